"""Sources mixed to target weights of the total tokens, none repeated too often, with the shares reached.

Weights go down a tree from the whole over the sources to their domains and the languages of each (``levels``); a source
weighs its target, what is below it a power of its tokens, so that small languages get more than their part. What a node
can't give, even repeated, its siblings take on first, then those of its ancestors. Each leaf's texts are put in a new seeded order per epoch and its budget is a prefix of that stream of tokens, so
the last text may be used in part.

Results for odd input: equal texts are one text, used together at most ``max_repeats`` times, and belong to the source
of the earliest document among those whose source has a target that can be met; texts without tokens and sources without a target are left out; null languages and domains are one each;
null or negative shares and repeats count as 0; without ``total`` the mix is the largest that meets all targets that
can be met at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.prefix import running_total
from loomwork.functions.shared import written
from loomwork.llm.tokens import TOKENIZER, with_tokens

LEAVES = 100_000  # leaves of the tree, which is planned on the driver; more are refused
LEVELS = ("project", "lang")  # the tree below a source: its domains, and the languages of each
ALPHA = 0.7  # power of the tokens by which nodes below a source weigh


def pour(amount: float, weights: dict, limits: dict) -> dict:
    """``amount`` shared by weight, nobody beyond their limit; what some can't take the others share again."""
    out = {k: 0.0 for k in weights}
    open_ = {k for k in weights if weights[k] > 0 and limits[k] > 0}
    while open_ and amount > 1e-9:
        whole = sum(weights[k] for k in open_)
        full = {k for k in open_ if out[k] + amount * weights[k] / whole >= limits[k] - 1e-9}
        if not full:
            for k in open_:
                out[k] += amount * weights[k] / whole
            return out
        for k in full:
            amount -= limits[k] - out[k]
            out[k] = limits[k]
        open_ -= full
    return out


def plan(leaves: dict[tuple, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None, alpha: float = 1.0) -> dict[tuple, int]:
    """Tokens for each leaf, a tuple ``(source, ...)`` of the levels from the top down, of given tokens.

    A source weighs its target, any node below it its tokens to the power ``alpha``: below 1 small siblings get more than
    their part, until their repeats are used up and the larger ones take on what they lack.
    """
    limits = {leaf: n * repeats.get(leaf[0], 0) for leaf, n in leaves.items()}
    by_source: dict[str, int] = {}
    for leaf, n in limits.items():
        by_source[leaf[0]] = by_source.get(leaf[0], 0) + n
    weights = {s: max(0.0, shares.get(s) or 0.0) for s in by_source}
    able = {s: w for s, w in weights.items() if w > 0 and by_source[s] > 0}
    if total is None:
        whole = sum(able.values())
        total = int(min((by_source[s] * whole / w for s, w in able.items()), default=0))

    def share_out(amount: float, under: dict[tuple, int], depth: int) -> dict[tuple, int]:
        children: dict[str, dict[tuple, int]] = {}
        for leaf, n in under.items():
            children.setdefault(leaf[depth] if depth < len(leaf) else "", {})[leaf] = n
        if depth >= max((len(leaf) for leaf in under), default=0):
            return {leaf: round(amount) for leaf in under}
        weigh = weights if depth == 0 else {c: sum(held.values()) ** alpha for c, held in children.items()}
        bound = {c: sum(limits[leaf] for leaf in held) for c, held in children.items()}
        out: dict[tuple, int] = {}
        for c, part in pour(amount, {c: weigh[c] for c in children}, bound).items():
            out |= share_out(part, children[c], depth + 1)
        return out

    return share_out(total, leaves, 0)


def mix(
    documents: DataFrame, targets: DataFrame, total: int | float | None = None, seed: int = 0, tokenizer: str = TOKENIZER, levels: tuple[str, ...] = LEVELS, alpha: float = ALPHA
) -> DataFrame:
    """What is used: ``doc_id, source``, the other levels, ``epoch, n_tokens, used_tokens``, a row per text and epoch.

    ``levels`` are the columns of the tree below the source, from the top down; those that ``documents`` lacks are left out. ``total`` is a number of tokens, or with a
    fraction the multiple of all tokens held.
    """
    levels = tuple(c for c in levels if c in documents.columns)
    wanted = targets.select("source", "target_share", "max_repeats").dropna(subset=["source"]).dropDuplicates(["source"]).take(LEAVES + 1)
    if len(wanted) > LEAVES:
        raise ValueError(f"more than {LEAVES} sources have a target")
    shares = {r.source: r.target_share for r in wanted}
    repeats = {r.source: max(0, r.max_repeats or 0) for r in wanted}
    usable = documents.sparkSession.createDataFrame([(s,) for s, w in shares.items() if (w or 0) > 0 and repeats[s] > 0], "source string")
    targeted = documents.filter(F.length("text") > 0).join(F.broadcast(usable), "source", "left_semi")  # at most LEAVES sources
    texts = targeted.groupBy(F.sha2("text", 256).alias("key")).agg(F.min(F.struct("doc_id", "source", *levels)).alias("d"), F.first("text").alias("text"))
    sized = with_tokens(texts.select("d.*", "text"), "text", tokenizer=tokenizer).drop("text").withColumns({c: F.coalesce(F.lower(F.trim(c)), F.lit("und")) for c in levels})
    sized = written(sized.filter(F.col("n_tokens") > 0), "sizes")
    tree = ["source", *levels]
    found = sized.groupBy(*tree).agg(F.sum("n_tokens").alias("n")).take(LEAVES + 1)
    if len(found) > LEAVES:
        raise ValueError(f"more than {LEAVES} leaves; group their levels first")
    sizes = {tuple(r[c] for c in tree): r.n for r in found if r.source in shares}
    if isinstance(total, float):
        total = int(total * sum(sizes.values()))
    budgets = plan(sizes, shares, repeats, total, alpha)
    rows = [(*leaf, b // sizes[leaf], b % sizes[leaf]) for leaf, b in budgets.items() if b > 0]
    budget = documents.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in tree) + ", whole long, rest long")
    held = sized.join(F.broadcast(budget), tree)  # at most LEAVES rows
    full = held.filter(F.col("whole") > 0).select("doc_id", *tree, F.explode(F.sequence(F.lit(1), F.col("whole").cast("int"))).alias("epoch"), "n_tokens", F.col("n_tokens").alias("used_tokens"))
    last = running_total(held.filter(F.col("rest") > 0), tree, [F.col("doc_id"), F.lit(seed), F.col("whole")], F.col("n_tokens"), "before")
    part = last.filter(F.col("before") < F.col("rest")).select(
        "doc_id", *tree, (F.col("whole") + 1).cast("int").alias("epoch"), "n_tokens", F.least("n_tokens", F.col("rest") - F.col("before")).alias("used_tokens")
    )
    return full.unionByName(part)


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: ``source, target_share, used_tokens, share, max_uses, n_texts``."""
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("used_tokens").alias("used"))
    sums = uses.groupBy("source").agg(F.sum("used").alias("used_tokens"), F.max("uses").alias("max_uses"), F.count("*").alias("n_texts"))
    joined = targets.select("source", "target_share").dropDuplicates(["source"]).join(sums, "source", "left").fillna(0, ["used_tokens", "max_uses", "n_texts"])
    whole = joined.groupBy(F.lit(1).alias("k")).agg(F.sum("used_tokens").alias("whole"))
    return joined.withColumn("k", F.lit(1)).join(F.broadcast(whole), "k").select("source", "target_share", "used_tokens", F.when(F.col("whole") > 0, F.col("used_tokens") / F.col("whole")).otherwise(0.0).alias("share"), "max_uses", "n_texts")

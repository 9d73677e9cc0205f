"""Train, validation and test splits that keep everything linked together.

Sessions that share a tool use id are linked, also over further sessions. The components are found by Borůvka's minimum-edge
contraction: each component picks its least outgoing edge, the picked edges join the spanning forest, and what they
connect becomes one component, until no edge leads out. The forest is written after every round. The roots are then put into
size bands and dealt to the splits, systematically within each band, the largest bands first.

Results for odd input: a session is the first uuid its field holds; an id is the ``toolu_`` id its field holds, and one
too short or without variety stands in for a missing one and links nothing; a row without session goes with the sessions
of its id, and without either by itself; shares are taken relative to their sum, and null or negative ones as 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.prefix import running_total
from loomwork.functions.shared import forget, written

SPLITS = 1000  # splits at once; more are refused
FEW = 64  # roots of a band that are dealt one by one
GOLDEN = (math.sqrt(5) - 1) / 2


def session_of(field: Column) -> Column:
    """The uuid in the field, in lower case with hyphens; null if it holds none."""
    parts = [F.regexp_extract(F.lower(field), r"(?<![0-9a-f])([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})(?![0-9a-f])", i) for i in range(1, 6)]
    return F.when(parts[0] != "", F.concat_ws("-", *parts))


def tool_use_of(field: Column) -> Column:
    """The id in the field; null if it holds none or a stand-in."""
    body = F.regexp_extract(field, r"(?<![0-9A-Za-z])toolu_([0-9A-Za-z]{16,})(?![0-9A-Za-z_])", 1)
    return F.when((body != "") & (F.size(F.array_distinct(F.split(body, ""))) >= 6), F.concat(F.lit("toolu_"), body))


def links(label_rows: DataFrame) -> DataFrame:
    """Edges between sessions that share an id, a star around the least: ``a, b, weight`` with a < b and distinct weights."""
    held = label_rows.select(session_of(F.col("session")).alias("session"), tool_use_of(F.col("tool_use_id")).alias("id")).dropna().distinct()
    least = held.groupBy("id").agg(F.min("session").alias("a"), F.max("session").alias("most")).filter(F.col("a") != F.col("most")).drop("most")
    pairs = held.join(least, "id").filter(F.col("session") != F.col("a")).select("a", F.col("session").alias("b")).distinct()
    return pairs.withColumn("weight", F.struct(F.xxhash64("a", "b").alias("h"), "a", "b"))


def forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spanning forest and components of ``edges``: the picked ``a, b`` and, per node, ``node, root``.

    The root is the least node of its component. Written after each round; a round at least halves the components that
    still have edges leading out.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = written(nodes.withColumn("root", F.col("node")), "labels")
    open_edges = written(edges.select("a", "b", "weight", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    picked = None
    while not open_edges.isEmpty():
        ends = open_edges.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "weight").unionByName(open_edges.select(F.col("cb").alias("c"), F.col("ca").alias("to"), "weight"))
        best = written(ends.groupBy("c").agg(F.min(F.struct("weight", "to")).alias("m")).select("c", F.col("m.to").alias("to"), "m.weight"), "picked")
        own = best.select("weight.a", "weight.b").distinct()
        picked = own if picked is None else picked.unionByName(own)
        # the picked edges form trees that end in one mutual pair each; its lesser component is the new root
        x, y = best.select("c", "to").alias("x"), best.select(F.col("c").alias("c2"), F.col("to").alias("to2")).alias("y")
        up = x.join(y, F.col("x.to") == F.col("y.c2")).select("c", F.when((F.col("to2") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up"))
        up = written(up, "parents")
        while True:  # pointer jumping doubles the steps taken each time
            above = up.select(F.col("c").alias("c2"), F.col("up").alias("up2"))
            jumped = written(up.join(above, up.up == above.c2).select("c", F.col("up2").alias("up"), (F.col("up2") != F.col("up")).alias("moved")), "parents")
            forget(up)
            done = jumped.filter("moved").isEmpty()
            up = jumped.select("c", "up")
            if done:
                break
        new = up.select(F.col("c").alias("root"), "up")
        fresh = labels.join(new, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        fresh = written(fresh, "labels")
        forget(labels)
        labels = fresh
        a, b = up.select(F.col("c").alias("ca"), F.col("up").alias("ua")), up.select(F.col("c").alias("cb"), F.col("up").alias("ub"))
        left = open_edges.join(a, "ca").join(b, "cb").filter(F.col("ua") != F.col("ub"))
        lean = left.groupBy(F.least("ua", "ub").alias("ca"), F.greatest("ua", "ub").alias("cb")).agg(F.min("weight").alias("weight")).select("weight.a", "weight.b", "weight", "ca", "cb")
        lean = written(lean, "edges")
        forget(open_edges)
        forget(up)
        open_edges = lean
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    named = labels.join(least, "root").select("node", F.col("least").alias("root"))
    return (edges.select("a", "b").limit(0) if picked is None else picked), named


def session_forest(label_rows: DataFrame) -> DataFrame:
    """The spanning forest that was built and stays in the shared folder: its edges ``root, a, b``, one fewer than nodes in each tree."""
    picked, named = forest(written(links(label_rows), "links"))
    return picked.distinct().join(named.select(F.col("node").alias("a"), "root"), "a").select("root", "a", "b")


def session_groups(label_rows: DataFrame) -> DataFrame:
    """One row per linked session with its group and the group's size: ``session, root, n_sessions``."""
    _, named = forest(written(links(label_rows), "links"))
    return named.join(named.groupBy("root").agg(F.count("*").alias("n_sessions")), "root").select(F.col("node").alias("session"), "root", "n_sessions")


def linked_sessions(label_rows: DataFrame) -> DataFrame:
    """Pairs of sessions that must stay together: ``session_a, session_b`` with the smaller first."""
    _, named = forest(written(links(label_rows), "links"))
    a = named.select("root", F.col("node").alias("session_a"))
    b = named.select("root", F.col("node").alias("session_b"))
    return a.join(b, "root").filter(F.col("session_a") < F.col("session_b")).select("session_a", "session_b")


def _groups(label_rows: DataFrame) -> DataFrame:
    """``label_rows`` with ``group``: what must stay together. Columns of the names added here are replaced."""
    label_rows = label_rows.drop("group", "split_name")
    _, named = forest(written(links(label_rows), "links"))
    rows = label_rows.withColumn("__s", session_of(F.col("session"))).withColumn("__i", tool_use_of(F.col("tool_use_id")))
    by_id = rows.filter(F.col("__s").isNotNull() & F.col("__i").isNotNull()).groupBy(F.col("__i").alias("__id")).agg(F.min("__s").alias("__of_id"))
    joined = rows.join(by_id, F.when(F.col("__s").isNull(), F.col("__i")) == F.col("__id"), "left")
    anchor = F.coalesce("__s", "__of_id", "__i", F.concat(F.lit("row:"), F.sha1(F.to_json(F.struct(*label_rows.columns)))))
    anchored = joined.withColumn("__anchor", anchor)
    return anchored.join(named.select(F.col("node").alias("__anchor"), F.col("root").alias("__root")), "__anchor", "left").select(*label_rows.columns, F.coalesce("__root", "__anchor").alias("group"))


def deal(sizes: DataFrame, targets: list[tuple[str, float]], seed: int = 0) -> DataFrame:
    """A split for each of ``group, n``: bands of sizes from the largest down, each dealt to what the splits still lack."""
    total_share = sum(max(0.0, s or 0.0) for _, s in targets) or 1.0
    shares = [(name, max(0.0, s or 0.0) / total_share) for name, s in targets]
    banded = sizes.withColumn("band", F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)))).cast("int"))
    bands = banded.groupBy("band").agg(F.count("*").alias("roots"), F.sum("n").alias("rows")).orderBy(F.desc("band")).collect()  # at most 64
    total = sum(b["rows"] for b in bands)
    lacks = {name: share * total for name, share in shares}
    few = [b.band for b in bands if b.roots <= FEW]
    single: dict[int, list] = {b: [] for b in few}
    for r in banded.filter(F.col("band").isin(few)).collect() if few else []:  # at most FEW in each of 64 bands
        single[r.band].append((-r.n, r.group))
    dealt: list[tuple[str, str]] = []
    cuts: list[tuple[int, float, str]] = []
    for b in bands:
        if b.band in single:
            for n, group in sorted(single[b.band]):
                to = max(lacks, key=lambda k: (lacks[k], k))
                lacks[to] += n
                dealt.append((group, to))
            continue
        open_ = {k: max(0.0, v) for k, v in lacks.items()}
        whole = sum(open_.values()) or 1.0
        at = 0.0
        for name, v in open_.items():
            at += v / whole
            cuts.append((b.band, at, name))
            lacks[name] -= b["rows"] * v / whole
    spark = sizes.sparkSession
    out = spark.createDataFrame(dealt, "group string, split_name string")
    many = banded.filter(~F.col("band").isin(few)) if few else banded
    ranked = running_total(many, ["band"], [F.col("group"), F.lit(seed)], F.lit(1), "rank")
    place = F.col("rank") * GOLDEN + 0.5
    place = place - F.floor(place)  # evenly spread however many roots are dealt
    pick = F.lit(shares[-1][0])
    for band, at, name in reversed(cuts):
        pick = F.when((F.col("band") == band) & (place < at), name).otherwise(pick)
    return ranked.select("group", pick.alias("split_name")).unionByName(out)


def split_rows(label_rows: DataFrame, split_targets: DataFrame, seed: int = 0) -> DataFrame:
    """``label_rows`` with ``group`` and ``split_name``; ``split_targets`` has a row per split, a handful."""
    targets = [(r.split_name, r.target_share) for r in split_targets.select("split_name", "target_share").dropna(subset=["split_name"]).dropDuplicates(["split_name"]).orderBy("split_name").take(SPLITS + 1)]
    if len(targets) > SPLITS:
        raise ValueError(f"more than {SPLITS} splits")
    if not targets:
        raise ValueError("there are no splits to assign to")
    grouped = written(_groups(label_rows), "groups")
    assigned = deal(grouped.groupBy("group").agg(F.count("*").alias("n")), targets, seed)
    return grouped.join(assigned, "group")


def split_shares(label_rows: DataFrame, split_targets: DataFrame, seed: int = 0) -> DataFrame:
    """Per split: ``split_name, target_share, n_rows, n_groups, share``."""
    rows = split_rows(label_rows, split_targets, seed)
    counts = rows.groupBy("split_name").agg(F.count("*").alias("n_rows"), F.count_distinct("group").alias("n_groups"))
    joined = split_targets.select("split_name", "target_share").dropDuplicates(["split_name"]).join(counts, "split_name", "left").fillna(0, ["n_rows", "n_groups"])
    joined = joined.withColumn("total", F.sum("n_rows").over(Window.partitionBy()))  # a row per split
    return joined.select("split_name", "target_share", "n_rows", "n_groups", F.when(F.col("total") > 0, F.col("n_rows") / F.col("total")).alias("share"))

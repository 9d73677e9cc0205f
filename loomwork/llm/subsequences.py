"""Ordered patterns, gaps allowed, that many sequences contain, with their support.

Two phases. Each partition of the sequences is mined on its own at the same share of its sequences: a pattern frequent
overall is so in at least one partition. The union of what the partitions found is then counted exactly over every
sequence. Both phases walk patterns step by step over a table that tells, for each position, where each step next occurs.

A sequence longer than ``LONG`` steps is first cut to a shorter one that contains exactly the same patterns of up to
``longest`` steps, stretch by stretch, so one huge sequence needs no more room than many small ones.

Results for odd input: sequences without steps count for nothing, not even for the total; equal sequences each count;
an origin without sequences gives no rows; steps that name no known tool stay as they are written, folded.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.shared import written
from loomwork.llm import runs
from loomwork.llm.toolnames import Catalog, flow_steps, folded

ARROW = " → "
LONG = 512  # steps beyond which a sequence is cut to an equivalent one
JOINED = 64  # neighbouring stretches joined at once
STRETCH = 512  # flows of one session that are read together
PER_PARTITION = 12_000  # sequences mined together
STEPS = 400_000  # steps mined together, where sequences are long
CANDIDATES = 400_000  # patterns counted in one pass; more are counted in several

def equivalent(steps: np.ndarray, longest: int) -> np.ndarray:
    """Positions of a shorter sequence that contains the same patterns of up to ``longest`` steps.

    A position matters only if some pattern ends there when matched as early as possible and some pattern starts there
    when matched as late as possible, and the two together, sharing it, are no longer than ``longest``.
    """

    def depth(order: range, kept: np.ndarray, seen: np.ndarray | None) -> np.ndarray:
        found = np.full(len(steps), longest + 1)
        least: dict[int, int] = {}  # per step: the least depth since its last occurrence, itself included
        for i in order:
            if not kept[i]:
                continue
            d = least.get(steps[i], 0) + 1
            if d > longest or (seen is not None and d + seen[i] > longest + 1):
                continue
            found[i] = d
            for s in least:
                if least[s] > d:
                    least[s] = d
            least[steps[i]] = d
        return found

    left = depth(range(len(steps)), np.ones(len(steps), dtype=bool), None)
    right = depth(range(len(steps) - 1, -1, -1), left <= longest, left)
    return np.flatnonzero(right <= longest)


def cut(steps: list, longest: int) -> list:
    """``steps``, or an equivalent shorter list if there are more than ``LONG``."""
    if len(steps) <= LONG:
        return list(steps)
    codes = pd.factorize(np.asarray(steps, dtype=object))[0]
    return [steps[i] for i in equivalent(codes, longest)]


class Sequences:
    """A partition's sequences as one table of next occurrences."""

    def __init__(self, sequences: list[list[str]], wanted: set[str]):
        """Steps that aren't wanted are left out; no pattern asked for has them."""
        sequences = [[s for s in q if s in wanted] for q in sequences]
        self.n = len(sequences)
        flat = [s for q in sequences for s in q]
        codes, names = pd.factorize(np.asarray(flat, dtype=object)) if flat else (np.zeros(0, int), [])
        self.names = list(names)
        self.code = {s: i for i, s in enumerate(self.names)}
        lengths = np.fromiter((len(q) for q in sequences), int, self.n)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1].astype(np.int32)
        rows = len(flat) + self.n
        self.next = np.zeros((rows, len(self.names)), np.int32)  # the row after the next occurrence; 0: none
        step_at = np.full(rows, -1)
        step_at[np.arange(len(flat)) + np.repeat(np.arange(self.n), lengths)] = codes
        ends = self.starts + lengths
        for back in range(1, int(lengths.max(initial=0)) + 1):  # all sequences at once, from their ends
            at = (ends - back)[lengths >= back]
            self.next[at] = self.next[at + 1]
            self.next[at, step_at[at]] = at + 1

    def mine(self, least: int, shortest: int, longest: int) -> Iterator[tuple[str, ...]]:
        """Every pattern of the wanted lengths that at least ``least`` sequences contain."""
        stack = [((), self.starts)]
        while stack:
            pattern, at = stack.pop()
            table = self.next[at]
            counts = np.count_nonzero(table, axis=0)
            for c in np.flatnonzero(counts >= least):
                longer = (*pattern, self.names[c])
                if len(longer) >= shortest:
                    yield longer
                if len(longer) < longest:
                    column = table[:, c]
                    stack.append((longer, column[column > 0]))

    def count(self, patterns: list[tuple[str, ...]]) -> Iterator[tuple[int, int]]:
        """Number and support of every given pattern that occurs; patterns come sorted."""
        stack: list[tuple[tuple[int, ...], np.ndarray]] = [((), self.starts)]
        for no, pattern in enumerate(patterns):
            codes = tuple(self.code.get(s, -1) for s in pattern)
            keep = 0
            while keep < min(len(stack) - 1, len(codes)) and stack[keep + 1][0][-1] == codes[keep]:
                keep += 1
            del stack[keep + 1 :]
            for c in codes[keep:]:
                at = stack[-1][1]
                found = self.next[at, c] if c >= 0 and len(at) else at[:0]
                stack.append(((*stack[-1][0], c), found[found > 0]))
            if len(stack[-1][1]):
                yield no, len(stack[-1][1])


def _counter(sent: Broadcast):
    def count(group: pd.DataFrame) -> pd.DataFrame:
        origin = group["origin"].iloc[0]
        patterns = sent.value[origin]
        found = list(Sequences(list(group["steps"]), {s for p in patterns for s in p}).count(patterns))
        return pd.DataFrame({"origin": [origin] * len(found), "steps": [list(patterns[i]) for i, _ in found], "support": [k for _, k in found]})

    return count


def frequent(sequences: DataFrame, share: float, least: int, shortest: int, longest: int, partitions: int | None = None) -> DataFrame:
    """Patterns of ``sequences (origin, steps)`` that reach both limits: ``origin, pattern, steps, support, sequences``."""
    spark = sequences.sparkSession
    full = written(sequences.filter(F.size("steps") > 0).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "sequences")
    found = full.groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.size("steps")).alias("steps")).collect()  # one row per origin, a handful
    totals = {r.origin: r.n for r in found}
    limits = {o: max(least, math.ceil(share * n - 1e-9)) for o, n in totals.items()}
    shares = {o: limits[o] / n for o, n in totals.items()}
    parts = {r.origin: partitions or max(1, round(max(r.n / PER_PARTITION, r.steps / STEPS))) for r in found}
    sizes = spark.createDataFrame([(o, p) for o, p in parts.items()], "origin string, parts int")
    # dealt in even shares: one group per origin and number
    dealt = full.join(F.broadcast(sizes), "origin").select("origin", F.pmod("deal", "parts").cast("int").alias("part"), "steps")

    def mine(group: pd.DataFrame) -> pd.DataFrame:
        origin = group["origin"].iloc[0]
        limit = max(1, math.ceil(shares[origin] * len(group) - 1e-9))
        held = Counter(s for q in group["steps"] for s in set(q))
        often = {s for s, n in held.items() if n >= limit}
        found = list(Sequences(list(group["steps"]), often).mine(limit, shortest, longest))
        return pd.DataFrame({"origin": [origin] * len(found), "steps": [list(p) for p in found]})

    kind = "origin string, steps array<string>"
    candidates = written(dealt.groupBy("origin", "part").applyInPandas(mine, kind).distinct(), "candidates")
    n = candidates.count()
    blocks = max(1, math.ceil(n / CANDIDATES))
    counted = None
    for b in range(blocks):
        own = candidates if blocks == 1 else candidates.filter(F.pmod(F.xxhash64("origin", "steps"), F.lit(blocks)) == b)
        known: dict[str, list] = {o: [] for o in totals}
        for r in own.collect():  # bounded by CANDIDATES
            known[r.origin].append(tuple(r.steps))
        for v in known.values():
            v.sort()
        sent = spark.sparkContext.broadcast(known)

        some = dealt.groupBy("origin", "part").applyInPandas(_counter(sent), kind + ", support long").groupBy("origin", "steps").agg(F.sum("support").alias("support"))
        counted = some if counted is None else counted.unionByName(some)
    bounds = spark.createDataFrame([(o, limits[o], totals[o]) for o in totals], "origin string, least long, sequences long")
    enough = counted.join(F.broadcast(bounds), "origin").filter(F.col("support") >= F.col("least"))
    return enough.select("origin", F.array_join("steps", ARROW).alias("pattern"), "steps", "support", "sequences")


def _shorten(longest: int):
    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(steps=[cut(list(s), longest) for s in batch["steps"]])

    return short


def _joined(stretches: DataFrame, key: list[str], longest: int, last: int) -> DataFrame:
    """One sequence per key from stretches numbered up to ``last``: neighbours are joined and cut, level by level."""
    kind = ", ".join(f"{k} string" for k in key) + ", stretch long, steps array<string>"
    level = stretches.select(*key, "stretch", "steps").filter(F.size("steps") <= LONG).unionByName(stretches.select(*key, "stretch", "steps").filter(F.size("steps") > LONG).mapInPandas(_shorten(longest), kind))
    while True:
        last //= JOINED
        parts = F.array_sort(F.collect_list(F.struct("stretch", "steps")))
        level = level.withColumn("group", F.floor(F.col("stretch") / JOINED) if last else F.lit(0)).groupBy(*key, "group").agg(F.flatten(F.transform(parts, lambda p: p["steps"])).alias("steps"))
        level = level.select(*key, F.col("group").cast("long").alias("stretch"), "steps")
        if not last:
            return level.select(*key, "steps")
        level = level.mapInPandas(_shorten(longest), kind)


def _last_stretch(table: DataFrame, order: str, size: int) -> int:
    return int((table.agg(F.max(order).alias("most")).first().most or 0) // size)


def call_sequences(subagent: DataFrame, tools: Catalog, longest: int = 4) -> DataFrame:
    """The tools of each conversation, each run once: ``origin, steps``."""
    found = _joined(runs.tool_sequences(subagent, tools), ["session", "side"], longest, _last_stretch(subagent, "line_no", runs.C.STRETCH))
    return found.select(F.lit("subagent").alias("origin"), "steps")


def flow_sequences(flows: DataFrame, tools: Catalog, longest: int = 4) -> DataFrame:
    """The steps of each session's flows in order: ``origin, steps``. Flows without a session belong to none."""
    kept = flows.filter(F.col("session").isNotNull()).select("session", F.coalesce(F.floor(F.col("seq_no") / STRETCH), F.lit(-1)).cast("long").alias("stretch"), F.struct("seq_no", "flow_id", "flow").alias("row"))
    grouped = kept.groupBy("session", "stretch").agg(F.array_sort(F.collect_set("row")).alias("rows")).select("session", "stretch", F.col("rows.flow_id").alias("ids"), F.col("rows.flow").alias("flows"))

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ids, texts in zip(batch["ids"], batch["flows"]):
                seen: set = set()
                own = []
                for i, text in zip(ids, texts):
                    if i is None or i not in seen:
                        own += flow_steps(text, tools)
                    seen.add(i)
                out.append(cut(own, longest))
            yield batch[["session", "stretch"]].assign(steps=pd.Series(out, index=batch.index, dtype=object))

    found = grouped.mapInPandas(steps, "session string, stretch long, steps array<string>")
    return _joined(found, ["session"], longest, _last_stretch(flows, "seq_no", STRETCH)).select(F.lit("flow_discovery").alias("origin"), "steps")


def frequent_patterns(subagent: DataFrame, flows: DataFrame, tools: Catalog, share: float = 0.06, least: int = 3, shortest: int = 3, longest: int = 4) -> DataFrame:
    """Patterns that reach the limits within their origin."""
    both = call_sequences(subagent, tools, longest).unionByName(flow_sequences(flows, tools, longest))
    return frequent(both, share, least, shortest, longest)

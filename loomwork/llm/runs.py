"""Runs of calls of one tool: each run becomes one event with its number of calls and its duration.

The calls of a stretch of a conversation are written as a string with one code point per tool, and the pattern
``(.)\\1*`` cuts it into runs; spans of the string give the first and last call of each run. Runs that touch the ends of
their stretch are joined with those of the neighbouring stretches.

Results for odd input: a call without a name names no tool, so it forms no run and ends one; calls without id keep
null ids; the duration is null if no call of the run has a readable time, 0 if just one has; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm import conversation as C
from loomwork.llm.toolnames import Catalog

_RUN = re.compile(r"(.)\1*", re.DOTALL)
_SYMBOLS = 0x10000  # the first code point used; beyond the surrogates
_RUN_TYPE = "session string, side string, stretch long, no int, n int, tool string, first_id string, last_id string, first_us long, last_us long, at_start boolean, at_end boolean"
_COLUMNS = [c.split()[0] for c in _RUN_TYPE.split(", ")]


def calls(subagent: DataFrame) -> DataFrame:
    """One row per stretch: ``session, side, stretch`` and the arrays ``ids, names, uss`` (microseconds) of its calls in order."""
    uses = F.filter("content", lambda b: C.block_type(b) == "tool_use")
    named = C.rows(subagent).select("session", "side", "stretch", F.struct("line_no", "row_id", "logged_at", F.transform(uses, lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"))).alias("uses")).alias("row"))
    grouped = named.filter(F.size("row.uses") > 0).groupBy("session", "side", "stretch").agg(C.gathered(F.col("row")).alias("rows"))
    flat = F.flatten(F.transform("rows", lambda r: F.transform(r["uses"], lambda u: F.struct(u["id"].alias("id"), u["name"].alias("name"), F.unix_micros(C.moment(r["logged_at"])).alias("us")))))
    found = grouped.select("session", "side", "stretch", flat.alias("calls"))
    return found.select("session", "side", "stretch", *(F.col(f"calls.{c}").alias(f"{c}s") for c in ("id", "name", "us")))


def symbol_runs(tools: list[str | None]) -> list[tuple[int, int]]:
    """Start and length of every run, from the string of the tools' symbols; a missing tool equals nothing."""
    symbols: dict[object, str] = {}
    text = "".join(symbols.setdefault(t if t is not None else ("none", i), chr(_SYMBOLS + len(symbols))) for i, t in enumerate(tools))
    return [(m.start(), m.end() - m.start()) for m in _RUN.finditer(text)]


def stretch_runs(subagent: DataFrame, tools: Catalog) -> DataFrame:
    """The runs of every stretch, one row each; a stretch's first and last are marked."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for session, side, stretch, ids, names, times in batch.itertuples(index=False, name=None):
                own = [None if n is None else tools.resolve(n) for n in names]
                spans = symbol_runs(own)
                for no, (start, n) in enumerate(spans):
                    known = [int(t) for t in times[start : start + n] if t is not None and t == t]
                    out.append((session, side, stretch, no, n, own[start], ids[start], ids[start + n - 1], min(known, default=None), max(known, default=None), no == 0, no == len(spans) - 1))
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(_COLUMNS, zip(*out) if out else [[]] * len(_COLUMNS))})

    return calls(subagent).mapInPandas(find, _RUN_TYPE)


def tool_runs(subagent: DataFrame, tools: Catalog, least: int = 1) -> DataFrame:
    """Every run of at least ``least`` calls: ``session, side, tool, first_id, last_id, n_events, started_at, ended_at, seconds``."""
    each = stretch_runs(subagent, tools)
    touches = F.col("at_start") | F.col("at_end")
    within = each.filter(~touches & (F.col("n") >= least))
    order = Window.partitionBy("session", "side").orderBy("stretch", "no")
    goes_on = F.col("at_start") & F.lag("at_end").over(order) & (F.lag("tool").over(order) == F.col("tool"))
    edges = each.filter(touches).withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    at = F.struct("stretch", "no")
    joined = edges.groupBy("session", "side", "run").agg(
        F.sum("n").cast("int").alias("n"),
        F.max("tool").alias("tool"),
        F.min_by("first_id", at).alias("first_id"),
        F.max_by("last_id", at).alias("last_id"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    )
    columns = ["session", "side", "tool", "first_id", "last_id", "n", "first_us", "last_us"]
    both = within.select(columns).unionByName(joined.filter(F.col("n") >= least).select(columns))
    return both.select(
        "session", "side", "tool", "first_id", "last_id", F.col("n").alias("n_events"), F.timestamp_micros("first_us").alias("started_at"), F.timestamp_micros("last_us").alias("ended_at"),
        ((F.col("last_us") - F.col("first_us")) / 1_000_000).alias("seconds"),
    )


def repeated_runs(subagent: DataFrame, tools: Catalog) -> DataFrame:
    """Runs of two or more calls that name one tool."""
    return tool_runs(subagent, tools, 2).filter(F.col("tool").isNotNull())


def tool_sequences(subagent: DataFrame, tools: Catalog) -> DataFrame:
    """The tools of each stretch with each run once, also across stretches: ``session, side, stretch, steps``."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            steps = []
            for names in batch["names"]:
                own = [None if n is None else tools.resolve(n) for n in names]
                steps.append([own[start] for start, _ in symbol_runs(own)])
            yield batch[["session", "side", "stretch"]].assign(steps=pd.Series(steps, index=batch.index, dtype=object))

    each = calls(subagent).select("session", "side", "stretch", "names").mapInPandas(find, "session string, side string, stretch long, steps array<string>")
    before = F.lag(F.try_element_at("steps", F.lit(-1))).over(Window.partitionBy("session", "side").orderBy("stretch"))
    begun = each.withColumn("before", before)
    steps = F.when(F.get("steps", 0) == F.col("before"), F.slice("steps", 2, F.size("steps"))).otherwise(F.col("steps"))
    return begun.select("session", "side", "stretch", F.filter(steps, lambda s: s.isNotNull()).alias("steps"))

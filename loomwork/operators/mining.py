"""Flows of work: segments after prompts, repeated steps, windows of steps, forward-closed and maximal patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSPECTION = ["Read", "Grep", "Glob", "LS", "WebFetch", "WebSearch", "TodoWrite", "BashOutput", "NotebookRead", "ToolSearch"]
LOOKING = ["ls", "cat", "head", "tail", "grep", "rg", "find", "sed -n", "wc", "git status", "git log", "git diff", "git show", "pwd", "echo", "which"]
ARROW = " → "


def collapsed(steps: DataFrame, key: list[str], order: list[str], step: str = "step") -> DataFrame:
    """Steps without immediate repeats."""
    before = F.lag(step).over(Window.partitionBy(*key).orderBy(*order))
    return steps.withColumn("__b", before).filter(~F.col("__b").eqNullSafe(F.col(step))).drop("__b")


def sliding_sequences(steps: DataFrame, key: list[str], order: list[str], batch: str, width: int = 3, step: str = "step") -> DataFrame:
    """The last ``width`` steps after each batch, where they aren't all the same: ``*key, batch, sequence``."""
    run = Window.partitionBy(*key).orderBy(*order)
    seen = steps.withColumn("__s", F.collect_list(step).over(run.rowsBetween(1 - width, 0))).withColumn("__n", F.row_number().over(run))
    last = seen.groupBy(*key, batch).agg(F.max_by("__s", "__n").alias("s"))
    return last.filter((F.size("s") == width) & (F.size(F.array_distinct("s")) > 1)).select(*key, batch, F.array_join("s", ARROW).alias("sequence"))


def first_and_last_batch(steps: DataFrame, key: list[str], order: list[str], batch: str, step: str = "step") -> DataFrame:
    """The sequence of each session's first and last batch: ``*key, orient, verify``."""
    at = F.struct(*order)
    batches = steps.groupBy(*key, batch).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(step).alias("s")))).alias("x"))
    named = batches.select(*key, F.col("x")[0]["at"].alias("at"), F.array_join(F.transform("x", lambda s: s["s"]), ARROW).alias("q"))
    return named.groupBy(*key).agg(F.min_by("q", "at").alias("orient"), F.max_by("q", "at").alias("verify"))


def segments(events: DataFrame, key: list[str], order: list[str], is_prompt: Column, step: str = "step") -> DataFrame:
    """Steps between prompts as flows of two or more: ``*key, segment, flow, n_steps``."""
    run = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("segment", F.sum(F.when(is_prompt, 1).otherwise(0)).over(run)).withColumn("__p", is_prompt)
    steps = collapsed(marked.filter(~F.col("__p")), [*key, "segment"], order, step)
    grouped = steps.groupBy(*key, "segment").agg(F.array_sort(F.collect_list(F.struct(*order, step))).alias("x"))
    return grouped.filter(F.size("x") > 1).select(*key, "segment", F.array_join(F.transform("x", lambda s: s[step]), ARROW).alias("flow"), F.size("x").alias("n_steps"))


def is_actionable(flow: Column) -> Column:
    """Whether any step of a flow does more than look."""
    family = lambda s: F.regexp_extract(s, r"^Bash\((.*)\)$", 1)
    looks = lambda s: s.isin(INSPECTION) | F.exists(F.array(*map(F.lit, LOOKING)), lambda x: (family(s) == x) | F.startswith(family(s), F.concat(x, F.lit(" "))))
    return F.exists(F.split(flow, ARROW), lambda s: ~looks(s))


def best_flows(flows: DataFrame, intent: str, flow: str, session: str) -> DataFrame:
    """Per intent its flow that most sessions have: ``intent, flow, sessions``; ties go to the first flow."""
    counts = flows.groupBy(intent, flow).agg(F.count_distinct(session).alias("sessions"))
    best = counts.groupBy(intent).agg(F.max(F.struct("sessions", F.col(flow).alias("f"))).alias("b"), F.max("sessions").alias("m"))
    tied = counts.join(best.select(intent, "m"), intent).filter(F.col("sessions") == F.col("m"))
    return tied.groupBy(intent).agg(F.min(flow).alias(flow), F.max("sessions").alias("sessions"))


def forward_closed(sequences: DataFrame, support: float, longest: int = 4) -> DataFrame:
    """Gapped patterns of an array column ``steps``, without those that one more step at the end leaves as frequent:
    ``pattern, freq``."""
    from pyspark.ml.fpm import PrefixSpan

    single = sequences.filter(F.size("steps") > 0).select(F.transform("steps", lambda s: F.array(s)).alias("sequence"))
    found = PrefixSpan(minSupport=support, maxPatternLength=longest).findFrequentSequentialPatterns(single)
    flat = found.filter(~F.exists("sequence", lambda s: F.size(s) > 1)).select(F.flatten("sequence").alias("pattern"), "freq")
    longer = flat.filter(F.size("pattern") > 1).select(F.slice("pattern", 1, F.size("pattern") - 1).alias("head"), F.col("freq").alias("f2"))
    return flat.join(longer, (F.col("pattern") == F.col("head")) & (F.col("freq") == F.col("f2")) & (F.size("pattern") < longest), "left_anti")


def maximal(patterns: DataFrame, longest: int = 4) -> DataFrame:
    """Patterns that are part of no longer one. Each pattern names the shorter ones it holds, so no pairs are tried."""
    subs = F.array_distinct(F.flatten(F.array(*[_without(F.col("pattern"), mask, longest) for mask in range(2**longest)])))
    held = patterns.select(F.explode(subs).alias("pattern"), F.size("pattern").alias("n")).filter(F.size("pattern") < F.col("n")).select("pattern").distinct()
    return patterns.join(held, "pattern", "left_anti")


def _without(pattern: Column, mask: int, longest: int) -> Column:
    kept = F.filter(pattern, lambda s, i: F.array(*[F.lit(bool(mask >> k & 1)) for k in range(longest)])[i])
    return F.array(kept)

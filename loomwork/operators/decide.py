"""Which calls to keep, to shorten and to drop, within a budget per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import truncated_length
from loomwork.plans.options import MARK, MUTATING, UNREPEATABLE, Options


def freed_chars(action: Column, chars: Column, input_chars: Column, is_error: Column, head: int, cap: int = 0) -> Column:
    """Characters that an action frees; a kept output frees what a cap cuts."""
    kept = chars - truncated_length(chars, is_error, cap) if cap > 0 else F.lit(0)
    return F.when(action == "keep", kept).when(action == "drop_call", chars + input_chars).otherwise(chars - truncated_length(chars, is_error, head)).cast("long")


def provisional(keep_result: Column, keep_call: Column, options: Options, text: Column | None = None) -> tuple[Column, Column]:
    """Action and reason of a call on its own; the first that holds."""
    result, call = F.coalesce(keep_result, F.lit(1.0)), F.coalesce(keep_call, F.lit(1.0))
    t = options.keep_threshold
    reason = (
        F.when(F.col("pinned"), "pinned")
        .when(F.col("tool").isin(UNREPEATABLE), "unrepeatable")
        .when(result >= t, "kept")
        .when((call >= t) | F.col("tool").isin(MUTATING), "result_dropped")
        .otherwise("call_dropped")
    )
    if text is not None:  # what was cut before is not dropped whole
        reason = F.when((reason == "call_dropped") & F.coalesce(F.contains(text, F.lit(MARK)), F.lit(False)), "kept").otherwise(reason)
    action = F.when(reason == "result_dropped", "drop_result").when(reason == "call_dropped", "drop_call").otherwise("keep")
    return action, reason


def decide(calls: DataFrame, options: Options = Options(), key: list[str] | None = None) -> DataFrame:
    """Scored calls with ``action, reason, freed``.

    Drops that free too little are kept; of the others the lowest scores go first until the share of the session's droppable
    characters is freed; the one that crosses it still goes. ``freed`` counts a cap on kept outputs.
    """
    key = key or ["session"]
    text = F.col("result_text") if "result_text" in calls.columns else None
    input_chars = F.col("input_chars") if "input_chars" in calls.columns else F.lit(2)
    _, reason = provisional(F.col("keep_result"), F.col("keep_call"), options, text)
    first = calls.withColumn("__r", reason).withColumn("__a", F.when(F.col("__r") == "result_dropped", "drop_result").when(F.col("__r") == "call_dropped", "drop_call").otherwise("keep"))
    first = first.withColumn("__f", freed_chars(F.col("__a"), F.col("result_chars"), input_chars, F.col("is_error"), options.head_chars))
    first = first.withColumn("__d", (F.col("__a") != "keep") & (F.col("__f") >= options.min_yield_chars))
    droppable = F.when(F.col("__d"), F.col("__f")).otherwise(0)
    order = Window.partitionBy(*key).orderBy(F.desc("__d"), F.coalesce("keep_result", F.lit(1.0)), "call_seq").rowsBetween(Window.unboundedPreceding, -1)
    summed = first.withColumn("__before", F.coalesce(F.sum(droppable).over(order), F.lit(0))).withColumn("__all", F.sum(droppable).over(Window.partitionBy(*key)))
    spared = F.col("__before") >= F.lit(options.target_reduction) * F.col("__all")
    final = F.when(F.col("__a") == "keep", F.col("__r")).when(~F.col("__d"), "too small").when(spared, "budget").otherwise(F.col("__r"))
    decided = summed.withColumn("reason", final).withColumn("action", F.when(F.col("reason") == "result_dropped", "drop_result").when(F.col("reason") == "call_dropped", "drop_call").otherwise("keep"))
    freed = freed_chars(F.col("action"), F.col("result_chars"), input_chars, F.col("is_error"), options.head_chars, options.max_kept_chars)
    return decided.withColumn("freed", freed).drop("__r", "__a", "__f", "__d", "__before", "__all")


def session_stats(decisions: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Counts per session: calls, kept, results_dropped, calls_dropped, pinned, freed."""
    is_ = lambda *r: F.count_if(F.col("reason").isin(*r))
    return decisions.groupBy(*(key or ["session"])).agg(
        F.count("*").alias("calls"), is_("kept", "budget", "too small").alias("kept"), is_("result_dropped").alias("results_dropped"), is_("call_dropped").alias("calls_dropped"),
        is_("pinned", "unrepeatable").alias("pinned"), F.sum("freed").alias("freed"),
    )


def handover(stats: DataFrame, passes: Column, min_freed_percent: float = 5.0, max_passes: int = 6, trigger_percent: float = 62.0) -> DataFrame:
    """Whether a pass is taken: ``tokens_before, tokens_after, window`` (else told from the trigger) give ``freed_percent, taken, why``."""
    window = F.coalesce(F.nullif(F.col("window"), F.lit(0)), F.col("tokens_before") / F.lit(trigger_percent / 100))
    percent = F.when(window > 0, (F.col("tokens_before") - F.col("tokens_after")) * 100 / window).otherwise(0.0)
    why = F.when(passes >= max_passes, "passes used up").when(percent < min_freed_percent, "frees too little")
    return stats.withColumn("freed_percent", percent).withColumn("why", why).withColumn("taken", why.isNull())

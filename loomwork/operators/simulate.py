"""Policies replayed over labelled calls, and the loops of production."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.prefix import ordered_totals
from loomwork.operators.metrics import quantiles

from loomwork.functions.text import truncated_length
from loomwork.plans.options import CHARS_PER_TOKEN


def budget_drops(labels: DataFrame, floor: float = 0.2, target: float | None = 0.5) -> DataFrame:
    """Labels with ``dropped``: those below the floor, lowest first, until the share of their characters is freed."""
    low = F.col("score") < floor
    if target is None:
        return labels.withColumn("dropped", low)
    order = Window.partitionBy("session").orderBy(F.desc("__low"), "score", "tool_use_id").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.when(F.col("__low"), F.col("output_chars")).otherwise(0)
    run = labels.withColumn("__low", low).withColumn("__b", F.coalesce(F.sum(chars).over(order), F.lit(0))).withColumn("__t", F.sum(chars).over(Window.partitionBy("session")))
    return run.withColumn("dropped", F.col("__low") & (F.col("__b") < F.lit(target) * F.col("__t"))).drop("__low", "__b", "__t")


def policy_totals(dropped: DataFrame, floor: float = 0.2, head: int = 300) -> DataFrame:
    """Outcome of a policy: freed and total characters, wrong drops, those that keep a head, needed characters kept."""
    wrong = F.col("dropped") & F.col("result_needed")
    headed = wrong & (F.coalesce("call_score", F.lit(0.0)) >= floor)
    kept = F.when(F.col("result_needed") & ~F.col("dropped"), F.col("output_chars")).when(headed, F.least(F.lit(head), "output_chars")).otherwise(0)
    return dropped.agg(
        F.count("*").alias("calls"), F.count_if("result_needed").alias("needed"), F.sum("output_chars").alias("total"), F.sum(F.when(F.col("dropped"), F.col("output_chars")).otherwise(0)).alias("freed"),
        F.count_if("dropped").alias("n_dropped"), F.count_if(wrong).alias("wrong"), F.count_if(headed).alias("wrong_with_head"), F.sum(kept).alias("needed_chars_kept"),
        F.sum(F.when(F.col("result_needed"), F.col("output_chars")).otherwise(0)).alias("needed_chars"),
    )


def cap_sweep(calls: DataFrame, caps: list[int], chars: str = "result_chars") -> DataFrame:
    """What caps on outputs free: ``cap, capped_calls, kept_chars, freed_chars``."""
    each = calls.select(chars, "is_error", F.explode(F.array(*map(F.lit, caps))).alias("cap"))
    left = truncated_length(F.col(chars), F.col("is_error"), F.col("cap"))
    return each.groupBy("cap").agg(F.count_if(F.col(chars) != left).alias("capped_calls"), F.sum(left).alias("kept_chars"), F.sum(F.col(chars) - left).alias("freed_chars"))


def threshold_sweep(labels: DataFrame, thresholds: list[float], label: str = "result_needed", chars: str = "output_chars") -> DataFrame:
    """Operating points: ``threshold, freed_chars, wrong_drops, kept_needed, dominated``: whether another point frees as
    much and loses as little, and is better in one of the two."""
    each = labels.select("score", label, chars, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    low = F.col("score") < F.col("threshold")
    points = each.groupBy("threshold").agg(F.sum(F.when(low, F.col(chars)).otherwise(0)).alias("freed_chars"), F.count_if(low & F.col(label)).alias("wrong_drops"), F.count_if(~low & F.col(label)).alias("kept_needed"))
    more = Window.orderBy(F.desc("freed_chars")).rangeBetween(Window.unboundedPreceding, -1)  # a row per threshold
    as_much = Window.partitionBy("freed_chars")
    beaten = F.coalesce(F.min("wrong_drops").over(more) <= F.col("wrong_drops"), F.lit(False)) | (F.min("wrong_drops").over(as_much) < F.col("wrong_drops"))
    return points.withColumn("dominated", beaten)


def oracle_gap(labels: DataFrame, chars: str = "output_chars") -> DataFrame:
    """Characters of outputs nobody needed, the most that any policy frees without loss."""
    return labels.agg(F.sum(chars).alias("total"), F.sum(F.when(~F.col("result_needed"), F.col(chars)).otherwise(0)).alias("unneeded"), F.count_if(~F.col("result_needed")).alias("unneeded_calls"))


def loss_ledger(dropped: DataFrame) -> DataFrame:
    """Wrong drops by tool and by evidence: ``by, value, n, chars``."""
    lost = dropped.filter(F.col("dropped") & F.col("result_needed"))
    sets = lost.groupingSets([["tool"], ["evidence"]], "tool", "evidence").agg(F.grouping("tool").alias("g"), F.count("*").alias("n"), F.sum("output_chars").alias("chars"))
    return sets.select(F.when(F.col("g") == 0, "tool").otherwise("evidence").alias("by"), F.when(F.col("g") == 0, F.col("tool")).otherwise(F.col("evidence")).alias("value"), "n", "chars")


def trigger_points(rows: DataFrame, chars: str, at: float, order: list[str], key: str = "session") -> DataFrame:
    """The first row of each session where the running characters reach a share of all: ``key, point, chars``."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__r", F.sum(chars).over(run)).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("__t", F.sum(chars).over(Window.partitionBy(key)))
    return summed.filter(F.col("__r") >= F.col("__t") * at).groupBy(key).agg(F.min("__n").alias("point"), F.min_by("__r", "__n").alias("chars"))


def tail_window(rows: DataFrame, chars: str, budget: int, order: list[str], key: str = "session") -> DataFrame:
    """The last rows of each session until a budget is reached, the one that crosses it included."""
    back = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__b", F.coalesce(F.sum(chars).over(back), F.lit(0))).filter(F.col("__b") < budget).drop("__b")


def pass_loop(messages: DataFrame, trigger_tokens: int, floor_tokens: int, freed_share: float = 0.3, max_passes: int = 6) -> DataFrame:
    """Passes of the production loop over ``session, ord, chars, droppable``: ``session, pass, at, tokens_before, tokens_after, why``.

    Messages come in until the trigger, a pass then frees a share of what can be dropped and wasn't yet; the loop ends at the
    first pass that frees too little or when passes are used up. State runs on from pass to pass, so each session is one
    group, of two numbers a message.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord")
        out, live, loose = [], 0.0, 0.0
        for at, chars, droppable in zip(group["ord"], group["chars"], group["droppable"]):
            live += chars / CHARS_PER_TOKEN
            loose += droppable / CHARS_PER_TOKEN
            if live < trigger_tokens:
                continue
            freed = loose * freed_share
            why = "floor" if freed < floor_tokens else "ceiling" if len(out) >= max_passes else "taken"
            out.append((group["session"].iloc[0], len(out) + 1, at, math.floor(live), math.floor(live - freed), why))
            if why != "taken":
                break
            live, loose = live - freed, loose - freed
        return pd.DataFrame(out, columns=["session", "pass", "at", "tokens_before", "tokens_after", "why"])

    kind = dict(messages.dtypes)
    return messages.select("session", "ord", "chars", "droppable").groupBy("session").applyInPandas(run, f"session {kind['session']}, pass int, at {kind['ord']}, tokens_before long, tokens_after long, why string")


def matched_baseline(labels: DataFrame, order: list[str], freed: int, label: str = "result_needed", chars: str = "output_chars") -> DataFrame:
    """Drops over all sessions in the order of these columns until as much is freed as another policy frees: ``dropped, freed_chars,
    wrong_drops``; the drop that crosses it still goes."""
    summed = ordered_totals(labels.select(*order, label, chars), order, {"__before": F.col(chars)}).filter(F.col("__before") < freed)
    return summed.agg(F.count("*").alias("dropped"), F.coalesce(F.sum(chars), F.lit(0)).alias("freed_chars"), F.count_if(label).alias("wrong_drops"))


def error_policies(labels: DataFrame, penalties: list[float], threshold: float, chars: str = "output_chars") -> DataFrame:
    """What comes of marking failed calls down by a penalty, or of dropping them all: ``penalty, hard, dropped, freed_chars, wrong_drops``."""
    grid = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("penalty"), F.lit(hard).alias("hard")) for p in penalties for hard in (False, True)))).alias("g")
    each = labels.select("score", "is_error", "result_needed", chars, grid).select("*", "g.*")
    failed = F.coalesce(F.col("is_error"), F.lit(False))
    low = (F.col("score") - F.when(failed, F.col("penalty")).otherwise(0.0) < threshold) | (F.col("hard") & failed)
    return each.groupBy("penalty", "hard").agg(F.count_if(low).alias("dropped"), F.sum(F.when(low, F.col(chars)).otherwise(0)).alias("freed_chars"), F.count_if(low & F.col("result_needed")).alias("wrong_drops"))


def head_tail_sweep(calls: DataFrame, caps: list[int], tail_shares: list[float], chars: str = "result_chars") -> DataFrame:
    """Caps that keep a head and a tail of an output: ``cap, tail_share, capped_calls, head_chars, tail_chars, freed_chars``."""
    grid = F.explode(F.array(*(F.struct(F.lit(c).cast("long").alias("cap"), F.lit(float(t)).alias("tail_share")) for c in caps for t in tail_shares))).alias("g")
    each = calls.select(chars, grid).select(chars, "g.*")
    tail = F.floor(F.col("cap") * F.col("tail_share")).cast("long")
    over = F.col(chars) > F.col("cap")
    total = lambda value: F.sum(F.when(over, value).otherwise(0))
    return each.groupBy("cap", "tail_share").agg(F.count_if(over).alias("capped_calls"), total(F.col("cap") - tail).alias("head_chars"), total(tail).alias("tail_chars"), total(F.col(chars) - F.col("cap")).alias("freed_chars"))


def cost_aware(labels: DataFrame, thresholds: list[float], chars: str = "output_chars") -> DataFrame:
    """Keeping what scores enough or is no larger than the median: ``threshold, kept, freed_chars, kept_needed``."""
    middle = quantiles(labels, chars).select(F.col("upper").alias("median"))
    each = labels.select("score", "result_needed", chars, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")).join(F.broadcast(middle))  # one row
    keep = (F.col("score") >= F.col("threshold")) | (F.col(chars) <= F.col("median"))
    return each.groupBy("threshold").agg(F.count_if(keep).alias("kept"), F.sum(F.when(keep, 0).otherwise(F.col(chars))).alias("freed_chars"), F.count_if(keep & F.col("result_needed")).alias("kept_needed"))


def reuse_targets(labels: DataFrame, within: list[int]) -> DataFrame:
    """Labels by how soon an output is used again: ``within, positives, negatives, positive_chars``."""
    distance = F.col("first_reuse_index") - F.col("result_index")
    each = labels.withColumn("__d", distance).select("result_needed", "first_reuse_index", "__d", "output_chars", F.explode(F.array(*map(F.lit, within))).alias("within"))
    soon = F.coalesce(F.col("result_needed") & (F.col("first_reuse_index") >= 0) & (F.col("__d") <= F.col("within")), F.lit(False))
    return each.groupBy("within").agg(F.count_if(soon).alias("positives"), F.count_if(~soon).alias("negatives"), F.sum(F.when(soon, F.col("output_chars")).otherwise(0)).alias("positive_chars"))

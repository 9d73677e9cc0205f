"""Ranking, calibration and policy metrics over ``score, label`` and sizes. All by sorted distinct scores, never by pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.prefix import ordered_totals


def _by_score(df: DataFrame, score: str, label: str, chars: Column) -> DataFrame:
    """Per distinct score: n, positives, chars and what lies below, summed by ranges of the scores."""
    grouped = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(label).alias("pos"), F.sum(chars).alias("c"))
    return ordered_totals(grouped, ["s"], {f"{x}_below": F.col(x) for x in ("n", "pos", "c")})


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties at their average rank; null where one class is missing."""
    ranked = _by_score(df, score, label, F.lit(0))
    sums = ranked.agg(F.sum(F.col("pos") * (F.col("n_below") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(F.when((p > 0) & (q > 0), (F.col("ranks") - p * (p + 1) / 2) / (p * q)).alias("auc"), p.alias("positives"), "n")


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 15) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))


def ece(df: DataFrame, score: str, label: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins."""
    held = calibration_bins(df, score, label, bins)
    return held.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def droppable_at(df: DataFrame, score: str, label: str, chars: str, safety: float) -> DataFrame:
    """The most characters droppable while the share ``safety`` of positives is kept: ``threshold, dropped_chars, total_chars, wrong_drops``."""
    swept = _by_score(df, score, label, F.col(chars))
    total = swept.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("c"), F.lit(0)).alias("total_chars"))
    joined = swept.join(F.broadcast(total))
    fair = joined.filter((F.col("c_below") > 0) & ((F.col("p") == 0) | ((F.col("p") - F.col("pos_below")) / F.col("p") >= safety)))
    best = fair.agg(F.max(F.struct("c_below", (-F.col("s")).alias("m"), "pos_below")).alias("b"))
    none = lambda c, d: F.coalesce(c, d)
    return total.join(F.broadcast(best)).select(none(-F.col("b.m"), F.lit(1.0)).alias("threshold"), none(F.col("b.c_below"), F.lit(0)).alias("dropped_chars"), "total_chars", none(F.col("b.pos_below"), F.col("p")).alias("wrong_drops"))


def freed_at_retention(df: DataFrame, score: str, label: str, chars: str, safety: float, steps: int = 100) -> DataFrame:
    """The same over a fixed grid of thresholds k/steps: ``threshold, freed_chars``."""
    swept = df.groupBy(F.least(F.lit(steps), F.floor(F.col(score) * steps + F.lit(1e-9))).cast("int").alias("k")).agg(F.count_if(label).alias("pos"), F.sum(chars).alias("c"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k")).join(swept, "k", "left").fillna(0)
    below = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("pos").over(Window.partitionBy())
    run = grid.withColumns({"wrong": F.coalesce(F.sum("pos").over(below), F.lit(0)), "freed": F.coalesce(F.sum("c").over(below), F.lit(0)), "p": total})
    fair = run.filter((F.col("p") == 0) | ((F.col("p") - F.col("wrong")) / F.col("p") >= safety))
    return fair.agg(F.max(F.struct("freed", (-F.col("k")).alias("m"))).alias("b")).select((-F.col("b.m") / steps).alias("threshold"), F.col("b.freed").alias("freed_chars"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation, 0 where one side doesn't vary."""
    return df.agg(F.coalesce(F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b)), F.lit(0.0)).alias("pearson"))


def quantiles(df: DataFrame, x: str, p: float = 0.5) -> DataFrame:
    """Three definitions: the upper one at n·p, the mean of the middle ones, the lower one at (n-1)·p."""
    n = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("v")).agg(F.count("*").alias("k"))
    upto = ordered_totals(n, ["v"], {"lo": F.col("k")}).withColumn("hi", F.col("lo") + F.col("k"))
    total = upto.agg(F.max("hi").alias("n"))
    placed = upto.join(F.broadcast(total))
    at = lambda i: F.max(F.when((i >= F.col("lo")) & (i < F.col("hi")), F.col("v")))
    last = F.col("n") - 1
    up, low = F.least(last, F.floor(F.col("n") * p)), F.floor(last * p)
    near, far = F.floor(last * p), F.ceil(last * p)
    return placed.agg(at(up).alias("upper"), ((at(near) + at(far)) / 2.0).alias("middle"), at(low).alias("lower"))


def spread(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.stddev_pop(x).alias("sd_population"), F.min(x).alias("least"), F.max(x).alias("most"))


def bootstrap_ratio(df: DataFrame, key: str, over: str, under: str, rounds: int = 400, seed: int = 0) -> DataFrame:
    """Ratio of sums over sessions drawn with replacement: ``round, ratio``. Draws are Poisson weights from a hash, so each
    session's part is known where it lies and nothing is collected."""
    sums = df.groupBy(key).agg(F.sum(over).alias("a"), F.sum(under).alias("b"))
    each = sums.select("a", "b", key, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = F.pmod(F.xxhash64(F.col(key), "round", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = F.lit(8)
    for k in reversed(range(8)):
        weight = F.when(u < cuts[k], k).otherwise(weight)
    return each.withColumn("w", weight).groupBy("round").agg((F.sum(F.col("a") * F.col("w")) / F.nullif(F.sum(F.col("b") * F.col("w")), F.lit(0))).alias("ratio"))


def fit_temperature(df: DataFrame, score: str, label: str) -> DataFrame:
    """The temperature of a logarithmic grid from 0.25 to 20 with the least log loss: ``temperature, loss``."""
    from loomwork.functions.text import temperature

    grid = [0.25 * (80 ** (i / 60)) for i in range(61)]
    counts = df.groupBy(F.col(score).alias("s"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    each = counts.select("s", "y", "n", F.explode(F.array(*map(F.lit, grid))).alias("t"))
    q = temperature(F.col("s"), F.col("t"))
    loss = F.sum(-F.col("n") * F.log(F.when(F.col("y"), q).otherwise(1 - q))) / F.sum("n")
    return each.groupBy("t").agg(loss.alias("loss")).agg(F.min(F.struct("loss", "t")).alias("b")).select(F.col("b.t").alias("temperature"), F.col("b.loss").alias("loss"))


def grouped_splits(df: DataFrame, key: str, score: str, label: str, splits: int = 10, percent: int = 30) -> DataFrame:
    """The area under the curve on held-out sessions, over repeated splits: ``split, sessions, n, positives, auc``.

    A session is held out of a split by the hash of its name and the split's number, so all its rows go together.
    """
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key), F.col("split").cast("string"))), 1, 8), 16, 10).cast("long") % 100
    held = df.select(key, score, label, F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split")).filter(drawn < percent)
    grouped = held.groupBy("split", F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(label).alias("pos"))
    below = Window.partitionBy("split").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # distinct scores only
    ranks = grouped.withColumn("r", F.col("pos") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2))
    sums = ranks.groupBy("split").agg(F.sum("r").alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    sessions = held.groupBy("split").agg(F.count_distinct(key).alias("sessions"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.join(sessions, "split").select("split", "sessions", "n", p.alias("positives"), F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("auc"))

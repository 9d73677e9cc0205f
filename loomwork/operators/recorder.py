"""Counted signals of repeated work, in batch: upsert, fair pruning, fixes after failures, proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.prefix import ordered_totals
from loomwork.functions.signatures import estimated_saving, redact, slug

MAX_ROWS, MAX_SESSIONS, MAX_SAMPLES, SAMPLE_CHARS = 2000, 50, 3, 200


def counted(signals: DataFrame) -> DataFrame:
    """Signals ``kind, sig, calls, chars, session, sample, at`` as counters: ``kind, sig, n, calls, chars, sessions, samples, last_seen``.

    Sessions and samples are the first different ones to arrive. Each is reduced to its first arrival before it is
    gathered, and only the first few of those are, so a hot signal's rows never meet in one place.
    """
    key = ["kind", "sig"]
    sums = signals.groupBy(*key).agg(F.count("*").alias("n"), F.sum("calls").alias("calls"), F.sum("chars").alias("chars"), F.max("at").alias("last_seen"))

    def first(column, most, name):
        seen = signals.filter(F.coalesce(column, F.lit("")) != "").groupBy(*key, column.alias("v")).agg(F.min("at").alias("first"))
        placed = seen.withColumn("p", F.row_number().over(Window.partitionBy(*key).orderBy("first", "v"))).filter(F.col("p") <= most)
        return placed.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda x: x["v"]).alias(name))

    text = F.substring(redact(F.col("sample")), 1, SAMPLE_CHARS)
    sessions, samples = first(F.col("session"), MAX_SESSIONS, "sessions"), first(text, MAX_SAMPLES, "samples")
    empty = F.array().cast("array<string>")
    return sums.join(sessions, key, "left").join(samples, key, "left").withColumns({"sessions": F.coalesce("sessions", empty), "samples": F.coalesce("samples", empty)})


def fair_prune(rows: DataFrame, most: int = MAX_ROWS, arrived: str = "last_seen") -> DataFrame:
    """At most ``most`` counters, taken in turn from every kind, the most frequent and latest of each first; kinds take turns by
    their first appearance, the least ``arrived``: give a column of first arrivals where the rows have one."""
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), F.desc("last_seen"), "sig"))
    begun = rows.groupBy("kind").agg(F.min(arrived).alias("__first"))
    return rows.withColumn("__p", place).filter(F.col("__p") <= most).join(F.broadcast(begun), "kind").orderBy("__p", "__first", "kind").limit(most).drop("__p", "__first")


def newest(rows: DataFrame, at: str, most: int) -> DataFrame:
    """The latest rows, as many as are kept."""
    return rows.orderBy(F.desc(at)).limit(most)


def error_fixes(commands: DataFrame, order: list[str]) -> DataFrame:
    """Successes of a command that failed the time before in the same session: ``session, sig`` and the order columns."""
    before = F.lag("is_error").over(Window.partitionBy("session", "sig").orderBy(*order))
    return commands.withColumn("__b", before).filter(F.col("__b") & ~F.col("is_error")).select("session", "sig", *order)


def proposals(counters: DataFrame, least: int = 3, sessions: int = 2, totals: bool = False) -> DataFrame:
    """Counters repeated often enough, ranked by what they would save, then by how often, then by name: ``rank, kind, sig, slug, n,
    n_sessions, saved``. Saving is reckoned from the mean of an occurrence, or, as ``totals``, from the sums."""
    held = counters.withColumn("n_sessions", F.size("sessions")).filter((F.col("n") >= least) & (F.col("n_sessions") >= sessions))
    one = F.lit(1) if totals else F.col("n")
    saved = estimated_saving(F.col("n"), F.col("calls") / one, F.col("chars") / one)
    found = held.select("kind", "sig", slug(F.col("sig")).alias("slug"), "n", "n_sessions", saved.alias("saved"))
    keyed = found.withColumns({"__saved": -F.round("saved", 6), "__n": -F.col("n")})
    ranked = ordered_totals(keyed, ["__saved", "__n", "kind", "sig"], {"before": F.lit(1)})
    return ranked.select((F.col("before") + 1).alias("rank"), *found.columns).orderBy("rank")

"""What repetition and cache cost: repeated shapes, targets read again, gates, segments between compactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.prefix import ordered_totals


def repeated_shapes(calls: DataFrame, shape: str, seconds: str, session: str, least: int = 2, sessions: int = 2, tail: float = 120.0) -> DataFrame:
    """Shapes that recur over sessions with their time, each at most ``tail``: ``shape, n, sessions, seconds``."""
    grouped = calls.groupBy(shape).agg(F.count("*").alias("n"), F.count_distinct(session).alias("sessions"), F.sum(F.least(F.col(seconds), F.lit(tail))).alias("seconds"))
    return grouped.filter((F.col("n") >= least) & (F.col("sessions") >= sessions))


def gate(tool: Column) -> Column:
    """Who a call waits for."""
    return F.when(tool.isin("AskUserQuestion", "ExitPlanMode"), "human").when(tool.isin("Task", "Agent"), "delegated").otherwise("machine")


def gate_totals(calls: DataFrame, seconds: str) -> DataFrame:
    return calls.groupBy(gate(F.col("tool")).alias("gate")).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"))


def short_target(path: Column) -> Column:
    """The last two parts of a path."""
    return F.array_join(F.slice(F.split(path, "/"), F.greatest(F.lit(1), F.size(F.split(path, "/")) - 1), 2), "/")


def rereads(reads: DataFrame, target: str, chars: str) -> DataFrame:
    """Targets by the last two parts of their path, with what was read and what of it was read again: ``target, reads, chars,
    repeated_chars``."""
    reads = reads.withColumn(target, short_target(F.col(target)))
    return reads.groupBy(target).agg(F.count("*").alias("reads"), F.sum(chars).alias("chars"), (F.sum(chars) - F.max(chars)).alias("repeated_chars"))


def pair_times(starts: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """Finished calls with their start, the last of several: ``*key, seconds``, null where no start is known."""
    begun = starts.groupBy(*key).agg(F.max("at").alias("begun"))
    return ends.join(begun, key, "left").withColumn("seconds", F.greatest(F.lit(0.0), (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("begun").cast("timestamp"))) / 1_000_000))


def cache_segments(usage: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Turns between compactions of rows ``key, is_boundary, message_id, cache_read, cache_created``: per segment
    ``key, segment, turns, first_created, last_read``; an id that repeats the row before counts once."""
    run = Window.partitionBy(key).orderBy(*order)
    marked = usage.withColumn("segment", F.sum(F.when(F.col("is_boundary"), 1).otherwise(0)).over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__o", F.row_number().over(run))
    turns = marked.filter(~F.col("is_boundary")).withColumn("__b", F.lag("message_id").over(Window.partitionBy(key, "segment").orderBy("__o")))
    once = turns.filter(F.col("__b").isNull() | ~F.col("__b").eqNullSafe(F.col("message_id")))
    return once.groupBy(key, "segment").agg(F.count("*").alias("turns"), F.min_by("cache_created", "__o").alias("first_created"), F.max_by("cache_read", "__o").alias("last_read"))


def cache_events(segments: DataFrame, key: str) -> DataFrame:
    """Compactions between segments: ``key, segment, freed, recached, turns``; freed is what the cache held before less what it
    holds after, a first segment is none."""
    before = F.lag("last_read").over(Window.partitionBy(key).orderBy("segment"))
    found = segments.withColumn("__b", before).filter(F.col("__b").isNotNull())
    return found.select(key, "segment", (F.col("__b") - F.col("last_read")).alias("freed"), F.col("first_created").alias("recached"), "turns")


def breakeven_turns(freed: Column, recached: Column, read: float = 0.10, write: float = 1.25) -> Column:
    """Turns after which what a compaction frees pays for writing the cache anew."""
    return F.when(freed > 0, recached * (write - read) / (freed * read))


def halves(sessions: DataFrame, at: str, key: str) -> DataFrame:
    """Sessions by their first time: ``key, early``; the earlier half, rounded up, is early."""
    first = sessions.groupBy(key).agg(F.min(at).alias("first"))
    n = first.agg(F.count("*").alias("n"))
    placed = ordered_totals(first, ["first", key], {"p": F.lit(1)})
    return placed.join(F.broadcast(n)).select(key, (F.col("p") + 1 <= F.ceil(F.col("n") / 2)).alias("early"))


def payoff(signals: DataFrame, early: DataFrame, key: str, shape: list[str], least: int = 3, sessions: int = 2) -> DataFrame:
    """Shapes proposed from the early half and how often they come back in the late one: ``*shape, early_n, late_n``."""
    split = signals.join(early, key)
    a = split.filter("early").groupBy(*shape).agg(F.count("*").alias("early_n"), F.count_distinct(key).alias("s")).filter((F.col("early_n") >= least) & (F.col("s") >= sessions)).drop("s")
    b = split.filter(~F.col("early")).groupBy(*shape).agg(F.count("*").alias("late_n"))
    return a.join(b, shape, "left").fillna(0, ["late_n"])

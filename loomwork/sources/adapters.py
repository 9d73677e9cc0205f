"""Tables of other shapes as calls, steps and scored labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.pairing import pinned


def calls_from_events(events: DataFrame, preserve_recent: int = 6) -> DataFrame:
    """Events of a user as the calls of a session, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "purchase", "Edit").when(F.col("event_type") == "signup", "AskUserQuestion").otherwise("Bash")
    calls = events.select(
        F.col("user_id").alias("session"), F.row_number().over(order).cast("long").alias("call_seq"), "event_id", "ts", tool.alias("tool"), (F.col("event_type") == "error").alias("is_error"), F.col("props").alias("target"),
        F.round(F.col("value") * 100).cast("long").alias("result_chars"), F.count("*").over(Window.partitionBy("user_id")).alias("n"),
    )
    calls = calls.withColumns({"call_index": F.col("call_seq") * 2 - 1, "result_index": F.col("call_seq") * 2, "total": F.col("n") * 2 + 1})
    return calls.withColumn("pinned", pinned(F.col("call_index"), F.col("result_index"), F.col("total"), preserve_recent)).drop("n")


def scored_labels(label_rows: DataFrame) -> DataFrame:
    """The latest label of each call, with the score that its size alone gives."""
    key = ["session", "tool_use_id"]
    held = label_rows.dropna(subset=key)
    latest = held.groupBy(*key).agg(F.max_by(F.struct("tool", "output_chars", "is_error", "call_needed", "result_needed", "match_shingles", "evidence", "result_index", "first_reuse_index", "messages"), F.struct("labeled_at", "output_chars", "match_shingles", "tool", "evidence", "result_index", "first_reuse_index", "messages")).alias("r"))
    size = F.col("output_chars") / (F.col("output_chars") + 1000.0)
    return latest.select(*key, "r.*").withColumn("score", F.round(size, 6)).withColumn("call_score", F.round(size, 6))

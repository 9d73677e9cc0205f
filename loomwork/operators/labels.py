"""Which outputs were reused later, told by shared word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import shingles

OWNERS = 3
LEAST = 2


def owners(calls: DataFrame, n: int = 8, most: int = 2000) -> DataFrame:
    """Calls that hold each sampled shingle of a session: ``session, shingle, owners``."""
    held = calls.select("session", "tool_use_id", F.explode(F.array_distinct(shingles(F.col("result_text"), n, most))).alias("shingle"))
    return held.groupBy("session", "shingle").agg(F.count_distinct("tool_use_id").alias("owners"))


def reuse(messages: DataFrame, calls: DataFrame, n: int = 8, most: int = 2000) -> DataFrame:
    """Per call with a match: ``session, tool_use_id, match_shingles, first_reuse_index, in_input``.

    A sampled shingle of an output counts if a later message's text or input holds it; shingles that more than ``OWNERS``
    outputs share are boilerplate and left out before the join.
    """
    held = calls.select("session", "tool_use_id", "result_index", F.explode(F.array_distinct(shingles(F.col("result_text"), n, most))).alias("shingle")).withColumn("h", F.xxhash64("shingle"))
    rare = held.groupBy("session", "h").agg(F.count("*").alias("k")).filter(F.col("k") <= OWNERS).select("session", "h")
    inputs = F.array_join(F.transform("tool_uses", lambda u: u["input_json"]), "\n")
    said = messages.select("session", "msg_idx", (F.size("tool_uses") > 0).alias("in_input"), F.explode(F.array_distinct(shingles(F.concat_ws("\n", "text", inputs), n))).alias("shingle")).withColumn("h", F.xxhash64("shingle"))
    met = held.join(rare, ["session", "h"], "left_semi").join(said, ["session", "h", "shingle"]).filter(F.col("msg_idx") > F.col("result_index"))
    return met.groupBy("session", "tool_use_id").agg(F.count_distinct("shingle").alias("match_shingles"), F.min("msg_idx").alias("first_reuse_index"), F.min_by("in_input", "msg_idx").alias("in_input"))


def labels(messages: DataFrame, facts: DataFrame, n: int = 8, most: int = 2000) -> DataFrame:
    """A label row per call: whether its output and the call itself were needed, and why."""
    found = reuse(messages, facts, n, most)
    joined = facts.join(found, ["session", "tool_use_id"], "left").fillna({"match_shingles": 0, "first_reuse_index": -1})
    quoted = F.col("match_shingles") >= LEAST
    why = F.when(quoted, F.concat(F.when(F.col("in_input"), "reused in a later tool input").otherwise("quoted in later text"), F.lit(" ("), F.col("match_shingles").cast("string"), F.lit(" shingles)"))).when(F.col("rerun_later"), "the same target was read again later, so it was reproducible").otherwise("never reproduced downstream")
    return joined.select(
        "session", "tool_use_id", "tool", F.coalesce("target", F.lit("")).alias("target"), F.col("result_chars").alias("output_chars"), "is_error", (quoted | F.col("rerun_later") | F.col("target_touched_after")).alias("call_needed"),
        quoted.alias("result_needed"), "match_shingles", F.size(F.array_distinct(shingles(F.col("result_text"), n, most))).alias("sampled_shingles"), why.alias("evidence"), "result_index", "first_reuse_index", F.col("total").alias("messages"),
    )


def first_offsets(text: DataFrame, key: list[str], column: str, n: int = 8) -> DataFrame:
    """Where each shingle of a text first stands, in words: ``*key, shingle, at``."""
    return text.select(*key, F.posexplode(shingles(F.col(column), n)).alias("at", "shingle")).groupBy(*key, "shingle").agg(F.min("at").alias("at"))

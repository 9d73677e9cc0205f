"""Calls joined with their results, and what follows from their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import truncate, units
from loomwork.plans.options import MARK


def paired_calls(messages: DataFrame, preserve_recent: int = 6, texts: bool = True) -> DataFrame:
    """A row per call with a result, the last of several: ``session, call_seq, id, tool_use_id, tool, input_json, call_index,
    result_index, result_text, result_chars, is_error, total, pinned``; calls without result are left out.

    Without ``texts`` the result's text is only the note of an earlier cut, where it holds one, so that rows stay narrow.
    """
    total = messages.groupBy("session").agg(F.count("*").alias("total"))
    uses = messages.select("session", "msg_idx", F.posexplode("tool_uses").alias("pos", "u"))
    results = messages.select("session", "msg_idx", F.posexplode("tool_results").alias("pos", "r"))
    text = F.col("r.text") if texts else F.when(F.contains(F.col("r.text"), F.lit(MARK)), F.lit(MARK)).otherwise(F.lit(""))
    held = results.select("session", "msg_idx", "pos", F.col("r.tool_use_id").alias("tool_use_id"), text.alias("text"), units(F.col("r.text")).alias("chars"), F.col("r.is_error").alias("is_error"))
    last = held.groupBy("session", "tool_use_id").agg(F.max_by(F.struct("msg_idx", "text", "chars", "is_error"), F.struct("msg_idx", "pos")).alias("r"))
    told = uses.select("session", "msg_idx", "pos", F.col("u.tool_use_id").alias("tool_use_id"), F.col("u.tool").alias("tool"), F.col("u.input_json").alias("input_json"))
    seq = F.row_number().over(Window.partitionBy("session").orderBy("msg_idx", "pos"))
    calls = told.join(last, ["session", "tool_use_id"]).select(
        "session", seq.alias("call_seq"), "tool_use_id", "tool", "input_json", F.col("msg_idx").alias("call_index"), F.col("r.msg_idx").alias("result_index"), F.col("r.text").alias("result_text"),
        F.col("r.chars").alias("result_chars"), F.col("r.is_error").alias("is_error"),
    )
    return calls.join(total, "session").withColumns({"id": F.concat(F.lit("t"), F.col("call_seq").cast("string")), "pinned": pinned(F.col("call_index"), F.col("result_index"), F.col("total"), preserve_recent)})


def pinned(call: Column, result: Column, total: Column, recent: int) -> Column:
    """Whether either end is the first message or among the last."""
    one = lambda i: (i == 0) | (i >= total - recent)
    return one(call) | one(result)


def orphans(messages: DataFrame) -> DataFrame:
    """Calls without result and results without call: ``session, tool_use_id, side``."""
    uses = messages.select("session", F.explode("tool_uses").alias("u")).select("session", "u.tool_use_id")
    results = messages.select("session", F.explode("tool_results").alias("r")).select("session", "r.tool_use_id")
    key = ["session", "tool_use_id"]
    return uses.join(results, key, "left_anti").withColumn("side", F.lit("call")).unionByName(results.join(uses, key, "left_anti").withColumn("side", F.lit("result")))


def goals(messages: DataFrame, n: int = 3, limit: int = 500) -> DataFrame:
    """The last prompts of each session, joined in order: ``session, goal``."""
    prompts = messages.filter((F.col("role") == "user") & F.col("text").rlike(r"\S") & (F.size("tool_results") == 0))
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("msg_idx")))
    last = prompts.withColumn("back", back).filter(F.col("back") <= n).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("msg_idx", truncate(F.col("text"), limit).alias("t")))).alias("ts"))
    return last.select("session", F.array_join(F.transform("ts", lambda t: t["t"]), "\n").alias("goal"))


def message_chars() -> Column:
    """Characters of a message: its text, its calls' inputs and its results."""
    uses = F.aggregate("tool_uses", F.lit(0), lambda n, u: n + units(u["input_json"]))
    results = F.aggregate("tool_results", F.lit(0), lambda n, r: n + units(r["text"]))
    return units(F.col("text")) + uses + results


def bash_commands(messages: DataFrame) -> DataFrame:
    """Shell commands in order: ``session, msg_idx, pos, tool_use_id, command``."""
    uses = messages.select("session", "msg_idx", F.posexplode("tool_uses").alias("pos", "u")).filter(F.col("u.tool") == "Bash")
    return uses.select("session", "msg_idx", "pos", "u.tool_use_id", F.get_json_object("u.input_json", "$.command").alias("command")).filter(F.col("command").isNotNull())


def with_result_chars(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls ``session, tool_use_id`` with the characters of their results, 0 where there is none."""
    sizes = results.groupBy("session", "tool_use_id").agg(F.max(units(F.col("text"))).alias("result_chars"))
    return calls.join(sizes, ["session", "tool_use_id"], "left").fillna(0, ["result_chars"])


def result_owners(messages: DataFrame) -> DataFrame:
    """Results with the tool that made them, ``unknown`` where no call is known: ``session, tool_use_id, tool, chars``."""
    uses = messages.select("session", F.explode("tool_uses").alias("u")).groupBy("session", F.col("u.tool_use_id").alias("tool_use_id")).agg(F.max("u.tool").alias("tool"))
    results = messages.select("session", F.explode("tool_results").alias("r")).select("session", "r.tool_use_id", units(F.col("r.text")).alias("chars"))
    return results.join(uses, ["session", "tool_use_id"], "left").select("session", "tool_use_id", F.coalesce("tool", F.lit("unknown")).alias("tool"), "chars")

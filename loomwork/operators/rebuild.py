"""Messages rebuilt after a decision, and the whole compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.shared import written
from loomwork.functions.text import SLACK, tokens_of_chars, truncated_text, units
from loomwork.operators import pairing, scoring
from loomwork.operators.decide import decide, session_stats
from loomwork.operators.facts import target, with_facts
from loomwork.plans.options import Options


MESSAGE = ("session", "msg_idx", "role", "text", "tool_uses", "tool_results")


def apply_decisions(messages: DataFrame, decisions: DataFrame, options: Options = Options()) -> DataFrame:
    """Messages without dropped calls and with shortened outputs, in order, with ``touched``.

    Actions are joined to the ids that each message holds and come back as a map per message, so the work grows with the
    blocks of a session and not with its messages times its calls. A message that loses all it had is dropped; one that was
    blank before stays.
    """
    held = lambda blocks: F.transform(blocks, lambda b: b["tool_use_id"])
    ids = messages.select("session", "msg_idx", F.explode(F.array_distinct(F.concat(held("tool_uses"), held("tool_results")))).alias("tool_use_id"))
    acted = decisions.filter(F.col("action") != "keep").groupBy("session", "tool_use_id").agg(F.min("action").alias("action"))
    by_message = ids.join(acted, ["session", "tool_use_id"]).groupBy("session", "msg_idx").agg(F.map_from_entries(F.collect_list(F.struct("tool_use_id", "action"))).alias("actions"))
    joined = messages.join(by_message, ["session", "msg_idx"], "left").withColumn("actions", F.coalesce("actions", F.create_map().cast("map<string,string>")))
    action = lambda x: F.try_element_at(F.col("actions"), F.coalesce(x["tool_use_id"], F.lit("")))
    over = lambda r: (F.lit(options.max_kept_chars) > 0) & (units(r["text"]) > options.max_kept_chars + SLACK)
    result = lambda r: F.when(action(r) == "drop_result", truncated_text(r["text"], r["is_error"], options.head_chars)).when(action(r).isNull() & over(r), truncated_text(r["text"], r["is_error"], options.max_kept_chars)).otherwise(r["text"])
    uses = F.filter("tool_uses", lambda u: ~action(u).eqNullSafe("drop_call"))
    results = F.transform(F.filter("tool_results", lambda r: ~action(r).eqNullSafe("drop_call")), lambda r: F.struct(r["tool_use_id"].alias("tool_use_id"), result(r).alias("text"), r["is_error"].alias("is_error")))
    changed = (F.size("actions") > 0) | F.exists("tool_results", over)  # most messages stay as they are
    built = joined.withColumns({"new_uses": F.when(changed, uses).otherwise(F.col("tool_uses")), "new_results": F.when(changed, results).otherwise(F.col("tool_results"))})
    built = built.withColumn("touched", changed & ((F.size("new_uses") != F.size("tool_uses")) | ~F.col("new_results").eqNullSafe(F.col("tool_results"))))
    empty = F.col("touched") & ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)) & (F.size("new_uses") == 0) & (F.size("new_results") == 0)
    return built.filter(~empty).select("session", "msg_idx", "role", "text", F.col("new_uses").alias("tool_uses"), F.col("new_results").alias("tool_results"), "touched", *(c for c in messages.columns if c not in MESSAGE))


def compact(messages: DataFrame, scorer: scoring.Scorer | None = None, options: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rebuilt messages, decisions, and statistics per session. Messages are written once to the shared folder."""
    messages = written(messages.withColumn("chars", pairing.message_chars().cast("long")), "messages")
    calls = pairing.paired_calls(messages, options.preserve_recent, texts=False).withColumn("target", target()).withColumn("input_chars", units(F.col("input_json")))
    scored = (scorer or scoring.built_in())(with_facts(calls))
    decisions = decide(scored, options).drop("result_text", "input_json")
    rebuilt = apply_decisions(messages, decisions, options)
    size = lambda df, name, chars: df.groupBy("session").agg(F.count("*").alias(f"messages_{name}"), F.sum(chars).alias(f"chars_{name}"))
    left = F.when(F.col("touched"), pairing.message_chars()).otherwise(F.col("chars"))
    stats = size(messages, "before", F.col("chars")).join(size(rebuilt, "after", left), "session", "left").join(session_stats(decisions), "session", "left").fillna(0)
    return rebuilt.drop("chars"), decisions, stats.withColumns({"tokens_before": tokens_of_chars(F.col("chars_before")), "tokens_after": tokens_of_chars(F.col("chars_after")), "reduction": reduction(F.col("chars_before"), F.col("chars_after"))})


def reduction(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0.0).otherwise((before - after) / before)

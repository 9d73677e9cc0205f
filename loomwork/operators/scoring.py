"""The state of a call in prose, its features, and the chance that it is needed."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import estimate_tokens, excerpt, one_line, truncate
from loomwork.operators.facts import target_prose
from loomwork.plans.options import EXCERPTS, FEATURES, MUTATING, Weights


class Scorer(Protocol):
    """Adds ``keep_result`` and ``keep_call`` to calls; null where it has no answer, which keeps the call."""

    def __call__(self, calls: DataFrame) -> DataFrame: ...


def state_prose(goal: Column) -> Column:
    """Task and facts of a call."""
    facts = F.concat(
        F.lit("The assistant ran the "), F.col("tool"), F.lit(" tool "), target_prose(), F.lit(". That happened "), F.col("age"), F.lit(". The output was "), F.col("size"), F.lit("."),
        F.when(F.col("is_error"), " The call failed and returned an error.").otherwise(""),
        F.when(F.col("target_touched_after"), " The same thing was changed afterwards, so this output describes how it used to be.").otherwise(""),
        F.when(F.col("rerun_later"), " The assistant ran the same tool on the same thing again later.").otherwise(""),
    )
    return F.concat(F.lit("Task: "), truncate(one_line(F.coalesce(goal, F.lit(""))), 300), F.lit("\n\n"), facts)


def with_state(calls: DataFrame, budget: int = 700) -> DataFrame:
    """Calls with ``state, state_tokens, rung``: the longest excerpt of the output that stays within the budget, else the shortest."""
    headed = calls.withColumn("__head", state_prose(F.col("goal")))
    body = lambda h, t: excerpt(F.coalesce(F.col("result_text"), F.lit("")), h, t)
    states = [F.when(body(h, t) == "", F.col("__head")).otherwise(F.concat(F.col("__head"), F.lit("\n\nThe output said:\n"), body(h, t))) for h, t in EXCERPTS]
    tried = F.array(*(F.struct(s.alias("state"), estimate_tokens(s).alias("tokens"), F.lit(i).alias("rung")) for i, s in enumerate(states)))
    tried_once = headed.withColumn("__tried", tried)
    fit = F.coalesce(F.get(F.filter("__tried", lambda s: s["tokens"] <= budget), F.lit(0)), F.element_at("__tried", -1))
    return tried_once.withColumn("__s", fit).withColumns({"state": F.col("__s.state"), "state_tokens": F.col("__s.tokens"), "rung": F.col("__s.rung")}).drop("__head", "__tried", "__s")


def features(tool: Column, is_error: Column, touched: Column, again: Column, size: Column, age: Column) -> Column:
    """The features straight from the facts."""
    values = [F.lit(True), tool == "Read", tool == "Bash", tool.isin(MUTATING), tool.isin("Grep", "Glob"), is_error, touched, again, size == "very short", size == "short", size == "very long", age == "long ago in the session", age == "just now"]
    return F.array(*(F.coalesce(v, F.lit(False)).cast("double") for v in values))


def features_of_prose(state: Column, tool: Column, is_error: Column) -> Column:
    """The features as they stand in the facts paragraph of a state."""
    at = F.locate(". That happened ", state)
    rest = F.when(at > 0, F.substring(state, at, F.length(state))).otherwise(state)
    end = F.locate("\n\n", rest)
    facts = F.when((at > 0) & (end > 0), F.substring(rest, F.lit(1), end - 1)).otherwise(rest)
    said = lambda text: facts.contains(text)
    values = [F.lit(True), tool == "Read", tool == "Bash", tool.isin(MUTATING), tool.isin("Grep", "Glob"), is_error, said("changed afterwards"), said("again later"), said("very short"), said("The output was short."), said("very long"), said("long ago in the session"), said("just now")]
    return F.array(*(F.coalesce(v, F.lit(False)).cast("double") for v in values))


def tool_of_state(state: Column) -> Column:
    tries = [F.nullif(F.regexp_extract(state, p, 1), F.lit("")) for p in (r"ran the (\S+) tool", r"output of the (\S+) call", r"Tool call (\S+) \(")]
    return F.coalesce(*tries, F.lit(""))


def completed_state(state: Column, instructions: Column) -> Column:
    """State and instructions, with the size in words where only the number of characters is told."""
    text = F.concat(state, F.lit("\n"), F.coalesce(instructions, F.lit("")))
    told = F.regexp_replace(F.regexp_extract(instructions, r"\((?:[^)]*?, )?([0-9][0-9_,]*) chars\)", 1), "[_,]", "")
    chars = told.try_cast("long")
    words = F.when(chars < 200, "very short").when(chars < 2000, "short").when(chars < 20_000, "long").otherwise("very long")
    return F.when(text.rlike(r"The output was (?:very short|short|long|very long)\.") | chars.isNull(), text).otherwise(F.concat(text, F.lit("\nThe output was "), words, F.lit(".")))


def probability(weights: tuple[float, ...], vector: Column) -> Column:
    """Logistic score; weights that are missing count as 0."""
    padded = [*weights, *[0.0] * (len(FEATURES) - len(weights))]
    z = F.aggregate(F.zip_with(vector, F.array(*map(F.lit, padded)), lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b)
    return 1 / (1 + F.exp(-z))


def built_in(weights: Weights = Weights(), digits: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """The scorer of two logistic heads over the facts."""

    def score(calls: DataFrame) -> DataFrame:
        vector = features(*(F.col(c) for c in ("tool", "is_error", "target_touched_after", "rerun_later", "size", "age")))
        held = calls.withColumn("features", vector)
        exact = {"keep_result": probability(weights.keep_result, F.col("features")), "keep_call": probability(weights.keep_call, F.col("features"))}
        return held.withColumns({k: F.round(v, digits) if digits is not None else v for k, v in exact.items()})

    return score


def score_requests(requests: DataFrame, weights: Weights = Weights(), most_chars: int = 1_000_000) -> DataFrame:
    """Requests ``request_id, state, questions`` (map of name to a struct with instructions) answered: ``request_id, status, answers``.

    Status 413 for states too long, 400 without questions, else 200; a question named ``result_…`` is about the output.
    """
    status = F.when(F.length("state") > most_chars, 413).when(F.col("state").isNull() | (F.coalesce(F.size("questions"), F.lit(0)) <= 0), 400).otherwise(200)
    marked = requests.withColumn("status", status)
    each = marked.filter(F.col("status") == 200).select("request_id", "state", F.explode("questions").alias("name", "q"))
    text = completed_state(F.col("state"), F.col("q.instructions"))
    each = each.withColumn("__t", text)
    vector = features_of_prose(F.col("__t"), tool_of_state(F.col("__t")), F.col("__t").contains("returned an error"))
    scored = each.withColumn("__v", vector).withColumn("noul", F.when(F.startswith("name", F.lit("result_")), probability(weights.keep_result, F.col("__v"))).otherwise(probability(weights.keep_call, F.col("__v"))))
    answers = scored.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "noul"))).alias("answers"))
    return marked.select("request_id", "status").join(answers, "request_id", "left")

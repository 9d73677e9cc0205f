"""What later calls tell about a call, and its size and age in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import one_line, trimmed, truncate
from loomwork.plans.options import MUTATING, TARGET_KEYS


def _field(name: str, of: str = "input_json") -> Column:
    """A field of the input if it is a string and not blank, trimmed."""
    typed = F.from_json(of, f"struct<`{name}`:string>")[name]
    is_text = F.schema_of_variant(F.try_variant_get(F.try_parse_json(of), f"$.{name}", "variant")) == "STRING"
    value = trimmed(typed)
    return F.when(is_text & (value != ""), value)


def target(of: str = "input_json") -> Column:
    """What a call works on, as ``key:value`` of the first telling field."""
    return F.coalesce(*(F.concat(F.lit(f"{k}:"), _field(k, of)) for k in TARGET_KEYS))


def target_prose(of: str = "input_json") -> Column:
    """The same in words."""
    file = F.coalesce(_field("file_path", of), _field("notebook_path", of))
    pattern = F.coalesce(_field("pattern", of), _field("query", of))
    prompt = F.coalesce(_field("prompt", of), _field("description", of))
    place = _field("path", of)
    return (
        F.when(file.isNotNull(), F.concat(F.lit("on the file "), truncate(file, 120)))
        .when(_field("command", of).isNotNull(), F.concat(F.lit("with the command "), truncate(one_line(_field("command", of)), 120)))
        .when(_field("url", of).isNotNull(), F.concat(F.lit("on the page "), truncate(_field("url", of), 120)))
        .when(pattern.isNotNull(), F.concat(F.lit("searching for "), truncate(pattern, 80), F.when(place.isNotNull(), F.concat(F.lit(" in "), truncate(place, 60))).otherwise("")))
        .when(prompt.isNotNull(), F.concat(F.lit("to "), truncate(one_line(prompt), 120)))
        .otherwise("with a structured input")
    )


def size_words(chars: Column) -> Column:
    return F.when(chars < 200, "very short").when(chars < 2000, "short").when(chars < 20_000, "long").otherwise("very long")


def age_words(index: Column, total: Column) -> Column:
    span = F.greatest(F.lit(1), total - 1)
    back = (span - index) / span
    return F.when(back > 0.75, "long ago in the session").when(back > 0.5, "a while back").when(back > 0.25, "earlier in the session").otherwise("just now")


def with_facts(calls: DataFrame) -> DataFrame:
    """Calls ``session, call_seq, tool, target, call_index, total, result_chars`` with ``age, size, target_touched_after, rerun_later``.

    What comes later is known from the last change of the target and the last call of the tool on it, so no order is needed
    within the groups; calls without target have neither.
    """
    last_change = F.max(F.when(F.col("tool").isin(MUTATING), F.col("call_seq"))).over(Window.partitionBy("session", "target"))
    last_call = F.max("call_seq").over(Window.partitionBy("session", "target", "tool"))
    later = lambda last: F.col("target").isNotNull() & (F.coalesce(last, F.lit(-1)) > F.col("call_seq"))
    return calls.withColumn("target_touched_after", later(last_change)).withColumn("rerun_later", later(last_call)).withColumns({"age": age_words(F.col("call_index"), F.col("total")), "size": size_words(F.col("result_chars"))})

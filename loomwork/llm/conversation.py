"""Transcript rows as conversations: the user and assistant rows of one session on one side, in line order.

Conversations are handled in stretches of ``STRETCH`` lines, so that no task ever holds more than that of one
conversation, however large a session is; what spans stretches is joined from one summary row per stretch.

Common to all operators here: a row delivered several times counts once (deliveries differ in ``ingested_at`` only);
rows without a session or of other types belong to no conversation; a missing ``line_no`` sorts first; a missing
``message`` or ``content`` is an empty list of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 2048


def role(kind: Column) -> Column:
    """The ``type`` without case and blanks."""
    return F.lower(F.regexp_replace(kind, r"(?U)[\s\p{Z}\p{Cf}]+", ""))


def block_type(block: Column) -> Column:
    return F.lower(F.trim(block["type"]))


def moment(text: Column) -> Column:
    """A logged time as a timestamp: ISO with any offset, or seconds or milliseconds since 1970; null if unreadable."""
    plain = F.trim(text)
    digits = F.when(plain.rlike(r"^[0-9]{9,11}(\.[0-9]+)?$"), plain.try_cast("double")).when(plain.rlike("^[0-9]{12,14}$"), plain.try_cast("double") / 1000)
    return F.coalesce(F.timestamp_micros((digits * 1_000_000).cast("long")), F.when(digits.isNull(), F.try_to_timestamp(plain)))


def rows(subagent: DataFrame) -> DataFrame:
    """User and assistant rows: ``session, side, stretch, line_no, row_id, role, logged_at, content``."""
    found = subagent.select(
        "session",
        F.when(F.col("issidechain"), "side").otherwise("main").alias("side"),
        F.coalesce(F.floor(F.col("line_no") / STRETCH), F.lit(-1)).cast("long").alias("stretch"),
        "line_no",
        "row_id",
        role(F.col("type")).alias("role"),
        "logged_at",
        F.coalesce(F.col("message.content"), F.array()).alias("content"),
    )
    return found.filter(F.col("role").isin("user", "assistant") & F.col("session").isNotNull())


def gathered(row: Column) -> Column:
    """Aggregate: the different rows of a group, sorted by their first fields; equal deliveries are one."""
    return F.sort_array(F.collect_set(row))

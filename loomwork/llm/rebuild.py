"""Conversations put together again from single message rows, and the verdict on each.

Every row replies to the rows of the line before it, and a result also to its call. Kahn's algorithm sorts this reply
graph, taking the earlier time first where several rows could follow; rows that are left over lie on or behind a cycle (a
result before its own call), are counted, and keep their line order. Then the roles and the pairing of calls and results
are checked. Long conversations are sorted by stretches of lines and joined at the seams.

Results for odd input: a call or result without id is unpaired; a conversation whose rows are all blank has no user row
and is dropped; equal lines are ordered by time, then ``row_id``; unreadable times come last; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.shared import written
from loomwork.llm import conversation as C

_ROW_LIMITS = "session string, side string, stretch long"
_STRETCH_TYPE = (
    _ROW_LIMITS + ", turns array<struct<row_id:long,role:string>>, calls array<string>, results array<string>, users int, assistants int, doubled int, "
    "starts_user boolean, ends_asking boolean, last_role string, cyclic int, blank int"
)


def _says(block: Column) -> Column:
    told = F.when(C.block_type(block) == "text", block["text"]).when(C.block_type(block) == "thinking", block["thinking"])
    return C.block_type(block).isin("tool_use", "tool_result") | F.coalesce(told.rlike(r"(?U)[^\s\p{Z}\p{Cf}]"), F.lit(False))


def sort_replies(lines: list, times: list, calls: list[list], results: list[list]) -> tuple[list[int], int]:
    """Kahn's order of rows given by line, and the number left over; the latter follow in the order given."""
    n = len(lines)
    after: list[list[int]] = [[] for _ in range(n)]
    waits = [0] * n
    made = {c: i for i in range(n) for c in calls[i] if c is not None}
    for i in range(n):
        for r in results[i]:
            j = made.get(r)
            if j is not None and j != i:
                after[j].append(i)
                waits[i] += 1
    order: list[int] = []
    ready: list[tuple] = []
    start = 0
    while start < n:  # rows of one line become free together, once every row of the line before is placed
        end = start + 1
        while end < n and lines[end] == lines[start]:
            end += 1
        free = [False] * (end - start)
        for i in range(start, end):
            if not waits[i]:
                heapq.heappush(ready, (times[i] is None, times[i] or 0, i))
                free[i - start] = True
        placed = 0
        while ready:
            i = heapq.heappop(ready)[2]
            order.append(i)
            placed += 1
            for j in after[i]:
                waits[j] -= 1
                if start <= j < end and not waits[j] and not free[j - start]:
                    free[j - start] = True
                    heapq.heappush(ready, (times[j] is None, times[j] or 0, j))
        if placed < end - start:
            break
        start = end
    done = set(order)
    return order + [i for i in range(n) if i not in done], n - len(order)


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.strip().split(" ")[0] for c in _STRETCH_TYPE.replace("struct<row_id:long,role:string>", "struct").split(",")]
    for batch in batches:
        out = []
        for session, side, stretch, rows in batch.itertuples(index=False, name=None):
            kept = [r for r in rows if not r["blank"]]
            ids = lambda r, k: list(r[k])
            order, cyclic = sort_replies([r["line_no"] for r in kept], [r["us"] for r in kept], [ids(r, "calls") for r in kept], [ids(r, "results") for r in kept])
            turns = [kept[i] for i in order]
            asks = [t["role"] == "user" and not len(t["results"]) for t in turns]
            doubled = sum(a and t["role"] == "user" for a, t in zip(asks, turns[1:]))
            users = sum(t["role"] == "user" for t in turns)
            out.append((
                session, side, stretch, [{"row_id": t["row_id"], "role": t["role"]} for t in turns], [c for t in turns for c in t["calls"]], [r for t in turns for r in t["results"]],
                users, len(turns) - users, doubled, bool(turns) and turns[0]["role"] == "user", bool(turns) and asks[-1], turns[-1]["role"] if turns else None, cyclic, len(rows) - len(kept),
            ))
        yield pd.DataFrame(out, columns=names)


def stretches(subagent: DataFrame) -> DataFrame:
    """Each stretch of each conversation, sorted and counted; written once to the shared folder."""
    uses = lambda kind, field: F.transform(F.filter("content", lambda b: C.block_type(b) == kind), lambda b: b[field])
    rows = C.rows(subagent).select(
        "session", "side", "stretch",
        F.struct(
            "line_no", "row_id", "role", F.unix_micros(C.moment(F.col("logged_at"))).alias("us"), uses("tool_use", "id").alias("calls"),
            uses("tool_result", "tool_use_id").alias("results"), (~F.exists("content", _says)).alias("blank"),
        ).alias("row"),
    )
    grouped = rows.groupBy("session", "side", "stretch").agg(C.gathered(F.col("row")).alias("rows"))
    return written(grouped.mapInPandas(_stretches, _STRETCH_TYPE), "stretches")


def verdicts(sorted_stretches: DataFrame) -> DataFrame:
    """One row per conversation: counts and ``reason``, the first cause to drop it, null where it is sound."""
    key = ["session", "side"]
    sides = F.concat(F.transform("calls", lambda c: F.struct(c.alias("id"), F.lit(1).alias("call"))), F.transform("results", lambda r: F.struct(r.alias("id"), F.lit(0).alias("call"))))
    first = lambda call: F.min(F.when(F.col("call") == call, F.col("stretch")))
    ids = sorted_stretches.select(*key, "stretch", F.inline(sides)).groupBy(*key, "id").agg(
        F.max("call").alias("called"), F.min("call").alias("open"), F.count("*").alias("n"), (first(0) < first(1)).alias("early"),
    )
    pairs = ids.groupBy(*key).agg(
        F.sum(F.when(F.col("id").isNull() | ((F.col("called") == 1) & (F.col("open") == 1)), F.col("n")).otherwise(0)).alias("unanswered"),
        F.sum(F.when(F.col("id").isNotNull() & (F.col("called") == 0), F.col("n")).otherwise(0)).alias("uncalled"),
        F.count_if(F.col("id").isNotNull() & F.col("early")).alias("early"),  # results in an earlier stretch than their call: a cycle over a seam
    )
    order = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    told = F.when(F.col("last_role").isNotNull(), F.col("ends_asking"))
    seams = sorted_stretches.select(*key, "stretch", "users", "assistants", "doubled", "starts_user", "ends_asking", "last_role", "cyclic", "blank").withColumn("seam", F.last(told, ignorenulls=True).over(order) & F.col("starts_user"))
    counts = seams.groupBy(*key).agg(
        F.sum("users").alias("user_rows"), F.sum("assistants").alias("assistant_rows"), F.sum("blank").alias("blank_rows"),
        (F.sum("doubled") + F.coalesce(F.count_if("seam"), F.lit(0))).alias("unreplied"), F.sum("cyclic").alias("cyclic_rows"),
        F.max_by("last_role", F.when(F.col("last_role").isNotNull(), F.col("stretch"))).alias("last_role"),
    )
    joined = counts.join(pairs, key, "left").fillna(0, ["unanswered", "uncalled", "early"]).withColumn("cyclic_rows", F.col("cyclic_rows") + F.col("early")).drop("early")
    reason = (
        F.when(F.col("user_rows") == 0, "no user row")
        .when(F.col("assistant_rows") == 0, "no assistant row")
        .when(F.col("last_role") != "assistant", "no last reply")
        .when(F.col("unanswered") > 0, "call without result")
        .when(F.col("uncalled") > 0, "result without call")
        .when(F.col("unreplied") > 0, "user row without reply")
        .when(F.col("cyclic_rows") > 0, "replies in a circle")
    )
    return joined.withColumn("reason", reason)


def dropped(subagent: DataFrame) -> DataFrame:
    """The conversations to be dropped."""
    return verdicts(stretches(subagent)).filter(F.col("reason").isNotNull())


def conversations(subagent: DataFrame) -> DataFrame:
    """The rows of the sound conversations: ``session, side, position, row_id, role``; positions run from 0."""
    key = ["session", "side"]
    sorted_stretches = stretches(subagent)
    sound = verdicts(sorted_stretches).filter(F.col("reason").isNull()).select(*key)
    order = Window.partitionBy(*key).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begun = sorted_stretches.select(*key, "stretch", "turns").withColumn("before", F.coalesce(F.sum(F.size("turns")).over(order), F.lit(0)))
    kept = begun.join(sound, key, "left_semi").select(*key, "before", F.posexplode("turns").alias("at", "turn"))
    return kept.select(*key, (F.col("before") + F.col("at")).alias("position"), "turn.row_id", "turn.role")

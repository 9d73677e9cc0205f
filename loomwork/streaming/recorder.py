"""The recorder of repeated work as a stream: per session its state, then counters merged batch by batch.

Events: ``session, at, kind ('batch' or 'prompt'), prompt, tools, commands, failed, chars`` with arrays of one entry per call.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import signatures as S
from loomwork.functions.shared import written
from loomwork.operators.recorder import MAX_SAMPLES, MAX_SESSIONS, fair_prune

SIGNAL = "kind string, sig string, calls long, chars long, session string, sample string, at long"
STATE = "batches int, last_sequence string, recent array<string>, waiting array<string>"
WAITING = 256  # failed commands remembered per session
_EMPTY = (0, "", [], [])


def step(state: tuple, event: dict) -> tuple[tuple, list[tuple]]:
    """State and signals after one event; also what a batch replay uses."""
    batches, last, recent, waiting = state
    recent, waiting, out = list(recent), list(waiting), []
    session, at = event["session"], event["at"]
    if event["kind"] == "prompt":
        prompt = event["prompt"] or ""
        opening = prompt.strip().lower()[:40]
        correction = batches > 0 and any(opening.startswith(c) for c in S.CORRECTIONS)
        out.append(("correction" if correction else "intent", _intent(prompt), 0, 0, session, prompt, at))
        if last:
            out.append(("verify", last, 0, 0, "", "", at))  # without a session, as live recording has it
        return (batches, "", recent, waiting), out
    steps = []
    for i, tool in enumerate(event["tools"]):
        command = event["commands"][i]
        steps.append(f"Bash({S.command_family(command)})" if tool == "Bash" and command else tool)
        if not command:
            continue
        sig, chars = S.command_shape(command), int(event["chars"][i] or 0)
        out.append(("command", sig, 1, chars, session, command, at))
        if event["failed"][i]:
            waiting = [w for w in waiting if w != sig][-WAITING + 1 :] + [sig]
        elif sig in waiting:
            waiting.remove(sig)
            out.append(("error-fix", sig, 2, 0, session, command, at))
        script = S.script_shape(command)
        if script:
            out.append(("tool", script, 1, chars, session, command, at))
    recent = (recent + steps)[-3:]
    if len(recent) == 3 and len(set(recent)) > 1:
        out.append(("sequence", " → ".join(recent), 3, 0, session, "", at))
    sequence = " → ".join(steps)
    if batches == 0 and steps:
        out.append(("orient", sequence, len(steps), 0, session, "", at))
    return (batches + 1, sequence, recent, waiting), out


def _intent(prompt: str) -> str:
    import re

    plain = re.sub(r"```.*?```", " ", S._redacted(prompt).lower(), flags=re.DOTALL)
    telling = dict.fromkeys(w for w in re.findall(r"[a-z][a-z0-9-]{2,}", plain) if w not in S.STOPWORDS)
    return " ".join(sorted(list(telling)[:4]))


def signal_stream(events: DataFrame, idle: str | None = None) -> DataFrame:
    """Signals of a stream of events; with ``idle``, for streams that never end, a session's state is dropped after that time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    millis = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else _EMPTY
        rows: list[tuple] = []
        whole = pd.concat(list(batches)).sort_values("at", kind="stable")
        for event in whole.to_dict("records"):
            now, out = step(now, event)
            rows += out
        state.update((int(now[0]), now[1], list(now[2]), list(now[3])))
        if idle:
            state.setTimeoutDuration(millis)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNAL.split(", ")])

    return events.groupBy("session").applyInPandasWithState(update, SIGNAL, STATE, "append", timeout)


def merged(counters: DataFrame, fresh: DataFrame) -> DataFrame:
    """Counters of two times as one; sessions and samples keep their order and limits."""
    both = counters.withColumn("__o", F.lit(0)).unionByName(fresh.withColumn("__o", F.lit(1)))
    first = lambda c, most: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__o", c))), lambda x: x[c]))), 1, most).alias(c)
    return both.groupBy("kind", "sig").agg(F.sum("n").alias("n"), F.sum("calls").alias("calls"), F.sum("chars").alias("chars"), F.max("last_seen").alias("last_seen"), first("sessions", MAX_SESSIONS), first("samples", MAX_SAMPLES))


def store_writer(path: str):
    """For ``foreachBatch``: each batch is merged into a new version of the counters, named after the batch, so a repeated
    batch changes nothing; the version before stays until the next is whole."""
    from loomwork.operators.recorder import counted

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = written(batch, "signals")  # read several times below, while a stateful batch may run only once
        fresh = counted(held).select("kind", "sig", "n", "calls", "chars", "last_seen", "sessions", "samples")
        if batch_id > 0:
            fresh = merged(spark.read.parquet(f"{path}/v={batch_id - 1}"), fresh)
        fair_prune(fresh).write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write

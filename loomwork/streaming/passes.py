"""Passes per session and agent as a stream: tried at the trigger and after a cooldown, taken or handed over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomwork.plans.options import PassOptions

OUT = "session string, agent string, turn int, action string, passes int"


def step(state: tuple[int, int, int], turn: int, percent: float, freed_percent: float | None, speculative: bool, options: PassOptions) -> tuple[tuple[int, int, int], str]:
    """State ``(passes, last_turn, last_at)`` and what happens at a turn: wait, cooldown, speculative, taken or handed over.

    ``freed_percent`` is null where the pass failed, which hands over. Handing over starts the count anew.
    """
    passes, last, _ = state
    if percent < options.compact_at_percent:
        return state, "wait"
    if last >= 0 and turn - last < options.cooldown_turns:
        return state, "cooldown"
    good = freed_percent is not None and freed_percent == freed_percent and freed_percent >= options.min_freed_percent and passes < options.max_passes
    if speculative:
        return state, "speculative"
    return ((passes + 1, turn, turn), "taken") if good else ((0, turn, turn), "handed over")


def pass_stream(turns: DataFrame, options: PassOptions = PassOptions(), idle: str | None = None) -> DataFrame:
    """Actions for turns ``session, agent, turn, percent, freed_percent, speculative``; ``idle`` as for the recorder."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    millis = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else (0, -1, -1)
        rows = []
        for e in pd.concat(list(batches)).sort_values("turn", kind="stable").to_dict("records"):
            now, action = step(now, int(e["turn"]), e["percent"], e["freed_percent"], bool(e["speculative"]), options)
            rows.append((*key, int(e["turn"]), action, now[0]))
        state.update(now)
        if idle:
            state.setTimeoutDuration(millis)
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return turns.groupBy("session", "agent").applyInPandasWithState(update, OUT, "passes int, last_turn int, last_at int", "append", timeout)

"""Options of a compaction, and the values its results depend on."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Fixed values.
MUTATING = ["Edit", "Write", "MultiEdit", "NotebookEdit"]
UNREPEATABLE = ["AskUserQuestion", "ExitPlanMode"]
TARGET_KEYS = ["file_path", "notebook_path", "command", "url", "pattern", "path", "query", "prompt", "description"]
FEATURES = ["bias", "tool=Read", "tool=Bash", "tool=Edit|Write", "tool=Grep|Glob", "isError", "targetTouchedAfter", "targetReadAgain", "size=very short", "size=short", "size=very long", "age=long ago", "age=just now"]
KEEP_RESULT = [-0.854504, -0.080158, -0.103559, -1.961938, 0.0, -0.203870, 2.283794, -0.585116, -3.047582, -1.474709, -0.259475, 0.074074, 0.097573]
KEEP_CALL = [-0.614181, -0.379293, -0.405222, 0.438643, 0.0, -0.059718, 3.600786, 4.605452, -2.658946, -1.263787, 0.195068, 0.062363, 0.059608]
# Also fixed: head and tail of excerpts from the longest to none, characters a token, the note of a cut and its slack.
EXCERPTS = [(2400, 700), (1400, 450), (800, 250), (400, 120), (150, 50), (0, 0)]
CHARS_PER_TOKEN = 2.946
#: Opens the note that takes the place of a cut text; its length counts in every figure of freed characters.
MARK = "[outputs truncated "
SLACK = 120  # characters that a text may exceed a cut by


@dataclass(frozen=True)
class Weights:
    """Two heads of the scorer, a weight per feature."""

    keep_result: tuple[float, ...] = tuple(KEEP_RESULT)
    keep_call: tuple[float, ...] = tuple(KEEP_CALL)

    def __post_init__(self) -> None:
        for head in (self.keep_result, self.keep_call):
            if len(head) != len(FEATURES) or not all(isinstance(w, (int, float)) and abs(w) < float("inf") for w in head):
                raise ValueError(f"each head takes {len(FEATURES)} finite numbers")


def _finite(value, default):
    return default if value is None or value != value or abs(value) == float("inf") else value


def _within(value, low, high, default):
    return min(high, max(low, _finite(value, default)))


@dataclass(frozen=True)
class Options:
    """Missing values and those that are not finite take the default. Counts are rounded down and have a least value; the share
    to free lies within 0 and 1; a threshold is taken as it is, so that one over 1 keeps nothing and one below 0 everything."""

    keep_threshold: float | None = 0.2
    preserve_recent: int | None = 6
    max_state_tokens: int | None = 700
    target_reduction: float | None = 0.5
    head_chars: int | None = 300
    min_yield_chars: int | None = 200
    max_kept_chars: int | None = 24_000

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        defaults = {name: f.default for name, f in self.__dataclass_fields__.items()}
        for name, default in defaults.items():
            put(name, _finite(getattr(self, name), default))
        put("target_reduction", min(1.0, max(0.0, self.target_reduction)))
        for name, least in (("preserve_recent", 0), ("max_state_tokens", 64), ("head_chars", 0), ("min_yield_chars", 0), ("max_kept_chars", 0)):
            put(name, max(least, math.floor(getattr(self, name))))


@dataclass(frozen=True)
class PassOptions:
    """When a pass is tried and taken."""

    compact_at_percent: float | None = 62.0
    min_freed_percent: float | None = 5.0
    max_passes: int | None = 6
    cooldown_turns: int = 2
    kept_sessions: int = 32

    def __post_init__(self) -> None:
        object.__setattr__(self, "compact_at_percent", _within(self.compact_at_percent, 1.0, 69.0, 62.0))
        object.__setattr__(self, "min_freed_percent", _within(self.min_freed_percent, 0.1, 100.0, 5.0))
        object.__setattr__(self, "max_passes", int(_within(self.max_passes, 1, 100, 6)))

"""Tool names as they are meant: one spelling per tool of a catalog, whatever is written.

A spelling is folded (compatibility forms, look-alike letters, invisible characters, case, wrappers, call suffixes and
namespaces) and looked up; failing that, a single slip of the keyboard away from exactly one tool is taken for it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g",
}
# Capitals look alike where their small forms don't, so they are folded before the case is.
LOOK_ALIKE_CAPITALS = {"В": "B", "Н": "H", "М": "M", "Т": "T", "У": "Y", "К": "K", "Ѕ": "S", "Β": "B", "Η": "H", "Μ": "M", "Ν": "N", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z", "Ι": "I", "Ο": "O", "Α": "A", "Ε": "E", "Κ": "K"}

_CAPITALS = str.maketrans(LOOK_ALIKE_CAPITALS)
_SMALL = str.maketrans(LOOK_ALIKES)
_NAMESPACE = re.compile(r"^(?:[a-z][a-z0-9_-]*\s*[.:/]+\s*)+(?=\S)")
_SUFFIX = re.compile(r"(?:\(\s*\)|\[\s*\d+\s*\]|[#:@]\s*\d+|[.,;!?…]+)+$")
_WRAP = " \t\r\n`\"'<>*[]{}«»“”‘’"
_EDGE = "abcdefghijklmnopqrstuvwxyz0123456789"


def folded(name: str) -> str:
    """``name`` without wrappers, namespaces, call suffixes, invisible characters and differences of case or script."""
    s = unicodedata.normalize("NFKC", name)
    s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Cc") or c.isspace())
    s = unicodedata.normalize("NFKD", s.translate(_CAPITALS).lower().translate(_SMALL))
    s = "".join(c for c in s if not unicodedata.combining(c))
    while True:
        before = s
        s = _NAMESPACE.sub("", _SUFFIX.sub("", s.strip(_WRAP + "\xa0")).strip(_WRAP))
        if s == before:
            return s


def key(name: str) -> str:
    """What is compared: the letters and digits of the folded name."""
    return re.sub(r"[^a-z0-9]", "", folded(name))


def slips(word: str) -> set[str]:
    """Every word that one dropped, doubled, added, changed or swapped letter makes of ``word``."""
    out = set()
    for i in range(len(word) + 1):
        a, b = word[:i], word[i:]
        out.update(a + c + b for c in _EDGE)
        if b:
            out.add(a + b[1:])
            out.update(a + c + b[1:] for c in _EDGE)
        if len(b) > 1:
            out.add(a + b[1] + b[0] + b[2:])
    return out - {word}


class Catalog:
    """Resolves spellings against a fixed list of tools; serialisable, and quick for names seen before."""

    def __init__(self, tools: list[str]):
        self.tools = sorted({t for t in tools if t and key(t)})
        self._build()

    def _build(self) -> None:
        self.exact = {}
        for t in reversed(self.tools):
            self.exact[key(t)] = t
        near: dict[str, set[str]] = {}
        for k, t in self.exact.items():
            for s in slips(k) if len(k) > 1 else ():
                near.setdefault(s, set()).add(t)
        self.near = {s: next(iter(t)) for s, t in near.items() if len(t) == 1}
        self.resolve = lru_cache(100_000)(self._resolve)

    def __getstate__(self):
        return self.tools

    def __setstate__(self, tools):
        self.tools = tools
        self._build()

    def _resolve(self, name: str) -> str | None:
        k = key(name)
        if not k:
            return None
        return self.exact.get(k) or self.near.get(k) or folded(name)


def catalog(table: DataFrame) -> Catalog:
    """Of the table of all tools, which is fixed and small by definition; beyond 10,000 rows it is refused."""
    rows = table.select("tool").distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a tool catalog has at most 10,000 tools")
    return Catalog([r.tool for r in rows])


_SEPARATOR = re.compile(r"\s*(?:->|=>|→|⇒|➔|➜|»|\||;|,|>|\n)\s*")
_SHELL = re.compile(r"^(.*?)\s*\(\s*(\S.*?)\s*\)\s*[.,;:]?\s*$", re.DOTALL)
_INSIDE = re.compile(r"\([^()]*\)")


def flow_steps(flow: str | None, tools: Catalog) -> list[str]:
    """The steps of one flow in their proper spelling; a shell step keeps its command family in brackets."""
    out = []
    held: list[str] = []

    def hold(m: re.Match) -> str:  # a separator within brackets is none
        held.append(m.group())
        return f"\ue000{len(held) - 1}\ue001"

    for part in _SEPARATOR.split(_INSIDE.sub(hold, (flow or "").replace("<", "").replace("`", ""))):
        part = re.sub("\ue000(\\d+)\ue001", lambda m: held[int(m.group(1))], part)
        shell = _SHELL.match(part)
        name = tools.resolve(shell.group(1) if shell else part)
        if name is not None:
            family = " ".join(shell.group(2).split()) if shell else ""
            out.append(f"{name}({family})" if family else name)
    return out

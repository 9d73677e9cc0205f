"""A scanner for code, configuration and prose: names, operators, quoted literals and line breaks, with their places.

It knows no single language: a literal opens with any quote, also an escaped or a tripled one, and closes with the same;
escapes within don't close it; an apostrophe within a word opens none; only tripled quotes and backticks reach over lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

_TOKENS = re.compile(
    r"""
    (?P<triple>(?P<t>\"{3}|'{3})(?P<ti>(?:\\.|(?!(?P=t)).)*?)(?P=t))
  | (?P<escaped>(?P<e>\\+["'])(?P<ei>(?:(?!(?P=e)|(?<!\\)["\n])(?:\\\\+["']|.))*?)(?P=e))
  | (?P<double>"(?P<di>(?:\\.|[^"\\\n])*)")
  | (?P<single>(?<![\w\\])'(?P<si>(?:\\.|[^'\\\n])*)'(?!\w))
  | (?P<tick>`(?P<bi>(?:\\.|[^`\\\n])*)`)
  | (?P<name>[A-Za-z_$][\w$]*(?:[.-][\w$]+)*)
  | (?P<op>:=|=>|==|!=|\+=|[=:(),{}\[\]<>|;+?!&@\n])
  | (?P<other>[^\s"'`A-Za-z_$=:(),{}\[\]<>|;+?!&@]+|.)
    """,
    re.VERBOSE | re.DOTALL,
)
_INNER = {"triple": "ti", "escaped": "ei", "double": "di", "single": "si", "tick": "bi"}
_ESCAPE = re.compile(r"""\\(?:u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[0-7]{3}|\\*[abefnrtv0"'`/]|\\|\r?\n)""")


class Token(NamedTuple):
    """``kind`` is name, literal, op or other; ``start`` and ``end`` are those of the literal's content where it is one."""

    kind: str
    start: int
    end: int
    outer: int
    close: int


def tokens(text: str, start: int = 0, end: int | None = None) -> Iterator[Token]:
    """The tokens of ``text`` between two places; blanks are none, line breaks are operators."""
    for m in _TOKENS.finditer(text, start, len(text) if end is None else end):
        kind = m.lastgroup if m.lastgroup in ("name", "op", "other") else next(k for k in _INNER if m.group(k) is not None)
        if kind in _INNER:
            a, b = m.span(_INNER[kind])
            yield Token("literal", a, b, m.start(), m.end())
        elif kind != "other" or not m.group().isspace():
            yield Token(kind, m.start(), m.end(), m.start(), m.end())


def masked_literal(value: str) -> str:
    """``value`` with all but its escapes and line breaks masked, so that what surrounds it still parses."""
    out, at = [], 0
    for m in _ESCAPE.finditer(value):
        out += [_stars(value[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, _stars(value[at:])])


def _stars(text: str) -> str:
    return re.sub(r"[^\r\n]", "*", text)

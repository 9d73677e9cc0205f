"""Scalar text functions as Column expressions. Lengths count UTF-16 units, as transcripts' own figures do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.plans.options import CHARS_PER_TOKEN, MARK, SLACK

SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
EDGE = rf"^{SPACE}+|{SPACE}+$"


def units(text: Column) -> Column:
    """UTF-16 units of a text; null counts as none. Plain ASCII, most texts, has as many as bytes."""
    plain = F.octet_length(text) == F.length(text)
    return F.coalesce(F.when(plain, F.octet_length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGE, "")


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis where something was cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, max(0, limit - 1)), F.lit("…")))


def tokens_of_chars(chars: Column) -> Column:
    """Tokens that so many characters come to, halves rounded up."""
    return F.floor(chars / F.lit(CHARS_PER_TOKEN) + F.lit(0.5)).cast("long")


def estimate_tokens(text: Column) -> Column:
    """Tokens estimated from words, digits and signs, summed from left to right and rounded up."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"([A-Za-z]+|[0-9]+|(?!{SPACE})[^A-Za-z0-9])"), F.lit(1))
    code = lambda p: F.ascii(p)
    wide = lambda p: (
        F.when(code(p) > 0xFFFF, 3.5)
        .when((code(p) >= 0x3040) & (code(p) <= 0x9FFF) | (code(p) >= 0xAC00) & (code(p) <= 0xD7AF) | (code(p) >= 0xF900) & (code(p) <= 0xFAFF), 1.75)
        .when(code(p) > 0x7F, 1.1)
        .otherwise(0.9)
    )
    cost = lambda p: F.when(p.rlike("^[0-9]"), F.length(p) / 2.0).when(p.rlike("^[A-Za-z]"), (F.lit(1) + F.floor((F.length(p) - 1) / 6)).cast("double")).otherwise(wide(p))
    return F.ceil(F.aggregate(pieces, F.lit(0.0), lambda total, p: total + cost(p))).cast("int")


def note(chars: Column, is_error: Column, head: Column | int) -> Column:
    """The note that takes the place of what was cut."""
    return F.concat(F.lit(MARK), (chars - head).cast("string"), F.lit(" chars of this tool result"), F.when(is_error, " (error)").otherwise(""), F.lit("; re-run the tool if needed]"))


def truncated_length(chars: Column, is_error: Column, head: Column | int) -> Column:
    """Characters left of a text of ``chars`` when cut after ``head``."""
    head = head if isinstance(head, Column) else F.lit(head)
    fixed = len(MARK) + len(" chars of this tool result") + len("; re-run the tool if needed]")
    left = F.when(head > 0, head + 1).otherwise(0) + fixed + F.length((chars - head).cast("string")) + F.when(is_error, len(" (error)")).otherwise(0)
    return F.when(chars <= head + SLACK, chars).otherwise(left).cast("long")


def truncated_text(text: Column, is_error: Column, head: int) -> Column:
    """The text cut after ``head`` characters, with the note."""
    start = F.concat(F.substring(text, 1, head), F.lit("\n")) if head > 0 else F.lit("")
    return F.when(units(text) <= head + SLACK, text).otherwise(F.concat(start, note(units(text), is_error, head)))


def excerpt(text: Column, head: int, tail: int) -> Column:
    """Head and tail of a text around a mark of what is left out."""
    if head == 0:
        return F.lit("")
    return F.when(F.length(text) <= head + tail + 40, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n[... middle omitted ...]\n"), F.right(text, F.lit(tail))))


def words(text: Column, pattern: str = "[a-z0-9_./-]+") -> Column:
    """Words of the lower-cased text; the pattern is that of labels. Others: ``[a-z0-9]+`` prose, ``[a-z0-9]{3,}`` novelty, ``[a-z0-9]{2,}`` retrieval."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def shingles(text: Column, n: int = 8, most: int | None = None) -> Column:
    """Runs of ``n`` words; with ``most``, every so many of them that no more than that remain."""
    def of(w: Column) -> Column:
        total = F.size(w) - n + 1
        stride = F.greatest(F.lit(1), F.ceil(total / F.lit(most))).cast("int") if most else F.lit(1)
        found = F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1)), stride), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(total < 1, F.array().cast("array<string>")).otherwise(found)

    # bound as a variable, so that the words are found once and not for every shingle
    return F.transform(F.array(words(text)), of)[0]


def sentences(text: Column) -> Column:
    """Sentences and lines of three or more words."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), trimmed), lambda s: F.size(F.split(s, r"\s+")) >= 3)


def encoded_share(text: Column) -> Column:
    """Share of a text in long runs that look encoded."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9+/=]{40,})"), F.lit(1))
    return F.when(F.length(text) > 0, F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r)) / F.length(text)).otherwise(0.0)


def temperature(p: Column, t: Column | float) -> Column:
    """A probability sharpened or flattened by a temperature."""
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    a, b = F.pow(q, F.lit(1.0) / t), F.pow(1 - q, F.lit(1.0) / t)
    return a / (a + b)

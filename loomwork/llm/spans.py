"""Long exact spans that several records share, and how much of each record stands elsewhere too.

Lines or paragraphs as units miss spans that begin and end within a line, so the units hashed here are chosen by content:
of every ``span - UNIT + 1`` neighbouring stretches of ``UNIT`` characters the one with the least hash. Any span of
``span`` characters then holds a whole unit, the same one wherever it stands. Units are grouped by digest over all
records; those of one record only are let go. Around each shared unit its text is read again as far as a span could reach,
equal surroundings are held once, different ones are compared by their characters, and every shared span goes
to the earliest record that holds it, with the original offsets kept for the rest.

Results for odd input: null, empty and shorter texts share nothing; a record delivered several times counts once, and
what it repeats within itself doesn't count; offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.shared import written
from loomwork.llm.credentials import texts

SPAN = 200
UNIT = 96
CROWD = 64  # classes of one unit that are compared by pairs; more are compared by the hashes of their spans
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93  # odd, so that it can be undone


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the step and of what undoes it."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def unit_hashes(text: str, unit: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The hash of every stretch of ``unit`` characters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = (code + np.uint64(1)) * _MIX
    code ^= code >> np.uint64(29)
    n = len(code)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * powers[0][:n])])
    found = (sums[unit:] - sums[:-unit]) * powers[1][: n - unit + 1]  # all as if at one place
    found ^= found >> np.uint64(31)
    found *= _MIX
    return found ^ (found >> np.uint64(29))


def chosen(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least hash, the last of equal ones, of some ``window`` neighbours."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))])
    low, width = hashes, 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = window - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    # a place is chosen if it equals the least of a window that holds it and no later place of that window does
    at = np.flatnonzero(hashes == _spread(low, window, n))
    return at


def _spread(low: np.ndarray, window: int, n: int) -> np.ndarray:
    """For each place the greatest of the windows' least hashes over the windows that hold it."""
    top = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    width = 1
    while 2 * width <= window:
        top = np.maximum(top[:-width], top[width:])
        width *= 2
    rest = window - width
    if rest:
        top = np.maximum(top[:-rest], top[rest:])
    return top[:n]


def _unit_rows(span: int, unit: int):
    window = span - unit + 1

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _powers(1 << 16)
        for batch in batches:
            digests, owners, places = [], [], []
            for i, value in enumerate(batch["value"]):
                if len(value) > len(powers[0]):
                    powers = _powers(2 * len(value))
                hashes = unit_hashes(value, unit, powers)
                at = chosen(hashes, window)
                digests.append(hashes[at].view(np.int64))
                owners.append(np.full(len(at), i))
                places.append(at)
            if owners:
                out = batch.drop(columns="value").iloc[np.concatenate(owners)].reset_index(drop=True)
                yield out.assign(digest=np.concatenate(digests), place=np.concatenate(places).astype(np.int32))

    return rows


_KEY = "row_id long, block_no int, part string"


def _long_texts(subagent: DataFrame, span: int) -> DataFrame:
    return texts(subagent).filter((F.length("value") >= span) & F.col("row_id").isNotNull())


def shared_units(subagent: DataFrame, span: int = SPAN, unit: int = UNIT) -> DataFrame:
    """Units that several records hold, with their surroundings: ``row_id, block_no, part, digest, place, before, around``."""
    key = ["row_id", "block_no", "part"]
    reach = span - unit
    long_texts = _long_texts(subagent, span)
    units = written(long_texts.mapInPandas(_unit_rows(span, unit), _KEY + ", digest long, place int"), "units")
    held = units.groupBy("digest").agg(F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    several = held.filter(F.col("first") != F.col("last")).select("digest")
    places = units.join(several, "digest", "left_semi").groupBy(*key).agg(F.collect_set(F.struct("digest", "place")).alias("units"))
    again = long_texts.join(places, key).dropDuplicates(key)
    each = again.select(*key, "value", F.inline("units"))
    start = F.greatest(F.lit(0), F.col("place") - reach)
    full = each.select(*key, "digest", "place", (F.col("place") - start).alias("before"), F.substring("value", start + 1, F.col("place") - start + span).alias("around"))
    return written(full, "surroundings")


def _extent(span: int, unit: int):
    """Of two surroundings of one unit: how many characters they share before and from the unit on, or nothing."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, at_a, at_b, text_a, text_b in batch.itertuples(index=False, name=None):
                left = 0
                while left < min(at_a, at_b) and text_a[at_a - left - 1] == text_b[at_b - left - 1]:
                    left += 1
                right, most = 0, min(len(text_a) - at_a, len(text_b) - at_b)
                while right < most and text_a[at_a + right] == text_b[at_b + right]:
                    right += 1
                if right >= unit and left + right >= span:
                    out.append((a, b, left, right))
            yield pd.DataFrame(out, columns=["a", "b", "left", "right"])

    return rows


def _classes(subagent: DataFrame, span: int, unit: int) -> tuple[DataFrame, DataFrame]:
    """Equal surroundings as one class, ``class, digest, before, around, first, last``, and its places, ``class, row_id, block_no, part, place``."""
    units = shared_units(subagent, span, unit)
    key = F.struct("digest", "before", F.length("around").alias("n"), F.sha2("around", 256).alias("h"))
    named = units.withColumn("class", F.sha1(F.to_json(key)))
    members = named.select("class", "row_id", "block_no", "part", "place").distinct()
    classes = named.groupBy("class").agg(F.first("digest").alias("digest"), F.first("before").alias("before"), F.first("around").alias("around"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))
    return written(classes, "classes"), members


def _crowded(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of units that few and that many classes hold."""
    sizes = classes.groupBy("digest").agg(F.count("*").alias("k")).filter(F.col("k") > CROWD)
    return classes.join(sizes, "digest", "left_anti"), classes.join(sizes, "digest", "left_semi")


def _windows(classes: DataFrame, span: int) -> DataFrame:
    """Every span around a unit by its hash, ``class, digest, first, last, left, h``: work that grows with the classes, not with their pairs."""
    starts = F.transform(F.sequence(F.lit(0), F.length("around") - span), lambda o: F.struct((F.col("before") - o).alias("left"), F.sha1(F.substring("around", o + 1, F.lit(span))).alias("h")))
    return classes.filter(F.length("around") >= span).select("class", "digest", "first", "last", F.inline(starts))


def _met(classes: DataFrame, span: int, unit: int) -> DataFrame:
    """Links between the few classes of a unit that share a span, ``a, b, left, right``; a class with itself where it has several records."""
    own = classes.filter((F.col("first") != F.col("last")) & (F.length("around") >= span)).select(F.col("class").alias("a"), F.col("class").alias("b"), F.col("before").alias("left"), (F.length("around") - F.col("before")).alias("right"))
    left = classes.select("digest", F.col("class").alias("a"), F.col("before").alias("at_a"), F.col("around").alias("text_a"))
    right = classes.select("digest", F.col("class").alias("b"), F.col("before").alias("at_b"), F.col("around").alias("text_b"))
    met = left.join(right, (left.digest == right.digest) & (F.col("a") < F.col("b"))).select("a", "b", "at_a", "at_b", "text_a", "text_b")
    return own.unionByName(met.mapInPandas(_extent(span, unit), "a string, b string, left int, right int"))


def shared_spans(subagent: DataFrame, span: int = SPAN, unit: int = UNIT) -> tuple[DataFrame, DataFrame]:
    """Sets of classes that share one span, ``group, class``, and the places of each class. Copies stay members of one class and
    are never paired here, nor are the classes of a set."""
    classes, members = _classes(subagent, span, unit)
    few, many = _crowded(classes)
    links = _met(few, span, unit).select("a", "b").distinct()
    paired = links.select(F.concat_ws("/", "a", "b").alias("group"), F.explode(F.array_distinct(F.array("a", "b"))).alias("class"))
    windows = _windows(many, span)
    key = ["digest", "left", "h"]
    several = windows.groupBy(*key).agg(F.min("first").alias("least"), F.max("last").alias("most")).filter(F.col("least") != F.col("most"))
    hashed = windows.join(several.select(*key), key, "left_semi").select(F.sha1(F.concat_ws("/", *key)).alias("group"), "class")
    return paired.unionByName(hashed), members


def span_classes(subagent: DataFrame, span: int = SPAN, unit: int = UNIT) -> DataFrame:
    """One row per text and class of equal surroundings that others share: ``row_id, block_no, part, place, class, n_groups``."""
    groups, members = shared_spans(subagent, span, unit)
    counted = groups.groupBy("class").agg(F.count_distinct("group").alias("n_groups"))
    return members.join(counted, "class").select("row_id", "block_no", "part", "place", "class", "n_groups")


def shared_pairs(subagent: DataFrame, span: int = SPAN, unit: int = UNIT) -> DataFrame:
    """Pairs of records that share a span: ``row_a, row_b`` with the smaller first."""
    groups, members = shared_spans(subagent, span, unit)
    rows = members.select("class", "row_id").distinct()
    held = groups.join(rows, "class").select("group", "row_id").distinct()
    met = held.select("group", F.col("row_id").alias("row_a")).join(held.select("group", F.col("row_id").alias("row_b")), "group")
    return met.filter(F.col("row_a") < F.col("row_b")).select("row_a", "row_b").distinct()


def _covered(intervals: list) -> int:
    total, end = 0, -1
    for a, b in intervals:
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def shared_parts(subagent: DataFrame, span: int = SPAN, unit: int = UNIT) -> DataFrame:
    """Per text with a shared span: ``row_id, block_no, part, starts, ends, keepers``, spans in order.

    A keeper is the earliest record that holds the span of that unit; where it is the row itself, the span is kept there.
    """
    classes, members = _classes(subagent, span, unit)
    few, many = _crowded(classes)
    links = _met(few, span, unit)
    sides = links.select(F.col("a").alias("class"), F.col("b").alias("other"), "left", "right").unionByName(links.filter(F.col("a") != F.col("b")).select(F.col("b").alias("class"), F.col("a").alias("other"), "left", "right"))
    ranked = sides.join(classes.select(F.col("class").alias("other"), "first", "last"), "other")
    # one row per class and extent: its earliest holder, and what shows that another record holds it too
    met = ranked.groupBy("class", "left", "right").agg(F.min("first").alias("least"), F.max("last").alias("most"))
    windows = _windows(many, span)
    shared = windows.groupBy("digest", "left", "h").agg(F.min("first").alias("least"), F.max("last").alias("most")).filter(F.col("least") != F.col("most"))
    hashed = windows.select("class", "digest", "left", "h").join(shared, ["digest", "left", "h"]).select("class", "left", (F.lit(span) - F.col("left")).alias("right"), "least", "most")
    reach = met.unionByName(hashed)
    at = members.join(reach, "class").filter((F.col("least") != F.col("row_id")) | (F.col("most") != F.col("row_id")))
    found = at.select("row_id", "block_no", "part", F.struct((F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"), F.least("least", "row_id").alias("keeper")).alias("span")).distinct()
    return found.groupBy("row_id", "block_no", "part").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def shared_share(subagent: DataFrame, span: int = SPAN, unit: int = UNIT) -> DataFrame:
    """For every record: ``row_id, n_chars, shared_chars, share, repeated_chars``.

    Shared characters stand in a span that another record holds; repeated ones in a span of an earlier record.
    """
    whole = texts(subagent).filter(F.col("row_id").isNotNull()).select("row_id", "block_no", "part", F.length("value").alias("n")).distinct().groupBy("row_id").agg(F.sum("n").alias("n_chars"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shared = [_covered([(s["start"], s["end"]) for s in spans]) for spans in batch["spans"]]
            later = [_covered([(s["start"], s["end"]) for s in spans if s["keeper"] != row]) for row, spans in zip(batch["row_id"], batch["spans"])]
            yield pd.DataFrame({"row_id": batch["row_id"], "shared": shared, "repeated": later})

    parts = shared_parts(subagent, span, unit).select("row_id", "spans").mapInPandas(count, "row_id long, shared long, repeated long")
    sums = parts.groupBy("row_id").agg(F.sum("shared").alias("shared_chars"), F.sum("repeated").alias("repeated_chars"))
    rows = subagent.select("row_id").filter(F.col("row_id").isNotNull()).distinct()
    joined = rows.join(whole, "row_id", "left").join(sums, "row_id", "left").fillna(0, ["n_chars", "shared_chars", "repeated_chars"])
    return joined.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))


def unrepeated(subagent: DataFrame, span: int = SPAN, unit: int = UNIT) -> DataFrame:
    """Texts that repeat spans of earlier records, without them: ``row_id, block_no, part, text, removed``.

    The earliest record keeps a span. ``removed`` holds what was taken out, ``start, end, keeper``, joined where it overlaps
    and with the offsets of the original text, so that the text can be put together again.
    """
    key = ["row_id", "block_no", "part"]

    def take_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, block, part, value, spans in batch.itertuples(index=False, name=None):
                removed: list[dict] = []
                for s in spans:
                    if s["keeper"] == row:
                        continue
                    if removed and s["start"] < removed[-1]["end"]:
                        removed[-1]["end"] = max(removed[-1]["end"], s["end"])
                        removed[-1]["keeper"] = min(removed[-1]["keeper"], s["keeper"])
                    else:
                        removed.append({"start": s["start"], "end": s["end"], "keeper": s["keeper"]})
                if removed:
                    cuts = [0, *(p for r in removed for p in (r["start"], r["end"])), len(value)]
                    out.append((row, block, part, "".join(value[a:b] for a, b in zip(cuts[::2], cuts[1::2])), removed))
            yield pd.DataFrame(out, columns=[*key, "text", "removed"])

    held = shared_parts(subagent, span, unit)
    whole = _long_texts(subagent, span).join(held, key).dropDuplicates(key).select(*key, "value", "spans")
    return whole.mapInPandas(take_out, "row_id long, block_no int, part string, text string, removed array<struct<start:int,end:int,keeper:long>>")


def shared_lines(subagent: DataFrame, least: int = SPAN) -> DataFrame:
    """Lines and paragraphs of several records, blanks and case apart: ``digest, keeper, row_id, block_no, part, start, length``.

    The plainer units: what they find is a part of what ``shared_pairs`` finds, as spans may begin and end within a line.
    """
    key = ["row_id", "block_no", "part"]
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))

    def units(pattern: str) -> DataFrame:
        pieces = F.split("value", pattern)
        starts = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p) + len(pattern.encode().decode("unicode_escape")))))
        return _long_texts(subagent, least).select(*key, F.inline(F.arrays_zip(pieces.alias("piece"), F.slice(starts, 1, F.size(pieces)).alias("start"))))

    both = units("\n").unionByName(units("\n\n")).filter(F.length("piece") >= least).select(*key, "start", F.length("piece").alias("length"), F.sha1(plain(F.col("piece"))).alias("digest")).distinct()
    several = both.groupBy("digest").agg(F.min("row_id").alias("keeper"), F.max("row_id").alias("last")).filter(F.col("keeper") != F.col("last")).drop("last")
    return both.join(several, "digest").select("digest", "keeper", *key, "start", "length")

"""Nested JSON records as flat tables: each distinct object once, each occurrence as a row that names its parent.

Objects are hashed bottom-up: an object's hash covers its fields in order of name with the hashes of the objects below
in their place, so equal subtrees have equal hashes wherever they stand. ``objects`` holds each hash once, ``bridges`` every
occurrence with its parent, field and position.

Results for odd input: lines that are not exactly one JSON object (blank, cut off, with anything after it, with NaN) yield
nothing; of repeated names in an object the last counts; a null ``type`` or id counts as absent; other scalar values are
taken as their JSON text; a record delivered several times counts once; rows without ``raw_id`` are skipped.
"""

from __future__ import annotations

import hashlib
import json
import json.decoder
import json.scanner
import sys
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.shared import written

_BRIDGE = "raw_id long, node int, parent_node int, field string, ordinal int, depth int, path string, hash string, parent_hash string, kind string, ref_id string, body string"
FRAMES = 2_000_000  # of Python's own, a few a level; a line of 2 GB would be the bound
_COLUMNS = [c.split()[0] for c in _BRIDGE.split(", ")]


def _refuse(name: str) -> None:
    raise ValueError(name)


def one_object(line: str | None) -> dict | None:
    """The line's object, or nothing if the line is anything else."""
    if not line or not line.strip(" \t\r\n").startswith("{"):
        return None
    try:
        try:
            found = json.loads(line, parse_constant=_refuse)
        except RecursionError:  # deeper than the C scanner goes
            found = _deep_decoder().decode(line)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


@lru_cache(1)
def _deep_decoder() -> json.JSONDecoder:
    """A decoder in Python throughout, whose depth only the limit of Python's own frames bounds."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
    decoder = json.JSONDecoder(parse_constant=_refuse)
    decoder.parse_object, decoder.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
    decoder.scan_once = json.scanner.py_make_scanner(decoder)
    return decoder


def _text(value: Any) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _scalar(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def _array(texts: list[str]) -> str:
    return "[" + ",".join(texts) + "]"


def _named(obj: dict) -> tuple[str, str]:
    ref = obj.get("id")
    return _text(obj.get("type")), _text(ref if ref is not None else obj.get("tool_use_id"))


def occurrences(record: dict) -> list[tuple]:
    """Every object of a record, parents first: node, parent, field, ordinal, depth, path, hash, parent's hash, kind, id, body.

    ``path`` is that of a content block: positions from the outside in, null for other objects.
    """
    rows: list[list] = []

    def seal(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]

    def visit(obj: dict, parent: int | None, field: str, ordinal: int, depth: int, path: str | None, holds: bool) -> str:
        """``holds``: whether the elements of its ``content`` are blocks."""
        me = len(rows)
        rows.append([me, parent, field, ordinal, depth, path, None, None, *_named(obj), None])
        body = {}
        for name, value in obj.items():
            if isinstance(value, list) and name == "content" and holds:
                body[name] = _array([below(v, me, name, i, depth, i if path is None else f"{path}.{i}") for i, v in enumerate(value)])
            elif isinstance(value, str) and name == "content" and holds and path is None:  # a message's plain text is its one block
                body[name] = below({"type": "text", "text": value}, me, name, 0, depth, "0", plain=True)
            else:
                inner = name == "message" or (name == "payload" and "message" not in obj)
                body[name] = below(value, me, name, None, depth, None, parent is None and inner)
        text = "{" + ",".join(f"{_scalar(k)}:{body[k]}" for k in sorted(body)) + "}"
        digest = seal(text)
        rows[me][6], rows[me][10] = digest, text
        return digest

    def below(value: Any, me: int, field: str, ordinal: int | None, depth: int, path: Any, holds: bool = False, plain: bool = False) -> str:
        """The canonical text of a value, the hash in place of an object."""
        if isinstance(value, dict):
            digest = visit(value, me, field, ordinal, depth + 1, None if path is None else str(path), (path is not None or holds) and not plain)
            return '{"\\u0000hash":"' + digest + '"}'
        if isinstance(value, list):
            return _array([below(v, me, field, i, depth, None) for i, v in enumerate(value)])
        return _scalar(value)

    visit(record, None, "", None, 0, None, False)
    for row in rows:
        if row[1] is not None:
            row[7] = rows[row[1]][6]
    return [tuple(r) for r in rows]


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
    told: set[str] = set()  # hashes whose text this task has written
    for batch in batches:
        out = []
        for raw_id, line in batch.itertuples(index=False, name=None):
            record = one_object(line)
            if record is not None:
                for row in occurrences(record):
                    out.append((raw_id, *row[:10], None if row[6] in told else row[10]))
                    told.add(row[6])
        frame = pd.DataFrame(out, columns=_COLUMNS)
        yield frame.astype({"node": "Int32", "parent_node": "Int32", "ordinal": "Int32", "depth": "Int32"})


def bridges(raw_lines: DataFrame) -> DataFrame:
    """Every occurrence of every object; an object's own text stands at its first occurrence in each task only. Written once."""
    lines = raw_lines.select("raw_id", "line").filter(F.col("raw_id").isNotNull() & F.col("line").isNotNull()).dropDuplicates(["raw_id"])
    return written(lines.mapInPandas(_walk, _BRIDGE), "bridges")


def objects(bridge: DataFrame) -> DataFrame:
    """Each distinct object once: ``hash, kind, ref_id, body, occurrences``."""
    return bridge.groupBy("hash").agg(F.first("kind").alias("kind"), F.first("ref_id").alias("ref_id"), F.first("body", ignorenulls=True).alias("body"), F.count("*").alias("occurrences"))


def blocks(raw_lines: DataFrame) -> DataFrame:
    """Every content block: ``raw_id, path, parent_path, depth, hash, kind, ref_id``; a top block's parent is the record."""
    bridge = bridges(raw_lines)
    placed = bridge.filter(F.col("path").isNotNull())
    return placed.select("raw_id", "path", F.regexp_extract("path", r"^(.*)\.[0-9]+$", 1).alias("parent_path"), F.size(F.split("path", r"\.")).alias("depth"), "hash", "kind", "ref_id")


def records(raw_lines: DataFrame) -> DataFrame:
    """One row per readable record: ``raw_id, session, parent_session, line_no, hash, kind, n_objects, n_blocks``."""
    bridge = bridges(raw_lines)
    counts = bridge.groupBy("raw_id").agg(F.count("*").alias("n_objects"), F.count("path").alias("n_blocks"))
    roots = bridge.filter(F.col("parent_node").isNull()).select("raw_id", "hash", "kind")
    keys = raw_lines.select("raw_id", "session", "parent_session", "line_no").dropDuplicates(["raw_id"])
    return roots.join(counts, "raw_id").join(keys, "raw_id").select("raw_id", "session", "parent_session", "line_no", "hash", "kind", "n_objects", "n_blocks")

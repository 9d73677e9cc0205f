"""Transcripts as messages: from JSON lines in files, from parsed rows, from a foreign harness; labels, scores and sinks.

Messages: ``session, msg_idx, role, text, tool_uses, tool_results`` with ``tool_uses`` an array of ``tool_use_id, tool,
input_json`` and ``tool_results`` one of ``tool_use_id, text, is_error``. Lines that can't be read and rows of other types are
left out; a session's side rows are left out only where it has others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.prefix import ordered_totals

_BLOCK = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
USES = "array<struct<tool_use_id:string,tool:string,input_json:string>>"
RESULTS = "array<struct<tool_use_id:string,text:string,is_error:boolean>>"
# What another harness calls tools known here.
FOREIGN_TOOLS = {"shell": "Bash", "exec_command": "Bash", "local_shell": "Bash", "apply_patch": "Edit", "read_file": "Read", "grep_files": "Grep", "list_dir": "Glob", "web_search": "WebSearch", "update_plan": "TodoWrite"}


def lines(spark: SparkSession, folder: str, two_levels: bool = False) -> DataFrame:
    """Lines of all ``*.jsonl`` below ``folder``, or just two levels down: ``session, parent_session, file_path, mtime, size, line_no, line``."""
    read = spark.read.option("ignoreMissingFiles", True).option("wholetext", True)
    files = read.text(f"{folder}/*/*.jsonl") if two_levels else read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(folder)
    found = files.select("value", "_metadata.file_path", F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"))
    each = found.select("file_path", "mtime", "size", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return each.select(session_of_path(F.col("file_path")).alias("session"), parent_of_path(F.col("file_path")).alias("parent_session"), "file_path", "mtime", "size", F.col("line_no").cast("long").alias("line_no"), "line")


def session_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


def parent_of_path(path: Column) -> Column:
    """The first eight characters of the session a file belongs to; that of a side file is its folder's."""
    side = F.regexp_extract(path, r"([^/]+)/subagents/[^/]*$", 1)
    return F.substring(F.when(side != "", side).otherwise(session_of_path(path)), 1, 8)


def newest(raw: DataFrame, k: int, by: str = "mtime") -> DataFrame:
    """Lines of the ``k`` newest or largest files."""
    top = raw.select("file_path", by).distinct().orderBy(F.desc(by), "file_path").limit(k).select("file_path")
    return raw.join(F.broadcast(top), "file_path", "left_semi")


def content_text(content: Column, separator: str = "\n") -> Column:
    """Text of a content that is a string or an array of blocks."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t.isNotNull()), separator)
    return F.when(F.trim(content).startswith("["), joined).otherwise(content)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows ``session, at, issidechain`` and others that belong to their session, with ``msg_idx``; give narrow rows only."""
    side = F.coalesce(F.col("issidechain"), F.lit(False))
    main = F.max(~side).over(Window.partitionBy("session"))
    kept = rows.withColumn("has_main", main).filter(~side | ~F.col("has_main")).drop("has_main")
    return kept.withColumn("msg_idx", F.row_number().over(Window.partitionBy("session").orderBy("at")) - 1)


def _built(rows: DataFrame) -> DataFrame:
    """Messages of rows ``session, msg_idx, role, blocks``."""
    of = lambda kind: F.filter("blocks", lambda b: b["type"] == kind)
    texts = F.transform(F.filter("blocks", lambda b: b["type"].isin("text", "thinking")), lambda b: F.coalesce(b["text"], b["thinking"]))
    uses = F.transform(of("tool_use"), lambda b: F.struct(b["id"].alias("tool_use_id"), b["name"].alias("tool"), F.coalesce(b["input"], F.lit("{}")).alias("input_json")))
    results = F.transform(
        of("tool_result"),
        lambda b: F.struct(b["tool_use_id"].alias("tool_use_id"), F.coalesce(content_text(b["content"]), F.lit("")).alias("text"), F.coalesce(b["is_error"], F.lit(False)).alias("is_error")),
    )
    text = F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n")
    return rows.select("session", "msg_idx", "role", text.alias("text"), uses.cast(USES).alias("tool_uses"), results.cast(RESULTS).alias("tool_results"))


def messages(raw: DataFrame) -> DataFrame:
    """Messages of raw lines in the transcript dialect."""
    record = "struct<type:string,isSidechain:boolean,message:struct<content:string>>"
    parsed = raw.filter(F.col("line").contains("{")).withColumn("r", F.from_json("line", record)).filter(F.col("r.type").isin("user", "assistant") & F.col("session").isNotNull())
    content = F.col("r.message.content")
    plain = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("thinking", "id", "name", "input", "tool_use_id", "content")), F.lit(None).cast("boolean").alias("is_error")))
    blocks = F.when(F.trim(content).startswith("["), F.from_json(content, _BLOCK)).otherwise(F.when(content.isNotNull(), plain))
    return _built(_placed(parsed.select("session", F.col("line_no").alias("at"), F.col("r.type").alias("role"), F.col("r.isSidechain").alias("issidechain"), F.coalesce(blocks, F.array().cast(_BLOCK)).alias("blocks"))))


def messages_of_rows(subagent: DataFrame) -> DataFrame:
    """Messages of parsed transcript rows, each row once. Rows are numbered by their keys alone and meet their texts afterwards, so
    that no window over a session holds texts."""
    role = F.lower(F.trim("type"))
    content = lambda b: F.coalesce(b["content"], F.array_join(F.transform(F.filter(F.coalesce(b["items"], F.array()), lambda i: i["type"] == "text"), lambda i: i["text"]), "\n"))
    blocks = F.transform(F.coalesce(F.col("message.content"), F.array()), lambda b: F.struct(*(b[c].alias(c) for c in ("type", "text", "thinking", "id", "name", "input", "tool_use_id")), content(b).alias("content"), b["is_error"].alias("is_error")))
    told = subagent.filter(role.isin("user", "assistant") & F.col("session").isNotNull())
    keys = told.groupBy("row_id").agg(F.min(F.struct("session", "line_no", role.alias("role"), "issidechain")).alias("k")).select("row_id", "k.*")
    placed = _placed(keys.withColumn("at", F.struct("line_no", "row_id"))).select(F.col("row_id").alias("id"), "session", "msg_idx", "role")
    whole = told.select("row_id", blocks.alias("blocks"))
    return _built(placed.join(whole, F.col("id").eqNullSafe(F.col("row_id"))).dropDuplicates(["row_id"]))


def _foreign_items(raw: DataFrame) -> DataFrame:
    record = "struct<type:string,payload:struct<type:string,name:string,call_id:string,arguments:string,input:string,output:string>>"
    return raw.filter(F.col("line").contains("response_item")).select("session", "line_no", F.from_json("line", record).alias("r")).filter(F.col("r.type") == "response_item").select("session", "line_no", "r.payload.*")


def foreign_outputs(raw: DataFrame) -> DataFrame:
    """Outputs of the foreign dialect, the last of each call: ``session, call_id, output, exit_code``; they are JSON within JSON."""
    given = _foreign_items(raw).filter(F.col("type").isin("function_call_output", "custom_tool_call_output"))
    inner = F.from_json("output", "struct<output:string,metadata:struct<exit_code:int>>")
    each = given.select("session", "call_id", F.coalesce(inner["output"], content_text(F.col("output")), F.lit("")).alias("output"), inner["metadata"]["exit_code"].alias("exit_code"), "line_no")
    last = each.groupBy("session", "call_id").agg(F.max_by(F.struct("output", "exit_code"), F.struct("line_no", "output")).alias("g"))
    return last.select("session", "call_id", "g.output", "g.exit_code")


def foreign_calls(raw: DataFrame) -> DataFrame:
    """Calls of the foreign dialect under their names here: ``session, line_no, call_id, tool, input_json, output, exit_code``; calls without output are left out."""
    names = F.create_map(*[F.lit(x) for kv in FOREIGN_TOOLS.items() for x in kv])
    items = _foreign_items(raw).filter(F.col("type").isin("function_call", "custom_tool_call"))
    used = items.select("session", "line_no", "call_id", F.coalesce(F.try_element_at(names, F.col("name")), F.col("name")).alias("tool"), F.coalesce("arguments", "input").alias("input_json"))
    return used.join(foreign_outputs(raw), ["session", "call_id"]).select("session", "line_no", "call_id", "tool", "input_json", "output", "exit_code")


def scores_long(cache: DataFrame) -> DataFrame:
    """A score cache of JSON text ``{config: {key: {result, call}}}`` as rows ``config, key, result, call``."""
    inner = "map<string,map<string,struct<result:double,call:double>>>"
    each = cache.select(F.explode(F.from_json("value", inner)).alias("config", "m")).select("config", F.explode("m").alias("key", "s"))
    return each.select("config", "key", "s.result", "s.call")


def with_scores(labels: DataFrame, scores: DataFrame) -> DataFrame:
    """Labels with scores by composite key, else by bare id."""
    a = scores.select(F.col("config").alias("config_a"), F.col("key").alias("key_a"), F.struct("result", "call").alias("by_row"))
    b = scores.select(F.col("config").alias("config_b"), F.col("key").alias("key_b"), F.struct("result", "call").alias("by_id"))
    configs = scores.select("config").distinct()
    each = labels.withColumn("__k", F.concat_ws("\x00", "session", "tool_use_id")).join(configs)
    found = each.join(a, (F.col("__k") == F.col("key_a")) & (F.col("config") == F.col("config_a")), "left").join(b, (F.col("tool_use_id") == F.col("key_b")) & (F.col("config") == F.col("config_b")), "left")
    return found.withColumn("s", F.coalesce("by_row", "by_id")).select(*labels.columns, "config", F.col("s.result").alias("score_result"), F.col("s.call").alias("score_call"))


def fully_scored(scores: DataFrame) -> DataFrame:
    """Scores of the keys that every configuration has."""
    n = scores.agg(F.count_distinct("config").alias("n")).first().n
    keys = scores.groupBy("key").agg(F.count_distinct("config").alias("c")).filter(F.col("c") == n).select("key")
    return scores.join(keys, "key", "left_semi")


def signals(spark: SparkSession, file: str) -> DataFrame:
    """Rows of a mirrored signals store: ``kind, sig, n, calls, chars, sessions, samples, last_seen``; broken ones are left out."""
    row = "struct<kind:string,sig:string,n:bigint,calls:bigint,chars:bigint,sessions:array<string>,samples:array<string>,lastSeen:bigint>"
    whole = spark.read.option("wholetext", True).text(file).select(F.from_json("value", f"struct<version:int,rows:map<string,{row}>>").alias("s"))
    each = whole.select(F.explode("s.rows").alias("key", "r")).select("r.*").filter(F.col("kind").isNotNull() & F.col("sig").isNotNull() & (F.col("n") > 0))
    return each.select("kind", "sig", "n", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("sessions", F.array().cast("array<string>")).alias("sessions"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), F.col("lastSeen").alias("last_seen"))


STORE_ROWS = 2000


def write_store(signal_rows: DataFrame, path: str, written_at: int, version: int = 1) -> None:
    """One JSON object ``{version, writtenAt, rows}`` of a store that was pruned before; a larger one is refused."""
    if len(signal_rows.take(STORE_ROWS + 1)) > STORE_ROWS:
        raise ValueError(f"more than {STORE_ROWS} rows; prune the store first")
    row = F.struct("kind", "sig", "n", "calls", "chars", "sessions", "samples", F.col("last_seen").alias("lastSeen"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("::", "kind", "sig"), row)))
    signal_rows.agg(entries.alias("rows")).select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(written_at).alias("writtenAt"), "rows")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").json(path)


def append_missing(fresh: DataFrame, cache: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows that the cache lacks, appended to it."""
    todo = fresh.join(cache.select(*keys), keys, "left_anti")
    todo.write.mode("append").parquet(path)
    return todo


LEAKS = r"(?i)/(?:home|users|root)/|@[a-z0-9-]+\.|gh[pousr]_[A-Za-z0-9]{16}|sk-[A-Za-z0-9]{16}|AKIA[0-9A-Z]{12}"


def anonymised(rows: DataFrame, order: str, key: str = "session", private: str = r"[~/.A-Za-z0-9_-]*/[A-Za-z0-9_./-]+") -> DataFrame:
    """Keys numbered by first appearance and paths scrubbed in every text; call ``assert_clean`` before publishing."""
    first = rows.groupBy(key).agg(F.min(order).alias("__first"))
    placed = ordered_totals(first, ["__first", key], {"__rank": F.lit(1)})
    ranked = placed.select(key, F.concat(F.lit("s"), (F.col("__rank") + 1).cast("string")).alias("__new"))
    joined = rows.join(ranked, key)
    texts = {f.name: F.regexp_replace(f.name, private, "<path>") for f in rows.schema if isinstance(f.dataType, T.StringType) and f.name != key}
    return joined.withColumns(texts).withColumn(key, F.col("__new")).select(*rows.columns)


def assert_clean(rows: DataFrame, leaks: str = LEAKS) -> DataFrame:
    """The rows, or an error if any text looks private."""
    texts = [F.col(f.name) for f in rows.schema if isinstance(f.dataType, T.StringType)]
    if texts and not rows.filter(F.concat_ws("\n", *texts).rlike(leaks)).isEmpty():
        raise ValueError("rows hold private text; nothing is written")
    return rows


def scrubbed(text: Column, most: int = 24_000) -> Column:
    """Text of the same form without its characters: a fixed letter for letters, a digit for digits, spaces kept."""
    cut = F.substring(text, 1, most)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cut, r"\p{Lu}", "X"), r"\p{L}", "x"), r"\p{N}", "0")

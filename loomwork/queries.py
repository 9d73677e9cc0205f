"""The queries of the core, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import signatures, text, toolnames
from loomwork.operators import costs, facts, labels, metrics, mining, models, nested, pairing, rebuild, recorder, retrieval, scoring, simulate
from loomwork.operators.decide import decide, session_stats
from loomwork.plans.options import KEEP_CALL, KEEP_RESULT
from loomwork.sources import table
from loomwork.sources import transcripts as tr
from loomwork.sources.adapters import calls_from_events, scored_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    """Registers a query ``(spark, sf)`` under its name."""
    QUERIES[function.__name__] = function
    return function


def long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- nested records


@query
def p3_found(spark, sf):
    return nested.blocks(table(spark, sf, "raw_lines")).select("raw_id", "path", "kind", "ref_id").distinct()


SQL["p3_found"] = """WITH RECURSIVE d AS (SELECT DISTINCT ON (raw_id) raw_id, line::JSON AS j FROM raw_lines WHERE raw_id IS NOT NULL AND json_valid(line) AND json_type(line) = 'OBJECT'),
m AS (SELECT raw_id, list_contains(json_keys(j), 'message') AS own, CASE WHEN list_contains(json_keys(j), 'message') THEN j -> '$.message.content' ELSE j -> '$.payload.content' END AS c FROM d),
t AS (SELECT raw_id, CAST(i AS VARCHAR) AS path, c -> CAST('$[' || i || ']' AS VARCHAR) AS j FROM (SELECT raw_id, c, unnest(range(0, json_array_length(c)::BIGINT)) AS i FROM m WHERE json_type(c) = 'ARRAY')
  UNION ALL SELECT raw_id, path || '.' || i, c -> CAST('$[' || i || ']' AS VARCHAR) FROM (SELECT raw_id, path, j -> '$.content' AS c, unnest(range(0, json_array_length(j -> '$.content')::BIGINT)) AS i FROM t WHERE json_type(j) = 'OBJECT' AND json_type(j -> '$.content') = 'ARRAY'))
SELECT DISTINCT raw_id, path, coalesce(j ->> '$.type', '') AS kind, coalesce(j ->> '$.id', j ->> '$.tool_use_id', '') AS ref_id FROM t WHERE json_type(j) = 'OBJECT'
UNION SELECT raw_id, '0', 'text', '' FROM m WHERE own AND json_type(c) = 'VARCHAR'"""


@query
def p3_blocks(spark, sf):
    return nested.blocks(table(spark, sf, "raw_lines"))


@query
def p3_records(spark, sf):
    return nested.records(table(spark, sf, "raw_lines"))


@query
def p3_objects(spark, sf):
    return nested.objects(nested.bridges(table(spark, sf, "raw_lines")))


# ---- the compaction kernel over events


def _calls(spark, sf):
    return calls_from_events(table(spark, sf, "events"))


def _scored(spark, sf):
    return scoring.built_in(digits=6)(facts.with_facts(_calls(spark, sf)))


_CALLS = """WITH base AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_seq, event_id, ts,
  CASE event_type WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'AskUserQuestion' ELSE 'Bash' END AS tool,
  event_type = 'error' AS is_error, props AS target, CAST(round(value * 100) AS BIGINT) AS result_chars, count(*) OVER (PARTITION BY user_id) AS n FROM events),
calls AS (SELECT *, 2 * call_seq - 1 AS call_index, 2 * call_seq AS result_index, 2 * n + 1 AS total,
  (2 * call_seq - 1 >= 2 * n + 1 - 6 OR 2 * call_seq >= 2 * n + 1 - 6) AS pinned FROM base)"""
_FACTS = (
    _CALLS
    + """,
facts AS (SELECT *,
  coalesce(max(CASE WHEN tool = 'Edit' THEN call_seq END) OVER (PARTITION BY session, target) > call_seq, false) AS target_touched_after,
  max(call_seq) OVER (PARTITION BY session, target, tool) > call_seq AS rerun_later,
  CASE WHEN (total - 1 - call_index) / (total - 1) > 0.75 THEN 'long ago in the session' WHEN (total - 1 - call_index) / (total - 1) > 0.5 THEN 'a while back'
    WHEN (total - 1 - call_index) / (total - 1) > 0.25 THEN 'earlier in the session' ELSE 'just now' END AS age,
  CASE WHEN result_chars < 200 THEN 'very short' WHEN result_chars < 2000 THEN 'short' WHEN result_chars < 20000 THEN 'long' ELSE 'very long' END AS size FROM calls)"""
)


def _logit(w: list[float]) -> str:
    terms = ["tool = 'Read'", "tool = 'Bash'", "tool = 'Edit'", "false", "is_error", "target_touched_after", "rerun_later", "size = 'very short'", "size = 'short'", "size = 'very long'", "age = 'long ago in the session'", "age = 'just now'"]
    return f"({w[0]}" + "".join(f" + ({x}) * CASE WHEN {t} THEN 1 ELSE 0 END" for x, t in zip(w[1:], terms)) + ")"


_SCORES = _FACTS + f", scores AS (SELECT *, round(1 / (1 + exp(-{_logit(KEEP_RESULT)}::DOUBLE)), 6) AS keep_result, round(1 / (1 + exp(-{_logit(KEEP_CALL)}::DOUBLE)), 6) AS keep_call FROM facts)"
_CUT = "CASE WHEN result_chars <= {h} + 120 THEN 0 ELSE result_chars - ({h} + 1 + 73 + length(CAST(result_chars - {h} AS VARCHAR)) + CASE WHEN is_error THEN 8 ELSE 0 END) END"
_DECIDE = (
    _SCORES
    + f""",
first AS (SELECT *, CASE WHEN pinned THEN 'pinned' WHEN tool = 'AskUserQuestion' THEN 'unrepeatable' WHEN keep_result >= 0.2 THEN 'kept'
  WHEN keep_call >= 0.2 OR tool = 'Edit' THEN 'result_dropped' ELSE 'call_dropped' END AS r FROM scores),
yield AS (SELECT *, CASE r WHEN 'call_dropped' THEN result_chars + 2 WHEN 'result_dropped' THEN {_CUT.format(h=300)} ELSE 0 END AS f FROM first),
droppable AS (SELECT *, r IN ('call_dropped', 'result_dropped') AND f >= 200 AS d FROM yield),
summed AS (SELECT *, coalesce(sum(CASE WHEN d THEN f ELSE 0 END) OVER (PARTITION BY session ORDER BY d DESC, keep_result, call_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
  sum(CASE WHEN d THEN f ELSE 0 END) OVER (PARTITION BY session) AS whole FROM droppable),
named AS (SELECT *, CASE WHEN r NOT IN ('call_dropped', 'result_dropped') THEN r WHEN NOT d THEN 'too small' WHEN prior * 2 >= whole THEN 'budget' ELSE r END AS reason FROM summed),
decided AS (SELECT *, CASE reason WHEN 'call_dropped' THEN 'drop_call' WHEN 'result_dropped' THEN 'drop_result' ELSE 'keep' END AS action,
  CAST(CASE reason WHEN 'call_dropped' THEN result_chars + 2 WHEN 'result_dropped' THEN {_CUT.format(h=300)} ELSE {_CUT.format(h=24000)} END AS BIGINT) AS freed FROM named)"""
)


@query
def calls_paired(spark, sf):
    return _calls(spark, sf).select("session", "call_seq", "tool", "is_error", "target", "result_chars", "call_index", "result_index", "total", "pinned")


SQL["calls_paired"] = _CALLS + " SELECT session, call_seq, tool, is_error, target, result_chars, call_index, result_index, total, pinned FROM calls"


@query
def pinned_calls(spark, sf):
    return _calls(spark, sf).filter("pinned").groupBy("session").agg(F.count("*").alias("n_pinned"))


SQL["pinned_calls"] = _CALLS + " SELECT session, count(*) AS n_pinned FROM calls WHERE pinned GROUP BY session"


@query
def call_facts(spark, sf):
    return facts.with_facts(_calls(spark, sf)).select("session", "call_seq", "age", "size", "target_touched_after", "rerun_later")


SQL["call_facts"] = _FACTS + " SELECT session, call_seq, age, size, target_touched_after, rerun_later FROM facts"


@query
def call_scores(spark, sf):
    return _scored(spark, sf).select("session", "call_seq", "keep_result", "keep_call")


SQL["call_scores"] = _SCORES + " SELECT session, call_seq, keep_result, keep_call FROM scores"


@query
def decide_actions(spark, sf):
    return decide(_scored(spark, sf)).select("session", "call_seq", "action", "reason", "freed")


SQL["decide_actions"] = _DECIDE + " SELECT session, call_seq, action, reason, freed FROM decided"


@query
def decide_stats(spark, sf):
    return session_stats(decide(_scored(spark, sf)))


SQL["decide_stats"] = (
    _DECIDE
    + """ SELECT session, count(*) AS calls, count(*) FILTER (reason IN ('kept', 'budget', 'too small')) AS kept, count(*) FILTER (reason = 'result_dropped') AS results_dropped,
  count(*) FILTER (reason = 'call_dropped') AS calls_dropped, count(*) FILTER (reason IN ('pinned', 'unrepeatable')) AS pinned, CAST(sum(freed) AS BIGINT) AS freed FROM decided GROUP BY session"""
)


@query
def reason_counts(spark, sf):
    return decide(_scored(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"), F.sum("freed").alias("freed"))


SQL["reason_counts"] = _DECIDE + " SELECT reason, count(*) AS n, CAST(sum(freed) AS BIGINT) AS freed FROM decided GROUP BY reason"


@query
def cap_sweep(spark, sf):
    return simulate.cap_sweep(_calls(spark, sf), [300, 1000, 4000, 12_000, 24_000]).select(F.col("cap").cast("long").alias("cap"), "capped_calls", "kept_chars", "freed_chars")


SQL["cap_sweep"] = (
    _CALLS
    + f", cut AS (SELECT cap, result_chars, {_CUT.format(h='cap')} AS freed FROM calls, (SELECT unnest([300, 1000, 4000, 12000, 24000])::BIGINT AS cap)) SELECT cap, count(*) FILTER (freed <> 0) AS capped_calls, CAST(sum(result_chars - freed) AS BIGINT) AS kept_chars, CAST(sum(freed) AS BIGINT) AS freed_chars FROM cut GROUP BY cap"
)


@query
def per_tool_rates(spark, sf):
    f = facts.with_facts(_calls(spark, sf))
    return f.groupBy("tool", "is_error").agg(F.count("*").alias("n"), F.count_if("rerun_later").alias("rerun"), F.sum("result_chars").alias("chars"))


SQL["per_tool_rates"] = _FACTS + " SELECT tool, is_error, count(*) AS n, count(*) FILTER (rerun_later) AS rerun, CAST(sum(result_chars) AS BIGINT) AS chars FROM facts GROUP BY ALL"


@query
def trigger_points(spark, sf):
    return simulate.trigger_points(_calls(spark, sf), "result_chars", 0.62, ["call_seq"]).select("session", *long("point", "chars"))


SQL["trigger_points"] = (
    _CALLS
    + """, run AS (SELECT session, call_seq, sum(result_chars) OVER (PARTITION BY session ORDER BY call_seq) AS r, sum(result_chars) OVER (PARTITION BY session) AS t FROM calls)
SELECT session, min(call_seq) AS point, CAST(min_by(r, call_seq) AS BIGINT) AS chars FROM run WHERE r >= t * 0.62::DOUBLE GROUP BY session"""
)


@query
def tail_window(spark, sf):
    return simulate.tail_window(_calls(spark, sf), "result_chars", 60_000, ["call_seq"]).groupBy("session").agg(F.count("*").alias("kept"), F.min("call_seq").alias("first_kept"))


SQL["tail_window"] = (
    _CALLS
    + """, run AS (SELECT session, call_seq, coalesce(sum(result_chars) OVER (PARTITION BY session ORDER BY call_seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM calls)
SELECT session, count(*) AS kept, min(call_seq) AS first_kept FROM run WHERE b < 60000 GROUP BY session"""
)


@query
def pass_loop(spark, sf):
    rows = _scored(spark, sf).select("session", F.col("call_seq").alias("ord"), F.col("result_chars").alias("chars"), F.when(F.col("keep_result") < 0.2, F.col("result_chars")).otherwise(0).alias("droppable"))
    return simulate.pass_loop(rows, 20_000, 1_000)


# ---- steps, signals and costs over events


def _steps(spark, sf):
    return _calls(spark, sf).withColumn("step", F.concat_ws(":", "tool", F.when(F.col("is_error"), "failed")))


_STEPS = _CALLS + ", steps AS (SELECT *, CASE WHEN is_error THEN tool || ':failed' ELSE tool END AS step FROM calls)"


@query
def collapsed_steps(spark, sf):
    return mining.collapsed(_steps(spark, sf), ["session"], ["call_seq"]).groupBy("session", "step").agg(F.count("*").alias("runs"))


SQL["collapsed_steps"] = _STEPS + ", b AS (SELECT *, lag(step) OVER (PARTITION BY session ORDER BY call_seq) AS p FROM steps) SELECT session, step, count(*) AS runs FROM b WHERE p IS DISTINCT FROM step GROUP BY ALL"


@query
def step_3grams(spark, sf):
    return mining.sliding_sequences(_steps(spark, sf), ["session"], ["call_seq"], "call_seq").groupBy("sequence").agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"))


SQL["step_3grams"] = (
    _STEPS
    + """, b AS (SELECT session, step, lag(step) OVER w AS p, lag(step, 2) OVER w AS q FROM steps WINDOW w AS (PARTITION BY session ORDER BY call_seq))
SELECT q || ' → ' || p || ' → ' || step AS sequence, count(*) AS n, count(DISTINCT session) AS sessions FROM b WHERE q IS NOT NULL AND NOT (q = p AND p = step) GROUP BY 1"""
)


@query
def orient_verify(spark, sf):
    s = _steps(spark, sf).withColumn("batch", F.date_trunc("day", "ts"))
    return mining.first_and_last_batch(s, ["session"], ["call_seq"], "batch")


SQL["orient_verify"] = (
    _STEPS
    + """, b AS (SELECT session, date_trunc('day', ts) AS batch, min(call_seq) AS pos, string_agg(step, ' → ' ORDER BY call_seq) AS q FROM steps GROUP BY ALL)
SELECT session, min_by(q, pos) AS orient, max_by(q, pos) AS verify FROM b GROUP BY session"""
)


@query
def prompt_segments(spark, sf):
    return mining.segments(_steps(spark, sf), ["session"], ["call_seq"], F.col("tool") == "AskUserQuestion").select("session", *long("segment"), "flow", *long("n_steps"))


SQL["prompt_segments"] = (
    _STEPS
    + """, m AS (SELECT *, sum(CASE WHEN tool = 'AskUserQuestion' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY call_seq) AS segment FROM steps),
b AS (SELECT *, lag(step) OVER (PARTITION BY session, segment ORDER BY call_seq) AS p FROM m WHERE tool <> 'AskUserQuestion')
SELECT session, CAST(segment AS BIGINT) AS segment, string_agg(step, ' → ' ORDER BY call_seq) AS flow, count(*) AS n_steps FROM b WHERE p IS DISTINCT FROM step GROUP BY session, segment HAVING count(*) > 1"""
)


@query
def error_fix(spark, sf):
    c = _calls(spark, sf).filter(F.col("tool") == "Bash").withColumn("sig", F.col("target"))
    return recorder.error_fixes(c, ["call_seq"])


SQL["error_fix"] = _CALLS + ", b AS (SELECT session, target AS sig, call_seq, is_error, lag(is_error) OVER (PARTITION BY session, target ORDER BY call_seq) AS p FROM calls WHERE tool = 'Bash') SELECT session, sig, call_seq FROM b WHERE p AND NOT is_error"


def _signals(spark, sf):
    return _calls(spark, sf).select(F.col("tool").alias("kind"), F.col("target").alias("sig"), F.lit(1).cast("long").alias("calls"), F.col("result_chars").alias("chars"), F.col("session").cast("string").alias("session"), F.concat_ws(" ", "tool", "result_chars").alias("sample"), F.col("event_id").cast("long").alias("at"))


@query
def signal_counters(spark, sf):
    c = recorder.counted(_signals(spark, sf))
    return c.select("kind", "sig", "n", "calls", "chars", F.array_join("sessions", ",").alias("sessions"), F.array_join("samples", "|").alias("samples"), "last_seen")


SQL["signal_counters"] = (
    _CALLS
    + """, f AS (SELECT tool AS kind, target AS sig, CAST(session AS VARCHAR) AS s, min(event_id) AS first FROM calls GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY kind, sig ORDER BY first, s) AS k FROM f),
l AS (SELECT kind, sig, string_agg(s, ',' ORDER BY k) AS sessions FROM p WHERE k <= 50 GROUP BY ALL),
f2 AS (SELECT tool AS kind, target AS sig, tool || ' ' || result_chars AS s, min(event_id) AS first FROM calls GROUP BY ALL),
p2 AS (SELECT *, row_number() OVER (PARTITION BY kind, sig ORDER BY first, s) AS k FROM f2),
l2 AS (SELECT kind, sig, string_agg(s, '|' ORDER BY k) AS samples FROM p2 WHERE k <= 3 GROUP BY ALL)
SELECT c.tool AS kind, c.target AS sig, count(*) AS n, count(*) AS calls, CAST(sum(c.result_chars) AS BIGINT) AS chars, any_value(l.sessions) AS sessions, any_value(l2.samples) AS samples, CAST(max(c.event_id) AS BIGINT) AS last_seen
FROM calls c JOIN l ON l.kind = c.tool AND l.sig = c.target JOIN l2 ON l2.kind = c.tool AND l2.sig = c.target GROUP BY c.tool, c.target"""
)


@query
def fair_prune(spark, sf):
    c = _signals(spark, sf).groupBy("kind", "sig").agg(F.count("*").alias("n"), F.max("at").alias("last_seen"), F.min("at").alias("first_seen"))
    return recorder.fair_prune(c, 120, "first_seen")


SQL["fair_prune"] = (
    _CALLS
    + """, c AS (SELECT tool AS kind, target AS sig, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last_seen, CAST(min(event_id) AS BIGINT) AS first_seen FROM calls GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, last_seen DESC, sig) AS p, min(first_seen) OVER (PARTITION BY kind) AS first FROM c)
SELECT kind, sig, n, last_seen, first_seen FROM r ORDER BY p, first, kind LIMIT 120"""
)


@query
def proposals(spark, sf):
    return recorder.proposals(recorder.counted(_signals(spark, sf)), 3, 2).select(*long("rank"), "kind", "sig", "n", *long("n_sessions"), F.round("saved", 6).alias("saved"))


SQL["proposals"] = (
    _CALLS
    + """, p AS (SELECT tool AS kind, target AS sig, count(*) AS n, least(50, count(DISTINCT session)) AS n_sessions, round(count(*) * (1 + sum(result_chars) / count(*) / 1000), 6) AS saved FROM calls GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT session) >= 2)
SELECT row_number() OVER (ORDER BY saved DESC, n DESC, kind, sig) AS rank, * FROM p"""
)


@query
def shape_repeats(spark, sf):
    c = _calls(spark, sf).withColumn("seconds", F.col("result_chars") / 100.0)
    return costs.repeated_shapes(c, "target", "seconds", "session").select("target", "n", "sessions", F.round("seconds", 4).alias("seconds"))


SQL["shape_repeats"] = _CALLS + " SELECT target, count(*) AS n, count(DISTINCT session) AS sessions, round(sum(least(result_chars / 100.0, 120.0)), 4)::DOUBLE AS seconds FROM calls GROUP BY target HAVING count(*) >= 2 AND count(DISTINCT session) >= 2"


@query
def reread_targets(spark, sf):
    return costs.rereads(_calls(spark, sf).filter(F.col("tool") == "Read"), "target", "result_chars")


SQL["reread_targets"] = _CALLS + " SELECT target, count(*) AS reads, CAST(sum(result_chars) AS BIGINT) AS chars, CAST(sum(result_chars) - max(result_chars) AS BIGINT) AS repeated_chars FROM calls WHERE tool = 'Read' GROUP BY target"


@query
def gate_totals(spark, sf):
    return costs.gate_totals(_calls(spark, sf), "result_chars").select("gate", "n", *long("seconds"))


SQL["gate_totals"] = _CALLS + " SELECT CASE WHEN tool = 'AskUserQuestion' THEN 'human' ELSE 'machine' END AS gate, count(*) AS n, CAST(sum(result_chars) AS BIGINT) AS seconds FROM calls GROUP BY 1"


@query
def payoff_split(spark, sf):
    c = _calls(spark, sf)
    early = costs.halves(c, "ts", "session")
    return costs.payoff(c, early, "session", ["tool", "target"])


SQL["payoff_split"] = (
    _CALLS
    + """, f AS (SELECT session, min(ts) AS first FROM calls GROUP BY session), h AS (SELECT session, row_number() OVER (ORDER BY first, session) <= ceil((SELECT count(*) FROM f) / 2) AS early FROM f),
a AS (SELECT tool, target, count(*) AS early_n FROM calls JOIN h USING (session) WHERE early GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT session) >= 2),
b AS (SELECT tool, target, count(*) AS late_n FROM calls JOIN h USING (session) WHERE NOT early GROUP BY ALL)
SELECT tool, target, early_n, coalesce(late_n, 0) AS late_n FROM a LEFT JOIN b USING (tool, target)"""
)


@query
def quantile_defs(spark, sf):
    return metrics.quantiles(_calls(spark, sf), "result_chars").select(*long("upper"), "middle", *long("lower"))


SQL["quantile_defs"] = _CALLS + ", s AS (SELECT list(result_chars ORDER BY result_chars) AS v, count(*) AS n FROM calls) SELECT v[CAST(floor(n / 2) AS BIGINT) + 1] AS upper, (v[CAST(floor((n - 1) / 2) AS BIGINT) + 1] + v[CAST(ceil((n - 1) / 2) AS BIGINT) + 1]) / 2.0::DOUBLE AS middle, v[CAST(floor((n - 1) / 2) AS BIGINT) + 1] AS lower FROM s"


# ---- labels: metrics and policies


def _labels(spark, sf):
    return scored_labels(table(spark, sf, "label_rows"))


_LABELS = """WITH l AS (SELECT session, tool_use_id, max_by(struct_pack(tool := tool, output_chars := output_chars, is_error := is_error, call_needed := call_needed, result_needed := result_needed, evidence := evidence, result_index := result_index, first_reuse_index := first_reuse_index),
  struct_pack(a := labeled_at, b := output_chars, c := match_shingles, d := tool, e := evidence, f := result_index, g := first_reuse_index, h := messages)) AS r FROM label_rows WHERE session IS NOT NULL AND tool_use_id IS NOT NULL GROUP BY ALL),
labels AS (SELECT session, tool_use_id, r.*, round(r.output_chars / (r.output_chars + 1000.0::DOUBLE), 6) AS score FROM l)"""


@query
def label_totals(spark, sf):
    return _labels(spark, sf).groupBy("tool").agg(F.count("*").alias("n"), F.count_if("result_needed").alias("results"), F.count_if("call_needed").alias("calls"), F.sum("output_chars").alias("chars"))


SQL["label_totals"] = _LABELS + " SELECT tool, count(*) AS n, count(*) FILTER (result_needed) AS results, count(*) FILTER (call_needed) AS calls, CAST(sum(output_chars) AS BIGINT) AS chars FROM labels GROUP BY tool"


@query
def auc_score(spark, sf):
    return metrics.auc(_labels(spark, sf), "score", "result_needed").select(F.round("auc", 9).alias("auc"), "positives", "n")


SQL["auc_score"] = (
    _LABELS
    + """, g AS (SELECT score, count(*) AS n, count(*) FILTER (result_needed) AS pos FROM labels GROUP BY score), b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
s AS (SELECT sum(pos * (below + (n + 1) / 2))::DOUBLE AS ranks, CAST(sum(pos) AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS n FROM b) SELECT round((ranks - p * (p + 1) / 2) / (p * (n - p)), 9) AS auc, p AS positives, n FROM s"""
)


@query
def ece_bins(spark, sf):
    b = metrics.calibration_bins(_labels(spark, sf), "score", "result_needed")
    return b.select(*long("bin", "n"), F.round("confidence", 9).alias("confidence"), F.round("accuracy", 9).alias("accuracy"))


SQL["ece_bins"] = _LABELS + " SELECT CAST(least(14, floor(score * 15)) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 9) AS confidence, round(avg(result_needed::INT), 9) AS accuracy FROM labels GROUP BY 1"


@query
def ece_total(spark, sf):
    return metrics.ece(_labels(spark, sf), "score", "result_needed").select(F.round("ece", 9).alias("ece"))


SQL["ece_total"] = _LABELS + ", b AS (SELECT least(14, floor(score * 15)) AS bin, count(*) AS n, avg(score) AS c, avg(result_needed::INT) AS a FROM labels GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM b"


@query
def droppable_at(spark, sf):
    return metrics.droppable_at(_labels(spark, sf), "score", "result_needed", "output_chars", 0.9).select("threshold", *long("dropped_chars", "total_chars", "wrong_drops"))


SQL["droppable_at"] = (
    _LABELS
    + """, g AS (SELECT score, count(*) FILTER (result_needed) AS pos, sum(output_chars) AS c FROM labels GROUP BY score),
b AS (SELECT score, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(c) OVER w, 0) AS cb FROM g WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), t AS (SELECT sum(pos) AS p, sum(c) AS total FROM g)
SELECT threshold, CAST(dropped AS BIGINT) AS dropped_chars, CAST(total AS BIGINT) AS total_chars, CAST(wrong AS BIGINT) AS wrong_drops FROM
  (SELECT score AS threshold, cb AS dropped, pb AS wrong, total FROM b, t WHERE cb > 0 AND (p = 0 OR (p - pb) / p >= 0.9) UNION ALL SELECT 1.0::DOUBLE, 0, p, total FROM t) ORDER BY dropped DESC, threshold LIMIT 1"""
)


@query
def freed_grid(spark, sf):
    return metrics.freed_at_retention(_labels(spark, sf), "score", "result_needed", "output_chars", 0.85).select(F.round("threshold", 6).alias("threshold"), *long("freed_chars"))


SQL["freed_grid"] = (
    _LABELS
    + """, k AS (SELECT least(100, floor(score * 100 + 1e-9)) AS k, count(*) FILTER (result_needed) AS pos, sum(output_chars) AS c FROM labels GROUP BY 1), g AS (SELECT unnest(range(101)) AS k),
r AS (SELECT g.k, coalesce(sum(pos) OVER w, 0) AS wrong, coalesce(sum(c) OVER w, 0) AS freed FROM g LEFT JOIN k USING (k) WINDOW w AS (ORDER BY g.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), t AS (SELECT sum(pos) AS p FROM k)
SELECT round(k / 100, 6) AS threshold, CAST(freed AS BIGINT) AS freed_chars FROM r, t WHERE p = 0 OR (p - wrong) / p >= 0.85 ORDER BY freed DESC, k LIMIT 1"""
)


@query
def pearson_size(spark, sf):
    held = _labels(spark, sf).select("output_chars", F.col("result_needed").cast("int").alias("y"))
    return metrics.pearson(held, "output_chars", "y").select(F.round("pearson", 9).alias("pearson"))


SQL["pearson_size"] = _LABELS + " SELECT round(corr(output_chars, result_needed::INT), 9) AS pearson FROM labels"


@query
def policy_totals(spark, sf):
    out = simulate.policy_totals(simulate.budget_drops(_labels(spark, sf)))
    return out.select(*long(*out.columns))


_DROPPED = (
    _LABELS
    + """, b AS (SELECT *, score < 0.2 AS low FROM labels), d AS (SELECT *, low AND coalesce(sum(CASE WHEN low THEN output_chars ELSE 0 END) OVER (PARTITION BY session ORDER BY low DESC, score, tool_use_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2
  < sum(CASE WHEN low THEN output_chars ELSE 0 END) OVER (PARTITION BY session) AS dropped FROM b)"""
)
SQL["policy_totals"] = (
    _DROPPED
    + """ SELECT count(*) AS calls, count(*) FILTER (result_needed) AS needed, CAST(sum(output_chars) AS BIGINT) AS total, CAST(sum(CASE WHEN dropped THEN output_chars ELSE 0 END) AS BIGINT) AS freed, count(*) FILTER (dropped) AS n_dropped,
count(*) FILTER (dropped AND result_needed) AS wrong, count(*) FILTER (dropped AND result_needed AND score >= 0.2) AS wrong_with_head, CAST(sum(CASE WHEN result_needed AND NOT dropped THEN output_chars WHEN result_needed AND score >= 0.2 THEN least(300, output_chars) ELSE 0 END) AS BIGINT) AS needed_chars_kept,
CAST(sum(CASE WHEN result_needed THEN output_chars ELSE 0 END) AS BIGINT) AS needed_chars FROM d"""
)


@query
def loss_ledger(spark, sf):
    return simulate.loss_ledger(simulate.budget_drops(_labels(spark, sf)))


SQL["loss_ledger"] = _DROPPED + " SELECT 'tool' AS \"by\", tool AS \"value\", count(*) AS n, CAST(sum(output_chars) AS BIGINT) AS chars FROM d WHERE dropped AND result_needed GROUP BY tool UNION ALL SELECT 'evidence', evidence, count(*), CAST(sum(output_chars) AS BIGINT) FROM d WHERE dropped AND result_needed GROUP BY evidence"


@query
def oracle_gap(spark, sf):
    return simulate.oracle_gap(_labels(spark, sf))


SQL["oracle_gap"] = _LABELS + " SELECT CAST(sum(output_chars) AS BIGINT) AS total, CAST(sum(CASE WHEN NOT result_needed THEN output_chars ELSE 0 END) AS BIGINT) AS unneeded, count(*) FILTER (NOT result_needed) AS unneeded_calls FROM labels"


@query
def operating_points(spark, sf):
    out = simulate.threshold_sweep(_labels(spark, sf), [k / 20 for k in range(1, 20)])
    return out.select("threshold", "freed_chars", "wrong_drops", "kept_needed", "dominated")


SQL["operating_points"] = (
    _LABELS
    + """, p AS (SELECT t / 20::DOUBLE AS threshold, CAST(sum(CASE WHEN score < t / 20::DOUBLE THEN output_chars ELSE 0 END) AS BIGINT) AS freed_chars, count(*) FILTER (score < t / 20::DOUBLE AND result_needed) AS wrong_drops, count(*) FILTER (score >= t / 20::DOUBLE AND result_needed) AS kept_needed FROM labels, (SELECT unnest(range(1, 20)) AS t) GROUP BY 1)
SELECT *, EXISTS (FROM p AS q WHERE q.freed_chars >= p.freed_chars AND q.wrong_drops <= p.wrong_drops AND (q.freed_chars > p.freed_chars OR q.wrong_drops < p.wrong_drops)) AS dominated FROM p"""
)


@query
def recency_baseline(spark, sf):
    """Dropping the oldest outputs first, until as much is freed as by the scores under 0.2."""
    held = _labels(spark, sf)
    freed = held.agg(F.sum(F.when(F.col("score") < 0.2, F.col("output_chars")).otherwise(0)).alias("f")).first().f or 0
    return simulate.matched_baseline(held.fillna(-1, ["result_index"]), ["result_index", "session", "tool_use_id"], freed)


SQL["recency_baseline"] = (
    _LABELS
    + """, f AS (SELECT sum(CASE WHEN score < 0.2 THEN output_chars ELSE 0 END) AS target FROM labels), b AS (SELECT *, coalesce(sum(output_chars) OVER (ORDER BY coalesce(result_index, -1), session, tool_use_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM labels)
SELECT count(*) AS dropped, CAST(sum(output_chars) AS BIGINT) AS freed_chars, count(*) FILTER (result_needed) AS wrong_drops FROM b, f WHERE before < target"""
)


@query
def error_policy(spark, sf):
    return simulate.error_policies(_labels(spark, sf), [0.0, 0.1, 0.2, 0.3], 0.2)


SQL["error_policy"] = _LABELS + """, grid AS (SELECT * FROM (SELECT unnest([0.0::DOUBLE, 0.1, 0.2, 0.3]) AS penalty), (SELECT unnest([false, true]) AS hard)),
e AS (SELECT grid.*, output_chars, result_needed, (score - CASE WHEN is_error THEN penalty ELSE 0 END < 0.2) OR (hard AND coalesce(is_error, false)) AS low FROM labels, grid)
SELECT penalty, hard, count(*) FILTER (low) AS dropped, CAST(sum(CASE WHEN low THEN output_chars ELSE 0 END) AS BIGINT) AS freed_chars, count(*) FILTER (low AND result_needed) AS wrong_drops FROM e GROUP BY ALL"""


@query
def head_tail_sweep(spark, sf):
    return simulate.head_tail_sweep(_calls(spark, sf), [2_000, 8_000, 24_000], [0.0, 0.25, 0.5])


SQL["head_tail_sweep"] = _CALLS + """, grid AS (SELECT * FROM (SELECT unnest([2000::BIGINT, 8000, 24000]) AS cap), (SELECT unnest([0.0::DOUBLE, 0.25, 0.5]) AS tail_share)), e AS (SELECT *, CAST(floor(cap * tail_share) AS BIGINT) AS tail FROM calls, grid)
SELECT cap, tail_share, count(*) FILTER (result_chars > cap) AS capped_calls, CAST(sum(CASE WHEN result_chars > cap THEN cap - tail ELSE 0 END) AS BIGINT) AS head_chars, CAST(sum(CASE WHEN result_chars > cap THEN tail ELSE 0 END) AS BIGINT) AS tail_chars, CAST(sum(CASE WHEN result_chars > cap THEN result_chars - cap ELSE 0 END) AS BIGINT) AS freed_chars FROM e GROUP BY ALL"""


@query
def cost_aware(spark, sf):
    return simulate.cost_aware(_labels(spark, sf), [k / 10 for k in range(1, 10)])


SQL["cost_aware"] = _LABELS + """, m AS (SELECT output_chars AS median FROM labels ORDER BY output_chars LIMIT 1 OFFSET (SELECT count(*) // 2 FROM labels)), e AS (SELECT t / 10::DOUBLE AS threshold, *, score >= t / 10::DOUBLE OR output_chars <= median AS keep FROM labels, m, (SELECT unnest(range(1, 10)) AS t))
SELECT threshold, count(*) FILTER (keep) AS kept, CAST(sum(CASE WHEN keep THEN 0 ELSE output_chars END) AS BIGINT) AS freed_chars, count(*) FILTER (keep AND result_needed) AS kept_needed FROM e GROUP BY ALL"""


@query
def reuse_targets(spark, sf):
    return simulate.reuse_targets(_labels(spark, sf), [10, 25, 50])


SQL["reuse_targets"] = _LABELS + """, e AS (SELECT within, output_chars, coalesce(result_needed AND first_reuse_index >= 0 AND first_reuse_index - result_index <= within, false) AS soon FROM labels, (SELECT unnest([10, 25, 50]) AS within))
SELECT within, count(*) FILTER (soon) AS positives, count(*) FILTER (NOT soon) AS negatives, CAST(sum(CASE WHEN soon THEN output_chars ELSE 0 END) AS BIGINT) AS positive_chars FROM e GROUP BY within"""


@query
def repeated_splits(spark, sf):
    found = metrics.grouped_splits(_labels(spark, sf), "session", "score", "result_needed")
    return found.select("split", "sessions", "n", "positives", F.round("auc", 9).alias("auc"))


SQL["repeated_splits"] = _LABELS + """, h AS (SELECT split, session, score, result_needed FROM labels, (SELECT unnest(range(0, 10)) AS split) WHERE CAST('0x' || substr(md5(session || ':' || split), 1, 8) AS BIGINT) % 100 < 30),
g AS (SELECT split, score, count(*) AS n, count(*) FILTER (result_needed) AS pos FROM h GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
s AS (SELECT split, sum(pos * (below + (n + 1) / 2))::DOUBLE AS r, CAST(sum(pos) AS BIGINT) AS p, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY split), c AS (SELECT split, count(DISTINCT session) AS sessions FROM h GROUP BY split)
SELECT CAST(split AS INTEGER) AS split, sessions, n, p AS positives, CASE WHEN p > 0 AND p < n THEN round((r - p * (p + 1) / 2) / (p * (n - p)), 9) END AS auc FROM s JOIN c USING (split)"""


@query
def rule_baselines(spark, sf):
    """How well plain rules rank what is needed: size alone, recency alone, and success alone."""
    held = _labels(spark, sf)
    rules = {"size": F.col("output_chars").cast("double"), "recency": F.coalesce(F.col("result_index"), F.lit(-1)).cast("double"), "success": F.when(F.col("is_error"), 0.0).otherwise(1.0)}
    each = [metrics.auc(held.withColumn("rule", v), "rule", "result_needed").select(F.lit(n).alias("rule"), F.round("auc", 9).alias("auc")) for n, v in rules.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


SQL["rule_baselines"] = _LABELS + """, e AS (SELECT unnest([{'rule': 'size', 's': output_chars::DOUBLE}, {'rule': 'recency', 's': coalesce(result_index, -1)::DOUBLE}, {'rule': 'success', 's': CASE WHEN is_error THEN 0.0 ELSE 1.0 END::DOUBLE}]) AS x, result_needed FROM labels),
g AS (SELECT x.rule AS rule, x.s AS s, count(*) AS n, count(*) FILTER (result_needed) AS pos FROM e GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY rule ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
t AS (SELECT rule, sum(pos * (below + (n + 1) / 2))::DOUBLE AS r, sum(pos) AS p, sum(n) AS n FROM b GROUP BY rule) SELECT rule, round((r - p * (p + 1) / 2) / (p * (n - p)), 9)::DOUBLE AS auc FROM t"""


@query
def raw_messages(spark, sf):
    """Raw lines of the transcript dialect as messages, counted per session."""
    found = tr.messages(table(spark, sf, "raw_lines").dropDuplicates(["raw_id"]))
    return found.groupBy("session").agg(
        F.count("*").alias("messages"), F.sum(F.size("tool_uses")).cast("long").alias("calls"), F.sum(F.size("tool_results")).cast("long").alias("results"), F.sum(text.units(F.col("text"))).alias("chars")
    )


@query
def reuse_distance(spark, sf):
    d = _labels(spark, sf).filter(F.col("result_needed") & (F.col("first_reuse_index") >= 0)).withColumn("d", F.col("first_reuse_index") - F.col("result_index"))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("d") <= 6).alias("near"), F.count_if(F.col("d") > 50).alias("far"), F.sum("d").cast("long").alias("total"))


SQL["reuse_distance"] = _LABELS + ", d AS (SELECT first_reuse_index - result_index AS d FROM labels WHERE result_needed AND first_reuse_index >= 0) SELECT count(*) AS n, count(*) FILTER (d <= 6) AS near, count(*) FILTER (d > 50) AS far, CAST(sum(d) AS BIGINT) AS total FROM d"


def _vector(df: DataFrame) -> DataFrame:
    x = [F.lit(1.0), F.log1p("output_chars"), F.col("is_error").cast("double"), *((F.col("tool") == t).cast("double") for t in ("Read", "Bash", "Edit"))]
    return df.withColumn("x", F.array(*(F.coalesce(v, F.lit(0.0)) for v in x)))


@query
def left_out_scores(spark, sf):
    held = _vector(_labels(spark, sf).dropna(subset=["output_chars", "result_needed"]))
    return models.left_out_scores(held, "x", "result_needed", ["session", "tool_use_id"], standardise=True, steps=300).select("session", "tool_use_id", "result_needed", F.round("p", 6).alias("p"))


@query
def conformal_floors(spark, sf):
    return models.conformal_floors(_labels(spark, sf), "score", "result_needed", 0.1, finite=True)


@query
def temperature_fit(spark, sf):
    return metrics.fit_temperature(_labels(spark, sf).filter((F.col("score") > 0) & (F.col("score") < 1)), "score", "result_needed")


@query
def bootstrap_needed(spark, sf):
    held = _labels(spark, sf).withColumn("needed", F.when(F.col("result_needed"), F.col("output_chars")).otherwise(0))
    return metrics.bootstrap_ratio(held, "session", "needed", "output_chars", 100)


# ---- documents: text functions and retrieval


@query
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


SQL["token_estimate"] = r"""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s\x{A0}\x{0B}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]') AS pieces FROM documents),
c AS (SELECT doc_id, list_prepend(0.0::DOUBLE, list_transform(pieces, lambda x: CASE WHEN x[1] BETWEEN '0' AND '9' THEN length(x) / 2.0::DOUBLE WHEN x[1] BETWEEN 'A' AND 'Z' OR x[1] BETWEEN 'a' AND 'z' THEN (1 + (length(x) - 1) // 6)::DOUBLE
  WHEN unicode(x) > 65535 THEN 3.5::DOUBLE WHEN unicode(x) BETWEEN 12352 AND 40959 OR unicode(x) BETWEEN 44032 AND 55215 OR unicode(x) BETWEEN 63744 AND 64255 THEN 1.75::DOUBLE WHEN unicode(x) > 127 THEN 1.1::DOUBLE ELSE 0.9::DOUBLE END)) AS costs FROM p)
SELECT doc_id, CAST(ceil(list_reduce(costs, lambda a, b: a + b)) AS BIGINT) AS tokens FROM c"""


@query
def intent_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", signatures.intent_signature(F.col("text")).alias("intent"), signatures.is_correction(F.col("text")).alias("correction"))


SQL["intent_words"] = (
    "SELECT doc_id, array_to_string(list_sort(list_slice(list_filter(f, lambda w, i: list_position(f, w) = i), 1, 4)), ' ') AS intent, coalesce(len(list_filter(["
    + ", ".join("'" + c.replace("'", "''") + "'" for c in signatures.CORRECTIONS)
    + "], lambda c: starts_with(substring(lower(trim(text, ' ')), 1, 40), c))) > 0, false) AS correction FROM (SELECT doc_id, text, list_filter(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '(?s)```.*?```', ' ', 'g'), '[a-z][a-z0-9-]{2,}'), lambda w: w NOT IN ("
    + ", ".join(f"'{w}'" for w in signatures.STOPWORDS)
    + ")) AS f FROM documents)"
)


@query
def redacted_texts(spark, sf):
    """Texts of all rows in which something is redacted."""
    blocks = table(spark, sf, "subagent").dropDuplicates(["row_id"]).select("row_id", F.posexplode("message.content").alias("block_no", "b"))
    parts = F.array(F.col("b.text"), F.col("b.content"), F.array_join(F.transform("b.items", lambda i: i["text"]), "\n"))
    each = blocks.select("row_id", "block_no", F.posexplode(parts).alias("part", "text")).filter(F.length("text") > 0)
    return each.withColumn("redacted", signatures.redact(F.col("text"))).filter(F.col("text") != F.col("redacted")).select("row_id", "block_no", "part", "redacted")


@query
def encoded_shares(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(text.encoded_share(F.col("text")), 9).alias("share"))


SQL["encoded_shares"] = "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9+/=]{40,}'), lambda r: length(r))), 0) / length(text) ELSE 0 END, 9)::DOUBLE AS share FROM documents"


@query
def sentence_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"))


SQL["sentence_counts"] = r"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda s: len(string_split_regex(trim(s, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)), '\s+')) >= 3))::INTEGER AS sentences FROM documents"""


@query
def shingle_owners(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(text.shingles(F.col("text"), 8))).alias("shingle"))
    return d.groupBy("shingle").agg(F.count("*").alias("owners")).filter(F.col("owners") > 1)


SQL["shingle_owners"] = "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_./-]+') AS w FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 7], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)) SELECT shingle, count(*) AS owners FROM s GROUP BY shingle HAVING count(*) > 1"


@query
def document_novelty(spark, sf):
    n = retrieval.novelty(table(spark, sf, "documents").filter(F.col("source").isNotNull()), "doc_id", ["created_at"], "text", "source")
    return n.select("doc_id", "words", F.round("novelty", 9).alias("novelty"))


SQL["document_novelty"] = (
    "WITH t AS (SELECT DISTINCT doc_id, created_at, source, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS token FROM documents WHERE source IS NOT NULL), r AS (SELECT doc_id, row_number() OVER (PARTITION BY source, token ORDER BY created_at NULLS FIRST, doc_id) = 1 AS fresh FROM t) SELECT doc_id, count(*) AS words, round(avg(fresh::INT), 9) AS novelty FROM r GROUP BY doc_id"
)


@query
def idf_terms(spark, sf):
    i = retrieval.inverse_frequencies(retrieval.terms(table(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    return i.select("term", "df", F.round("idf", 9).alias("idf"))


_POSTINGS = "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') AS w FROM documents), p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM p), idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p GROUP BY term)"
SQL["idf_terms"] = _POSTINGS + " SELECT term, df, round(idf, 9) AS idf FROM idf"


@query
def bm25_top5(spark, sf):
    asked = table(spark, sf, "flow_discovery").filter(F.col("intent").isNotNull()).select(F.col("intent").alias("query"), F.explode(text.words(F.col("intent"), "[a-z0-9]{2,}")).alias("term"))
    ranked = retrieval.bm25(retrieval.terms(table(spark, sf, "documents"), "doc_id", "text"), asked, "doc_id", "query", 5)
    return ranked.select("query", *long("rank"), "doc_id", F.round("score", 6).alias("score"))


SQL["bm25_top5"] = (
    _POSTINGS
    + """, q AS (SELECT DISTINCT intent AS query, unnest(regexp_extract_all(lower(intent), '[a-z0-9]{2,}')) AS term FROM flow_discovery WHERE intent IS NOT NULL), m AS (SELECT avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM p)),
s AS (SELECT query, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN p USING (term) JOIN idf USING (term), m GROUP BY ALL),
r AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT query, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 5"""
)

# ---- transcripts


def _messages(spark, sf):
    return tr.messages_of_rows(table(spark, sf, "subagent"))


def _transcript_calls(spark, sf):
    c = pairing.paired_calls(_messages(spark, sf)).withColumn("target", facts.target())
    return facts.with_facts(c)


_ROWS = """WITH d AS (SELECT DISTINCT ON (row_id) row_id, session, line_no, lower(trim(type)) AS role, coalesce(issidechain, false) AS side, coalesce(message.content, []) AS content FROM subagent WHERE lower(trim(type)) IN ('user', 'assistant') AND session IS NOT NULL),
k AS (SELECT *, bool_or(NOT side) OVER (PARTITION BY session) AS has_main FROM d), m AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY line_no, row_id) - 1 AS msg_idx, count(*) OVER (PARTITION BY session) AS total FROM k WHERE NOT side OR NOT has_main),
b AS (SELECT session, msg_idx, total, pos, content[pos] AS b FROM (SELECT session, msg_idx, total, content, unnest(range(1, len(content) + 1)) AS pos FROM m)),
u AS (SELECT session, msg_idx, total, pos, b.id AS tool_use_id, b.name AS tool, b.input AS input FROM b WHERE b.type = 'tool_use'),
r AS (SELECT session, msg_idx, pos, b.tool_use_id AS tool_use_id, coalesce(b.content, array_to_string(list_transform(list_filter(coalesce(b.items, []), lambda i: i.type = 'text'), lambda i: i.text), chr(10))) AS text, coalesce(b.is_error, false) AS is_error FROM b WHERE b.type = 'tool_result'),
l AS (SELECT session, tool_use_id, max_by(struct_pack(msg_idx := msg_idx, text := text, is_error := is_error), struct_pack(a := msg_idx, b := pos)) AS r FROM r GROUP BY ALL),
c AS (SELECT u.session, row_number() OVER (PARTITION BY u.session ORDER BY u.msg_idx, u.pos) AS call_seq, u.tool_use_id, u.tool, u.msg_idx AS call_index, l.r.msg_idx AS result_index, length(l.r.text) AS result_chars, l.r.is_error AS is_error, u.total FROM u JOIN l ON l.session = u.session AND l.tool_use_id = u.tool_use_id)"""


@query
def paired_calls(spark, sf):
    c = pairing.paired_calls(_messages(spark, sf))
    return c.select("session", *long("call_seq"), "tool_use_id", "tool", *long("call_index", "result_index", "result_chars"), "is_error", "pinned")


SQL["paired_calls"] = _ROWS + " SELECT session, call_seq, tool_use_id, tool, call_index, result_index, CAST(result_chars AS BIGINT) AS result_chars, is_error, (call_index = 0 OR result_index = 0 OR call_index >= total - 6 OR result_index >= total - 6) AS pinned FROM c"


@query
def orphan_blocks(spark, sf):
    return pairing.orphans(_messages(spark, sf))


SQL["orphan_blocks"] = _ROWS + " SELECT session, tool_use_id, 'call' AS side FROM u WHERE NOT EXISTS (FROM r WHERE r.session = u.session AND r.tool_use_id = u.tool_use_id) UNION ALL SELECT session, tool_use_id, 'result' FROM r WHERE NOT EXISTS (FROM u WHERE r.session = u.session AND r.tool_use_id = u.tool_use_id)"


@query
def tool_mass(spark, sf):
    return pairing.result_owners(_messages(spark, sf)).groupBy("tool").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


SQL["tool_mass"] = _ROWS + ", o AS (SELECT session, tool_use_id, max(tool) AS tool FROM u GROUP BY ALL) SELECT coalesce(tool, 'unknown') AS tool, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM r LEFT JOIN o USING (session, tool_use_id) GROUP BY 1"


@query
def session_goals(spark, sf):
    return pairing.goals(_messages(spark, sf))


SQL["session_goals"] = (
    _ROWS
    + r""", p AS (SELECT session, msg_idx, array_to_string(list_transform(list_filter(content, lambda b: b.type = 'text' AND b.text IS NOT NULL), lambda b: b.text), chr(10)) AS text FROM m WHERE role = 'user' AND len(list_filter(content, lambda b: b.type = 'tool_result')) = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY msg_idx DESC) AS back FROM p WHERE regexp_matches(text, '\S'))
SELECT session, string_agg(CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 499) || '…' END, chr(10) ORDER BY msg_idx) AS goal FROM g WHERE back <= 3 GROUP BY session"""
)


@query
def transcript_features(spark, sf):
    c = _transcript_calls(spark, sf)
    scored = scoring.built_in(digits=6)(c)
    return scored.select("session", "tool_use_id", "target", "age", "size", "target_touched_after", "rerun_later", "keep_result", "keep_call")


@query
def call_states(spark, sf):
    c = _transcript_calls(spark, sf).join(pairing.goals(_messages(spark, sf)), "session", "left")
    return scoring.with_state(c).select("session", "tool_use_id", "state", "state_tokens", "rung")


@query
def compaction_stats(spark, sf):
    return rebuild.compact(_messages(spark, sf))[2]


@query
def compacted_messages(spark, sf):
    return rebuild.compact(_messages(spark, sf))[0]


@query
def reuse_labels(spark, sf):
    return labels.labels(_messages(spark, sf), _transcript_calls(spark, sf))


@query
def command_shapes(spark, sf):
    c = pairing.bash_commands(_messages(spark, sf))
    return c.withColumn("shape", signatures.command_signature(F.col("command"))).groupBy("shape").agg(F.count("*").alias("n"), F.count_distinct("session").alias("sessions"))


def _usage(spark, sf):
    """Rows with usage, and the summaries that a compaction leaves as boundaries between them."""
    s = table(spark, sf, "subagent").filter(F.col("session").isNotNull()).dropDuplicates(["row_id"])
    boundary = F.coalesce(F.lower(F.trim("type")) == "summary", F.lit(False))
    return s.filter(F.col("message.usage").isNotNull() | boundary).select(
        "session", "line_no", "row_id", boundary.alias("is_boundary"), F.col("message.id").alias("message_id"), F.col("message.usage.cache_read_input_tokens").alias("cache_read"), F.col("message.usage.cache_creation_input_tokens").alias("cache_created")
    )


@query
def cache_segments(spark, sf):
    out = costs.cache_segments(_usage(spark, sf), "session", ["line_no", "row_id"])
    return out.select("session", *long("segment", "turns", "first_created", "last_read"))


_SEGMENTS = """WITH d AS (SELECT DISTINCT ON (row_id) row_id, session, line_no, coalesce(lower(trim(type)) = 'summary', false) AS b, message.id AS id, message.usage AS u FROM subagent WHERE session IS NOT NULL),
k AS (SELECT *, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment, row_number() OVER w AS o FROM d WHERE u IS NOT NULL OR b WINDOW w AS (PARTITION BY session ORDER BY line_no, row_id)),
t AS (SELECT *, lag(id) OVER (PARTITION BY session, segment ORDER BY o) AS p FROM k WHERE NOT b),
s AS (SELECT session, segment, count(*) AS turns, min_by(u.cache_creation_input_tokens, o) AS first_created, max_by(u.cache_read_input_tokens, o) AS last_read FROM t WHERE p IS NULL OR p IS DISTINCT FROM id GROUP BY session, segment)"""

SQL["cache_segments"] = _SEGMENTS + " SELECT session, segment, turns, first_created, last_read FROM s"


@query
def cache_breakeven(spark, sf):
    """Compactions: what each freed of the cache, what its first turn wrote anew, and the turns until that pays."""
    events = costs.cache_events(costs.cache_segments(_usage(spark, sf), "session", ["line_no", "row_id"]), "session")
    return events.select("session", *long("segment", "freed", "recached", "turns"), F.round(costs.breakeven_turns(F.col("freed"), F.col("recached")), 6).alias("breakeven"))


SQL["cache_breakeven"] = (
    _SEGMENTS
    + """, e AS (SELECT *, lag(last_read) OVER (PARTITION BY session ORDER BY segment) - last_read AS freed, lag(last_read) OVER (PARTITION BY session ORDER BY segment) IS NOT NULL AS known FROM s)
SELECT session, segment, freed, first_created AS recached, turns, CASE WHEN freed > 0 THEN round(first_created * 1.15 / (freed * 0.1), 6)::DOUBLE END AS breakeven FROM e WHERE known"""
)


@query
def foreign_outputs(spark, sf):
    return tr.foreign_outputs(table(spark, sf, "raw_lines").dropDuplicates(["raw_id"]))


SQL["foreign_outputs"] = """WITH d AS (SELECT DISTINCT ON (raw_id) session, line_no, line FROM raw_lines WHERE contains(line, 'response_item') AND json_valid(line)),
o AS (SELECT session, line_no, line ->> '$.payload.call_id' AS call_id, line ->> '$.payload.output' AS raw FROM d WHERE line ->> '$.type' = 'response_item' AND line ->> '$.payload.type' IN ('function_call_output', 'custom_tool_call_output')),
p AS (SELECT *, CASE WHEN json_valid(raw) THEN coalesce(raw ->> '$.output', raw) ELSE coalesce(raw, '') END AS output, CASE WHEN json_valid(raw) THEN TRY_CAST(raw ->> '$.metadata.exit_code' AS INT) END AS exit_code FROM o)
SELECT session, call_id, max_by(output, (line_no, output)) AS output, max_by(exit_code, (line_no, output)) AS exit_code FROM p GROUP BY ALL"""


# ---- flows


def _flows(spark, sf):
    """Flows once each, their steps in proper spelling, whatever separates them."""
    tools = toolnames.catalog(table(spark, sf, "tool_catalog"))

    @F.pandas_udf("string")
    def spelled(flows: pd.Series) -> pd.Series:
        return flows.map(lambda f: mining.ARROW.join(toolnames.flow_steps(f, tools)))

    return table(spark, sf, "flow_discovery").dropDuplicates(["flow_id"]).withColumn("flow", spelled("flow"))


@query
def intent_flows(spark, sf):
    f = _flows(spark, sf).filter(F.col("intent").isNotNull())
    return mining.best_flows(f, "intent", "flow", "session")


@query
def actionable_flows(spark, sf):
    f = _flows(spark, sf)
    return f.groupBy("flow").agg(F.count_distinct("session").alias("sessions")).filter(mining.is_actionable(F.col("flow")) & (F.col("sessions") > 1))


@query
def forward_closed_flows(spark, sf):
    s = _flows(spark, sf).select(F.split("flow", mining.ARROW).alias("steps"))
    return mining.forward_closed(s, 0.05, 3).select(F.array_join("pattern", mining.ARROW).alias("pattern"), "freq")


@query
def maximal_flows(spark, sf):
    s = _flows(spark, sf).select(F.split("flow", mining.ARROW).alias("steps"))
    return mining.maximal(mining.forward_closed(s, 0.05, 3), 3).select(F.array_join("pattern", mining.ARROW).alias("pattern"), "freq")

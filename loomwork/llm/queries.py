"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import credentials, mixing, mojibake, packing, rebuild, runs, spans, splits, subsequences
from loomwork.llm.toolnames import catalog
from loomwork.sources import table


def _tools(spark: SparkSession, sf: str):
    return catalog(table(spark, sf, "tool_catalog"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return runs.repeated_runs(table(spark, sf, "subagent"), _tools(spark, sf)).select("session", "side", "first_id", "last_id", "n_events").distinct()


def p1_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.tool_runs(table(spark, sf, "subagent"), _tools(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.linked_sessions(table(spark, sf, "label_rows"))


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_shares(table(spark, sf, "label_rows"), table(spark, sf, "split_targets"))


def p2_forest(spark: SparkSession, sf: str) -> DataFrame:
    return splits.session_forest(table(spark, sf, "label_rows"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return splits.session_groups(table(spark, sf, "label_rows"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.credentials(table(spark, sf, "subagent")).select("row_id", "block_no", "secret").distinct()


def p4_masked(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.masked_texts(table(spark, sf, "subagent"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_patterns(spark, sf).select("origin", "pattern")


def p5_patterns(spark: SparkSession, sf: str) -> DataFrame:
    found = subsequences.frequent_patterns(table(spark, sf, "subagent"), table(spark, sf, "flow_discovery"), _tools(spark, sf))
    return found.select("origin", "pattern", "support", "sequences")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_pairs(table(spark, sf, "subagent"))


def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_share(table(spark, sf, "subagent"))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    return spans.span_classes(table(spark, sf, "subagent"))


def p6_unrepeated(spark: SparkSession, sf: str) -> DataFrame:
    return spans.unrepeated(table(spark, sf, "subagent"))


def p6_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spans.shared_lines(table(spark, sf, "subagent"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return rebuild.dropped(table(spark, sf, "subagent")).select("session", "side")


def p7_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return rebuild.conversations(table(spark, sf, "subagent"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "pack_specs"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p8_containers(spark, sf), table(spark, sf, "pack_specs"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p8_least_cost(spark: SparkSession, sf: str) -> DataFrame:
    specs = table(spark, sf, "pack_specs")
    return packing.fill(packing.pack(table(spark, sf, "documents"), specs, nearly_full=0), specs)


def p9_short(spark: SparkSession, sf: str) -> DataFrame:
    """Shares reached where the mix must be twice as large as all that is held, so that some sources run short."""
    targets = table(spark, sf, "mix_targets")
    return mixing.reached(mixing.mix(table(spark, sf, "documents"), targets, total=2.0), targets)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.reached(p9_mix(spark, sf), table(spark, sf, "mix_targets"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.restored(table(spark, sf, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    return mojibake.restored(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_runs, p2_found, p2_forest, p2_groups, p2_splits, p4_found, p4_masked, p5_found, p5_patterns, p6_found, p6_shares, p6_classes, p6_unrepeated, p6_lines, p7_found, p7_conversations, p8_containers, p8_fill, p8_least_cost, p9_mix, p9_shares, p9_short, p10_found, p10_restored,
    )
}

SQL: dict[str, str] = {}

_HELD = r"""WITH RECURSIVE h AS (SELECT DISTINCT regexp_replace(regexp_extract(lower(session), '(^|[^0-9a-f])[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}([^0-9a-f]|$)'), '[^0-9a-f]', '', 'g') AS s,
  regexp_extract(tool_use_id, '(^|[^0-9A-Za-z])toolu_([0-9A-Za-z]{16,})([^0-9A-Za-z_]|$)', 2) AS id FROM label_rows),
g AS (SELECT substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-' || substr(s, 13, 4) || '-' || substr(s, 17, 4) || '-' || substr(s, 21) AS s, id FROM h WHERE s <> '' AND id <> '' AND len(list_distinct(string_split(id, ''))) >= 6),
e AS (SELECT DISTINCT a.s AS x, b.s AS y FROM g AS a JOIN g AS b USING (id) WHERE a.s <> b.s),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)"""

SQL["p2_found"] = _HELD + " SELECT DISTINCT x AS session_a, y AS session_b FROM reach WHERE x < y"

SQL["p2_groups"] = _HELD + ", r AS (SELECT x AS session, min(y) AS root FROM reach GROUP BY x) SELECT session, root, count(*) OVER (PARTITION BY root) AS n_sessions FROM r"

SQL["p6_found"] = """WITH t AS (SELECT row_id, unnest(list_concat([b.text, b.content], list_transform(coalesce(b.items, []), lambda i: i.text))) AS v FROM (SELECT row_id, unnest(message.content) AS b FROM (SELECT DISTINCT ON (row_id) row_id, message FROM subagent WHERE row_id IS NOT NULL))),
w AS (SELECT DISTINCT row_id, hash(substring(v, i, 200)) AS h FROM (SELECT row_id, v, unnest(range(1, length(v) - 198)) AS i FROM t WHERE length(v) >= 200)),
k AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), s AS (SELECT w.* FROM w SEMI JOIN k USING (h))
SELECT DISTINCT a.row_id AS row_a, b.row_id AS row_b FROM s AS a JOIN s AS b ON a.h = b.h AND a.row_id < b.row_id"""

_TURNS = r"""WITH d AS (SELECT DISTINCT ON (row_id) row_id, session, CASE WHEN issidechain THEN 'side' ELSE 'main' END AS side, line_no, lower(regexp_replace(type, '\s+', '', 'g')) AS role, coalesce(message.content, []) AS c FROM subagent),
a AS (SELECT * FROM d WHERE role IN ('user', 'assistant') AND session IS NOT NULL),
k AS (SELECT *, list_transform(list_filter(c, lambda b: lower(trim(b.type)) = 'tool_use'), lambda b: b.id) AS calls, list_transform(list_filter(c, lambda b: lower(trim(b.type)) = 'tool_result'), lambda b: b.tool_use_id) AS results FROM a
  WHERE len(list_filter(c, lambda b: lower(trim(b.type)) IN ('tool_use', 'tool_result') OR (lower(trim(b.type)) = 'text' AND coalesce(regexp_matches(b.text, '[^\s\p{Z}\p{Cf}]'), false)) OR (lower(trim(b.type)) = 'thinking' AND coalesce(regexp_matches(b.thinking, '[^\s\p{Z}\p{Cf}]'), false)))) > 0),
o AS (SELECT *, lead(role) OVER w AS next_role, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY session, side ORDER BY line_no, row_id)),
g AS (SELECT session, side, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, max_by(role, n) AS last_role, bool_or(role = 'user' AND len(results) = 0 AND coalesce(next_role, '') = 'user') AS doubled FROM o GROUP BY session, side),
u AS (SELECT DISTINCT session, side, unnest(calls) AS id FROM k), v AS (SELECT DISTINCT session, side, unnest(results) AS id FROM k),
x AS (SELECT session, side FROM u WHERE id IS NULL OR NOT EXISTS (FROM v WHERE v.session = u.session AND v.side = u.side AND v.id = u.id) UNION SELECT session, side FROM v WHERE id IS NULL OR NOT EXISTS (FROM u WHERE u.session = v.session AND u.side = v.side AND u.id = v.id)),
bad AS (SELECT DISTINCT a.session, a.side FROM a LEFT JOIN g USING (session, side) WHERE g.users IS NULL OR g.users = 0 OR g.assistants = 0 OR g.last_role <> 'assistant' OR g.doubled OR EXISTS (FROM x WHERE x.session = a.session AND x.side = a.side))"""

SQL["p7_found"] = _TURNS + " SELECT session, side FROM bad"

SQL["p7_conversations"] = _TURNS + " SELECT session, side, n - 1 AS position, row_id, role FROM o WHERE NOT EXISTS (FROM bad WHERE bad.session = o.session AND bad.side = o.side)"

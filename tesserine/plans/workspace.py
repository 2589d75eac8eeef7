"""Queries on investigation workspaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import workspace as W
from ..sources.bridge import table, view, with_views
from . import query

_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_OWN = f"""ow AS (SELECT workspace, seq, op, kind, coalesce(ref, '') AS ref, text, upper(coalesce(status, 'OPEN')) AS status FROM workspace_event
 WHERE ((op IN ('ADD', 'REMOVE') AND kind IN {_IN(W.SINGLE + W.MANY)}) OR (op = 'STATUS' AND kind = 'HYPOTHESIS')) AND (NOT (kind = 'HYPOTHESIS' AND op IN ('ADD', 'STATUS')) OR upper(coalesce(status, 'OPEN')) IN {_IN(W.STATES)}))"""


@query("workspace_state", with_views(f"""WITH {_OWN}, li AS (SELECT o.* FROM ow o LEFT JOIN (SELECT workspace, kind, ref, max(seq) AS gone FROM ow WHERE op = 'REMOVE' GROUP BY 1, 2, 3) g USING (workspace, kind, ref) WHERE op <> 'REMOVE' AND (gone IS NULL OR seq > gone)),
la AS (SELECT workspace, kind, ref, max(seq) AS last_add, min(seq) AS added_seq, count(*) AS k FROM li WHERE op = 'ADD' GROUP BY 1, 2, 3),
st AS (SELECT l.workspace, l.kind, l.ref, max(seq) AS said, arg_max(status, seq) AS said_status, arg_max(text, seq) FILTER (WHERE text IS NOT NULL) AS why FROM li l JOIN la USING (workspace, kind, ref) WHERE op = 'STATUS' AND seq > last_add GROUP BY 1, 2, 3),
no AS (SELECT workspace, kind, ref, arg_max(text, seq) FILTER (WHERE text <> '') AS note FROM li WHERE op = 'ADD' GROUP BY 1, 2, 3)
SELECT la.workspace, la.kind, la.ref, CASE WHEN la.kind IN {_IN(W.SINGLE)} THEN 1 ELSE k END AS n, added_seq, coalesce(said, last_add) AS last_seq, CASE WHEN la.kind = 'HYPOTHESIS' THEN l.text ELSE note END AS text,
 CASE WHEN la.kind = 'HYPOTHESIS' THEN coalesce(said_status, l.status) END AS status, why AS rationale
FROM la JOIN ow l ON l.workspace = la.workspace AND l.seq = last_add JOIN no ON no.workspace = la.workspace AND no.kind = la.kind AND no.ref = la.ref LEFT JOIN st ON st.workspace = la.workspace AND st.kind = la.kind AND st.ref = la.ref""", "workspace_event"))
def workspace_state(spark, d):
    return W.folded(view(spark, d, "workspace_event"))


_COUNTS = ", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN d ELSE 0 END) OVER (PARTITION BY workspace ORDER BY seq) AS BIGINT) AS n_{k.lower()}" for k in W.SINGLE + W.MANY)


@query("workspace_history", with_views(f"""WITH {_OWN}, a AS (SELECT *, sum(CASE WHEN op = 'ADD' THEN 1 ELSE 0 END) OVER (PARTITION BY workspace, kind, ref ORDER BY seq) AS a FROM ow),
b AS (SELECT *, a - coalesce(max(CASE WHEN op = 'REMOVE' THEN a END) OVER (PARTITION BY workspace, kind, ref ORDER BY seq), 0) AS m FROM a), c AS (SELECT *, CASE WHEN kind IN {_IN(W.SINGLE)} THEN least(m, 1) ELSE m END AS k FROM b),
e AS (SELECT *, k - lag(k, 1, 0) OVER (PARTITION BY workspace, kind, ref ORDER BY seq) AS d FROM c) SELECT workspace, seq, op, kind, ref, {_COUNTS} FROM e""", "workspace_event"))
def workspace_history(spark, d):
    return W.history(view(spark, d, "workspace_event"))


@query("workspace_rejected", with_views(f"WITH {_OWN} SELECT op, kind, status, count(*) AS n, min(seq) AS first FROM workspace_event WHERE seq NOT IN (SELECT seq FROM ow) GROUP BY 1, 2, 3", "workspace_event"))
def workspace_rejected(spark, d):
    return W.rejected(view(spark, d, "workspace_event")).groupBy("op", "kind", "status").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def _case(of: str, said: dict, other: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in said.items()) + f" ELSE {other} END"


@query("workspace_timeline", with_views(f"""WITH {_OWN}, ob AS (SELECT 'W' || CAST(session_id % 20 AS VARCHAR) AS workspace, * FROM observation), ev AS (
SELECT workspace, NULL::TIMESTAMP AS ts, {_case("name", {k: v[0] for k, v in W.STAGE_EVENT.items()}, "NULL")} AS event_type, {_case("name", {k: v[1] for k, v in W.STAGE_EVENT.items()}, "NULL")} AS source, NULL AS entity_ref, {_case("status", W.STAGE_CONFIDENCE, "'UNKNOWN'")} AS confidence,
 trim(name || '=' || status || ' ' || coalesce(detail, '')) AS detail, 0 AS rank, 0 AS major, 0 AS minor, ord AS number FROM stage WHERE name IN {_IN(W.STAGE_EVENT)}
UNION ALL SELECT workspace, min(ts), 'RUNTIME_SESSION', 'RUNTIME_ADB', 'RUNTIME_SESSION:' || session_id, 'HIGH', 'session OPEN adapter=' || max(adapter), 1, session_id, 0, 0 FROM ob GROUP BY workspace, session_id
UNION ALL SELECT workspace, ts, CASE WHEN adapter = 'adb' THEN 'LIVE_OBSERVATION' ELSE 'RUNTIME_OBSERVATION' END, CASE WHEN adapter = 'frida' THEN 'RUNTIME_FRIDA' ELSE 'RUNTIME_ADB' END, 'RUNTIME_OBSERVATION:' || obs_id, 'HIGH', observation_type || ' ' || class_name || '.' || method_name || coalesce(symbol, ''), 1, session_id, 1, obs_id FROM ob
UNION ALL SELECT workspace, ts, 'CORRELATION', 'RUNTIME', 'RUNTIME_CORRELATION:' || sha256(class_name || '#' || method_name), 'MEDIUM', 'METHOD [' || upper(adapter) || '] JAVA_METHOD ' || substr(class_name, 1, 80), 2, 0, 0, obs_id FROM ob WHERE method_name = 'loadUrl'
UNION ALL SELECT workspace, w.ts, 'RESEARCHER_NOTE', 'USER_NOTE', ow.ref, 'N/A', substr(coalesce(ow.text, ''), 1, 200), 3, 0, 0, seq FROM ow JOIN workspace_event w USING (workspace, seq) WHERE ow.op = 'ADD' AND ow.kind = 'NOTE')
SELECT workspace, event_type, source, entity_ref, confidence, detail, row_number() OVER (PARTITION BY workspace ORDER BY ts NULLS FIRST, rank, major, minor, number) AS position FROM ev""", "workspace_event", "observation", "stage"))
def workspace_timeline(spark, d):
    """Links stand for observations of a method that is known from the code."""
    log = view(spark, d, "workspace_event")
    seen = view(spark, d, "observation").withColumns({"workspace": F.concat(F.lit("W"), (F.col("session_id") % 20).cast("string")), "confidence": F.lit("HIGH")})
    sessions = seen.groupBy("workspace", "session_id").agg(F.min("ts").alias("ts"), F.max("adapter").alias("adapter"), F.lit("OPEN").alias("state"))
    links = seen.where("method_name = 'loadUrl'").select("workspace", "ts", F.col("obs_id").alias("link_id"), F.lit("RUNTIME").alias("source"), F.sha2(F.concat_ws("#", "class_name", "method_name"), 256).alias("fingerprint"), F.lit("MEDIUM").alias("confidence"), F.lit("METHOD").alias("link_type"), F.upper("adapter").alias("mode"), F.lit("JAVA_METHOD").alias("subject"), F.col("class_name").alias("detail"))
    stages = view(spark, d, "stage").withColumn("ts", F.lit(None).cast(log.schema["ts"].dataType))
    return W.timeline(stages, sessions, seen, links, log).drop("ts")


_STAGE = "SELECT o_custkey AS analysis_id, CASE o_orderkey % 7 WHEN 0 THEN 'ingest' WHEN 1 THEN 'manifest' WHEN 2 THEN 'ghidra' WHEN 3 THEN 'native' WHEN 4 THEN 'validation' WHEN 5 THEN 'correlation' END AS name, CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED' WHEN o_orderkey % 13 = 0 THEN 'DEGRADED' WHEN o_orderkey % 29 <> 0 THEN 'COMPLETE' END AS status FROM orders"


@query("stage_status", f"""WITH s AS ({_STAGE}), k AS (SELECT *, coalesce(name, '') NOT IN {_IN(W.EXEMPT_STAGES)} AS counts FROM s)
SELECT analysis_id, count(*) FILTER (WHERE counts) AS n_stages, count(*) FILTER (WHERE counts AND status = 'FAILED') AS n_failed, CASE WHEN count(*) FILTER (WHERE name = 'manifest' AND status = 'FAILED') > 0 THEN 'FAILED' WHEN count(*) FILTER (WHERE counts AND status IS DISTINCT FROM 'COMPLETE') > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS overall FROM k GROUP BY 1""")
def stage_status(spark, d):
    return W.overall_status(spark.sql(_STAGE.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")), "analysis_id")

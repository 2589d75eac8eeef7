"""Queries on code graphs and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import paths as P
from ..sources.bridge import view, with_views
from . import query

_EDGES = "ce AS (SELECT * FROM edge WHERE src IN (SELECT node_key FROM node) AND dst IN (SELECT node_key FROM node))"
_RANK = "CASE confidence WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'EXACT' THEN 3 ELSE -1 END"


def _graph(spark, d):
    nodes = view(spark, d, "node")
    return nodes, G.connected(view(spark, d, "edge"), nodes)


def _starts(nodes):
    return nodes.where(F.col("node_type").isin("ENTRY_POINT", "DATAFLOW_SOURCE"))


@query("dangling_edges_removed", with_views(f"WITH {_EDGES} SELECT edge_type, confidence, count(*) AS n FROM ce GROUP BY 1, 2", "node", "edge"))
def dangling_edges_removed(spark, d):
    return _graph(spark, d)[1].groupBy("edge_type", "confidence").agg(F.count("*").alias("n"))


@query("graph_reachable_set", with_views(f"""WITH RECURSIVE {_EDGES}, ar AS (SELECT DISTINCT src, dst FROM ce), r AS (SELECT node_key, 0 AS steps FROM node WHERE node_type = 'ENTRY_POINT' UNION SELECT ar.dst, r.steps + 1 FROM r JOIN ar ON ar.src = r.node_key WHERE r.steps < 8)
SELECT node_key, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY node_key""", "node", "edge"))
def graph_reachable_set(spark, d):
    """From all entry points, as far as it goes; the SQL stops after eight steps, where nothing new is found any more."""
    nodes, edges = _graph(spark, d)
    return G.reachable(edges, nodes.where("node_type = 'ENTRY_POINT'"))


def shortest_sql(starts: str, aims: str, edges: str = "ce") -> str:
    """CTEs ar and p: per start and node the shortest path, the first in text order; aims end a path. To be put after WITH RECURSIVE."""
    return f"""ar AS (SELECT src, dst, max({_RANK}) AS rank FROM {edges} WHERE src <> dst GROUP BY src, dst), aim AS ({aims}),
p(start, node, path, length, weakest) USING KEY (start, node) AS (SELECT node_key, node_key, node_key, 1, 9 FROM ({starts})
 UNION ALL (SELECT p.start, ar.dst, p.path || ' > ' || ar.dst, p.length + 1, least(p.weakest, ar.rank) FROM p JOIN ar ON ar.src = p.node WHERE p.length < {P.DEPTH} AND (p.length = 1 OR p.node NOT IN (SELECT node_key FROM aim))
 AND NOT EXISTS (SELECT 1 FROM recurring.p AS r WHERE r.start = p.start AND r.node = ar.dst) QUALIFY row_number() OVER (PARTITION BY p.start, ar.dst ORDER BY p.path) = 1))"""


NAMED_RANK = "CASE weakest WHEN -1 THEN 'UNKNOWN' WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'EXACT' END"
_STARTS = "SELECT node_key FROM node WHERE node_type IN ('ENTRY_POINT', 'DATAFLOW_SOURCE')"
_SINKS = "SELECT node_key FROM node WHERE node_type = 'SECURITY_SINK'"


@query("graph_shortest_target_paths", with_views(f"""WITH RECURSIVE {_EDGES}, {shortest_sql(_STARTS, _SINKS)}
SELECT start, node AS target, path, length, {NAMED_RANK} AS confidence FROM p WHERE length > 1 AND node IN (SELECT node_key FROM aim)""", "node", "edge"))
def graph_shortest_target_paths(spark, d):
    nodes, edges = _graph(spark, d)
    return P.shortest_paths(edges, _starts(nodes), nodes.where("node_type = 'SECURITY_SINK'"))


@query("graph_simple_paths", with_views(f"""WITH RECURSIVE {_EDGES}, ar AS (SELECT src, dst, max({_RANK}) AS rank FROM ce GROUP BY src, dst),
p AS (SELECT node_key AS node, [node_key] AS path, 9 AS weakest FROM node WHERE node_type = 'ENTRY_POINT' UNION ALL SELECT ar.dst, list_append(p.path, ar.dst), least(p.weakest, ar.rank) FROM p JOIN ar ON ar.src = p.node WHERE len(p.path) < 5 AND p.node NOT IN ({_SINKS}) AND NOT list_contains(p.path, ar.dst))
SELECT path[1] AS start, node AS target, array_to_string(path, ' > ') AS path, CAST(len(path) AS INTEGER) AS length, {NAMED_RANK} AS confidence FROM p WHERE node IN ({_SINKS})""", "node", "edge"))
def graph_simple_paths(spark, d):
    """All of up to five nodes, however many a pair has. The SQL stops there; where a pair has fewer than twenty by then, the query goes on to its twenty least."""
    nodes, edges = _graph(spark, d)
    return P.k_paths(edges, nodes.where("node_type = 'ENTRY_POINT'"), nodes.where("node_type = 'SECURITY_SINK'"), 20, whole=5)


@query("graph_k_paths", with_views(f"""WITH RECURSIVE {_EDGES}, ar AS (SELECT src, dst, max({_RANK}) AS rank FROM ce GROUP BY src, dst), st AS ({_STARTS} ORDER BY node_key LIMIT 50), aim AS ({_SINKS} ORDER BY node_key LIMIT 50),
p AS (SELECT node_key AS node, [node_key] AS path, 9 AS weakest FROM st UNION ALL SELECT ar.dst, list_append(p.path, ar.dst), least(p.weakest, ar.rank) FROM p JOIN ar ON ar.src = p.node WHERE len(p.path) < 3 AND p.node NOT IN (SELECT node_key FROM aim) AND NOT list_contains(p.path, ar.dst)),
k AS (SELECT path[1] AS start, node AS target, array_to_string(path, ' > ') AS path, CAST(len(path) AS INTEGER) AS length, {NAMED_RANK} AS confidence FROM p WHERE node IN (SELECT node_key FROM aim)
 QUALIFY row_number() OVER (PARTITION BY path[1], node ORDER BY len(path), array_to_string(path, ' > ')) <= 5) SELECT * FROM k ORDER BY length, path LIMIT 50""", "node", "edge"))
def graph_k_paths(spark, d):
    """The question of all pairs: the first 50 starts and targets, five paths a pair, the 50 shortest of all. There are fifty of three nodes, where the SQL stops."""
    nodes = view(spark, d, "node")
    return P.least_paths(view(spark, d, "edge"), _starts(nodes).orderBy("node_key").limit(50), nodes.where("node_type = 'SECURITY_SINK'").orderBy("node_key").limit(50), 5, 50, nodes)


@query("graph_paths_to_unresolved", with_views(f"""WITH RECURSIVE {_EDGES}, oc AS (SELECT DISTINCT src, 'unresolved:' || dst AS dst, 'CALLS' AS edge_type, 'UNKNOWN' AS confidence FROM edge WHERE edge_type IN ('CALLS', 'INVOKES') AND dst NOT IN (SELECT node_key FROM node)),
ae AS (SELECT src, dst, edge_type, confidence FROM ce UNION ALL SELECT * FROM oc), {shortest_sql("SELECT node_key FROM node WHERE node_type = 'NATIVE_FUNCTION'", "SELECT DISTINCT dst AS node_key FROM oc", "ae")}
SELECT start, node AS target, path, length, {NAMED_RANK} AS confidence FROM p WHERE length > 1 AND node IN (SELECT node_key FROM aim)""", "node", "edge"))
def graph_paths_to_unresolved(spark, d):
    """Native functions to callees that are nowhere: these end a path, as unresolved."""
    nodes, edges = _graph(spark, d)
    calls = view(spark, d, "edge").where(F.col("edge_type").isin("CALLS", "INVOKES"))
    more, ends = P.with_open_ends(edges, nodes, calls)
    return P.shortest_paths(more, nodes.where("node_type = 'NATIVE_FUNCTION'"), ends)


@query("graph_filtered_paths", with_views(f"""WITH RECURSIVE {_EDGES}, fe AS (SELECT * FROM ce WHERE edge_type IN ('CALLS', 'INVOKES') AND {_RANK} >= 1), {shortest_sql("SELECT node_key FROM node WHERE node_type = 'DATAFLOW_SOURCE'", _SINKS, "fe")}
SELECT start, node AS target, path, length, {NAMED_RANK} AS confidence FROM p WHERE length > 1 AND node IN (SELECT node_key FROM aim)""", "node", "edge"))
def graph_filtered_paths(spark, d):
    """Over calls of medium confidence or better."""
    nodes = view(spark, d, "node")
    calls = P.selected(view(spark, d, "edge"), ("CALLS", "INVOKES"), "MEDIUM")
    return P.forward_paths(calls, nodes.where("node_type = 'DATAFLOW_SOURCE'"), nodes.where("node_type = 'SECURITY_SINK'"), nodes=nodes)


@query("graph_neighbours", with_views(f"""WITH {_EDGES}, k AS (SELECT node_key FROM node WHERE node_type = 'SECURITY_SINK') SELECT k.node_key, 'out' AS direction, ce.dst AS other, edge_type FROM ce JOIN k ON ce.src = k.node_key
UNION ALL SELECT k.node_key, 'in', ce.src, edge_type FROM ce JOIN k ON ce.dst = k.node_key""", "node", "edge"))
def graph_neighbours(spark, d):
    nodes, edges = _graph(spark, d)
    return G.neighbours(edges, nodes.where("node_type = 'SECURITY_SINK'").select("node_key"))


@query("graph_fan_out", with_views("SELECT src, count(*) AS degree FROM edge WHERE edge_type IN ('CALLS', 'INVOKES') GROUP BY src HAVING count(*) >= 40", "edge"))
def graph_fan_out(spark, d):
    return G.fan_out(view(spark, d, "edge"), 40)


_FPN = "substr(sha256(analysis_id || '|' || {t} || '|' || {l}), 1, 32)"
_KG = f"""
kn AS (SELECT analysis_id, 'COMPONENT' AS node_type, name AS label, 'manifest' AS provenance FROM component UNION ALL SELECT analysis_id, 'DEPENDENCY', name, 'inventory' FROM dependency
 UNION ALL SELECT analysis_id, 'RULE', rule_id, 'finding' FROM finding UNION ALL SELECT analysis_id, 'COMPONENT', component, 'finding' FROM finding WHERE component IS NOT NULL),
nn AS (SELECT analysis_id, {_FPN.format(t="node_type", l="label")} AS fingerprint, node_type, label, min(provenance) AS provenance FROM kn GROUP BY 1, 2, 3, 4),
ke AS (SELECT DISTINCT analysis_id, {_FPN.format(t="'RULE'", l="rule_id")} AS src, {_FPN.format(t="'COMPONENT'", l="component")} AS dst, 'FOUND_IN' AS edge_type FROM finding WHERE component IS NOT NULL
 UNION SELECT DISTINCT analysis_id, {_FPN.format(t="'DEPENDENCY'", l="name")}, {_FPN.format(t="'COMPONENT'", l="'c' || CAST(dep_id % 997 AS VARCHAR)")}, 'USED_BY' FROM dependency),
ee AS (SELECT *, substr(sha256(src || '|' || dst || '|' || edge_type), 1, 32) AS fingerprint FROM ke WHERE src IN (SELECT fingerprint FROM nn) AND dst IN (SELECT fingerprint FROM nn))"""


def _kg_nodes(spark, d):
    named = lambda df, kind, label, origin: df.select("analysis_id", F.lit(kind).alias("node_type"), label.alias("label"), F.lit(origin).alias("provenance"))
    findings = view(spark, d, "finding")
    return G.projected_nodes(
        named(view(spark, d, "component"), "COMPONENT", F.col("name"), "manifest"), named(view(spark, d, "dependency"), "DEPENDENCY", F.col("name"), "inventory"),
        named(findings, "RULE", F.col("rule_id"), "finding"), named(findings.where("component IS NOT NULL"), "COMPONENT", F.col("component"), "finding"),
    )


def _kg_edges(spark, d, nodes):
    row = lambda df, st, s, dt, t, kind: df.select("analysis_id", F.lit(st).alias("src_type"), s.alias("src"), F.lit(dt).alias("dst_type"), t.alias("dst"), F.lit(kind).alias("edge_type"))
    return G.projected_edges(
        nodes, row(view(spark, d, "finding").where("component IS NOT NULL"), "RULE", F.col("rule_id"), "COMPONENT", F.col("component"), "FOUND_IN"),
        row(view(spark, d, "dependency"), "DEPENDENCY", F.col("name"), "COMPONENT", F.concat(F.lit("c"), (F.col("dep_id") % 997).cast("string")), "USED_BY"),
    )


@query("kg_nodes", with_views(f"WITH {_KG} SELECT * FROM nn", "component", "dependency", "finding"))
def kg_nodes(spark, d):
    return _kg_nodes(spark, d)


@query("kg_edges", with_views(f"WITH {_KG} SELECT * FROM ee", "component", "dependency", "finding"))
def kg_edges(spark, d):
    return _kg_edges(spark, d, _kg_nodes(spark, d))


@query("kg_digest", with_views(f"""WITH {_KG}, m AS (SELECT analysis_id, fingerprint FROM nn UNION ALL SELECT analysis_id, fingerprint FROM ee), b AS (SELECT analysis_id, substr(fingerprint, 1, 3) AS bucket, count(*) AS n, sha256(string_agg(fingerprint, '|' ORDER BY fingerprint)) AS part FROM m GROUP BY 1, 2)
SELECT analysis_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bucket || ':' || part, '|' ORDER BY bucket)) AS digest FROM b GROUP BY 1""", "component", "dependency", "finding"))
def kg_digest(spark, d):
    nodes = _kg_nodes(spark, d)
    return G.digest(nodes.select("analysis_id", "fingerprint").unionByName(_kg_edges(spark, d, nodes).select("analysis_id", "fingerprint")))


@query("graph_dot_lines", with_views("""SELECT '"' || src || '" -> "' || dst || '" [label="' || edge_type || '"];' AS line FROM edge""", "edge"))
def graph_dot_lines(spark, d):
    return G.as_dot(view(spark, d, "edge"))

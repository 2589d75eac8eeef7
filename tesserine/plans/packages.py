"""Queries on manifests and on the transitions between two analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots as S
from ..sources import manifest
from ..sources.bridge import table, view, with_views
from . import query

_KIND = "CASE c_mktsegment WHEN 'BUILDING' THEN 'activity' WHEN 'MACHINERY' THEN 'service' WHEN 'HOUSEHOLD' THEN 'provider' WHEN 'AUTOMOBILE' THEN 'receiver' ELSE 'activity' END"


def _elements(spark, d):
    """A manifest per group of customers, written as text and read by the parser."""
    c = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    kind = F.when(seg == "BUILDING", "activity").when(seg == "MACHINERY", "service").when(seg == "HOUSEHOLD", "provider").when(seg == "AUTOMOBILE", "receiver").otherwise("activity")
    flag = F.when(key % 3 == 0, ' android:exported="true"').when(key % 3 == 1, ' android:exported="false"').otherwise("")
    filters = F.when(F.col("c_nationkey") % 2 == 0, '<intent-filter><action android:name="a.V"/></intent-filter>').otherwise("")
    one = c("<", kind, ' android:name="c', key.cast("string"), '"', flag, ">", filters, "</", kind, ">")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), one.alias("x")))), lambda s: s["x"]), "")
    group = (key % 97).cast("string")
    grouped = table(spark, d, "customer").groupBy(group.alias("g")).agg(body.alias("body"))
    text = c('<manifest xmlns:android="', manifest.ANDROID, '" package="p', F.col("g"), '" android:versionName="1.', F.col("g"), '"><uses-sdk android:minSdkVersion="21"/><uses-permission android:name="android.permission.READ_SMS"/><permission android:name="p', F.col("g"), '.OWN"/>',
             F.when(F.col("g") == "5", "<broken").otherwise(""), '<application android:debuggable="', F.when(F.col("g").endswith("1"), "true").otherwise("false"), '">', F.col("body"), "</application></manifest>")
    return manifest.elements(grouped.select(F.col("g").alias("path"), F.encode(text, "UTF-8").alias("manifest")))


@query("manifest_headers", """SELECT DISTINCT CAST(c_custkey % 97 AS VARCHAR) AS path, CASE WHEN c_custkey % 97 = 5 THEN 'malformed_xml' ELSE 'parsed' END AS status, CASE WHEN c_custkey % 97 <> 5 THEN 'p' || CAST(c_custkey % 97 AS VARCHAR) END AS package,
 CASE WHEN c_custkey % 97 <> 5 THEN '1.' || CAST(c_custkey % 97 AS VARCHAR) END AS version_name, CASE WHEN c_custkey % 97 <> 5 THEN '21' END AS min_sdk, CASE WHEN c_custkey % 97 <> 5 THEN c_custkey % 97 % 10 = 1 END AS debuggable FROM customer""")
def manifest_headers(spark, d):
    return manifest.headers(_elements(spark, d)).select("path", "status", "package", "version_name", "min_sdk", "debuggable")


@query("manifest_components", f"""WITH c AS (SELECT CAST(c_custkey % 97 AS VARCHAR) AS path, {_KIND} AS kind, 'c' || CAST(c_custkey AS VARCHAR) AS name, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS exported, c_nationkey % 2 = 0 AS f FROM customer WHERE c_custkey % 97 <> 5)
SELECT path, kind, name, exported, CASE WHEN exported THEN 'EXPORTED' WHEN NOT exported THEN 'INTERNAL' WHEN f AND kind <> 'provider' THEN 'CONDITIONALLY_EXPORTED' WHEN kind = 'provider' THEN 'UNKNOWN' ELSE 'INTERNAL' END AS exposure, CAST(f AS BIGINT) AS n_filters FROM c""")
def manifest_components(spark, d):
    return manifest.components(_elements(spark, d)).select("path", "kind", "name", "exported", "exposure", "n_filters")


@query("manifest_permissions", """SELECT DISTINCT CAST(c_custkey % 97 AS VARCHAR) AS path, 'android.permission.READ_SMS' AS name, false AS declared, 'DANGEROUS' AS class, 'SMS' AS "group" FROM customer WHERE c_custkey % 97 <> 5
UNION ALL SELECT DISTINCT CAST(c_custkey % 97 AS VARCHAR), 'p' || CAST(c_custkey % 97 AS VARCHAR) || '.OWN', true, 'UNKNOWN', NULL FROM customer WHERE c_custkey % 97 <> 5""")
def manifest_permissions(spark, d):
    return manifest.permissions(_elements(spark, d))


_SIDES = """
ma AS (SELECT ps_key, 'S' || CAST(ps_key % 7 AS VARCHAR) AS version_state, 'C' || CAST(ps_key % 3 AS VARCHAR) AS correlation_state, CAST(ps_key % 5 AS VARCHAR) AS version, CAST(ps_key % 2 AS VARCHAR) AS reachability_state, 'x' AS signature_state, CAST(ps_key % 4 AS VARCHAR) AS kind FROM (SELECT p_partkey AS ps_key FROM part) WHERE ps_key % 11 <> 0),
mb AS (SELECT ps_key, 'S' || CAST(ps_key % 7 AS VARCHAR) AS version_state, 'C' || CAST(ps_key % 6 AS VARCHAR) AS correlation_state, CASE WHEN ps_key % 9 > 0 THEN CAST(ps_key % 10 AS VARCHAR) END AS version, CAST(ps_key % 4 AS VARCHAR) AS reachability_state, CASE WHEN ps_key % 8 = 0 THEN 'y' ELSE 'x' END AS signature_state, CAST(ps_key % 8 AS VARCHAR) AS kind FROM (SELECT p_partkey AS ps_key FROM part) WHERE ps_key % 13 <> 0)"""


def _sides(spark, d):
    k = F.col("p_partkey")
    t = lambda m: (k % m).cast("string")
    own = table(spark, d, "part")
    a = own.where(k % 11 != 0).select(k.alias("ps_key"), F.concat(F.lit("S"), t(7)).alias("version_state"), F.concat(F.lit("C"), t(3)).alias("correlation_state"), t(5).alias("version"), t(2).alias("reachability_state"), F.lit("x").alias("signature_state"), t(4).alias("kind"))
    b = own.where(k % 13 != 0).select(k.alias("ps_key"), F.concat(F.lit("S"), t(7)).alias("version_state"), F.concat(F.lit("C"), t(6)).alias("correlation_state"), F.when(k % 9 > 0, t(10)).alias("version"), t(4).alias("reachability_state"), F.when(k % 8 == 0, "y").otherwise("x").alias("signature_state"), t(8).alias("kind"))
    return a, b


_JOIN = "ma FULL JOIN mb ON ma.ps_key = mb.ps_key"


@query("diff_cve_transitions", f"""WITH {_SIDES}, j AS (SELECT coalesce(ma.ps_key, mb.ps_key) AS ps_key, CASE WHEN ma.ps_key IS NULL THEN 'NEW_MATCH' WHEN mb.ps_key IS NULL THEN 'REMOVED_MATCH' ELSE concat_ws(',', CASE WHEN ma.version_state IS DISTINCT FROM mb.version_state OR ma.correlation_state IS DISTINCT FROM mb.correlation_state THEN 'STATE_CHANGED' END,
 CASE WHEN ma.version IS DISTINCT FROM mb.version THEN 'VERSION_CHANGED' END, CASE WHEN ma.reachability_state IS DISTINCT FROM mb.reachability_state THEN 'REACHABILITY_CHANGED' END, CASE WHEN ma.signature_state IS DISTINCT FROM mb.signature_state THEN 'SIGNATURE_CHANGED' END) END AS transition, ma.correlation_state AS a_correlation_state, mb.correlation_state AS b_correlation_state FROM {_JOIN})
SELECT ps_key, CASE transition WHEN 'NEW_MATCH' THEN 'ADDED' WHEN 'REMOVED_MATCH' THEN 'REMOVED' ELSE 'CHANGED' END AS change_type, transition, a_correlation_state, b_correlation_state FROM j WHERE transition <> ''""")
def diff_cve_transitions(spark, d):
    return S.cve_transitions(*_sides(spark, d), ["ps_key"])


@query("diff_dependency_transitions", f"""WITH {_SIDES}, j AS (SELECT coalesce(ma.ps_key, mb.ps_key) AS ps_key, CASE WHEN ma.ps_key IS NULL THEN 'ADDED' WHEN mb.ps_key IS NULL THEN 'REMOVED' WHEN ma.version IS DISTINCT FROM mb.version THEN CASE WHEN ma.version <> '' AND mb.version <> '' THEN 'VERSION_CHANGED' ELSE 'VERSION_UNKNOWN' END WHEN ma.kind IS DISTINCT FROM mb.kind THEN 'CLASSIFICATION_CHANGED' END AS classification, ma.version AS a_version, mb.version AS b_version FROM {_JOIN})
SELECT * FROM j WHERE classification IS NOT NULL""")
def diff_dependency_transitions(spark, d):
    return S.dependency_transitions(*_sides(spark, d), ["ps_key"])


_RISKS = lambda t, m: f"{t} AS (SELECT s_nationkey, CAST(max(s_suppkey) % {m} AS INTEGER) AS score, CASE WHEN max(s_suppkey) % {m} >= 40 THEN 'medium' ELSE 'info' END AS band, string_agg(DISTINCT 'f' || CAST(s_suppkey % {m} % 9 AS VARCHAR), ',') AS factors FROM supplier GROUP BY 1)"
_GONE = lambda x, y: f"coalesce(array_to_string(list_sort(list_filter(string_split({x}.factors, ','), lambda f: NOT list_contains(coalesce(string_split({y}.factors, ','), []), f))), ','), '')"


@query("diff_risk_delta", f"""WITH {_RISKS("ra", 83)}, {_RISKS("rb", 97)} SELECT coalesce(ra.s_nationkey, rb.s_nationkey) AS s_nationkey, coalesce(rb.score, 0) - coalesce(ra.score, 0) AS delta, CASE WHEN coalesce(ra.band, 'info') = coalesce(rb.band, 'info') THEN coalesce(ra.band, 'info') ELSE coalesce(ra.band, 'info') || ' -> ' || coalesce(rb.band, 'info') END AS band_transition,
 {_GONE("rb", "ra")} AS factors_added, {_GONE("ra", "rb")} AS factors_removed FROM ra FULL JOIN rb ON ra.s_nationkey = rb.s_nationkey""")
def diff_risk_delta(spark, d):
    own = table(spark, d, "supplier")

    def side(m):
        top = F.max("s_suppkey") % m
        return own.groupBy("s_nationkey").agg(top.cast("int").alias("score"), F.when(top >= 40, "medium").otherwise("info").alias("band"), F.array_join(F.collect_set(F.concat(F.lit("f"), (F.col("s_suppkey") % m % 9).cast("string"))), ",").alias("factors"))

    return S.risk_delta(side(83), side(97), ["s_nationkey"])


@query("diff_needed_libraries", with_views("""WITH a AS (SELECT analysis_id, name, list(DISTINCT 'n' || CAST(n_exported AS VARCHAR)) AS x FROM library GROUP BY 1, 2), b AS (SELECT analysis_id, name, list(DISTINCT 'n' || CAST(n_exported % 5 AS VARCHAR)) AS x FROM library GROUP BY 1, 2)
SELECT * FROM (SELECT analysis_id, name, array_to_string(list_sort(list_filter(b.x, lambda i: NOT list_contains(a.x, i))), ',') AS added, array_to_string(list_sort(list_filter(a.x, lambda i: NOT list_contains(b.x, i))), ',') AS removed FROM a JOIN b USING (analysis_id, name)) WHERE added <> '' OR removed <> ''""", "library"))
def diff_needed_libraries(spark, d):
    side = lambda c: view(spark, d, "library").groupBy("analysis_id", "name").agg(F.collect_set(F.concat(F.lit("n"), c.cast("string"))).alias("needed"))
    return S.list_delta(side(F.col("n_exported")), side(F.col("n_exported") % 5), ["analysis_id", "name"], "needed")

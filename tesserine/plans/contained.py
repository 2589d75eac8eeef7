"""Queries that join on substrings and suffixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contained as C
from ..sources.bridge import table, view, with_views
from . import query

_META = "meta AS (SELECT 'A' || CAST(s_suppkey % 5 AS VARCHAR) AS analysis_id, s_suppkey AS meta_id, CASE s_suppkey % 4 WHEN 0 THEN 'Lib' || CAST(s_suppkey % 89 AS VARCHAR) ELSE 'x' || CAST(s_suppkey % 50 AS VARCHAR) || '-lib' || CAST(s_suppkey % 13 AS VARCHAR) END AS artifact, CASE s_suppkey % 6 WHEN 0 THEN 'the core' WHEN 1 THEN NULL ELSE lower(s_name) END AS grp, CASE s_suppkey % 7 WHEN 0 THEN 'v1' ELSE CAST(s_suppkey % 9 AS VARCHAR) || '.' || CAST(s_nationkey AS VARCHAR) END AS version FROM supplier)"
_MATCHED = f"""{_META}, n AS (SELECT analysis_id, dep_id, unnest([lower(name), split_part(package_prefix, '.', -1)]) AS needle FROM dependency),
mm AS (SELECT m.analysis_id, m.meta_id, min(n.dep_id) AS dep_id, any_value(m.version) AS version FROM meta m JOIN n ON n.analysis_id = m.analysis_id AND contains(lower(coalesce(grp, '') || ' ' || coalesce(artifact, '')), needle) WHERE regexp_matches(version, '^[0-9]') GROUP BY 1, 2)"""


def _metadata(spark, d):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    artifact = F.when(k % 4 == 0, F.concat(F.lit("Lib"), text(k % 89))).otherwise(F.concat(F.lit("x"), text(k % 50), F.lit("-lib"), text(k % 13)))
    grp = F.when(k % 6 == 0, "the core").when(k % 6 != 1, F.lower("s_name"))
    version = F.when(k % 7 == 0, "v1").otherwise(F.concat(text(k % 9), F.lit("."), text(F.col("s_nationkey"))))
    return table(spark, d, "supplier").select(F.concat(F.lit("A"), text(k % 5)).alias("analysis_id"), k.alias("meta_id"), artifact.alias("artifact"), grp.alias("grp"), version.alias("version"))


@query("embedded_metadata", with_views(f"WITH {_MATCHED} SELECT * FROM mm", "dependency"))
def embedded_metadata(spark, d):
    return C.metadata_dependencies(_metadata(spark, d), view(spark, d, "dependency"))


@query("embedded_versions", with_views(f"WITH {_MATCHED} SELECT analysis_id, dep_id, max_by(version, meta_id) AS version, count(*) AS n_metadata, 'EXACT' AS version_confidence FROM mm GROUP BY 1, 2", "dependency"))
def embedded_versions(spark, d):
    return C.embedded_versions(_metadata(spark, d), view(spark, d, "dependency"))


_LABEL = "CASE o_orderkey % 3 WHEN 0 THEN 'c' || CAST(o_custkey % 997 AS VARCHAR) WHEN 1 THEN 'entry com.x.c' || CAST(o_custkey % 997 AS VARCHAR) || '#onCreate' ELSE o_orderpriority END"


@query("path_surface_nodes", with_views(f"""WITH p AS (SELECT 'A' || CAST(o_custkey % 5 AS VARCHAR) AS analysis_id, o_orderkey AS path_id, {_LABEL} AS start_label FROM orders),
l AS (SELECT DISTINCT analysis_id, start_label FROM p), f AS (SELECT l.analysis_id, start_label, min(component_id) AS ord FROM l JOIN component c ON c.analysis_id = l.analysis_id AND contains(start_label, c.name) GROUP BY 1, 2)
SELECT analysis_id, path_id, ord FROM p JOIN f USING (analysis_id, start_label)""", "component"))
def path_surface_nodes(spark, d):
    k = F.col("o_orderkey")
    own = F.concat(F.lit("c"), (F.col("o_custkey") % 997).cast("string"))
    label = F.when(k % 3 == 0, own).when(k % 3 == 1, F.concat(F.lit("entry com.x."), own, F.lit("#onCreate"))).otherwise(F.col("o_orderpriority"))
    paths = table(spark, d, "orders").select(F.concat(F.lit("A"), (F.col("o_custkey") % 5).cast("string")).alias("analysis_id"), k.alias("path_id"), label.alias("start_label"))
    nodes = view(spark, d, "component").select("analysis_id", F.col("component_id").alias("ord"), "name", F.col("name").alias("component"))
    return C.path_surface(paths, nodes)


_END = "CASE s_suppkey % 4 WHEN 0 THEN 'SINK exec' || CAST(s_suppkey % 7 AS VARCHAR) || '(x)' WHEN 1 THEN 'line' WHEN 2 THEN 'exec' || CAST(s_suppkey % 9 AS VARCHAR) || '(x)' ELSE 'bol' END"


@query("path_rule_links", with_views(f"""WITH t AS (SELECT finding_id, max_by(detail, ord) AS tail FROM evidence GROUP BY 1), f AS (SELECT finding_id, rule_id, tail FROM finding JOIN t USING (finding_id)),
p AS (SELECT s_suppkey AS path_id, {_END} AS end_label FROM supplier), l AS (SELECT DISTINCT end_label FROM p),
r AS (SELECT end_label, min(finding_id) AS finding_ord, min_by(rule_id, finding_id) AS rule_id FROM l JOIN f ON ends_with(tail, end_label) GROUP BY 1) SELECT path_id, end_label, rule_id, finding_ord FROM p LEFT JOIN r USING (end_label)""", "finding", "evidence"))
def path_rule_links(spark, d):
    k = F.col("s_suppkey")
    exec_of = lambda head, m: F.concat(F.lit(head), (k % m).cast("string"), F.lit("(x)"))
    end = F.when(k % 4 == 0, exec_of("SINK exec", 7)).when(k % 4 == 1, "line").when(k % 4 == 2, exec_of("exec", 9)).otherwise("bol")
    tails = view(spark, d, "evidence").groupBy("finding_id").agg(F.max_by("detail", "ord").alias("tail"))
    findings = view(spark, d, "finding").join(tails, "finding_id").select(F.col("finding_id").alias("ord"), "rule_id", "tail")
    return C.path_rules(table(spark, d, "supplier").select(k.alias("path_id"), end.alias("end_label")), findings)

"""Queries on presence and reach of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reach as X
from ..sources.bridge import view, with_views
from . import query

_METHODS = "me AS (SELECT 'org.lib' || CAST(dep_id % 60 AS VARCHAR) || CASE WHEN dep_id % 2 = 0 THEN '.core' ELSE '.x' END || '.C' || CAST(dep_id % 7 AS VARCHAR) AS class_name, 'm' || CAST(dep_id % 5 AS VARCHAR) AS method_name, dep_id % 9 = 0 AS reached FROM dependency)"


def _methods(spark, d):
    k = lambda m: (F.col("dep_id") % m).cast("string")
    name = F.concat(F.lit("org.lib"), k(60), F.when(F.col("dep_id") % 2 == 0, ".core").otherwise(".x"), F.lit(".C"), k(7))
    return view(spark, d, "dependency").select(name.alias("class_name"), F.concat(F.lit("m"), k(5)).alias("method_name"), (F.col("dep_id") % 9 == 0).alias("reached"))


@query("signature_states", with_views(f"""WITH {_METHODS}, sg AS (SELECT cve_id, 'org.lib' || CAST(product_id % 70 AS VARCHAR) || '.core.C' || CAST(product_id % 11 AS VARCHAR) AS class_name, 'm' || CAST(product_id % 6 AS VARCHAR) AS method_name FROM product),
ms AS (SELECT DISTINCT d.dep_id, p.cve_id FROM dependency d JOIN product p ON p.product = lower(d.name)),
lv AS (SELECT cve_id, max(CASE WHEN EXISTS (SELECT 1 FROM me WHERE me.class_name = sg.class_name AND me.method_name = sg.method_name AND reached) THEN 5 WHEN EXISTS (SELECT 1 FROM me WHERE me.class_name = sg.class_name AND me.method_name = sg.method_name) THEN 4
 WHEN EXISTS (SELECT 1 FROM me WHERE me.class_name = sg.class_name) THEN 3 WHEN EXISTS (SELECT 1 FROM me WHERE regexp_extract(me.class_name, '^(.*)\\.[^.]*$', 1) = regexp_extract(sg.class_name, '^(.*)\\.[^.]*$', 1)) THEN 2 ELSE 1 END) AS level FROM sg GROUP BY cve_id)
SELECT dep_id, cve_id, CASE coalesce(level, 0) {" ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(X.SIGNATURE_STATES))} END AS signature_state FROM ms LEFT JOIN lv USING (cve_id)""", "dependency", "product"))
def signature_states(spark, d):
    n = F.col("product_id")
    products = view(spark, d, "product")
    named = F.concat(F.lit("org.lib"), (n % 70).cast("string"), F.lit(".core.C"), (n % 11).cast("string"))
    signatures = products.select("cve_id", named.alias("class_name"), F.concat(F.lit("m"), (n % 6).cast("string")).alias("method_name"))
    matches = view(spark, d, "dependency").select("dep_id", F.lower("name").alias("product")).join(products.select("product", "cve_id"), "product").select("dep_id", "cve_id").distinct()
    return X.signature_states(matches, signatures, _methods(spark, d))


@query("dependency_reachability", with_views(f"""WITH {_METHODS}, c AS (SELECT class_name, bool_or(reached) AS reached FROM me GROUP BY 1), p AS (SELECT package_prefix, bool_or(reached) AS reached FROM (SELECT DISTINCT package_prefix FROM dependency) JOIN c ON starts_with(class_name, package_prefix) GROUP BY 1)
SELECT dep_id, CASE WHEN reached THEN 'REACHABLE' WHEN reached IS NOT NULL THEN 'NOT_REACHABLE' ELSE 'UNKNOWN' END AS reachability FROM dependency LEFT JOIN p USING (package_prefix)""", "dependency"))
def dependency_reachability(spark, d):
    return X.dependency_reach(view(spark, d, "dependency"), _methods(spark, d))


@query("observed_findings", with_views("""WITH f AS (SELECT event_id AS finding_id, 'calls ' || regexp_extract(class_name, '[^.]*$') || '.' || CASE WHEN event_id % 3 = 0 THEN 'nothing' ELSE method_name END || ' twice: Web.x' AS text FROM (SELECT obs_id AS event_id, class_name, method_name FROM observation)),
s AS (SELECT regexp_extract(class_name, '[^.]*$') || '.' || method_name AS name, count(*) AS n, bool_or(adapter <> 'mock') AS live FROM observation GROUP BY 1),
t AS (SELECT finding_id, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z_$][\\w$]*\\.[A-Za-z_$][\\w$]*)', 1))) AS name FROM f)
SELECT finding_id, CAST(sum(n) AS BIGINT) AS n_observed, bool_or(live) AS live FROM t JOIN s USING (name) GROUP BY 1""", "observation"))
def observed_findings(spark, d):
    own = view(spark, d, "observation")
    text = F.concat(F.lit("calls "), F.substring_index("class_name", ".", -1), F.lit("."), F.when(F.col("obs_id") % 3 == 0, "nothing").otherwise(F.col("method_name")), F.lit(" twice: Web.x"))
    return X.mentioned(own.select(F.col("obs_id").alias("finding_id"), text.alias("text")), own)

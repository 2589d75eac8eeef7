"""Queries on findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import findings as N
from ..sources.bridge import view, with_views
from . import query

_FP = """
pe AS (SELECT finding_id, arg_min(location, ord) FILTER (WHERE coalesce(location, '') <> '') AS target, string_agg(coalesce(source, 'None') || ':' || coalesce(location, 'None'), '|' ORDER BY coalesce(source, 'None') || ':' || coalesce(location, 'None')) AS identity FROM evidence GROUP BY finding_id),
ft AS (SELECT f.*, coalesce(target, nullif(component, ''), rule_id) AS primary_target, coalesce(nullif(identity, ''), component, '') AS identity FROM finding f LEFT JOIN pe USING (finding_id)),
fp AS (SELECT * EXCLUDE (identity), substr(sha256(rule_id || '|' || category || '|' || primary_target || '|' || identity), 1, 32) AS fingerprint FROM ft),
dd AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, fingerprint ORDER BY finding_id) > 1 AS is_duplicate FROM fp)"""
_DIMS = """
sk AS (SELECT finding_id, arg_max(trim(split_part(trim(substr(detail, strpos(detail, 'SECURITY_SINK') + 13)), '(', 1)), ord) AS sink FROM evidence WHERE contains(detail, 'SECURITY_SINK') GROUP BY finding_id),
dm AS (SELECT analysis_id, finding_id, 'component' AS dimension, component AS key FROM finding WHERE coalesce(component, '') <> ''
 UNION ALL SELECT analysis_id, finding_id, 'cve', regexp_extract(title, '(CVE[-\\w]+)', 1) FROM finding WHERE category = 'cve' AND regexp_matches(title, 'CVE[-\\w]+')
 UNION ALL SELECT analysis_id, finding_id, 'dependency', component FROM finding WHERE category = 'cve' AND coalesce(component, '') <> ''
 UNION ALL SELECT analysis_id, finding_id, 'native_library', component FROM finding WHERE category = 'native' AND coalesce(component, '') <> ''
 UNION ALL SELECT analysis_id, finding_id, 'sink', sink FROM finding JOIN sk USING (finding_id) WHERE coalesce(sink, '') <> '')"""
_CAUSE = (
    "CASE WHEN rule_id LIKE 'ANDROID-REACH-%' THEN CASE " + " ".join(f"WHEN contains(lower(title), '{w}') THEN '{n}'" for w, n in N.TITLE_CAUSE) + " ELSE 'EXPORTED_COMPONENT_INPUT' END "
    + " ".join(f"WHEN starts_with(rule_id, '{p}') THEN '{n}'" for p, n in N.PREFIX_CAUSE.items()) + " " + " ".join(f"WHEN rule_id = '{r}' THEN '{n}'" for r, n in N.RULE_CAUSE.items()) + " END"
)
_WHOLE = ", ".join(f"'{w}'" for w in N.WHOLE)
_SEV = ranks.ranked_sql("severity", {s: k for k, s in enumerate(ranks.SEVERITIES)}, 0)
_CONF = ranks.ranked_sql("confidence", ranks.CONFIDENCE_SCORE, 0)
_RC = f"""
rc AS (SELECT *, CASE WHEN cause IN ({_WHOLE}) THEN cause ELSE coalesce(nullif(component, ''), cause) END AS grouped_by FROM (SELECT *, {_CAUSE} AS cause FROM dd WHERE NOT is_duplicate) WHERE cause IS NOT NULL),
cause AS (SELECT analysis_id, cause, grouped_by, count(*) AS n_findings, arg_max(severity, {_SEV}) AS severity, arg_max(confidence, {_CONF}) AS confidence,
 coalesce(string_agg(DISTINCT component, ',' ORDER BY component) FILTER (WHERE component <> ''), '') AS components, coalesce(string_agg(DISTINCT component, ',' ORDER BY component) FILTER (WHERE component <> '' AND category = 'cve'), '') AS dependencies,
 string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, 'RC-' || cause || '-' || substr(sha256(analysis_id || '|' || cause || '|' || grouped_by), 1, 10) AS identifier FROM rc GROUP BY analysis_id, cause, grouped_by)"""


def deduplicated(spark, d):
    return N.deduplicated(N.fingerprinted(view(spark, d, "finding"), view(spark, d, "evidence")))


@query("finding_dedup", with_views(f"WITH {_FP} SELECT analysis_id, finding_id, primary_target, fingerprint, is_duplicate FROM dd", "finding", "evidence"))
def finding_dedup(spark, d):
    return deduplicated(spark, d).select("analysis_id", "finding_id", "primary_target", "fingerprint", "is_duplicate")


@query("correlation_groups", with_views(f"WITH {_DIMS} SELECT analysis_id, dimension, key, count(*) AS n, min(finding_id) AS first, max(finding_id) AS last FROM dm GROUP BY 1, 2, 3 HAVING count(*) > 1", "finding", "evidence"))
def correlation_groups(spark, d):
    return N.groups(N.dimensions(view(spark, d, "finding"), view(spark, d, "evidence")))


@query("correlated_peers", with_views(f"""WITH {_DIMS}, t AS (SELECT analysis_id, dimension, key, max(finding_id, 2) AS m FROM dm GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT d.analysis_id, d.dimension, d.key, d.finding_id, CASE WHEN d.finding_id = m[1] THEN m[2] ELSE m[1] END AS peer FROM dm d JOIN t USING (analysis_id, dimension, key)""", "finding", "evidence"))
def correlated_peers(spark, d):
    return N.peers(N.dimensions(view(spark, d, "finding"), view(spark, d, "evidence")))


@query("root_causes", with_views(f"WITH {_FP}, {_RC} SELECT * FROM cause", "finding", "evidence"))
def root_causes(spark, d):
    return N.root_causes(deduplicated(spark, d))


@query("severity_histogram", with_views("SELECT a.analysis_id, s.severity, CAST(count(f.finding_id) AS BIGINT) AS n FROM (SELECT DISTINCT analysis_id FROM finding) a CROSS JOIN (SELECT unnest(['info', 'low', 'medium', 'high', 'critical']) AS severity) s LEFT JOIN finding f ON f.analysis_id = a.analysis_id AND f.severity = s.severity GROUP BY 1, 2", "finding"))
def severity_histogram(spark, d):
    return N.severity_histogram(view(spark, d, "finding"))


@query("finding_summary", with_views(f"""WITH {_FP}, s AS (SELECT analysis_id, count(*) AS n, count(*) FILTER (WHERE is_duplicate) AS n_duplicates, count(*) FILTER (WHERE status = 'CONFIRMED_BY_STATIC_ANALYSIS') AS n_confirmed, count(*) FILTER (WHERE status = 'POTENTIAL') AS n_potential,
 count(*) FILTER (WHERE severity IN ('high', 'critical')) AS n_severe, count(DISTINCT rule_id) AS n_rules, CAST(floor(avg({ranks.ranked_sql("confidence", ranks.CONFIDENCE_SCORE, 30)}) FILTER (WHERE NOT is_duplicate)) AS BIGINT) AS confidence_score FROM dd GROUP BY analysis_id)
SELECT *, CASE WHEN confidence_score >= 80 THEN 'high' WHEN confidence_score >= 55 THEN 'medium' ELSE 'low' END AS confidence_label FROM s""", "finding", "evidence"))
def finding_summary(spark, d):
    return N.summary(deduplicated(spark, d))


@query("finding_page", with_views("SELECT finding_id, analysis_id, title, rule_id FROM finding WHERE severity = 'high' ORDER BY title, finding_id LIMIT 25 OFFSET 50", "finding"))
def finding_page(spark, d):
    return N.page(view(spark, d, "finding"), "high", 2)


@query("findings_bounded", with_views("SELECT analysis_id, rule_id, n_kept, truncated FROM (SELECT analysis_id, rule_id, CAST(least(count(*), 20) AS BIGINT) AS n_kept, CAST(greatest(count(*) - 20, 0) AS BIGINT) AS truncated FROM finding GROUP BY 1, 2)", "finding"))
def findings_bounded(spark, d):
    kept, left_out = N.capped(view(spark, d, "finding"), ["analysis_id", "rule_id"], ["finding_id"], 20)
    return kept.groupBy("analysis_id", "rule_id").agg(F.count("*").alias("n_kept")).join(left_out, ["analysis_id", "rule_id"])

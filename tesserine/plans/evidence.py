"""Queries on the layers of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.lineage import kept_counted
from ..functions.skew import sent
from ..operators import evidence as E
from ..operators import findings as N
from ..operators import vulnerabilities as V
from ..sources.bridge import table, view, with_views
from . import query
from .findings import _FP, _RC, deduplicated
from .vulnerabilities import _CORR, _STATES, _three

_STATE = "CASE WHEN exported THEN 'EXPORTED' WHEN NOT exported THEN 'INTERNAL' WHEN has_filter AND kind <> 'provider' THEN 'CONDITIONALLY_EXPORTED' WHEN kind = 'provider' THEN 'UNKNOWN' ELSE 'INTERNAL' END"
_EXPOSED = "CASE WHEN state = 'UNKNOWN' THEN 'UNKNOWN' WHEN state NOT IN ('EXPORTED', 'CONDITIONALLY_EXPORTED') THEN 'INTERNAL' WHEN coalesce(permission, '') <> '' THEN 'PERMISSION_PROTECTED' ELSE 'PUBLIC' END"
_KIND = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.SURFACE.items()) + " ELSE 'EXPORTED_COMPONENT' END"
_SURF = f"""
cp AS (SELECT *, {_EXPOSED} AS exposure FROM (SELECT *, {_STATE} AS state FROM component)),
sn AS (SELECT analysis_id, 'surface:component:' || name AS node_key, name AS component, {_KIND} AS node_type, exposure, permission FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, name ORDER BY component_id) AS n FROM cp WHERE exposure <> 'INTERNAL') WHERE n = 1)"""
_EDGES = """
ec AS (SELECT analysis_id, identifier, cause, unnest(string_split(components, ',')) AS component FROM cause),
se AS (SELECT n.analysis_id, n.node_key AS src, 'rootcause:' || identifier AS dst, 'LEADS_TO' AS edge_type, cause FROM sn n JOIN ec USING (analysis_id, component))"""
_WEIGHT = ranks.ranked_sql("name", {**E.RISK, **{k: -v for k, v in E.MITIGATION.items()}}, 0)
_BAND = "CASE WHEN raw >= 90 THEN 'critical' WHEN raw >= 70 THEN 'high' WHEN raw >= 40 THEN 'medium' WHEN raw >= 20 THEN 'low' ELSE 'info' END"


@query("exposure_ladder", with_views(f"WITH {_SURF} SELECT analysis_id, kind, state, exposure, count(*) AS n FROM cp GROUP BY 1, 2, 3, 4", "component"))
def exposure_ladder(spark, d):
    own = view(spark, d, "component").withColumn("state", ranks.exposure(F.col("exported"), F.col("has_filter"), F.col("kind")))
    return own.withColumn("exposure", ranks.surface_exposure(F.col("state"), F.col("permission"))).groupBy("analysis_id", "kind", "state", "exposure").agg(F.count("*").alias("n"))


@query("permission_classification", with_views(f"""SELECT name, CASE WHEN NOT starts_with(name, 'android.permission.') THEN 'UNKNOWN' WHEN replace(name, 'android.permission.', '') IN {ranks.DANGEROUS} THEN 'DANGEROUS' WHEN replace(name, 'android.permission.', '') IN {ranks.SIGNATURE} THEN 'SIGNATURE' ELSE 'NORMAL' END AS class, count(*) AS n FROM permission GROUP BY 1, 2""", "permission"))
def permission_classification(spark, d):
    return view(spark, d, "permission").groupBy("name", ranks.permission_class(F.col("name")).alias("class")).agg(F.count("*").alias("n"))


@query("attack_surface", with_views(f"WITH {_SURF} SELECT * FROM sn", "component"))
def attack_surface(spark, d):
    return E.surface(view(spark, d, "component"))


def _edges(spark, d):
    nodes = attack_surface(spark, d)
    return nodes, E.surface_edges(nodes, N.root_causes(deduplicated(spark, d)))


@query("attack_surface_edges", with_views(f"WITH {_FP}, {_RC}, {_SURF}, {_EDGES} SELECT * FROM se", "component", "finding", "evidence"))
def attack_surface_edges(spark, d):
    return _edges(spark, d)[1]


@query("risk_entry_points", with_views(f"""WITH {_FP}, {_RC}, {_SURF}, {_EDGES}, f AS (SELECT analysis_id, node_key, 'exported_component' AS name FROM sn UNION ALL SELECT analysis_id, node_key, 'permission_protected' FROM sn WHERE exposure = 'PERMISSION_PROTECTED'
 UNION ALL SELECT analysis_id, src, {"CASE cause " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.CAUSE_FACTOR.items()) + " ELSE 'sensitive_sink_reachable' END"} FROM se),
g AS (SELECT analysis_id, node_key, sum({_WEIGHT}) AS raw, string_agg(DISTINCT name, ',' ORDER BY name) AS factors FROM f GROUP BY 1, 2)
SELECT analysis_id, node_key, CAST(greatest(0, least(100, raw)) AS INTEGER) AS score, {_BAND} AS band, factors FROM g""", "component", "finding", "evidence"))
def risk_entry_points(spark, d):
    return E.risk(E.entry_factors(*_edges(spark, d)), "analysis_id", "node_key")


_OVERALL = """
fa AS (SELECT DISTINCT analysis_id, 'exported_component' AS name FROM sn UNION SELECT DISTINCT analysis_id, 'missing_permission_protection' FROM dd WHERE NOT is_duplicate AND rule_id = 'ANDROID-COMPONENT-001'
 UNION SELECT DISTINCT analysis_id, 'webview_javascript' FROM dd WHERE NOT is_duplicate AND rule_id = 'ANDROID-WEBVIEW-001' UNION SELECT DISTINCT analysis_id, 'javascript_interface' FROM dd WHERE NOT is_duplicate AND rule_id IN ('ANDROID-WEBVIEW-002', 'ANDROID-SEMANTIC-004')
 UNION SELECT DISTINCT analysis_id, 'native_unsafe_api' FROM dd WHERE NOT is_duplicate AND starts_with(rule_id, 'ASF-NATIVE-') UNION SELECT DISTINCT analysis_id, 'weak_crypto' FROM dd WHERE NOT is_duplicate AND rule_id = 'ANDROID-CRYPTO-001'
 UNION SELECT DISTINCT analysis_id, 'cleartext_network' FROM dd WHERE NOT is_duplicate AND rule_id = 'ANDROID-MANIFEST-003' UNION SELECT DISTINCT analysis_id, 'unknown_dependency_version' FROM dependency WHERE coalesce(version, '') IN ('', 'UNKNOWN')
 UNION SELECT analysis_id, 'permission_protected' FROM sn GROUP BY analysis_id HAVING bool_and(exposure = 'PERMISSION_PROTECTED'))"""


@query("risk_overall", with_views(f"""WITH {_FP}, {_SURF}, {_OVERALL}, g AS (SELECT analysis_id, sum({_WEIGHT}) AS raw, string_agg(DISTINCT name, ',' ORDER BY name) AS factors FROM fa GROUP BY 1)
SELECT analysis_id, CAST(greatest(0, least(100, raw)) AS INTEGER) AS score, {_BAND} AS band, factors FROM g""", "component", "finding", "evidence", "dependency"))
def risk_overall(spark, d):
    nodes = attack_surface(spark, d)
    rule = F.col("rule_id")
    by_rule = F.array(
        F.when(rule == "ANDROID-COMPONENT-001", "missing_permission_protection"), F.when(rule == "ANDROID-WEBVIEW-001", "webview_javascript"), F.when(rule.isin("ANDROID-WEBVIEW-002", "ANDROID-SEMANTIC-004"), "javascript_interface"),
        F.when(rule.startswith("ASF-NATIVE-"), "native_unsafe_api"), F.when(rule == "ANDROID-CRYPTO-001", "weak_crypto"), F.when(rule == "ANDROID-MANIFEST-003", "cleartext_network"),
    )
    rules = deduplicated(spark, d).where(~F.col("is_duplicate")).select("analysis_id", F.explode(F.filter(by_rule, lambda n: n.isNotNull())).alias("name"))
    per = nodes.groupBy("analysis_id").agg(F.bool_and(F.col("exposure") == "PERMISSION_PROTECTED").alias("guarded"))
    exposed = per.select("analysis_id", F.explode(F.filter(F.array(F.lit("exported_component"), F.when(F.col("guarded"), "permission_protected")), lambda n: n.isNotNull())).alias("name"))
    versions = view(spark, d, "dependency").where(F.coalesce("version", F.lit("")).isin("", "UNKNOWN")).select("analysis_id", F.lit("unknown_dependency_version").alias("name"))
    return E.risk(rules.unionByName(exposed).unionByName(versions).distinct(), "analysis_id")


@query("runtime_taxonomy", with_views(f"SELECT {ranks.observed_kind_sql()} AS kind, adapter, count(*) AS n FROM observation GROUP BY 1, 2", "observation"))
def runtime_taxonomy(spark, d):
    kind = ranks.observed_kind(*(F.col(c) for c in ("observation_type", "class_name", "method_name", "symbol")))
    return view(spark, d, "observation").groupBy(kind.alias("kind"), "adapter").agg(F.count("*").alias("n"))


_METHODS = "me AS (SELECT DISTINCT lower(regexp_extract(class_name, '[^.]*$')) AS k_class, lower(method_name) AS k_method, class_name || '#' || method_name AS node_key FROM observation)"


@query("runtime_correlation", with_views(f"WITH {_METHODS} SELECT obs_id, coalesce(node_key, 'RUNTIME_BEHAVIOR') AS target, node_key IS NOT NULL AS linked FROM observation o LEFT JOIN me ON lower(regexp_extract(o.class_name, '[^.]*$')) = k_class AND lower(o.method_name) = k_method", "observation"))
def runtime_correlation(spark, d):
    own = view(spark, d, "observation")
    methods = own.select("class_name", "method_name", F.concat("class_name", F.lit("#"), "method_name").alias("node_key")).distinct()
    return E.runtime_links(own, methods)


@query("runtime_modes", with_views("SELECT session_id, count(*) AS n, CASE WHEN bool_or(adapter <> 'mock') THEN 'LIVE' WHEN bool_or(adapter = 'mock') THEN 'MOCKED' ELSE 'UNAVAILABLE' END AS mode FROM observation GROUP BY 1", "observation"))
def runtime_modes(spark, d):
    return E.session_modes(view(spark, d, "observation"))


@query("runtime_timeline", with_views("SELECT obs_id, session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, obs_id) AS INTEGER) AS sequence FROM observation", "observation"))
def runtime_timeline(spark, d):
    return E.timeline(view(spark, d, "observation")).select("obs_id", "session_id", "sequence")


@query("latest_per_session", with_views("SELECT session_id, obs_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, obs_id DESC) AS n FROM observation) WHERE n = 1", "observation"))
def latest_per_session(spark, d):
    return V.latest(view(spark, d, "observation"), "session_id", F.desc("ts"), F.desc("obs_id")).select("session_id", "obs_id", "event_type")


@query("jni_bindings", """WITH e AS (SELECT DISTINCT 'C' || CAST(p_partkey % 300 AS VARCHAR) AS class_name, 'm' || CAST(p_size % 5 AS VARCHAR) AS method_name, 'lib' || CAST(p_partkey % 3 AS VARCHAR) || '.so' AS library FROM part),
n AS (SELECT DISTINCT 'C' || CAST(s_suppkey % 400 AS VARCHAR) AS class_name, 'm' || CAST(s_nationkey % 5 AS VARCHAR) AS method_name FROM supplier)
SELECT coalesce(e.class_name, n.class_name) AS class_name, coalesce(e.method_name, n.method_name) AS method_name, library, CASE WHEN library IS NOT NULL THEN 'ELF_EXPORT' ELSE 'JAVA_NATIVE' END AS source,
 CASE WHEN library IS NOT NULL AND n.class_name IS NOT NULL THEN 'HIGH' WHEN library IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM e FULL OUTER JOIN n ON e.class_name = n.class_name AND e.method_name = n.method_name""")
def jni_bindings(spark, d):
    named = lambda c, k, m: (F.concat(F.lit("C"), (F.col(c) % k).cast("string")).alias("class_name"), F.concat(F.lit("m"), (F.col(m) % 5).cast("string")).alias("method_name"))
    exports = table(spark, d, "part").select(*named("p_partkey", 300, "p_size"), F.concat(F.lit("lib"), (F.col("p_partkey") % 3).cast("string"), F.lit(".so")).alias("library"))
    return E.jni_bindings(exports, table(spark, d, "supplier").select(*named("s_suppkey", 400, "s_nationkey")))


@query("native_reconcile", """WITH f AS (SELECT 'lib' || CAST(p_partkey % 50 AS VARCHAR) AS library, 'fn' || CAST(p_partkey % 700 AS VARCHAR) AS name, p_partkey AS address, 'ELF' AS source FROM part 
 UNION ALL SELECT 'lib' || CAST(p_partkey % 50 AS VARCHAR), 'fn' || CAST(p_partkey % 350 AS VARCHAR), p_partkey + 7, 'GHIDRA' FROM part)
SELECT library, name, string_agg(DISTINCT source, '+' ORDER BY source) AS source, coalesce(min(address) FILTER (WHERE source = 'ELF'), min(address)) AS address FROM f GROUP BY 1, 2""")
def native_reconcile(spark, d):
    parts = table(spark, d, "part")
    rows = lambda df, k, shift: df.select(F.concat(F.lit("lib"), (F.col("p_partkey") % 50).cast("string")).alias("library"), F.concat(F.lit("fn"), (F.col("p_partkey") % k).cast("string")).alias("name"), (F.col("p_partkey") + shift).alias("address"))
    return E.reconciled(rows(parts, 700, 0), rows(parts, 350, 7))


_NAMES = """nm AS (SELECT 'pk' || CAST(p_partkey % 211 AS VARCHAR) AS analysis_id, CASE WHEN p_partkey % 4 = 0 THEN 'method' ELSE 'class' END AS kind,
 CASE WHEN p_size < 10 + p_partkey % 211 % 40 THEN 'a' || CAST(p_size % 10 AS VARCHAR) ELSE p_name END AS name, CASE WHEN p_partkey % 211 % 3 = 0 THEN 'com.x.' || CAST(p_size % 20 AS VARCHAR) ELSE 'com.large' END AS package FROM part)"""


@query("obfuscation_identifier_ratio", f"""WITH {_NAMES}, s AS (SELECT *, trim(name) <> '' AND (length(trim(name)) <= 2 OR regexp_matches(trim(name), '{E.GENERATED}')) AS short,
 CASE WHEN package <> '' AND len(list_filter(string_split(package, '.'), lambda p: length(p) <= 1)) > 0 AND kind = 'class' THEN package END AS flat FROM nm),
n AS (SELECT analysis_id, count(*) FILTER (WHERE kind = 'class') AS n_classes, count(*) FILTER (WHERE kind = 'method') AS n_methods, count(*) FILTER (WHERE kind = 'class' AND short) AS n_short_classes,
 count(*) FILTER (WHERE kind = 'method' AND short) AS m, count(DISTINCT flat) AS n_flat_packages FROM s GROUP BY 1),
t AS (SELECT *, CASE WHEN n_classes = 0 THEN 'UNAVAILABLE' WHEN n_classes < 8 THEN 'INSUFFICIENT_CLASSES' WHEN n_short_classes * 2 >= n_classes THEN 'STRONG_INDICATOR' WHEN n_short_classes * 4 >= n_classes THEN 'WEAK_INDICATOR' ELSE 'NO_INDICATOR' END AS state FROM n)
SELECT analysis_id, n_classes, n_methods, n_short_classes, n_flat_packages, CASE WHEN n_classes > 0 THEN round(n_short_classes / n_classes, 3) ELSE 0 END AS class_share, CASE WHEN n_methods > 0 THEN round(m / n_methods, 3) ELSE 0 END AS method_share, state,
 CASE state WHEN 'STRONG_INDICATOR' THEN 'HIGH' WHEN 'WEAK_INDICATOR' THEN CASE WHEN n_flat_packages > 0 THEN 'MEDIUM' ELSE 'LOW' END END AS confidence FROM t""")
def obfuscation_identifier_ratio(spark, d):
    k = F.col("p_partkey") % 211
    named = F.when(F.col("p_size") < 10 + k % 40, F.concat(F.lit("a"), (F.col("p_size") % 10).cast("string"))).otherwise(F.col("p_name"))
    package = F.when(k % 3 == 0, F.concat(F.lit("com.x."), (F.col("p_size") % 20).cast("string"))).otherwise("com.large")
    kind = F.when(F.col("p_partkey") % 4 == 0, "method").otherwise("class")
    return E.name_shares(table(spark, d, "part").select(F.concat(F.lit("pk"), k.cast("string")).alias("analysis_id"), kind.alias("kind"), named.alias("name"), package.alias("package")))


_FIXES = "fx AS (SELECT product_id, true AS known FROM version_range WHERE fixed IS NOT NULL OR raw LIKE '%<%' GROUP BY 1)"


#: Of a product's records the largest epss counts, and any that says it is exploited.
_ITEMS = f"""
vu AS (SELECT record_id % 1000000 AS product_id, bool_or(coalesce(known_exploited, false)) AS kev, max(epss) AS epss FROM vulnerability GROUP BY 1),
ms AS (SELECT cs.*, {_CORR} AS correlation_state, CASE dep_id % 3 WHEN 0 THEN 'REACHABLE' WHEN 1 THEN 'NOT_REACHABLE' ELSE 'UNKNOWN' END AS reachability_state, CASE dep_id % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS identity_confidence FROM cs),
r AS (SELECT ms.*, coalesce(known, false) AS known, coalesce(kev, false) AS kev, coalesce(epss, 0) AS epss FROM ms LEFT JOIN fx USING (product_id) LEFT JOIN vu USING (product_id) WHERE version_state <> 'NOT_AFFECTED'),
si AS (SELECT analysis_id, dep_id, cve_id, CASE WHEN version_state = 'AFFECTED' AND known THEN 'RECOMMENDED' WHEN version_state = 'AFFECTED' THEN 'REVIEW_REQUIRED' WHEN version_state = 'POSSIBLY_AFFECTED' AND known THEN 'CONDITIONALLY_RECOMMENDED' ELSE 'VERSION_UNVERIFIED' END AS status,
 CASE WHEN version_state = 'AFFECTED' AND known THEN 'DIRECT_FIX' WHEN version_state = 'AFFECTED' THEN 'UNKNOWN_FIX' ELSE 'CONDITIONAL_FIX' END AS fixability,
 CAST(greatest(0, CASE WHEN correlation_state = 'AFFECTED_REACHABLE' THEN 40 WHEN correlation_state IN ('PRESENT_AFFECTED', 'AFFECTED_NOT_REACHABLE') THEN 25 WHEN version_state = 'POSSIBLY_AFFECTED' THEN 12 ELSE 0 END
  + CASE WHEN identity_confidence IN ('EXACT', 'HIGH') THEN 10 ELSE 0 END + CASE reachability_state WHEN 'REACHABLE' THEN 15 WHEN 'NOT_REACHABLE' THEN -10 ELSE 0 END + CASE WHEN known THEN 8 ELSE 0 END + CASE WHEN kev THEN 20 ELSE 0 END + CASE WHEN epss >= 0.5 THEN 10 ELSE 0 END) AS INTEGER) AS score FROM r),
it AS (SELECT *, CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 45 THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' WHEN score >= 10 THEN 'LOW' WHEN score >= 1 THEN 'INFO' WHEN status IN ('VERSION_UNVERIFIED', 'REVIEW_REQUIRED') THEN 'UNDETERMINED' ELSE 'INFO' END AS priority FROM si)"""


def _matches(spark, d, also=()):
    """Matches with reach and identity, which the domain tables give by dependency."""
    k = F.col("dep_id")
    reach = F.when(k % 3 == 0, "REACHABLE").when(k % 3 == 1, "NOT_REACHABLE").otherwise("UNKNOWN")
    identity = F.when(k % 4 == 0, "EXACT").when(k % 4 == 1, "HIGH").when(k % 4 == 2, "MEDIUM").otherwise("LOW")
    return V.correlated(*_three(spark, d), also).withColumns({"reachability_state": reach, "identity_confidence": identity})


def _items(spark, d):
    intel = view(spark, d, "vulnerability").groupBy((F.col("record_id") % 1000000).alias("product_id")).agg(F.bool_or(F.coalesce("known_exploited", F.lit(False))).alias("known_exploited"), F.max("epss").alias("epss"))
    intel, n = kept_counted(intel, "intel")
    fixes, n_fixes = kept_counted(V.fixed_versions(view(spark, d, "version_range")), "fixes")
    return E.remediation_items(_matches(spark, d).join(sent(intel, n), "product_id", "left"), sent(fixes, n_fixes))


@query("remediation_plan", with_views(f"WITH {_STATES}, {_FIXES}, {_ITEMS} SELECT * FROM it", "dependency", "product", "version_range", "vulnerability"))
def remediation_plan(spark, d):
    return _items(spark, d).drop("fixed_versions")


@query("remediation_merged", with_views(f"""WITH {_STATES}, {_FIXES}, {_ITEMS}, m AS (SELECT *, CASE status WHEN 'RECOMMENDED' THEN 4 WHEN 'CONDITIONALLY_RECOMMENDED' THEN 3 WHEN 'REVIEW_REQUIRED' THEN 2 ELSE 1 END AS k FROM it)
SELECT analysis_id, cve_id, arg_min(fixability, dep_id) AS action, arg_max(status, k) AS status, max(score) AS score, count(*) AS n_merged, string_agg(DISTINCT CAST(dep_id AS VARCHAR), ',' ORDER BY CAST(dep_id AS VARCHAR)) AS evidence FROM m GROUP BY 1, 2""", "dependency", "product", "version_range", "vulnerability"))
def remediation_merged(spark, d):
    """Of each analysis and CVE one item, with the dependencies as evidence."""
    rows = _items(spark, d).withColumns({"action": F.col("fixability"), "ord": F.col("dep_id"), "evidence": F.col("dep_id")})
    return E.merged_items(rows, ["analysis_id", "cve_id"])


@query("cvss_bands", with_views("SELECT source, CASE WHEN cvss >= 9 THEN 'CRITICAL' WHEN cvss >= 7 THEN 'HIGH' WHEN cvss >= 4 THEN 'MEDIUM' WHEN cvss > 0 THEN 'LOW' WHEN cvss = 0 THEN 'NONE' END AS band, count(*) AS n FROM vulnerability GROUP BY 1, 2", "vulnerability"))
def cvss_bands(spark, d):
    return view(spark, d, "vulnerability").groupBy("source", ranks.cvss_band(F.col("cvss")).alias("band")).agg(F.count("*").alias("n"))


_CLAIMS = f"""
ev AS (SELECT 'U' || CAST(user_id AS VARCHAR) || ':' || CAST(event_id % 4 AS VARCHAR) AS claim, CASE event_id % 5 WHEN 0 THEN 'RUNTIME' WHEN 1 THEN 'STATIC_CODE' WHEN 2 THEN 'STATIC_MANIFEST' WHEN 3 THEN 'STATIC_REACHABILITY' ELSE 'STATIC_NATIVE' END AS family, user_id % 3 > 0 AS live,
 value > 60 AS direct, CASE WHEN event_id % 401 = 0 THEN 'MISSING_VERSION' WHEN event_id % 307 = 0 THEN 'AMBIGUOUS_IDENTITY' WHEN event_id % 211 = 0 THEN 'UNKNOWN_NATIVE_TARGET' END AS blocker, user_id % 4 = 0 AS sure, user_id % 5 > 0 AS version_known, user_id % 7 = 0 AS possibly, user_id % 11 = 0 AS unreached FROM events),
pc AS (SELECT claim, count(DISTINCT CASE WHEN family <> 'RUNTIME' OR live THEN family END) AS n_families, bool_or(family = 'RUNTIME' AND live) AS live, bool_or(direct) AS direct, bool_or(family = 'STATIC_REACHABILITY') AS path, count(*) AS n_evidence,
 coalesce(bool_or(blocker = 'MISSING_VERSION'), false) AS b1, coalesce(bool_or(blocker = 'AMBIGUOUS_IDENTITY'), false) AS b2, coalesce(bool_or(blocker = 'UNKNOWN_NATIVE_TARGET'), false) AS b3, bool_or(sure) AS sure, bool_or(version_known) AS version_known, bool_or(possibly) AS possibly, bool_or(unreached) AS unreached FROM ev GROUP BY 1),
cl AS (SELECT claim, n_families, n_evidence, CASE WHEN n_families = 0 THEN 'UNVERIFIED' WHEN b1 THEN 'VALIDATION_BLOCKED' WHEN n_families >= 2 THEN 'MULTI_SOURCE_CORROBORATED' WHEN live THEN 'RUNTIME_CORROBORATED' ELSE 'STATIC_SUPPORTED' END AS state,
 CAST(greatest(0, least(100, 40 + 15 * greatest(n_families - 1, 0) + CASE WHEN direct THEN 10 ELSE 0 END + CASE WHEN live THEN 20 ELSE 0 END + CASE WHEN path THEN 10 ELSE 0 END + CASE WHEN sure THEN 10 ELSE 0 END + CASE WHEN version_known THEN 10 ELSE 0 END
  - CASE WHEN b1 THEN 15 ELSE 0 END - CASE WHEN b2 THEN 10 ELSE 0 END - CASE WHEN b3 THEN 10 ELSE 0 END - CASE WHEN unreached THEN 10 ELSE 0 END - CASE WHEN possibly THEN 10 ELSE 0 END)) AS INTEGER) AS confidence FROM pc)"""


def _claims(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    family = F.when(e % 5 == 0, "RUNTIME").when(e % 5 == 1, "STATIC_CODE").when(e % 5 == 2, "STATIC_MANIFEST").when(e % 5 == 3, "STATIC_REACHABILITY").otherwise("STATIC_NATIVE")
    blocker = F.when(e % 401 == 0, "MISSING_VERSION").when(e % 307 == 0, "AMBIGUOUS_IDENTITY").when(e % 211 == 0, "UNKNOWN_NATIVE_TARGET")
    made = table(spark, d, "events").select(
        F.concat(F.lit("U"), u.cast("string"), F.lit(":"), (e % 4).cast("string")).alias("claim"), family.alias("family"), (u % 3 > 0).alias("live"), (F.col("value") > 60).alias("direct"), blocker.alias("blocker"),
        F.when(u % 4 == 0, "HIGH").otherwise("LOW").alias("identity"), (u % 5 > 0).alias("version_known"), F.when(u % 7 == 0, "POSSIBLY_AFFECTED").otherwise("AFFECTED").alias("version_state"), F.when(u % 11 == 0, "NOT_REACHABLE").otherwise("UNKNOWN").alias("reach"),
    )
    return E.claims(made)


@query("validation_claims", f"WITH {_CLAIMS} SELECT * FROM cl")
def validation_claims(spark, d):
    return _claims(spark, d)


_ROLL = f"""
ro AS (SELECT split_part(claim, ':', 1) AS parent, count(*) AS n_claims, arg_max(state, {"CASE state " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(E.CLAIM_ORDER)) + " END"}) AS state, max(confidence) AS confidence FROM cl GROUP BY 1)"""


@query("validation_rollup", f"WITH {_CLAIMS}, {_ROLL} SELECT * FROM ro")
def validation_rollup(spark, d):
    return E.rolled_up(_claims(spark, d), F.split_part("claim", F.lit(":"), F.lit(1)))


_DECIDE = f"""
de AS (SELECT dd.*, coalesce(ro.state, 'UNVERIFIED') AS state FROM dd LEFT JOIN ro ON ro.parent = 'U' || CAST(CAST(substr(component, 2) AS INTEGER) AS VARCHAR)),
du AS (SELECT analysis_id, finding_id, category, CASE WHEN is_duplicate THEN 'R-FIND-DUP' WHEN status = 'CONFIRMED_BY_STATIC_ANALYSIS' THEN 'R-FIND-STATIC-CONFIRMED' WHEN state = 'MULTI_SOURCE_CORROBORATED' THEN 'R-FIND-MULTI' WHEN state = 'RUNTIME_CORROBORATED' THEN 'R-FIND-RUNTIME'
 WHEN state = 'STATIC_SUPPORTED' THEN 'R-FIND-STATIC-SUPPORTED' WHEN state = 'VALIDATION_BLOCKED' THEN 'R-FIND-BLOCKED' WHEN status IS NULL OR status IN ('POTENTIAL', 'REVIEW_REQUIRED') THEN 'R-FIND-UNVERIFIED' ELSE 'R-FIND-INCONCLUSIVE' END AS rule FROM de),
dz AS (SELECT *, CASE rule WHEN 'R-FIND-DUP' THEN 'SUPERSEDED' WHEN 'R-FIND-STATIC-CONFIRMED' THEN 'CONFIRMED' WHEN 'R-FIND-MULTI' THEN 'STRONGLY_SUPPORTED' WHEN 'R-FIND-RUNTIME' THEN 'STRONGLY_SUPPORTED' WHEN 'R-FIND-STATIC-SUPPORTED' THEN 'SUPPORTED' WHEN 'R-FIND-BLOCKED' THEN 'BLOCKED' WHEN 'R-FIND-UNVERIFIED' THEN 'UNVERIFIED' ELSE 'INCONCLUSIVE' END AS decision,
 CASE rule WHEN 'R-FIND-STATIC-CONFIRMED' THEN 'FINDING_CONFIRMED' WHEN 'R-FIND-MULTI' THEN 'FINDING_SUPPORTED' WHEN 'R-FIND-RUNTIME' THEN 'FINDING_SUPPORTED' WHEN 'R-FIND-STATIC-SUPPORTED' THEN 'FINDING_SUPPORTED' WHEN 'R-FIND-BLOCKED' THEN 'FINDING_BLOCKED' WHEN 'R-FIND-UNVERIFIED' THEN 'FINDING_UNVERIFIED' ELSE 'FINDING_INCONCLUSIVE' END AS conclusion FROM du)"""


def _decided(spark, d):
    rolled = validation_rollup(spark, d).select("parent", "state")
    own = deduplicated(spark, d).withColumns({"parent": F.concat(F.lit("U"), F.substring("component", 2, 9)), "confirmed": F.lit(False)})
    return E.decisions(own.join(rolled, "parent", "left"))


@query("assessment_decisions", with_views(f"WITH {_FP}, {_CLAIMS}, {_ROLL}, {_DECIDE} SELECT analysis_id, finding_id, rule, conclusion, decision FROM dz", "finding", "evidence"))
def assessment_decisions(spark, d):
    return _decided(spark, d).select("analysis_id", "finding_id", "rule", "conclusion", "decision")


@query("assessment_summary", with_views(f"WITH {_FP}, {_CLAIMS}, {_ROLL}, {_DECIDE} SELECT decision, rule, category, count(*) AS n FROM dz GROUP BY GROUPING SETS ((decision), (rule), (category))", "finding", "evidence"))
def assessment_summary(spark, d):
    return E.decision_summary(_decided(spark, d))


_CVE_RULES = """
cd AS (SELECT analysis_id, dep_id, cve_id, CASE WHEN version_state = 'NOT_AFFECTED' THEN 'R-CVE-NOT-AFFECTED' WHEN version_state = 'AFFECTED' AND reachability_state = 'REACHABLE' AND identity_confidence IN ('EXACT', 'HIGH') THEN 'R-CVE-AFFECTED-REACHABLE' WHEN version_state = 'AFFECTED' THEN 'R-CVE-AFFECTED'
 WHEN reachability_state = 'NOT_REACHABLE' THEN 'R-CVE-NOT-REACHABLE' WHEN version_state IN ('POSSIBLY_AFFECTED', 'PRESENT_UNKNOWN_VERSION', 'UNKNOWN') THEN 'R-CVE-VERSION-UNVERIFIED' ELSE 'R-CVE-INSUFFICIENT' END AS rule, identity_confidence IN ('EXACT', 'HIGH') AS sure FROM ms),
ce AS (SELECT analysis_id, dep_id, cve_id, rule, CASE rule WHEN 'R-CVE-NOT-AFFECTED' THEN 'CVE_NOT_AFFECTED' WHEN 'R-CVE-AFFECTED-REACHABLE' THEN 'CVE_CONFIRMED' WHEN 'R-CVE-AFFECTED' THEN 'CVE_POSSIBLY_RELEVANT' WHEN 'R-CVE-NOT-REACHABLE' THEN 'CVE_NOT_REACHABLE' WHEN 'R-CVE-VERSION-UNVERIFIED' THEN 'CVE_VERSION_UNVERIFIED' ELSE 'CVE_EVIDENCE_INSUFFICIENT' END AS conclusion,
 CASE rule WHEN 'R-CVE-NOT-AFFECTED' THEN 'NOT_APPLICABLE' WHEN 'R-CVE-AFFECTED-REACHABLE' THEN 'STRONGLY_SUPPORTED' WHEN 'R-CVE-AFFECTED' THEN 'SUPPORTED' WHEN 'R-CVE-NOT-REACHABLE' THEN 'REQUIRES_REVIEW' WHEN 'R-CVE-VERSION-UNVERIFIED' THEN CASE WHEN sure THEN 'CONDITIONALLY_SUPPORTED' ELSE 'UNVERIFIED' END ELSE 'INCONCLUSIVE' END AS decision FROM cd)"""


@query("assessment_cve_decisions", with_views(f"WITH {_STATES}, {_FIXES}, {_ITEMS}, {_CVE_RULES} SELECT * FROM ce", "dependency", "product", "version_range", "vulnerability"))
def assessment_cve_decisions(spark, d):
    return E.cve_decisions(_matches(spark, d)).select("analysis_id", "dep_id", "cve_id", "rule", "conclusion", "decision")


_REM_RULES = """
rd AS (SELECT analysis_id, dep_id, cve_id, CASE status WHEN 'RECOMMENDED' THEN 'R-REM-RECOMMENDED' WHEN 'CONDITIONALLY_RECOMMENDED' THEN 'R-REM-CONDITIONAL' WHEN 'REVIEW_REQUIRED' THEN 'R-REM-REVIEW' ELSE 'R-REM-VERSION-UNVERIFIED' END AS rule,
 CASE status WHEN 'RECOMMENDED' THEN 'REMEDIATION_RECOMMENDED' WHEN 'CONDITIONALLY_RECOMMENDED' THEN 'REMEDIATION_CONDITIONAL' WHEN 'REVIEW_REQUIRED' THEN 'REMEDIATION_REQUIRES_REVIEW' ELSE 'REMEDIATION_STATUS_UNVERIFIED' END AS conclusion,
 CASE status WHEN 'RECOMMENDED' THEN 'SUPPORTED' WHEN 'CONDITIONALLY_RECOMMENDED' THEN 'CONDITIONALLY_SUPPORTED' WHEN 'REVIEW_REQUIRED' THEN 'REQUIRES_REVIEW' ELSE 'UNVERIFIED' END AS decision FROM it)"""


@query("assessment_remediation_decisions", with_views(f"WITH {_STATES}, {_FIXES}, {_ITEMS}, {_REM_RULES} SELECT * FROM rd", "dependency", "product", "version_range", "vulnerability"))
def assessment_remediation_decisions(spark, d):
    return E.remediation_decisions(_items(spark, d)).select("analysis_id", "dep_id", "cve_id", "rule", "conclusion", "decision")


@query("assessment_runtime_decisions", """WITH r AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'MOCKED' WHEN 1 THEN 'LIVE' END AS mode, count(*) FILTER (WHERE value > 99) AS n FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN mode = 'LIVE' AND n > 0 THEN 'R-RT-LIVE-CORROBORATED' WHEN mode = 'LIVE' THEN 'R-RT-LIVE-NOT-OBSERVED' WHEN mode = 'MOCKED' THEN 'R-RT-MOCKED' ELSE 'R-RT-UNAVAILABLE' END AS rule,
 CASE WHEN mode = 'LIVE' AND n > 0 THEN 'SUPPORTED' WHEN mode = 'LIVE' THEN 'REQUIRES_REVIEW' WHEN mode = 'MOCKED' THEN 'UNVERIFIED' ELSE 'INCONCLUSIVE' END AS decision FROM r""")
def assessment_runtime_decisions(spark, d):
    mode = F.when(F.col("user_id") % 3 == 0, "MOCKED").when(F.col("user_id") % 3 == 1, "LIVE")
    runs = table(spark, d, "events").groupBy("user_id", mode.alias("mode")).agg(F.count_if(F.col("value") > 99).alias("live_claim_count"))
    return E.runtime_decisions(runs).select("user_id", "rule", "decision")


@query("assessment_native_decisions", """WITH v AS (SELECT s_nationkey AS analysis_id, CASE WHEN s_nationkey % 4 = 0 THEN 'ELF_ONLY' ELSE 'ELF_AND_DISASSEMBLY' END AS mode, count(*) FILTER (WHERE s_acctbal > 9900) AS n_live, count(*) FILTER (WHERE s_acctbal > 9000 AND s_nationkey % 2 = 1) AS n_reached, count(*) FILTER (WHERE s_acctbal > 2000) AS n_present FROM supplier GROUP BY 1, 2)
SELECT analysis_id, CASE WHEN n_live > 0 THEN 'R-NAT-LIVE-INVOKED' WHEN n_reached > 0 THEN 'R-NAT-REACHED' WHEN mode = 'ELF_ONLY' THEN 'R-NAT-ELF-ONLY' WHEN n_present > 0 THEN 'R-NAT-PRESENT' ELSE 'R-NAT-NONE' END AS rule,
 CASE WHEN n_live > 0 OR n_reached > 0 THEN 'SUPPORTED' WHEN mode = 'ELF_ONLY' THEN 'INCONCLUSIVE' WHEN n_present > 0 THEN 'UNVERIFIED' ELSE 'INCONCLUSIVE' END AS decision FROM v""")
def assessment_native_decisions(spark, d):
    k, b = F.col("s_nationkey"), F.col("s_acctbal")
    views = table(spark, d, "supplier").groupBy(k.alias("analysis_id"), F.when(k % 4 == 0, "ELF_ONLY").otherwise("ELF_AND_DISASSEMBLY").alias("mode")).agg(F.count_if(b > 9900).alias("n_live"), F.count_if((b > 9000) & (k % 2 == 1)).alias("n_reached"), F.count_if(b > 2000).alias("n_present"))
    return E.native_decisions(views).select("analysis_id", "rule", "decision")


@query("assessment_overall", with_views(f"""WITH {_FP}, {_CLAIMS}, {_ROLL}, {_DECIDE}, {_STATES}, {_FIXES}, {_ITEMS}, {_CVE_RULES}, {_REM_RULES},
al AS (SELECT analysis_id, conclusion, decision FROM dz UNION ALL SELECT analysis_id, conclusion, decision FROM ce UNION ALL SELECT analysis_id, conclusion, decision FROM rd),
g AS (SELECT analysis_id, count(*) FILTER (WHERE conclusion IN {E.RELEVANT_CONCLUSIONS}) AS relevant, count(*) FILTER (WHERE decision IN {E.OPEN_DECISIONS}) AS open, count(*) FILTER (WHERE decision IN ('BLOCKED', 'UNVERIFIED')) AS incomplete FROM al GROUP BY 1)
SELECT analysis_id, 'R-ASSESS-RELEVANT' AS rule, 'SUPPORTED' AS decision FROM g WHERE relevant > 0 UNION ALL SELECT analysis_id, 'R-ASSESS-REVIEW', 'REQUIRES_REVIEW' FROM g WHERE open > 0 UNION ALL SELECT analysis_id, 'R-ASSESS-INCOMPLETE', 'INCONCLUSIVE' FROM g WHERE open > 0
UNION ALL SELECT analysis_id, 'R-ASSESS-VALIDATION-INCOMPLETE', 'INCONCLUSIVE' FROM g WHERE incomplete > 0 UNION ALL SELECT analysis_id, 'R-ASSESS-INCONCLUSIVE', 'INCONCLUSIVE' FROM g WHERE open > 0 UNION ALL SELECT analysis_id, 'R-ASSESS-CONCLUSIVE', 'CONFIRMED' FROM g WHERE open = 0""", "finding", "evidence", "dependency", "product", "version_range", "vulnerability"))
def assessment_overall(spark, d):
    own = lambda df: df.select("analysis_id", "conclusion", "decision")
    whole = own(_decided(spark, d)).unionByName(own(E.cve_decisions(_matches(spark, d)))).unionByName(own(E.remediation_decisions(_items(spark, d))))
    return E.overall_decisions(whole).select("analysis_id", "rule", "decision")


@query("analysis_report", with_views(f"""WITH {_FP}, {_RC}, c AS (SELECT analysis_id, count(*) AS findings, count(*) FILTER (WHERE is_duplicate) AS duplicates FROM dd GROUP BY 1), r AS (SELECT analysis_id, list({{'identifier': identifier, 'severity': severity, 'n_findings': n_findings}} ORDER BY identifier, severity, n_findings) AS causes FROM cause GROUP BY 1)
SELECT analysis_id, CAST(to_json({{'findings': findings, 'duplicates': duplicates, 'root_causes': coalesce(causes, [])}}) AS VARCHAR) AS document FROM c LEFT JOIN r USING (analysis_id)""", "finding", "evidence"))
def analysis_report(spark, d):
    own = deduplicated(spark, d)
    return E.report(own, N.root_causes(own))

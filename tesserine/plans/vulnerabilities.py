"""Queries on versions, vulnerability matching and provider records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks, versions
from ..functions.lineage import kept_counted
from ..functions.skew import sent
from ..operators import vulnerabilities as V
from ..sources.bridge import view, with_views
from . import query

_TOKENS = f"""
vs AS (SELECT DISTINCT version AS v FROM dependency WHERE version IS NOT NULL UNION SELECT introduced FROM version_range UNION SELECT fixed FROM version_range UNION SELECT last_affected FROM version_range UNION SELECT exact FROM version_range
  UNION SELECT unnest(regexp_extract_all(raw, '{versions.OPERATOR}', 2)) FROM version_range WHERE raw IS NOT NULL),
tk AS (SELECT v, {versions.tokens_sql("v")} AS t FROM vs WHERE v IS NOT NULL),
cmp AS (SELECT a.v AS a, b.v AS b, {versions.compare_sql("a.t", "b.t")} AS c FROM tk a, tk b)"""
_NAMELESS = "coalesce(version, '') IN ('', 'UNKNOWN')"
_RANGES = f"""
rs AS (SELECT p.product_id, p.version, r.ord, CASE WHEN {_NAMELESS} THEN 'UNKNOWN'
  WHEN raw IS NOT NULL THEN (SELECT CASE WHEN bool_or(c.c IS NULL) THEN 'UNKNOWN' WHEN bool_and(CASE k.op WHEN '<' THEN c.c < 0 WHEN '<=' THEN c.c <= 0 WHEN '>' THEN c.c > 0 WHEN '>=' THEN c.c >= 0 ELSE c.c = 0 END) THEN 'AFFECTED' ELSE 'NOT_AFFECTED' END
    FROM (SELECT unnest(regexp_extract_all(r.raw, '{versions.OPERATOR}', 1)) AS op, unnest(regexp_extract_all(r.raw, '{versions.OPERATOR}', 2)) AS v) k LEFT JOIN cmp c ON c.a = p.version AND c.b = k.v)
  WHEN exact IS NOT NULL THEN CASE WHEN e.c IS NULL THEN 'UNKNOWN' WHEN e.c = 0 THEN 'AFFECTED' ELSE 'NOT_AFFECTED' END
  WHEN introduced IS NULL AND fixed IS NULL AND last_affected IS NULL THEN 'UNKNOWN'
  WHEN (introduced IS NOT NULL AND i.c IS NULL) OR (fixed IS NOT NULL AND f.c IS NULL) OR (last_affected IS NOT NULL AND l.c IS NULL) THEN 'UNKNOWN'
  WHEN coalesce(i.c >= 0, true) AND coalesce(f.c < 0, true) AND coalesce(l.c <= 0, true) THEN 'AFFECTED' ELSE 'NOT_AFFECTED' END AS state
 FROM pairs p JOIN version_range r USING (product_id) LEFT JOIN cmp e ON e.a = p.version AND e.b = r.exact LEFT JOIN cmp i ON i.a = p.version AND i.b = r.introduced
 LEFT JOIN cmp f ON f.a = p.version AND f.b = r.fixed LEFT JOIN cmp l ON l.a = p.version AND l.b = r.last_affected)"""
_CANDIDATES = """
dt AS (SELECT DISTINCT analysis_id, dep_id, ecosystem, token FROM (SELECT *, lower(unnest([name, product, split_part(cpe, ':', 5)])) AS token FROM dependency) WHERE coalesce(token, '') <> ''),
pt AS (SELECT DISTINCT product_id, cve_id, ecosystem, token FROM (SELECT *, lower(unnest([product, package_name])) AS token FROM product) WHERE coalesce(token, '') <> ''),
cand AS (SELECT analysis_id, dep_id, cve_id, product_id, generic = 0 AS same_ecosystem FROM (
  SELECT d.analysis_id, d.dep_id, p.cve_id, p.product_id, CASE WHEN p.ecosystem = d.ecosystem THEN 0 ELSE 1 END AS generic,
    row_number() OVER (PARTITION BY d.analysis_id, d.dep_id, p.cve_id ORDER BY CASE WHEN p.ecosystem = d.ecosystem THEN 0 ELSE 1 END, p.product_id) AS n
  FROM dt d JOIN pt p ON d.token = p.token AND (p.ecosystem = d.ecosystem OR p.ecosystem = 'generic')) WHERE n = 1)"""
_STATES = f"""{_CANDIDATES},
pairs AS (SELECT DISTINCT product_id, version FROM cand JOIN dependency USING (analysis_id, dep_id)),
{_TOKENS.strip()},{_RANGES},
st AS (SELECT product_id, version, CASE WHEN bool_or(state = 'AFFECTED') THEN 'AFFECTED' WHEN bool_or(state = 'UNKNOWN') THEN 'UNKNOWN' ELSE 'NOT_AFFECTED' END AS state FROM rs GROUP BY product_id, version),
cs AS (SELECT c.analysis_id, c.dep_id, c.cve_id, c.product_id, CASE WHEN c.product_id NOT IN (SELECT product_id FROM version_range) THEN 'UNKNOWN' WHEN {_NAMELESS.replace("version", "d.version")} THEN 'POSSIBLY_AFFECTED' ELSE s.state END AS version_state
  FROM cand c JOIN dependency d USING (analysis_id, dep_id) LEFT JOIN st s ON s.product_id = c.product_id AND s.version IS NOT DISTINCT FROM d.version)"""
_CORR = "CASE version_state WHEN 'NOT_AFFECTED' THEN 'PRESENT_NOT_AFFECTED' WHEN 'POSSIBLY_AFFECTED' THEN 'PRESENT_UNKNOWN_VERSION' WHEN 'AFFECTED' THEN 'PRESENT_AFFECTED' ELSE 'UNKNOWN' END"


def _three(spark, d):
    return view(spark, d, "dependency"), view(spark, d, "product"), view(spark, d, "version_range")


@query("cve_state_summary", with_views(f"WITH {_STATES} SELECT analysis_id, version_state, {_CORR} AS correlation_state, count(*) AS n_matches, count(DISTINCT dep_id) AS n_dependencies FROM cs GROUP BY 1, 2, 3", "dependency", "product", "version_range"))
def cve_state_summary(spark, d):
    """The flagship: which dependencies are affected, possibly affected or unknown, per analysis."""
    return V.correlated(*_three(spark, d)).groupBy("analysis_id", "version_state", "correlation_state").agg(F.count("*").alias("n_matches"), F.count_distinct("dep_id").alias("n_dependencies"))


@query("version_compare", with_views(f"""WITH {_TOKENS} SELECT d.version, r.fixed, c.c AS verdict, count(*) AS n FROM dependency d JOIN product p ON p.ecosystem = d.ecosystem AND p.product = lower(d.name) JOIN version_range r ON r.product_id = p.product_id AND r.fixed IS NOT NULL
  LEFT JOIN cmp c ON c.a = d.version AND c.b = r.fixed GROUP BY 1, 2, 3""", "dependency", "product", "version_range"))
def version_compare(spark, d):
    deps, products, ranges = _three(spark, d)
    pairs = deps.select("ecosystem", F.lower("name").alias("product"), "version").join(products, ["ecosystem", "product"]).join(ranges.where("fixed IS NOT NULL"), "product_id")
    return pairs.groupBy("version", "fixed").agg(F.count("*").alias("n")).withColumn("verdict", versions.compare_versions(F.col("version"), F.col("fixed")))


@query("version_range_match", with_views(f"WITH {_CANDIDATES}, pairs AS (SELECT DISTINCT product_id, version FROM cand JOIN dependency USING (analysis_id, dep_id)), {_TOKENS.strip()},{_RANGES} SELECT product_id, version, ord, state FROM rs", "dependency", "product", "version_range"))
def version_range_match(spark, d):
    return V.candidate_ranges(*_three(spark, d))


@query("cve_candidate_match", with_views(f"WITH {_CANDIDATES} SELECT analysis_id, dep_id, cve_id, product_id, same_ecosystem FROM cand", "dependency", "product"))
def cve_candidate_match(spark, d):
    return V.candidates(*_three(spark, d)[:2])


@query("cve_correlation_state", with_views(f"WITH {_STATES} SELECT *, {_CORR} AS correlation_state FROM cs", "dependency", "product", "version_range"))
def cve_correlation_state(spark, d):
    return V.correlated(*_three(spark, d))


@query("cve_finding_severity", with_views(f"""WITH {_STATES}, sev AS (SELECT record_id % 1000000 AS product_id, arg_max(severity, {ranks.ranked_sql("severity", ranks.SEVERITY_RANK, -1)}) AS severity FROM vulnerability GROUP BY 1),
x AS (SELECT c.*, {_CORR} AS present, upper(severity) AS severity, CASE WHEN dep_id % 3 = 0 THEN 'REACHABLE' WHEN dep_id % 3 = 1 THEN 'NOT_REACHABLE' ELSE 'UNKNOWN' END AS reach FROM cs c LEFT JOIN sev USING (product_id)),
y AS (SELECT *, CASE WHEN present <> 'PRESENT_AFFECTED' THEN present WHEN reach = 'REACHABLE' THEN 'AFFECTED_REACHABLE' WHEN reach = 'NOT_REACHABLE' THEN 'AFFECTED_NOT_REACHABLE' ELSE present END AS correlation_state FROM x)
SELECT analysis_id, dep_id, cve_id, correlation_state, CASE correlation_state WHEN 'AFFECTED_REACHABLE' THEN CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'high' ELSE 'medium' END WHEN 'PRESENT_AFFECTED' THEN 'medium'
  WHEN 'AFFECTED_NOT_REACHABLE' THEN 'low' WHEN 'PRESENT_UNKNOWN_VERSION' THEN 'low' ELSE 'info' END AS finding_severity FROM y""", "dependency", "product", "version_range", "vulnerability"))
def cve_finding_severity(spark, d):
    """Of a product's records the most severe counts."""
    rank = ranks.ranked(F.col("severity"), ranks.SEVERITY_RANK, -1)
    severities, n = kept_counted(view(spark, d, "vulnerability").groupBy((F.col("record_id") % 1000000).alias("product_id")).agg(F.max_by("severity", rank).alias("severity")), "severities")
    reach = F.when(F.col("dep_id") % 3 == 0, "REACHABLE").when(F.col("dep_id") % 3 == 1, "NOT_REACHABLE").otherwise("UNKNOWN")
    return V.with_reachability(V.correlated(*_three(spark, d)).join(sent(severities, n), "product_id", "left"), reach, F.col("severity")).select("analysis_id", "dep_id", "cve_id", "correlation_state", "finding_severity")


@query("fixed_versions", with_views(f"""WITH v AS (SELECT product_id, fixed AS v FROM version_range WHERE fixed IS NOT NULL UNION SELECT product_id, unnest(regexp_extract_all(raw, '<\\s*([\\w.\\-+]+)', 1)) FROM version_range WHERE raw IS NOT NULL)
SELECT product_id, string_agg(v, ',' ORDER BY {versions.tokens_sql("v")}, v) AS fixed_versions FROM v GROUP BY product_id""", "version_range"))
def fixed_versions(spark, d):
    return V.fixed_versions(view(spark, d, "version_range"))


@query("provider_conflict_resolution", with_views(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY cve_id ORDER BY coalesce(cvss, -1) DESC, {ranks.ranked_sql("source", {p: k for k, p in enumerate(ranks.PROVIDERS)}, len(ranks.PROVIDERS))}, {ranks.ranked_sql("upper(severity)", ranks.SEVERITY_RANK, -1)} DESC, record_id) AS n FROM vulnerability)
SELECT cve_id, count(*) AS n_records, max(source) FILTER (WHERE n = 1) AS canonical_source, max(severity) FILTER (WHERE n = 1) AS canonical_severity, max(cvss) FILTER (WHERE n = 1) AS canonical_cvss,
 count(DISTINCT upper(severity)) > 1 AS severity_disagrees, count(DISTINCT cvss) > 1 AS cvss_disagrees, bool_or(known_exploited) AS known_exploited, max(epss) AS epss, string_agg(DISTINCT source, ',' ORDER BY source) AS providers FROM r GROUP BY cve_id""", "vulnerability"))
def provider_conflict_resolution(spark, d):
    return V.resolved_conflicts(view(spark, d, "vulnerability"))


@query("intel_upsert", with_views("""WITH new AS (SELECT * FROM vulnerability WHERE record_id >= 1000000), old AS (SELECT cve_id, CASE WHEN record_id % 4 = 0 THEN 'test' ELSE source END AS source, record_id, cvss FROM vulnerability WHERE record_id < 1000000)
SELECT cve_id, source, record_id, cvss FROM new UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.cve_id = old.cve_id AND new.source = old.source)""", "vulnerability"))
def intel_upsert(spark, d):
    records = view(spark, d, "vulnerability").select("cve_id", "source", "record_id", "cvss")
    old = records.where("record_id < 1000000").withColumn("source", F.when(F.col("record_id") % 4 == 0, "test").otherwise(F.col("source")))
    return V.upserted(old, records.where("record_id >= 1000000"), ["cve_id", "source"])


@query("dependency_inventory", with_views(f"SELECT analysis_id, ecosystem, count(*) AS n_dependencies, count(DISTINCT name) AS n_names, count_if({_NAMELESS}) AS n_unknown_version, max(name) AS last_name FROM dependency GROUP BY 1, 2".replace("count_if(", "CAST(count_if(").replace(") AS n_unknown", ") AS BIGINT) AS n_unknown"), "dependency"))
def dependency_inventory(spark, d):
    return V.inventory(view(spark, d, "dependency"))


@query("intel_freshness", with_views("SELECT source, count(*) FILTER (WHERE age_days <= 30) AS n_current, count(*) FILTER (WHERE age_days > 30) AS n_stale, count(*) FILTER (WHERE age_days IS NULL) AS n_unknown, count(*) AS n, min(age_days) AS newest FROM vulnerability GROUP BY source", "vulnerability"))
def intel_freshness(spark, d):
    return V.freshness(view(spark, d, "vulnerability"))


@query("intel_search", with_views("SELECT DISTINCT cve_id, source, record_id, cvss FROM vulnerability WHERE (lower(cve_id) LIKE '%second%' OR lower(summary) LIKE '%second%') AND cvss >= 4.0 ORDER BY cvss DESC, cve_id, record_id LIMIT 50", "vulnerability"))
def intel_search(spark, d):
    return V.searched(view(spark, d, "vulnerability"), "SECOND", 4.0, 50)


_OFFERED = """SELECT product_id AS record_id, product, package_name, ecosystem, 'cpe:2.3:a:Vend' || CAST(product_id % 9 AS STRING) || ':' || product || ':*' AS cpe, 'pkg:' || ecosystem || '/' || coalesce(package_name, product) AS purl FROM product"""
#: Searches of intel_found: every predicate of a search takes part in some.
_SEARCHES = (
    {"query": "LIB1", "provider": "NVD", "min_cvss": 3.0}, {"severity": "high", "known_exploited": False, "ecosystem": "PyPI"}, {"package": "prod1", "cpe": "vend3", "limit": None}, {"purl": "pkg:NPM/", "query": "summary of", "min_cvss": 9.0}, {"query": "cve-2024-1000", "limit": 40},
)


def _search_sql(limit=100, **asked) -> str:
    like = lambda c, w: f"contains(lower(coalesce({c}, '')), '{w.lower()}')"
    said = {
        "query": lambda w: f"({like('v.cve_id', w)} OR {like('summary', w)} OR {like('p.product', w)})", "provider": lambda w: f"lower(source) = '{w.lower()}'", "severity": lambda w: f"upper(coalesce(severity, '')) = '{w.upper()}'",
        "ecosystem": lambda w: f"lower(p.ecosystem) = '{w.lower()}'", "package": lambda w: like("coalesce(p.package_name, p.product)", w), "cpe": lambda w: like("p.cpe", w), "purl": lambda w: like("p.purl", w),
        "known_exploited": lambda w: f"known_exploited = {w}", "min_cvss": lambda w: f"cvss >= {w}",
    }
    cut = f" ORDER BY v.cve_id, coalesce(source, ''), v.record_id LIMIT {limit}" if limit else ""
    return f"SELECT DISTINCT v.cve_id, source, v.record_id, severity, cvss, known_exploited, epss, summary FROM vulnerability v LEFT JOIN pr p ON p.record_id = v.record_id WHERE {' AND '.join(said[k](w) for k, w in asked.items())}{cut}"


_FOUND = " UNION ALL ".join(f"SELECT {k} AS search, * FROM ({_search_sql(**s)})" for k, s in enumerate(_SEARCHES))


@query("intel_found", with_views(f"WITH pr AS ({_OFFERED}) {_FOUND}", "product", "vulnerability"))
def intel_found(spark, d):
    """Searches are top-k reports where they have a limit."""
    records, products = view(spark, d, "vulnerability"), spark.sql(_OFFERED.replace("FROM product", "FROM {product}"), product=view(spark, d, "product"))
    out = None
    for k, s in enumerate(_SEARCHES):
        one = V.found(records, products, **s).select(F.lit(k).alias("search"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("longest_prefix_fingerprint", with_views("""WITH pk AS (SELECT DISTINCT package_prefix || CASE WHEN dep_id % 2 = 0 THEN '.impl.X' ELSE '' END AS package FROM dependency),
fp AS (SELECT DISTINCT 'org.lib' || CAST(product_id % 89 AS VARCHAR) AS prefix, 'L' || CAST(product_id % 89 AS VARCHAR) AS label FROM product UNION SELECT 'org.lib' || CAST(product_id % 45 AS VARCHAR) || '.core', 'C' || CAST(product_id % 45 AS VARCHAR) FROM product UNION SELECT 'org', 'O')
SELECT package, prefix, label FROM (SELECT pk.package, fp.prefix, fp.label, row_number() OVER (PARTITION BY pk.package ORDER BY length(fp.prefix) DESC NULLS LAST, fp.prefix DESC, fp.label DESC) AS n FROM pk LEFT JOIN fp ON pk.package = fp.prefix OR starts_with(pk.package, fp.prefix || '.')) WHERE n = 1""", "dependency", "product"))
def longest_prefix_fingerprint(spark, d):
    packages = view(spark, d, "dependency").select(F.concat("package_prefix", F.when(F.col("dep_id") % 2 == 0, ".impl.X").otherwise("")).alias("package")).distinct()
    n = lambda k: (F.col("product_id") % k).cast("string")
    products = view(spark, d, "product")
    prints = products.select(F.concat(F.lit("org.lib"), n(89)).alias("prefix"), F.concat(F.lit("L"), n(89)).alias("label")).union(products.select(F.concat(F.lit("org.lib"), n(45), F.lit(".core")), F.concat(F.lit("C"), n(45)))).union(products.select(F.lit("org"), F.lit("O"))).distinct()
    return V.longest_prefix(packages, prints)


@query("identity_best_match", with_views("""WITH ids AS (SELECT cve_id, 0 AS ord, 'CPE' AS identity_type, 'cpe:2.3:a:vend' || CAST(product_id % 9 AS VARCHAR) || ':' || product || ':1' AS value FROM product
  UNION ALL SELECT cve_id, 1, 'MAVEN', 'org.lib' || CAST(product_id % 89 AS VARCHAR) || '.core:' || coalesce(package_name, product) FROM product UNION ALL SELECT cve_id, 2, 'PACKAGE', 'org.lib' || CAST(product_id % 89 AS VARCHAR) FROM product),
nm AS (SELECT DISTINCT dep_id, n FROM (SELECT dep_id, lower(unnest([name, product, split_part(cpe, ':', 5)])) AS n FROM dependency) WHERE coalesce(n, '') <> ''),
hit AS (SELECT d.dep_id, i.cve_id, i.ord, i.identity_type, 3 AS s FROM dependency d JOIN ids i ON i.identity_type = 'CPE' AND array_to_string(string_split(lower(d.cpe), ':')[1:5], ':') = array_to_string(string_split(lower(i.value), ':')[1:5], ':')
 UNION ALL SELECT n.dep_id, i.cve_id, i.ord, i.identity_type, 2 FROM nm n JOIN ids i ON i.identity_type = 'CPE' AND n.n = split_part(lower(i.value), ':', 5)
 UNION ALL SELECT d.dep_id, i.cve_id, i.ord, i.identity_type, 3 FROM dependency d JOIN ids i ON i.identity_type = 'MAVEN' AND lower(i.value) = lower(d.package_prefix) || ':' || lower(coalesce(d.product, d.name))
 UNION ALL SELECT n.dep_id, i.cve_id, i.ord, i.identity_type, 2 FROM nm n JOIN ids i ON i.identity_type = 'MAVEN' AND n.n = split_part(lower(i.value), ':', 2)
 UNION ALL SELECT d.dep_id, i.cve_id, i.ord, i.identity_type, CASE WHEN d.package_prefix = i.value THEN 2 ELSE 1 END FROM dependency d JOIN ids i ON i.identity_type = 'PACKAGE' AND (d.package_prefix = i.value OR starts_with(d.package_prefix, i.value || '.'))
 UNION ALL SELECT n.dep_id, i.cve_id, i.ord, i.identity_type, 1 FROM nm n JOIN ids i ON i.identity_type = 'PACKAGE' AND n.n = i.value)
SELECT dep_id, cve_id, identity_type, CASE s WHEN 3 THEN 'EXACT' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY dep_id, cve_id ORDER BY s DESC, ord) AS n FROM hit) WHERE n = 1""", "dependency", "product"))
def identity_best_match(spark, d):
    products = view(spark, d, "product")
    k = lambda m: (F.col("product_id") % m).cast("string")
    row = lambda o, t, v: products.select("cve_id", F.lit(o).alias("ord"), F.lit(t).alias("identity_type"), v.alias("value"))
    base = F.concat(F.lit("org.lib"), k(89))
    ids = row(0, "CPE", F.concat(F.lit("cpe:2.3:a:vend"), k(9), F.lit(":"), F.col("product"), F.lit(":1"))).union(row(1, "MAVEN", F.concat(base, F.lit(".core:"), F.coalesce("package_name", "product")))).union(row(2, "PACKAGE", base))
    return V.identity_match(view(spark, d, "dependency"), ids)

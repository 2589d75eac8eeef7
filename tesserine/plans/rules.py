"""Queries that scan text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.bridge import table, view, with_views
from . import query

_MASK = """list_reduce(list_prepend('', list_transform(list_zip(string_split_regex({b}, '"[^"]{{4,}}"'), regexp_extract_all({b}, '"([^"]{{4,}})"', 1)), lambda z: z[1] || coalesce('"' || CASE WHEN length(z[2]) <= 8 THEN z[2][1] || '***' ELSE z[2][1:4] || repeat('*', length(z[2]) - 8) || right(z[2], 4) END || '"', ''))), lambda x, y: x || y)"""


def _files(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")


_HIT = lambda rule: " OR ".join("regexp_matches(body, '{}')".format(p.replace("'", "''")) for p in rule[1])
#: Of a rule that wants all its patterns, the files that have each.
_ALL = lambda rule: "true" if not rule[2] else " AND ".join("regexp_matches(text, '{}')".format(p.replace("'", "''")) for p in rule[1])


_SCAN = " UNION ALL ".join(f"SELECT path, line, trim(body) AS body, '{r[0]}' AS rule_id, {str(r[6]).lower()} AS mask FROM l WHERE ({_HIT(r)}) AND {_ALL(r)}" for r in R.CODE_RULES)


@query("code_rule_scan", rf"""WITH l AS (SELECT doc_id AS path, text, generate_subscripts(s, 1) AS line, unnest(s) AS body FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents)),
h AS ({_SCAN}), n AS (SELECT *, row_number() OVER (PARTITION BY path, rule_id ORDER BY line) AS n FROM h)
SELECT path, rule_id, count(*) AS n_lines, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (WHERE n <= 5) AS evidence_lines, max(CASE WHEN mask THEN {_MASK.format(b="body")} ELSE body END) FILTER (WHERE n = 1) AS first_evidence FROM n GROUP BY path, rule_id""")
def code_rule_scan(spark, d):
    return R.scanned(_files(spark, d))


@query("rule_cooccurrence", """SELECT page_id AS path, 'LINK-IN-LIST' AS rule_id, CAST(len(list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '<script') OR regexp_matches(x, '<a href'))) AS BIGINT) AS n_lines FROM pages WHERE regexp_matches(html, '<script') AND regexp_matches(html, '<a href')""")
def rule_cooccurrence(spark, d):
    rules = (("LINK-IN-LIST", ("<script", "<a href"), True, "low", "low", "web", False),)
    files = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    return R.scanned(files, rules).select("path", "rule_id", "n_lines")


@query("secret_masking", f"SELECT doc_id, sha256({_MASK.format(b='text')}) AS masked FROM documents")
def secret_masking(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(R.masked(F.col("text")), 256).alias("masked"))


@query("log_redaction", r"""WITH l AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\b(password|token|secret|auth|key)\s*[=:]\s*\S+', '\1=***', 'g'), '\b([A-Za-z0-9_-]{4})[A-Za-z0-9_-]{18,}([A-Za-z0-9_-]{2})\b', '\1***\2', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '…' ELSE t END AS line FROM l""")
def log_redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", R.redacted_log(F.col("text")).alias("line"))


@query("line_context", """WITH l AS (SELECT doc_id AS path, generate_subscripts(s, 1) AS line, unnest(s) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
c AS (SELECT path, line, last_value(nullif(regexp_extract(body, '^([A-Z][a-z]+)[ .,]', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS context FROM l)
SELECT path, context, count(*) AS n_lines FROM c GROUP BY 1, 2""")
def line_context(spark, d):
    return R.with_context(R.lines(_files(spark, d)), r"^([A-Z][a-z]+)[ .,]").groupBy("path", "context").agg(F.count("*").alias("n_lines"))


@query("native_rule_match", with_views("""WITH s AS (SELECT DISTINCT 'lib' || CAST(dep_id % 40 AS VARCHAR) || '.so' AS library, CASE dep_id % 7 WHEN 0 THEN 'strcpy' WHEN 1 THEN 'system' WHEN 2 THEN 'sscanf' WHEN 3 THEN 'mktemp' WHEN 4 THEN 'RC4' WHEN 5 THEN 'strcat' ELSE 'malloc' END AS symbol FROM dependency)
SELECT library, rule_id, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM (SELECT library, symbol, CASE symbol WHEN 'strcpy' THEN 'ASF-NATIVE-STR-001' WHEN 'strcat' THEN 'ASF-NATIVE-STR-001' WHEN 'system' THEN 'ASF-NATIVE-EXEC-001' WHEN 'sscanf' THEN 'ASF-NATIVE-SCAN-001' WHEN 'mktemp' THEN 'ASF-NATIVE-TMP-001' WHEN 'RC4' THEN 'ASF-NATIVE-CRYPTO-001' END AS rule_id FROM s) WHERE rule_id IS NOT NULL GROUP BY 1, 2""", "dependency"))
def native_rule_match(spark, d):
    deps = view(spark, d, "dependency")
    names = F.array(*map(F.lit, ("strcpy", "system", "sscanf", "mktemp", "RC4", "strcat", "malloc")))
    symbols = deps.select(F.concat(F.lit("lib"), (F.col("dep_id") % 40).cast("string"), F.lit(".so")).alias("library"), F.element_at(names, (F.col("dep_id") % 7 + 1).cast("int")).alias("symbol")).distinct()
    return R.native_hits(symbols)


@query("manifest_rules", """WITH m AS (SELECT c_custkey AS package, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS debuggable, c_acctbal < 0 AS allow_backup, c_nationkey % 5 = 0 AS cleartext FROM customer)
SELECT package, 'ANDROID-MANIFEST-001' AS rule_id, 'medium' AS severity FROM m WHERE debuggable UNION ALL SELECT package, 'ANDROID-MANIFEST-002', 'low' FROM m WHERE allow_backup UNION ALL SELECT package, 'ANDROID-MANIFEST-003', 'medium' FROM m WHERE cleartext""")
def manifest_rules(spark, d):
    k = F.col("c_custkey") % 3
    return R.manifest_findings(table(spark, d, "customer").select(F.col("c_custkey").alias("package"), F.when(k == 0, True).when(k == 1, False).alias("debuggable"), (F.col("c_acctbal") < 0).alias("allow_backup"), (F.col("c_nationkey") % 5 == 0).alias("cleartext")))


@query("encoded_string_counts", """WITH f AS (SELECT doc_id AS path, list_filter(regexp_extract_all(text, '[A-Za-z0-9+/=]{24,}'), lambda s: regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]')) AS s FROM documents)
SELECT path, CAST(len(s) AS BIGINT) AS n_encoded, CAST(list_max(list_transform(s, lambda x: length(x))) AS INTEGER) AS longest FROM f WHERE len(s) > 0""")
def encoded_string_counts(spark, d):
    return R.encoded_strings(_files(spark, d))

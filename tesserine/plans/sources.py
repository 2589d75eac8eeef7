"""Queries on feeds, blobs and the named registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..sources import blobs, bundles, feeds
from ..sources.bridge import table, view, with_views
from . import query


def _feed(spark, d):
    k = F.col("s_suppkey")
    text = lambda *c: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in c))
    n, v = k.cast("string"), F.concat((k % 7).cast("string"), F.lit("."), (k % 5).cast("string"))
    nvd = text('{"cve": {"id": "CVE-1-', n, '", "metrics": {"score": 7.5}, "product": "Lib', n, '"}}')
    osv = text('{"id": "OSV-', n, '", "aliases": ["GHSA-x", "CVE-2-', n, '"], "affected": [{"package": {"ecosystem": "Maven", "name": "G:A', n, '"}, "ranges": [{"events": [{"introduced": "0"}, {"introduced": "1.0"}, {"fixed": "', v, '"}]}]}]}')
    ghsa = text('{"ghsa_id": "GHSA-', n, '", "vulnerabilities": [{"package": {"ecosystem": "npm", "name": "P', n, '"}, "vulnerable_version_range": "< ', v, '", "first_patched_version": "', v, '"}]}')
    own = text('{"cve_id": "CVE-4-', n, '", "source": "local", "product": "q", "ecosystem": "pypi", "raw": ">= ', v, '"}')
    return table(spark, d, "supplier").select(F.when(k % 6 == 0, nvd).when(k % 6 == 1, osv).when(k % 6 == 2, ghsa).when(k % 6 == 3, own).when(k % 6 == 4, text('{"broken": ', n)).otherwise(text("[", n, "]")).alias("payload"))


@query("feed_records", """WITH s AS (SELECT s_suppkey % 6 AS m, CAST(s_suppkey AS VARCHAR) AS n, CAST(s_suppkey % 7 AS VARCHAR) || '.' || CAST(s_suppkey % 5 AS VARCHAR) AS v FROM supplier)
SELECT 'nvd' AS provider, 'CVE-1-' || n AS cve_id, 'generic' AS ecosystem, 'lib' || n AS product, NULL AS introduced, NULL AS fixed, NULL AS raw FROM s WHERE m = 0 UNION ALL SELECT 'osv', 'CVE-2-' || n, 'maven', 'g:a' || n, '1.0', v, NULL FROM s WHERE m = 1
UNION ALL SELECT 'ghsa', 'GHSA-' || n, 'npm', 'p' || n, NULL, NULL, '< ' || v FROM s WHERE m = 2 UNION ALL SELECT 'ghsa', 'GHSA-' || n, 'npm', 'p' || n, NULL, v, NULL FROM s WHERE m = 2 UNION ALL SELECT 'canonical', 'CVE-4-' || n, 'pypi', 'q', NULL, NULL, '>= ' || v FROM s WHERE m = 3""")
def feed_records(spark, d):
    return feeds.records(_feed(spark, d))


@query("package_registry", "SELECT sha256(html) AS sha256, md5(html) AS md5, CAST(strlen(html) AS BIGINT) AS n_bytes, min(page_id) AS page_id, count(*) AS n_copies FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 10 = 0) GROUP BY 1, 2, 3")
def package_registry(spark, d):
    files = table(spark, d, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return blobs.registered(files, blobs.digests(files.where("page_id % 10 = 0")), "page_id").drop("sha1")


@query("bundle_checksums", with_views("""WITH l AS (SELECT source, sha256(source || '|' || cve_id || '|' || CAST(record_id AS VARCHAR)) AS m FROM vulnerability), b AS (SELECT source, substr(m, 1, 3) AS bucket, count(*) AS n, sha256(string_agg(m, '|' ORDER BY m)) AS part FROM l GROUP BY 1, 2)
SELECT source, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bucket || ':' || part, '|' ORDER BY bucket)) AS digest FROM b GROUP BY 1""", "vulnerability"))
def bundle_checksums(spark, d):
    """One checksum for each file of a bundle, whatever the order of its lines."""
    rows = view(spark, d, "vulnerability").select("source", F.sha2(F.concat_ws("|", "source", "cve_id", "record_id"), 256).alias("member"))
    return G.digest(rows, "source", "member")


@query("bundle_validation", with_views("""WITH f AS (SELECT source, substr(sha256(cve_id), 1, 2) AS name, sha256(string_agg(cve_id || '|' || CAST(record_id AS VARCHAR), chr(10) ORDER BY cve_id, record_id)) AS sha256 FROM vulnerability GROUP BY 1, 2),
g AS (SELECT source, substr(sha256(cve_id), 1, 2) AS name, sha256(string_agg(cve_id || '|' || CAST(record_id + CASE WHEN source = 'ghsa' AND record_id % 50 = 1 THEN 1 ELSE 0 END AS VARCHAR), chr(10) ORDER BY cve_id, record_id)) AS sha256 FROM vulnerability WHERE source <> 'osv' OR record_id % 40 <> 2 GROUP BY 1, 2)
SELECT source, count(*) AS n_files, count(*) FILTER (WHERE f.sha256 IS DISTINCT FROM g.sha256) AS n_errors, CASE WHEN count(*) FILTER (WHERE f.sha256 IS DISTINCT FROM g.sha256) > 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status FROM f FULL JOIN g USING (source, name) GROUP BY 1""", "vulnerability"))
def bundle_validation(spark, d):
    """Bundles by source, cut into files by identifier; what arrived has records changed in one and lost in another."""
    rows = view(spark, d, "vulnerability").select("source", "cve_id", "record_id", F.substring(F.sha2("cve_id", 256), 1, 2).alias("name"))
    lines = lambda df: df.groupBy("source", "name").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cve_id", "record_id"))), lambda r: F.concat(r["cve_id"], F.lit("|"), r["record_id"].cast("string"))), "\n"), 256).alias("sha256"))
    k = F.col("record_id")
    came = rows.where((F.col("source") != "osv") | (k % 40 != 2)).withColumn("record_id", k + F.when((F.col("source") == "ghsa") & (k % 50 == 1), 1).otherwise(0))
    return bundles.statuses(lines(rows), lines(came), "source")

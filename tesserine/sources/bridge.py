"""Domain tables read off the driver's tables, in SQL that Spark and DuckDB share.

The engine's operators work on tables of package evidence (dependencies, vulnerabilities,
findings, graph nodes and edges, snapshots, observations). No such packages are at hand, so
these views present the given tables in those schemas. Rows that a view leaves out are there to
make cases: a tenth of the suppliers are no nodes, so edges to them dangle; a seventh have no version
range; orders that are in one snapshot only are ADDED or REMOVED (and a few are in neither).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "dependency": """
SELECT 'A' || CAST(p_partkey % 5 AS STRING) AS analysis_id, p_partkey AS dep_id, 'Lib' || CAST(p_partkey % 89 AS STRING) AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 'prod' || CAST(p_partkey % 61 AS STRING) END AS product,
  CASE p_size % 4 WHEN 0 THEN 'maven' WHEN 1 THEN 'npm' WHEN 2 THEN 'native' ELSE 'pypi' END AS ecosystem,
  CASE WHEN p_size % 4 = 2 THEN 'native' ELSE 'java' END AS kind,
  CASE WHEN p_partkey % 7 = 0 THEN 'cpe:2.3:a:Vend' || CAST(p_partkey % 9 AS STRING) || ':Lib' || CAST(p_partkey % 89 AS STRING) || ':*' END AS cpe,
  'org.lib' || CAST(p_partkey % 89 AS STRING) || '.core' AS package_prefix,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 'UNKNOWN' WHEN p_partkey % 19 = 0 THEN 'trunk'
    WHEN p_partkey % 13 = 0 THEN CAST(p_size % 10 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) || '-rc' || CAST(p_partkey % 3 AS STRING)
    WHEN p_partkey % 23 = 0 THEN CAST(p_size % 10 AS STRING) || '.0-final'
    ELSE CAST(p_size % 10 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) END AS version
FROM part""",
    "product": """
SELECT s_suppkey AS product_id, 'CVE-2024-' || CAST(10000 + s_suppkey % 977 AS STRING) AS cve_id,
  CASE WHEN s_suppkey % 5 = 0 THEN 'generic' WHEN s_suppkey % 4 = 1 THEN 'npm' WHEN s_suppkey % 4 = 2 THEN 'native' WHEN s_suppkey % 4 = 3 THEN 'pypi' ELSE 'maven' END AS ecosystem,
  'lib' || CAST(s_suppkey % 89 AS STRING) AS product, CASE WHEN s_suppkey % 3 = 0 THEN 'prod' || CAST(s_suppkey % 61 AS STRING) END AS package_name
FROM supplier""",
    "version_range": """
SELECT s_suppkey AS product_id, 0 AS ord, CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_nationkey % 5 AS STRING) || '.0' END AS introduced,
  CASE WHEN s_suppkey % 5 < 2 THEN CAST(5 + s_nationkey % 5 AS STRING) || '.' || CAST(s_suppkey % 10 AS STRING) || '.1' END AS fixed,
  CASE WHEN s_suppkey % 5 = 2 THEN CAST(3 + s_nationkey % 6 AS STRING) || '.5-beta' END AS last_affected,
  CASE WHEN s_suppkey % 5 = 3 THEN CAST(s_nationkey % 10 AS STRING) || '.' || CAST(s_suppkey % 10 AS STRING) || '.' || CAST(s_suppkey % 7 AS STRING) END AS exact,
  CASE WHEN s_suppkey % 5 = 4 THEN '>= ' || CAST(s_nationkey % 4 AS STRING) || '.0.0 < ' || CAST(4 + s_nationkey % 6 AS STRING) || '.2.0-rc1' END AS raw
FROM supplier WHERE s_suppkey % 7 <> 6
UNION ALL
SELECT s_suppkey, 1, NULL, NULL, NULL, NULL, '< ' || CAST(1 + s_nationkey % 3 AS STRING) || '.1' FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 7 <> 6""",
    "vulnerability": """
SELECT 'CVE-2024-' || CAST(10000 + s_suppkey % 977 AS STRING) AS cve_id, CASE s_nationkey % 5 WHEN 0 THEN 'nvd' WHEN 1 THEN 'ghsa' WHEN 2 THEN 'osv' WHEN 3 THEN 'local' ELSE 'other' END AS source,
  s_suppkey AS record_id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_suppkey % 101 AS DOUBLE) / 10 END AS cvss,
  CASE s_suppkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'MODERATE' WHEN 4 THEN 'LOW' END AS severity,
  s_suppkey % 8 = 0 AS known_exploited, CASE WHEN s_suppkey % 3 > 0 THEN CAST(s_suppkey % 100 AS DOUBLE) / 100 END AS epss,
  'A summary of ' || lower(s_name) AS summary, CAST(floor(s_acctbal) AS INT) AS age_days
FROM supplier
UNION ALL
SELECT 'CVE-2024-' || CAST(10000 + s_suppkey % 977 AS STRING), 'test', 1000000 + s_suppkey, CAST(s_suppkey % 71 AS DOUBLE) / 10, 'HIGH', false, NULL, 'A second view of ' || lower(s_name), NULL FROM supplier WHERE s_suppkey % 3 = 1""",
    "finding": """
SELECT DISTINCT 'A' || CAST(o_custkey % 5 AS STRING) AS analysis_id, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS finding_id,
  CASE l_partkey % 12 WHEN 0 THEN 'ANDROID-WEBVIEW-001' WHEN 1 THEN 'ANDROID-SEMANTIC-004' WHEN 2 THEN 'ANDROID-COMPONENT-001' WHEN 3 THEN 'ANDROID-COMPONENT-002'
    WHEN 4 THEN 'ANDROID-SEMANTIC-005' WHEN 5 THEN 'ANDROID-MANIFEST-003' WHEN 6 THEN 'ANDROID-CRYPTO-001' WHEN 7 THEN 'ANDROID-REACH-00' || CAST(1 + l_partkey % 3 AS STRING)
    WHEN 8 THEN 'ASF-NATIVE-001' WHEN 9 THEN 'ANDROID-CVE-001' WHEN 10 THEN 'ANDROID-SECRET-001' ELSE 'OTHER-001' END AS rule_id,
  CASE l_partkey % 12 WHEN 8 THEN 'native' WHEN 9 THEN 'cve' WHEN 7 THEN 'reachability' ELSE 'code' END AS category,
  CASE WHEN l_partkey % 12 = 9 THEN 'Uses CVE-2024-' || CAST(10000 + l_suppkey % 977 AS STRING) || ' here' WHEN l_partkey % 3 = 0 THEN 'Input reaches WebView' WHEN l_partkey % 3 = 1 THEN 'Input reaches reflection' ELSE 'Input reaches a sink' END AS title,
  CASE WHEN o_custkey % 10 = 9 THEN NULL ELSE 'c' || CAST(o_custkey % 37 AS STRING) END AS component,
  CASE WHEN l_quantity < 10 THEN 'info' WHEN l_quantity < 20 THEN 'low' WHEN l_quantity < 35 THEN 'medium' WHEN l_quantity < 46 THEN 'high' ELSE 'critical' END AS severity,
  CASE l_linenumber % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'confirmed' END AS confidence,
  CASE l_returnflag WHEN 'R' THEN 'CONFIRMED_BY_STATIC_ANALYSIS' WHEN 'A' THEN 'POTENTIAL' ELSE 'NOT_OBSERVED' END AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "evidence": """
SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS finding_id, 0 AS ord, CASE l_returnflag WHEN 'R' THEN 'source_code' WHEN 'A' THEN 'manifest' ELSE 'dex' END AS source,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'f' || CAST(l_suppkey % 10 AS STRING) || '.java:' || CAST(l_linenumber AS STRING) END AS location,
  CASE WHEN l_partkey % 5 = 0 THEN 'method SECURITY_SINK exec' || CAST(l_suppkey % 5 AS STRING) || '(x)' ELSE 'line' END AS detail FROM lineitem
UNION ALL
SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000, 1, 'native', 'lib' || CAST(l_partkey % 6 AS STRING) || '.so', 'symbol' FROM lineitem WHERE l_linestatus = 'O'""",
    "node": """
SELECT 'r:' || CAST(r_regionkey AS STRING) AS node_key, 'ENTRY_POINT' AS node_type, r_name AS label FROM region
UNION ALL SELECT 'n:' || CAST(n_nationkey AS STRING), 'JAVA_METHOD', n_name FROM nation
UNION ALL SELECT 'c:' || CAST(c_custkey AS STRING), CASE WHEN c_custkey % 10 = 0 THEN 'DATAFLOW_SOURCE' ELSE 'JAVA_METHOD' END, c_name FROM customer
UNION ALL SELECT 'p:' || CAST(p_partkey AS STRING), 'JAVA_METHOD', p_name FROM part
UNION ALL SELECT 's:' || CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 10 = 7 THEN 'NATIVE_FUNCTION' ELSE 'SECURITY_SINK' END,
  CASE s_suppkey % 5 WHEN 0 THEN 'WebView.loadUrl' WHEN 1 THEN 'Runtime.exec' WHEN 2 THEN 'Java_x' WHEN 4 THEN 'Class.forName' ELSE 'SQLiteDatabase.rawQuery' END || ' ' || s_name FROM supplier WHERE s_suppkey % 10 <> 3""",
    "edge": """
SELECT 'r:' || CAST(n_regionkey AS STRING) AS src, 'n:' || CAST(n_nationkey AS STRING) AS dst, 'DECLARES' AS edge_type, 'HIGH' AS confidence FROM nation
UNION ALL SELECT 'n:' || CAST(c_nationkey AS STRING), 'c:' || CAST(c_custkey AS STRING), 'CALLS', CASE WHEN c_acctbal < 0 THEN 'LOW' ELSE 'MEDIUM' END FROM customer
UNION ALL SELECT DISTINCT 'c:' || CAST(o_custkey AS STRING), 'p:' || CAST(l_partkey AS STRING), 'INVOKES', 'MEDIUM' FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT DISTINCT 'p:' || CAST(l_partkey AS STRING), 's:' || CAST(l_suppkey AS STRING), 'CALLS', CASE WHEN l_suppkey % 3 = 0 THEN 'LOW' ELSE 'HIGH' END FROM lineitem
UNION ALL SELECT 's:' || CAST(s_suppkey AS STRING), 'n:' || CAST(s_nationkey AS STRING), 'RETURNS', 'LOW' FROM supplier""",
    "component": """
SELECT 'A' || CAST(c_custkey % 5 AS STRING) AS analysis_id, c_custkey AS component_id, 'c' || CAST(c_custkey % 997 AS STRING) AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'activity' WHEN 'MACHINERY' THEN 'service' WHEN 'HOUSEHOLD' THEN 'provider' WHEN 'AUTOMOBILE' THEN 'receiver' ELSE 'activity' END AS kind,
  CASE WHEN c_custkey % 3 = 0 THEN true WHEN c_custkey % 3 = 1 THEN false END AS exported, c_nationkey % 2 = 0 AS has_filter,
  CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 < 3 THEN 'com.x.permission.P' || CAST(c_nationkey AS STRING) END AS permission
FROM customer""",
    "permission": """
SELECT o_orderkey AS permission_id, CASE o_orderkey % 6 WHEN 0 THEN 'android.permission.CAMERA' WHEN 1 THEN 'android.permission.INTERNET' WHEN 2 THEN 'android.permission.READ_SMS'
  WHEN 3 THEN 'com.custom.permission.P' || CAST(o_custkey % 10 AS STRING) WHEN 4 THEN 'android.permission.INSTALL_PACKAGES' ELSE 'android.permission.ACCESS_FINE_LOCATION' END AS name FROM orders""",
    "snapshot_a": """
SELECT 'X' || CAST(o_custkey % 4 AS STRING) AS pair_id, CASE WHEN o_orderkey % 3 = 0 THEN 'component' ELSE 'permission' END AS category, 'e' || CAST(o_orderkey AS STRING) AS entity_key,
  o_orderstatus AS exposure, o_orderpriority AS guard FROM orders WHERE o_orderkey % 11 <> 0""",
    "snapshot_b": """
SELECT 'X' || CAST(o_custkey % 4 AS STRING) AS pair_id, CASE WHEN o_orderkey % 3 = 0 THEN 'component' ELSE 'permission' END AS category, 'e' || CAST(o_orderkey AS STRING) AS entity_key,
  CASE WHEN o_orderkey % 5 = 0 THEN 'PUBLIC' ELSE o_orderstatus END AS exposure, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS guard FROM orders WHERE o_orderkey % 13 <> 0""",
    "observation": """
SELECT event_id AS obs_id, user_id AS session_id, ts, CASE WHEN user_id % 3 = 0 THEN 'mock' WHEN user_id % 3 = 1 THEN 'adb' ELSE 'frida' END AS adapter,
  CASE event_id % 9 WHEN 0 THEN 'PROCESS' WHEN 1 THEN 'NATIVE' ELSE 'JAVA' END AS observation_type,
  CASE event_id % 7 WHEN 0 THEN 'android.webkit.WebView' WHEN 1 THEN 'java.lang.reflect.Method' WHEN 2 THEN 'dalvik.system.DexClassLoader' WHEN 3 THEN 'javax.net.ssl.SSLContext'
    WHEN 4 THEN 'com.x.MainActivity' WHEN 5 THEN 'com.x.SyncService' ELSE 'java.io.FileInputStream' END AS class_name,
  CASE event_id % 5 WHEN 0 THEN 'loadUrl' WHEN 1 THEN 'invoke' WHEN 2 THEN 'onCreate' WHEN 3 THEN 'getData' ELSE 'read' END AS method_name,
  CASE event_id % 9 WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'JNI_OnLoad' ELSE 'strcpy' END END AS symbol, event_type, value
FROM events""",
    "boundary": """
SELECT 'A' || CAST(o_custkey % 5 AS STRING) AS analysis_id, CASE o_orderkey % 5 WHEN 0 THEN 'WEBVIEW_JS_BRIDGE' WHEN 1 THEN 'CONTENT_PROVIDER' WHEN 2 THEN 'JNI' WHEN 3 THEN 'NETWORK' ELSE 'EXPORTED_COMPONENT' END AS boundary_type,
  'c' || CAST(o_custkey % 37 AS STRING) AS component, CASE o_orderkey % 7 WHEN 0 THEN 'LOW' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM orders""",
    "transaction": """
SELECT 'A' || CAST(s_suppkey % 5 AS STRING) AS analysis_id, 'com.x.S' || CAST(s_suppkey % 50 AS STRING) AS component, CASE s_suppkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'UNKNOWN' ELSE 'MEDIUM' END AS confidence FROM supplier""",
    "semantic": """
SELECT DISTINCT 'A' || CAST(user_id % 5 AS STRING) AS analysis_id, CASE WHEN user_id % 2 = 0 THEN 'c:' || CAST(user_id AS STRING) ELSE 'com.x.c' || CAST(user_id % 37 AS STRING) || '#run' END AS src,
  CASE event_id % 4 WHEN 0 THEN 'REFLECTION_TARGET' WHEN 1 THEN 'DYNAMIC_LOAD' WHEN 2 THEN 'INTENT' ELSE 'CRYPTO' END AS edge_type,
  CASE event_id % 4 WHEN 0 THEN 'reflect:' WHEN 1 THEN 'dynload:' ELSE 'x:' END || CASE WHEN event_id % 3 = 0 THEN 'UNKNOWN' ELSE 'com.y.D' || CAST(event_id % 50 AS STRING) END AS dst, CASE WHEN event_id % 3 = 0 THEN 'UNKNOWN' ELSE 'MEDIUM' END AS confidence FROM events""",
    "method": """
SELECT 'd' || CAST(doc_id AS STRING) AS path, 'com.x.c' || CAST(doc_id % 37 AS STRING) AS class_name,
  CASE doc_id % 9 WHEN 0 THEN 'onCreate' WHEN 1 THEN 'onReceive' WHEN 2 THEN 'query' WHEN 3 THEN 'onTransact' WHEN 4 THEN 'onBind' WHEN 5 THEN 'openFile' ELSE 'run' || CAST(doc_id AS STRING) END AS method_name,
  CAST(1 + doc_id % 50 AS INT) AS line, CAST(2 + doc_id % 50 AS INT) AS code_line,
  text || chr(10) || CASE doc_id % 14 WHEN 0 THEN 'new Intent("do.' || lang || '"); x.startActivity(i);' WHEN 1 THEN 'i.setAction("act.' || source || '"); x.sendBroadcast(i); i.setData(Uri.parse("u://' || lang || '"));'
    WHEN 2 THEN 'x.startService(i);' WHEN 3 THEN 'w.addJavascriptInterface(new B(), "b' || lang || '");' WHEN 4 THEN 'Class.forName("t.' || source || '");' WHEN 5 THEN 'Class.forName(s);'
    WHEN 6 THEN 'new DexClassLoader("/x", a);' WHEN 7 THEN 'new PathClassLoader(i.getStringExtra("p"), a);' WHEN 8 THEN 'new DexClassLoader(p);' WHEN 9 THEN 'Cipher.getInstance("AES/' || lang || '"); Mac.getInstance("HmacSHA1");'
    WHEN 10 THEN 'new URL("http://' || source || '/"); HostnameVerifier v;' WHEN 11 THEN 'OkHttpClient c; getCacheDir();' WHEN 12 THEN 'b.transact(1); case B: case A: SQLiteDatabase d;' ELSE 'i.setClassName("p.' || lang || '", "c"); x.bindService(i);' END AS code
FROM documents""",
    "body": """
SELECT 'd' || CAST(doc_id AS STRING) AS path, CAST(doc_id AS INT) AS ord, 'com.' || lang || '.K' || CAST(doc_id % 23 AS STRING) AS class_name, CASE WHEN doc_id % 23 = doc_id % 41 THEN 'K' || CAST(doc_id % 23 AS STRING) ELSE 'm' || CAST(doc_id % 41 AS STRING) END AS method_name,
  text || chr(10) || 'K' || CAST(doc_id % 22 AS STRING) || ' a = x; a.m' || CAST(doc_id % 41 AS STRING) || '(); { K' || CAST(doc_id % 19 AS STRING) || ' a = new K' || CAST(doc_id % 17 AS STRING) || '(1); a.m' || CAST(doc_id % 37 AS STRING) || '(); s = "K1 a = y; {"; } a.m'
    || CAST(doc_id % 31 AS STRING) || '(); b.m1(); m' || CAST(doc_id % 29 AS STRING) || '(); K' || CAST(doc_id % 13 AS STRING) || '.m' || CAST(doc_id % 11 AS STRING) || '(); f().m2();' AS code
FROM documents""",
    "library": """
SELECT p_partkey AS library_id, 'A' || CAST(p_partkey % 5 AS STRING) AS analysis_id, 'lib' || CAST(p_partkey % 600 AS STRING) || '.so' AS name, CASE WHEN p_size % 10 = 0 THEN 'MALFORMED' ELSE 'COMPLETE' END AS status, p_size % 4 = 0 AS stripped,
  CAST(p_size % 7 AS INT) AS n_exported, CAST(p_size AS BIGINT) * 10000 AS n_bytes FROM part""",
    "evasion": """
SELECT 'A' || CAST(c_custkey % 5 AS STRING) AS analysis_id, CASE c_nationkey % 3 WHEN 0 THEN 'DEBUGGER_CHECK' WHEN 1 THEN 'EMULATOR_CHECK' ELSE 'ROOT_CHECK' END AS category, lower(c_mktsegment) AS indicator,
  CASE WHEN c_custkey % 4 = 0 THEN 'SUPPORTED' ELSE 'INDICATOR' END AS evidence_level FROM customer""",
    "workspace_event": """
SELECT 'W' || CAST(user_id % 20 AS STRING) AS workspace, event_id AS seq, ts, CASE WHEN event_id % 11 = 0 THEN 'REMOVE' WHEN event_id % 97 = 5 THEN 'MOVE' WHEN event_id % 7 IN (1, 2) THEN 'STATUS' ELSE 'ADD' END AS op,
  CASE WHEN event_id % 101 = 0 THEN 'WORKSPACE' WHEN event_id % 7 IN (1, 2, 3) THEN 'HYPOTHESIS' WHEN event_id % 7 = 4 THEN 'NOTE' WHEN event_id % 7 = 5 THEN 'EDGE' WHEN event_id % 7 = 6 THEN 'FINDING' ELSE 'NODE' END AS kind,
  event_type || ':' || CAST(user_id % 9 AS STRING) AS ref, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type || ' ' || CAST(event_id AS STRING) END AS text,
  CASE WHEN event_id % 7 <> 3 THEN CASE event_id % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'REFUTED' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'sure' ELSE 'OPEN' END END AS status FROM events""",
    "stage": """
SELECT 'W' || CAST(n_nationkey % 20 AS STRING) AS workspace, CAST(n_nationkey AS INT) AS ord, CASE n_nationkey % 6 WHEN 0 THEN 'ingest' WHEN 1 THEN 'manifest' WHEN 2 THEN 'native' WHEN 3 THEN 'correlation' WHEN 4 THEN 'other' ELSE 'jni' END AS name,
  CASE n_regionkey WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'DEGRADED' WHEN 2 THEN 'FAILED' ELSE 'COMPLETE' END AS status, CASE WHEN n_regionkey < 3 THEN lower(n_name) END AS detail FROM nation""",
}


def _named(sql: str) -> set[str]:
    words = set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql))
    return words & {*TABLES, *VIEWS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame."""
    used = _named(VIEWS[name])
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in used:
        sql = re.sub(rf"((?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str, *names: str) -> str:
    """sql for DuckDB, with the domain tables it names put before it."""
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    for word in ("WITH RECURSIVE", "WITH"):
        if body.startswith(word):
            return f"{word} {head},\n{body[len(word):]}"
    return f"WITH {head}\n{body}"

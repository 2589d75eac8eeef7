"""Queries on the framework semantics of method bodies, read off the documents' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import semantics as S
from ..sources import java
from ..sources.bridge import view, with_views
from . import query


def _has(p: str, of: str = "code") -> str:
    return "regexp_matches({}, '{}')".format(of, p.replace("'", "''"))


def _group(p: str, n: int = 1) -> str:
    return "CASE WHEN {} THEN regexp_extract(code, '{}', {}) END".format(_has(p), p.replace("'", "''"), n)


def _line(p: str) -> str:
    before = "left(code, strpos(code, regexp_extract(code, '{}', 0)) - 1)".format(p.replace("'", "''"))
    return f"CAST(code_line + length({before}) - length(replace({before}, chr(10), '')) AS INTEGER)"


_ARGS = "regexp_extract(code, '{}', 2)".format(S.LOADER)
_KIND = "CASE WHEN contains({0}, '\"') THEN 'static_constant' WHEN {1} THEN 'external' ELSE 'application_controlled' END".format(_ARGS, _has("|".join(p for _, _, p in java.SOURCES), _ARGS))
_CALLS = f"""SELECT k AS src, 'jsbridge:' || {_group(S.BRIDGE)} AS dst, 'WEBVIEW_BRIDGE' AS edge_type, 'addJavascriptInterface(..., "' || {_group(S.BRIDGE)} || '")' AS evidence, {_line(S.BRIDGE)} AS line, 'MEDIUM' AS confidence FROM m WHERE {_has(S.BRIDGE)}
UNION ALL SELECT k, 'reflect:' || {_group(S.REFLECTION)}, 'REFLECTION_TARGET', 'constant target ' || {_group(S.REFLECTION)}, {_line(S.REFLECTION)}, 'MEDIUM' FROM m WHERE {_has(S.REFLECTION)}
UNION ALL SELECT k, 'reflect:UNKNOWN', 'REFLECTION_TARGET', 'dynamic target UNKNOWN', NULL, 'UNKNOWN' FROM m WHERE NOT {_has(S.REFLECTION)} AND {_has(S.REFLECTION_OPEN)}
UNION ALL SELECT k, 'dynload:' || {_KIND}, 'DYNAMIC_LOAD', {_group(S.LOADER)} || ' path=' || {_KIND}, {_line(S.LOADER)}, 'MEDIUM' FROM m WHERE {_has(S.LOADER)}
UNION ALL SELECT k, 'network', 'NETWORK', 'url=' || coalesce({_group(S.URL)}, 'UNKNOWN') || CASE WHEN {_has(S.TLS)} THEN ', tls=custom' ELSE ', tls=default' END, NULL, 'MEDIUM' FROM m WHERE {_has(S.URL)} OR {_has(S.NETWORK)}
UNION ALL SELECT k, 'storage', 'STORAGE', 'storage API ' || {_group(S.STORAGE)}, {_line(S.STORAGE)}, 'MEDIUM' FROM m WHERE {_has(S.STORAGE)}
UNION ALL SELECT k, 'crypto:' || a, 'CRYPTO', 'algorithm=' || a, NULL, 'HIGH' FROM (SELECT k, unnest(regexp_extract_all(code, '{S.CRYPTO}', 1)) AS a FROM m)"""


@query("semantic_calls", with_views(f"WITH m AS (SELECT *, class_name || '#' || method_name AS k FROM method) {_CALLS}", "method"))
def semantic_calls(spark, d):
    return S.framework_calls(view(spark, d, "method"))


_OPERATIONS = " UNION ALL ".join(f"SELECT *, '{n}' AS operation, {_line(p)} AS place FROM m WHERE {_has(p)}" for n, p in S.INTENT_OPERATIONS)


@query("semantic_intents", with_views(f"""WITH m AS (SELECT *, coalesce({_group(S.ACTIONS[0])}, {_group(S.ACTIONS[1])}) AS action, {_group(S.DATA)} AS data_uri, {_group(S.CLASS_NAME)} AS target_package, {_group(S.CLASS_NAME, 2)} AS target_component FROM method), o AS ({_OPERATIONS})
SELECT class_name, method_name, operation, CASE WHEN operation IN ('startActivity', 'startService') THEN coalesce(action, 'UNKNOWN') ELSE action END AS action, data_uri, target_package, target_component, place AS line,
 CASE WHEN coalesce(action, data_uri, target_component) IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM o""", "method"))
def semantic_intents(spark, d):
    return S.intents(view(spark, d, "method"))


@query("semantic_transactions", with_views(f"""WITH m AS (SELECT *, list_sort(list_distinct(regexp_extract_all(code, '{S.CASE}', 1))) AS codes FROM method)
SELECT 'SERVICE_ENTRY' AS kind, class_name, method_name, CASE WHEN len(codes) > 0 THEN array_to_string(codes[1:{S.CODES}], ',') END AS transaction_code, CASE WHEN len(codes) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM m WHERE method_name = 'onTransact'
UNION ALL SELECT 'CLIENT_INVOKE', class_name, method_name, NULL, 'LOW' FROM m WHERE {_has(S.TRANSACT)}""", "method"))
def semantic_transactions(spark, d):
    return S.transactions(view(spark, d, "method"))


def _components(spark, d):
    """Components with a filter of one link each, where they have filters: every other one names a host, every third a path, and some neither."""
    k = F.col("component_id")
    data = F.struct(
        F.when(k % 4 < 3, F.col("kind")).alias("scheme"), F.when(k % 2 == 0, F.col("name")).alias("host"), F.lit(None).cast("string").alias("port"), F.when(k % 3 == 0, F.lit("/p")).alias("path"),
        F.when(k % 5 == 0, F.lit("/q")).alias("path_prefix"), F.lit(None).cast("string").alias("path_pattern"), F.lit("text/plain").alias("mime_type"),
    )
    link = F.struct(F.array(F.lit("VIEW"), F.col("kind")).alias("actions"), F.array(F.lit("BROWSABLE")).alias("categories"), F.array(data).alias("data"))
    exported = F.coalesce("exported", F.lit(False)).alias("effective_exported")
    return view(spark, d, "component").select("name", "kind", exported, "permission", F.when(F.col("has_filter"), F.array(link)).alias("filters"))


@query("semantic_deep_links", with_views("""WITH l AS (SELECT name AS component, kind, CASE WHEN component_id % 4 < 3 THEN kind END AS scheme, CASE WHEN component_id % 2 = 0 THEN name END AS host, CASE WHEN component_id % 3 = 0 THEN '/p' END AS path, CASE WHEN component_id % 5 = 0 THEN '/q' END AS path_prefix FROM component WHERE exported AND has_filter)
SELECT component, scheme, host, CAST(NULL AS VARCHAR) AS port, path, path_prefix, CAST(NULL AS VARCHAR) AS path_pattern, 'text/plain' AS mime_type, 'VIEW,' || kind AS action, 'BROWSABLE' AS category,
 'deeplink:' || component || ':' || coalesce(scheme, 'None') || ':' || coalesce(host, 'None') || ':' || coalesce(path, path_prefix, 'None') AS node_key FROM l WHERE coalesce(scheme, host, path, path_prefix) IS NOT NULL""", "component"))
def semantic_deep_links(spark, d):
    return S.deep_links(_components(spark, d))


_EVENTS = " ".join(f"WHEN kind = '{kind}' AND method_name = '{m}' THEN '{e}'" for kind, of in S.LIFECYCLE.items() for m, e in of.items())
_JOINED = "j AS (SELECT c.name, kind, coalesce(exported, false) AS exported, permission, method_name, line, class_name || '#' || method_name AS node_key FROM component c JOIN method ON split_part(class_name, '.', 3) = c.name)"


@query("semantic_entry_points", with_views(f"""WITH {_JOINED}, e AS (SELECT *, CASE {_EVENTS} END AS lifecycle_event FROM j)
SELECT DISTINCT name AS component, kind AS component_type, method_name AS method, lifecycle_event, exported, permission, line, node_key FROM e WHERE lifecycle_event IS NOT NULL""", "component", "method"))
def semantic_entry_points(spark, d):
    return S.entry_points(view(spark, d, "method"), _components(spark, d))


@query("semantic_provider_inputs", with_views(f"""WITH {_JOINED} SELECT DISTINCT 'cpinput:' || node_key AS source_key, node_key, 'ContentProvider.' || method_name AS api, line FROM j WHERE exported AND kind = 'provider' AND method_name IN {S.PROVIDER_INPUTS}""", "component", "method"))
def semantic_provider_inputs(spark, d):
    return S.provider_inputs(view(spark, d, "method"), _components(spark, d))


@query("semantic_boundaries", with_views(f"""WITH m AS (SELECT *, class_name || '#' || method_name AS k FROM method), l AS (SELECT name AS component, CASE WHEN component_id % 4 < 3 THEN kind END AS scheme, CASE WHEN component_id % 2 = 0 THEN name END AS host, CASE WHEN component_id % 3 = 0 THEN '/p' WHEN component_id % 5 = 0 THEN '/q' END AS path FROM component WHERE exported AND has_filter)
SELECT 'EXTERNAL_INTENT' AS boundary_type, name AS component, 'boundary:external_intent:' || name AS node_key, 'HIGH' AS confidence FROM component WHERE exported
UNION SELECT 'DEEP_LINK', component, 'deeplink:' || component || ':' || coalesce(scheme, 'None') || ':' || coalesce(host, 'None') || ':' || coalesce(path, 'None'), 'HIGH' FROM l WHERE coalesce(scheme, host, path) IS NOT NULL
UNION SELECT 'BINDER_IPC', class_name, 'boundary:binder:' || class_name, 'MEDIUM' FROM m WHERE method_name = 'onTransact'
UNION SELECT 'WEBVIEW_JS', NULL, 'jsbridge:' || {_group(S.BRIDGE)}, 'MEDIUM' FROM m WHERE {_has(S.BRIDGE)}
UNION SELECT 'JNI', class_name, 'boundary:jni:' || class_name || '.' || method_name, 'LOW' FROM m WHERE starts_with(method_name, 'run')""", "component", "method"))
def semantic_boundaries(spark, d):
    """Methods named run... stand for those that a library exports; a further half of the bindings are guesses, which make no boundary."""
    methods = view(spark, d, "method")
    sure = F.col("method_name").startswith("run")
    bindings = methods.select(F.when(sure, "ELF_EXPORT").otherwise("GUESS").alias("source"), F.lit("LOW").alias("confidence"), F.col("class_name").alias("java_class"), F.col("method_name").alias("java_method"))
    return S.boundaries(methods, _components(spark, d), bindings)


_SIMPLE = "regexp_extract({}, '([^.$]*)$', 1)".format("class_name")


@query("code_calls", with_views(f"""WITH b AS (SELECT *, class_name || '#' || method_name AS node_key, {_SIMPLE} AS own FROM body), fm AS (SELECT own AS simple, method_name, arg_min(node_key, struct_pack(path := path, ord := ord)) AS dst FROM b GROUP BY 1, 2),
t0 AS (SELECT node_key, path, own, regexp_extract_all(regexp_replace(code, '{C.STRING}', '""', 'g'), '{C.TOKEN}', 0) AS ts FROM b), t AS (SELECT node_key, path, own, generate_subscripts(ts, 1) AS pos, unnest(ts) AS token FROM t0),
k AS (SELECT *, sum(CASE token WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS depth FROM t),
d AS (SELECT path, regexp_extract(token, '{C.DECLARED}', 2) AS on_name, split_part(regexp_extract(token, '{C.DECLARED}', 1), '.', -1) AS type, k.pos AS begun, depth,
 (SELECT min(e.pos) FROM k e WHERE e.path = k.path AND e.token = '}}' AND e.depth + 1 = k.depth AND e.pos > k.pos) AS until FROM k WHERE regexp_matches(token, '{C.DECLARED}')),
c AS (SELECT path, node_key, own, pos, nullif(regexp_extract(token, '{C.CALLED}', 1), '') AS on_name, regexp_extract(token, '{C.CALLED}', 2) AS method_name FROM k WHERE regexp_matches(token, '{C.CALLED}')),
y AS (SELECT c.path, c.pos, arg_max(d.type, d.begun) AS type FROM c JOIN d ON d.path = c.path AND d.on_name = c.on_name AND d.begun < c.pos AND (d.until IS NULL OR d.until > c.pos) GROUP BY 1, 2),
n AS (SELECT node_key, CASE WHEN type IS NOT NULL THEN type WHEN on_name IS NULL OR on_name = 'this' THEN own WHEN regexp_matches(on_name, '^[A-Z]') THEN on_name END AS simple, method_name, type IS NULL AS sure FROM c LEFT JOIN y USING (path, pos) WHERE method_name NOT IN {tuple(sorted(java.KEYWORDS))}
 UNION ALL SELECT node_key, regexp_extract(token, '{C.BUILT}', 1), regexp_extract(token, '{C.BUILT}', 1), true FROM k WHERE regexp_matches(token, '{C.BUILT}'))
SELECT node_key AS src, dst, CASE WHEN bool_or(sure) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM n JOIN fm USING (simple, method_name) WHERE node_key <> dst GROUP BY 1, 2""", "body"))
def code_calls(spark, d):
    """Bodies of one class and method are one method here as far as calls go, but each is read in its own file."""
    return C.resolved(view(spark, d, "body"))

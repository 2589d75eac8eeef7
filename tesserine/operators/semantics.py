"""Framework semantics of method bodies (G2, J7, J12): what the platform calls, what crosses a boundary, and what calls into the framework.

Bodies come without comments and with their string literals (java.methods() gives both and the line
on which a body begins), so constants are read where they stand and everything else is UNKNOWN.
Every detector is one expression over the body; a body is read once for all edges. Components meet
methods by simple names, as keys of one equality join. Reachability is stated, never that it can
be used. Nothing is capped here: findings.capped() bounds a detector's rows and counts the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import java
from . import paths

FRAMEWORK = "android:framework"
#: The methods that the platform calls, by kind of component, and the event that each stands for.
LIFECYCLE = {
    "activity": {"onCreate": "CREATE", "onStart": "START", "onResume": "RESUME", "onPause": "PAUSE", "onStop": "STOP", "onDestroy": "DESTROY", "onNewIntent": "NEW_INTENT"},
    "activity-alias": {"onCreate": "CREATE", "onNewIntent": "NEW_INTENT"},
    "service": {"onCreate": "CREATE", "onStartCommand": "START_COMMAND", "onBind": "BIND", "onUnbind": "UNBIND", "onDestroy": "DESTROY", "onHandleIntent": "HANDLE_INTENT"},
    "receiver": {"onReceive": "RECEIVE"},
    "provider": {"onCreate": "CREATE", "query": "QUERY", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "getType": "GET_TYPE", "openFile": "OPEN_FILE", "openAssetFile": "OPEN_ASSET_FILE", "call": "CALL"},
    "application": {"onCreate": "CREATE"},
}
PROVIDER_INPUTS = ("query", "insert", "update", "delete", "getType", "openFile", "openAssetFile", "call")
#: Operations on intents, and constants beside them.
INTENT_OPERATIONS = (
    ("getIntent", r"\.getIntent\s*\("),
    ("new Intent", r"\bnew\s+Intent\s*\("),
    ("startActivity", r"\.startActivity\s*\("),
    ("startActivityForResult", r"\.startActivityForResult\s*\("),
    ("startService", r"\.startService\s*\("),
    ("bindService", r"\.bindService\s*\("),
    ("sendBroadcast", r"\.sendBroadcast\s*\("),
    ("sendOrderedBroadcast", r"\.sendOrderedBroadcast\s*\("),
)
SENT = ("startActivity", "startService")
ACTIONS = (r'new\s+Intent\s*\(\s*"([^"]+)"', r'\.setAction\s*\(\s*"([^"]+)"')
DATA = r'\.setData\s*\(\s*Uri\.parse\s*\(\s*"([^"]+)"'
CLASS_NAME = r'\.setClassName\s*\(\s*"([^"]+)"\s*,\s*"([^"]+)"'
#: Patterns of framework calls.
BRIDGE = r'\.addJavascriptInterface\s*\(\s*(?:[A-Za-z_]\w*|new\s+[\w.]+)[^,]*,\s*"([^"]+)"'
REFLECTION, REFLECTION_OPEN = r'Class\.forName\s*\(\s*"([^"]+)"', r'Class\.forName\s*\(\s*(?:[^"\s]|$)'
LOADER = r"new\s+(DexClassLoader|PathClassLoader|BaseDexClassLoader|InMemoryDexClassLoader)\s*\(([^)]*)\)"
CRYPTO = r'\b(?:Cipher|MessageDigest|Mac|KeyGenerator)\.getInstance\s*\(\s*"([^"]+)"'
URL, NETWORK = r'new\s+URL\s*\(\s*"([^"]+)"', r"\b(?:HttpURLConnection|OkHttpClient|Retrofit|WebSocket|new\s+Socket)\b"
TLS = r"\b(?:X509TrustManager|HostnameVerifier|SSLContext|setHostnameVerifier)\b"
STORAGE = r"\b(openFileInput|openFileOutput|getFilesDir|getCacheDir|new\s+FileInputStream|new\s+FileOutputStream|getSharedPreferences|SQLiteDatabase|RoomDatabase)\b"
TRANSACT, CASE = r"\.transact\s*\(", r"case\s+(\w+)\s*:"
#: Codes of one transaction that its row names.
CODES = 20
JNI_SOURCES = ("ELF_EXPORT", "JAVA_NATIVE", "JNI_ONLOAD")


def group(pattern: str, n: int = 1) -> Column:
    """What the first match of a pattern in the code holds, or null."""
    found = F.regexp_extract("code", pattern, n)
    return F.when(F.col("code").rlike(pattern), found)


def line_of(pattern: str) -> Column:
    before = F.left("code", F.call_function("instr", F.col("code"), F.regexp_extract("code", pattern, 0)) - 1)
    return F.col("code_line") + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def _with_key(methods: DataFrame) -> DataFrame:
    return methods.withColumn("node_key", java.key())


def of_components(methods: DataFrame, components: DataFrame) -> DataFrame:
    """Methods (node_key, method_name, class_name, line) beside the components (component and all its columns) whose simple name their class has, nested or not."""
    m = _with_key(methods).withColumn("simple", F.explode(F.array_distinct(F.array(java.simple(F.col("class_name")), F.substring_index("class_name", ".", -1)))))
    own = components.withColumnRenamed("name", "component").withColumn("simple", F.substring_index("component", ".", -1))
    return own.join(m.select("simple", "node_key", "method_name", "class_name", "line"), "simple").drop("simple")


def entry_points(methods: DataFrame, components: DataFrame) -> DataFrame:
    """Methods that the platform calls: of each component (name, kind, effective_exported, permission) the lifecycle methods that its class has."""
    known = F.create_map(*(F.lit(x) for kind, of in LIFECYCLE.items() for name, event in of.items() for x in (f"{kind}#{name}", event)))
    listed = F.lower("kind").isin(*LIFECYCLE)
    event = F.when(listed, known[F.concat("kind", F.lit("#"), "method_name")]).when(F.col("method_name") == "onCreate", "CREATE")
    found = of_components(methods, components).withColumn("lifecycle_event", event).where("lifecycle_event IS NOT NULL")
    return found.select("component", F.col("kind").alias("component_type"), F.col("method_name").alias("method"), "lifecycle_event", F.col("effective_exported").alias("exported"), "permission", "line", "node_key").distinct()


def deep_links(components: DataFrame) -> DataFrame:
    """Data of exported components' filters (filters: array of actions, categories and data) that name a scheme, host or path."""
    each = components.where("effective_exported").select(F.col("name").alias("component"), F.explode("filters").alias("f")).select("component", "f.actions", "f.categories", F.explode("f.data").alias("d"))
    d = lambda c: F.col(f"d.{c}")
    place = F.coalesce(d("path"), d("path_prefix"), d("path_pattern"))
    named = each.where(F.coalesce(d("scheme"), d("host"), place).isNotNull())
    told = lambda c: F.coalesce(c, F.lit("None"))
    return named.select(
        "component", "d.scheme", "d.host", "d.port", "d.path", "d.path_prefix", "d.path_pattern", "d.mime_type", F.array_join("actions", ",").alias("action"), F.array_join("categories", ",").alias("category"),
        F.concat_ws(":", F.lit("deeplink"), "component", told(d("scheme")), told(d("host")), told(place)).alias("node_key"),
    )


def provider_inputs(methods: DataFrame, components: DataFrame) -> DataFrame:
    """Methods of exported providers that take what callers give."""
    found = of_components(methods, components.where("effective_exported AND kind = 'provider'")).where(F.col("method_name").isin(*PROVIDER_INPUTS))
    return found.select(F.concat(F.lit("cpinput:"), "node_key").alias("source_key"), "node_key", F.concat(F.lit("ContentProvider."), "method_name").alias("api"), "line").distinct()


def intents(methods: DataFrame) -> DataFrame:
    """A row per method and operation on intents, with the constants of that method."""
    action, data, package, target = F.coalesce(*map(group, ACTIONS)), group(DATA), group(CLASS_NAME), group(CLASS_NAME, 2)
    each = F.array(*(F.when(F.col("code").rlike(p), F.struct(F.lit(n).alias("operation"), line_of(p).cast("int").alias("line"))) for n, p in INTENT_OPERATIONS))
    found = methods.withColumns({"action": action, "data_uri": data, "target_package": package, "target_component": target}).withColumn("o", F.explode(F.filter(each, lambda x: x.isNotNull())))
    sure = F.coalesce("action", "data_uri", "target_component").isNotNull()
    told = F.when(F.col("o.operation").isin(*SENT), F.coalesce("action", F.lit("UNKNOWN"))).otherwise(F.col("action"))
    return found.select("class_name", "method_name", "o.operation", told.alias("action"), "data_uri", "target_package", "target_component", "o.line", F.when(sure, "HIGH").otherwise("MEDIUM").alias("confidence"))


def path_kind(args: Column) -> Column:
    """Where a loader's path comes from."""
    external = args.rlike("|".join(p for _, _, p in java.SOURCES))
    return F.when(args.contains('"'), "static_constant").when(external, "external").otherwise("application_controlled")


def framework_calls(methods: DataFrame) -> DataFrame:
    """Semantic edges of bodies: src, dst, edge_type, evidence, line, confidence. A dynamic target is UNKNOWN."""
    edge = lambda when, dst, kind, evidence, line, confidence="MEDIUM": F.when(
        when, F.struct(dst.alias("dst"), F.lit(kind).alias("edge_type"), evidence.alias("evidence"), line.cast("int").alias("line"), F.lit(confidence).alias("confidence"))
    )
    has = lambda p: F.col("code").rlike(p)
    none = F.lit(None).cast("int")
    one = [
        edge(has(BRIDGE), F.concat(F.lit("jsbridge:"), group(BRIDGE)), "WEBVIEW_BRIDGE", F.concat(F.lit('addJavascriptInterface(..., "'), group(BRIDGE), F.lit('")')), line_of(BRIDGE)),
        edge(has(REFLECTION), F.concat(F.lit("reflect:"), group(REFLECTION)), "REFLECTION_TARGET", F.concat(F.lit("constant target "), group(REFLECTION)), line_of(REFLECTION)),
        edge(~has(REFLECTION) & has(REFLECTION_OPEN), F.lit("reflect:UNKNOWN"), "REFLECTION_TARGET", F.lit("dynamic target UNKNOWN"), none, "UNKNOWN"),
        edge(has(LOADER), F.concat(F.lit("dynload:"), path_kind(group(LOADER, 2))), "DYNAMIC_LOAD", F.concat_ws(" path=", group(LOADER), path_kind(group(LOADER, 2))), line_of(LOADER)),
        edge(has(URL) | has(NETWORK), F.lit("network"), "NETWORK", F.concat(F.lit("url="), F.coalesce(group(URL), F.lit("UNKNOWN")), F.when(has(TLS), ", tls=custom").otherwise(", tls=default")), none),
        edge(has(STORAGE), F.lit("storage"), "STORAGE", F.concat(F.lit("storage API "), group(STORAGE)), line_of(STORAGE)),
    ]
    names = F.regexp_extract_all("code", F.lit(CRYPTO), F.lit(1))
    kind = "struct<dst:string,edge_type:string,evidence:string,line:int,confidence:string>"
    crypto = F.transform(names, lambda a: F.struct(F.concat(F.lit("crypto:"), a).alias("dst"), F.lit("CRYPTO").alias("edge_type"), F.concat(F.lit("algorithm="), a).alias("evidence"), none.alias("line"), F.lit("HIGH").alias("confidence")).cast(kind))
    every = F.concat(F.filter(F.array(*(o.cast(kind) for o in one)), lambda e: e.isNotNull()), crypto)
    return _with_key(methods).select(F.col("node_key").alias("src"), F.explode(every).alias("e")).select("src", "e.*")


def transactions(methods: DataFrame) -> DataFrame:
    """Binder entries, with the codes that they tell apart, and calls of transact()."""
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all("code", F.lit(CASE), F.lit(1))))
    m = methods.withColumn("codes", codes)
    told = F.when(F.size("codes") > 0, F.array_join(F.slice("codes", 1, CODES), ","))
    entries = m.where("method_name = 'onTransact'").select(F.lit("SERVICE_ENTRY").alias("kind"), "class_name", "method_name", told.alias("transaction_code"), F.when(F.size("codes") > 0, "MEDIUM").otherwise("LOW").alias("confidence"))
    none = F.lit(None).cast("string")
    return entries.unionByName(m.where(F.col("code").rlike(TRANSACT)).select(F.lit("CLIENT_INVOKE").alias("kind"), "class_name", "method_name", none.alias("transaction_code"), F.lit("LOW").alias("confidence")))


def boundaries(methods: DataFrame, components: DataFrame, bindings: DataFrame) -> DataFrame:
    """Where trust changes: exported components, deep links, binder entries, bridges into web views, native methods that a library exports (bindings: source, confidence, java_class, java_method)."""
    row = lambda df, kind, component, key, confidence: df.select(F.lit(kind).alias("boundary_type"), component.alias("component"), key.alias("node_key"), confidence.alias("confidence"))
    high, medium = F.lit("HIGH"), F.lit("MEDIUM")
    jni = bindings.where("source = 'ELF_EXPORT' AND coalesce(java_class, '') <> '' AND coalesce(java_method, '') <> ''")
    return (
        row(components.where("effective_exported"), "EXTERNAL_INTENT", F.col("name"), F.concat(F.lit("boundary:external_intent:"), "name"), high)
        .unionByName(row(deep_links(components), "DEEP_LINK", F.col("component"), F.col("node_key"), high))
        .unionByName(row(methods.where("method_name = 'onTransact'"), "BINDER_IPC", F.col("class_name"), F.concat(F.lit("boundary:binder:"), "class_name"), medium))
        .unionByName(row(framework_calls(methods).where("edge_type = 'WEBVIEW_BRIDGE'"), "WEBVIEW_JS", F.lit(None).cast("string"), F.col("dst"), medium))
        .unionByName(row(jni, "JNI", F.col("java_class"), F.concat(F.lit("boundary:jni:"), "java_class", F.lit("."), "java_method"), F.col("confidence")))
        .distinct()
    )


def native_edges(bindings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bindings as edges from a Java method to its native function, where both are nodes."""
    sure = bindings.where(F.col("source").isin(*JNI_SOURCES))
    ends = sure.select(F.concat("java_class", F.lit("#"), "java_method").alias("src"), F.concat_ws(":", F.lit("nfunc"), "library_name", "native_function").alias("dst"), "confidence")
    known = nodes.select(F.col("node_key").alias("src"))
    both = ends.join(known, "src", "left_semi").join(known.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return both.select("src", "dst", F.lit("BINDS_TO").alias("edge_type"), "confidence")


def augmented(nodes: DataFrame, edges: DataFrame, methods: DataFrame, components: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A code graph (java.code_graph) with the framework's nodes and edges beside its own."""
    entries, links, inputs, limits = entry_points(methods, components), deep_links(components), provider_inputs(methods, components), boundaries(methods, components, bindings)
    edge = lambda df, src, dst, kind, confidence="HIGH": df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), F.lit(confidence).alias("confidence"))
    more = (
        edge(entries, F.lit(FRAMEWORK), F.col("node_key"), "FRAMEWORK_DISPATCH")
        .unionByName(edge(entries.where("exported"), F.concat(F.lit("boundary:external_intent:"), "component"), F.col("node_key"), "SECURITY_BOUNDARY"))
        .unionByName(edge(links.select("component", F.col("node_key").alias("link")).join(entries.where("method IN ('onCreate', 'onNewIntent')"), "component"), F.col("link"), F.col("node_key"), "DEEP_LINK"))
        .unionByName(edge(inputs, F.col("source_key"), F.col("node_key"), "FLOWS_INTO", "MEDIUM"))
        .unionByName(edge(_with_key(methods.where("method_name = 'onTransact'")), F.concat(F.lit("boundary:binder:"), "class_name"), F.col("node_key"), "IPC_CALL", "MEDIUM"))
        .unionByName(framework_calls(methods).where("edge_type IN ('WEBVIEW_BRIDGE', 'REFLECTION_TARGET', 'DYNAMIC_LOAD')").select("src", "dst", "edge_type", "confidence"))
    )
    node = lambda df, key, kind, label: df.select(key.alias("node_key"), F.lit(kind).alias("node_type"), label.alias("label"))
    found = (
        nodes.unionByName(node(limits, F.col("node_key"), "SECURITY_BOUNDARY", F.concat_ws(":", "boundary_type", "component")))
        .unionByName(node(inputs, F.col("source_key"), "DATAFLOW_SOURCE", F.col("api")))
        .unionByName(node(entries.limit(1), F.lit(FRAMEWORK), "FRAMEWORK", F.lit("Android Framework")))
        .distinct()
    )
    return found, edges.unionByName(more).unionByName(native_edges(bindings, found)).distinct()


def findings(nodes: DataFrame, edges: DataFrame, methods: DataFrame, components: DataFrame) -> DataFrame:
    """What the augmented graph says, a row per rule and subject: rule_id, subject, severity, path (the shortest, or null)."""
    entries = entry_points(methods, components).where("exported")
    sinks = nodes.where("node_type = 'SECURITY_SINK'").select("node_key", F.substring_index("node_key", ":", -1).alias("kind"))
    keys = lambda df, c="node_key": df.select(F.col(c).alias("node_key")).distinct()
    sources, entry_keys = nodes.where("node_type = 'DATAFLOW_SOURCE'"), keys(entries)
    providers = keys(entries.where(F.col("component_type") == "provider").where(F.col("method").isin(*PROVIDER_INPUTS)))
    binders = nodes.where(F.col("node_key").startswith("boundary:binder:"))

    def reached(rule: str, starts: DataFrame, targets: DataFrame) -> DataFrame:
        found = paths.shortest_paths(edges, starts, targets)
        least = found.groupBy("target").agg(F.min_by("path", F.struct("length", "path")).alias("path"))
        return least.select(F.lit(rule).alias("rule_id"), F.col("target").alias("subject"), F.lit("medium").alias("severity"), "path")

    none = F.lit(None).cast("string").alias("path")
    acquired = edges.where("edge_type = 'FLOWS_INTO'").join(keys(sources).withColumnRenamed("node_key", "src"), "src", "left_semi").select(F.col("dst").alias("node_key")).distinct()
    received = entries.join(acquired, "node_key", "left_semi").select(F.lit("ANDROID-SEMANTIC-001").alias("rule_id"), F.col("component").alias("subject"), F.lit("low").alias("severity"), none).distinct()
    bridges = edges.where("edge_type = 'WEBVIEW_BRIDGE'").select("src", "dst")
    ways = paths.shortest_paths(edges, entry_keys, keys(bridges, "dst")).select(F.col("target").alias("dst"), F.lit(True).alias("way")).distinct()
    exposed = bridges.select("dst").distinct().join(ways, "dst", "left").select(F.lit("ANDROID-SEMANTIC-004").alias("rule_id"), F.col("dst").alias("subject"), F.when(F.col("way"), "medium").otherwise("low").alias("severity"), none)
    return (
        received.unionByName(reached("ANDROID-SEMANTIC-002", providers, sinks.where("kind = 'file_write'")))
        .unionByName(reached("ANDROID-SEMANTIC-003", binders, sinks)).unionByName(exposed)
        .unionByName(reached("ANDROID-SEMANTIC-005", sources, sinks.where("kind = 'dynamic_loading'")))
    )

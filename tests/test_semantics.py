"""Framework semantics of source text: the nine cases, and what detectors read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserine.operators import paths as P
from tesserine.operators import semantics as S
from tesserine.sources import java

FILTERS = "array<struct<actions:array<string>,categories:array<string>,data:array<struct<scheme:string,host:string,port:string,path:string,path_prefix:string,path_pattern:string,mime_type:string>>>>"
COMPONENT = f"name string, kind string, effective_exported boolean, permission string, filters {FILTERS}"
BINDING = "source string, confidence string, java_class string, java_method string, library_name string, native_function string"
LINK = [(["android.intent.action.VIEW"], ["android.intent.category.BROWSABLE"], [("https", "example.com", None, "/doc", None, None, None), (None, None, None, None, None, None, "text/plain")])]
FILES = {
    "A1": 'class A1 { public void onCreate(){ String s=getIntent().getStringExtra("x"); load(s);} void load(String s){ Class.forName(s);} }',
    "DL": 'class DL { public void onCreate(){ String id=getIntent().getData().getQueryParameter("id"); web.loadUrl(id);} }',
    "Rcv": 'class Rcv { public void onReceive(Object c, Object i){ String s=i.getStringExtra("x"); } }',
    "Prov": 'class Prov { public Object query(Object uri, Object proj){ new FileOutputStream("/tmp/x"); return null; } }',
    "Svc": 'class Svc { public boolean onTransact(int code, Object d, Object r, int f){ switch(code){ case 2: case 1: Runtime.getRuntime().exec("x"); } return true; } }',
    "W": 'class W { void onCreate(){ web.addJavascriptInterface(new B(), "androidBridge"); } }',
    "R": 'class R { void onCreate(){ Class.forName("com.example.Target"); } }',
    "D": 'class D { void onCreate(){ new DexClassLoader("/data/x.dex", null, null, null); } }',
    "D2": 'class D2 { void onCreate(){ String p=getIntent().getStringExtra("p"); new DexClassLoader(p, null, null, null); } }',
    "S9": 'class S9 { void onCreate(){ String u=getIntent().getStringExtra("u"); log(u);} void log(String s){} }',
    "K9": 'class K9 { void other(){ Runtime.getRuntime().exec("id"); } }',
    "I": 'class I {\n void go(){ // .startService(\n Intent x = new Intent("android.intent.action.VIEW");\n a.startActivity(x); b.transact(1); } }',
    "N": 'class N { void run(){ Cipher.getInstance("AES"); MessageDigest.getInstance("MD5"); new URL("http://h/"); SSLContext c; getCacheDir(); /* Mac.getInstance("no") */ } }',
    "J": "class J { void call(){ go(); } void go(){ } }",
}
COMPONENTS = [(".A1", "activity"), (".DL", "activity"), (".Rcv", "receiver"), (".Prov", "provider"), (".Svc", "service"), (".W", "activity"), (".R", "activity"), (".D", "activity"), (".D2", "activity"), (".S9", "activity")]


@pytest.fixture(scope="module")
def told(spark):
    files = spark.createDataFrame([(f"p/{n}.java", f"package p;\n{t}") for n, t in FILES.items()], "path string, text string")
    components = spark.createDataFrame([(n, k, True, None, LINK if n == ".DL" else []) for n, k in COMPONENTS] + [(".K9", "activity", False, None, [])], COMPONENT)
    bindings = spark.createDataFrame([("ELF_EXPORT", "LOW", "p.J", "go", "libn.so", "Java_p_J_go"), ("GUESS", "HIGH", "p.J", "call", "libn.so", "x"), ("ELF_EXPORT", "HIGH", None, "go", "libn.so", "y")], BINDING)
    methods = java.methods(files).cache()
    nodes, edges = java.code_graph(methods, components.select("name", "effective_exported"))
    nodes = nodes.unionByName(spark.createDataFrame([("nfunc:libn.so:Java_p_J_go", "NATIVE_FUNCTION", "Java_p_J_go")], nodes.schema))
    nodes, edges = S.augmented(nodes, edges, methods, components, bindings)
    return methods, components, bindings, nodes.cache(), edges.cache()


def test_nine_cases(told):
    methods, components, _, nodes, edges = told
    got = {(r.rule_id[-3:], r.subject, r.severity) for r in S.findings(nodes, edges, methods, components).collect()}
    assert {s for rule, s, _ in got if rule == "001"} == {".A1", ".DL", ".Rcv", ".D2", ".S9", ".Prov"}
    assert {x for x in got if x[0] != "001"} == {
        ("002", "sink:p.Prov#query:file_write", "medium"), ("003", "sink:p.Svc#onTransact:command_exec", "medium"), ("004", "jsbridge:androidBridge", "medium"), ("005", "sink:p.D2#onCreate:dynamic_loading", "medium"),
    }
    apart = P.shortest_paths(edges, nodes.where("node_key LIKE 'src:p.S9%'"), nodes.where("node_key = 'sink:p.K9#other:command_exec'"))
    assert apart.count() == 0


def test_entries_links_and_inputs(told):
    methods, components, bindings, nodes, edges = told
    entries = {(r.component, r.method, r.lifecycle_event, r.exported) for r in S.entry_points(methods, components).collect()}
    assert {(".Rcv", "onReceive", "RECEIVE", True), (".Prov", "query", "QUERY", True), (".A1", "onCreate", "CREATE", True)} <= entries and not any(m == "onTransact" for _, m, _, _ in entries)
    (link,) = S.deep_links(components).collect()
    assert (link.component, link.scheme, link.host, link.path, link.action, link.node_key) == (".DL", "https", "example.com", "/doc", "android.intent.action.VIEW", "deeplink:.DL:https:example.com:/doc")
    assert [r.api for r in S.provider_inputs(methods, components).collect()] == ["ContentProvider.query"]
    kinds = {(r.edge_type, r.dst) for r in edges.where("src LIKE 'deeplink%' OR src = 'android:framework'").collect()}
    assert ("DEEP_LINK", "p.DL#onCreate") in kinds and ("FRAMEWORK_DISPATCH", "p.Rcv#onReceive") in kinds
    limits = {(r.boundary_type, r.confidence) for r in S.boundaries(methods, components, bindings).where("boundary_type IN ('JNI', 'BINDER_IPC', 'WEBVIEW_JS')").collect()}
    assert limits == {("JNI", "LOW"), ("BINDER_IPC", "MEDIUM"), ("WEBVIEW_JS", "MEDIUM")}


def test_low_binding_ends_a_path_with_low_confidence(told):
    _, _, _, nodes, edges = told
    (path,) = P.shortest_paths(edges, nodes.where("node_key = 'p.J#call'"), nodes.where("node_type = 'NATIVE_FUNCTION'")).collect()
    assert (path.path, path.confidence) == ("p.J#call > p.J#go > nfunc:libn.so:Java_p_J_go", "LOW")


def test_what_detectors_read(told):
    methods = told[0]
    calls = {(r.src, r.edge_type, r.dst, r.confidence) for r in S.framework_calls(methods).collect()}
    assert {("p.A1#load", "REFLECTION_TARGET", "reflect:UNKNOWN", "UNKNOWN"), ("p.R#onCreate", "REFLECTION_TARGET", "reflect:com.example.Target", "MEDIUM"), ("p.D#onCreate", "DYNAMIC_LOAD", "dynload:static_constant", "MEDIUM"), ("p.D2#onCreate", "DYNAMIC_LOAD", "dynload:application_controlled", "MEDIUM")} <= calls
    assert {x[1:3] for x in calls if x[0] == "p.N#run"} == {("CRYPTO", "crypto:AES"), ("CRYPTO", "crypto:MD5"), ("NETWORK", "network"), ("STORAGE", "storage")}
    assert S.framework_calls(methods).where("edge_type = 'NETWORK'").first().evidence == "url=http://h/, tls=custom"
    assert sorted((r.operation, r.action, r.line, r.confidence) for r in S.intents(methods.where("method_name = 'go'")).collect()) == [("new Intent", "android.intent.action.VIEW", 4, "HIGH"), ("startActivity", "android.intent.action.VIEW", 5, "HIGH")]
    assert sorted((r.kind, r.class_name, r.transaction_code, r.confidence) for r in S.transactions(methods).collect()) == [("CLIENT_INVOKE", "p.I", None, "LOW"), ("SERVICE_ENTRY", "p.Svc", "1,2", "MEDIUM")]


def test_nothing_and_nulls(spark):
    methods = java.methods(spark.createDataFrame([("a", None), ("b", "")], "path string, text string"))
    components = spark.createDataFrame([(None, None, None, None, None)], COMPONENT)
    assert S.entry_points(methods, components).count() == S.deep_links(components).count() == S.framework_calls(methods).count() == S.intents(methods).count() == 0
    assert S.framework_calls(methods.withColumn("code", F.lit(None).cast("string"))).count() == 0

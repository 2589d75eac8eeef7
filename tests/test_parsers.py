"""Java source, code graphs from it, and shared objects."""

from __future__ import annotations

import glob

import pytest

from tesserine.operators import graphs as G
from tesserine.operators import paths as P
from tesserine.sources import elf, java

WEB = 'package com.x; class Web extends Activity { void onCreate(Bundle b) { String u = getIntent().getStringExtra("u"); show(u); } void show(String u) { w.loadUrl(u); } }'
APART = 'package com.x; class A { void a() { i.getStringExtra("x"); } } class B { void b() { Runtime.getRuntime().exec("x"); } }'
TRICKY = 'package p;\n// class No { void no() { } }\nclass Out { String s = "} { void bad() {"; /* { */\n  static class In { int f(int a) { if (a > 0) { return 1; } return g(); } }\n  int g() { return 2; } }'


def test_methods_and_nesting():
    got = [(c, m, line) for _, c, m, line, *_ in java.methods_of("T", TRICKY)]
    assert got == [("p.Out$In", "f", 4), ("p.Out", "g", 5)]
    assert java.methods_of("E", None) == java.methods_of("E", "") == []
    assert len(java.blanked(TRICKY)) == len(TRICKY)


def graph(spark, *texts):
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    components = spark.createDataFrame([("com.x.Web", True), ("com.x.A", False)], "name string, effective_exported boolean")
    nodes, edges = java.code_graph(java.methods(files), components)
    starts = nodes.where("node_type IN ('ENTRY_POINT', 'DATAFLOW_SOURCE')")
    return P.shortest_paths(G.connected(edges, nodes), starts, nodes.where("node_type = 'SECURITY_SINK'"), 10).collect()


def test_intent_extra_reaches_webview(spark):
    got = {r.path for r in graph(spark, WEB)}
    assert got == {"src:com.x.Web#onCreate:intent > com.x.Web#onCreate > com.x.Web#show > sink:com.x.Web#show:webview", "entry:com.x.Web > com.x.Web#onCreate > com.x.Web#show > sink:com.x.Web#show:webview"}


def test_unrelated_source_and_sink(spark):
    assert graph(spark, APART) == []


def test_shared_object(spark):
    found = glob.glob("/lib/*/libm.so.6") + glob.glob("/usr/lib/*/libm.so.6")
    if not found:
        pytest.skip("no shared object at hand")
    with open(found[0], "rb") as f:
        blob = f.read()
    df = spark.createDataFrame([("m", blob), ("x", b"text"), ("t", blob[:5000]), ("n", None)], "path string, content binary")
    rows = elf.symbols(df).collect()
    mine = [r for r in rows if r.path == "m"]
    assert {r.status for r in mine} == {"COMPLETE"} and mine[0].soname == "libm.so.6" and "libc.so.6" in mine[0].needed
    assert any(r.name == "cos" and r.kind == "exported" for r in mine) and len({(r.name, r.kind) for r in mine}) == len(mine)
    assert {r.path: r.status for r in rows if r.path != "m"} == {"x": "not_elf", "t": "malformed", "n": "not_elf"}
    kept = elf.bounded(spark.createDataFrame([("a", "local", f"l{i}") for i in range(7)] + [("a", "exported", "e"), ("b", None, None)], "path string, kind string, name string"), 5)
    assert sorted((r.path, r.kind or "", r.truncated) for r in kept.collect()) == [("a", "exported", True)] + [("a", "local", True)] * 5 + [("b", "", False)]

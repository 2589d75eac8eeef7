"""Typed call resolution on small sources."""

from __future__ import annotations

from tesserine.operators import calls as C
from tesserine.sources import java

SOURCE = """package p;
class Main {
  void go() {
    Foo a = make(); a.run();
    if (x) { Bar a = new Bar(1); a.run(); String s = "Baz b = q; b.run()"; }
    a.stop(); b.run(); Baz.help(); com.q.Baz.more(); this.make(); make().run(); List<Baz> items = x; items.add(1);
  }
  Foo make() { return null; }
  void late() { { Foo c = x; } c.run(); }
  void again() { Foo d; d.run(); Bar d = y; d.run(); again(); }
}
class Foo { void run() { } void stop() { } }
class Bar { Bar(int n) { } void run() { } }
class Baz { static void help() { } static void more() { } void run() { } }
"""


def edges(spark, *texts):
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    return java.methods(files)


def test_last_declaration_that_still_holds_counts(spark):
    got = {(r.src[2:], r.dst[2:], r.confidence) for r in C.resolved(edges(spark, SOURCE)).collect()}
    assert got == {
        ("Main#go", "Foo#run", "LOW"), ("Main#go", "Bar#run", "LOW"), ("Main#go", "Foo#stop", "LOW"), ("Main#go", "Bar#Bar", "MEDIUM"), ("Main#go", "Baz#help", "MEDIUM"), ("Main#go", "Baz#more", "MEDIUM"),
        ("Main#go", "Main#make", "MEDIUM"), ("Main#again", "Foo#run", "LOW"), ("Main#again", "Bar#run", "LOW"),
    }


def test_first_method_in_file_order_and_nothing(spark):
    got = C.resolved(edges(spark, "package a; class T { void f() { U.g(); } }", "package b; class U { void g() { } }", "package c; class U { void g() { } }")).collect()
    assert [(r.src, r.dst) for r in got] == [("a.T#f", "b.U#g")]
    assert C.resolved(edges(spark, None, "")).count() == 0


def test_components_meet_full_names_first(spark):
    methods = edges(spark, "package p; class Web { void onCreate() { } void onBind() { } }", "package q; class Web { void onCreate() { } }", "package r; class Svc { void onBind() { } }")
    components = spark.createDataFrame([("p.Web", "activity", True), (".Svc", "service", True), ("z.Web", "widget", True), ("q.Web", "activity", False), (None, None, True)], "name string, kind string, effective_exported boolean")
    got = {(r.name, r.node_key) for r in C.component_methods(components, methods).collect()}
    assert got == {("p.Web", "p.Web#onCreate"), (".Svc", "r.Svc#onBind"), ("z.Web", "p.Web#onCreate"), ("z.Web", "q.Web#onCreate")}

"""Queries over every row of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine import plans
from tesserine.sources.bridge import table, view

QUERIES, SQL = plans.load()


def test_graphs_have_every_edge(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    want = orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct().count()
    want += line.select("l_partkey", "l_suppkey").distinct().count()
    want += sum(table(spark, sf_dir, t).count() for t in ("nation", "customer", "supplier"))
    assert QUERIES["graph_dot_lines"](spark, sf_dir).count() == want
    arcs, known = {}, {r.node_key for r in view(spark, sf_dir, "node").collect()}
    for r in view(spark, sf_dir, "edge").collect():
        if r.src in known and r.dst in known:
            arcs.setdefault(r.src, set()).add(r.dst)
    steps = {r.node_key: 0 for r in view(spark, sf_dir, "node").where("node_type = 'ENTRY_POINT'").collect()}
    todo = list(steps)
    for n in todo:
        for m in sorted(arcs.get(n, set()) - steps.keys()):
            steps[m] = steps[n] + 1
            todo.append(m)
    assert {r.node_key: r.steps for r in QUERIES["graph_reachable_set"](spark, sf_dir).collect()} == steps


def test_evidence_has_every_row(spark, sf_dir):
    events, parts = table(spark, sf_dir, "events").count(), table(spark, sf_dir, "part").count()
    assert QUERIES["validation_claims"](spark, sf_dir).agg(F.sum("n_evidence")).first()[0] == events
    assert QUERIES["native_reconcile"](spark, sf_dir).agg(F.count("*")).first()[0] >= min(parts, 700)
    assert QUERIES["runtime_correlation"](spark, sf_dir).where("NOT linked").count() == 0

"""Path searches against a plain walk over small cyclic graphs."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesserine import plans
from tesserine.functions.lineage import CLEANUP, kept
from tesserine.operators import paths as P
from tesserine.sources.bridge import view

RANK = {"UNKNOWN": -1, "LOW": 0, "MEDIUM": 1, "HIGH": 2, "EXACT": 3}


def every_path(arcs, start, targets, max_nodes):
    """All paths without a repeated node from start to a target, which ends it."""
    out, todo = [], [[start]]
    while todo:
        path = todo.pop()
        if len(path) > 1 and path[-1] in targets:
            out.append(path)
        elif len(path) < max_nodes:
            todo += [[*path, n] for n in arcs.get(path[-1], {}) if n not in path]
    return sorted(out, key=lambda p: (len(p), p))


def a_graph(seed, n, m):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(("CALLS", "INVOKES")), rng.choice(list(RANK))) for _ in range(m)]
    arcs = {}
    for s, d, _, c in rows:
        arcs.setdefault(s, {})[d] = max(RANK[c], arcs.get(s, {}).get(d, -1))
    return rows, arcs, [f"n{i}" for i in range(n)]


def with_confidence(arcs, path):
    weakest = min(arcs[a][b] for a, b in zip(path, path[1:], strict=False))
    return path[0], path[-1], " > ".join(path), len(path), next(k for k, v in RANK.items() if v == weakest)


def rows_of(made):
    return sorted((r.start, r.target, r.path, r.length, r.confidence) for r in made.collect())


@pytest.mark.parametrize("seed, n, m, depth", [(1, 8, 16, 25), (3, 9, 22, 4), (4, 70, 80, 25)])
def test_paths_equal_brute_force(spark, seed, n, m, depth):
    rows, arcs, names = a_graph(seed, n, m)
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string, confidence string")
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "node_key string")
    starts, targets = names[:3], names[2:] if n > 60 else names[2:5]
    every = [p for s in starts for p in every_path(arcs, s, set(targets), depth)]
    shortest = {}
    for p in sorted(every, key=lambda p: (len(p), p)):
        shortest.setdefault((p[0], p[-1]), p)
    assert rows_of(P.shortest_paths(edges, keys(starts), keys(targets), depth)) == sorted(with_confidence(arcs, p) for p in shortest.values())
    for k, most in ((3, None), (2, 4)) if n < 60 else ():
        first, of = [], {}
        for p in sorted(every, key=lambda p: (len(p), " > ".join(p))):
            of[p[0], p[-1]] = of.get((p[0], p[-1]), 0) + 1
            if of[p[0], p[-1]] <= k:
                first.append(p)
        assert rows_of(P.k_paths(edges, keys(starts), keys(targets), k, depth, most)) == sorted(with_confidence(arcs, p) for p in first[:most])


def test_no_starts_no_targets_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string, edge_type string, confidence string")
    some = spark.createDataFrame([("a", "b", "CALLS", "HIGH")], none.schema)
    key, no_key = spark.createDataFrame([("a",)], "node_key string"), spark.createDataFrame([], "node_key string")
    for edges, starts, targets in ((none, key, key), (some, no_key, key), (some, key, no_key)):
        assert P.shortest_paths(edges, starts, targets).count() == 0
        assert P.k_paths(edges, starts, targets, 5).count() == 0


def test_depth_counts_nodes_and_a_long_chain_is_found(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "CALLS", "HIGH") for i in range(7)], "src string, dst string, edge_type string, confidence string")
    start, target = (spark.createDataFrame([(k,)], "node_key string") for k in ("n000", "n007"))
    assert P.shortest_paths(chain, start, target, 1).count() == P.shortest_paths(chain, start, target, 7).count() == 0
    assert P.shortest_paths(chain, start, target).first().length == P.k_paths(chain, start, target, 2).first().length == 8


def test_edges_by_type_and_confidence_and_open_ends(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS", "LOW"), ("a", "c", "RETURNS", "HIGH"), ("b", "d", "CALLS", "MEDIUM")], "src string, dst string, edge_type string, confidence string")
    assert {(r.src, r.dst) for r in P.selected(edges, ("CALLS",), "MEDIUM").collect()} == {("b", "d")}
    nodes = spark.createDataFrame([(k,) for k in "abcd"], "node_key string")
    calls = spark.createDataFrame([("d", "a"), ("d", "dlsym"), ("b", None)], "src string, dst string")
    more, ends = P.with_open_ends(edges, nodes, calls)
    assert {r.node_key for r in ends.collect()} == {"unresolved:dlsym", "unresolved:UNKNOWN"}
    start = spark.createDataFrame([("a",)], "node_key string")
    assert {(r.path, r.confidence) for r in P.shortest_paths(more, start, ends).collect()} == {("a > b > unresolved:UNKNOWN", "UNKNOWN"), ("a > b > d > unresolved:dlsym", "UNKNOWN")}


@pytest.mark.parametrize("seed, n, m, whole", [(8, 9, 20, 4), (8, 9, 22, 4)])
def test_no_path_of_up_to_whole_nodes_is_left_out(spark, seed, n, m, whole):
    rows, arcs, names = a_graph(seed, n, m)
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string, confidence string")
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "node_key string")
    want, of, more, later = [], {}, 0, 0
    for p in sorted((p for s in names[:3] for p in every_path(arcs, s, set(names[2:5]), 25)), key=lambda p: (len(p), " > ".join(p))):
        nth = of[p[0], p[-1]] = of.get((p[0], p[-1]), 0) + 1
        if len(p) <= whole or nth <= 2:
            want.append(p)
        more += len(p) <= whole and nth > 2
        later += len(p) > whole and nth <= 2
    assert more and later  # both kinds are there
    assert rows_of(P.k_paths(edges, keys(names[:3]), keys(names[2:5]), 2, whole=whole)) == sorted(with_confidence(arcs, p) for p in want)


def test_simple_paths_has_every_path_of_five_nodes(spark, sf_dir):
    arcs, kinds = {}, {r.node_key: r.node_type for r in view(spark, sf_dir, "node").collect()}
    for r in view(spark, sf_dir, "edge").collect():
        if r.src in kinds and r.dst in kinds:
            arcs.setdefault(r.src, {})[r.dst] = True
    sinks = {k for k, t in kinds.items() if t == "SECURITY_SINK"}
    want = sorted(" > ".join(p) for s, t in kinds.items() if t == "ENTRY_POINT" for p in every_path(arcs, s, sinks, 5))
    got = sorted(r.path for r in plans.load()[0]["graph_simple_paths"](spark, sf_dir).collect() if r.length <= 5)
    assert got == want and len(want) > 20 * 5 * len(sinks)  # more than twenty a pair


@pytest.mark.parametrize("seed, n, m, depth, busy", [(1, 8, 16, 25, 1000), (3, 9, 22, 4, 2), (4, 70, 80, 25, 3), (7, 9, 30, 25, 1)])
def test_forward_paths_equal_brute_force(spark, monkeypatch, seed, n, m, depth, busy):
    monkeypatch.setattr(P, "BUSY", busy)
    monkeypatch.setattr(P, "LIST", 2)
    rows, arcs, names = a_graph(seed, n, m)
    edges = spark.createDataFrame([*rows, ("none", names[2], "CALLS", "HIGH"), (names[0], "none", "CALLS", "HIGH")], "src string, dst string, edge_type string, confidence string")
    starts, targets = names[:3], names[2:] if n > 60 else names[2:5]  # one start is a target itself
    shortest = {}
    for p in sorted((p for s in starts for p in every_path(arcs, s, set(targets), depth)), key=lambda p: (len(p), p)):
        shortest.setdefault((p[0], p[-1]), p)
    nodes = spark.createDataFrame([(k,) for k in names], "node_key string")
    begin = spark.createDataFrame([(k, "ab"[k == names[0]]) for k in starts], "node_key string, family string")
    ends = spark.createDataFrame([(k, k != targets[-1]) for k in targets], "node_key string, wanted boolean")
    want = [p for p in shortest.values() if p[-1] != targets[-1]]
    assert rows_of(P.forward_paths(edges, begin.drop("family"), ends, depth, nodes)) == sorted(with_confidence(arcs, p) for p in want)
    for some in (begin, begin.where(f"node_key <> '{names[2]}'")):  # with and without the start that is a target
        has, least = {r.node_key: r.family for r in some.collect()}, {}
        for p in sorted((p for p in want if p[0] in has), key=lambda p: (len(p), p)):
            least.setdefault((has[p[0]], p[-1]), p)
        got = P.forward_paths(edges, some, ends, depth, nodes)
        assert sorted((r.family, r.start, r.target, r.path, r.length, r.confidence) for r in got.collect()) == sorted((k[0], *with_confidence(arcs, p)) for k, p in least.items())


def test_what_a_table_was_shuffled_for_is_deleted_with_its_job(spark, tmp_path):
    kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "some")
    assert spark.conf.get(CLEANUP) == "false"  # as it was before
    blocks = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    before = len(list(blocks.rglob("shuffle_*")))
    kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "some")
    assert len(list(blocks.rglob("shuffle_*"))) <= before


@pytest.mark.parametrize("most", [3, 40])
def test_least_paths_look_at_near_edges_first(spark, monkeypatch, most):
    rows, arcs, names = a_graph(8, 9, 20)
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string, confidence string")
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "node_key string")
    every = sorted((p for s in names[:3] for p in every_path(arcs, s, set(names[2:5]), 25)), key=lambda p: (len(p), " > ".join(p)))
    of, want = {}, []
    for p in every:
        of[p[0], p[-1]] = of.get((p[0], p[-1]), 0) + 1
        if of[p[0], p[-1]] <= 2:
            want.append(p)
    depths, search = [], P.k_paths
    monkeypatch.setattr(P, "k_paths", lambda *a: depths.append(a[4]) or search(*a))
    got = P.least_paths(edges, keys(names[:3]), keys(names[2:5]), 2, most, keys(names))
    assert rows_of(got) == sorted(with_confidence(arcs, p) for p in want[:most])
    assert depths == ([3] if most == 3 else [3, 6, 12, 25])

"""Substring and suffix joins against every pair."""

from __future__ import annotations

import random

from tesserine.operators import contained as C


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda most: "".join(rng.choice("abé.") for _ in range(rng.randint(0, most)))
    hays, needles = [("A" if i % 3 else "B", word(14)) for i in range(200)] + [("A", None)], [("A" if i % 2 else "B", word(7)) for i in range(60)] + [("A", None)]
    h, n = spark.createDataFrame(hays, "k string, hay string"), spark.createDataFrame(needles, "k string, needle string")
    for join, test in ((C.containing, lambda a, b: b in a), (C.ending, lambda a, b: a.endswith(b))):
        want = {(k, a, b) for k, a in hays for j, b in needles if a is not None and b and k == j and test(a, b)}
        got = [(r.k, r.hay, r.needle) for r in join(h, n, "hay", "needle", ("k",)).collect()]
        assert set(got) == want and len(got) == len(want)
        assert join(h, n.where("1 = 0"), "hay", "needle", ("k",)).count() == join(h.where("1 = 0"), n, "hay", "needle").count() == 0


def test_no_nested_loops(spark):
    h, n = spark.createDataFrame([("x", "abcdef")], "k string, hay string"), spark.createDataFrame([("cdef",)], "needle string")
    for join in (C.containing, C.ending):
        plan = join(h, n, "hay", "needle")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_match_stands(spark):
    deps = spark.createDataFrame([("A", 1, "OkHttp", "com.squareup.core"), ("A", 2, "gson", None), ("A", 3, "ok", "org.ok")], "analysis_id string, dep_id long, name string, package_prefix string")
    meta = spark.createDataFrame([("A", 1, "okhttp", "com.squareup", "3.1"), ("A", 2, "gson", None, "v2"), ("A", 3, "gson-core", "", "2.8"), ("A", 4, "gson", "", "2.9"), ("B", 5, "gson", "", "1")], "analysis_id string, meta_id long, artifact string, grp string, version string")
    assert sorted((r.meta_id, r.dep_id) for r in C.metadata_dependencies(meta, deps).collect()) == [(1, 1), (3, 1), (4, 2)]
    assert sorted((r.dep_id, r.version, r.n_metadata) for r in C.embedded_versions(meta, deps).collect()) == [(1, "2.8", 2), (2, "2.9", 1)]
    paths = spark.createDataFrame([("A", 1, "com.x.Web"), ("A", 2, "entry com.x.Web2"), ("A", 3, "none")], "analysis_id string, path_id long, start_label string")
    nodes = spark.createDataFrame([("A", 5, "n", "com.x.Web2"), ("A", 6, "com.x.Web", None), ("A", 7, "m", "com.x.Web"), ("A", 1, "", "com.x.Web")], "analysis_id string, ord long, name string, component string")
    assert sorted((r.path_id, r.ord) for r in C.path_surface(paths, nodes).collect()) == [(1, 6), (2, 5)]
    ends = spark.createDataFrame([(1, "exec(x)"), (2, "load"), (3, "")], "path_id long, end_label string")
    found = spark.createDataFrame([(9, "R2", "sink exec(x)"), (4, "R1", "other exec(x)"), (1, "R0", "exec(x) no")], "ord long, rule_id string, tail string")
    assert sorted((r.path_id, r.rule_id, r.finding_ord) for r in C.path_rules(ends, found).collect()) == [(1, "R1", 4), (2, None, None), (3, None, None)]

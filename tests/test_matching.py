"""Matching of many dependencies of few kinds."""

from __future__ import annotations

import pytest

from tesserine.functions import skew, versions
from tesserine.operators import vulnerabilities as V

DEPS = "analysis_id string, dep_id long, name string, product string, ecosystem string, cpe string, version string, reach string"
PRODUCTS = "product_id long, cve_id string, ecosystem string, product string, package_name string"
RANGES = "product_id long, ord int, introduced string, fixed string, last_affected string, exact string, raw string"


@pytest.fixture
def tables(spark):
    versions_ = ["1.0", "2.0", None, "UNKNOWN", "trunk"]
    deps = [(f"A{k % 2}", k, f"Lib{k % 3}", "Prod1" if k % 4 == 0 else None, ("maven", "npm", None)[k % 3 if k % 7 else 2], "cpe:2.3:a:v:Other:1" if k % 5 == 0 else None, versions_[k % 5], "R") for k in range(300)]
    deps += [("A0", 0, "other", None, "generic", None, "2.0", "R"), ("A0", 299, None, None, "npm", None, "1.0", "R")]  # one dependency in two rows; one row without a name
    products = [(k, f"C{k % 17}", ("maven", "npm", "generic")[k % 3], f"lib{k % 4}" if k % 9 else "other", "prod1" if k % 6 == 0 else None) for k in range(80)]
    ranges = [(k, 0, "0.5", "1.5", None, None, None) for k in range(80) if k % 5] + [(k, 1, None, None, None, None, ">= 2.0 < 3.0") for k in range(80) if k % 5 == 2]
    return spark.createDataFrame(deps, DEPS), spark.createDataFrame(products, PRODUCTS), spark.createDataFrame(ranges, RANGES)


def by_hand(deps, products):
    """The best product of each dependency and CVE, by going through all pairs."""
    tokens = lambda *ns: {n.lower() for n in ns if n}
    best = {}
    for d in deps:
        has = tokens(d.name, d.product, d.cpe and d.cpe.split(":")[4])
        for p in products:
            if has & tokens(p.product, p.package_name) and p.ecosystem in (d.ecosystem, "generic"):
                key = d.analysis_id, d.dep_id, p.cve_id
                mine = int(p.ecosystem != d.ecosystem), p.product_id
                best[key] = min(best.get(key, mine), mine)
    return best


@pytest.mark.parametrize("hot", [1000, 5])
def test_candidates_and_states_equal_all_pairs(spark, monkeypatch, tables, hot):
    monkeypatch.setattr(skew.join_spread, "__defaults__", tuple(hot if v == skew.HOT_ROWS else v for v in skew.join_spread.__defaults__))
    deps, products, ranges = (t.collect() for t in tables)
    best = by_hand(deps, products)
    got = {(r.analysis_id, r.dep_id, r.cve_id): (int(not r.same_ecosystem), r.product_id) for r in V.candidates(*tables[:2]).collect()}
    assert got == best and len(best) > 1000
    state = {"1.0": "AFFECTED", "2.0": "NOT_AFFECTED", "trunk": "UNKNOWN", None: "POSSIBLY_AFFECTED", "UNKNOWN": "POSSIBLY_AFFECTED"}
    has = {r.product_id for r in ranges}
    of = lambda v, p: "UNKNOWN" if p not in has else "AFFECTED" if v == "2.0" and p % 5 == 2 else state[v]
    want = sorted((d.analysis_id, d.dep_id, k[2], p, of(d.version, p), "R") for d in deps for k, (_, p) in best.items() if k[:2] == (d.analysis_id, d.dep_id))
    assert sorted((r.analysis_id, r.dep_id, r.cve_id, r.product_id, r.version_state, r.reach) for r in V.correlated(*tables, also=("reach",)).collect()) == want
    pairs = tables[0].sparkSession.createDataFrame([(p, d.version) for d in deps for k, (_, p) in best.items() if k[:2] == (d.analysis_id, d.dep_id)], "product_id long, version string")
    row = lambda r: (r.product_id, str(r.version), r.ord, r.state)
    assert sorted(map(row, V.candidate_ranges(*tables).collect())) == sorted(map(row, V.range_states(pairs, tables[2]).collect()))
    assert {(r.analysis_id, r.dep_id) for r in V.touched(*tables[:2]).collect()} == {k[:2] for k in best}


def test_a_version_is_judged_once_against_equal_ranges(tables, monkeypatch):
    judged, judge = [], versions.with_range_state
    monkeypatch.setattr(versions, "with_range_state", lambda df: judged.append(df.count()) or judge(df))
    V.correlated(*tables).count()
    assert judged == [3 * 3]  # versions that are known; two profiles, one of which has two ranges


def test_identities_of_equal_keys_are_matched_once(spark, monkeypatch):
    deps = spark.createDataFrame([(k, f"Lib{k % 2}", None, None, "org.lib") for k in range(40)] + [(0, "Other", None, None, None), (99, None, None, None, None)], "dep_id long, name string, product string, cpe string, package_prefix string")
    ids = spark.createDataFrame([("C1", 0, "PACKAGE", "org"), ("C2", 1, "MAVEN", "org.lib:Lib1"), ("C3", 2, "PACKAGE", "other")], "cve_id string, ord int, identity_type string, value string")
    matched, spread = [], V._spread
    monkeypatch.setattr(V, "_spread", lambda rows, offers: matched.append(offers.count()) or spread(rows, offers))
    got = {(r.dep_id, r.cve_id): (r.identity_type, r.confidence) for r in V.identity_match(deps, ids).collect()}
    want = {(k, "C1"): ("PACKAGE", "MEDIUM") for k in range(40)} | {(k, "C2"): ("MAVEN", "EXACT") for k in range(40) if k % 2} | {(0, "C3"): ("PACKAGE", "MEDIUM")}
    assert got == want
    assert matched == [1 + 2 + 2]  # kinds Lib0, Lib1, and Lib0 with Other

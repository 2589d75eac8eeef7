"""Encoded constants, where they are decoded, and the signed score."""

from __future__ import annotations

from tesserine.operators import obfuscation as O

B64 = '"QUJDREVGR0hJSktMTU5PUFFSU1RVVg=="'


def test_states_of_encoded_strings(spark):
    rows = [("A", B64), ("A", B64), ("A", B64), ("A", "Base64.decode(s)"), ("B", B64), ("B", "0x0123456789abcdef"), ("B", "\\u0041\\u0042\\u0043\\u0044"), ("C", "plain"), ("C", None), ("D", B64)]
    got = {r.analysis_id: (r.scanned, r.reconstruction, r.state) for r in O.encoded_strings(spark.createDataFrame(rows, "analysis_id string, text string")).collect()}
    assert got == {"A": (4, 1, "STRONG_INDICATOR"), "B": (3, 0, "WEAK_INDICATOR"), "C": (1, 0, None), "D": (1, 0, None)}


def test_decode_sites_are_near_constants_of_their_own_body(spark):
    rows = [("A", "m", f"k = {B64};\n\nx ^ 0x1f;"), ("A", "n", "new String(b)"), ("A", "far", f"{B64}" + "\n" * 11 + "Base64.decode(k)"), ("A", "edge", f"{B64}" + "\n" * 10 + f"Base64.decode({B64})"), ("A", "none", None)]
    got = {(r.place, r.line, r.n_constants) for r in O.decode_sites(spark.createDataFrame(rows, "analysis_id string, place string, code string")).collect()}
    assert got == {("m", 2, 1), ("edge", 10, 2)}


def test_score_is_signed_and_held(spark):
    flags = lambda **on: {c: on.get(c, False) for c in O.WEIGHTS}
    rows = [("A", *flags(identifier_strong=True, string_obfuscation=True, native_stripped=True, unresolved_reflection=True).values()), ("B", *flags(descriptive_identifiers=True, native_sparse=True).values()), ("C", *flags(identifier_weak=True).values())]
    frame = spark.createDataFrame(rows, "analysis_id string, " + ", ".join(f"{c} boolean" for c in O.WEIGHTS))
    got = {r.analysis_id: (r.score, r.band, r.factors) for r in O.complexity(frame).collect()}
    assert got == {"A": (67, "HIGH", "identifier_strong,string_obfuscation,unresolved_reflection,native_stripped"), "B": (0, "MINIMAL", "native_sparse,descriptive_identifiers"), "C": (12, "LOW", "identifier_weak")}


def test_flags_of_observations(spark):
    seen = spark.createDataFrame([("A", "IDENTIFIER", "x", "STRONG_INDICATOR"), ("A", "IDENTIFIER", "x", "WEAK_INDICATOR"), ("B", "DYNAMIC_RESOLUTION", "constant reflection target", "RESOLVED"), ("C", "DYNAMIC_RESOLUTION", "unresolved dynamic_load target", "UNRESOLVED")], "analysis_id string, category string, indicator string, state string")
    none = spark.createDataFrame([], "analysis_id string, state string, evidence_level string, status string, stripped boolean, n_exported int, n_bytes long")
    libraries = spark.createDataFrame([("A", None, None, "COMPLETE", True, 9, 1), ("B", None, None, "COMPLETE", False, 1, 300_000)], none.schema)
    got = {r.analysis_id: {c for c in O.WEIGHTS if r[c]} for r in O.complexity_flags(seen, seen, none, none, libraries, none).collect()}
    assert got == {"A": {"identifier_strong", "native_stripped"}, "B": {"resolved_targets", "native_sparse", "symbols_available"}, "C": {"unresolved_dynamic_load"}}

"""Queries on encoded constants and the complexity score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import obfuscation as O
from ..sources.bridge import table, view, with_views
from . import query
from .investigation import _obfuscation, _with

_TEXTS = r"""tx AS (SELECT 'A' || CAST(doc_id % 5 AS VARCHAR) AS analysis_id, doc_id AS place, text || CASE WHEN doc_id % 11 = 3 THEN chr(10) || 'k = "QUJDREVGR0hJSktMTU5PUFFSU1RVVg==";' || chr(10) || 'x();' || chr(10) || 'b = Base64.decode(k);'
 WHEN doc_id % 11 = 5 THEN chr(10) || 'h = 0x0123456789abcdef01;' || repeat(chr(10), 30) || 'new String(h)' WHEN doc_id % 11 = 6 THEN chr(10) || 'v = a ^ 0x1f' ELSE '' END AS code FROM documents)"""


def _texts(spark, d):
    k = F.col("doc_id")
    base64, far, alone = '\nk = "QUJDREVGR0hJSktMTU5PUFFSU1RVVg==";\nx();\nb = Base64.decode(k);', "\nh = 0x0123456789abcdef01;" + "\n" * 30 + "new String(h)", "\nv = a ^ 0x1f"
    more = F.when(k % 11 == 3, base64).when(k % 11 == 5, far).when(k % 11 == 6, alone).otherwise("")
    return table(spark, d, "documents").select(F.concat(F.lit("A"), (k % 5).cast("string")).alias("analysis_id"), k.alias("place"), F.concat("text", more).alias("code"))


_COUNTED = f"""sc AS (SELECT analysis_id, count(code) AS scanned, count(*) FILTER (WHERE regexp_matches(code, '{O.BASE64}')) AS base64_like, count(*) FILTER (WHERE regexp_matches(code, '{O.HEX}')) AS hex_like,
 count(*) FILTER (WHERE regexp_matches(code, '{O.UNICODE}')) AS unicode_escaped, count(*) FILTER (WHERE regexp_matches(code, '{O.DECODES}')) AS reconstruction FROM tx GROUP BY 1),
st AS (SELECT *, CASE WHEN base64_like + hex_like + unicode_escaped >= {O.ENCODED} THEN CASE WHEN reconstruction > 0 THEN 'STRONG_INDICATOR' ELSE 'WEAK_INDICATOR' END END AS state FROM sc)"""


@query("obfuscation_strings", f"WITH {_TEXTS}, {_COUNTED} SELECT * FROM st")
def obfuscation_strings(spark, d):
    return O.encoded_strings(_texts(spark, d), "code")


@query("obfuscation_decode_sites", f"""WITH {_TEXTS}, l AS (SELECT analysis_id, place, generate_subscripts(s, 1) - 1 AS line, unnest(s) AS said FROM (SELECT *, string_split(code, chr(10)) AS s FROM tx)),
f AS (SELECT *, regexp_matches(said, '{O.DECODES}') AS decodes, CAST(regexp_matches(said, '{O.BASE64}|{O.HEX}|{O.UNICODE}') AS INTEGER) AS has_constant FROM l)
SELECT analysis_id, place, CAST(line AS INTEGER) AS line, n_constants FROM (SELECT *, CAST(sum(has_constant) OVER (PARTITION BY place ORDER BY line RANGE BETWEEN {O.NEAR} PRECEDING AND {O.NEAR} FOLLOWING) AS BIGINT) AS n_constants FROM f) WHERE decodes AND n_constants > 0""")
def obfuscation_decode_sites(spark, d):
    return O.decode_sites(_texts(spark, d))


_SCORE = "greatest(0, least(100, " + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in O.WEIGHTS.items()) + "))"
_BAND = "CASE " + " ".join(f"WHEN score >= {n} THEN '{b}'" for n, b in O.BANDS) + " ELSE 'MINIMAL' END"


@query("obfuscation_score", _with(f"""SELECT *, {_BAND} AS band FROM (SELECT analysis_id, CAST({_SCORE} AS INTEGER) AS score, concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{c}' END" for c in O.WEIGHTS)}) AS factors FROM (SELECT a.analysis_id, false AS identifier_strong, false AS identifier_weak, false AS control_flow,
 coalesce((SELECT st.state IS NOT NULL FROM st WHERE st.analysis_id = a.analysis_id), false) AS string_obfuscation,
 EXISTS (SELECT 1 FROM dy WHERE dy.analysis_id = a.analysis_id AND state <> 'RESOLVED' AND contains(indicator, 'reflection')) AS unresolved_reflection, EXISTS (SELECT 1 FROM dy WHERE dy.analysis_id = a.analysis_id AND state <> 'RESOLVED' AND contains(indicator, 'dynamic_load')) AS unresolved_dynamic_load,
 EXISTS (SELECT 1 FROM dy WHERE dy.analysis_id = a.analysis_id AND state = 'RESOLVED') AND (SELECT count(*) FILTER (WHERE state = 'RESOLVED') >= count(*) FILTER (WHERE state <> 'RESOLVED') FROM dy WHERE dy.analysis_id = a.analysis_id) AS resolved_targets,
 EXISTS (SELECT 1 FROM library l WHERE l.analysis_id = a.analysis_id AND l.status = 'COMPLETE' AND stripped) AS native_stripped, EXISTS (SELECT 1 FROM library l WHERE l.analysis_id = a.analysis_id AND l.status = 'COMPLETE' AND NOT stripped AND n_exported <= 2 AND n_bytes > 200000) AS native_sparse,
 EXISTS (SELECT 1 FROM library l WHERE l.analysis_id = a.analysis_id AND l.status = 'COMPLETE') AND NOT EXISTS (SELECT 1 FROM library l WHERE l.analysis_id = a.analysis_id AND l.status = 'COMPLETE' AND stripped) AS symbols_available,
 EXISTS (SELECT 1 FROM evasion e WHERE e.analysis_id = a.analysis_id AND evidence_level = 'SUPPORTED') AS anti_analysis_supported, a.analysis_id IN ('A1', 'A3') AS descriptive_identifiers FROM (SELECT DISTINCT analysis_id FROM component) a))""", "obfuscation", "component", "evasion").replace("WITH ", f"WITH {_TEXTS}, {_COUNTED}, ", 1))
def obfuscation_score(spark, d):
    """Analyses A1 and A3 stand for those whose identifiers are mostly words."""
    analyses = view(spark, d, "component").select("analysis_id")
    wordy = analyses.where("analysis_id IN ('A1', 'A3')")
    return O.complexity(O.complexity_flags(analyses, _obfuscation(spark, d), O.encoded_strings(_texts(spark, d), "code"), view(spark, d, "evasion"), view(spark, d, "library"), wordy))

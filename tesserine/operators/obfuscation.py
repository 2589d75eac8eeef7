"""Obfuscation beyond names: unresolved targets, native indirection, fan-out, encoded constants and where they are decoded, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dynamic_targets(semantics: DataFrame, reached: DataFrame) -> DataFrame:
    """Reflection and class loading (analysis_id, src, dst, edge_type): their targets' state. A target that isn't known stays UNKNOWN; reached (node_key) makes it externally influenced."""
    own = semantics.where(F.col("edge_type").isin("REFLECTION_TARGET", "DYNAMIC_LOAD"))
    kind = F.when(F.col("edge_type") == "REFLECTION_TARGET", "reflection").otherwise("dynamic_load")
    unknown = F.col("dst").endswith("UNKNOWN") | F.col("dst").startswith("reflect:UNKNOWN") | F.col("dst").startswith("dynload:UNKNOWN")
    near = reached.select(F.col("node_key").alias("src"), F.lit(True).alias("near")).distinct()
    state = F.when(~unknown, "RESOLVED").when(F.col("near"), "EXTERNALLY_INFLUENCED").otherwise("UNRESOLVED")
    indicator = F.when(unknown, F.concat(F.lit("unresolved "), kind, F.lit(" target"))).otherwise(F.concat(F.lit("constant "), kind, F.lit(" target")))
    return own.join(near, "src", "left").select("analysis_id", F.col("src").alias("target"), F.lit("DYNAMIC_RESOLUTION").alias("category"), state.alias("state"), indicator.alias("indicator"))


def impacts(observations: DataFrame) -> DataFrame:
    """What dynamic_targets() means for the analysis: a row per target that isn't resolved, and one more where it is reached from outside."""
    reflection = F.col("indicator").contains("reflection")
    first = F.when(reflection, "UNRESOLVED_REFLECTION").otherwise("UNRESOLVED_DYNAMIC_LOAD")
    rows = F.filter(F.array(F.when(F.col("state") != "RESOLVED", first), F.when(F.col("state") == "EXTERNALLY_INFLUENCED", "INCREASED_REACHABILITY_UNCERTAINTY")), lambda x: x.isNotNull())
    return observations.where("category = 'DYNAMIC_RESOLUTION'").select("analysis_id", F.explode(rows).alias("impact"), "target").distinct()


def native_indirection(libraries: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Libraries (analysis_id, name, status, stripped, n_exported, n_bytes) and JNI boundaries: what hides native targets. Large is more than 200,000 bytes, sparse at most two exports."""
    sparse = (F.col("n_exported") <= 2) & (F.col("n_bytes") > 200_000)
    state = F.when(F.col("stripped"), "OBSERVED").when(sparse, "WEAK_INDICATOR")
    indicator = F.when(F.col("stripped"), "stripped native symbols").when(sparse, "sparse exports for a large library")
    row = lambda df, target, state, indicator: df.select("analysis_id", target.alias("target"), F.lit("NATIVE_INDIRECTION").alias("category"), state.alias("state"), indicator.alias("indicator"))
    own = row(libraries.where("status = 'COMPLETE'"), F.col("name"), state, indicator).where("state IS NOT NULL")
    jni = row(boundaries.where("upper(boundary_type) = 'JNI'"), F.col("component"), F.lit("UNKNOWN"), F.lit("JNI boundary with UNKNOWN_NATIVE_TARGET"))
    return own.unionByName(jni)


def dispatchers(edges: DataFrame, degree: int = 40, least: int = 3, top: int = 5) -> DataFrame:
    """The nodes of most calls, if at least so many have so many; a weak indicator only."""
    high = edges.where(F.col("edge_type").isin("CALLS", "INVOKES")).groupBy("src").agg(F.count("*").alias("degree")).where(F.col("degree") >= degree)
    enough = high.agg(F.count("*").alias("n_high")).where(F.col("n_high") >= least)
    return high.orderBy(F.desc("degree"), "src").limit(top).crossJoin(enough).select("src", "degree", "n_high")  # one row with top rows


#: What looks like an encoded constant, and like a place that decodes one.
BASE64, HEX, UNICODE = r"[A-Za-z0-9+/]{24,}={0,2}", r"(?:0x)?[0-9a-fA-F]{16,}", r"(?:\\u[0-9a-fA-F]{4}){4,}"
DECODES = r"(?i)(?:Base64\.decode|new String\(|\bxor\b|\^\s*0x|StringBuilder.*decode)"
#: Encoded texts that make an observation; lines between a constant and the place that decodes it, at most.
ENCODED, NEAR = 3, 10
#: Weights of the complexity score, and what speaks against it.
WEIGHTS = {
    "identifier_strong": 25, "identifier_weak": 12, "string_obfuscation": 15, "unresolved_reflection": 12, "unresolved_dynamic_load": 12, "native_stripped": 15, "native_sparse": 8, "control_flow": 10, "anti_analysis_supported": 10,
    "descriptive_identifiers": -15, "resolved_targets": -8, "symbols_available": -8,
}
BANDS = ((60, "HIGH"), (30, "MEDIUM"), (10, "LOW"))


def encoded_strings(texts: DataFrame, text: str = "text") -> DataFrame:
    """Of each analysis (analysis_id), how many texts hold each kind of encoded constant or decode one, and the state: STRONG_INDICATOR where constants and a place that decodes are there, WEAK_INDICATOR with constants alone, else null."""
    n = lambda p, name: F.count_if(F.col(text).rlike(p)).alias(name)
    counted = texts.groupBy("analysis_id").agg(F.count(text).alias("scanned"), n(BASE64, "base64_like"), n(HEX, "hex_like"), n(UNICODE, "unicode_escaped"), n(DECODES, "reconstruction"))
    encoded = F.col("base64_like") + F.col("hex_like") + F.col("unicode_escaped")
    return counted.withColumn("state", F.when(encoded >= ENCODED, F.when(F.col("reconstruction") > 0, "STRONG_INDICATOR").otherwise("WEAK_INDICATOR")))


def decode_sites(bodies: DataFrame, near: int = NEAR) -> DataFrame:
    """Lines that decode something with encoded constants so many lines around them in the same body (analysis_id, place, code): line, and how many lines hold constants. A body is a group of lines, so no method meets another's."""
    lines = bodies.select("analysis_id", "place", F.posexplode(F.split("code", "\n")).alias("line", "said"))
    constant, decodes = F.col("said").rlike(f"{BASE64}|{HEX}|{UNICODE}"), F.col("said").rlike(DECODES)
    told = lines.select("analysis_id", "place", "line", decodes.alias("decodes"), constant.cast("int").alias("constant")).where("decodes OR constant = 1")
    around = Window.partitionBy("analysis_id", "place").orderBy("line").rangeBetween(-near, near)
    return told.withColumn("n_constants", F.sum("constant").over(around)).where("decodes AND n_constants > 0").select("analysis_id", "place", "line", "n_constants")


def complexity_flags(analyses: DataFrame, observations: DataFrame, strings: DataFrame, anti: DataFrame, libraries: DataFrame, descriptive: DataFrame) -> DataFrame:
    """One row per analysis with a boolean for each of WEIGHTS.

    observations: analysis_id, category, indicator, state; strings as encoded_strings() gives them; anti: evidence_level;
    libraries: status, stripped, n_exported, n_bytes; descriptive: analyses most of whose identifiers are words.
    """
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    strong, weak = (any_of((F.col("category") == "IDENTIFIER") & (F.col("state") == s)) for s in ("STRONG_INDICATOR", "WEAK_INDICATOR"))
    dynamic = F.col("category") == "DYNAMIC_RESOLUTION"
    is_open = dynamic & F.col("state").isin("UNRESOLVED", "EXTERNALLY_INFLUENCED")
    known, unknown = F.count_if(dynamic & (F.col("state") == "RESOLVED")), F.count_if(is_open)
    seen = observations.groupBy("analysis_id").agg(
        strong.alias("identifier_strong"), (weak & ~strong).alias("identifier_weak"), any_of(is_open & F.col("indicator").contains("reflection")).alias("unresolved_reflection"),
        any_of(is_open & F.col("indicator").contains("dynamic_load")).alias("unresolved_dynamic_load"), any_of(F.col("category") == "CONTROL_FLOW").alias("control_flow"), ((known > 0) & (known >= unknown)).alias("resolved_targets"),
    )
    whole = libraries.where("status = 'COMPLETE'")
    sparse = (F.col("n_exported") <= 2) & (F.col("n_bytes") > 200_000) & ~F.col("stripped")
    native = whole.groupBy("analysis_id").agg(any_of(F.col("stripped")).alias("native_stripped"), any_of(sparse).alias("native_sparse"), (~any_of(F.col("stripped"))).alias("symbols_available"))
    coded = strings.select("analysis_id", F.col("state").isNotNull().alias("string_obfuscation"))
    evasive = anti.groupBy("analysis_id").agg(any_of(F.col("evidence_level").isin("SUPPORTED", "CONFIRMED_STATIC")).alias("anti_analysis_supported"))
    out = analyses.select("analysis_id").distinct()
    for part in (seen, native, coded, evasive, descriptive.select("analysis_id", F.lit(True).alias("descriptive_identifiers")).distinct()):
        out = out.join(part, "analysis_id", "left")
    return out.select("analysis_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in WEIGHTS))


def complexity(flags: DataFrame) -> DataFrame:
    """The signed score of each analysis, 0 to 100, its band, and the names that count. It tells how hard an analysis is, not how bad a finding."""
    raw = sum((F.when(F.col(c), w).otherwise(0) for c, w in WEIGHTS.items()), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    band = F.lit("MINIMAL")
    for least, name in reversed(BANDS):
        band = F.when(score >= least, name).otherwise(band)
    return flags.select("analysis_id", score.alias("score"), band.alias("band"), F.concat_ws(",", *(F.when(F.col(c), c) for c in WEIGHTS)).alias("factors"))

"""Findings: fingerprints, duplicates, correlation, root causes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranks


def fingerprinted(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """primary_target and fingerprint. The target is the first located evidence, else the component, else the rule."""
    per = evidence.groupBy("finding_id").agg(
        F.min_by("location", F.when(F.coalesce("location", F.lit("")) != "", F.col("ord"))).alias("target"),
        F.array_join(F.array_sort(F.collect_list(F.concat(F.coalesce("source", F.lit("None")), F.lit(":"), F.coalesce("location", F.lit("None"))))), "|").alias("identity"),
    )
    out = findings.join(per, "finding_id", "left")
    target = F.coalesce("target", F.when(F.col("component") != "", F.col("component")), "rule_id")
    identity = F.coalesce(F.when(F.col("identity") != "", F.col("identity")), "component", F.lit(""))
    print_ = F.substring(F.sha2(F.concat_ws("|", F.col("rule_id"), F.col("category"), target, identity), 256), 1, 32)
    return out.withColumns({"primary_target": target, "fingerprint": print_}).drop("target", "identity")


def deduplicated(prints: DataFrame) -> DataFrame:
    """is_duplicate on all but the first finding of a fingerprint.

    The first one is found by a partial aggregate; only fingerprints that repeat are joined back,
    so most rows meet nothing. Where that list is too long to be sent to all tasks, adaptive
    execution splits a frequent fingerprint's rows, which are the left side.
    """
    first = prints.groupBy("analysis_id", "fingerprint").agg(F.min("finding_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    duplicate = F.coalesce(F.col("finding_id") != F.col("first"), F.lit(False))
    return prints.join(first, ["analysis_id", "fingerprint"], "left").withColumn("is_duplicate", duplicate).drop("first")


def dimensions(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row per finding and correlation key."""
    sink = F.trim(F.substring_index(F.trim(F.substr(F.col("detail"), F.locate("SECURITY_SINK", F.col("detail")) + F.lit(13))), "(", 1))
    sinks = evidence.where(F.col("detail").contains("SECURITY_SINK")).groupBy("finding_id").agg(F.max_by(sink, F.col("ord")).alias("sink"))
    cve = F.nullif(F.regexp_extract("title", r"(CVE[-\w]+)", 1), F.lit(""))
    has = F.coalesce("component", F.lit("")) != ""
    pair = lambda name, when, key: F.when(when, F.struct(F.lit(name).alias("dimension"), key.alias("key")))
    pairs = F.array(
        pair("component", has, F.col("component")), pair("cve", (F.col("category") == "cve") & cve.isNotNull(), cve), pair("dependency", (F.col("category") == "cve") & has, F.col("component")),
        pair("native_library", (F.col("category") == "native") & has, F.col("component")), pair("sink", F.coalesce("sink", F.lit("")) != "", F.col("sink")),
    )
    rows = findings.join(sinks, "finding_id", "left").select("analysis_id", "finding_id", F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p"))
    return rows.select("analysis_id", "finding_id", "p.dimension", F.substring("p.key", 1, 512).alias("key"))


def groups(dims: DataFrame) -> DataFrame:
    """A4: keys that two findings or more share, with their number and smallest and largest member."""
    return dims.groupBy("analysis_id", "dimension", "key").agg(F.count("*").alias("n"), F.min("finding_id").alias("first"), F.max("finding_id").alias("last")).where("n > 1")


def peers(dims: DataFrame) -> DataFrame:
    """For each finding and shared key the last other finding. The group's two largest members answer for all, so no pairs are made."""
    top = dims.groupBy("analysis_id", "dimension", "key").agg(F.max("finding_id").alias("a"), F.count("*").alias("n")).where("n > 1")
    joined = dims.join(top, ["analysis_id", "dimension", "key"])
    second = joined.where("finding_id <> a").groupBy("analysis_id", "dimension", "key").agg(F.max("finding_id").alias("b"))
    return joined.join(second, ["analysis_id", "dimension", "key"]).select("analysis_id", "dimension", "key", "finding_id", F.when(F.col("finding_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("peer"))


#: Rules and the root cause they point to.
RULE_CAUSE = {
    "ANDROID-WEBVIEW-001": "UNSAFE_WEBVIEW_INPUT", "ANDROID-WEBVIEW-002": "UNSAFE_WEBVIEW_INPUT", "ANDROID-SEMANTIC-004": "UNSAFE_WEBVIEW_INPUT", "ANDROID-COMPONENT-001": "EXPORTED_COMPONENT_INPUT", "ANDROID-SEMANTIC-001": "EXPORTED_COMPONENT_INPUT",
    "ANDROID-COMPONENT-002": "IPC_EXPOSURE", "ANDROID-SEMANTIC-003": "IPC_EXPOSURE", "ANDROID-SEMANTIC-005": "DANGEROUS_DYNAMIC_LOADING", "ANDROID-MANIFEST-003": "INSECURE_NETWORK_CONFIGURATION", "ANDROID-TLS-001": "INSECURE_NETWORK_CONFIGURATION",
    "ANDROID-TLS-002": "INSECURE_NETWORK_CONFIGURATION", "ANDROID-CRYPTO-001": "WEAK_CRYPTO", "ANDROID-MANIFEST-001": "DEBUGGABLE_BUILD", "ANDROID-MANIFEST-002": "BACKUP_ENABLED", "ANDROID-SECRET-001": "HARDCODED_SECRET",
}
#: Words of a reachability finding's title and their root cause, in order.
TITLE_CAUSE = (("webview", "UNSAFE_WEBVIEW_INPUT"), ("reflection", "REFLECTION_EXTERNAL_INPUT"), ("dynamic class loading", "DANGEROUS_DYNAMIC_LOADING"), ("command execution", "COMMAND_EXECUTION"), ("jni/native boundary", "JNI_REACHABLE_SURFACE"), ("native security-relevant", "NATIVE_UNSAFE_API"))
#: Prefixes of rules and their root cause; causes that are one group for the whole analysis.
PREFIX_CAUSE = {"ASF-NATIVE-": "NATIVE_UNSAFE_API", "ANDROID-CVE-": "DEPENDENCY_CVE"}
WHOLE = ("UNSAFE_WEBVIEW_INPUT", "DANGEROUS_DYNAMIC_LOADING", "INSECURE_NETWORK_CONFIGURATION", "WEAK_CRYPTO", "DEBUGGABLE_BUILD", "BACKUP_ENABLED", "REFLECTION_EXTERNAL_INPUT", "COMMAND_EXECUTION", "JNI_REACHABLE_SURFACE")


def cause(rule: Column, title: Column) -> Column:
    """The root cause category of a finding, or null."""
    by_title = F.lit("EXPORTED_COMPONENT_INPUT")
    for words, name in reversed(TITLE_CAUSE):
        by_title = F.when(F.lower(title).contains(words), name).otherwise(by_title)
    out = F.when(rule.startswith("ANDROID-REACH-"), by_title)
    for prefix, name in PREFIX_CAUSE.items():
        out = out.when(rule.startswith(prefix), name)
    for known, name in RULE_CAUSE.items():
        out = out.when(rule == known, name)
    return out


def root_causes(findings: DataFrame) -> DataFrame:
    """Duplicates left out, findings grouped by cause and by component where the cause is not one for the whole."""
    category = cause(F.col("rule_id"), F.col("title"))
    own = findings.where(~F.col("is_duplicate")).withColumn("cause", category).where("cause IS NOT NULL")
    own = own.withColumn("grouped_by", F.when(F.col("cause").isin(*WHOLE), F.col("cause")).otherwise(F.coalesce(F.when(F.col("component") != "", F.col("component")), "cause")))
    severity = ranks.ranked(F.col("severity"), {s: k for k, s in enumerate(ranks.SEVERITIES)}, 0)
    confidence = ranks.ranked(F.col("confidence"), ranks.CONFIDENCE_SCORE, 0)
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = own.groupBy("analysis_id", "cause", "grouped_by").agg(
        F.count("*").alias("n_findings"), F.max_by("severity", severity).alias("severity"), F.max_by("confidence", confidence).alias("confidence"),
        listed(F.when(F.col("component") != "", F.col("component"))).alias("components"), listed(F.when((F.col("category") == "cve") & (F.col("component") != ""), F.col("component"))).alias("dependencies"), listed(F.col("rule_id")).alias("rules"),
    )
    identifier = F.concat(F.lit("RC-"), F.col("cause"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", "analysis_id", "cause", "grouped_by"), 256), 1, 10))
    return out.withColumn("identifier", identifier)


def severity_histogram(findings: DataFrame) -> DataFrame:
    """A3: every level for every analysis, zero where there is none."""
    counts = findings.groupBy("analysis_id", "severity").agg(F.count("*").alias("n"))
    levels = findings.select("analysis_id").distinct().withColumn("severity", F.explode(F.array(*map(F.lit, ranks.SEVERITIES))))
    return levels.join(counts, ["analysis_id", "severity"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def summary(findings: DataFrame) -> DataFrame:
    """The conditional counts of one analysis, with the floored mean confidence."""
    score = ranks.ranked(F.col("confidence"), ranks.CONFIDENCE_SCORE, 30)
    status = lambda s: F.count_if(F.col("status") == s)
    mean = F.floor(F.sum(F.when(~F.col("is_duplicate"), score)) / F.count(F.when(~F.col("is_duplicate"), 1)))
    return findings.groupBy("analysis_id").agg(
        F.count("*").alias("n"), F.count_if("is_duplicate").alias("n_duplicates"), status("CONFIRMED_BY_STATIC_ANALYSIS").alias("n_confirmed"), status("POTENTIAL").alias("n_potential"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("n_severe"), F.count_distinct("rule_id").alias("n_rules"), mean.cast("long").alias("confidence_score"),
    ).withColumn("confidence_label", F.when(F.col("confidence_score") >= 80, "high").when(F.col("confidence_score") >= 55, "medium").otherwise("low"))


def page(findings: DataFrame, severity: str, number: int, size: int = 25) -> DataFrame:
    """One page of the findings of a severity, by title with the key as last sort column."""
    return findings.where(F.col("severity") == severity).select("finding_id", "analysis_id", "title", "rule_id").orderBy("title", "finding_id").offset(number * size).limit(size)


def capped(rows: DataFrame, group: list[str], order: list[str], bound: int) -> tuple[DataFrame, DataFrame]:
    """At most bound rows of each group, and per group how many were left out."""
    w = Window.partitionBy(*group).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= bound).drop("_n")
    return kept, rows.groupBy(*group).agg(F.greatest(F.count("*") - bound, F.lit(0)).cast("long").alias("truncated"))

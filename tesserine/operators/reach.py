"""What of the vulnerable or reported code is present and reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a signature, weakest first.
SIGNATURE_STATES = ("NO_SIGNATURE", "SIGNATURE_NO_CODE", "PACKAGE_PRESENT", "CLASS_PRESENT", "METHOD_PRESENT", "METHOD_REACHABLE")


def signature_states(matches: DataFrame, signatures: DataFrame, methods: DataFrame) -> DataFrame:
    """Matches (dep_id, cve_id) with the best state of the CVE's signatures (class_name, method_name) against methods (class_name, method_name, reached).

    One equality join per level; levels are counted up as they hold.
    """
    package = F.regexp_extract("class_name", r"^(.*)\.[^.]*$", 1)
    sig = signatures.withColumn("package", package)
    by_method = methods.groupBy("class_name", "method_name").agg(F.bool_or("reached").alias("reached"))
    classes = methods.select("class_name").distinct().withColumn("has_class", F.lit(True))
    packages = methods.select(package.alias("package")).where("package <> ''").distinct().withColumn("has_package", F.lit(True))
    level = F.when(F.col("reached"), 5).when(F.col("reached").isNotNull(), 4).when(F.col("has_class"), 3).when(F.col("has_package"), 2).otherwise(1)
    best = sig.join(by_method, ["class_name", "method_name"], "left").join(classes, "class_name", "left").join(packages, "package", "left").groupBy("cve_id").agg(F.max(level).alias("level"))
    state = F.element_at(F.array(*map(F.lit, SIGNATURE_STATES)), F.coalesce("level", F.lit(0)) + 1)
    return matches.join(best, "cve_id", "left").select("dep_id", "cve_id", state.alias("signature_state"))


def dependency_reach(dependencies: DataFrame, methods: DataFrame) -> DataFrame:
    """REACHABLE, NOT_REACHABLE or UNKNOWN per dependency, by classes whose name starts with its package prefix.

    The prefix is a plain one, so classes are cut at each length that some prefix has; there are few lengths.
    """
    lengths = sorted(r[0] for r in dependencies.select(F.length("package_prefix")).where("package_prefix <> ''").distinct().collect())
    cut = F.array(*(F.when(F.length("class_name") >= n, F.substring("class_name", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    members = methods.groupBy("class_name").agg(F.bool_or("reached").alias("reached")).select(F.explode(F.filter(cut, lambda p: p.isNotNull())).alias("package_prefix"), "reached")
    per = members.join(dependencies.select("package_prefix").distinct(), "package_prefix", "left_semi").groupBy("package_prefix").agg(F.bool_or("reached").alias("reached"))
    state = F.when(F.col("reached"), "REACHABLE").when(F.col("reached").isNotNull(), "NOT_REACHABLE").otherwise("UNKNOWN")
    return dependencies.join(per, "package_prefix", "left").select("dep_id", state.alias("reachability"))


def mentioned(findings: DataFrame, observations: DataFrame, text: str = "text") -> DataFrame:
    """Findings whose text names a method (Simple.method) that was observed, by an equality join on the names in it."""
    names = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][\w$]*\.[A-Za-z_$][\w$]*)"), F.lit(1))))
    seen = observations.select(F.concat(F.substring_index("class_name", ".", -1), F.lit("."), "method_name").alias("name"), "adapter").groupBy("name").agg(F.count("*").alias("n_observed"), F.bool_or(F.col("adapter") != "mock").alias("live"))
    return findings.select("finding_id", names.alias("name")).join(seen, "name").groupBy("finding_id").agg(F.sum("n_observed").alias("n_observed"), F.bool_or("live").alias("live"))

"""Joins on substrings and suffixes without trying every pair.

A substring join posts each needle under one of its pieces of GRAM characters, the one that the
fewest haystacks hold, and each haystack under all its pieces; pieces meet by an equality join and
the whole needle is checked after. A needle shorter than that is its own piece. A suffix join cuts
each haystack at the lengths that needles have and compares whole strings, so it needs no check.
Both take needles once each, however many rows have them, and give the first by an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept

GRAM = 4


def _pieces(rows: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """Rows with each of their pieces of the sizes, once each."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(F.col(text), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("piece", F.explode(F.array_distinct(F.concat(*map(of, sizes)))))


def containing(hays: DataFrame, needles: DataFrame, hay: str, needle: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of distinct hay and needle texts (with the columns within, equal on both sides) where the hay holds the needle. Empty needles are in none."""
    by = list(within)
    sought = kept(needles.select(*by, needle).where(F.length(needle) > 0).distinct(), "needles")
    sizes = [r[0] for r in sought.select(F.least(F.length(needle), F.lit(GRAM)).alias("k")).distinct().collect()]  # GRAM numbers at most
    if not sizes:
        return hays.select(*by, hay).join(sought, by, "inner").where("1 = 0") if by else hays.select(hay).where("1 = 0").withColumn(needle, F.lit(None).cast("string"))
    posted = _pieces(hays.select(*by, hay).where(F.col(hay).isNotNull()).distinct(), hay, sizes)
    own = _pieces(sought, needle, [GRAM]).unionByName(sought.where(F.length(needle) < GRAM).withColumn("piece", F.col(needle)))
    common = posted.join(own.select(*by, "piece").distinct(), [*by, "piece"], "left_semi").groupBy(*by, "piece").agg(F.count("*").alias("n"))
    rarest = own.join(common, [*by, "piece"]).groupBy(*by, needle).agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    return posted.join(rarest, [*by, "piece"]).where(F.contains(hay, needle)).select(*by, hay, needle)


def ending(hays: DataFrame, needles: DataFrame, hay: str, needle: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of distinct hay and needle texts where the hay ends with the needle."""
    by = list(within)
    sought = needles.select(*by, needle).where(F.length(needle) > 0).distinct()
    lengths = sorted(r[0] for r in sought.select(F.length(needle)).distinct().collect())  # numbers up to the longest needle
    ends = F.transform(F.filter(F.lit(lengths) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length(hay)), lambda n: F.call_function("right", F.col(hay), n))
    cut = hays.select(*by, hay).where(F.col(hay).isNotNull()).distinct().withColumn(needle, F.explode(ends))
    return cut.join(sought, [*by, needle], "left_semi").select(*by, hay, needle)


def metadata_dependencies(metadata: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Metadata (analysis_id, meta_id, artifact, grp, version) with the first dependency whose name, or the last part of whose prefix, its group and artifact hold; versions begin with a digit."""
    named = metadata.where(F.col("version").rlike("^[0-9]")).withColumn("hay", F.lower(F.concat_ws(" ", F.coalesce("grp", F.lit("")), F.coalesce("artifact", F.lit("")))))
    words = F.array(F.lower("name"), F.substring_index("package_prefix", ".", -1))
    first = dependencies.select("analysis_id", "dep_id", F.explode(words).alias("needle")).where("needle IS NOT NULL").groupBy("analysis_id", "needle").agg(F.min("dep_id").alias("dep_id"))
    pairs = containing(named, first, "hay", "needle", ("analysis_id",)).join(first, ["analysis_id", "needle"]).groupBy("analysis_id", "hay").agg(F.min("dep_id").alias("dep_id"))
    return named.join(pairs, ["analysis_id", "hay"]).select("analysis_id", "meta_id", "dep_id", "version")


def embedded_versions(metadata: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The version that each dependency gets from its metadata: that of the last."""
    last = metadata_dependencies(metadata, dependencies).groupBy("analysis_id", "dep_id").agg(F.max_by("version", "meta_id").alias("version"), F.count("*").alias("n_metadata"))
    return last.withColumn("version_confidence", F.lit("EXACT"))


def path_surface(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths (analysis_id, path_id, start_label) with the first surface node (analysis_id, ord, name, component) whose name the label is, or whose component it holds."""
    needles = nodes.where(F.length("name") > 0).select("analysis_id", F.col("component").alias("needle"), "ord").groupBy("analysis_id", "needle").agg(F.min("ord").alias("ord"))
    held = containing(paths, needles, "start_label", "needle", ("analysis_id",)).join(needles, ["analysis_id", "needle"]).select("analysis_id", "start_label", "ord")
    same = nodes.where(F.length("name") > 0).groupBy("analysis_id", F.col("name").alias("start_label")).agg(F.min("ord").alias("ord"))
    first = held.unionByName(same).groupBy("analysis_id", "start_label").agg(F.min("ord").alias("ord"))
    return paths.join(first, ["analysis_id", "start_label"]).select("analysis_id", "path_id", "ord")


def path_rules(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """Paths (path_id, end_label) with the rule of the first finding (ord, rule_id, tail) whose last evidence ends with the label; null where there is none."""
    first = findings.groupBy(F.col("tail").alias("hay")).agg(F.min(F.struct("ord", "rule_id")).alias("f"))
    pairs = ending(first, paths, "hay", "end_label").join(first, "hay").groupBy("end_label").agg(F.min("f").alias("f"))
    return paths.join(pairs, "end_label", "left").select("path_id", "end_label", "f.rule_id", F.col("f.ord").alias("finding_ord"))

"""Matching of dependencies against vulnerability records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ranks, versions
from ..functions.lineage import kept, kept_counted
from ..functions.skew import SMALL, join_spread, sent


def _tokens(*names: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*(F.lower(n) for n in names)), lambda t: t.isNotNull() & (t != "")))


def _kinds(dependencies: DataFrame) -> DataFrame:
    """Each dependency (analysis_id, dep_id) with its kind: the ecosystems and name tokens that it has, all that matching reads of it."""
    cpe_name = F.get(F.split("cpe", ":"), F.lit(4))
    named = dependencies.select("analysis_id", "dep_id", F.struct("ecosystem", F.array_sort(_tokens(F.col("name"), F.col("product"), cpe_name)).alias("tokens")).alias("k"))
    return named.where("size(k.tokens) > 0").groupBy("analysis_id", "dep_id").agg(F.array_sort(F.collect_set("k")).alias("kind"))


def _offers(kinds: DataFrame, products: DataFrame) -> DataFrame:
    """One product per kind and CVE: kind, cve_id, product_id, generic (0 or 1). A product of the kind's own ecosystem goes before a generic one; ties take the smallest product_id.

    Both sides are exploded to name tokens, so the join is an equality on (ecosystem, token).
    """
    each = kinds.select("kind").distinct().select("kind", F.explode("kind").alias("k")).select("kind", F.col("k.ecosystem").alias("ecosystem"), F.explode("k.tokens").alias("token"))
    each = each.withColumn("wanted", F.explode(F.array_distinct(F.array("ecosystem", F.lit("generic")))))
    offered = products.select("product_id", "cve_id", F.col("ecosystem").alias("wanted"), F.explode(_tokens(F.col("product"), F.col("package_name"))).alias("token"))
    own = F.when(F.col("wanted") == F.col("ecosystem"), 0).otherwise(1)
    best = each.join(offered, ["wanted", "token"]).groupBy("kind", "cve_id").agg(F.min(F.struct(own.alias("generic"), F.col("product_id"))).alias("best"))
    return best.select("kind", "cve_id", "best.product_id", "best.generic")


def _spread(rows: DataFrame, offers: DataFrame) -> DataFrame:
    """rows (with kind and dep_id) with the offers of their kind (a list, o). Rows of a frequent kind are dealt over many tasks, and tasks stay many: they make more than they read."""
    counts = rows.groupBy("kind").agg(F.count("*").alias("n"))
    listed = offers.groupBy("kind").agg(F.collect_list(F.struct(*(c for c in offers.columns if c != "kind"))).alias("o")).join(counts, "kind")
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return join_spread(rows, listed, "kind", "dep_id", rows.count(), salts=16, tasks=tasks)


def candidates(dependencies: DataFrame, products: DataFrame) -> DataFrame:
    """One product per dependency and CVE. A product of the dependency's own ecosystem goes before a generic one; ties take the smallest product_id.

    Dependencies that have the same names are matched once.
    """
    kinds = kept(_kinds(dependencies), "kinds")
    made = _spread(kinds, _offers(kinds, products)).select("analysis_id", "dep_id", F.inline("o"))
    return made.select("analysis_id", "dep_id", "cve_id", "product_id", (F.col("generic") == 0).alias("same_ecosystem"))


def touched(dependencies: DataFrame, products: DataFrame) -> DataFrame:
    """The dependencies (analysis_id, dep_id) that have some candidate."""
    kinds = kept(_kinds(dependencies), "kinds")
    return kinds.join(_offers(kinds, products).select("kind").distinct(), "kind", "left_semi").select("analysis_id", "dep_id")


def _nameless() -> Column:
    return F.coalesce(F.col("version"), F.lit("")).isin("", "UNKNOWN")


def range_states(pairs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs (product_id, version, ...) with the state of each range; versions are judged once per distinct pair."""
    distinct = pairs.select("product_id", "version").distinct().join(ranges, "product_id")
    return versions.with_range_state(distinct).select("product_id", "version", "ord", "state")


def candidate_ranges(dependencies: DataFrame, products: DataFrame, ranges: DataFrame) -> DataFrame:
    """range_states() of all candidates with their versions. A version is judged once against equal ranges of however many products; products meet lists of versions' numbers."""
    kinds = _kinds(dependencies)
    own = kept(dependencies.select("analysis_id", "dep_id", "version").join(kinds, ["analysis_id", "dep_id"]).select("kind", "version").distinct(), "kinds")
    offers = _offers(own, products).select("kind", "product_id")
    bounds = ["introduced", "fixed", "last_affected", "exact", "raw"]
    numbered, n = kept_counted(own.select("version").distinct().withColumn("v", F.monotonically_increasing_id()), "versions")
    same = own["version"].eqNullSafe(numbered["version"])
    per = own.join(sent(numbered, n), same).groupBy("kind").agg(F.collect_list("v").alias("vs"))
    limits, n_limits = kept_counted(ranges.select(*bounds).distinct().withColumn("limit", F.monotonically_increasing_id()), "limits")
    mine = ranges.alias("r").join(sent(limits.alias("l"), n_limits), reduce(Column.__and__, (F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in bounds))).select("product_id", "ord", "limit")
    mine = mine.groupBy("product_id").agg(F.collect_list(F.struct("ord", "limit")).alias("limits"))
    spark = dependencies.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = offers.join(per, "kind").repartition(tasks, "product_id").select("product_id", F.explode("vs").alias("v")).distinct()
    rows = met.join(mine, "product_id").select("product_id", "v", F.inline("limits"))
    states, n_states = kept_counted(versions.with_range_state(numbered.crossJoin(limits)).select("v", "version", "limit", "state"), "states") if n * n_limits <= SMALL * 16 else (None, 0)
    if states is None:  # too many to judge all against all: only those that meet
        asked = rows.select("v", "limit").distinct().join(numbered, "v").join(limits, "limit")
        states, n_states = kept_counted(versions.with_range_state(asked).select("v", "version", "limit", "state"), "states")
    return rows.join(sent(states, n_states), ["v", "limit"]).select("product_id", "version", "ord", "state")


def correlated(dependencies: DataFrame, products: DataFrame, ranges: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """R6 without reachability: version_state and correlation_state per candidate, with the dependency's columns of also.

    Products with equal ranges are one profile. A version is judged once against a profile, and matches look the state up.
    """
    rows = kept(dependencies.select("analysis_id", "dep_id", "version", *also).join(_kinds(dependencies), ["analysis_id", "dep_id"]), "kinds")
    bounds = ["introduced", "fixed", "last_affected", "exact", "raw"]
    per = ranges.groupBy("product_id").agg(F.array_sort(F.collect_set(F.struct(*bounds))).alias("ranges"))
    per = kept(per, "ranges")
    profiles, n = kept_counted(per.select("ranges").distinct().withColumn("profile", F.monotonically_increasing_id()), "profiles")
    of, n_of = kept_counted(per.join(sent(profiles, n), "ranges").select("product_id", "profile"), "profiles")
    offers = kept(_offers(rows, products).join(sent(of, n_of), "product_id", "left"), "offers")
    asked = rows.where(~_nameless()).select("kind", "version").distinct().join(offers.where("profile IS NOT NULL").groupBy("kind").agg(F.collect_set("profile").alias("ps")), "kind")
    asked = asked.select("version", F.explode("ps").alias("profile")).distinct()
    judged = versions.with_range_state(asked.join(sent(profiles, n), "profile").select("version", "profile", F.inline("ranges")))
    states, n_states = kept_counted(judged.groupBy("version", "profile").agg(versions.worst_state(F.col("state")).alias("state")), "states")
    out = _spread(rows, offers).select("analysis_id", "dep_id", "version", *also, F.inline("o")).join(sent(states, n_states), ["version", "profile"], "left")
    version_state = F.when(F.col("profile").isNull(), "UNKNOWN").when(_nameless(), "POSSIBLY_AFFECTED").otherwise(F.col("state"))
    out = out.select("analysis_id", "dep_id", "cve_id", "product_id", version_state.alias("version_state"), *also)
    return out.withColumn("correlation_state", correlation_state(F.col("version_state")))


def correlation_state(version_state: Column) -> Column:
    return (
        F.when(version_state == "NOT_AFFECTED", "PRESENT_NOT_AFFECTED").when(version_state == "POSSIBLY_AFFECTED", "PRESENT_UNKNOWN_VERSION").when(version_state == "AFFECTED", "PRESENT_AFFECTED").otherwise("UNKNOWN")
    )


def with_reachability(matches: DataFrame, reach: Column, severity: Column) -> DataFrame:
    """An affected match becomes reachable or not; severity follows the state and is never critical by itself."""
    state = F.when(F.col("correlation_state") != "PRESENT_AFFECTED", F.col("correlation_state")).when(reach == "REACHABLE", "AFFECTED_REACHABLE").when(reach == "NOT_REACHABLE", "AFFECTED_NOT_REACHABLE").otherwise("PRESENT_AFFECTED")
    out = matches.withColumn("correlation_state", state)
    s = F.col("correlation_state")
    rank = ranks.ranked(F.upper(severity), ranks.SEVERITY_RANK, -1)
    return out.withColumn("finding_severity", F.when(s == "AFFECTED_REACHABLE", F.when(rank >= 3, "high").otherwise("medium")).when(s == "PRESENT_AFFECTED", "medium").when(s.isin("AFFECTED_NOT_REACHABLE", "PRESENT_UNKNOWN_VERSION"), "low").otherwise("info"))


def fixed_versions(ranges: DataFrame) -> DataFrame:
    """The fixed versions that providers name, per product: versions by their tokens, then what is no version."""
    named = F.concat(F.array("fixed"), F.coalesce(F.regexp_extract_all("raw", F.lit(r"<\s*([\w.\-+]+)"), F.lit(1)), F.array().cast("array<string>")))
    each = ranges.select("product_id", F.explode(F.array_distinct(F.filter(named, lambda v: v.isNotNull() & (v != "")))).alias("v")).distinct()
    key = F.struct(versions.version_tokens(F.col("v")).isNull().alias("odd"), versions.version_tokens(F.col("v")).alias("tokens"), F.col("v").alias("v"))
    return each.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda k: k["v"]), ",").alias("fixed_versions"))


def resolved_conflicts(records: DataFrame) -> DataFrame:
    """Per CVE the canonical record (highest score, then provider precedence, then severity) and what providers disagree on."""
    precedence = ranks.ranked(F.lower(F.col("source")), {p: k for k, p in enumerate(ranks.PROVIDERS)}, len(ranks.PROVIDERS))
    severity = ranks.ranked(F.upper(F.col("severity")), ranks.SEVERITY_RANK, -1)
    best = F.struct(F.coalesce(F.col("cvss"), F.lit(-1.0)), -precedence, severity, -F.col("record_id"))
    return records.groupBy("cve_id").agg(
        F.count("*").alias("n_records"),
        F.max_by("source", best).alias("canonical_source"),
        F.max_by(F.struct("severity"), best)["severity"].alias("canonical_severity"),
        F.max_by(F.struct("cvss"), best)["cvss"].alias("canonical_cvss"),
        (F.count_distinct(F.upper("severity")) > 1).alias("severity_disagrees"),
        (F.count_distinct("cvss") > 1).alias("cvss_disagrees"),
        F.bool_or("known_exploited").alias("known_exploited"),
        F.max("epss").alias("epss"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("providers"),
    )


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def longest_prefix(packages: DataFrame, prints: DataFrame) -> DataFrame:
    """Packages (package) with the longest fingerprint (prefix, label) that is the package or a dotted prefix of it."""
    parts = F.split("package", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    hits = packages.select("package", F.explode(prefixes).alias("prefix")).join(prints, "prefix")
    best = hits.groupBy("package").agg(F.max(F.struct(F.length("prefix").alias("n"), F.col("prefix"), F.col("label"))).alias("m"))
    return packages.join(best, "package", "left").select(*packages.columns, F.col("m.prefix").alias("prefix"), F.col("m.label").alias("label"))


def inventory(dependencies: DataFrame) -> DataFrame:
    """Counts per analysis and ecosystem."""
    nameless = F.coalesce(F.col("version"), F.lit("")).isin("", "UNKNOWN")
    return dependencies.groupBy("analysis_id", "ecosystem").agg(F.count("*").alias("n_dependencies"), F.count_distinct("name").alias("n_names"), F.count_if(nameless).alias("n_unknown_version"), F.max("name").alias("last_name"))


def freshness(records: DataFrame, now_days: int = 0, current_days: int = 30) -> DataFrame:
    """CURRENT, STALE or UNKNOWN by age, and the roll-up per source."""
    age = F.col("age_days") - now_days
    state = F.when(age.isNull(), "UNKNOWN").when(age <= current_days, "CURRENT").otherwise("STALE")
    return records.withColumn("freshness", state).groupBy("source").agg(*(F.count_if(F.col("freshness") == s).alias(f"n_{s.lower()}") for s in ("CURRENT", "STALE", "UNKNOWN")), F.count("*").alias("n"), F.min("age_days").alias("newest"))


def searched(records: DataFrame, text: str, least_cvss: float, limit: int) -> DataFrame:
    """Substring search on identifier and summary, sorted and then cut."""
    low = text.lower()
    hit = F.lower("cve_id").contains(low) | F.lower("summary").contains(low)
    return records.where(hit & (F.col("cvss") >= least_cvss)).select("cve_id", "source", "record_id", "cvss").distinct().orderBy(F.desc("cvss"), "cve_id", "record_id").limit(limit)


def found(
    records: DataFrame, products: DataFrame, query: str | None = None, provider: str | None = None, severity: str | None = None, ecosystem: str | None = None, package: str | None = None,
    cpe: str | None = None, purl: str | None = None, known_exploited: bool | None = None, min_cvss: float | None = None, limit: int | None = 100,
) -> DataFrame:
    """Records for which every predicate that is given holds, each once, sorted and then cut (limit None: all).

    query is sought in identifier, summary and product; package in the package's name, or in the product where there is none.
    What is asked of a product must hold for one of the record's products. products: record_id, product,
    package_name, ecosystem, cpe, purl; they are read only where a predicate asks for them. Letters' case
    doesn't count; % and _ stand for themselves.
    """
    has = lambda c, word: F.coalesce(F.lower(c).contains(word.lower()), F.lit(False))
    rows = records
    if provider is not None:
        rows = rows.where(F.lower("source") == provider.lower())
    if severity is not None:
        rows = rows.where(F.upper(F.coalesce("severity", F.lit(""))) == severity.upper())
    if known_exploited is not None:
        rows = rows.where(F.col("known_exploited") == known_exploited)
    if min_cvss is not None:
        rows = rows.where(F.col("cvss") >= min_cvss)
    of_product = []
    if ecosystem is not None:
        of_product.append(F.lower("_p.ecosystem") == ecosystem.lower())
    if package is not None:
        of_product.append(has(F.coalesce("_p.package_name", "_p.product"), package))
    of_product += [has(F.col(f"_p.{c}"), word) for c, word in (("cpe", cpe), ("purl", purl)) if word is not None]
    if query or of_product:
        offered = products.select(F.col("record_id").alias("_of"), F.struct("product", "package_name", "ecosystem", "cpe", "purl").alias("_p"))
        rows = rows.join(offered, F.col("record_id") == F.col("_of"), "left")
        if query:
            rows = rows.where(has(F.col("cve_id"), query) | has(F.col("summary"), query) | has(F.col("_p.product"), query))
        for holds in of_product:
            rows = rows.where(holds)
    out = rows.select("cve_id", "source", "record_id", "severity", "cvss", "known_exploited", "epss", "summary").distinct()
    return out if limit is None else out.orderBy("cve_id", F.coalesce("source", F.lit("")), "record_id").limit(limit)


def latest(rows: DataFrame, parent: str, *order: Column) -> DataFrame:
    """The last row of each parent."""
    w = Window.partitionBy(parent).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


CONFIDENCES = ("UNKNOWN", "MEDIUM", "HIGH", "EXACT")


def identity_match(dependencies: DataFrame, identities: DataFrame) -> DataFrame:
    """Per dependency and CVE the strongest identity: EXACT on a normalised CPE or coordinate, HIGH on the name within one, MEDIUM on a package name.

    dependencies: dep_id, name, product, cpe, package_prefix. identities: cve_id, ord, identity_type, value.
    Every rule is an equality join on a (type, token) key; the dotted-prefix rule lists the prefixes.
    """
    names = F.array_distinct(F.filter(F.array(F.lower("name"), F.lower("product"), cpe_part(F.col("cpe"), 4)), lambda v: v.isNotNull() & (v != "")))
    prefix = F.lower("package_prefix")
    parts = F.split(prefix, r"\.")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("token"))
    keys = F.concat(
        F.array(key("cpe", normal_cpe(F.col("cpe"))), key("maven", F.concat(prefix, F.lit(":"), F.lower(F.coalesce("product", "name")))), key("package", prefix)),
        F.transform(names, lambda n: key("name", n)), F.coalesce(F.transform(heads, lambda h: key("head", h)), F.array().cast("array<struct<kind:string,token:string>>")),
    )
    keys = F.filter(keys, lambda k: (k["token"].isNotNull()) & (k["token"] != ""))
    have = dependencies.select("dep_id", F.array_distinct(keys).alias("k")).where("size(k) > 0")
    # Dependencies that have the same keys are matched once.
    have = kept(have.groupBy("dep_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("kind")), "kinds")
    value, kind = F.col("value"), F.col("identity_type")
    low = F.lower(F.trim(value))
    wanted = (
        F.when(kind == "CPE", F.array(_want("cpe", normal_cpe(value), 3), _want("name", cpe_part(value, 4), 2)))
        .when(kind == "MAVEN", F.array(_want("maven", low, 3), _want("name", F.element_at(F.split(low, ":"), 2), 2)))
        .when(kind == "PACKAGE", F.array(_want("package", low, 2), _want("head", low, 1), _want("name", low, 1)))
    )
    asked = identities.select("cve_id", "ord", "identity_type", F.explode(wanted).alias("w")).select("cve_id", "ord", "identity_type", "w.kind", "w.token", "w.strength")
    each = have.select("kind").distinct().select(F.col("kind").alias("keys"), F.inline("kind"))
    hits = each.join(asked, ["kind", "token"]).groupBy("keys", "cve_id").agg(F.max(F.struct("strength", (-F.col("ord")).alias("first"), "identity_type")).alias("best"))
    confidence = F.element_at(F.array(*map(F.lit, CONFIDENCES)), F.col("best.strength") + 1)
    offers = hits.select(F.col("keys").alias("kind"), "cve_id", "best.identity_type", confidence.alias("confidence"))
    return _spread(have, offers).select("dep_id", F.inline("o"))


def _want(kind: str, token: Column, strength: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), token.alias("token"), F.lit(strength).alias("strength"))


def normal_cpe(cpe: Column) -> Column:
    """cpe:2.3:part:vendor:product in lower case."""
    return F.lower(F.array_join(F.slice(F.split(F.trim(cpe), ":"), 1, 5), ":"))


def cpe_part(cpe: Column, n: int) -> Column:
    return F.lower(F.get(F.split(F.trim(cpe), ":"), F.lit(n)))

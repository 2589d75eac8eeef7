"""Layers of evidence: surface, risk, native and JNI, runtime, remediation, validation, assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.running import running

#: What each kind of component is on the attack surface.
SURFACE = {"activity": "EXPORTED_ACTIVITY", "service": "EXPORTED_SERVICE", "receiver": "EXPORTED_RECEIVER", "provider": "EXPORTED_PROVIDER"}
#: Weights of risk factors.
RISK = {
    "exported_component": 15,
    "external_input": 15,
    "sensitive_sink_reachable": 20,
    "dangerous_permission": 8,
    "missing_permission_protection": 10,
    "webview_javascript": 10,
    "javascript_interface": 12,
    "reflection_external_input": 10,
    "dynamic_loading_external": 15,
    "jni_boundary": 8,
    "native_unsafe_api": 8,
    "reachable_cve": 20,
    "affected_cve_unreachable": 6,
    "possibly_affected_cve": 4,
    "unknown_dependency_version": 3,
    "weak_crypto": 6,
    "cleartext_network": 6,
    "security_boundary_crossed": 8,
    "external_kev_known_exploited": 12,
    "external_epss_high": 6,
}
#: Weights of mitigations, which are taken off.
MITIGATION = {
    "permission_protected": 10,
    "internal_only": 8,
    "source_sink_not_reachable": 5,
    "dependency_not_affected": 3,
    "constant_only_reflection_or_dynload": 4,
    "disconnected_source_sink": 2,
}


def surface(components: DataFrame) -> DataFrame:
    """The components that can be reached, with exposure (P1, P3); the first row of a name stands."""
    state = ranks.exposure(F.col("exported"), F.col("has_filter"), F.col("kind"))
    seen = components.withColumn("state", state).withColumn("exposure", ranks.surface_exposure(F.col("state"), F.col("permission"))).where("exposure <> 'INTERNAL'")
    kind = F.lit("EXPORTED_COMPONENT")
    for name, node in SURFACE.items():
        kind = F.when(F.col("kind") == name, node).otherwise(kind)
    first = seen.withColumn("node_type", kind).groupBy("analysis_id", "name").agg(F.min_by(F.struct("node_type", "exposure", "permission"), "component_id").alias("f"))
    return first.select("analysis_id", F.concat(F.lit("surface:component:"), "name").alias("node_key"), F.col("name").alias("component"), "f.node_type", "f.exposure", "f.permission")


def surface_edges(nodes: DataFrame, causes: DataFrame) -> DataFrame:
    """Surface nodes lead to the root causes whose components (comma-joined) name theirs."""
    each = causes.select("analysis_id", "identifier", "cause", F.explode(F.split("components", ",")).alias("component"))
    return nodes.join(each, ["analysis_id", "component"]).select("analysis_id", F.col("node_key").alias("src"), F.concat(F.lit("rootcause:"), "identifier").alias("dst"), F.lit("LEADS_TO").alias("edge_type"), "cause")


def risk(factors: DataFrame, *group: str) -> DataFrame:
    """Factors (name) to a score of 0 to 100, its band, and the factors' names."""
    names = F.col("name")
    weight = ranks.ranked(names, {**RISK, **{k: -v for k, v in MITIGATION.items()}}, 0)
    total = factors.groupBy(*group).agg(F.sum(weight).alias("raw"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("factors"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("raw"))).cast("int")
    return total.select(*group, score.alias("score"), ranks.risk_band(F.col("raw")).alias("band"), "factors")


#: What a root cause adds to the risk of an entry point it reaches.
CAUSE_FACTOR = {"UNSAFE_WEBVIEW_INPUT": "webview_javascript", "DANGEROUS_DYNAMIC_LOADING": "dynamic_loading_external", "NATIVE_UNSAFE_API": "native_unsafe_api", "DEPENDENCY_CVE": "reachable_cve"}


def entry_factors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per entry point and factor; each root cause adds its own, also when of one name."""
    own = nodes.select("analysis_id", "node_key", F.lit("exported_component").alias("name"))
    guarded = nodes.where("exposure = 'PERMISSION_PROTECTED'").select("analysis_id", "node_key", F.lit("permission_protected").alias("name"))
    name = F.lit("sensitive_sink_reachable")
    for cause, factor in CAUSE_FACTOR.items():
        name = F.when(F.col("cause") == cause, factor).otherwise(name)
    return own.unionByName(guarded).unionByName(edges.select("analysis_id", F.col("src").alias("node_key"), name.alias("name")))


def jni_bindings(exports: DataFrame, natives: DataFrame) -> DataFrame:
    """Exports and native declarations on (class, method): both HIGH, export alone MEDIUM, declaration alone LOW."""
    both = exports.select("class_name", "method_name", "library").distinct().join(natives.select("class_name", "method_name", F.lit(True).alias("declared")).distinct(), ["class_name", "method_name"], "full_outer")
    confidence = F.when(F.col("library").isNotNull() & F.col("declared").isNotNull(), "HIGH").when(F.col("library").isNotNull(), "MEDIUM").otherwise("LOW")
    source = F.when(F.col("library").isNotNull(), "ELF_EXPORT").otherwise("JAVA_NATIVE")
    return both.select("class_name", "method_name", "library", source.alias("source"), confidence.alias("confidence"))


def reconciled(elf: DataFrame, deep: DataFrame) -> DataFrame:
    """Functions of two sources, by (library, name): ELF, GHIDRA or ELF+GHIDRA, first known address."""
    both = elf.select("library", "name", "address", F.lit("ELF").alias("source")).unionByName(deep.select("library", "name", "address", F.lit("GHIDRA").alias("source")))
    return both.groupBy("library", "name").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"), F.coalesce(F.min(F.when(F.col("source") == "ELF", F.col("address"))), F.min("address")).alias("address"))


#: Fixed value: names that tools make up.
GENERATED = r"^(?:[a-z]{1,2}|[a-z][0-9]{1,3}|[a-z]{1,2}[0-9]{1,3})$"
SHORT_NAME, LEAST_CLASSES, STRONG_SHARE, WEAK_SHARE = 2, 8, 0.5, 0.25


def name_shares(names: DataFrame) -> DataFrame:
    """Names (analysis_id, kind: class or method, name, package) to shares of short or generated names and a state.

    Fewer than eight classes are not judged. From a half on the indicator is strong; from a quarter on
    it is weak, with MEDIUM confidence where a package has a segment of one letter, else LOW.
    """
    name = F.trim(F.coalesce("name", F.lit("")))
    short = (name != "") & ((F.length(name) <= SHORT_NAME) | name.rlike(GENERATED))
    is_class, is_method = F.col("kind") == "class", F.col("kind") == "method"
    flat = is_class & F.exists(F.split(F.coalesce("package", F.lit("")), r"\."), lambda p: F.length(p) <= 1) & (F.coalesce("package", F.lit("")) != "")
    n = names.groupBy("analysis_id").agg(
        F.count_if(is_class).alias("n_classes"), F.count_if(is_method).alias("n_methods"), F.count_if(is_class & short).alias("n_short_classes"),
        F.count_if(is_method & short).alias("n_short_methods"), F.count_distinct(F.when(flat, F.col("package"))).alias("n_flat_packages"),
    )
    share = F.col("n_short_classes") / F.col("n_classes")
    few = F.col("n_classes") < LEAST_CLASSES
    state = F.when(F.col("n_classes") == 0, "UNAVAILABLE").when(few, "INSUFFICIENT_CLASSES").when(share >= STRONG_SHARE, "STRONG_INDICATOR").when(share >= WEAK_SHARE, "WEAK_INDICATOR").otherwise("NO_INDICATOR")
    confidence = F.when(state == "STRONG_INDICATOR", "HIGH").when(state == "WEAK_INDICATOR", F.when(F.col("n_flat_packages") > 0, "MEDIUM").otherwise("LOW"))
    rounded = lambda x, of: F.when(F.col(of) > 0, F.round(F.col(x) / F.col(of), 3)).otherwise(0.0)
    return n.select("analysis_id", "n_classes", "n_methods", "n_short_classes", "n_flat_packages", rounded("n_short_classes", "n_classes").alias("class_share"), rounded("n_short_methods", "n_methods").alias("method_share"), state.alias("state"), confidence.alias("confidence"))


def session_modes(observations: DataFrame) -> DataFrame:
    """LIVE, MOCKED or UNAVAILABLE per session."""
    live, mock = F.bool_or(F.col("adapter") != "mock"), F.bool_or(F.col("adapter") == "mock")
    return observations.groupBy("session_id").agg(F.count("*").alias("n"), F.when(live, "LIVE").when(mock, "MOCKED").otherwise("UNAVAILABLE").alias("mode"))


def runtime_links(observations: DataFrame, methods: DataFrame) -> DataFrame:
    """Observations to static methods by lower-case simple class and method; what meets none is kept as behaviour."""
    key = F.lower(F.substring_index("class_name", ".", -1))
    seen = observations.withColumns({"k_class": key, "k_method": F.lower("method_name")})
    known = methods.select(F.lower(F.substring_index("class_name", ".", -1)).alias("k_class"), F.lower("method_name").alias("k_method"), "node_key").distinct()
    return seen.join(known, ["k_class", "k_method"], "left").select("obs_id", F.coalesce("node_key", F.lit("RUNTIME_BEHAVIOR")).alias("target"), F.col("node_key").isNotNull().alias("linked"))


def timeline(observations: DataFrame) -> DataFrame:
    """Sequence of each session's observations; a session is counted by days, so that a busy one is many tasks."""
    day = F.coalesce(F.unix_date(F.to_date("ts")), F.lit(-(1 << 30)))
    return running(observations, ["session_id"], ["ts", "obs_id"], day, {"sequence": F.lit(1)}).withColumn("sequence", F.col("sequence").cast("int"))


def merged_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items of one fingerprint: the first's text, the best status, all evidence (numbers or texts, joined in text order)."""
    rank = ranks.ranked(F.col("status"), {"BLOCKED": 0, "VERSION_UNVERIFIED": 1, "REVIEW_REQUIRED": 2, "CONDITIONALLY_RECOMMENDED": 3, "RECOMMENDED": 4}, -1)
    return items.groupBy(*keys).agg(F.min_by("action", "ord").alias("action"), F.max_by("status", rank).alias("status"), F.max("score").alias("score"), F.count("*").alias("n_merged"), F.array_join(F.array_sort(F.transform(F.collect_set("evidence"), lambda e: e.cast("string"))), ",").alias("evidence"))


#: Weights of remediation priority.
PRIORITY = {
    "affected_reachable": 40,
    "affected_present": 25,
    "possibly_affected": 12,
    "identity_confirmed": 10,
    "reachable": 15,
    "not_reachable": -10,
    "external_exposure": 15,
    "fixed_version_available": 8,
    "kev_known_exploited": 20,
    "epss_high": 10,
    "runtime_corroborated": 12,
    "native_jni_boundary": 6,
    "root_cause_critical": 15,
    "root_cause_high": 10,
    "confirmed_static_finding": 12,
    "finding_high_severity": 10,
    "finding_medium_severity": 5,
    "finding_low_severity": 2,
    "unknown_native_target": 0,
}
PRIORITY_BANDS = ((70, "CRITICAL"), (45, "HIGH"), (25, "MEDIUM"), (10, "LOW"), (1, "INFO"))
EPSS_HIGH = 0.5


def priority_of(score: Column, status: Column) -> Column:
    """The band of a score that is 0 or more; what can't be judged stays undetermined."""
    out = F.when(F.lit(False), F.lit(""))
    for least, band in PRIORITY_BANDS:
        out = out.when(score >= least, band)
    return out.otherwise(F.when(status.isin("VERSION_UNVERIFIED", "REVIEW_REQUIRED"), "UNDETERMINED").otherwise("INFO"))


def remediation_items(matches: DataFrame, fixes: DataFrame) -> DataFrame:
    """R15 for vulnerable dependencies.

    matches: analysis_id, dep_id, cve_id, product_id, version_state, correlation_state,
    reachability_state, identity_confidence, known_exploited, epss; fixes: product_id, fixed_versions.
    A version that isn't known is never taken for affected; NOT_AFFECTED gives no item.
    """
    known = F.coalesce("fixed_versions", F.lit("")) != ""
    affected, possible = F.col("version_state") == "AFFECTED", F.col("version_state") == "POSSIBLY_AFFECTED"
    status = F.when(affected, F.when(known, "RECOMMENDED").otherwise("REVIEW_REQUIRED")).when(possible, F.when(known, "CONDITIONALLY_RECOMMENDED").otherwise("VERSION_UNVERIFIED")).otherwise("VERSION_UNVERIFIED")
    fixability = F.when(affected, F.when(known, "DIRECT_FIX").otherwise("UNKNOWN_FIX")).otherwise("CONDITIONAL_FIX")
    correlation, reach = F.col("correlation_state"), F.col("reachability_state")
    present = F.when(correlation == "AFFECTED_REACHABLE", PRIORITY["affected_reachable"]).when(correlation.isin("PRESENT_AFFECTED", "AFFECTED_NOT_REACHABLE"), PRIORITY["affected_present"]).when(possible, PRIORITY["possibly_affected"]).otherwise(0)
    score = (
        present + F.when(F.col("identity_confidence").isin("EXACT", "HIGH"), PRIORITY["identity_confirmed"]).otherwise(0)
        + F.when(reach == "REACHABLE", PRIORITY["reachable"]).when(reach == "NOT_REACHABLE", PRIORITY["not_reachable"]).otherwise(0) + F.when(known, PRIORITY["fixed_version_available"]).otherwise(0)
        + F.when(F.coalesce("known_exploited", F.lit(False)), PRIORITY["kev_known_exploited"]).otherwise(0) + F.when(F.coalesce("epss", F.lit(0.0)) >= EPSS_HIGH, PRIORITY["epss_high"]).otherwise(0)
    )
    rows = matches.join(fixes, "product_id", "left").where("version_state <> 'NOT_AFFECTED'")
    out = rows.select("analysis_id", "dep_id", "cve_id", status.alias("status"), fixability.alias("fixability"), F.greatest(score, F.lit(0)).alias("score"), F.coalesce("fixed_versions", F.lit("")).alias("fixed_versions"))
    return out.withColumn("priority", priority_of(F.col("score"), F.col("status")))


def with_prerequisites(items: DataFrame) -> DataFrame:
    """Review items (action, target) of inputs and bridges wait for the review of the exported component that is their target."""
    waits = ("REVIEW_INTENT_INPUT", "REVIEW_DEEP_LINK_INPUT", "REVIEW_IPC_BOUNDARY", "REVIEW_WEBVIEW_BRIDGE")
    first = items.where("action = 'REVIEW_EXPORTED_COMPONENT'").groupBy("analysis_id", "target").agg(F.min("item_id").alias("prerequisite"))
    own = items.where(F.col("action").isin(*waits) & F.col("target").isNotNull())
    return own.join(first, ["analysis_id", "target"]).select("analysis_id", "item_id", "prerequisite")


#: Weights and penalties of a claim's confidence.
VALIDATION = {"base_evidence": 40, "independent_family": 15, "direct_target": 10, "runtime_corroboration": 20, "reachability_confirmed": 10, "identity_confirmed": 10, "version_confirmed": 10}
PENALTY = {"MISSING_VERSION": 15, "UNKNOWN_NATIVE_TARGET": 10, "UNRESOLVED_IPC_TARGET": 10, "MISSING_PROVIDER_RECORD": 5, "AMBIGUOUS_IDENTITY": 10}
NOT_REACHABLE_PENALTY, POSSIBLY_AFFECTED_PENALTY = 10, 10
#: Blockers that block a claim.
HARD_BLOCKERS = ("MISSING_VERSION", "NO_LIVE_OBSERVATION", "UNRESOLVED_IPC_TARGET", "MISSING_JNI_TARGET")


def claims(evidence: DataFrame) -> DataFrame:
    """Evidence rows to a state and a confidence per claim.

    Columns: claim, family, live, direct (names the target), blocker (or null), and of the claim's
    match, the same in all its rows or null: identity, version_known, version_state, reach. Mocked
    runtime counts for nothing. Without any source a claim is UNVERIFIED, whatever blocks it.
    """
    runtime = F.col("family") == "RUNTIME"
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    has = {b: any_of(F.col("blocker") == b).alias(b) for b in (*PENALTY, *HARD_BLOCKERS)}
    per = evidence.groupBy("claim").agg(
        F.count_distinct(F.when(~runtime | F.col("live"), F.col("family"))).alias("n_families"), any_of(runtime & F.col("live")).alias("live"), any_of(F.col("direct")).alias("direct"),
        any_of(F.col("family") == "STATIC_REACHABILITY").alias("path"), F.count("*").alias("n_evidence"), *has.values(), *(F.max(c).alias(c) for c in ("identity", "version_known", "version_state", "reach")),
    )
    n, live = F.col("n_families"), F.col("live")
    blocked = F.greatest(*(F.col(b) for b in HARD_BLOCKERS))
    state = F.when(n == 0, "UNVERIFIED").when(blocked, "VALIDATION_BLOCKED").when(n >= 2, "MULTI_SOURCE_CORROBORATED").when(live, "RUNTIME_CORROBORATED").otherwise("STATIC_SUPPORTED")
    adds = lambda holds, points: F.when(F.coalesce(holds, F.lit(False)), points).otherwise(0)
    score = F.lit(VALIDATION["base_evidence"]) + VALIDATION["independent_family"] * F.greatest(n - 1, F.lit(0))
    score += adds(F.col("direct"), VALIDATION["direct_target"]) + adds(live, VALIDATION["runtime_corroboration"]) + adds(F.col("path"), VALIDATION["reachability_confirmed"])
    score += adds(F.col("identity").isin("EXACT", "HIGH"), VALIDATION["identity_confirmed"]) + adds(F.col("version_known"), VALIDATION["version_confirmed"])
    score -= sum((adds(F.col(b), k) for b, k in PENALTY.items()), F.lit(0)) + adds(F.col("reach") == "NOT_REACHABLE", NOT_REACHABLE_PENALTY) + adds(F.col("version_state") == "POSSIBLY_AFFECTED", POSSIBLY_AFFECTED_PENALTY)
    return per.select("claim", "n_families", "n_evidence", state.alias("state"), F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("confidence"))


#: Validation states, weakest first.
CLAIM_ORDER = ("SUPERSEDED", "NOT_APPLICABLE", "UNVERIFIED", "VALIDATION_BLOCKED", "INCONCLUSIVE", "STATIC_SUPPORTED", "RUNTIME_CORROBORATED", "MULTI_SOURCE_CORROBORATED")


def rolled_up(judged: DataFrame, parent: Column) -> DataFrame:
    """Claims per parent: their number, strongest state and largest confidence."""
    rank = ranks.ranked(F.col("state"), {s: k for k, s in enumerate(CLAIM_ORDER)}, -1)
    return judged.groupBy(parent.alias("parent")).agg(F.count("*").alias("n_claims"), F.max_by("state", F.struct(rank, "state")).alias("state"), F.max("confidence").alias("confidence"))


def _ladder(rows: DataFrame, rules, rule: str, conclusion: str, decision: str) -> DataFrame:
    """The first rule (condition, rule, conclusion, decision) that holds; else the three given."""
    out = [F.lit(rule), F.lit(conclusion), F.lit(decision)]
    for holds, *said in reversed(rules):
        out = [F.when(F.coalesce(holds, F.lit(False)), v).otherwise(o) for v, o in zip(said, out)]
    return rows.withColumns(dict(zip(("rule", "conclusion", "decision"), out)))


def decisions(findings: DataFrame) -> DataFrame:
    """R21 for findings (is_duplicate, status, state of validation, confirmed at runtime or not): rule, conclusion and decision.

    A null state is UNVERIFIED.
    """
    state, status = F.coalesce("state", F.lit("UNVERIFIED")), F.col("status")
    rules = (
        (F.col("is_duplicate"), "R-FIND-DUP", "FINDING_INCONCLUSIVE", "SUPERSEDED"),
        (status == "CONFIRMED_BY_STATIC_ANALYSIS", "R-FIND-STATIC-CONFIRMED", "FINDING_CONFIRMED", "CONFIRMED"),
        (F.coalesce("confirmed", F.lit(False)) | (state == "MULTI_SOURCE_CORROBORATED"), "R-FIND-MULTI", "FINDING_SUPPORTED", "STRONGLY_SUPPORTED"),
        (state == "RUNTIME_CORROBORATED", "R-FIND-RUNTIME", "FINDING_SUPPORTED", "STRONGLY_SUPPORTED"),
        (state == "STATIC_SUPPORTED", "R-FIND-STATIC-SUPPORTED", "FINDING_SUPPORTED", "SUPPORTED"),
        (state == "VALIDATION_BLOCKED", "R-FIND-BLOCKED", "FINDING_BLOCKED", "BLOCKED"),
        (state.isin("UNVERIFIED", "INCONCLUSIVE") & (status.isNull() | status.isin("POTENTIAL", "REVIEW_REQUIRED")), "R-FIND-UNVERIFIED", "FINDING_UNVERIFIED", "UNVERIFIED"),
    )
    return _ladder(findings, rules, "R-FIND-INCONCLUSIVE", "FINDING_INCONCLUSIVE", "INCONCLUSIVE")


def cve_decisions(matches: DataFrame) -> DataFrame:
    """R21 for matches (version_state, reachability_state, identity_confidence; null is UNKNOWN)."""
    version, reach, identity = (F.upper(F.coalesce(c, F.lit("UNKNOWN"))) for c in ("version_state", "reachability_state", "identity_confidence"))
    sure = identity.isin("EXACT", "HIGH")
    unknown = version.isin("POSSIBLY_AFFECTED", "PRESENT_UNKNOWN_VERSION", "UNKNOWN")
    rules = (
        (version == "NOT_AFFECTED", "R-CVE-NOT-AFFECTED", "CVE_NOT_AFFECTED", "NOT_APPLICABLE"),
        ((version == "AFFECTED") & (reach == "REACHABLE") & sure, "R-CVE-AFFECTED-REACHABLE", "CVE_CONFIRMED", "STRONGLY_SUPPORTED"),
        (version == "AFFECTED", "R-CVE-AFFECTED", "CVE_POSSIBLY_RELEVANT", "SUPPORTED"),
        (reach == "NOT_REACHABLE", "R-CVE-NOT-REACHABLE", "CVE_NOT_REACHABLE", "REQUIRES_REVIEW"),
        (unknown & sure, "R-CVE-VERSION-UNVERIFIED", "CVE_VERSION_UNVERIFIED", "CONDITIONALLY_SUPPORTED"),
        (unknown, "R-CVE-VERSION-UNVERIFIED", "CVE_VERSION_UNVERIFIED", "UNVERIFIED"),
    )
    return _ladder(matches, rules, "R-CVE-INSUFFICIENT", "CVE_EVIDENCE_INSUFFICIENT", "INCONCLUSIVE")


def runtime_decisions(runs: DataFrame) -> DataFrame:
    """R21 for an analysis's latest runtime run (mode, live_claim_count); mocked runs never count as live ones."""
    mode = F.upper(F.coalesce("mode", F.lit("UNAVAILABLE")))
    rules = (
        ((mode == "LIVE") & (F.col("live_claim_count") > 0), "R-RT-LIVE-CORROBORATED", "RUNTIME_CORROBORATED", "SUPPORTED"),
        (mode == "LIVE", "R-RT-LIVE-NOT-OBSERVED", "RUNTIME_NOT_OBSERVED", "REQUIRES_REVIEW"),
        (mode == "MOCKED", "R-RT-MOCKED", "RUNTIME_MOCKED_ONLY", "UNVERIFIED"),
    )
    return _ladder(runs, rules, "R-RT-UNAVAILABLE", "RUNTIME_UNAVAILABLE", "INCONCLUSIVE")


def native_decisions(views: DataFrame) -> DataFrame:
    """R21 for an analysis's native view (mode, n_live, n_reached, n_present)."""
    rules = (
        (F.col("n_live") > 0, "R-NAT-LIVE-INVOKED", "NATIVE_API_CONFIRMED", "SUPPORTED"),
        (F.col("n_reached") > 0, "R-NAT-REACHED", "NATIVE_PATH_CORROBORATED", "SUPPORTED"),
        (F.col("mode") == "ELF_ONLY", "R-NAT-ELF-ONLY", "NATIVE_ANALYSIS_UNAVAILABLE", "INCONCLUSIVE"),
        (F.col("n_present") > 0, "R-NAT-PRESENT", "NATIVE_REACHABILITY_UNVERIFIED", "UNVERIFIED"),
    )
    return _ladder(views, rules, "R-NAT-NONE", "NATIVE_REACHABILITY_UNVERIFIED", "INCONCLUSIVE")


def remediation_decisions(items: DataFrame) -> DataFrame:
    """R21 for remediation items (status)."""
    status = F.col("status")
    rules = (
        (status == "RECOMMENDED", "R-REM-RECOMMENDED", "REMEDIATION_RECOMMENDED", "SUPPORTED"),
        (status == "CONDITIONALLY_RECOMMENDED", "R-REM-CONDITIONAL", "REMEDIATION_CONDITIONAL", "CONDITIONALLY_SUPPORTED"),
        (status == "REVIEW_REQUIRED", "R-REM-REVIEW", "REMEDIATION_REQUIRES_REVIEW", "REQUIRES_REVIEW"),
        (status == "REMEDIATED", "R-REM-REMEDIATED", "REMEDIATION_REMEDIATED", "CONFIRMED"),
        (status == "VERSION_UNVERIFIED", "R-REM-VERSION-UNVERIFIED", "REMEDIATION_STATUS_UNVERIFIED", "UNVERIFIED"),
    )
    return _ladder(items, rules, "R-REM-DEFAULT", "REMEDIATION_REQUIRES_REVIEW", "REQUIRES_REVIEW")


#: Decisions that leave something to do, and conclusions that matter for security.
OPEN_DECISIONS = ("REQUIRES_REVIEW", "UNVERIFIED", "BLOCKED", "INCONCLUSIVE", "CONDITIONALLY_SUPPORTED")
RELEVANT_CONCLUSIONS = ("FINDING_CONFIRMED", "FINDING_SUPPORTED", "CVE_CONFIRMED", "CVE_POSSIBLY_RELEVANT", "RUNTIME_CORROBORATED", "NATIVE_PATH_CORROBORATED", "NATIVE_API_CONFIRMED")


def overall_decisions(decided: DataFrame) -> DataFrame:
    """R21 for whole analyses: decided (analysis_id, conclusion, decision) to a row per rule that holds."""
    per = decided.groupBy("analysis_id").agg(
        F.count_if(F.col("conclusion").isin(*RELEVANT_CONCLUSIONS)).alias("relevant"), F.count_if(F.col("decision").isin(*OPEN_DECISIONS)).alias("open"), F.count_if(F.col("decision").isin("BLOCKED", "UNVERIFIED")).alias("incomplete")
    )
    row = lambda holds, rule, conclusion, decision: F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(conclusion).alias("conclusion"), F.lit(decision).alias("decision")))
    is_open = F.col("open") > 0
    rows = F.array(
        row(F.col("relevant") > 0, "R-ASSESS-RELEVANT", "SECURITY_RELEVANT_EVIDENCE_PRESENT", "SUPPORTED"), row(is_open, "R-ASSESS-REVIEW", "SECURITY_REVIEW_REQUIRED", "REQUIRES_REVIEW"),
        row(is_open, "R-ASSESS-INCOMPLETE", "EVIDENCE_INCOMPLETE", "INCONCLUSIVE"), row(F.col("incomplete") > 0, "R-ASSESS-VALIDATION-INCOMPLETE", "VALIDATION_INCOMPLETE", "INCONCLUSIVE"),
        row(is_open, "R-ASSESS-INCONCLUSIVE", "ASSESSMENT_INCONCLUSIVE", "INCONCLUSIVE"), row(~is_open, "R-ASSESS-CONCLUSIVE", "ASSESSMENT_CONCLUSIVE", "CONFIRMED"),
    )
    return per.select("analysis_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("analysis_id", "r.*")


def decision_summary(decided: DataFrame) -> DataFrame:
    """A1: counts by decision, by rule and by category in one pass."""
    return decided.groupingSets([["decision"], ["rule"], ["category"]], "decision", "rule", "category").agg(F.count("*").alias("n"))


def report(findings: DataFrame, causes: DataFrame) -> DataFrame:
    """One JSON document per analysis, of counts and root causes."""
    counts = findings.groupBy("analysis_id").agg(F.count("*").alias("findings"), F.count_if("is_duplicate").alias("duplicates"))
    per = causes.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("identifier", "severity", "n_findings"))).alias("root_causes"))
    whole = counts.join(per, "analysis_id", "left")
    return whole.select("analysis_id", F.to_json(F.struct("findings", "duplicates", F.coalesce("root_causes", F.array()).alias("root_causes"))).alias("document"))

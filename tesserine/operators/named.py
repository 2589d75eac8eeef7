"""The registry of named investigation queries (G10) over a set of domain tables, and path questions.

tables: component (analysis_id, name, kind, exposure, permission), surface (analysis_id, component, node_type, exposure),
findings (analysis_id, finding_id, rule_id, category, component, is_duplicate, runtime_status, validation_state, text),
matches (analysis_id, dep_id, name, cve_id, version_state, correlation_state), boundaries and transactions (analysis_id,
boundary_type, component, confidence), semantics (analysis_id, src, dst, edge_type, confidence), obfuscation and impacts (see
obfuscation.py), anti (analysis_id, category, indicator, evidence_level), entry_risk (analysis_id, node_key, score), causes
(analysis_id, identifier, cause, components), libraries (name), entries (component), and paths, a function that gives the shortest
paths (start, target, path, confidence) of starts and targets for which two conditions on nodes hold. Every state that a row has is
given as it is; UNKNOWN is never read as no.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import sent

HIGH_RISK = 70
#: Words of sinks' names that make them web views, or commands and loaders.
WEBVIEW_APIS = ("loadurl", "loaddata", "addjavascriptinterface", "evaluatejavascript", "webview")
EXEC_APIS = ("runtime.exec", "processbuilder", "exec", "system", "loadlibrary", "dexclassloader", "pathclassloader", "class.forname")
OPEN_TARGETS = ("UNRESOLVED", "EXTERNALLY_INFLUENCED")


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(w.replace(".", r"\.") for w in words))


def matching(nodes: DataFrame, query: str, with_type: bool = True) -> DataFrame:
    """P5: nodes whose label, class, type (unless left out) or key holds query, whatever its case."""
    parts = ["label", "class_name", *(["node_type"] if with_type else []), "node_key"]
    return nodes.where(F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in parts))), F.lit(query.lower())))


def _findings(t: dict, where) -> DataFrame:
    return t["findings"].where(where).select("analysis_id", "finding_id", "rule_id", "category", "component")


def _unsure(t: dict) -> DataFrame:
    rows = t["boundaries"].unionByName(t["transactions"].withColumn("boundary_type", F.lit("BINDER_IPC")))
    return rows.where(F.upper(F.coalesce("confidence", F.lit(""))).isin("LOW", "UNKNOWN"))


def _targets(t: dict, kind: str) -> DataFrame:
    return t["semantics"].where(F.col("edge_type") == kind).select("analysis_id", "src", "dst", "confidence", (~F.col("dst").endswith("UNKNOWN")).alias("resolved"))


def _open(t: dict, word: str) -> DataFrame:
    return t["obfuscation"].where((F.col("category") == "DYNAMIC_RESOLUTION") & F.col("indicator").contains(word) & F.col("state").isin(*OPEN_TARGETS)).select("analysis_id", "target", "state", "indicator")


def _of_entries(t: dict) -> DataFrame:
    """Observations whose target's class ends with an entry's simple name; names are cut at the points that both have, so it is an equality join."""
    simple = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    entries = t["entries"].where(F.coalesce("component", F.lit("")) != "").select(simple(F.col("component")).alias("simple")).distinct()
    own = t["obfuscation"].where("target IS NOT NULL").withColumn("simple", simple(F.substring_index("target", "#", 1)))
    return own.join(entries, "simple", "left_semi").select("analysis_id", "target", "category", "state", "indicator")


def _paths(t: dict, words: tuple[str, ...]) -> DataFrame:
    return t["paths"](F.lit(True), holds_any(F.col("label"), words)).select("start", "target", "path", "confidence")


NAMED: dict[str, Callable[..., DataFrame]] = {
    "exported-components": lambda t: t["component"].where(F.col("exposure").isin("EXPORTED", "CONDITIONALLY_EXPORTED")).select("analysis_id", "name", "kind", "exposure", "permission"),
    "public-attack-surface": lambda t: t["surface"].where("exposure = 'PUBLIC'").select("analysis_id", "component", "node_type"),
    "findings-reachable-from-exported": lambda t: t["findings"].where(~F.col("is_duplicate")).join(run("exported-components", t).select("analysis_id", F.col("name").alias("component")).distinct(), ["analysis_id", "component"], "left_semi").select("analysis_id", "finding_id"),
    "external-to-webview": lambda t: _paths(t, WEBVIEW_APIS),
    "external-to-exec": lambda t: _paths(t, EXEC_APIS),
    "exported-to-jni": lambda t: t["paths"](F.col("node_type") == "ENTRY_POINT", F.col("node_type") == "NATIVE_FUNCTION").select("start", "target", "path", "confidence"),
    "cve-reachable": lambda t: t["matches"].where("correlation_state = 'AFFECTED_REACHABLE'").select("analysis_id", "dep_id", "cve_id"),
    "possibly-affected": lambda t: t["matches"].where("version_state = 'POSSIBLY_AFFECTED'").select("analysis_id", "dep_id", "cve_id"),
    "dependencies-with-cve": lambda t: t["matches"].groupBy("analysis_id", "name").agg(F.array_join(F.array_sort(F.collect_set("cve_id")), ",").alias("cves")),
    "runtime-confirmed": lambda t: _findings(t, F.col("runtime_status").isin("STATIC_RUNTIME_CONFIRMED", "RUNTIME_SUPPORTS_STATIC_PATH")),
    "runtime-not-observed": lambda t: _findings(t, F.col("validation_state") == "NOT_OBSERVED"),
    "unknown-boundaries": lambda t: _unsure(t).select("analysis_id", "boundary_type", "component", "confidence"),
    "webview-bridges": lambda t: t["boundaries"].where(F.upper(F.coalesce("boundary_type", F.lit(""))).contains("WEBVIEW")).select("analysis_id", "boundary_type", "component", "confidence"),
    "reflection-paths": lambda t: _targets(t, "REFLECTION_TARGET"),
    "dynamic-load-paths": lambda t: _targets(t, "DYNAMIC_LOAD"),
    "high-risk-entrypoints": lambda t, threshold=HIGH_RISK: t["entry_risk"].where(F.col("score") >= threshold).select("analysis_id", "node_key", "score"),
    "findings-crossing-jni": lambda t: _findings(t, F.upper(F.coalesce("text", F.lit(""))).rlike("JNI|BINDS_TO|NATIVE_FUNCTION")),
    "findings-involving-native": lambda t: t["findings"].join(t["libraries"].select(F.col("name").alias("component"), F.lit(True).alias("is_library")).distinct(), "component", "left").where("category = 'native' OR is_library").select("analysis_id", "finding_id", "rule_id", "category", "component"),
    "root-causes-for-component": lambda t, component="c1": t["causes"].where(F.exists(F.split("components", ","), lambda c: c.contains(component))).select("analysis_id", "identifier", "cause"),
    "obfuscated-components": lambda t: t["obfuscation"].where("coalesce(target, '') <> ''").select("analysis_id", "target", "category", "state", "indicator"),
    "obfuscated-entrypoints": _of_entries,
    "anti-analysis": lambda t: t["anti"].select("analysis_id", "category", "indicator", "evidence_level"),
    "unresolved-reflection": lambda t: _open(t, "reflection"),
    "unresolved-dynamic-loading": lambda t: _open(t, "dynamic_load"),
    "native-indirection": lambda t: t["obfuscation"].where("category = 'NATIVE_INDIRECTION'").select("analysis_id", "target", "state", "indicator"),
    "analysis-uncertainty": lambda t: t["impacts"].select("analysis_id", "impact", "target"),
}


def run(name: str, tables: dict[str, DataFrame], **params) -> DataFrame:
    if name not in NAMED:
        raise ValueError(f"no query is named {name!r}; there are {', '.join(sorted(NAMED))}")
    return NAMED[name](tables, **params)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """How many rows each named query gives, and NOT_APPLICABLE where a path query has no target in the graph at all."""
    parts = [run(n, tables).agg(F.count("*").alias("n")).select(F.lit(n).alias("query"), "n") for n in sorted(NAMED)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def located_paths(paths: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """Paths (start, target, path, length, confidence) between nodes of starts and of targets with the types and labels of their ends and the status: REACHABLE from an entry point or a source, else UNKNOWN."""
    of = lambda nodes, end: sent(nodes.select(F.col("node_key").alias(end), F.col("node_type").alias(f"{end}_type"), F.col("label").alias(f"{end}_label")).dropDuplicates([end]), nodes.count())
    both = paths.join(of(starts, "start"), "start").join(of(targets, "target"), "target")
    return both.withColumn("status", F.when(F.col("start_type").isin("ENTRY_POINT", "DATAFLOW_SOURCE"), "REACHABLE").otherwise("UNKNOWN"))


#: What a path to each kind of sink is reported as: rule, title, severity.
SINK_RULES = {
    "webview": ("ANDROID-REACH-001", "External input reaches WebView sink", "medium"),
    "command_exec": ("ANDROID-REACH-002", "External input reaches command execution sink", "medium"),
    "unsafe_string": ("ANDROID-REACH-004", "External input reaches native security-relevant API", "medium"),
    "unsafe_parse": ("ANDROID-REACH-004", "External input reaches native security-relevant API", "low"),
    "reflection": ("ANDROID-REACH-001", "External input reaches reflection sink", "low"),
    "dynamic_loading": ("ANDROID-REACH-001", "External input reaches dynamic class loading sink", "medium"),
    "file_write": ("ANDROID-REACH-001", "External input reaches file write sink", "low"),
    "sql": ("ANDROID-REACH-001", "External input reaches SQL sink", "low"),
}
OTHER_SINK = ("ANDROID-REACH-001", "External input reaches security-relevant sink", "low")
NATIVE_RULE = ("ANDROID-REACH-003", "Exported component reaches JNI/native boundary", "low")


def path_findings(paths: DataFrame) -> DataFrame:
    """Located paths (with sink_kind) to findings: a sink counts when its path begins at a source, a native function also from an entry point; of a rule and target the shortest path stands."""
    from_source = F.col("start_type") == "DATAFLOW_SOURCE"
    to_sink = (F.col("target_type") == "SECURITY_SINK") & from_source
    to_native = (F.col("target_type") == "NATIVE_FUNCTION") & (from_source | (F.col("start_type") == "ENTRY_POINT"))
    said = [F.lit(v) for v in OTHER_SINK]
    for kind, rule in SINK_RULES.items():
        said = [F.when(F.col("sink_kind") == kind, new).otherwise(old) for new, old in zip(rule, said)]
    said = [F.when(F.col("target_type") == "NATIVE_FUNCTION", new).otherwise(old) for new, old in zip(NATIVE_RULE, said)]
    own = paths.where(to_sink | to_native).withColumns(dict(zip(("rule_id", "title", "severity"), said)))
    first = own.groupBy("rule_id", "target").agg(F.min_by(F.struct("start", "start_label", "title", "severity", "confidence", "status", "path", "length"), F.struct("length", "path")).alias("f"))
    return first.select("rule_id", "target", "f.start", F.col("f.start_label").alias("component"), "f.title", "f.severity", "f.confidence", "f.status", "f.path", "f.length")


def path_summary(paths: DataFrame) -> DataFrame:
    """The chain of a located path, and a note that nothing is known behind a native function."""
    note = F.when(F.col("target_type") == "NATIVE_FUNCTION", "UNKNOWN_NATIVE_TARGET")
    return paths.select("start", "target", "status", "confidence", "length", F.col("path").alias("chain"), note.alias("note"))


def answer(paths: DataFrame, froms: DataFrame, tos: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """One row: the status of a question for paths between two sets of nodes, how many paths there are, and the unresolved edges at their starts.

    Without starts or targets it is UNKNOWN, as it is without a path when a start has unresolved
    targets (src); else NOT_REACHABLE.
    """
    found = paths.agg(F.count("*").alias("n_paths"))
    both = found.crossJoin(froms.agg(F.count("*").alias("n_from"))).crossJoin(tos.agg(F.count("*").alias("n_to")))  # one row each
    open_ends = froms.join(unresolved.select(F.col("src").alias("node_key")), "node_key", "left_semi").agg(F.count("*").alias("n_unresolved")) if unresolved is not None else froms.limit(1).agg(F.lit(0).cast("long").alias("n_unresolved"))
    row = both.crossJoin(open_ends)
    status = F.when((F.col("n_from") == 0) | (F.col("n_to") == 0), "UNKNOWN").when(F.col("n_paths") > 0, "REACHABLE").when(F.col("n_unresolved") > 0, "UNKNOWN").otherwise("NOT_REACHABLE")
    return row.select(status.alias("status"), "n_paths", "n_from", "n_to", "n_unresolved")

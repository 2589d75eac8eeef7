"""Investigation workspaces (R23): an append-only log folded into a state, as of any event, and one timeline of all sources.

Researchers' entries stand beside machine evidence and never change it: nothing here writes findings,
severities or states of vulnerabilities. A log has the columns workspace, seq (ascending within a
workspace, no ties), ts, op, kind, ref, text, status:

* ADD of a live NODE, FINDING or WORKSPACE makes no second one; a text that isn't empty replaces its
  note (of a WORKSPACE: its name). ADD of a live HYPOTHESIS states it anew. Each ADD of an EDGE, NOTE,
  EVIDENCE or BOOKMARK is an entry of its own.
* REMOVE cancels all that came before under its kind and ref.
* STATUS sets the status of a live HYPOTHESIS (null: OPEN), and its rationale where text isn't null.

Events of other ops or kinds, or with a status that is none, have no effect; rejected() gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.running import running

#: States of a hypothesis.
STATES = ("OPEN", "SUPPORTED", "REFUTED", "UNKNOWN")
#: Kinds of which a ref is one thing, and kinds of which every entry is one.
SINGLE = ("WORKSPACE", "NODE", "FINDING", "HYPOTHESIS")
MANY = ("EDGE", "NOTE", "EVIDENCE", "BOOKMARK")
THING = ["workspace", "kind", "ref"]
#: Log positions that one task sorts at a time.
SHARD = 1 << 16
#: Stages of an analysis as events of a timeline, with their source.
STAGE_EVENT = {
    "ingest": ("APK_INGESTION", "DEX"),
    "manifest": ("MANIFEST_PARSE", "MANIFEST"),
    "jadx": ("JADX_DECOMPILE", "JADX"),
    "code_index": ("CODE_INDEX", "JADX"),
    "native": ("ELF_PARSE", "ELF"),
    "jni": ("JNI_ANALYSIS", "JNI"),
    "semantics": ("SEMANTIC_ANALYSIS", "SEMANTICS"),
    "reachability": ("REACHABILITY_ANALYSIS", "REACHABILITY"),
    "vulnerability_match": ("CVE_CORRELATION", "CVE_DATABASE"),
    "correlation": ("FINDING_GENERATION", "STATIC_RULE"),
}
#: Confidence of a stage's event by its status.
STAGE_CONFIDENCE = {"COMPLETE": "HIGH", "DEGRADED": "MEDIUM", "PARTIAL": "MEDIUM"}


def effective() -> Column:
    """Does an event of a log have a known op, kind and status?"""
    op, kind = F.col("op"), F.col("kind")
    known = (op.isin("ADD", "REMOVE") & kind.isin(*SINGLE, *MANY)) | ((op == "STATUS") & (kind == "HYPOTHESIS"))
    stated = (kind == "HYPOTHESIS") & op.isin("ADD", "STATUS")
    return F.coalesce(known & (~stated | F.col("status").isNull() | F.upper("status").isin(*STATES)), F.lit(False))


def rejected(log: DataFrame) -> DataFrame:
    return log.where(~effective())


def folded(log: DataFrame) -> DataFrame:
    """What is live at the end of a log; as of an event, give the log up to it.

    Per thing: n (entries), added_seq (of its first entry), last_seq, text, status and rationale
    (hypotheses). Two partial aggregates: of removals, which are few, and of what is after them.
    """
    own = log.where(effective()).withColumn("ref", F.coalesce("ref", F.lit("")))
    gone = own.where("op = 'REMOVE'").groupBy(*THING).agg(F.max("seq").alias("_gone"))
    rest = own.where("op <> 'REMOVE'").join(gone, THING, "left").where("_gone IS NULL OR seq > _gone")
    added, said = F.col("op") == "ADD", F.col("op") == "STATUS"
    status = F.upper(F.coalesce("status", F.lit("OPEN")))
    per = rest.groupBy(*THING).agg(
        F.count_if(added).alias("_n"), F.min(F.when(added, F.col("seq"))).alias("added_seq"), F.max_by(F.struct("seq", "text", status.alias("status")), F.when(added, F.col("seq"))).alias("_add"),
        F.max_by("text", F.when(added & (F.col("text") != ""), F.col("seq"))).alias("_note"), F.max_by(F.struct("seq", status.alias("status")), F.when(said, F.col("seq"))).alias("_said"),
        F.max_by(F.struct("seq", "text"), F.when(said & F.col("text").isNotNull(), F.col("seq"))).alias("_why"),
    ).where("_n > 0")
    guess = F.col("kind") == "HYPOTHESIS"
    later = lambda of: F.col(of)["seq"] > F.col("_add.seq")
    return per.select(
        *THING, F.when(F.col("kind").isin(*SINGLE), F.lit(1).cast("long")).otherwise(F.col("_n")).alias("n"), "added_seq", F.greatest(F.col("_add.seq"), F.col("_said.seq")).alias("last_seq"),
        F.when(guess, F.col("_add.text")).otherwise(F.col("_note")).alias("text"), F.when(guess, F.when(later("_said"), F.col("_said.status")).otherwise(F.col("_add.status"))).alias("status"),
        F.when(guess & later("_why"), F.col("_why.text")).alias("rationale"),
    )


def history(log: DataFrame) -> DataFrame:
    """How many entries of each kind a workspace has after each effective event.

    The events of one thing meet to see what each changes; a workspace's changes are summed by ranges of seq.
    """
    w = Window.partitionBy(*THING).orderBy("seq")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    own = log.where(effective()).select("workspace", "seq", "op", "kind", F.coalesce("ref", F.lit("")).alias("ref"))
    own = own.withColumn("_a", F.sum(F.when(F.col("op") == "ADD", 1).otherwise(0)).over(up_to))
    n = F.col("_a") - F.coalesce(F.max(F.when(F.col("op") == "REMOVE", F.col("_a"))).over(up_to), F.lit(0))
    own = own.withColumn("_n", F.when(F.col("kind").isin(*SINGLE), F.least(n, F.lit(1))).otherwise(n))
    own = own.withColumn("_d", F.col("_n") - F.lag("_n", 1, 0).over(w)).select("workspace", "seq", "op", "kind", "ref", "_d")
    return running(own, ["workspace"], ["seq"], F.floor(F.col("seq") / SHARD), {f"n_{k.lower()}": F.when(F.col("kind") == k, F.col("_d")).otherwise(0) for k in (*SINGLE, *MANY)}).drop("_d")


def _event(rows: DataFrame, rank: int, major: Column, minor: int, number: Column, **said: Column) -> DataFrame:
    return rows.select("workspace", F.col("ts"), *(said[c].cast("string").alias(c) for c in ("event_type", "source", "entity_ref", "confidence", "detail")), F.lit(rank).alias("rank"), major.cast("long").alias("major"), F.lit(minor).alias("minor"), number.cast("long").alias("number"))


def timeline(stages: DataFrame, sessions: DataFrame, observations: DataFrame, links: DataFrame, log: DataFrame) -> DataFrame:
    """All events of each workspace with their position in one order: time (none first), then stages, sessions each before their
    observations, links, notes.

    stages: workspace, ts, ord, name, status, detail. sessions: workspace, ts, session_id, state, adapter.
    observations: workspace, ts, session_id, obs_id, adapter, confidence, observation_type, class_name,
    method_name, symbol. links: workspace, ts, link_id, source, fingerprint, confidence, link_type, mode,
    subject, detail. Of log the NOTE entries come in, removed ones too: a timeline is what happened. No
    time is made up. Positions are counted by days, so that a workspace is many tasks.
    """
    name = F.create_map(*(F.lit(v) for k, (event, _) in STAGE_EVENT.items() for v in (k, event)))
    source = F.create_map(*(F.lit(v) for k, (_, source) in STAGE_EVENT.items() for v in (k, source)))
    sure = F.create_map(*map(F.lit, (v for pair in STAGE_CONFIDENCE.items() for v in pair)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = stages.where(F.col("name").isin(*STAGE_EVENT))
    notes = log.where(effective() & (F.col("op") == "ADD") & (F.col("kind") == "NOTE"))
    rows = [
        _event(known, 0, F.lit(0), 0, F.col("ord"), event_type=name[F.col("name")], source=source[F.col("name")], entity_ref=F.lit(None), confidence=F.coalesce(sure[F.col("status")], F.lit("UNKNOWN")), detail=F.trim(F.concat("name", F.lit("="), text("status"), F.lit(" "), text("detail")))),
        _event(sessions, 1, F.col("session_id"), 0, F.lit(0), event_type=F.lit("RUNTIME_SESSION"), source=F.lit("RUNTIME_ADB"), entity_ref=F.concat(F.lit("RUNTIME_SESSION:"), F.col("session_id")), confidence=F.lit("HIGH"), detail=F.concat(F.lit("session "), text("state"), F.lit(" adapter="), text("adapter"))),
        _event(
            observations, 1, F.col("session_id"), 1, F.col("obs_id"), event_type=F.when(F.col("adapter") == "adb", "LIVE_OBSERVATION").otherwise("RUNTIME_OBSERVATION"), source=F.when(F.col("adapter") == "frida", "RUNTIME_FRIDA").otherwise("RUNTIME_ADB"),
            entity_ref=F.concat(F.lit("RUNTIME_OBSERVATION:"), F.col("obs_id")), confidence=F.col("confidence"), detail=F.trim(F.concat(text("observation_type"), F.lit(" "), text("class_name"), F.lit("."), text("method_name"), text("symbol"))),
        ),
        _event(links, 2, F.lit(0), 0, F.col("link_id"), event_type=F.lit("CORRELATION"), source=F.col("source"), entity_ref=F.concat(F.lit("RUNTIME_CORRELATION:"), F.col("fingerprint")), confidence=F.col("confidence"), detail=F.concat(text("link_type"), F.lit(" ["), text("mode"), F.lit("] "), text("subject"), F.lit(" "), F.substring(text("detail"), 1, 80))),
        _event(notes, 3, F.lit(0), 0, F.col("seq"), event_type=F.lit("RESEARCHER_NOTE"), source=F.lit("USER_NOTE"), entity_ref=F.col("ref"), confidence=F.lit("N/A"), detail=F.substring(text("text"), 1, 200)),
    ]
    merged = rows[0]
    for r in rows[1:]:
        merged = merged.unionByName(r)
    day = F.coalesce(F.unix_date(F.to_date("ts")), F.lit(-(1 << 30)))
    order = ["ts", "rank", "major", "minor", "number"]
    return running(merged, ["workspace"], order, day, {"position": F.lit(1)}).drop("rank", "major", "minor", "number")


#: Stages that don't count for the status of an analysis.
EXEMPT_STAGES = ("ghidra", "graph_snapshot", "validation", "obfuscation", "native_deep")


def overall_status(stages: DataFrame, *group: str) -> DataFrame:
    """Stages (name, status) to the status of each group: FAILED only where the manifest failed, COMPLETE where all that counts is, else PARTIAL."""
    counts = ~F.coalesce(F.col("name"), F.lit("")).isin(*EXEMPT_STAGES)
    failed = F.coalesce(F.col("status") == "FAILED", F.lit(False))
    other = counts & F.coalesce(F.col("status") != "COMPLETE", F.lit(True))
    per = stages.groupBy(*group).agg(F.count_if(counts).alias("n_stages"), F.count_if(counts & failed).alias("n_failed"), F.bool_or(failed & F.coalesce(F.col("name") == "manifest", F.lit(False))).alias("_manifest"), F.bool_or(other).alias("_other"))
    return per.withColumn("overall", F.when(F.col("_manifest"), "FAILED").when(F.col("_other"), "PARTIAL").otherwise("COMPLETE")).drop("_manifest", "_other")

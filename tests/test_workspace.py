"""Workspaces against a plain replay, after every event; the timeline's order; running totals over ranges."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tesserine.functions.running import running
from tesserine.operators import workspace as W

LOG = "workspace string, seq long, ts timestamp, op string, kind string, ref string, text string, status string"
T0 = datetime(2024, 1, 1)


def events(n, seed=3):
    r = random.Random(seed)
    for k in range(n):
        yield (r.choice("xy"), k, T0 + timedelta(hours=r.randrange(60)), r.choice(["ADD", "ADD", "ADD", "STATUS", "REMOVE", "MOVE", None]), r.choice([*W.SINGLE, *W.MANY, "HYPOTHESIS", "HYPOTHESIS", "ODD", None]),
               r.choice(["a", "b", None]), r.choice(["", None, f"t{k}"]), r.choice(["supported", "OPEN", None, "sure", "REFUTED"]))


def replay(log):
    """Live things as {(workspace, kind, ref): [n, added, last, text, status, rationale]}, event by event."""
    live = {}
    for ws, seq, _, op, kind, ref, text, status in log:
        key, status = (ws, kind, ref or ""), (status or "OPEN").upper()
        if kind not in W.SINGLE + W.MANY or op not in ("ADD", "REMOVE", "STATUS") or (op == "STATUS" and kind != "HYPOTHESIS"):
            yield None, live
            continue
        if kind == "HYPOTHESIS" and op != "REMOVE" and status not in W.STATES:
            yield None, live
            continue
        if op == "REMOVE":
            live.pop(key, None)
        elif op == "STATUS":
            if key in live:
                live[key][2], live[key][4] = seq, status
                live[key][5] = text if text is not None else live[key][5]
        else:
            old = live.get(key)
            n = 1 if not old or kind in W.SINGLE else old[0] + 1
            if kind == "HYPOTHESIS":
                live[key] = [1, old[1] if old else seq, seq, text, status, None]
            else:
                live[key] = [n, old[1] if old else seq, seq, text or (old[3] if old else None), None, None]
        yield seq, live


def state(df):
    return {(r.workspace, r.kind, r.ref): [r.n, r.added_seq, r.last_seq, r.text, r.status, r.rationale] for r in df.collect()}


@pytest.mark.parametrize("upto", [0, 1, 7, 40, 150, 400])
def test_state_as_of_an_event_equals_replay(spark, upto):
    log = list(events(400))
    want = {}
    for _, live in replay(log[:upto]):
        want = live
    assert state(W.folded(spark.createDataFrame(log, LOG).where(F.col("seq") < upto))) == want


def test_history_equals_replay_after_each_event(spark, monkeypatch):
    monkeypatch.setattr(W, "SHARD", 16)
    log, want = list(events(400, 5)), {}
    for (ws, *_), (seq, live) in zip(log, replay(log)):
        if seq is not None:
            want[seq] = {f"n_{k.lower()}": sum(v[0] for t, v in live.items() if t[:2] == (ws, k)) for k in W.SINGLE + W.MANY}
    df = spark.createDataFrame(log, LOG)
    got = {r.seq: {c: r[c] for c in r.asDict() if c.startswith("n_")} for r in W.history(df).collect()}
    assert got == want and W.rejected(df).count() == len(log) - len(want)


def test_state_never_promotes_a_hypothesis(spark):
    rows = [("w", 1, T0, "ADD", "HYPOTHESIS", "h", "s", "SUPPORTED"), ("w", 2, T0, "STATUS", "HYPOTHESIS", "h", None, "sure"), ("w", 3, T0, "REMOVE", "HYPOTHESIS", "h", None, None), ("w", 4, T0, "STATUS", "HYPOTHESIS", "h", "r", "REFUTED")]
    df = spark.createDataFrame(rows, LOG)
    assert state(W.folded(df.where("seq < 3"))) == {("w", "HYPOTHESIS", "h"): [1, 1, 1, "s", "SUPPORTED", None]}
    assert state(W.folded(df)) == {}


def test_timeline_is_one_order(spark):
    stages = spark.createDataFrame([("w", None, 1, "manifest", "DEGRADED", None), ("w", None, 0, "ingest", "COMPLETE", "x"), ("w", None, 2, "unheard", "COMPLETE", "x")], "workspace string, ts timestamp, ord int, name string, status string, detail string")
    sessions = spark.createDataFrame([("w", T0, 2, "OPEN", "adb"), ("w", T0, 1, "OPEN", "mock")], "workspace string, ts timestamp, session_id long, state string, adapter string")
    seen = spark.createDataFrame([("w", T0, 2, 9, "adb", "HIGH", "JAVA", "a.B", "c", None), ("w", T0 + timedelta(days=1), 1, 3, "frida", "LOW", "NATIVE", None, None, "strcpy"), ("w", T0, 1, 4, "mock", "LOW", "JAVA", "a.B", "d", None)], "workspace string, ts timestamp, session_id long, obs_id long, adapter string, confidence string, observation_type string, class_name string, method_name string, symbol string")
    links = spark.createDataFrame([("w", T0, 1, "S", "f", "HIGH", "T", "LIVE", "M", "d" * 100)], "workspace string, ts timestamp, link_id long, source string, fingerprint string, confidence string, link_type string, mode string, subject string, detail string")
    log = spark.createDataFrame([("w", 1, T0, "ADD", "NOTE", "r", "n" * 300, None), ("w", 2, T0, "REMOVE", "NOTE", "r", None, None)], LOG)
    rows = sorted(W.timeline(stages, sessions, seen, links, log).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 10)) and [r.entity_ref for r in rows[2:6]] == ["RUNTIME_SESSION:1", "RUNTIME_OBSERVATION:4", "RUNTIME_SESSION:2", "RUNTIME_OBSERVATION:9"]
    assert [(r.event_type, r.confidence, r.detail) for r in rows[:2]] == [("APK_INGESTION", "HIGH", "ingest=COMPLETE x"), ("MANIFEST_PARSE", "MEDIUM", "manifest=DEGRADED")]
    assert rows[6].detail == "T [LIVE] M " + "d" * 80 and rows[7].detail == "n" * 200 and (rows[8].source, rows[8].detail) == ("RUNTIME_FRIDA", "NATIVE .strcpy")


def test_running_totals_with_null_keys_and_shards(spark):
    rows = [(None if k % 3 == 0 else k % 3, k, k % 5 - 2) for k in range(100)]
    df = running(spark.createDataFrame(rows, "g int, k long, v int"), ["g"], ["k"], F.floor(F.col("k") / 7), {"total": F.col("v")})
    want, sums = {}, {}
    for g, k, v in rows:
        sums[g] = want[k] = sums.get(g, 0) + v
    assert {r.k: r.total for r in df.collect()} == want


def test_overall_status(spark):
    cases = {"a": [("manifest", "FAILED"), ("native", "COMPLETE")], "b": [("native", "FAILED"), ("manifest", "COMPLETE")], "c": [("manifest", "COMPLETE"), ("ghidra", "FAILED")], "d": [("validation", "FAILED")], "e": [("native", None)], "f": [("native", "DEGRADED"), (None, "COMPLETE")]}
    df = spark.createDataFrame([(a, *s) for a, stages in cases.items() for s in stages], "analysis string, name string, status string")
    assert {r.analysis: r.overall for r in W.overall_status(df, "analysis").collect()} == {"a": "FAILED", "b": "PARTIAL", "c": "COMPLETE", "d": "COMPLETE", "e": "PARTIAL", "f": "PARTIAL"}

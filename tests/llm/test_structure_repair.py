"""Structure repair: block tables, tracing and pieces against a plain search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from tesserine.llm import structure_repair
from tesserine.llm.common import Scratch


def brute(rows):
    """Faults, cost, least edits and repaired lines of the (turn, role, text) rows of one conversation, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, before):
        found = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        if i < len(rows):
            _, role, text = rows[i]
            c, e, lines = best(i + 1, before)
            found.append((c + 3, "D" + e, lines))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if role[:1] and role[0] in after[before]:
                    c, e, lines = best(i + 1, role[0])
                    found.append((c + late, "K" + e, (f"{role}:{text}", *lines)))
                for to in ("user", "assistant"):
                    if to[0] in after[before]:
                        c, e, lines = best(i + 1, to[0])
                        found.append((c + 2 + late, "R" + e, (f"{to}:{text}", *lines)))
        for to, more in (("user", 0), ("assistant", 1)):
            if to[0] in after[before] and not (before == "a" or (before == "u" and more == 0)):
                c, e, lines = best(i, to[0])
                found.append((c + 2, "I" + e, (f"{to}:", *lines)))
        if before == "a":  # a pair may come here too: two inserts, then the same question from a again
            for c, e, lines in [direct(i, "u")]:
                found.append((c + 2, "I" + e, ("user:", *lines)))
        return min(found)

    @cache
    def direct(i, before):
        """As best(), from u, without inserting an answer first."""
        found = [(10**6, "Z", ())]
        if i < len(rows):
            _, role, text = rows[i]
            c, e, lines = best(i + 1, before)
            found.append((c + 3, "D" + e, lines))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                c, e, lines = best(i + 1, "a")
                if role[:1] == "a":
                    found.append((c + late, "K" + e, (f"{role}:{text}", *lines)))
                found.append((c + 2 + late, "R" + e, (f"assistant:{text}", *lines)))
        return min(found)

    cost, edits, lines = best(0, "")
    known = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(known) - min(known) + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def some_rows(rng, n):
    roles, texts = ("user", "assistant", "user", "assistant", "system", "tool", "", "u"), ("", " ", "done.", "why?", "cut", "so", "ok! ", "x.", "y.", "z.", "w.", "v.")
    turns = sorted(rng.choice((None, rng.randint(0, 20))) or -1 for _ in range(n)) if rng.random() < 0.3 else list(range(n))
    return [(None if t == -1 else t, rng.choice(roles), rng.choice(texts) + (str(rng.randint(0, 50)) + "." if rng.random() < 0.6 else "")) for t in turns]


def result(made):
    return tuple(made[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


def test_one_conversation_equals_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        rows = some_rows(rng, rng.randint(1, 9))
        assert result(structure_repair.repaired_rows(*map(list, zip(*rows, strict=True)))) == brute(rows)


def test_tables():
    vectors, steps, costs, end = structure_repair.block_tables()
    assert len(vectors) < 200 and (vectors.min(axis=1) == 0).all()
    rng = np.random.default_rng(2)
    for _ in range(300):
        symbols = rng.integers(0, 9, rng.integers(0, 14)).astype(np.uint8)
        v, total = end, 0
        for x in symbols[::-1]:
            total += costs[0][v, x]
            v = steps[0][v, x]
        at, cost = structure_repair.backward(structure_repair.blocks_of(symbols), end)
        assert (at[0], cost) == (v, total)


def ordered(rows):
    by = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())
    of = {}
    for r in rows:
        of.setdefault(r[0], []).append((r[0], r[1], r[2] or "", r[3] or ""))
    return {c: [x[1:] for x in sorted(own, key=by)] for c, own in of.items()}


@pytest.mark.parametrize("seed, shards", [(1, 1), (2, 7), (3, 90)])
def test_shards_and_pieces_equal_brute_force(spark, seed, shards):
    rng = random.Random(seed)
    rows = [(c, *r) for c in (None, *range(40)) for r in some_rows(rng, rng.randint(1, 6))]
    rows += [(99, *r) for r in some_rows(rng, 150)] + [(100, None, None, None), (101, 3, None, "a b"), (7, 1, "user", "x" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS shard", "2 AS idx", "'x' AS print")
    made = structure_repair.repaired(frame, Scratch(spark, "t"), shards=shards)
    assert {r.conv_id: result(r) for r in made.collect()} == {c: brute(own) for c, own in ordered(rows).items()}


def test_every_conversation_has_a_row(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"well {t}.") for c in range(300) for t in range(1)] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {r.conv_id: result(r) for r in structure_repair.with_all(frame, structure_repair.repaired(structure_repair.damaged(frame), Scratch(spark, "t"))).collect()}
    assert len(made) == 301
    gone = [c for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and all(made[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure_repair.with_all(none, structure_repair.repaired(structure_repair.damaged(none), Scratch(spark, "t"))).count() == 0

"""The prefix trie: its matrices and shards against plain walks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tesserine.llm import prefix_trie
from tesserine.llm.common import Scratch


@pytest.mark.parametrize("columns", [1, 3, 32])
def test_order_and_shared_turns(columns):
    rng = random.Random(columns)
    for _ in range(150):
        rows = [[rng.randint(1, 2) for _ in range(rng.choice((0, 1, 2, 3, 7, 12)))] for _ in range(rng.randint(1, 30))]
        conv = np.array(rng.sample(range(100), len(rows)))
        lens = np.array([len(r) for r in rows])
        at = np.concatenate(([0], np.cumsum(lens)[:-1]))
        order, shared = prefix_trie.in_order(np.array([x for r in rows for x in r], np.int32), at, lens, conv, columns)
        want = sorted(range(len(rows)), key=lambda i: (rows[i], conv[i]))
        assert order.tolist() == want
        for k in range(1, len(rows)):
            a, b = rows[want[k - 1]], rows[want[k]]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert shared[k] == n


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    nodes, members = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        members[c] = seq
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = []
    for seq, of in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaf = lambda s: not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in nodes)
        saved = sum((len(nodes[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) for s in below if s)
        ends = ",".join(map(str, sorted(c for c in of if members[c] == seq)))
        out.append((min(of), len(seq), min(nodes[seq[:-1]]) if seq else None, len(of), len(children), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(made):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in names) for r in made.collect()), key=str)


@pytest.mark.parametrize("seed, shards", [(1, 1), (2, 5), (3, 60)])
def test_trie_equals_brute_force(spark, seed, shards):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-25, 70), 1000, 1001]:
        kind = rng.random()
        n = rng.randint(1, 6) if kind < 0.7 else 4
        for t in range(n):
            rows.append((c, rng.choice((t, t, t, None)), rng.choice(("user", "assistant", None)) if kind < 0.5 else "user", "hello again" if kind > 0.4 else rng.choice(("a b", "", None, "a  c", " "))))
    rows += [(5, t, "user", "on and on") for t in range(100)] + [(None, 1, "user", "x"), (6, 1, "user", "twice"), (6, 1, "user", "twice")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS ids", "2 AS key", "3 AS shard")
    made = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(frame)), Scratch(spark, "t"), shards=shards)
    assert rows_of(made) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(7, None, None, None)], [(41, 0, "user", "x"), (61, 0, "user", "x")]])
def test_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(frame)), Scratch(spark, "t"))) == brute(rows)


def test_identical_conversations_over_many_shards(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = prefix_trie.trie(prefix_trie.sequences(frame), Scratch(spark, "t"), shards=16).collect()
    assert sorted((r.depth, r.n_convs, r.n_children, r.n_leaves) for r in made) == [(0, 400, 1, 1), (1, 400, 1, 1), (2, 400, 1, 1), (3, 400, 0, 1)]
    assert next(r for r in made if r.depth == 3).ends_sha256 == hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()

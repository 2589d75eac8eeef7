"""The quality classifier against plain loops: features, scores, held-out rows and the risk that it minimises."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tesserine.llm import quality_classifier as Q


def kind_of(c):
    for kind, marks in Q.MARKS.items():
        if c in marks and ord(c) < 0x24F:
            return kind
    if ord(c) >= 0x24F:
        c = "ɏ"
    return "line" if c == "\n" else "space" if c.isspace() else "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else "other"


def plain_features(text):
    text, n = text or "", max(1, len(text or ""))
    kinds = Counter(map(kind_of, text))
    shares = [kinds[k] / n for k in Q.CLASSES]
    words, lines = text.split(), [x for x in text.split("\n") if x]
    m = max(1, len(words))
    again = sum(words[i] == words[i - 1] for i in range(1, len(words))) / m
    twice = (len(lines) - len(set(lines))) / len(lines) if lines else 0.0
    out = [*shares, *map(math.sqrt, shares), again, math.sqrt(again), twice, len(set(words)) / m**0.9, math.log(1 + m), 1 / m, min(20.0, sum(len(w) for w in words) / m), len(lines) / m]
    low = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text]
    triples = Counter(((a * 961 + b * 31 + c) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % Q.TRIPLES for a, b, c in zip(low, low[1:], low[2:], strict=False))
    return out + [math.sqrt(triples[k] / n) for k in range(Q.TRIPLES)]


def some_texts(rng, n):
    good = lambda: ". ".join(" ".join(rng.choice(("the", "river", "runs", "Over", "old", "stones", "é", "and")) for _ in range(rng.randint(5, 12))) for _ in range(rng.randint(1, 6)))
    bad = lambda: "\n".join(rng.choice(("BUY NOW!!! $$$", "| # | % | & |", "click click click 123")) for _ in range(rng.randint(1, 9)))
    return [(i, good() if i % 3 else bad()) for i in range(n)]


def test_features_equal_plain_loops():
    rng = random.Random(8)
    texts = [t for _, t in some_texts(rng, 40)] + [None, "", "a", "ab", "Āɐ\U0001f600あ x", "\x00\t\r\n", "\n\n", "Z" * 5000]
    for t in texts:
        assert np.allclose(Q.features(t), plain_features(t))


def test_scores_and_held_out_rows_equal_plain_loops(spark):
    rng = random.Random(9)
    rows = [*some_texts(rng, 240), (240, None), (241, ""), (3, "twice the same identifier")]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 240, 2)] + [(5, None), (None, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int")
    model = Q.fit(docs, known)
    made = Q.with_quality(docs, known).collect()
    assert len(made) == len(rows)
    for r in made:
        x = [max(-8.0, min(8.0, (v - m) / s)) for v, m, s in zip(plain_features(r.text), model["mean"], model["scale"], strict=True)]
        at = sum(v * w for v, w in zip(x, model["weights"], strict=False)) + model["weights"][-1]
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-40.0, min(40.0, at)))), rel_tol=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)
    right = [r.predicted == int(r.doc_id % 3 > 0) for r in made if r.held_out and r.doc_id < 240]
    assert sum(right) >= 0.9 * len(right)
    # Neither labels nor texts of held-out rows have a part in the model.
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    other = Q.fit(spark.createDataFrame([(i, "junk" if out(i) else t) for i, t in rows], "doc_id long, text string"), spark.createDataFrame([(i, 1 - y if out(i) and y is not None else y) for i, y in labels], "doc_id long, quality int"))
    assert np.allclose(other["weights"], model["weights"]) and other["prior"] == model["prior"]


def test_risk_is_what_plain_loops_give_and_falls():
    rng = np.random.default_rng(10)
    p, u = rng.normal(1, 1, (60, 3)), np.concatenate([rng.normal(1, 1, (60, 3)), rng.normal(-1, 1, (60, 3))])
    w = Q.nnpu(p, u, 0.5)
    chance = lambda x, w: 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, w, strict=False)) + w[-1])))
    for weights in (w, np.array([0.3, -0.2, 0.1, 0.05])):
        positive = 0.5 * sum(-math.log(chance(x, weights)) for x in p) / len(p)
        negative = sum(-math.log(1 - chance(x, weights)) for x in u) / len(u) - 0.5 * sum(-math.log(1 - chance(x, weights)) for x in p) / len(p)
        assert np.allclose(Q.risks(weights, p, u, 0.5), (positive, negative))
    least = lambda w: sum(max(0.0, r) for r in Q.risks(w, p, u, 0.5))
    assert least(w) < least(np.zeros(4)) and all(least(w) <= least(w + d) + 0.02 for d in 0.3 * np.eye(4))

"""Operator 8: a quality classifier learnt from positives and unlabelled text.

Trusted positives and unlabelled web text train a logistic score by minimising the
non-negative unbiased risk: with class prior p, the risk of the negatives is taken as that of
the unlabelled minus p times that of the positives read as negatives, and where a step's
estimate falls under zero the step goes the other way.

The prior is estimated from the same two samples; labels of negatives are not used at all. Half of
the positives and of the unlabelled train a score that tells the two apart; on the other halves,
the share of the unlabelled above a threshold over the share of the positives above it bounds the
prior from above, and the threshold with the least bound, sampling error included, is taken.

Both samples are bounded by documented parameters (MAX_POSITIVES, MAX_UNLABELLED) and drawn by
a hash of the identifier, one text an identifier, so they are the same on every run. Their feature
rows, WIDTH numbers each, are what the driver gets; every text is scored in Spark, whole.

Features come from the text alone: character classes, words, lines and hashed character triples.
Labels of held-out rows (crc32 of the identifier's digits modulo 3 equal to 1) are never read.

Defined results: null is the empty text; it gets a score like any other. With no usable positive
or no unlabelled text every score is DEFAULT_PRIOR. Repeated label rows of a document count once,
as their mean rounded; a null label is no label. Of the texts of a repeated identifier the least
one is sampled; all are scored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, only, read_table, text_or_empty

MAX_POSITIVES = 4000
MAX_UNLABELLED = 8000
DEFAULT_PRIOR = 0.5
#: Counters of hashed character triples.
TRIPLES = 64
THRESHOLD = 0.5
#: Character classes, for characters under U+0250; what lies above counts as other.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "quote", "symbol", "bar", "bang", "other")
MARKS = {"stop": ".,;:?", "quote": "'\"()-’", "symbol": "#*$%&<>=+@^~\\[]{}_/", "bar": "|", "bang": "!"}


def _class_table() -> np.ndarray:
    table = np.full(0x250, CLASSES.index("other"), np.uint8)
    for c in map(chr, range(0x250)):
        kind = next((k for k, marks in MARKS.items() if c in marks), None)
        kind = kind or ("line" if c == "\n" else "space" if c.isspace() else "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else "other")
        table[ord(c)] = CLASSES.index(kind)
    return table


CLASS_OF = _class_table()


def features(text: str | None) -> list[float]:
    text = text or ""
    n = max(1, len(text))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(CLASS_OF[np.minimum(codes, 0x24F)], minlength=len(CLASSES)) / n
    words = text.split()
    m = max(1, len(words))
    again = sum(map(eq, words, words[1:])) / m
    lines = [x for x in text.split("\n") if x]
    twice = 1 - len(set(lines)) / len(lines) if lines else 0.0
    shown = counts.tolist()
    root = [x**0.5 for x in shown]
    surface = [*shown, *root, again, again**0.5, twice, len(set(words)) / m**0.9, float(np.log1p(m)), 1.0 / m, min(20.0, sum(map(len, words)) / m), len(lines) / m]
    small = np.where((codes >= 65) & (codes <= 90), codes + 32, codes).astype(np.uint64)
    mixed = (small[:-2] * np.uint64(961) + small[1:-1] * np.uint64(31) + small[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    triples = np.bincount((mixed % np.uint64(TRIPLES)).astype(np.int64), minlength=TRIPLES) / n
    return [*surface, *np.sqrt(triples).tolist()]


WIDTH = len(features(""))


def chance(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The logistic score of feature rows; the last weight is the offset."""
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -40, 40)))


def risks(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The logistic risk of the positives, and the unbiased estimate of that of the negatives (it may be negative)."""
    sp, su = chance(positive, weights), chance(unlabelled, weights)
    loss = lambda s: -np.log(np.maximum(s, 1e-12)).mean()
    return prior * loss(sp), loss(1 - su) - prior * loss(1 - sp)


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 1e-3) -> np.ndarray:
    """Weights (the last is the offset) that minimise the non-negative unbiased risk of the logistic loss."""
    w = np.zeros(positive.shape[1] + 1)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    slope = lambda x, pull: np.append(pull @ x, pull.sum()) / len(x)
    for t in range(1, steps + 1):
        sp, su = chance(positive, w), chance(unlabelled, w)
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        of_negative = slope(unlabelled, su) - prior * slope(positive, sp)
        of_positive = -prior * slope(positive, 1 - sp)
        step = of_positive + of_negative if negative >= 0 else -of_negative
        step = step + decay * np.append(w[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step**2
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.05) -> float:
    """The share of positives among the unlabelled, from the two samples alone; rows are in no order that matters."""
    if len(positive) < 8 or len(unlabelled) < 8:
        return DEFAULT_PRIOR
    w = nnpu(positive[::2], unlabelled[::2], 0.5)
    p, u = np.sort(chance(positive[1::2], w)), np.sort(chance(unlabelled[1::2], w))
    at = np.unique(p)
    above = lambda s: (len(s) - np.searchsorted(s, at, "left")) / len(s)
    error = np.sqrt(np.log(20) / 2 / len(u)) + np.sqrt(np.log(20) / 2 / len(p))
    share_p, share_u = above(p), above(u)
    enough = share_p >= least_share
    best = np.argmin((share_u[enough] + error) / share_p[enough])
    return float(np.clip(share_u[enough][best] / share_p[enough][best], 0.02, 0.98))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _feature_rows(docs: DataFrame, most: int) -> np.ndarray:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    # One text an identifier, so no more rows than identifiers come to the driver.
    texts = docs.groupBy("id").agg(F.min(text_or_empty("text")).alias("text"))
    rows = texts.orderBy(F.xxhash64("id", F.lit("rows")), "id").limit(most).select(of("text").alias("x")).collect()
    return np.array([r[0] for r in rows], float) if rows else np.empty((0, WIDTH))


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """At most so many distinct ids, by a hash; the hash is cut first, so that few ids are sorted and shuffled."""
    grain = 1 << 20
    share = min(grain, 1 + 4 * most * grain // max(1, ids.count()))
    cut = ids.where(F.pmod(F.xxhash64("id", F.lit("cut")), F.lit(grain)) < share)
    return cut.distinct().orderBy(F.xxhash64("id"), "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    """The model: mean and scale of the features, weights, prior and how many rows were used."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~is_held_out(F.col("id")))
    positives = known.groupBy("id").agg(F.round(F.avg("y")).cast("int").alias("y")).where("y = 1").select("id")
    p = _feature_rows(own.join(_sample(positives, max_positives), "id", "left_semi"), max_positives)
    u = _feature_rows(own.join(_sample(own.select("id"), max_unlabelled), "id", "left_semi"), max_unlabelled)
    if not len(p) or not len(u):
        return {"prior": DEFAULT_PRIOR, "weights": None, "positives": len(p), "unlabelled": len(u)}
    mean, scale = u.mean(0), u.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    prior = estimated_prior(p, u)
    return {"prior": prior, "weights": nnpu(p, u, prior), "mean": mean, "scale": scale, "positives": len(p), "unlabelled": len(u)}


def score(text: Column, model: dict) -> Column:
    """The score, 0 to 1, of a string column."""
    if model["weights"] is None:
        return F.lit(float(model["prior"]))
    mean, scale, weights = model["mean"], model["scale"], model["weights"]

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        only("quality_classifier")
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(chance(np.clip((np.array([features(t) for t in texts]) - mean) / scale, -8, 8), weights))

    return of(text)


def with_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with held_out, score and predicted; such columns are replaced."""
    model = fit(docs, labels, text=text, doc_id=doc_id, **options)
    out = docs.withColumns({"held_out": F.coalesce(is_held_out(F.col(doc_id)), F.lit(False)), "score": score(text_or_empty(text), model)})
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality")).select("doc_id", "held_out", "score", "predicted")

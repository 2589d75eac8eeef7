"""Operator 5: quality rules with compression bands.

The zstandard ratio (bytes over compressed bytes) of the whole text and of each fixed chunk is
held against limits by length: above the band a text repeats itself, below it holds nothing
that compresses, as encoded or random data. A text is cut into chunks of CHUNK_BYTES; the tail is
a chunk with the limits of its own length, so every byte is judged twice. A text passes when its
own ratio lies in its band and at most CHUNK_SHARE of its bytes lie in chunks outside theirs. The
counts that come with it (words, symbols, repeated lines and words in repeated 8-word windows)
are exact.

BANDS are parameters. The given ones are the quantiles 0.005 and 0.995, by length, of the ratios
of documents labelled good that pass the base rules (sf0.1: 3,300 documents in four languages),
widened by about 15 in 100 and rounded; from 64 KiB on, where no such documents were, the upper
limit is wider, since long prose finds more to refer to. Under 64 bytes the format's own bytes
outweigh any text, so only repetition shows there. calibrated() works bands out anew from any
trusted documents.

Defined results: null is a text without words; the empty text has ratio 0 and lies within the
limits. Equal windows are found by exact ranks of word pairs, then of pairs of pairs, not by
hashes. Repeated rows are judged each; an empty table gives none.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, only, read_table, text_or_empty

#: Bytes from which a band holds, and its least and largest ratio.
BANDS = (
    (0, 0.0, 1.05), (64, 0.95, 1.55), (128, 1.0, 1.8), (256, 1.15, 2.1), (512, 1.25, 2.25), (1024, 1.5, 2.4),
    (2048, 1.65, 2.6), (4096, 1.8, 2.8), (8192, 1.85, 3.0), (16384, 1.95, 3.3), (65536, 1.95, 4.0),
)
CHUNK_BYTES = 2048
CHUNK_SHARE = 0.25
LEVEL = 3
#: Words end at these white-space characters; these characters are symbols.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, base_failed boolean, kept boolean"


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL)


def repeated_words(words: list[str], window: int = 8) -> int:
    """Words inside windows of that many (a power of two) words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    number: dict[str, int] = {}
    ranks = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        pairs = ranks[:-size] * (int(ranks.max()) + 1) + ranks[size:]
        _, ranks = np.unique(pairs, return_inverse=True)
        size *= 2
    starts = np.flatnonzero(np.bincount(ranks)[ranks] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def ratio_of(raw: bytes) -> float:
    return len(raw) / max(1, len(_compressor().compress(raw)))


def within(raw: bytes, bands=BANDS) -> bool:
    """Does the ratio of raw lie in the band of its length?"""
    _, low, high = next(b for b in reversed(bands) if len(raw) >= b[0])
    return low <= ratio_of(raw) <= high


def compression(raw: bytes, bands=BANDS) -> tuple[float, float, bool]:
    """The whole text's ratio, the share of its bytes in chunks outside their bands, and whether both are within the limits."""
    chunks = [raw[k : k + CHUNK_BYTES] for k in range(0, len(raw), CHUNK_BYTES)]
    bad = sum(len(c) for c in chunks if not within(c, bands)) / max(1, len(raw))
    return ratio_of(raw), bad, within(raw, bands) and bad <= CHUNK_SHARE


def calibrated(docs: DataFrame, text: str = "text", lengths=tuple(b[0] for b in BANDS), low: float = 0.005, high: float = 0.995, widen: float = 0.15) -> tuple:
    """Bands for trusted documents: the two quantiles of the ratios of each length class, widened. Classes without documents stay open."""
    bounded_batches(docs.sparkSession)
    ratio = F.pandas_udf(lambda raws: pd.Series([ratio_of(bytes(r)) for r in raws], dtype="float64"), "double")
    raw = F.encode(text_or_empty(text), "UTF-8")
    least = sum((F.when(F.octet_length(text_or_empty(text)) >= n, 1).otherwise(0) for n in lengths[1:]), F.lit(0))
    found = docs.select(least.alias("k"), ratio(raw).alias("r")).groupBy("k").agg(F.percentile_approx("r", [low, high], 10000).alias("q")).collect()  # a row a class
    limits = {r["k"]: (r["q"][0] * (1 - widen), r["q"][1] * (1 + widen)) for r in found}
    return tuple((n, *limits.get(k, (0.0, float("inf")))) for k, n in enumerate(lengths))


def judged(text: str | None, bands=BANDS) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip("\t\n\v\f\r ")]
    repeats = repeated_words(words)
    ratio, bad, fits = compression(text.encode(), bands)
    failed = n < 20 or 100 * repeats > 30 * n
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, ratio, bad, failed, fits and not failed


def with_quality_rules(docs: DataFrame, text: str = "text", bands=BANDS) -> DataFrame:
    """docs with the counts, ratio, bad_chunks (a share of bytes), base_failed and kept; such columns are replaced."""
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    @F.pandas_udf(COLUMNS)
    def judge(texts: pd.Series) -> pd.DataFrame:
        only("quality_rules")
        return pd.DataFrame([judged(t, bands) for t in texts], columns=names)

    own = free_name(docs, "made")
    return docs.withColumn(own, judge(F.col(text).cast("string"))).withColumns({n: F.col(f"{own}.{n}") for n in names}).drop(own)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")

"""Operator 4: token counts by heap-and-linked-list byte-pair merging.

The symbols of a text are its characters, after spaces became the mark U+2581 and one mark
was put in front. A heap hands out the adjacent pair of lowest rank; a linked list joins it.
The count is symbols minus merges, plus the further bytes of characters that have no piece
(byte fallback). No identifier is made.

A merge never crosses a point whose two characters stand next to each other in no piece of the
vocabulary. So a text is cut into short segments, whose counts a bounded cache holds: before a
run of marks and around a line feed (if the vocabulary, when loaded, turns out to allow that),
and then within a segment at any other such point, as between a word and its full stop (segments of
letters alone are left whole).

Defined results: null is counted as the empty text, which has 0 tokens. Repeated rows are
counted one by one, and columns other than the text play no part.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import concat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, only, read_table, text_or_empty

MARK = "▁"
#: A worker caches at most 4 * CACHED_SEGMENTS counts of segments of CACHED_LENGTH characters, some 70 MB.
CACHED_SEGMENTS = 160_000
CACHED_LENGTH = 48
TOKEN_LIMIT = 4096


class _Counts(dict):
    """Counts of segments that follow prefix, filled on demand; the older half goes when it is full."""

    def __init__(self, counter: PieceCounter, prefix: str):
        super().__init__()
        self.counter, self.prefix, self.older = counter, prefix, {}

    def __missing__(self, rest: str) -> int:
        if (n := self.older.get(rest)) is None:
            n = self.counter.count_parts(self.prefix, rest)
        if len(rest) <= CACHED_LENGTH:
            if len(self) >= CACHED_SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[rest] = n
        return n


class PieceCounter:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in kept}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[s] for piece, s in scores.items()}
        self.cut_marks = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.cut_lines = not any("\n" in p for p in self.rank if len(p) > 1)
        self.single = {p for p in self.rank if len(p) == 1}
        self.neighbours = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.after_mark, self.plain = _Counts(self, MARK), _Counts(self, "")

    def count_parts(self, prefix: str, rest: str) -> int:
        """The count of prefix + rest, cut where no piece has the two neighbours."""
        if rest.isalpha():  # words seldom have such points, and need no cut to be counted
            return self.count_segment(prefix + rest)
        near = self.neighbours
        cuts = [i for i in range(1, len(rest)) if rest[i - 1 : i + 1] not in near]
        if not cuts:
            return self.count_segment(prefix + rest)
        parts = [rest[a:b] for a, b in zip(cuts, [*cuts[1:], len(rest)])]
        head = self.after_mark[rest[: cuts[0]]] if prefix else self.plain[rest[: cuts[0]]]
        return head + sum(map(self.plain.__getitem__, parts))

    def count_segment(self, seg: str) -> int:
        n, rank_of = len(seg), self.rank.get
        if n == 0:
            return 0
        # end[i]: where the symbol that starts at i ends and the next one starts; n when it was joined to its left.
        end, prv = [*range(1, n + 1), 0], list(range(-1, n))
        bits = n.bit_length()
        mask = (1 << bits) - 1
        # An entry is rank, start and end in one number: lowest rank first, then leftmost.
        heap = [(r << bits | i) << bits | i + 2 for i, r in enumerate(map(rank_of, map(concat, seg, seg[1:]))) if r is not None]
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            i, e = top >> bits & mask, top & mask
            j = end[i]
            if end[j] != e:
                continue  # one of the two has changed since; end[n] is no end
            end[i], end[j] = e, n
            merges += 1
            if e < n:
                prv[e] = i
                if (r := rank_of(seg[i : end[e]])) is not None:
                    heappush(heap, (r << bits | i) << bits | end[e])
            if i and (r := rank_of(seg[prv[i] : e])) is not None:
                heappush(heap, (r << bits | prv[i]) << bits | e)
        if self.single.issuperset(seg):
            return n - merges
        i = further = 0
        while i < n:
            if end[i] == i + 1 and seg[i] not in self.single:
                further += len(seg[i].encode()) - 1
            i = end[i]
        return n - merges + further

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.cut_marks:
            return self.count_segment(marked)
        lines = marked.split("\n") if self.cut_lines else [marked]
        total = (len(lines) - 1) * self.plain["\n"]
        for line in lines:
            first, *rest = line.split(MARK)
            total += self.plain[first] if first else 0
            if "" in rest:  # a run of marks goes with what follows it
                run = 0
                for part in rest:
                    if part:
                        total += self.count_segment(MARK * (run + 1) + part) if run else self.after_mark[part]
                        run = 0
                    else:
                        run += 1
                total += self.count_segment(MARK * run)
            else:
                total += sum(map(self.after_mark.__getitem__, rest))
        return total


@lru_cache(maxsize=1)
def _counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def token_count(text: Column, model_file: str) -> Column:
    """The number of tokens of a string column."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        only("token_counts", _counter.cache_clear)
        counter = _counter(model_file)
        return pd.Series([counter.count(t or "") for t in texts], dtype="int64")

    return count(text)


def with_token_counts(docs: DataFrame, model_file: str, text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; columns of those names are replaced."""
    bounded_batches(docs.sparkSession)
    return docs.withColumns({"n_bytes": F.octet_length(text_or_empty(text)).cast("long"), "n_tokens": token_count(text_or_empty(text), model_file)}).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")

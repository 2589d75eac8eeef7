"""Operator 6: benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items are put into one suffix automaton, each item starting again at
the root. A document's words stream through it; at each word the automaton tells the length of
the longest suffix that occurs in some item. Where that reaches the window (10 words, or the
whole of a shorter item), the words of that match are hit and the items behind the matching
state are recorded. Documents lose their hit spans, or go altogether when hits cover more than
a share of them.

A worker holds one automaton at a time. Its size is held: items are dealt into shards of at most
SHARD_WORDS words by running totals (some 60 bytes a word in a worker). With one shard its
automaton is built once and stays. With several, a worker takes CHUNK bytes of documents, leads
them through one shard after the other and builds each shard's automaton anew for each chunk, so
neither memory nor the query's plan grows with the number of shards. One item longer than a shard
makes one of its own, since an item is one value of its table. Items are read shard by shard
through the driver, never all at once.

Defined results: null and wordless texts have no words and no hits; wordless items match
nothing; items with equal words are each reported. Repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, free_name, only, read_table, text_or_empty, written

WINDOW = 10
COVERAGE = 0.5
SHARD_WORDS = 2_000_000
#: Bytes of documents that a worker leads through all shards, where there are several.
CHUNK = 32 << 20
#: Fixed value: a word, in UTF-8 after A-Z became lower case.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class ItemAutomaton:
    """The suffix automaton of many items' words, with the items behind each window.

    Most states have one way on, so that is kept in two flat arrays; only states with more have a dict.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.word, self.next = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        cut = [(item, array("i", [self.ids.setdefault(w, len(self.ids)) for w in words])) for item, text in items if (words := words_of(text))]
        for _, ids in cut:
            last = 0
            for i in ids:
                last = self._add(last, i)
        self.shortest = min((min(len(ids), window) for _, ids in cut), default=0)
        #: Of the state that holds a window (the one where link is shorter): its first item; further ones, and shorter items by length.
        self.names = [item for item, _ in cut]
        self.owner = array("i", [-1]) * len(self.link)
        self.others: dict[int, dict[int, set[int]]] = {}
        for number, (_, ids) in enumerate(cut):
            n = min(len(ids), window)
            for state, _, end in self._walk(ids):
                if end + 1 >= n:
                    state = self._holding(state, n)
                    if n == window and self.owner[state] < 0:
                        self.owner[state] = number
                    elif n < window or self.owner[state] != number:
                        self.others.setdefault(state, {}).setdefault(n, set()).add(number)
        self.above = array("i", [0]) * len(self.link)  # the nearest state from here up the links that holds windows, or 0
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.above[state] = state if self.owner[state] >= 0 or state in self.others else self.above[self.link[state]]

    def _to(self, state: int, word: int) -> int:
        """The state after word, or 0 (no way leads to the root)."""
        if self.word[state] == word:
            return self.next[state]
        return self.more[state].get(word, 0) if state in self.more else 0

    def _set(self, state: int, word: int, there: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.next[state] = word, there
        else:
            self.more.setdefault(state, {})[word] = there

    def _state(self, link: int, length: int) -> int:
        for values, value in ((self.word, -1), (self.next, 0), (self.link, link), (self.length, length)):
            values.append(value)
        return len(self.link) - 1

    def _add(self, last: int, word: int) -> int:
        link, length = self.link, self.length
        if there := self._to(last, word):
            return there if length[there] == length[last] + 1 else self._clone(last, word, there)
        new = self._state(0, length[last] + 1)
        at = last
        while at >= 0 and not self._to(at, word):
            self._set(at, word, new)
            at = link[at]
        if at >= 0:
            there = self._to(at, word)
            link[new] = there if length[there] == length[at] + 1 else self._clone(at, word, there)
        return new

    def _clone(self, at: int, word: int, there: int) -> int:
        """Splits there at the strings that come by way of at, and gives the new state."""
        new = self._state(self.link[there], self.length[at] + 1)
        self.word[new], self.next[new] = self.word[there], self.next[there]
        if there in self.more:
            self.more[new] = dict(self.more[there])
        self.link[there] = new
        while at >= 0 and self._to(at, word) == there:
            self._set(at, word, new)
            at = self.link[at]
        return new

    def _holding(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _walk(self, ids: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """State, matched length and position, word by word."""
        word, nxt, more, link, length = self.word, self.next, self.more, self.link, self.length
        state = matched = 0
        for k, i in enumerate(ids):
            while True:
                if word[state] == i:
                    state, matched = nxt[state], matched + 1
                elif state in more and (there := more[state].get(i)):
                    state, matched = there, matched + 1
                elif state:
                    state = link[state]
                    matched = length[state]
                    continue
                break
            yield state, matched, k

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words (start, end), in order and apart, and the items found."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not self.ids or len(words) < self.shortest:
            return spans, found
        ids = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # runs of words that items have
            if b - a < self.shortest:
                continue
            for state, matched, k in self._walk(ids[a:b].tolist()):
                if matched < self.shortest:
                    continue
                at = self.above[state]
                longest = 0
                while at:
                    if self.owner[at] >= 0 and self.window <= matched:
                        found.add(self.names[self.owner[at]])
                        longest = self.window
                    for n, numbers in self.others.get(at, {}).items():
                        if n <= matched:
                            found.update(map(self.names.__getitem__, numbers))
                            longest = max(longest, n)
                    at = self.above[self.link[at]]
                if longest:
                    start, end = a + k + 1 - longest, a + k + 1
                    if spans and start <= spans[-1][1]:
                        while spans and start <= spans[-1][1]:
                            start = min(start, spans.pop()[0])
                    spans.append((start, end))
        return spans, found


def _shards(items: DataFrame, item_id: str, text: str, shard_words: int) -> list[DataFrame]:
    size = F.length(text_or_empty(text)) / 2 + 1  # no text has more words than this
    numbered = items.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text")).withColumn("size", size)
    total = numbered.agg(F.sum("size")).first()[0] or 0
    if total <= shard_words:
        return [numbered]
    by_hash = numbered.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(256)))
    before = Window.partitionBy("part").orderBy("item", "text")
    parts = by_hash.groupBy("part").agg(F.sum("size").alias("whole"))
    starts = parts.withColumn("start", F.sum("whole").over(Window.orderBy("part")) - F.col("whole"))  # 256 rows
    dealt = by_hash.join(starts, "part").withColumn("shard", F.floor((F.col("start") + F.sum("size").over(before)) / shard_words))
    dealt = written(dealt.select("item", "text", "shard"), "item-shards")
    numbers = sorted(r[0] for r in dealt.select("shard").distinct().collect())
    return [dealt.where(F.col("shard") == n) for n in numbers]


#: The automaton that this worker used last, by its shard and window.
_built: dict[tuple[str, int], ItemAutomaton] = {}


def _automaton(shard: str, rows, window: int) -> ItemAutomaton:
    """The automaton of a shard's rows (a broadcast), which takes the place of another's. Its rows go again."""
    if (shard, window) not in _built:
        _built.clear()
        _built[shard, window] = ItemAutomaton(rows.value, window)
        rows.__dict__.pop("_value", None)
    return _built[shard, window]


def _places(body: str | None, spans: list[tuple[int, int]]) -> list[int]:
    """Where spans of words begin and end in the text, in turn, in code points."""
    if not spans:
        return []
    raw = body.encode()
    words = [m.span() for m in WORD.finditer(raw.lower())]
    out, at, passed = [], 0, 0
    for edge in (e for start, end in spans for e in (words[start][0], words[end - 1][1])):
        passed += len(raw[at:edge].decode())
        at = edge
        out.append(passed)
    return out


def _scan(shards: dict, window: int, chunk: int):
    """A column function that gives the hits of all shards (broadcasts of their rows, by name)."""

    def judged(texts: list[str | None]) -> pd.DataFrame:
        spans: list[list] = [[] for _ in texts]
        found: list[set] = [set() for _ in texts]
        sizes = [0] * len(texts)
        for shard, rows in shards.items():
            automaton = _automaton(shard, rows, window)
            for k, body in enumerate(texts):
                words = words_of(body)
                new_spans, new_found = automaton.scan(words)
                sizes[k] = len(words)
                spans[k] = merged([*spans[k], *new_spans]) if spans[k] else new_spans
                found[k].update(map(str, new_found))
        rows = [(n, [e for span in own for e in span], _places(body, own), sorted(items)) for n, own, body, items in zip(sizes, spans, texts, found, strict=True)]
        return pd.DataFrame(rows, columns=["n_words", "edges", "cuts", "found"])

    @F.pandas_udf("n_words long, edges array<long>, cuts array<long>, found array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held: list[list] = []
        size = 0
        for texts in batches:
            only("decontamination", _built.clear)
            held.append(texts.tolist())
            size += sum(len(t) for t in held[-1] if t)
            if len(shards) == 1 or size >= chunk:
                yield judged([t for part in held for t in part])
                held, size = [], 0
        if held:
            yield judged([t for part in held for t in part])

    return scan


def hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Column:
    """A column of docs: n_words, edges (starts and ends of the spans of words that are hit, in turn), cuts (the same in code points) and found (item ids as strings)."""
    bounded_batches(docs.sparkSession)
    shards = {uuid.uuid4().hex: docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in shard.select("item", "text").toLocalIterator()]) for shard in _shards(items, item_id, item_text, shard_words)}
    return _scan(shards, window, CHUNK)(F.col(text).cast("string"))


def spans_of(edges: Column) -> Column:
    """Starts and ends in turn as an array of structs."""
    spans = F.transform(F.sequence(F.lit(1), F.size(edges) - 1, F.lit(2)), lambda k: F.struct(F.element_at(edges, k).alias("start"), F.element_at(edges, k + 1).alias("end")))
    return F.when(F.size(edges) > 0, spans).otherwise(F.array().cast("array<struct<start:long,end:long>>"))


def with_hits(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs with n_words, hit_spans (of words, end exclusive) and found (item ids as strings); such columns are replaced."""
    own = free_name(docs, "made")
    made = {"n_words": F.col(f"{own}.n_words"), "hit_spans": spans_of(F.col(f"{own}.edges")), "found": F.col(f"{own}.found")}
    return docs.withColumn(own, hits(docs, items, **options)).withColumns(made).drop(own)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hit_count(spans: str = "hit_spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", coverage: float = COVERAGE, **options) -> DataFrame:
    """docs without hit spans; those covered beyond coverage go. All other columns of docs stay as they are, whatever their names."""
    own = free_name(docs, "made")
    judged = docs.withColumn(own, hits(docs, items, text=text, **options))

    edges, cuts = F.col(f"{own}.edges"), F.col(f"{own}.cuts")
    n_hit = F.aggregate(F.transform(edges, lambda e, k: F.when(k % 2 == 1, e).otherwise(-e)), F.lit(0).cast("long"), lambda n, e: n + e)
    kept = judged.where(n_hit <= F.lit(coverage) * F.col(f"{own}.n_words"))
    # What stands between the spans: from an end (or the start) to the next start (or the end).
    bounds = F.concat(F.array(F.lit(0).cast("long")), cuts, F.array(F.length(text).cast("long")))
    piece = lambda k: F.substr(F.col(text), (F.element_at(bounds, k) + 1).cast("int"), (F.element_at(bounds, k + 1) - F.element_at(bounds, k)).cast("int"))
    cut = F.array_join(F.transform(F.sequence(F.lit(1), F.size(bounds) - 1, F.lit(2)), piece), "")
    return kept.withColumn(text, F.when(F.size(edges) == 0, F.col(text)).otherwise(cut)).drop(own)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = with_hits(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return judged.select(
        "doc_id", "n_words", hit_count().alias("n_hit"), F.size("found").cast("long").alias("n_items"),
        F.sha2(F.array_join("found", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )


#: The same rows by joins on windows. Items shorter than ten words make one window of their own length.
OP6_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT d.doc_id, d.n, d.i, w.item_id FROM dwin d JOIN win w ON d.n = w.n AND d.win = w.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

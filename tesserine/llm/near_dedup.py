"""Operator 1: near-duplicate classes by Order MinHash and banded alignment.

Two texts are near-duplicates when an alignment of their words (lower case, cut at white space)
needs at most 20 edits for 100 words of the longer text: edit similarity of 0.8 or more.

Sketches. The five-word shingles of a text carry their occurrence number, so a repeated shingle
counts as often as it comes. Each of SKETCHES hash functions picks the two smallest; the pair,
kept in text order, is one sketch. Two texts share a sketch with about the square of the
similarity of their labelled shingles, and only when the two stand in the same order. A band is
two sketches; texts that share a band are candidates.

Links. Equal texts (by SHA-256) are one text from the start, so groups of copies take one row
each. In a band bucket every text is a candidate of the bucket's first text only, which keeps
pairs in proportion to rows: each text is aligned with the first text that it meets in most
buckets, then, where that leaves it in another component, with the others. What a bucket may still
hide are links between different components of it, so the texts of all buckets with several
components are compared once more, whatever sketches they share and however many there are. An
edit changes two pairs of neighbouring words at most, so similar texts of n words have about
0.6 n such pairs (grams) in common, and in any fixed order of grams they share one among the first
of each (first_grams). The order puts grams of few texts first, which moves passages that many
texts share to the end. A gram whose texts all have one other gram in common is left out, as that
brings them together. The texts of a gram make up a cell; a gram of many texts makes a cell of each
two blocks of them. A task compares the texts of a cell, those of one component never, those that
lengths or bags of words (kept as bits) rule out never, and a few of each two components at a
time, since one link is enough; it gives links, not pairs. So every similar pair of these texts is
aligned or is in one class already.

Alignment is exact within a band of diagonals as wide as the allowed edits, tried with a narrow
band first; many pairs of like length are worked through at once, and very wide bands one by one.

What is missed: similar texts that share no band. With shingle similarity J about the share
(1 - J**4) ** 64 of such pairs is missed: none at 0.6 or more, 2 in 100 at 0.5, 19 in 100 at 0.4.
Scattered edits of 5, 8 and 10 words in 100 leave J near 0.63, 0.49 and 0.42.

Defined results: null texts and texts without words are alone in their classes. A text under
five words has one shingle, all its words. Rows are judged by their texts, not identifiers:
rows that repeat a doc_id with other texts have the class of their own text, and exact repeats
are copies. class_id is the least doc_id of the class that is not null. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import join_spread
from .common import Scratch, bounded_batches, free_name, only, read_table, trimmed, written

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 32
STRIDES = (1, 5)  # a band joins a sketch with the one so many places on
BLOCK = 250  # texts of a block; a cell has one or two blocks
COUNTED = 1 << 20  # counters of grams, by hash
MOST_BITS = 1 << 17  # of a bag of words
WORDS_AT_ONCE = 100_000
NARROW = 32  # edits that the first band allows
CELLS_AT_ONCE = 1 << 19  # table entries that pairs aligned together have in a row of their bands
WIDE = 1024  # half width from which a band is worked through for a pair alone
FAR = 16_000
LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _seeds(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def labelled_shingles(words: np.ndarray, sizes: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled shingles of texts laid end to end, and how many each text has."""
    counts = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    starts = np.cumsum(sizes) - sizes
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    at = np.arange(total) - np.repeat(first, counts) + np.repeat(starts, counts)
    room = np.repeat(np.minimum(sizes, shingle), counts)
    value = np.zeros(total, np.uint64)
    for k in range(shingle):
        inside = k < room
        word = words[np.minimum(at + k, len(words) - 1)]
        value = np.where(inside, _mixed(value * np.uint64(31) + word + np.uint64(k + 1)), value)
    text = np.repeat(np.arange(len(sizes)), counts)
    order = np.lexsort((np.arange(total), value, text))
    same = np.zeros(total, bool)
    same[1:] = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
    runs = np.arange(total)
    number = np.zeros(total, np.uint64)
    number[order] = (runs - np.maximum.accumulate(np.where(same, 0, runs))).astype(np.uint64)
    return np.where(number > 0, _mixed(value + number * np.uint64(0x9E3779B97F4A7C15)), value), counts


def sketches(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SKETCHES values for each text; every text has at least one word."""
    value, counts = labelled_shingles(words, sizes)
    starts = np.cumsum(counts) - counts
    here = np.arange(len(value))
    out = np.empty((len(sizes), SKETCHES), np.uint64)
    for j, seed in enumerate(_seeds(SKETCHES)):
        h = (value ^ seed) * (seed << np.uint64(1) | np.uint64(1))
        h ^= h >> np.uint64(29)
        found = []
        for _ in range(2):
            least = np.minimum.reduceat(h, starts)
            at = np.minimum.reduceat(np.where(h == np.repeat(least, counts), here, len(here)), starts)
            found.append((least, at))
            h[at] = LARGEST
        (a, at_a), (b, at_b) = found
        lone = counts == 1
        swap = (at_a > at_b) & ~lone
        x, y = np.where(swap, b, a), np.where(swap, a, np.where(lone, a, b))
        out[:, j] = _mixed(x * np.uint64(3) + _mixed(y + seed))
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with some WORDS_AT_ONCE words (hashes): the part, its words end to end, how many each row has."""
    lists = batch.column("words")
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + WORDS_AT_ONCE, "right")) - 1)
        end = min(end, len(batch))
        yield batch.slice(start, end - start), flat[offsets[start] : offsets[end]], np.diff(offsets[start : end + 1]).astype(np.int64)
        start = end


def _lists(values: np.ndarray) -> pa.Array:
    """A list for each row of a matrix."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.view(np.int64).ravel()))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc_id, sha, words (hashes) to rows doc_id, sha, n_words, sketches (null without words)."""
    only("near_dedup")
    for batch in batches:
        for part, words, sizes in _slices(batch):
            has = np.flatnonzero(sizes)
            found = _lists(sketches(words, sizes[has])) if len(has) else pa.array([], pa.list_(pa.int64()))
            place = np.full(len(sizes), -1)
            place[has] = np.arange(len(has))
            columns = [part.column("doc_id"), part.column("sha"), pa.array(sizes.astype(np.int32)), found.take(pa.array(place, mask=place < 0))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "n_words", "sketches"])
    trimmed()


def edits_within(a: np.ndarray, b: np.ndarray, most: int, known: int = 0) -> int | None:
    """The edit distance of two arrays if it is at most most. It is known to be known or more."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    if not len(b):
        return len(a)
    narrow = max(len(a) - len(b), 2 * known, 32)
    if narrow < most and (found := _banded(a, b, narrow)) is not None:
        return found
    return _banded(a, b, most)


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """As edits_within, over diagonals -most..most only, a column of the band as the bits of two numbers. a is not shorter than b.

    A bit of up (down) says that the table grows (falls) by one from the row above; the band's
    lowest row runs along its diagonal and then along the last row, where the distance is read off.
    """
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    most = min(most, len(a))
    width = 2 * most + 2
    full, lowest = (1 << width) - 1, width - 1
    up, down = full ^ ((1 << width - most - 1) - 1), 0
    distance, turn = most, len(a) - most
    bound = most + len(b) - turn  # along the last row it can still fall by one a word
    for j, word in enumerate(b.tolist()):
        at = places.get(word, 0)
        first = j - most - 1  # the row of a that bit 0 stands for
        at = (at >> first if first >= 0 else at << -first) & full
        same = (((at & up) + up) ^ up) | at | down
        grows, falls = (down | full ^ (full & (same | up))), same & up
        if j < turn:
            distance += not same >> lowest & 1
        else:
            row = lowest - 1 - (j - turn)
            distance += (grows >> row & 1) - (falls >> row & 1)
        if distance > bound:
            return None
        above = (same & full) >> 1
        up, down = falls & full | full ^ (above | grows & full), above & grows
    return distance if distance <= most else None


def _most(n: np.ndarray, least: float) -> np.ndarray:
    """The edits that similar texts may differ by, the longer having n words."""
    return np.floor((1 - least) * n + 1e-9).astype(np.int64)


def _distances(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """The edit distance of each a and b where it is at most most, else a larger number. Bands of all pairs are filled side by side."""
    rows, columns = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    height, width = int(rows.max()), 2 * most + 1
    kind = np.int16 if height < FAR else np.int32
    first, second = np.full((len(a), height), -1, np.int32), np.full((len(b), height + width), -2, np.int32)  # second has room for the band on both sides
    for k, (x, y) in enumerate(zip(a, b)):
        first[k, : len(x)] = x
        second[k, most : most + len(y)] = y
    first, second = np.ascontiguousarray(first.T), np.ascontiguousarray(second.T)
    steps = np.arange(width, dtype=kind)[:, None]
    row = np.repeat(np.where(steps >= most, steps - most, kind(FAR)), len(a), 1)  # place d stands for column i + d - most
    out = np.full(len(a), FAR, np.int64)
    ends = {int(i): np.flatnonzero(rows == i) for i in np.unique(rows)}
    for i in range(height + 1):
        if i:
            fresh = row + (second[i - 1 : i - 1 + width] != first[i - 1])
            np.minimum(fresh[:-1], row[1:] + kind(1), out=fresh[:-1])
            if i <= most:
                fresh[: most - i] = FAR
                fresh[most - i] = i
            fresh -= steps
            np.minimum.accumulate(fresh, axis=0, out=fresh)
            fresh += steps
            row = fresh
        if i in ends:
            k = ends[i]
            out[k] = row[columns[k] - rows[k] + most, k]
    return out


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """Is the edit similarity of each two arrays of words (numbers) at least least?"""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    most = _most(np.maximum(n, m), least)
    good = np.zeros(len(left), bool)
    todo = np.flatnonzero(np.abs(n - m) <= most)
    for band in (NARROW, None):
        width = np.minimum(most, band) if band else most
        here = todo[(np.abs(n - m)[todo] <= width[todo]) & (band is None or n[todo] < FAR)]
        here = here[np.lexsort((n[here], width[here]))]
        while len(here):
            if width[here[-1]] >= WIDE:  # the widest bands, one by one
                k, here = here[-1], here[:-1]
                good[k] = edits_within(left[k], right[k], int(most[k])) is not None
                continue
            # From the longest on, pairs of at least half the length and band.
            last = here[-1]
            alike = (2 * n[here] >= n[last] - 8) & (2 * width[here] >= width[last] - 8)
            batch = here[alike][-max(1, CELLS_AT_ONCE // (2 * int(width[last]) + 1)) :]
            here = np.setdiff1d(here, batch, assume_unique=True)
            here = here[np.lexsort((n[here], width[here]))]
            good[batch] = _distances([left[k] for k in batch], [right[k] for k in batch], int(width[batch].max())) <= most[batch]
        todo = todo[~good[todo] & (most[todo] > NARROW)]
    return good


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    return bool(similar_pairs([a], [b], least)[0])


def gram_places(n: np.ndarray, least: float) -> np.ndarray:
    """How many of its first grams a text of n words must show so that it shares one with every similar text."""
    spare = 2 * (1 - least)
    if spare >= 1:
        raise ValueError("similarity must be above 0.5")
    # A text of m words keeps m - 1 - 2 * edits grams; the least of that over all m from n on, by its slope.
    keeps = lambda m: m - 1 - 2 * np.floor((1 - least) * m + 1e-9)
    fewest = np.min([keeps(n + k) for k in range(int(np.ceil(2 / (1 - spare))) + 2)], axis=0)
    grams = np.where(n >= 2, n - 1, np.minimum(n, 1))
    return np.clip(grams - fewest + 1, 0, grams).astype(np.int64)


def first_grams(words: np.ndarray, sizes: np.ndarray, texts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbouring words (labelled by occurrence) of which similar texts share one, and the text of each.

    texts has, for each hash, the number of grams that have it; rare grams come first.
    """
    value, counts = labelled_shingles(words, sizes, 2)
    text = np.repeat(np.arange(len(sizes)), counts)
    order = np.lexsort((value, texts[value & np.uint64(COUNTED - 1)], text))
    place = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)
    kept = order[place < np.repeat(gram_places(sizes, least), counts)]
    return value[kept], text[kept]


def bags(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The words of each text (labelled by occurrence) as bits, eight or more times as many as the longest has words (up to MOST_BITS)."""
    value, _ = labelled_shingles(words, sizes, 1)
    longs = 1 << int(np.ceil(np.log2(min(MOST_BITS, 8 * max(8, int(sizes.max()))) / 64)))
    text = np.repeat(np.arange(len(sizes)), sizes)
    bits = np.zeros((len(sizes), longs), np.uint64)
    np.bitwise_or.at(bits, (text, (value >> np.uint64(6)) % np.uint64(longs)), np.uint64(1) << (value & np.uint64(63)))
    return bits


def lacking(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits of each x its y lacks. A bit stands for a word, at least, that an edit takes away."""
    step = max(1, (1 << 20) // bits.shape[1])
    return np.concatenate([np.bitwise_count(bits[x[k : k + step]] & ~bits[y[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def words_of(text: Column) -> Column:
    """Words: lower case, cut at white space of any kind."""
    return F.filter(F.split(F.lower(text), r"[\s\p{Z}\x85]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _numbered(bodies: list[str]) -> list[np.ndarray]:
    """The words of texts (joined by a space) as numbers."""
    number: dict[str, int] = {}
    return [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)) for words in (t.split(" ") for t in bodies)]


def _verified(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of a written table whose texts (id, body) are similar. A text may be a in any number of pairs, and b in few."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _numbered([*batch.column("left").to_pylist(), *batch.column("right").to_pylist()])
            good = similar_pairs(numbers[: len(batch)], numbers[len(batch) :], least)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        trimmed()

    side = lambda end, name: bodies.select(F.col("id").alias(end), F.col("body").alias(name))
    total = pairs.count()
    left = join_spread(pairs, pairs.groupBy("a").agg(F.count("*").alias("n")).join(side("a", "left"), "a"), "a", "b", total)
    # Aligning costs far more than its bytes show, so few tasks would be made of them.
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return left.repartition(min(tasks, 1 + total // 16), "b").join(side("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (its smallest id) of each end of edges (a, b).

    Each end points to its smallest neighbour, pointers are followed to their ends, and edges are
    drawn between these ends, which at least halves the number of vertices each time.
    """
    left = scratch.written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    whole = None
    while True:
        both = left.select(F.col("a").alias("id"), "b").unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("b")))
        to = scratch.written(both.groupBy("id").agg(F.least(F.min("b"), F.col("id")).alias("to"), F.count("*").alias("degree")), "to")
        total = to.count()
        while True:
            ends = to.groupBy("to").agg(F.count("*").alias("n")).join(to.select(F.col("id").alias("to"), F.col("to").alias("next")), "to")
            fresh = scratch.written(join_spread(to, ends, "to", "id", total).select("id", "degree", F.col("to").alias("old"), F.col("next").alias("to")), "to")
            to = fresh.drop("old")
            if fresh.where('old <> "to"'.replace('"', "`")).isEmpty():
                break
        whole = to.select("id", F.col("to").alias("component")) if whole is None else scratch.written(_renamed(whole, to.select("id", "to")), "labels")
        n_edges = 2 * left.count()
        for end in ("a", "b"):
            left = join_spread(left, to.select(F.col("id").alias(end), F.col("to").alias(f"c_{end}"), F.col("degree").alias("n")), end, "b" if end == "a" else "a", n_edges)
        left = scratch.written(left.where("c_a <> c_b").select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return whole


def _renamed(labels: DataFrame, names: DataFrame) -> DataFrame:
    """labels (id, component) with components renamed as names (id, to) says."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).join(names.select(F.col("id").alias("component"), "to"), "component", "left")
    return join_spread(labels, sizes, "component", "id", labels.count()).select("id", F.coalesce("to", "component").alias("component"))


def _bands(texts: DataFrame) -> DataFrame:
    """A row per text and band: key, id, n_words."""
    bands = [F.xxhash64(F.lit(s), F.lit(j), F.element_at("sketches", j + 1), F.element_at("sketches", (j + s) % SKETCHES + 1)) for s in STRIDES for j in range(SKETCHES)]
    return texts.select("id", "n_words", F.explode(F.array(*bands)).alias("key"))


def _near_length(a: str, b: str, least: float) -> Column:
    """May two texts of so many words be similar?"""
    longer = F.greatest(F.col(a), F.col(b))
    return longer - F.least(F.col(a), F.col(b)) <= F.floor(F.lit(1 - least) * longer + 1e-9)


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _open_keys(named: DataFrame) -> DataFrame:
    """Keys with texts of several components: key, n."""
    return named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")


def _relabelled(labels: DataFrame, new: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after some more links (a, b): only the components that these join are worked out again."""
    if new.isEmpty():
        return labels
    ends = new.select(F.col("a").alias("id")).unionByName(new.select(F.col("b").alias("id"))).distinct()
    whole = scratch.written(labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))), "labels")
    of = lambda end: whole.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    joins = new.join(of("a"), "a").join(of("b"), "b").where("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    joins = scratch.written(joins.distinct(), "joins")
    return whole if joins.isEmpty() else scratch.written(_renamed(whole, components(joins, scratch).withColumnRenamed("component", "to")), "labels")


def _per_place(texts: DataFrame, of_slice: Callable, start: Callable[[], list[np.ndarray]], *how: Column) -> list[np.ndarray]:
    """Arrays of COUNTED numbers that of_slice(arrays, component of each text, words, sizes) fills in each task, put together by how (columns c0, c1, ...)."""
    names = [f"c{k}" for k in range(len(how))]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, untouched = start(), start()
        for batch in batches:
            for part, words, sizes in _slices(batch):
                of_slice(arrays, part.column("component").to_numpy(), words, sizes)
        place = np.flatnonzero(arrays[0] != untouched[0])
        yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(v[place]) for v in arrays)], ["place", *names])

    schema = ", ".join(["place long", *(f"{n} long" for n in names)])
    found = texts.mapInArrow(fill, schema).groupBy("place").agg(*how).toArrow()  # at most COUNTED rows of a few numbers
    out, place = start(), found.column("place").to_numpy()
    for array, name in zip(out, names):
        array[place] = found.column(name).to_numpy()
    return out


def _by_first_grams(texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Rows (key, id) of the first grams of texts (id, component, words).

    Left out, as far as the grams' places in the counters show it, are grams that texts of one
    component alone have, and those all of whose texts have one other such gram in common: that one
    brings them together.
    """
    place, edges = np.uint64(COUNTED - 1), np.iinfo(np.int64)
    context = texts.sparkSession.sparkContext
    numbers, lows, highs = (lambda v: lambda: np.full(COUNTED, v))(0), lambda: np.full(COUNTED, edges.max), lambda: np.full(COUNTED, edges.min)

    def add(arrays: list[np.ndarray], _: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> None:
        arrays[0] += np.bincount(labelled_shingles(words, sizes, 2)[0] & place, minlength=COUNTED)

    (counts,) = _per_place(texts, add, lambda: [numbers()], F.sum("c0").alias("c0"))
    sent = context.broadcast(counts)

    def meet(arrays: list[np.ndarray], component: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> None:
        key, text = first_grams(words, sizes, sent.value, least)
        arrays[0] += np.bincount(key & place, minlength=COUNTED)
        np.minimum.at(arrays[1], key & place, component[text])
        np.maximum.at(arrays[2], key & place, component[text])

    shown, low, high = _per_place(texts, meet, lambda: [numbers(), lows(), highs()], F.sum("c0").alias("c0"), F.min("c1").alias("c1"), F.max("c2").alias("c2"))
    met = context.broadcast(np.where(low < high, shown, 0))  # how many texts show a gram, if they are of several components

    def tops(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first grams that several components show, the text of each, and for each that of its text which most texts show."""
        key, text = first_grams(words, sizes, sent.value, least)
        n = met.value[key & place]
        key, text, n = key[n > 0], text[n > 0], n[n > 0]
        order = np.lexsort((key, n, text))
        key, text = key[order], text[order]
        last = np.searchsorted(text, np.arange(len(sizes)), "right") - 1
        return key, text, key[last[text]].view(np.int64)

    def bounds(arrays: list[np.ndarray], _: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> None:
        key, _, top = tops(words, sizes)
        np.minimum.at(arrays[0], key & place, top)
        np.maximum.at(arrays[1], key & place, top)

    spread = context.broadcast(_per_place(texts, bounds, lambda: [lows(), highs()], F.min("c0").alias("c0"), F.max("c1").alias("c1")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words, sizes in _slices(batch):
                key, text, top = tops(words, sizes)
                low, high = spread.value
                stays = (low[key & place] != high[key & place]) | (key.view(np.int64) == top)
                yield pa.RecordBatch.from_arrays([pa.array(key[stays].view(np.int64)), part.column("id").take(pa.array(text[stays]))], ["key", "id"])

    grams = scratch.written(texts.mapInArrow(cut, "key long, id long"), "grams")
    for shared in (sent, met, spread):
        shared.destroy()
    return grams


def _without_covered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (key, id, n: the key's number of ids) without keys all of whose ids have one other key in common that stays.

    An id's largest key, and of those left its second largest, is looked at: where it is the same
    for all ids of a key, that key brings them together already.
    """
    for place in (1, 2):
        top = rows.groupBy("id").agg(F.max_by("key", F.struct("n", "key")).alias("top"))
        if place == 2:
            below = rows.join(top, "id").where("key <> top")
            top = below.groupBy("id").agg(F.max_by("key", F.struct("n", "key")).alias("top"))
        seen = rows.join(top, "id", "left")
        spared = seen.groupBy("key").agg(F.min("top").alias("low"), F.max("top").alias("high"), F.count("top").alias("known"), F.count("*").alias("n"))
        kept = spared.where("known < n OR low < high OR low = key").select("key", "n")
        rows = scratch.written(join_spread(rows.drop("n"), kept.withColumn("size", F.col("n")), "key", "id", rows.count()).withColumnRenamed("size", "n"), "keys")
    return rows


def _cell_links(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join different components, found among the texts (id, component, body) of each key of rows (key, id, n).

    Keys of few texts share cells. Two texts with several keys in common are compared in one cell only, that of the least.
    """
    total = rows.count()
    many = F.col("n") > BLOCK
    blocks = F.when(many, F.ceil(F.col("n") / BLOCK)).otherwise(1)
    own = F.pmod(F.xxhash64("id"), blocks)
    cell = F.when(many, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(1 + total // (2 * BLOCK))))
    placed = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)), "cell": cell, "many": many})
    placed = placed.select("id", "key", "cell", "many", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    where = ["cell", "many", "i", "j"]
    met = placed.groupBy("id", *where).agg(F.collect_list("key").alias("here"), F.max("second").alias("second"))
    keys = rows.groupBy("id").agg(F.collect_list("key").alias("keys"))

    def check(table: pa.Table) -> pa.Table:
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        second = table.column("second").to_numpy() if table.column("i")[0] != table.column("j")[0] else None
        numbers = _numbered(table.column("body").to_pylist())
        x, y = _candidates(numbers, component, table.column("here").to_pylist(), [frozenset(k) for k in table.column("keys").to_pylist()], second, least)
        found = _spanning(numbers, component, x, y, least)
        return pa.table({"a": ids[[i for i, _ in found]], "b": ids[[j for _, j in found]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    spark = rows.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    full = met.join(texts.join(keys, "id"), "id").repartition(tasks, *where)
    return full.groupBy(*where).applyInArrow(check, "a long, b long")


def _candidates(numbers: list[np.ndarray], component: np.ndarray, here: list[list[int]], keys: list[frozenset], second: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of different components that have a key of this cell as their least one in common, and whose lengths and bags allow similarity.

    With second, only pairs of a text of the first block and one of the second.
    """
    sizes = np.array([len(x) for x in numbers], np.int64)
    bits = bags(np.concatenate(numbers).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), sizes)
    members: dict[int, list[int]] = {}
    for place, mine in enumerate(here):
        for k in mine:
            members.setdefault(k, []).append(place)
    xs, ys = [], []
    for k, places in members.items():
        at = np.array(places)
        if second is None:
            i, j = np.triu_indices(len(at), 1)
        else:
            i, j = (v.ravel() for v in np.meshgrid(np.flatnonzero(~second[at]), np.flatnonzero(second[at])))
        x, y = at[i], at[j]
        longer = np.maximum(sizes[x], sizes[y])
        spare = _most(longer, least)
        may = (component[x] != component[y]) & (longer - np.minimum(sizes[x], sizes[y]) <= spare)
        x, y, longer, spare = x[may], y[may], longer[may], spare[may]
        may = lacking(bits, x, y) <= sizes[x] - longer + spare
        x, y, longer, spare = x[may], y[may], longer[may], spare[may]
        may = lacking(bits, y, x) <= sizes[y] - longer + spare
        pairs = [(i, j) for i, j in zip(x[may].tolist(), y[may].tolist()) if min(keys[i] & keys[j]) == k]
        xs += [i for i, _ in pairs]
        ys += [j for _, j in pairs]
    return np.array(xs, np.int64), np.array(ys, np.int64)


def _spanning(numbers: list[np.ndarray], component: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Similar pairs of (x, y) that join all components which any of these pairs joins. Pairs of components already joined aren't aligned."""
    _, group = np.unique(component, return_inverse=True)
    out, share = [], 1
    while len(x):
        low, high = np.minimum(group[x], group[y]), np.maximum(group[x], group[y])
        order = np.lexsort((high, low))
        x, y, low, high = x[order], y[order], low[order], high[order]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        place = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        turn = place < share  # so many of each two components
        good = similar_pairs([numbers[i] for i in x[turn]], [numbers[j] for j in y[turn]], least)
        for i, j in zip(x[turn][good], y[turn][good]):
            if group[i] != group[j]:
                out.append((i, j))
                group[group == max(group[i], group[j])] = min(group[i], group[j])
        x, y = x[~turn], y[~turn]
        apart = group[x] != group[y]
        x, y, share = x[apart], y[apart], share * 4
    return out


def near_labels(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the rows (doc_id, sha, n_words), the texts with words (id, sha, doc_id, n) and the components (id, component) that verified links make."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("sha", F.sha2("text", 256))
    hashed = own.select("doc_id", "sha", word_hashes(F.col("text")).alias("words"))
    made = T.StructType([*hashed.drop("words").schema.fields, T.StructField("n_words", T.IntegerType()), T.StructField("sketches", T.ArrayType(T.LongType()))])
    rows = scratch.written(hashed.mapInArrow(_sketched, made), "sketches")
    texts = rows.where("n_words > 0").groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("sketches").alias("sketches"))
    texts = scratch.written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")

    # Band rows of keys that two texts have, with the key's first text.
    bands = _bands(texts)
    keys = bands.groupBy("key").agg(F.min("id").alias("leader"), F.min_by("n_words", "id").alias("leader_words"), F.count("*").alias("n")).where("n > 1")
    shared = scratch.written(join_spread(bands, scratch.written(keys, "keys"), "key", "id", texts.count() * len(STRIDES) * SKETCHES), "bands")
    wanted = scratch.written(texts.join(shared.select("id").distinct(), "id", "left_semi").select("id", "n", F.col("doc_id").alias("own"), F.col("sha").alias("own_sha")), "wanted")
    read = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("sha") == F.col("own_sha"))).select("id", "n", F.array_join(words_of(F.col("text")), " ").alias("body"))
    read = scratch.written(read, "bodies")
    repeated = scratch.written(read.where("n > 1").dropDuplicates(["id"]), "bodies")  # rows may repeat whole
    bodies = read.where("n = 1").unionByName(repeated).select("id", "body")

    led = shared.where((F.col("leader") < F.col("id")) & _near_length("leader_words", "n_words", least))
    led = scratch.written(led.groupBy("leader", "id").agg(F.count("*").alias("n")), "led")
    best = scratch.written(led.groupBy(F.col("id").alias("b")).agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("a")).select("a", "b"), "pairs")
    labels = components(scratch.written(_verified(best, bodies, least), "links"), scratch)
    others = led.select(F.col("leader").alias("a"), F.col("id").alias("b")).join(best, ["a", "b"], "left_anti")
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    apart = others.join(of("a"), "a", "left").join(of("b"), "b", "left").where("c_a IS NULL OR c_b IS NULL OR c_a <> c_b").select("a", "b")
    labels = _relabelled(labels, scratch.written(_verified(scratch.written(apart, "pairs"), bodies, least), "links"), scratch)

    named = scratch.written(_named(shared.select("key", "id"), labels), "named")
    open_keys = scratch.written(_open_keys(named), "open")
    if open_keys.isEmpty():
        return rows, texts, labels
    ids = scratch.written(join_spread(named, open_keys, "key", "id", named.count()).select("id").distinct(), "ids")
    few = scratch.written(_named(bodies.join(ids, "id", "left_semi"), labels), "bodies")
    hashed = few.repartition("id").select("id", "component", F.transform(F.split("body", " "), lambda w: F.xxhash64(w)).alias("words"))
    grams = _by_first_grams(hashed, least, scratch)
    each = scratch.written(_named(grams, labels), "grams")
    met = scratch.written(join_spread(each, _open_keys(each).withColumn("size", F.col("n")), "key", "id", each.count()).select("key", "id", F.col("size").alias("n")), "met")
    return rows, texts, _relabelled(labels, scratch.written(_cell_links(_without_covered(met, scratch), few, least), "links"), scratch)


def near_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A written table, a row per row: doc_id, sha (of its text), n_words, class_id, n_copies, and first (the SHA-256 of the class's text that stands for it)."""
    scratch = Scratch(docs.sparkSession, "near")
    rows, texts, labels = near_labels(docs, scratch, doc_id, text, least)
    of_class = texts.select("id", "sha", "doc_id").join(labels, "id")
    classes = of_class.groupBy("component").agg(F.min_by("sha", F.struct(F.col("doc_id").isNull(), "doc_id", "sha")).alias("first"), F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    linked = join_spread(labels, classes, "component", "id", labels.count()).select("id", "class_id", "first")
    named = texts.select("id", "sha", "n", F.col("doc_id").alias("own")).join(linked, "id", "left")
    named = named.select("sha", "n", F.col("n").alias("n_copies"), F.when(F.col("first").isNull(), F.col("own")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("first", "sha").alias("first"))
    with_words = join_spread(rows.where("n_words > 0").select("doc_id", "sha", "n_words"), named, "sha", "doc_id", rows.count())
    alone = rows.where("n_words = 0").select("doc_id", "sha", "n_words", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.col("sha").alias("first"))
    out = written(with_words.unionByName(alone), "near")
    scratch.drop()
    return out


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_copies (rows with the very same text) for each row."""
    return near_rows(docs, doc_id, text, least).select("doc_id", "class_id", "n_copies")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of each class, the least by doc_id, text digest and then the other columns; rows without words all stay.

    Columns must be of types that Spark can order.
    """
    found = near_rows(docs, doc_id, text, least)
    key, own, sha, n, row = (free_name(docs, name) for name in ("key", "own", "sha", "n_rows", "row"))
    kept = found.where("n_words > 0 AND sha = first").groupBy(F.col("sha").alias(sha)).agg(F.min("doc_id").alias(own), F.count("*").alias(n))
    keyed = docs.withColumn(key, F.sha2(F.col(text).cast("string"), 256))
    single = keyed.join(kept, F.col(key) == F.col(sha)).where(F.col(doc_id).eqNullSafe(F.col(own)))
    once = single.where(F.col(n) == 1).select(*docs.columns)
    repeated = single.where(F.col(n) > 1).groupBy(key).agg(F.min(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(row)).select(f"{row}.*")
    wordless = docs.where(F.col(text).isNull() | ~F.col(text).cast("string").rlike(r"[^\s\p{Z}\x85]"))
    return once.unionByName(repeated).unionByName(wordless)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

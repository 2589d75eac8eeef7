"""Near-duplicates, WARC, decontamination, URL filter, chat format and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tesserine.llm import chat_format, decontamination, near_dedup, queries, url_filter, warc
from tesserine.llm.common import Scratch, new_path, written


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    same_rows(queries.QUERIES[name](spark, sf_dir), duck, queries.ORACLE_SQL[name])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_banded_alignment_equals_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 25))]
        b = a[:] if rng.random() < 0.7 else [rng.randint(0, 5) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, len(b))
            if rng.random() < 0.5:
                b.insert(k, rng.randint(0, 5))
            elif b:
                del b[k - 1]
        most, x, y = rng.randint(0, 12), np.array(a, np.int32), np.array(b, np.int32)
        want = d if (d := edit_distance(a, b)) <= most else None
        assert near_dedup.edits_within(x, y, most) == want


@pytest.mark.parametrize("narrow, wide", [(32, 1024), (3, 6), (1, 0)])
def test_alignment_side_by_side_equals_brute_force(monkeypatch, narrow, wide):
    monkeypatch.setattr(near_dedup, "NARROW", narrow)
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    monkeypatch.setattr(near_dedup, "CELLS_AT_ONCE", 200)
    rng = random.Random(6)
    left, right = [], []
    for _ in range(600):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 70))]
        b = a[:] if rng.random() < 0.8 else [rng.randint(0, 5) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 16)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.randint(0, 5)] * rng.randint(0, 1)
        left.append(np.array(a, np.int32))
        right.append(np.array(b, np.int32))
    want = [edit_distance(x.tolist(), y.tolist()) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in zip(left, right)]
    assert near_dedup.similar_pairs(left, right).tolist() == want and 100 < sum(want) < 500


def prose(rng, n):
    return ["".join(rng.choice(["er", "in", "the", "on", "st", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(25):  # families of copies and near copies, up to six words in a hundred changed
        base = prose(rng, rng.randint(60, 160))
        for _ in range(rng.randint(1, 7)):
            words = base[:]
            for _ in range(rng.randint(0, len(words) // 16)):
                words[rng.randrange(len(words))] = "zz" + str(rng.randint(0, 999))
            texts += [" ".join(words)] * rng.randint(1, 3)
    passage = " ".join(prose(rng, 30))
    texts += [" ".join(prose(rng, 60)) + " " + passage for _ in range(20)]  # a passage that many share
    texts += [None, "", "", "  \n ", "one two", "one two", "One  TWO", "a b c d e f"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], "doc_id long, text string, key string, component string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    cut = [(t or "").lower().split() for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = cut[i], cut[j]
        most = int(0.2 * max(len(a), len(b)) + 1e-9)
        if a and b and sum((Counter(a) & Counter(b)).values()) >= max(len(a), len(b)) - most and edit_distance(a, b) <= most:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    want = {i: find(i) for i in range(len(texts))}
    assert all(want[i] == want[c] for i, c in got.items())  # no link that brute force lacks
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in cut]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if want[i] == want[j] and cut[i]]
    close = [(i, j) for i, j in pairs if len(shingles[i] & shingles[j]) >= 0.6 * len(shingles[i] | shingles[j])]
    assert len(close) > 100 and all(got[i] == got[j] for i, j in close)  # none lost where the shingles are close
    assert np.mean([got[i] == got[j] for i, j in pairs]) > 0.95
    assert near_dedup.near_classes(docs.where("doc_id < 0")).count() == 0
    again = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs.union(docs)).collect()}
    assert again == got


def test_crowded_bucket_loses_no_near_pair(spark, monkeypatch):
    """Near pairs that share no five-word shingle but those of a passage that far more texts share; also in small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    shared = prose(rng, 47)
    own = [[f"w{rng.randrange(10**9)}" for _ in range(13)] for _ in range(60)]
    changed = [[f"c{i}x{k}" if k % 4 == 0 else w for k, w in enumerate(words)] for i, words in enumerate(own[:30])]
    docs = spark.createDataFrame([(i, " ".join(shared + words)) for i, words in enumerate(own + changed)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert got == {i: i - 60 if i >= 60 else i for i in range(90)}


def test_two_families_that_share_a_passage_give_few_pairs(spark, monkeypatch):
    """Pairs follow the rows of families of near copies, not the product of their sizes."""
    rng = random.Random(12)
    shared, own = prose(rng, 40), [[f"w{f}x{k}" for k in range(80)] for f in range(2)]
    texts = []
    for f in range(2):
        for i in range(150):
            words = shared + own[f]
            words[40 + rng.randrange(80)] = f"z{i}"
            texts.append(" ".join(words))
    aligned = []
    verified, similar_pairs = near_dedup._verified, near_dedup.similar_pairs
    monkeypatch.setattr(near_dedup, "_verified", lambda p, *a: aligned.append(p.count()) or verified(p, *a))
    got = near_dedup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0, 150} and all(r.class_id == r.doc_id // 150 * 150 for r in got)
    assert sum(aligned) < 4 * len(texts)
    # Within a task, one link joins two components however many texts they have.
    numbers = near_dedup._numbered([" ".join(t.split()) for t in texts[:150]])
    places, tried = np.triu_indices(150, 1), []
    odd = (places[0] + places[1]) % 2 == 1
    monkeypatch.setattr(near_dedup, "similar_pairs", lambda a, b, *o: tried.append(len(a)) or similar_pairs(a, b, *o))
    assert len(near_dedup._spanning(numbers, np.arange(150) % 2, places[0][odd], places[1][odd], 0.8)) == 1 and sum(tried) == 1
    assert len(near_dedup._spanning(numbers, np.arange(150), *places, 0.8)) == 149


def test_covered_keys_are_left_out(spark):
    rng = random.Random(2)
    for _ in range(4):
        members = {k: {i for i in range(12) if rng.random() < rng.choice([0.2, 0.9])} for k in range(8)}
        rows = [(k, i, len(m)) for k, m in members.items() for i in m if len(m) > 1]
        left = near_dedup._without_covered(spark.createDataFrame(rows, "key long, id long, n long"), Scratch(spark, "t")).collect()
        stays = {}
        for r in left:
            stays.setdefault(r.key, set()).add(r.id)
            assert r.n == len(members[r.key])
        pairs = lambda sets: {p for m in sets for p in itertools.combinations(sorted(m), 2)}
        assert pairs(stays.values()) == pairs(m for m in members.values() if len(m) > 1)
    same = [(k, i, 50) for k in range(30) for i in range(50)]
    assert {r.key for r in near_dedup._without_covered(spark.createDataFrame(same, "key long, id long, n long"), Scratch(spark, "t")).collect()} == {29}


def test_similar_texts_share_a_first_gram():
    rng = np.random.default_rng(3)
    for least in (0.8, 0.7):
        for _ in range(300):
            a = rng.integers(0, 40, rng.integers(1, 60))
            b = a.copy()
            for _ in range(rng.integers(0, len(a) // 4 + 1)):
                k, x = rng.integers(0, len(b)), rng.integers(0, 40)
                b = [np.delete(b, k) if len(b) > 1 else b, np.insert(b, k, x), np.where(np.arange(len(b)) == k, x, b)][rng.integers(0, 3)]
            if not near_dedup.similar(a, b, least):
                continue
            words, sizes = np.concatenate([a, b]).astype(np.uint64), np.array([len(a), len(b)])
            value, text = near_dedup.first_grams(words, sizes, rng.integers(2, 9, near_dedup.COUNTED), least)  # any order of grams will do
            assert set(value[text == 0]) & set(value[text == 1])
            bits, longer = near_dedup.bags(words, sizes), max(len(a), len(b))
            for x, y, n in ((0, 1, len(a)), (1, 0, len(b))):
                assert near_dedup.lacking(bits, np.array([x]), np.array([y]))[0] <= n - longer + int((1 - least) * longer + 1e-9)


def test_rows_are_judged_by_their_texts(spark):
    """Repeated doc_ids, null doc_ids, exact repeats and white space beyond ASCII."""
    rng = random.Random(3)
    t, u, v = (" ".join(prose(rng, 50)) for _ in range(3))
    rows = [(1, t, 1), (2, u, 2), (2, t + " extra", 3), (3, u, 4), (4, v.replace(" ", "\u00a0"), 5), (5, v.replace(" ", "\u3000"), 6), (None, v, 7), (None, None, 8), (6, t, 9), (6, t, 9), (6, t, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first int")
    got = Counter((r.doc_id, r.class_id) for r in near_dedup.near_classes(docs).collect())
    assert got == Counter([(1, 1), (2, 2), (2, 1), (3, 2), (4, 4), (5, 4), (None, 4), (None, None), (6, 1), (6, 1), (6, 1)])
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.first for r in kept.collect()) == [1, 2, 5, 8]
    ids = spark.createDataFrame([("b", t), ("a", t), ("c", u)], "doc_id string, text string")
    assert sorted(map(tuple, near_dedup.near_classes(ids).select("doc_id", "class_id").collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
    again = near_dedup.without_near_duplicates(docs.where("doc_id = 6").union(docs.where("doc_id = 6")))
    assert [r.first for r in again.collect()] == [9]


def test_warc_round_trip(spark):
    html = ["<p>" + "é" * 200, "short", None, "", "<p>" + "é" * 200, "short", "x" * 300000, "WARC/1.1\r\n\r\n" * 40, "<p>" + "é" * 200, "\r\n" * 90]
    pages = spark.createDataFrame([(9 - i, f"http://a/{i}\r\nX: y" if i else None, h, "clash", 1) for i, h in enumerate(html)], "page_id long, url string, html string, digest string, chunk int").repartition(3)
    folder = new_path(spark, "warc")
    archives = written(warc.write_archives(warc.records(pages), folder, chunk_bytes=1000), "archives")
    rows = warc.read_archives(archives, folder, chunk_bytes=700).collect()
    body = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.chunk_no)):
        body[r.page_id] = body.get(r.page_id, b"") + bytes(r.chunk)
        assert r.digest_so_far == hashlib.sha256(body[r.page_id]).hexdigest() and r.bytes_so_far == len(body[r.page_id]) and len(r.chunk) <= 700
    last = {r.page_id: r for r in rows if r.is_last}
    assert len(last) == len(html)
    for i, h in enumerate(html):
        raw, r = (h or "").encode(), last[9 - i]
        first = min(9 - j for j, g in enumerate(html) if g == h) if len(raw) >= 100 else 9 - i
        assert (r.record_type, r.refers_to) == (("revisit", first) if first < 9 - i else ("response", None))
        assert r.named_digest == hashlib.sha256(raw).hexdigest() and r.named_bytes == len(raw)
        assert body[9 - i] == (b"" if r.record_type == "revisit" else raw)
    with gzip.open(archives.first()["path"]) as f:
        assert f.read(8) == b"WARC/1.1"
    assert warc.read_archives(written(warc.write_archives(warc.records(pages.where("page_id < 0")), folder), "archives"), folder).count() == 0


def brute_hits(text, items):
    words = decontamination.words_of(text)
    hit, found = set(), set()
    for item, body in items:
        w = decontamination.words_of(body)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else []:
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("shard_words, chunk", [(2_000_000, 1), (12, 1), (3, 1 << 20)])
def test_decontamination_equals_brute_force(spark, monkeypatch, shard_words, chunk):
    monkeypatch.setattr(decontamination, "CHUNK", chunk)
    rng = random.Random(6)
    draw = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, draw(rng.randint(8, 16))) for i in range(8)] + [(8, "É x-y z"), (9, None), (10, "..."), (11, "q"), (12, "É X y, Z")]
    items += [(13 + i, draw(30)) for i in range(30)]  # so there are some forty shards of the smallest size
    texts = [draw(rng.randint(0, 60)) for _ in range(60)] + [None, "", "é x y z q", "É! X Y Z " * 3, "q"] + [items[0][1]]
    docs = spark.createDataFrame([(i, t, 5, "f") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.hit_spans), r.found) for r in decontamination.with_hits(docs, bench, shard_words=shard_words).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    clean = decontamination.decontaminated(docs, bench, shard_words=shard_words)
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == docs.columns and kept[60] is None and kept[61] == ""
    for i, t in enumerate(texts):
        n, hits, _ = got[i]
        assert (i in kept) == (hits <= 0.5 * n)
        if i in kept:
            assert hits or kept[i] == t
            assert len(decontamination.words_of(kept[i])) <= n - hits
    assert decontamination.with_hits(docs, bench.where("item_id < 0")).where("size(hit_spans) > 0").count() == 0
    assert decontamination.with_hits(docs.where("doc_id < 0"), bench).count() == 0


def test_url_filter_keeps_no_false_positive(spark):
    rows = [(i, f"http://h{i}.com/p/{i}") for i in range(400)] + [(400, None), (401, "nope"), (402, "http://u@H7.com:80/p//7/?q#f"), (403, "http://x.example.net/en/1"), (404, "http://x.example.net/de/1"), (405, "http://h9.com/p/%39")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, block string, hit string")
    listed = spark.createDataFrame([(f"h{i}.com/p/{i}",) for i in range(0, 400, 7)] + [(None,), ("h7.com/p/7",), ("h9.com/p/9",)], "canonical string")
    got = {r.page_id: r.verdict for r in url_filter.filtered(pages, listed, max_blocks=2).collect()}  # a filter this small passes much
    assert {i for i in range(400) if got[i] == "block"} == {*range(0, 400, 7), 9}
    assert (got[400], got[401], got[402], got[403], got[404], got[405]) == ("allow", "allow", "block", "allow", "block", "block")
    assert url_filter.filtered(pages, listed.where("1 = 0")).count() == len(rows)
    assert url_filter.filtered(pages.where("1 = 0"), listed).count() == 0


def test_chat_round_trip(spark):
    bits = ["\\", "###", "</turn>", "\n", "\\b", "\\h", "\\t", "#", "x", ":\n", "### assistant:\n", "é🙂"]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) if rng.random() > 0.1 else None, "z") for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(0, 0, "user", "tie", "z"), (0, 0, "user", "tie", "z"), (99, None, "user", "null turn", "z"), (99, 1, "assistant", "", "z"), (None, 0, "user", "no conversation", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns string")
    made = chat_format.formatted(df)
    got = {r.conv_id: r for r in made.withColumn("back", chat_format.parsed(made["formatted"])).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted([(-1 if t is None else t, r or "", x or "") for k, t, r, x, _ in rows if k == c])
        assert [(b.role, b.text) for b in got[c].back] == [t[1:] for t in turns]
        loss = [chat_format_plain(got[c].formatted[m.start : m.end]) for m in got[c].loss_mask]
        assert loss == [x for _, r, x in turns if r == "assistant"]
    assert chat_format.formatted(df.where("1 = 0")).count() == 0


def chat_format_plain(s):
    for raw, pair in reversed(chat_format.PAIRS):
        s = s.replace(pair, raw)
    return s


def test_pipeline_stages(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "benchmark_decontamination", "personal_data", "encoding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf_dir), "stage")
        kept[name] = docs.count()
        if name != "encoding":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontamination.with_hits(docs, bench).where("size(hit_spans) > 0").count() == 0
    classes = near_dedup.near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert kept["near_duplicates"] <= classes.where("class_id = doc_id").count()
    assert kept["encoding"] == kept["personal_data"] == docs.where("n_tokens >= 0").count() > 0
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "ids").collect())) == sorted(map(tuple, docs.select("doc_id", "ids").collect()))


CLASHES = ("score", "predicted", "held_out", "n_words", "found", "hit_spans", "made", "base", "extra", "voted", "decoded", "key", "own", "sha", "row", "class_id", "first", "label")


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    """Nulls in every column, an empty table, very long texts, ties and repeated rows, and columns whose names the stages use themselves."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(1)
    long_text = " ".join(prose(rng, 30000))
    rows = [(1, None, None, None, None), (None, "no identifier, mail a@b.cd now", "en", "s", 3), (2, "", "en", "s", 0), (3, long_text, "en", "s", len(long_text)), (4, " ".join(prose(rng, 60)), "en", "s", 9), (4, " ".join(prose(rng, 60)), "en", "s", 9), (5, "9" * 40000, None, None, None)]
    odd = spark.createDataFrame(rows + [rows[4]] * 3, own.schema).withColumns({c: F.lit(f"u-{c}") for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, sf_dir)
        kept = made.collect()
        assert stage(spark, odd.where("1 = 0"), sf_dir).count() == 0
        assert all(r[c] == f"u-{c}" for r in kept for c in CLASHES)
        if name != "encoding":
            assert made.columns == odd.columns and made.dtypes == odd.dtypes
        texts = Counter(r.text for r in kept)
        if name == "near_duplicates":
            assert texts[rows[4][1]] == 1 and texts[None] == texts[""] == 1 and len(kept) == 7
        elif name != "quality":
            assert len(kept) == 10 and texts[None] == 1 and texts[""] == 1
        if name == "personal_data":
            assert "no identifier, mail [EMAIL] now" in texts and next(r.n_chars for r in kept if r.text and "[EMAIL]" in r.text) == 31
        if name == "encoding":
            assert {r.n_tokens for r in kept if not r.text} == {0}


def test_pipeline_encoding_decodes_too(spark, sf_dir):
    """decoded_text is what the library makes of the ids; a column decoded stays."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [None, "", "Some words, 12 of é中 them's\n\n<|endoftext|>", " ".join(prose(random.Random(2), 3000))]
    docs = spark.createDataFrame([(i, t, "own", "gone") for i, t in enumerate(texts)], "doc_id long, text string, decoded string, decoded_text string")
    for r in corpus_pipeline.encoding(spark, docs, sf_dir).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded, r.decoded_text) == (" ".join(map(str, ids)), len(ids), "own", lib.decode(ids, skip_special_tokens=False))


def test_pipeline_equals_plain_stages(spark, sf_dir):
    """run() against stages in plain Python: all pairs of texts, all windows, the patterns as written, and the library's encoder."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    from tesserine.llm import quality_classifier

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels.select("doc_id", "quality"))
    logit = lambda t: float(np.clip((np.array(quality_classifier.features(t)) - model["mean"]) / model["scale"], -8, 8) @ model["weights"][:-1] + model["weights"][-1])
    left = {r.doc_id: r.text for r in docs.collect() if logit(r.text) >= 0}
    cut = {i: (t or "").lower().split() for i, t in left.items()}
    parent = {i: i for i in left}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, j in itertools.combinations(sorted(left), 2):
        a, b, n = cut[i], cut[j], max(len(cut[i]), len(cut[j]))
        most = int(0.2 * n + 1e-9)
        if a and b and abs(len(a) - len(b)) <= most and sum((Counter(a) & Counter(b)).values()) >= n - most and (a == b or edit_distance(a, b) <= most):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    left = {i: t for i, t in left.items() if find(i) == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows: dict = {}
    for _, body in items:
        w = decontamination.words_of(body)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else []:
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    for i, t in list(left.items()):
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        words = decontamination.words_of(t)
        hit = {k + j for n, known in windows.items() for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in known for j in range(n)}
        if 2 * len(hit) > len(words):
            del left[i]
        elif hit:
            out, at = "", 0
            for first in sorted(k for k in hit if k - 1 not in hit):
                last = first
                while last + 1 in hit:
                    last += 1
                out, at = out + t[at : places[first][0]], places[last][1]
            left[i] = out + t[at:]
    luhn = lambda d: sum((v := int(c) * (1 + k % 2)) - (9 if v > 9 else 0) for k, c in enumerate(reversed(d))) % 10 == 0
    kinds = (
        ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("IP", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("CARD", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)), ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
        ("SECRET", r"(?<=token = \")[0-9a-f]{40}(?=\")", lambda m: True),
    )
    for i, t in left.items():
        spans = sorted((m.start(), m.end(), k) for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m.group()))
        out, at = "", 0
        for start, end, kind in spans:
            if start >= at:
                out += t[at:start] + f"[{kind}]"
            at = max(at, end)
        left[i] = out + t[at:] if t else t
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: (t, " ".join(map(str, lib.encode(t or "", add_special_tokens=False).ids))) for i, t in left.items()}
    got = {r.doc_id: (r.text, r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want

"""Token counts, word BPE, quality rules, classifier and PII against libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tesserine.llm import pii, quality_classifier, quality_rules, token_counts, word_bpe

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
BITS = [*"ab c\n\t <>/'.,sé漢🙂\x00Σİ́ \x1c½", "▁", "the", "ing", "<|endoftext|>", "<s>", "'s", "aaaa", "!!", "Ⅷ", "  ", "\n\n"]


def random_texts(n, seed=1, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def documents(spark, texts):
    rows = [(i, t, "x", "clash", "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, found string, score string, n_tokens int")


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    texts = [*random_texts(1500), None, "", "a" * 30000, " " * 4000, "\n" * 3000, "x"]
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = token_counts.with_token_counts(documents(spark, [*texts, texts[0]]), PIECES)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()}
    for i, t in enumerate([*texts, texts[0]]):
        n = len(lib.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096), repr(t)[:80]
    assert token_counts.with_token_counts(documents(spark, texts).where("doc_id < 0"), PIECES).count() == 0


def test_count_without_cuts_is_the_same():
    counter = token_counts.PieceCounter(PIECES)
    texts = random_texts(300, 2)
    with_cuts = [counter.count(t) for t in texts]
    counter.cut_marks = False
    assert [counter.count(t) for t in texts] == with_cuts


def test_token_counter_keeps_the_words_of_a_large_vocabulary(monkeypatch):
    """150,000 words that come again are not merged again; counts are the library's."""
    import sentencepiece

    counter = token_counts.PieceCounter(PIECES)
    words = [f"{'aeiou'[i % 5]}{i:x}" for i in range(150_000)]
    first = [counter.count(w) for w in words]
    merged = []
    whole = counter.count_segment
    monkeypatch.setattr(counter, "count_segment", lambda seg: merged.append(seg) or whole(seg))
    assert [counter.count(w) for w in words] == first and not merged
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert first[::50] == [len(ids) for ids in lib.encode(words[::50])]


def test_word_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    texts = [*random_texts(1500, 3), None, "", "b" * 20000, "-" * 5000, "é" * 2000]
    out = word_bpe.with_encoding(documents(spark, [*texts, texts[0]]), WORDS)
    got = {r.doc_id: (r.ids, r.n_tokens, r.decoded) for r in out.collect()}
    for i, t in enumerate([*texts, texts[0]]):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (" ".join(map(str, ids)), len(ids), lib.decode(ids, skip_special_tokens=False)), repr(t)[:80]
    digests = word_bpe.with_encoding(documents(spark, texts[:50]), WORDS, digests=True).collect()
    assert all(r.ids_sha256 == hashlib.sha256(got[r.doc_id][0].encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(got[r.doc_id][2].encode()).hexdigest() for r in digests)
    assert word_bpe.with_encoding(documents(spark, texts).where("doc_id < 0"), WORDS).count() == 0


def test_word_encoder_keeps_the_words_of_a_large_vocabulary(monkeypatch):
    """140,000 words that come again are not worked out again; ids are the library's."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [" ".join({"".join(rng.choices("etaoinshrdlucm", k=8)) for _ in range(20_000)}) for _ in range(7)]
    encoder = word_bpe.WordEncoder(WORDS)
    first = [i for t in texts for i in encoder.encode([t])]
    learnt = []
    whole = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (learnt.extend(words := list(words)), whole(words)))
    assert [i for t in texts for i in encoder.encode([t])] == first and not learnt
    assert first[0] == " ".join(map(str, Tokenizer.from_file(WORDS).encode(texts[0], add_special_tokens=False).ids))


def test_neighbours_stay_apart_as_the_merges_say():
    encoder = word_bpe.WordEncoder(WORDS)
    rng = random.Random(6)
    assert encoder.in_order
    stable = [t for t in rng.sample(sorted(encoder.vocab), 3000) if encoder._merged(encoder._symbols(t)) == [t]]
    lefts = [t for t in stable if not t.endswith(encoder.suffix)]
    split = [(t[:k], t[k:]) for t in stable for k in range(1, len(t) - len(encoder.suffix)) if t[:k] in encoder.vocab and t[k:] in encoder.vocab]
    pairs = [*((rng.choice(lefts), rng.choice(stable)) for _ in range(3000)), *split[:3000], *((t, t) for t in lefts[:500])]
    kinds = set()
    for a, b in pairs:
        if all(encoder._merged(encoder._symbols(t)) == [t] for t in (a, b)):
            want = encoder._merged(encoder._symbols(a) + encoder._symbols(b)) == [a, b]
            assert encoder._apart(a, b) == want, (a, b)
            kinds.add(want)
    assert kinds == {True, False}


def test_small_caches_change_nothing(monkeypatch):
    texts = random_texts(400, 5)
    want = word_bpe.WordEncoder(WORDS).encode(texts)
    monkeypatch.setattr(word_bpe, "CACHED_WORDS", 20)
    monkeypatch.setattr(word_bpe, "CACHED_PAIRS", 50)
    encoder = word_bpe.WordEncoder(WORDS)
    assert [i for k in range(0, 400, 7) for i in encoder.encode(texts[k : k + 7])] == want


def test_few_places_of_the_vocabulary_change_nothing(monkeypatch):
    texts = random_texts(400, 5)
    want = word_bpe.WordEncoder(WORDS).encode(texts)
    monkeypatch.setattr(word_bpe, "CACHED_WAYS", 9)
    assert word_bpe.WordEncoder(WORDS).encode(texts) == want


def brute_repeats(words, window=8):
    at = {}
    for i in range(len(words) - window + 1):
        at.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(window)})


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "#c", "d\n", "\n", "e|<"]) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "x " * 5000, "word\n" * 300]
    got = {r.doc_id: r for r in quality_rules.with_quality_rules(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeats = brute_repeats(words)
        failed = len(words) < 20 or 100 * repeats > 30 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeats, failed)
        assert not (failed and r.kept)


def test_compression_bands():
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice(["er", "in", "the", "on", "st", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(700))
    noise = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000))
    wide = ((0, 0.0, 1.05), (64, 0.95, 1.9), (512, 1.25, 3.2), (4096, 1.8, 4.0))
    good = lambda t: quality_rules.compression(t.encode(), wide)[2]
    assert good(prose) and good(prose[:300]) and good("")
    assert not good("one two three four five six " * 300) and not good(noise)
    assert not quality_rules.compression(rng.randbytes(5000), wide)[2]
    _, bad, fits = quality_rules.compression(prose.encode()[:2048] + b"a" * 2047, wide)  # the tail is judged
    assert 0.49 < bad < 0.51 and not fits
    assert not good("a" * 63) and good("a")


def test_kept_equals_plain_computation(spark, sf_dir):
    import zstandard

    def plain(text):
        raw = (text or "").encode()
        size = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b)) if b else 0.0
        def ok(b):
            for n, low, high in sorted(quality_rules.BANDS, reverse=True):
                if len(b) >= n:
                    return low <= size(b) <= high
        bad = 0
        for at in range(0, len(raw), 2048):
            bad += 0 if ok(raw[at : at + 2048]) else len(raw[at : at + 2048])
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return len(words) >= 20 and 100 * brute_repeats(words) <= 30 * len(words) and ok(raw) and 4 * bad <= len(raw)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("made", F.lit("clash"))
    out = quality_rules.with_quality_rules(docs)
    rows = out.select("text", "kept", "ratio", "made").collect()
    assert all(r.kept == plain(r.text) and r.made == "clash" for r in rows) and {r.kept for r in rows} == {True, False}
    bands = quality_rules.calibrated(out.where("kept"))
    assert [b[0] for b in bands] == [b[0] for b in quality_rules.BANDS] and all(low < high for _, low, high in bands)


def test_nnpu_minimises_the_non_negative_risk():
    """Against a plain implementation of the risk and its slope by differences, and against the truth."""
    rng = np.random.default_rng(4)
    draw = lambda n, centre: rng.normal(centre, 1, (n, 2))
    p, u = draw(800, 1.5), np.vstack([draw(600, 1.5), draw(1400, -1.5)])
    rng.shuffle(u)

    def risk(w, prior):
        first = second = third = 0.0
        for x in p:
            z = float(x @ w[:2] + w[2])
            first += np.log1p(np.exp(-z)) / len(p)
            third += np.log1p(np.exp(z)) / len(p)
        for x in u:
            second += np.log1p(np.exp(float(x @ w[:2] + w[2]))) / len(u)
        return prior * first, second - prior * third

    w = np.array([0.3, -0.2, 0.1])
    assert np.allclose(risk(w, 0.3), quality_classifier.risks(w, p, u, 0.3))
    found = quality_classifier.nnpu(p, u, 0.3)
    best = sum(map(lambda r: max(r, 0.0), risk(found, 0.3)))
    for k in range(3):
        for d in (-0.4, 0.4):
            assert best <= sum(max(r, 0.0) for r in risk(found + d * np.eye(3)[k], 0.3)) + 0.01
    truth = draw(500, 1.5), draw(500, -1.5)
    assert (quality_classifier.chance(truth[0], found) >= 0.5).mean() > 0.95 and (quality_classifier.chance(truth[1], found) < 0.5).mean() > 0.95
    assert abs(quality_classifier.estimated_prior(p, u) - 0.3) < 0.07


def test_repeated_identifiers_send_one_row_to_the_driver(spark):
    docs = spark.createDataFrame([(i % 4, f"text number {i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels, max_positives=2, max_unlabelled=2)
    assert model["positives"] <= 2 and model["unlabelled"] <= 2


def test_classifier_on_held_out_rows(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    out = quality_classifier.with_quality(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.5 for s in good]) > 0.95 and np.mean([s < 0.5 for s in bad]) > 0.9


def test_classifier_ignores_held_out_labels_and_handles_edges(spark):
    texts = ["Some prose that runs on, as prose does.", "AAAA!! BBBB!!", None, "", "x" * 50000] * 12
    docs = documents(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))]
    labels = lambda flip: spark.createDataFrame([(i, (1 - int(i % 5 == 0)) if flip and held[i] else int(i % 5 == 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    one, two = ({r.doc_id: (r.held_out, r.score) for r in quality_classifier.with_quality(docs, labels(f)).collect()} for f in (False, True))
    assert one == two and [one[i][0] for i in range(len(texts))] == held and all(0 <= s <= 1 for _, s in one.values())
    none = quality_classifier.with_quality(docs, labels(False).where("doc_id < 0"))
    assert {r.score for r in none.collect()} == {0.5}
    assert quality_classifier.with_quality(docs.where("doc_id < 0"), labels(False)).count() == 0


LUHN = lambda d: sum((v := int(c) * (1 + i % 2)) - (9 if v > 9 else 0) for i, c in enumerate(reversed(d))) % 10 == 0
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and LUHN(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(7)
    bits = ["a", "b.c", "@", "@x.y", ".", "1", "22", "255", "256", "0001", " ", "-", "+", "(", "4111 1111 1111 1111", "4111111111111111", "+1 (377) 555-0271", "\x03", "é", "🙂", "_", "%", "\n", "1.2.3.4", "m@ex-a.com", "5555-5555-5555-4444"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(2500)] + [None, "", "9" * 30000, "1 " * 8000, "a@b" + ".c" * 20000, "a" * 60000]
    found = pii.with_candidates(documents(spark, texts)).select("doc_id", pii._listed("base").alias("s")).collect()
    want = {i: ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in KINDS for m in re.finditer(p, t or "") if ok(m.group())) for i, t in enumerate(texts)}
    assert {r.doc_id: r.s for r in found} == want


def private_texts(n, seed=5):
    """Texts with private spans of each further kind in differing surroundings, and look-alikes that are none; (text, private spans)."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    out = []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            span, text = (s := hexes(rng.choice([32, 40, 64]))), f'{word(5)} {rng.choice(["token", "api_key", "password"])} = "{s}" {word(6)}'
        elif kind == 1:
            span, text = (s := "DE" + "".join(rng.choice("0123456789") for _ in range(20))), f"IBAN: {s} {word(4)}"
        elif kind == 2:
            span, text = (s := f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"), f"{word(6)} ssn: {s}, {word(4)}"
        elif kind == 3:
            span, text = (s := f"Dr. {word(5).title()} {word(6).title()}"), f"Dear {s}, {word(5)}"
        elif kind == 4:
            span, text = (s := f"{rng.randint(1, 99)} {word(6).title()} Street"), f"address: {s}, {rng.randint(10000, 99999)} {word(4)}"
        else:
            span, text = None, [f"{word(20)} {word(18)}", f"{word(9)}-{word(9)} {word(4)}", f"see {word(17)}_{word(8)} there"][kind - 5]
        out.append((text, span))
    return out


def test_private_spans_against_labels(spark):
    """Precision and recall over labelled texts of five kinds; nothing is told to the labelers' training but the texts."""
    cases = private_texts(800)
    docs = documents(spark, [t for t, _ in cases])
    found = pii.with_candidates(docs)
    weights = pii.fit(found)
    spans = {r.doc_id: [(s.start, s.end) for s in r.s] for r in found.select("doc_id", pii.all_spans(weights).alias("s")).collect()}
    right = sum(p is not None and (t.index(p), t.index(p) + len(p)) in spans[i] for i, (t, p) in enumerate(cases))
    wrong = sum(len(spans[i]) for i, (_, p) in enumerate(cases) if p is None)
    assert right >= 0.9 * sum(p is not None for _, p in cases)
    assert wrong <= 0.05 * sum(p is None for _, p in cases)


def test_secrets_are_added_and_redacted(spark):
    secret = 'token = "%s" end'
    texts = [secret % hashlib.sha1(str(i).encode()).hexdigest() for i in range(30)] + ["plain words only"] * 30 + ["mail me@ex.com now", None, "longlonglonglonglonglonglongword", secret % (hashlib.sha1(b"x").hexdigest() * 8)]
    docs = documents(spark, texts).withColumns({"base": F.lit("u"), "extra": F.lit("v")})
    rows = pii.without_pii(docs)
    out = {r.doc_id: r.text for r in rows.collect()}
    assert out[0] == 'token = "[SECRET]" end' and out[30] == "plain words only" and out[60] == "mail [EMAIL] now" and out[61] is None and out[62] == texts[62]
    assert out[63] == 'token = "[SECRET]" end'  # 320 characters
    assert rows.columns == docs.columns and {(r.base, r.extra) for r in rows.collect()} == {("u", "v")}
    assert pii.without_pii(docs.where("doc_id < 0")).count() == 0


def test_redaction_merges_overlaps(spark):
    spans = "array(named_struct('kind', 'b', 'start', 2, 'end', 5), named_struct('kind', 'a', 'start', 4, 'end', 7), named_struct('kind', 'c', 'start', 2, 'end', 3), named_struct('kind', 'd', 'start', 8, 'end', 9))"
    row = spark.range(1).select(F.lit("0123456789").alias("t"), F.expr(spans).alias("s")).select(pii.redacted(F.col("t"), F.col("s")).alias("r")).first()
    assert row.r == "01[C]7[D]9"


def test_reliabilities_tell_good_labelers_from_bad():
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        private = rng.random() < 0.3
        votes = [rng.random() < (0.95 if private else 0.05), rng.random() < (0.9 if private else 0.1), rng.random() < (0.85 if private else 0.2), rng.random() < 0.5]
        p = sum(v << k for k, v in enumerate(votes))
        counts[p] = counts.get(p, 0) + 1
    chance, rates = pii.reliabilities(counts)
    assert chance[7] > 0.95 and chance[0] < 0.05
    assert rates[0][0] > 0.85 and rates[0][1] < 0.15 and abs(rates[3][0] - rates[3][1]) < 0.1
    assert pytest.approx(1, abs=0.2) == chance[15] and F is not None

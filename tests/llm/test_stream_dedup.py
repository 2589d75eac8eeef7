"""Exact duplicates by streaming: against SQL, against brute force with digests that collide, over several arrivals."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserine.llm import stream_dedup
from tesserine.llm.common import Scratch, new_path



def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, k))
    return sorted(((rows[k][0], rows[min(g)[3]][0], len(g), k == min(g)[3], hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for *_, k in g), key=str)


def rows_of(made):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in made.collect()), key=str)


ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a b"), (4, "a b"), (5, "ab"), (None, "a  b"), (None, "a  b"), (6, "é b"), (7, "éb"), (8, "x" * 300_000), (9, "x " * 300_000), (10, "A B")]


def test_odd_rows(spark):
    path = new_path(spark, "odd")
    frame = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"digest": F.lit("z"), "path": F.lit(1), "n": F.lit(2)})
    frame.coalesce(1).write.parquet(path)
    folder = new_path(spark, "state")
    stream_dedup.ingest(spark, path, folder)
    assert rows_of(stream_dedup.classes(spark, path, folder, Scratch(spark, "t"))) == brute(ODD)


def test_empty_table(spark):
    path, folder = new_path(spark, "none"), new_path(spark, "state")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    stream_dedup.ingest(spark, path, folder)
    assert stream_dedup.classes(spark, path, folder, Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("bits", [0, 4])
def test_colliding_digests_are_told_apart_by_bytes(spark, bits):
    rng = random.Random(bits)
    rows = [(i, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 5)))) for i in range(300)]
    path, folder = new_path(spark, "texts"), new_path(spark, "state")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    stream_dedup.ingest(spark, path, folder, digest=lambda t: F.conv(F.substring(F.sha2(t, 256), 1, bits // 4), 16, 10) if bits else F.lit("one"))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in stream_dedup.classes(spark, path, folder, Scratch(spark, "t")).collect()), key=str)
    assert got == sorted((x[:4] for x in brute(rows)), key=str)


def test_later_arrivals_meet_the_state(spark):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randint(0, 40)}" + " " * rng.randint(0, 3)) for i in range(200)]
    path, folder = new_path(spark, "arrivals"), new_path(spark, "state")
    for k in range(0, 200, 40):
        spark.createDataFrame(rows[k : k + 40], "doc_id long, text string").coalesce(2).write.mode("append").parquet(path)
        stream_dedup.ingest(spark, path, folder, files=1)
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in stream_dedup.classes(spark, path, folder, Scratch(spark, "t")).collect()), key=str)
        assert got == sorted((x[:4] for x in brute(rows[: k + 40])), key=str)
    assert len(list(spark.read.parquet(f"{folder}/retained").select("batch").distinct().collect())) > 5

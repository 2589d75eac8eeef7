"""Feeds, blobs, named queries and streaming."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserine.operators import named
from tesserine.sources import blobs, feeds
from tesserine.sources.bridge import view
from tesserine.streaming import observations


def test_feeds(spark):
    payloads = ['{"cve": {"id": "CVE-1"}}', '{"id": "O", "aliases": [], "affected": [{"package": {"ecosystem": "PyPI", "name": "X"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "2"}]}]}]}', "{", "[]", None, '{"ghsa_id": "G", "cve_id": "CVE-9", "vulnerabilities": []}', '{"source": "no id"}']
    rows = feeds.records(spark.createDataFrame([(p,) for p in payloads], "payload string")).collect()
    assert {(r.provider, r.cve_id, r.ecosystem, r.introduced, r.fixed) for r in rows} == {("nvd", "CVE-1", "generic", None, None), ("osv", "O", "pypi", "0", "2")}


def test_dex_headers(spark):
    head = bytearray(112)
    head[:8] = b"dex\n035\0"
    for at, n in ((56, 12), (80, 4), (88, 6), (96, 0x80000003)):
        struct.pack_into("<I", head, at, n)
    df = spark.createDataFrame([(1, bytes(head)), (2, bytes(head[:100])), (3, b"x" * 200)], "i int, content binary")
    got = {r.i: (r.status, r.n_strings, r.n_fields, r.n_methods, r.n_classes) for r in blobs.dex_headers(df).collect()}
    assert got == {1: ("parsed", 12, 4, 6, 0x80000003), 2: ("truncated", None, None, None, None), 3: ("not_dex", None, None, None, None)}


def test_zip_inventory(spark):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name in ("classes.dex", "lib/arm/libx.so", "assets/a", "res/b", "META-INF/C.RSA", "AndroidManifest.xml"):
            z.writestr(name, b"12345")
    df = spark.createDataFrame([("a", held.getvalue()), ("b", b"no zip"), ("c", None)], "path string, content binary")
    got = {(r.path, r.kind) for r in blobs.zip_entries(df).collect()}
    assert got == {("a", k) for k in ("dex", "native", "assets", "resources", "certificates", "other")} | {("b", "invalid"), ("c", "invalid")}


def test_registry(spark):
    files = spark.createDataFrame([(1, b"a"), (2, b"b"), (3, b"b"), (4, b"c")], "n int, content binary")
    got = blobs.registered(files, blobs.digests(files.where("n = 4")), "n").collect()
    assert sorted((r.n, r.n_copies) for r in got) == [(1, 1), (2, 2)]


def test_unknown_named_query(spark):
    with pytest.raises(ValueError, match="no query is named"):
        named.run("nothing", {})


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = view(spark, sf_dir, "observation")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = observations.counted(observations.classified(stream)).writeStream.outputMode("append").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    streamed = {(r.start, r.kind): r.n for r in spark.table("seen").collect()}
    batch = {(r.start, r.kind): r.n for r in observations.counted(rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("kind", observations.ranks.observed_kind(*(F.col(c) for c in ("observation_type", "class_name", "method_name", "symbol"))))).collect()}
    assert streamed and all(batch[k] == n for k, n in streamed.items())

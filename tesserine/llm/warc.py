"""Operator 2: WARC archives as a chunked record table.

Writing: each payload is cut into chunk rows (record, chunk number, bytes), which a task streams
into a gzip member per record, one file per task. Reading: a task streams a file and gives back
chunk rows (record identifier, chunk number, bytes, and the SHA-256 of the payload up to and
including the chunk), so the row marked as last carries the digest and length of the whole.
Neither side holds a whole record; the input cell that Spark read is the one place where a
payload stands in one piece.

Among records with equal payloads of at least MIN_REVISIT bytes, those of the smallest page are
written as response and others as revisit, without payload but with the headers that name the
response, its digest and its length.

Files go to the shared folder under the names of their tasks' attempts; the table of files,
written by Spark, names those of the attempts that succeeded, and only these are read. Archives
are opened by pyarrow's file systems, so the folder can be any that they know.

Defined results: a null payload is empty. Rows with equal page identifier and payload are
written each; when they are the smallest, each is a response. A null page identifier is the
empty target, comes back as null, and is always a response.
White space and controls of URLs are percent-encoded. Extra columns aren't kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import join_spread
from .common import new_path, read_table, written

MIN_REVISIT = 100
CHUNK_BYTES = 65536
LEVEL = 2
#: Records read or written per Arrow batch by the reader.
BATCH_BYTES = 8 << 20
ARCHIVES = "path string, records long, bytes long"
CHUNKS = "page_id long, record_id string, record_type string, refers_to long, target_uri string, named_digest string, named_bytes long, chunk_no long, is_last boolean, chunk binary, digest_so_far string, bytes_so_far long"
DATE = "2000-01-01T00:00:00Z"


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """A row per page: page_id, url, raw, digest, n_bytes and refers_to (null for a response)."""
    raw = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("raw"))
    own = own.withColumns({"digest": F.sha2("raw", 256), "n_bytes": F.octet_length("raw").cast("long")})
    may = F.col("n_bytes") >= min_revisit
    groups = own.where(may).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Short payloads are not moved at all; the rows of a frequent digest are dealt over many tasks.
    long = join_spread(own.where(may), groups, "digest", "page_id", pages.count(), how="left")
    out = long.unionByName(own.where(~may).withColumn("first", F.lit(None).cast("long")))
    return out.withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first"))).select("page_id", "url", "raw", "digest", "n_bytes", "refers_to")


def write_archives(rows: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes what records() gives; a row per archive file."""
    revisit = F.col("refers_to").isNotNull()
    sent = F.when(revisit, F.lit(b"")).otherwise(F.col("raw"))
    chunk = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.octet_length(sent) / chunk_bytes).cast("int") - 1)))
    cut = rows.withColumn("chunk_no", chunk).select(
        "page_id", "url", "digest", "n_bytes", "refers_to", "chunk_no", F.substring(sent, F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        n = size = 0
        out = pack = None
        for batch in batches:
            for page, url, digest, n_bytes, first, number, chunk in batch.itertuples(index=False):
                if out is None:
                    out = store.open_output_stream(path, compression=None)
                if number == 0:
                    if pack is not None:
                        size += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    size += out.write(pack.compress(_head(page, url, digest, n_bytes, first)))
                    n += 1
                size += out.write(pack.compress(chunk))
        if out is not None:
            size += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
            out.close()
            yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

    return cut.mapInPandas(write, ARCHIVES)


def _record_id(page, digest: str) -> str:
    h = hashlib.sha256(f"{page}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _head(page, url: str | None, digest: str, n_bytes: int, first) -> bytes:
    page = "" if pd.isna(page) else int(page)
    revisit = not pd.isna(first)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)), ("WARC-Page-ID", page), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", n_bytes),
    ]
    if revisit:
        fields += [("WARC-Refers-To", _record_id(int(first), digest)), ("WARC-Refers-To-Page-ID", int(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "text/html"), ("Content-Length", 0 if revisit else n_bytes)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _line(url: str | None) -> str:
    """A URL on one line, its white space and controls percent-encoded."""
    return "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


class _Unpacked:
    """The bytes of a file of gzip members, a bounded piece at a time."""

    def __init__(self, source, piece: int = 1 << 18):
        self.source, self.piece, self.held, self.pack, self.raw = source, piece, b"", None, b""

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(self.piece)
        if not self.raw:
            return False
        if self.pack is None or self.pack.eof:
            self.pack = zlib.decompressobj(31)
        self.held += self.pack.decompress(self.raw, self.piece)
        self.raw = self.pack.unused_data if self.pack.eof else self.pack.unconsumed_tail
        return True

    def upto(self, mark: bytes) -> bytes | None:
        """What stands before mark; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self.more():
                return None
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        found, self.held = self.held[:n], self.held[n:]
        if len(found) < n:
            raise ValueError("the archive ends within a record")
        return found


def _chunks(source, chunk_bytes: int) -> Iterator[tuple]:
    data = _Unpacked(source)
    while (head := data.upto(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        number = lambda name: int(field[name]) if field.get(name) else None
        left, digest, at, k = number("content-length") or 0, hashlib.sha256(), 0, 0
        while left or not k:
            chunk = data.take(min(left, chunk_bytes))
            left, at = left - len(chunk), at + len(chunk)
            digest.update(chunk)
            yield (number("warc-page-id"), field["warc-record-id"], field["warc-type"], number("warc-refers-to-page-id"), field["warc-target-uri"], field["warc-payload-digest"].partition(":")[2], number("warc-payload-length"), k, not left, chunk, digest.hexdigest(), at)
            k += 1
        data.take(4)


def read_archives(archives: DataFrame, uri_of_folder: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of the archives that a table of files (path, records, bytes) names."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(uri_of_folder)
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for row in _chunks(source, chunk_bytes):
                        rows.append(row)
                        held += len(row[9]) + 400
                        if held > BATCH_BYTES:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    spread = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("path").repartition(max(spread, archives.rdd.getNumPartitions()), "path").mapInPandas(read, CHUNKS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    archives = written(write_archives(records(read_table(spark, sf_dir, "pages")), folder), "archives")
    last = read_archives(archives, folder).where("is_last")
    response = F.col("record_type") == "response"
    return last.select(
        "page_id", F.when(response, F.col("bytes_so_far")).otherwise(F.col("named_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("named_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM q
"""

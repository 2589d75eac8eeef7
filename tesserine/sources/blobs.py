"""Package files as blobs: registry by digest, ZIP inventory and DEX headers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENSIONS = ("apk", "aab", "apks", "apkm")


def digests(blobs: DataFrame, content: str = "content") -> DataFrame:
    c = F.col(content)
    return blobs.withColumns({"sha256": F.sha2(c, 256), "sha1": F.sha1(c), "md5": F.md5(c), "n_bytes": F.octet_length(c).cast("long")})


def registered(blobs: DataFrame, registry: DataFrame, key: str, content: str = "content") -> DataFrame:
    """The blobs that the registry (sha256) lacks, one of each digest, that of the smallest key."""
    fresh = digests(blobs, content).drop(content).join(registry.select("sha256"), "sha256", "left_anti")
    return fresh.groupBy("sha256", "sha1", "md5", "n_bytes").agg(F.min(key).alias(key), F.count("*").alias("n_copies"))


def little_endian(content: Column, at: int) -> Column:
    """The unsigned 32-bit number at an offset."""
    return F.conv(F.hex(F.concat(*(F.substring(content, at + 4 - k, 1) for k in range(4)))), 16, 10).cast("long")


def dex_headers(blobs: DataFrame, content: str = "content") -> DataFrame:
    """Counts of strings, fields, methods and classes; status says why there are none."""
    c = F.col(content)
    status = F.when(F.octet_length(c) < 112, "truncated").when(F.hex(F.substring(c, 1, 4)) != "6465780A", "not_dex").otherwise("parsed")
    out = blobs.withColumn("status", status)
    return out.withColumns({n: F.when(F.col("status") == "parsed", little_endian(c, at)) for n, at in (("n_strings", 56), ("n_fields", 80), ("n_methods", 88), ("n_classes", 96))})


def zip_entries(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row per entry (path, entry, kind, n_bytes); what is no ZIP gives one row of kind invalid."""

    def kind(name: str) -> str:
        low = name.lower()
        if low.endswith(".dex"):
            return "dex"
        if low.startswith("lib/") and low.endswith(".so"):
            return "native"
        if low.startswith("meta-inf/") and low.rpartition(".")[2] in ("rsa", "dsa", "ec"):
            return "certificates"
        return "resources" if low.startswith("res/") or low == "resources.arsc" else "assets" if low.startswith("assets/") else "other"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, body in zip(batch[path], batch[content]):
                try:
                    rows += [(name, e.filename, kind(e.filename), e.file_size) for e in zipfile.ZipFile(io.BytesIO(body)).infolist()]
                except (zipfile.BadZipFile, TypeError):
                    rows.append((name, None, "invalid", 0))
            yield pd.DataFrame(rows, columns=["path", "entry", "kind", "n_bytes"])

    return files.select(path, content).mapInPandas(read, "path string, entry string, kind string, n_bytes long")

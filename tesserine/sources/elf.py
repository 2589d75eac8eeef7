"""Shared objects as tables: header, needed libraries and symbols (S7, S8). One blob per row; the rest is relational."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SYMBOLS = "path string, status string, bits int, machine int, soname string, needed array<string>, name string, kind string"
LOCAL_LIMIT = 4000
#: Fixed values of the format: section types, dynamic tags and symbol binding.
SYMTAB, DYNAMIC, DYNSYM, NEEDED, SONAME, LOCAL = 2, 6, 11, 1, 14, 0


def parsed(blob: bytes | None) -> dict:
    """Header fields, needed, soname and symbols (name, kind) of an ELF file; status says what failed."""
    out = {"status": "not_elf", "bits": None, "machine": None, "soname": None, "needed": [], "symbols": []}
    if not blob or blob[:4] != b"\x7fELF":
        return out
    try:
        wide, end = blob[4] == 2, "<" if blob[5] == 1 else ">"
        read = lambda form, at: struct.unpack_from(end + form, blob, at)
        out |= {"bits": 64 if wide else 32, "machine": read("H", 18)[0]}
        table = read("Q", 40)[0] if wide else read("I", 32)[0]
        size, count = read("HH", 58 if wide else 46)
        sections = [read("IIQQQQIIQQ" if wide else "IIIIIIIIII", table + k * size) for k in range(count)]
        text = lambda base, at: blob[base + at : blob.index(b"\0", base + at)].decode("utf-8", "replace")
        seen = set()
        for _, kind, _, _, offset, length, link, _, _, width in sections:
            if kind not in (SYMTAB, DYNSYM, DYNAMIC) or not width:
                continue
            strings = sections[link][4]
            for at in range(offset, offset + length, width):
                if kind == DYNAMIC:
                    tag, value = read("qQ" if wide else "iI", at)
                    if tag == NEEDED:
                        out["needed"].append(text(strings, value))
                    elif tag == SONAME:
                        out["soname"] = text(strings, value)
                    continue
                name, info, section = (read("IBBH", at)[i] for i in (0, 1, 3)) if wide else (read("IIIBBH", at)[i] for i in (0, 3, 5))
                label = text(strings, name).partition("@")[0]
                use = "imported" if section == 0 else "local" if info >> 4 == LOCAL else "exported"
                if label and (label, use) not in seen:
                    seen.add((label, use))
                    out["symbols"].append((label, use))
        out["status"] = "COMPLETE"
    except (struct.error, ValueError, IndexError):
        out["status"] = "malformed"
    return out


def symbols(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row per symbol, or one without name where a file has none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blob in zip(batch[path], batch[content]):
                p = parsed(blob)
                rows = [(name, p["status"], p["bits"], p["machine"], p["soname"], p["needed"], *s) for s in p["symbols"] or [(None, None)]]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOLS.split(", ")]).astype({"bits": "Int32", "machine": "Int32"})

    return files.select(F.col(path).cast("string").alias(path), content).mapInPandas(read, SYMBOLS)


def bounded(rows: DataFrame, limit: int = LOCAL_LIMIT) -> DataFrame:
    """At most limit local symbols of a file, with a mark on files that had more."""
    w = Window.partitionBy("path", "kind").orderBy("name")
    over = rows.where("kind = 'local'").groupBy("path").agg((F.count("*") > limit).alias("over"))
    kept = rows.withColumn("_n", F.row_number().over(w)).where(~F.col("kind").eqNullSafe(F.lit("local")) | (F.col("_n") <= limit)).drop("_n")
    return kept.join(over, "path", "left").withColumn("truncated", F.coalesce("over", F.lit(False))).drop("over")

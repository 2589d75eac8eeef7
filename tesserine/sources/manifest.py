"""Package manifests as tables: where they lie, their elements, and what the elements say.

A parser turns a manifest, plain or binary XML, into a row per element; everything after that
(header values, permissions, components, filters) is relational over the elements.

Binary XML: little-endian chunks of type, header size and size. A string pool gives the texts
(UTF-8 or UTF-16); a start element names its tag and its attributes by place in the pool, with a
typed value where the text is not given.

Defined results: a null or empty content is missing; content that is neither kind is
unsupported_binary_xml; broken content is malformed_xml or malformed_axml, without elements.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks

ANDROID = "http://schemas.android.com/apk/res/android"
ELEMENTS = "path string, status string, source_format string, ord int, parent int, tag string, attrs map<string,string>"
COMPONENTS = ("activity", "activity-alias", "service", "receiver", "provider")
#: Fixed values of the binary format: kinds of chunks and of values.
POOL, START, END = 0x0001, 0x0102, 0x0103
REFERENCE, ATTRIBUTE, TEXT, FLOAT, DECIMAL, HEX, BOOLEAN = 0x01, 0x02, 0x03, 0x04, 0x10, 0x11, 0x12
NONE = 0xFFFFFFFF

Event = tuple[str, str, dict[str, str]]


class MalformedXml(ValueError):
    pass


def _named(uri: str | None, name: str) -> str:
    return name if not uri else f"android:{name}" if uri == ANDROID else f"{{{uri}}}{name}"


def _plain_events(raw: bytes) -> Iterator[Event]:
    for event, node in ElementTree.iterparse(io.BytesIO(raw), ("start", "end")):
        tagged = lambda key: _named(*key[1:].split("}", 1)) if key[:1] == "{" else key
        yield event, tagged(node.tag), {tagged(k): v for k, v in node.attrib.items()} if event == "start" else {}


def _length(raw: bytes, at: int, wide: bool) -> tuple[int, int]:
    """A text's length and where it ends: one or two units, the first with its top bit set if there are two."""
    size, top = (2, 0x8000) if wide else (1, 0x80)
    first = int.from_bytes(raw[at : at + size], "little")
    if not first & top:
        return first, at + size
    return (first & top - 1) << 8 * size | int.from_bytes(raw[at + size : at + 2 * size], "little"), at + 2 * size


def _pool(raw: bytes, base: int) -> list[str]:
    count, _, flags, start = struct.unpack_from("<4I", raw, base + 8)
    if count > len(raw) // 4:
        raise MalformedXml("more texts than bytes")
    out = []
    for offset in struct.unpack_from(f"<{count}I", raw, base + 28):
        at = base + start + offset
        if at >= len(raw):
            raise MalformedXml("a text lies beyond the end")
        n, at = _length(raw, at, not flags & 0x100)
        if flags & 0x100:
            n, at = _length(raw, at, False)
            out.append(raw[at : at + n].decode("utf-8", "replace"))
        else:
            out.append(raw[at : at + 2 * n].decode("utf-16-le", "replace"))
    return out


def _value(kind: int, data: int, texts: list[str]) -> str:
    if kind == TEXT:
        return texts[data] if data < len(texts) else ""
    if kind == BOOLEAN:
        return "true" if data else "false"
    if kind == DECIMAL:
        return str(data - (data >> 31 << 32))
    if kind == HEX:
        return hex(data)
    if kind in (REFERENCE, ATTRIBUTE):
        return f"{'@' if kind == REFERENCE else '?'}0x{data:08x}"
    return str(struct.unpack("<f", struct.pack("<I", data))[0]) if kind == FLOAT else str(data)


def _binary_events(raw: bytes) -> Iterator[Event]:
    end = struct.unpack_from("<I", raw, 4)[0]
    end, at, texts, tags = min(end or len(raw), len(raw)), 8, [], []
    text = lambda ref: texts[ref] if ref < len(texts) else None
    while at + 8 <= end:
        kind, _, size = struct.unpack_from("<HHI", raw, at)
        if size < 8 or at + size > len(raw):
            raise MalformedXml("a chunk of no such size")
        if kind == POOL:
            texts = _pool(raw, at)
        elif kind == START:
            name, start, step, count = struct.unpack_from("<I3H", raw, at + 20)
            attrs = {}
            for k in range(count):
                uri, local, given, _, _, of, data = struct.unpack_from("<3IHBBI", raw, at + 16 + start + k * step)
                if text(local):
                    attrs[_named(text(uri), text(local))] = text(given) if of == TEXT and text(given) is not None else _value(of, data, texts)
            tags.append(text(name) or "")
            yield "start", tags[-1], attrs
        elif kind == END and tags:
            yield "end", tags.pop(), {}
        at += size


def is_binary(raw: bytes) -> bool:
    return raw[:4] == b"\x03\x00\x08\x00" and len(raw) >= 8


def read(raw: bytes | None) -> tuple[str, str | None, list[tuple[int, int, str, dict[str, str]]]]:
    """Status, format and elements (place, place of the parent or -1, tag, attributes) of a manifest."""
    if not raw:
        return "missing", None, []
    if is_binary(raw):
        events, form, broken = _binary_events(raw), "binary_axml", "malformed_axml"
    elif raw.lstrip()[:1] == b"<":
        events, form, broken = _plain_events(raw), "plain_xml", "malformed_xml"
    else:
        return "unsupported_binary_xml", "binary_axml", []
    found, above = [], [-1]
    try:
        for event, tag, attrs in events:
            if event == "start":
                found.append((len(found), above[-1], tag, attrs))
                above.append(len(found) - 1)
            elif len(above) > 1:
                above.pop()
    except (MalformedXml, struct.error, ElementTree.ParseError):
        return broken, form, []
    return ("parsed", form, found) if found else (broken, form, [])


def located(archives: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """S3: path and manifest of archives: the first entry that is a manifest, at the root or in a folder manifest; null without one."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, blob in zip(batch["path"], batch["content"]):
                manifest = None
                try:
                    with zipfile.ZipFile(io.BytesIO(blob or b"")) as z:
                        inside = [n for n in z.namelist() if n == "AndroidManifest.xml" or n.endswith("/manifest/AndroidManifest.xml")]
                        manifest = z.read(inside[0]) if inside else None
                except zipfile.BadZipFile:
                    pass
                out.append((name, manifest))
            yield pd.DataFrame(out, columns=["path", "manifest"])

    return archives.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInPandas(find, "path string, manifest binary")


def elements(manifests: DataFrame, path: str = "path", manifest: str = "manifest") -> DataFrame:
    """A row per element; a manifest without any has one row, whose ord is null."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ELEMENTS.split(", ")]
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["manifest"]):
                status, form, found = read(None if raw is None else bytes(raw))
                rows += [(name, status, form, *element) for element in found] or [(name, status, form, None, None, None, None)]
            yield pd.DataFrame(rows, columns=names).astype({"ord": "Int32", "parent": "Int32"})

    return manifests.select(F.col(path).cast("string").alias("path"), F.col(manifest).alias("manifest")).mapInPandas(parse, ELEMENTS)


def _flag(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1")


def headers(found: DataFrame) -> DataFrame:
    """A row per manifest, of the root, its first uses-sdk and its first application."""
    a = lambda name: F.col("attrs")[f"android:{name}"]
    root, under = F.col("parent") == -1, F.col("parent") == 0
    first = lambda when, value: F.min_by(value, F.when(when, F.col("ord")))
    sdk, app = under & (F.col("tag") == "uses-sdk"), under & (F.col("tag") == "application")
    return found.groupBy("path").agg(
        F.first("status").alias("status"), F.first("source_format").alias("source_format"), first(root, F.col("attrs")["package"]).alias("package"), first(root, a("versionName")).alias("version_name"),
        first(root, a("versionCode")).alias("version_code"), first(root, a("compileSdkVersion")).alias("compile_sdk"), first(sdk, a("minSdkVersion")).alias("min_sdk"), first(sdk, a("targetSdkVersion")).alias("target_sdk"),
        first(app, _flag(a("debuggable"))).alias("debuggable"), first(app, _flag(a("allowBackup"))).alias("allow_backup"), first(app, _flag(a("usesCleartextTraffic"))).alias("cleartext"), first(app, a("networkSecurityConfig")).alias("network_security_config"),
    )


def permissions(found: DataFrame) -> DataFrame:
    """Path, name, whether the manifest declares it itself, and its class and group (P2); names are needed."""
    name = F.col("attrs")["android:name"]
    own = found.where((F.col("parent") == 0) & F.col("tag").isin("uses-permission", "permission") & (F.coalesce(name, F.lit("")) != ""))
    return own.select("path", name.alias("name"), (F.col("tag") == "permission").alias("declared"), ranks.permission_class(name).alias("class"), ranks.permission_group(name).alias("group"))


def components(found: DataFrame, kinds: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """The components of the first application with their filters counted and who can reach them."""
    a = lambda name: F.col("attrs")[f"android:{name}"]
    app = found.where((F.col("parent") == 0) & (F.col("tag") == "application")).groupBy("path").agg(F.min("ord").alias("parent"))
    own = found.where(F.col("tag").isin(*kinds)).join(app, ["path", "parent"])
    filters = found.where("tag = 'intent-filter'").groupBy("path", F.col("parent").alias("ord")).agg(F.count("*").alias("n_filters"))
    each = own.join(filters, ["path", "ord"], "left").select(
        "path", "ord", F.col("tag").alias("kind"), a("name").alias("name"), _flag(a("exported")).alias("exported"), a("permission").alias("permission"), a("authorities").alias("authorities"),
        a("process").alias("process"), _flag(a("enabled")).alias("enabled"), F.coalesce("n_filters", F.lit(0).cast("long")).alias("n_filters"),
    )
    state = ranks.exposure(F.col("exported"), F.col("n_filters") > 0, F.col("kind"))
    return each.withColumn("exposure", state).withColumn("effective_exported", F.col("exposure").isin("EXPORTED", "CONDITIONALLY_EXPORTED"))


def filters(found: DataFrame) -> DataFrame:
    """A row per intent filter: its component's place, and its actions, categories and data, as written and in order."""
    name, attrs = F.col("attrs")["android:name"], F.col("attrs")
    data = F.concat(F.coalesce(attrs["android:scheme"], F.lit("")), F.lit("://"), F.coalesce(attrs["android:host"], F.lit("")), F.coalesce(attrs["android:path"], attrs["android:pathPrefix"], attrs["android:pathPattern"], F.lit("")))
    listed = lambda tag, value: F.transform(F.array_sort(F.collect_list(F.when((F.col("tag") == tag) & value.isNotNull(), F.struct("ord", value.alias("v"))))), lambda x: x["v"])
    inside = found.groupBy("path", F.col("parent").alias("filter")).agg(listed("action", name).alias("actions"), listed("category", name).alias("categories"), listed("data", data).alias("data"))
    own = found.where("tag = 'intent-filter'").select("path", F.col("ord").alias("filter"), F.col("parent").alias("component"))
    none = F.array().cast("array<string>")
    return own.join(inside, ["path", "filter"], "left").select("path", "component", "filter", *(F.coalesce(c, none).alias(c) for c in ("actions", "categories", "data")))

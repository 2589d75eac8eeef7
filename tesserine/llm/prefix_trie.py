r"""Operator 13: the prefix trie of conversations, from padded turn-id matrices over range shards.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, so texts are read once and
never moved. Rebuilt conversations are strings of ids, range-partitioned by (ids, conversation)
into shards of bounded size, which also cuts through a prefix or a whole sequence that many
conversations share. In a shard the ids are numbered and laid out as a matrix, a row per
conversation, padded with zeros, in blocks of COLUMNS columns: numpy's lexsort orders the rows,
and the change of each column against the row before, or-accumulated from left to right, marks
where nodes start. Only runs of rows that are still equal and go on are laid out for the next
block, so one very long conversation doesn't widen the matrix of the others. Then reduceat adds
up each depth over the rows that reach it.

Every figure of a node is a sum over its rows, given how many turns a row shares with the row
before and the row after: a row with more turns starts a child, a row that the next one doesn't
share wholly ends a leaf, and a row saves the words of the turns that it shares. So shards only
need their neighbours' edge rows. Nodes that reach across an edge of a shard, and the root, come
as partial rows with a digest of their prefix as key; these are few, and are folded in order of
shards, streaming the identifiers that end there through one SHA-256.

The turns of one conversation meet in one row, as ids and word counts without texts.

Defined results: null role or text is empty; null turns come first, and rows of one turn go by
the digest of role and text, repeated rows as often as they come; rows without a conversation
form none; an empty table has no nodes, not even a root; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.skew import join_spread
from .common import Scratch, bounded_batches, read_table, text_or_empty

WORDS = r"[^\x20\x09-\x0D]+"
#: Characters of a turn's id.
ID = 32
#: Columns of one padded matrix; turns of one shard, about.
COLUMNS, SHARD_TURNS = 32, 1 << 17
NONE = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PARTS = f"{NODE}, shard int, key string, parent_key string, ends string"
FOLDED = f"{NODE}, key string, parent_key string"


def sequences(turns: DataFrame) -> DataFrame:
    """A row per conversation: conv_id and its turns (turn, id, words) in order."""
    role, text = text_or_empty("role"), text_or_empty("text")
    own = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn"),
            F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, ID).alias("id"),
            F.regexp_count(text, F.lit(WORDS)).alias("words"),
        ).alias("t"),
    )
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame, step: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation with its first turns (fewer than heads) taken from the one whose number step divides."""
    c = F.col("conv_id")
    bases = own.where(c % step == 0).select(c.alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(c.cast("string")) % heads).cast("int")
    joined = own.withColumn("base", c - c % step).join(bases, "base", "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def padded(ids: np.ndarray, at: np.ndarray, lens: np.ndarray, start: int, width: int) -> np.ndarray:
    """Rows of the ids that begin at places at, from column start on, with 0 where a row has ended."""
    column = np.arange(start, start + width)
    inside = column[None, :] < lens[:, None]
    return np.where(inside, ids[np.minimum(at[:, None] + column[None, :], len(ids) - 1)], 0) if len(ids) else np.zeros((len(at), width), ids.dtype)


def in_order(ids: np.ndarray, at: np.ndarray, lens: np.ndarray, conv: np.ndarray, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order by ids, then conv; and how many turns each row in that order shares with the one before (the first: 0)."""
    order, shared = np.arange(len(at)), np.zeros(len(at), np.int64)
    places, run, start = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while len(places):
        rows = order[places]
        matrix = padded(ids, at[rows], lens[rows], start, columns)
        by = np.lexsort((conv[rows], *matrix.T[::-1], run))
        rows, matrix = rows[by], matrix[by]
        order[places] = rows
        head = np.concatenate(([True], run[1:] != run[:-1]))
        changed = np.zeros(matrix.shape, bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        marks = np.logical_or.accumulate(changed, axis=1)
        length = lens[rows]
        least = np.minimum(length, np.concatenate((length[:1], length[:-1])))
        shared[places] = np.where(head, shared[places], np.minimum(start + (~marks).sum(axis=1), least))
        start += columns
        group = np.cumsum(head | marks[:, -1]) - 1
        goes_on, size = np.bincount(group, weights=length > start), np.bincount(group)
        keep = (goes_on[group] > 0) & (size[group] > 1)
        places, run = places[keep], group[keep]
    return order, shared


def _keys(ids: str, most: int) -> list[str]:
    """Digests of the first 0 to most ids of a string of ids."""
    made, digest = [NONE], hashlib.sha256()
    for d in range(most):
        digest.update(ids[d * ID : (d + 1) * ID].encode())
        made.append(digest.copy().hexdigest())
    return made


def _shared(a: str, b: str) -> int:
    """How many ids two strings of ids share from the start."""
    n = min(len(a), len(b)) // ID
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * ID] == b[: mid * ID] else (low, mid - 1)
    return low


def _joined(convs: np.ndarray) -> str:
    return ",".join(map(str, convs.tolist()))


def shard_nodes(shard: int, conv: np.ndarray, seqs: list[str], words: list[list[int]], before: str | None, after: str | None) -> dict[str, list]:
    """The nodes of a shard's rows; those that reach across its edges, and the root, as partial rows with a key."""
    lens = np.array([len(s) // ID for s in seqs], np.int64)
    at = np.concatenate(([0], np.cumsum(lens)[:-1]))
    ids = np.unique(np.frombuffer("".join(seqs).encode(), f"S{ID}"), return_inverse=True)[1].astype(np.int32) + 1
    flat = np.fromiter((w for row in words for w in row), np.int64, int(lens.sum()))
    order, shared = in_order(ids, at, lens, conv)
    conv, lens, at = conv[order], lens[order], at[order]
    first, last = seqs[order[0]], seqs[order[-1]]
    shared[0] = -1 if before is None else _shared(before, first)
    onward = -1 if after is None else _shared(last, after)
    leaf = np.concatenate((shared[1:], [onward])) < lens
    total = np.concatenate(([0], np.cumsum(flat)))
    saved = total[at + np.maximum(shared, 0)] - total[at]
    first_keys, last_keys = _keys(first, max(int(shared[0]), 0)), _keys(last, max(onward, 0))

    out: dict[str, list] = {name.split()[0]: [] for name in PARTS.split(", ")}
    above = np.zeros(len(conv), np.int64)  # of each row: its node's least conversation one depth up
    above_key: np.ndarray = np.full(len(conv), None, object)
    act = np.arange(len(conv))
    for depth in range(int(lens.max(initial=0)) + 1):
        act = act[lens[act] >= depth]
        fresh = shared[act] < depth
        fresh[0] = True
        starts = np.flatnonzero(fresh)
        before_depth = total[at[act] + max(depth - 1, 0)] - total[at[act]]
        n = np.diff(np.append(starts, len(act)))
        group = np.repeat(np.arange(len(starts)), n)
        least = np.minimum.reduceat(conv[act], starts)
        ended = np.add.reduceat((lens[act] == depth).astype(np.int64), starts)
        key: np.ndarray = np.full(len(starts), None, object)
        if depth <= max(int(shared[0]), 0):
            key[0] = first_keys[depth]
        if depth <= max(onward, 0):
            key[-1] = last_keys[depth]
        head = act[starts]
        rows_ended = [conv[act[s : s + e]] if e else None for s, e in zip(starts.tolist(), ended.tolist(), strict=True)]
        out["conv_id"] += least.tolist()
        out["depth"] += [depth] * len(starts)
        out["parent_key"] += above_key[head].tolist()
        out["parent_conv_id"] += [None if k is not None or not depth else c for k, c in zip(above_key[head].tolist(), above[head].tolist(), strict=True)]
        out["n_convs"] += n.tolist()
        out["n_children"] += np.add.reduceat(((lens[act] > depth) & (shared[act] <= depth)).astype(np.int64), starts).tolist()
        out["n_leaves"] += np.add.reduceat(leaf[act].astype(np.int64), starts).tolist()
        out["saved_tokens"] += np.add.reduceat(np.where(shared[act] >= depth, saved[act] - before_depth, 0), starts).tolist()
        out["key"] += key.tolist()
        out["ends"] += [None if k is None or r is None else _joined(r) for k, r in zip(key.tolist(), rows_ended, strict=True)]
        out["ends_sha256"] += [None if k is not None else NONE if r is None else hashlib.sha256(_joined(r).encode()).hexdigest() for k, r in zip(key.tolist(), rows_ended, strict=True)]
        above[act], above_key[act] = least[group], key[group]
    out["shard"] = [shard] * len(out["depth"])
    return out


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _of_shard(rows: pa.Table, edges: pa.Table) -> pa.Table:
    edge = edges.to_pylist()[0]
    made = shard_nodes(edge["shard"], rows["conv_id"].to_numpy(), rows["ids"].to_pylist(), rows["words"].to_pylist(), edge["before"], edge["after"])
    return pa.table(made, schema=_schema(PARTS))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial rows sorted by key and shard, to one row per key."""
    node, digest = None, None
    done: list[dict] = []

    def close() -> None:
        if node is not None:
            done.append(node | {"ends_sha256": digest.hexdigest()})

    for batch in batches:
        for r in batch.to_pylist():
            ends = r.pop("ends")
            if node is None or r["key"] != node["key"]:
                close()
                node, digest, some = r, hashlib.sha256(), False
            else:
                node["conv_id"] = min(node["conv_id"], r["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    node[c] += r[c]
            if ends is not None:
                digest.update((("," if some else "") + ends).encode())
                some = True
        if len(done) >= 4096:
            yield pa.RecordBatch.from_pylist(done, schema=_schema(FOLDED))
            done = []
    close()
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_schema(FOLDED))


def trie(convs: DataFrame, tables: Scratch, shard_turns: int = SHARD_TURNS, shards: int | None = None) -> DataFrame:
    """The nodes of conversations (conv_id, turns as sequences() gives them). Its tables are needed until the result is written."""
    spark = convs.sparkSession
    bounded_batches(spark)
    ids = tables.written(convs.select("conv_id", F.array_join("turns.id", "").alias("ids"), F.col("turns.words").alias("words")), "ids")
    turns = ids.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    ranged = tables.written(ids.repartitionByRange(n, "ids", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    row = F.struct("ids", "conv_id")
    edges = ranged.groupBy("shard").agg(F.min(row)["ids"].alias("first"), F.max(row)["ids"].alias("last"))
    # As many rows as shards, so one window may hold them.
    in_line = Window.orderBy("shard")
    beside = edges.select("shard", F.lag("last").over(in_line).alias("before"), F.lead("first").over(in_line).alias("after"))
    parts = tables.written(ranged.groupBy("shard").cogroup(beside.groupBy("shard")).applyInArrow(_of_shard, PARTS), "parts")
    edge_parts = parts.where(F.col("key").isNotNull()).select(*[c.split()[0] for c in FOLDED.split(", ")], "shard", "ends")
    folded = tables.written(edge_parts.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_folded, FOLDED), "edges")
    nodes = parts.where(F.col("key").isNull()).select(*folded.columns).unionByName(folded)
    below = nodes.where(F.col("parent_key").isNotNull())
    parents = folded.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"), F.col("n_children").alias("n"))
    joined = join_spread(below, parents, "parent_key", "conv_id", below.count()).withColumn("parent_conv_id", F.col("up"))
    names = [c.split()[0] for c in NODE.split(", ")]
    return nodes.where(F.col("parent_key").isNull()).select(*names).unionByName(joined.select(*names))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(sequences(read_table(spark, sf_dir, "conversations"))), Scratch(spark, "prefix-trie"))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce({bits}, lambda a, x: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


OP13_SQL = rf"""
WITH t AS (SELECT conv_id, i, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, i) AS k
  FROM (SELECT conv_id, turn, coalesce(text, '') AS x, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, k, i, words FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL SELECT c.conv_id, 1, k, i, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
s AS (SELECT c.conv_id, coalesce(q, []) AS q, coalesce(ws, []) AS ws FROM c LEFT JOIN (SELECT conv_id, list(i ORDER BY own, k) AS q, list(words ORDER BY own, k) AS ws FROM r GROUP BY conv_id) USING (conv_id)),
p AS (SELECT conv_id, d, len(q) AS n, array_to_string(q[1:d], '') AS key, CASE WHEN d > 0 THEN array_to_string(q[1:d - 1], '') END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS words FROM (SELECT *, unnest(range(0, len(q) + 1)) AS d FROM s)),
g AS (SELECT key, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY key, d),
k AS (SELECT up AS key, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (key)),
u AS (SELECT p.key, sum(CAST(f.n_children = 0 AS BIGINT)) AS n_leaves, sum(f.saved) AS saved_tokens FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.key)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, m.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (key) LEFT JOIN g m ON m.key = f.up
"""

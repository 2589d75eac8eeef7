r"""Operator 12: repair of conversation structure, with Four-Russians block tables.

A conversation is well formed when its roles' initials read (s?(ua)+)?. Edits are Keep (0),
Rerole to user or assistant (2), Delete (3) and Insert of an empty turn (2); rows that are blank or
repeat an earlier one must be deleted, undeleted truncated rows add 1. Which role Rerole and
Insert give follows from what stands before, so a string of edits is a path through the four
states of what stands before: nothing, s, u, a.

A row is one of nine symbols (initial and fault). The costs still to come from each state form a
vector; taken less its least value, only a few vectors exist. block_tables() precomputes, for
each of them and every block of up to BLOCK symbols, the vector before the block and what it
costs, so a conversation is gone through from its end by one lookup a block. Tracing goes
forward: each block's inner vectors are expanded backward from the vector at its end, and of the
edits that keep the cost least the one with the least letter is taken; as letters lead to one
state each, that gives the least string among the cheapest.

Rows are range-partitioned by conversation and turn into shards of bounded size, so a conversation
with a third of all rows lies in many of them. Conversations inside a shard are repaired
there. Those at its ends are cut into pieces, a piece a shard: what the block tables do to every
vector is worked out for each piece, and these short rows (two a shard at most, like the exits of
the four states) are put together on the driver; then pieces are traced side by side. The audit
and the digest of a conversation are one value each, so its pieces are joined as a stream.

Defined results: null role or text is empty (the query damages them to one space first); a null
turn comes first; rows of one turn go by role, then by the digest of role and text; a null
conversation is one; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import join_spread
from .common import Scratch, bounded_batches, read_table, text_or_empty
from .prefix_trie import crc32_sql

SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Symbols of a block.
BLOCK = 4
#: Rows and bytes of a shard, about.
SHARD_ROWS, SHARD_BYTES = 1 << 16, 32 << 20
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Symbols: 2 * initial (s, u, a, other) + truncated; GONE must be deleted.
GONE, SYMBOLS = 8, 9
INITIALS = {"s": 0, "u": 1, "a": 2}
#: By state: what keeping an initial leads to, what an inserted or re-roled turn leads to, and its role.
KEPT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
ENDS = ("", "II", "I", "")
FAULTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
REPAIRED = f"conv_id long, {FAULTS}, audit string, repaired_sha256 string"
RAW = "shard int, idx long, turn long, role string, text string"


def _closed(raw: list[float]) -> tuple[int, ...]:
    """Costs to come from each state, when turns may be inserted first."""
    for _ in range(3):
        raw = [min(c, INSERT + raw[NEXT[q]]) for q, c in enumerate(raw)]
    return tuple(raw)  # type: ignore[return-value]


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    if symbol == GONE:
        return _closed([DELETE + c for c in after])
    initial, late = divmod(symbol, 2)
    return _closed([min([DELETE + after[q], REROLE + late * TRUNCATED + after[NEXT[q]], *([late * TRUNCATED + after[KEPT[q][initial]]] if initial in KEPT[q] else [])]) for q in range(4)])


@functools.cache
def block_tables() -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], int]:
    """The normalised vectors; for blocks of 1 to BLOCK symbols the vector before, and the cost, by vector and block; the last vector."""
    end = _closed([0, float("inf"), float("inf"), 0])
    found, step, cost = {end: 0}, [], []
    for v in (todo := [end]):
        step.append([])
        cost.append([])
        for x in range(SYMBOLS):
            b = _before(v, x)
            least = min(b)
            b = tuple(c - least for c in b)
            if b not in found:
                found[b] = len(found)
                todo.append(b)
            step[-1].append(found[b])
            cost[-1].append(least)
    steps, costs = [np.array(step)], [np.array(cost)]
    for _ in range(BLOCK - 1):
        to, paid = steps[-1], costs[-1]
        steps.append(np.concatenate([steps[0][to, x] for x in range(SYMBOLS)], axis=1))
        costs.append(np.concatenate([costs[0][to, x] + paid for x in range(SYMBOLS)], axis=1))
    return np.array(todo), steps, costs, 0


def blocks_of(symbols: np.ndarray) -> list[tuple[int, int]]:
    """The blocks of a row of symbols in order, each as length and number; only the first may be shorter than BLOCK."""
    head = len(symbols) % BLOCK
    number = lambda part: int(part @ SYMBOLS ** np.arange(len(part))[::-1])
    full = symbols[head:].reshape(-1, BLOCK).astype(np.int64) @ SYMBOLS ** np.arange(BLOCK)[::-1]
    return ([(head, number(symbols[:head].astype(np.int64)))] if head else []) + [(BLOCK, b) for b in full.tolist()]


def backward(blocks: list[tuple[int, int]], vector: int) -> tuple[list[int], int]:
    """The vector at each block's end, then at the start, by lookups; and the cost that was taken off them."""
    _, steps, costs, _ = block_tables()
    at, total = [vector], 0
    for n, b in reversed(blocks):
        total += int(costs[n - 1][at[-1], b])
        at.append(int(steps[n - 1][at[-1], b]))
    return at[::-1], total


def backward_all(blocks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For every vector at the end: the vector at the start, and the cost."""
    vectors, steps, costs, _ = block_tables()
    at, total = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    for n, b in reversed(blocks):
        total += costs[n - 1][at, b]
        at = steps[n - 1][at, b]
    return at, total


@functools.lru_cache(1 << 16)
def block_edits(n: int, block: int, vector: int, state: int) -> tuple[str, int]:
    """The edits of a block entered in a state, with the vector at its end; and the state after it."""
    vectors, steps, costs, _ = block_tables()
    symbols = [block // SYMBOLS**k % SYMBOLS for k in range(n - 1, -1, -1)]
    inner, v, off = [vectors[vector].tolist()], vector, 0
    for x in reversed(symbols):
        off += int(costs[0][v, x])
        v = int(steps[0][v, x])
        inner.append((vectors[v] + off).tolist())
    inner.reverse()
    edits, q, i = "", state, 0
    while i < n:
        here, after, x = inner[i], inner[i + 1], symbols[i]
        late = TRUNCATED * (x % 2) if x != GONE else 0
        if here[q] == DELETE + after[q]:
            edits, i = edits + "D", i + 1
        elif here[q] == INSERT + here[NEXT[q]]:
            edits, q = edits + "I", NEXT[q]
        elif x // 2 in KEPT[q] and x != GONE and here[q] == late + after[KEPT[q][x // 2]]:
            edits, q, i = edits + "K", KEPT[q][x // 2], i + 1
        else:
            edits, q, i = edits + "R", NEXT[q], i + 1
    return edits, q


def edits_of(blocks: list[tuple[int, int]], vectors: list[int], state: int) -> tuple[str, int]:
    """The edits of a row of blocks, with the vectors at their ends; and the state after them."""
    made = []
    for (n, b), v in zip(blocks, vectors, strict=True):
        part, state = block_edits(n, b, v, state)
        made.append(part)
    return "".join(made), state


def repaired_lines(edits: str, roles: list[str], texts: list[str], state: int) -> list[str]:
    lines, q, i = [], state, 0
    for e in edits:
        if e == "I":
            lines.append(f"{ROLE[q]}:")
            q = NEXT[q]
            continue
        if e == "K":
            lines.append(f"{roles[i]}:{texts[i]}")
            q = KEPT[q][INITIALS[roles[i][0]]]
        elif e == "R":
            lines.append(f"{ROLE[q]}:{texts[i]}")
            q = NEXT[q]
        i += 1
    return lines


def symbols_of(roles: list[str], texts: list[str], repeated: list[bool]) -> tuple[np.ndarray, dict[str, int]]:
    """A symbol per row, and how many rows have each fault."""
    count, made = {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for role, text, again in zip(roles, texts, repeated, strict=True):
        said = text.rstrip(SPACE)
        fault = "blank" if not said else "duplicate" if again else "truncated" if said[-1] not in STOPS else None
        if fault:
            count[fault] += 1
        made.append(GONE if fault in ("blank", "duplicate") else 2 * INITIALS.get(role[:1], 3) + (fault == "truncated"))
    return np.array(made, np.uint8), count


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def repaired_rows(turns: list[int | None], roles: list[str], texts: list[str]) -> dict:
    """One conversation, all of whose rows are given in order."""
    seen: set[tuple[str, str]] = set()
    repeated = []
    for pair in zip(roles, texts, strict=True):
        repeated.append(pair in seen)
        seen.add(pair)
    symbols, count = symbols_of(roles, texts, repeated)
    blocks, (vectors, _, _, end) = blocks_of(symbols), block_tables()
    at, cost = backward(blocks, end)
    edits, state = edits_of(blocks, at[1:], 0)
    edits += ENDS[state]
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    digest = hashlib.sha256("\n".join(repaired_lines(edits, roles, texts, 0)).encode()).hexdigest()
    return {"gaps": gaps, **count, "illegal": illegal_pairs(roles), "cost": cost + int(vectors[at[0]][0]), "audit": edits, "repaired_sha256": digest}


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")])


def _of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's sorted rows: conversations inside it come repaired, those at its ends as the rows they are."""
    schema, from_shard = _schema(f"{REPAIRED}, {RAW}"), None
    own: list[dict] = []
    first, out, idx = True, [], 0
    empty = dict.fromkeys(schema.names)
    for batch in batches:
        for r in batch.to_pylist():
            if own and r["conv_id"] != own[0]["conv_id"]:
                if not first:
                    made = repaired_rows([x["turn"] for x in own], [x["role"] for x in own], [x["text"] for x in own])
                    out.append(empty | {"conv_id": own[0]["conv_id"]} | made)
                first, own = False, []
            idx += 1
            r["idx"] = idx
            if first:
                out.append(empty | r)
                own = [r]
            else:
                own.append(r)
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if not first:
        out += [empty | r for r in own]
    for k in range(0, len(out), 4096):
        yield pa.RecordBatch.from_pylist(out[k : k + 4096], schema=schema)


PIECE = "conv_id long, shard int, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, n_turns long, to string, paid string"


def _pieces(rows: pa.Table) -> Iterator[tuple[int | None, int, dict[str, list], np.ndarray, dict[str, int]]]:
    """The pieces of a shard's rows: conversation, shard, columns in order, symbols, faults."""
    rows = rows.sort_by("idx")
    columns = rows.to_pydict()
    conv, n = columns["conv_id"], len(rows)
    cuts = [k for k in range(n) if not k or conv[k] != conv[k - 1]]
    for a, b in zip(cuts, [*cuts[1:], n], strict=True):
        part = {c: columns[c][a:b] for c in ("turn", "role", "text", "repeated")}
        yield conv[a], columns["shard"][a], part, *symbols_of(part["role"], part["text"], part["repeated"])


def _summed(rows: pa.Table) -> pa.Table:
    out = []
    for conv, shard, part, symbols, count in _pieces(rows):
        to, paid = backward_all(blocks_of(symbols))
        known = sorted({t for t in part["turn"] if t is not None})
        ends = {"first_turn": known[0], "last_turn": known[-1]} if known else {"first_turn": None, "last_turn": None}
        numbers = lambda a: " ".join(map(str, a.tolist()))
        roles = part["role"]
        out.append({"conv_id": conv, "shard": shard, **count, "illegal": illegal_pairs(roles), "first_role": roles[0][:1], "last_role": roles[-1][:1], **ends, "n_turns": len(known), "to": numbers(to), "paid": numbers(paid)})
    return pa.Table.from_pylist(out, schema=_schema(PIECE))


def _exits(ends: dict):
    def of(rows: pa.Table) -> pa.Table:
        out = []
        for conv, shard, _, symbols, _ in _pieces(rows):
            blocks = blocks_of(symbols)
            at, _ = backward(blocks, ends[conv, shard])
            out.append({"conv_id": conv, "shard": shard} | {f"q{q}": edits_of(blocks, at[1:], q)[1] for q in range(4)})
        return pa.Table.from_pylist(out, schema=_schema("conv_id long, shard int, q0 int, q1 int, q2 int, q3 int"))

    return of


def _traced(ends: dict, entries: dict, last: set):
    def of(rows: pa.Table) -> pa.Table:
        out = []
        for conv, shard, part, symbols, _ in _pieces(rows):
            blocks, state = blocks_of(symbols), entries[conv, shard]
            at, _ = backward(blocks, ends[conv, shard])
            edits, after = edits_of(blocks, at[1:], state)
            edits += ENDS[after] if (conv, shard) in last else ""
            lines = repaired_lines(edits, part["role"], part["text"], state)
            out.append({"conv_id": conv, "shard": shard, "edits": edits, "lines": "\n".join(lines) if lines else None})
        return pa.Table.from_pylist(out, schema=_schema("conv_id long, shard int, edits string, lines string"))

    return of


def _rejoined(totals: dict):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces sorted by conversation and shard, to one row per conversation; texts only pass through the digest."""
        own, digest, audit, some, began = None, hashlib.sha256(), [], False, False
        close = lambda: pa.RecordBatch.from_pylist([{"conv_id": own, **totals[own], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], schema=_schema(REPAIRED))
        for batch in batches:
            for r in batch.to_pylist():
                if not began or r["conv_id"] != own:
                    if began:
                        yield close()
                    own, digest, audit, some, began = r["conv_id"], hashlib.sha256(), [], False, True
                audit.append(r["edits"])
                if r["lines"] is not None:
                    digest.update((("\n" if some else "") + r["lines"]).encode())
                    some = True
        if began:
            yield close()

    return of


def _put_together(pieces: list, end: int) -> tuple[dict, dict, dict]:
    """From the pieces' short rows: each one's vector at its end, each conversation's pieces in order, and its totals."""
    vectors = block_tables()[0]
    of: dict = {}
    for p in sorted(pieces, key=lambda p: p["shard"]):
        of.setdefault(p["conv_id"], []).append(p)
    ends, totals = {}, {}
    for conv, own in of.items():
        v, cost = end, 0
        for p in reversed(own):
            ends[conv, p["shard"]] = v
            cost += int(p["paid"].split(" ")[v])
            v = int(p["to"].split(" ")[v])
        total = {c: sum(p[c] for p in own) for c in ("blank", "duplicate", "truncated", "illegal")}
        total["illegal"] += sum(a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        known = [p for p in own if p["n_turns"]]
        twice = sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
        gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - (sum(p["n_turns"] for p in known) - twice) if known else 0
        totals[conv] = {"gaps": gaps, **total, "cost": cost + int(vectors[v][0])}
    return ends, of, totals


def repaired(rows: DataFrame, tables: Scratch, shards: int | None = None) -> DataFrame:
    """A row per conversation of rows (conv_id, turn, role, text): its faults, edits and repaired text's digest. Its tables are needed until the result is written."""
    spark = rows.sparkSession
    bounded_batches(spark)
    role, text = text_or_empty("role"), text_or_empty("text")
    told = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    told = told.withColumn("print", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    size = told.agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes")).first()
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size.n // SHARD_ROWS), -(-(size.bytes or 0) // SHARD_BYTES))
    by = ("conv_id", "turn", "role", "print")
    dealt = told.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(n, *by, "nth").sortWithinPartitions(*by).drop("nth", "print")
    numbered = dealt.withColumn("shard", F.spark_partition_id())
    split = tables.written(numbered.mapInArrow(_of_shard, f"{REPAIRED}, {RAW}"), "shards")
    whole = [c.split()[0] for c in REPAIRED.split(", ")]
    inside = split.where(F.col("shard").isNull()).select(*whole)

    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), F.sha2(F.concat("role", "text"), 256))
    edge = split.where(F.col("shard").isNotNull()).select("conv_id", "shard", "idx", "turn", "role", "text", key.alias("key"))
    place = F.struct("shard", "idx")
    firsts = edge.groupBy("key").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    marked = join_spread(edge, firsts, "key", "idx", edge.count(), how="left").withColumn("repeated", F.coalesce(place > F.col("first"), F.lit(False)))
    edge = tables.written(marked.drop("key", "first"), "edges")
    by_shard = edge.groupBy("shard")
    end = block_tables()[3]
    ends, of, totals = _put_together([r.asDict() for r in by_shard.applyInArrow(_summed, PIECE).collect()], end)
    exits = {(r.conv_id, r.shard): r for r in by_shard.applyInArrow(_exits(ends), "conv_id long, shard int, q0 int, q1 int, q2 int, q3 int").collect()}
    entries, last = {}, set()
    for conv, own in of.items():
        state = 0
        for p in own:
            entries[conv, p["shard"]] = state
            state = exits[conv, p["shard"]][f"q{state}"]
        last.add((conv, own[-1]["shard"]))
    traced = by_shard.applyInArrow(_traced(ends, entries, last), "conv_id long, shard int, edits string, lines string")
    joined = traced.repartition("conv_id").sortWithinPartitions("conv_id", "shard").mapInArrow(_rejoined(totals), REPAIRED)
    return inside.unionByName(joined)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with nulls as one space, and a twentieth each dropped, emptied, unstopped, repeated, or given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    told = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return told.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def with_all(conversations: DataFrame, made: DataFrame) -> DataFrame:
    """A row for every conversation there was, also where no row of it is left."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    joined = ids.join(made, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    names = [c.split()[0] for c in REPAIRED.split(", ")[1:]]
    return joined.select(F.col("id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(none.get(c, 0))).alias(c) for c in names])


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return with_all(conversations, repaired(damaged(conversations), Scratch(spark, "structure-repair")))


OP12_SQL = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS x,
  {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations),
m AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x,
  unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || x), copy) AS i FROM m),
f AS (SELECT *, CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, x ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
ins(q, q2, made, paid, lines) AS (VALUES (0, 0, '', 0, []), (0, 2, 'I', 2, ['user:']), (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 1, '', 0, []), (1, 2, 'I', 2, ['user:']), (1, 3, 'II', 4, ['user:', 'assistant:']),
  (2, 2, '', 0, []), (2, 3, 'I', 2, ['assistant:']), (2, 2, 'II', 4, ['assistant:', 'user:']), (3, 3, '', 0, []), (3, 2, 'I', 2, ['user:']), (3, 3, 'II', 4, ['user:', 'assistant:'])),
row(q2, edit, initial, q3, price, given) AS (VALUES (0, 'D', '', 0, 3, ''), (1, 'D', '', 1, 3, ''), (2, 'D', '', 2, 3, ''), (3, 'D', '', 3, 3, ''), (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''),
  (3, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''), (0, 'R', '', 2, 2, 'user'), (1, 'R', '', 2, 2, 'user'), (3, 'R', '', 2, 2, 'user'), (2, 'R', '', 3, 2, 'assistant')),
w(conv_id, i, q, cost, audit, lines) AS (SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '', CAST([] AS VARCHAR[]) FROM s
  UNION ALL SELECT w.conv_id, w.i + 1, q3, cost + paid + price + CASE WHEN fault = 't' AND edit <> 'D' THEN 1 ELSE 0 END, audit || made || edit,
    w.lines || ins.lines || CASE edit WHEN 'K' THEN [role || ':' || x] WHEN 'R' THEN [given || ':' || x] ELSE [] END
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ins ON ins.q = w.q JOIN row ON row.q2 = ins.q2 AND (edit = 'D' OR fault NOT IN ('b', 'd')) AND (edit <> 'K' OR left(role, 1) = initial)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id, q3 ORDER BY cost + paid + price + CASE WHEN fault = 't' AND edit <> 'D' THEN 1 ELSE 0 END, audit || made || edit) = 1),
e AS (SELECT w.conv_id, cost + paid AS cost, audit || made AS audit, w.lines || ins.lines AS lines FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i JOIN ins ON ins.q = w.q AND ins.q2 IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY cost + paid, audit || made) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

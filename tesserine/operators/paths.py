"""Path questions over edge tables (G3-G5, G9, G15, G17, A7, W6, W7): no cut at a number of nodes, no walks that can't end.

shortest_paths() goes backward from the targets. A node's state is a set of targets, as words of 64
bits in rows (node, word, bits), so a step is one join with the arcs and a bit_or; what a step adds
is kept as the level of that distance. Paths are built only for the hits, from the starts on, by
the least next node among those whose level holds the target: next hops belong to (node, target),
so they are worked out once for all starts.

k_paths() goes forward by length and keeps, of partial paths that have the same start and last node
and have passed the same nodes to which they may still come back, only the k least: any way on is
open to all of them or to none, so the k least paths of each pair survive; up to a length that the
question names all are kept. Partial paths from which
no target can be reached any more in the nodes left are dropped; pairs that have k paths are done,
and the search ends when all are, or when enough paths are found in all.

forward_paths() is for questions in which starts reach few nodes before targets end their ways. It goes
forward from the starts; a state is the least path of a start to a node, and nodes' arcs are lists, so a
step is one join and one aggregate. What a step finds at targets isn't written but worked out when the
result is read, from the states of the step before; only of starts that go on is it noted what they have.

In all a target ends its path, and paths of equal length go by their nodes in text order, which
takes keys without characters below the space.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.lineage import kept, kept_counted
from ..functions.skew import sent

SEPARATOR = " > "
NAMES = ("UNKNOWN", "LOW", "MEDIUM", "HIGH", "EXACT")
#: Nodes of a path at most, as bounded questions have it unless they say otherwise.
DEPTH = 25
#: What makes a start that is a target itself another node, so that its own path may begin there.
AWAY = " start"


def rank_of(c: str = "confidence") -> Column:
    return ranks.ranked(F.col(c), ranks.CONFIDENCE_RANK, -1)


def named_rank(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), rank + 2)


def selected(edges: DataFrame, kinds: tuple[str, ...] | None = None, least: str | None = None) -> DataFrame:
    """The edges of some types, of a confidence or a better one."""
    out = edges.where(F.col("edge_type").isin(*kinds)) if kinds else edges
    return out.where(rank_of() >= ranks.CONFIDENCE_RANK[least]) if least else out


def with_open_ends(edges: DataFrame, nodes: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and targets when calls (src, dst) whose callee is no node are endpoints of their own, unresolved:dst."""
    known = nodes.select(F.col("node_key").alias("dst"))
    open_calls = calls.join(known, "dst", "left_anti").select("src", F.concat(F.lit("unresolved:"), F.coalesce("dst", F.lit("UNKNOWN"))).alias("dst"))
    named = open_calls.select("src", "dst", F.lit("CALLS").alias("edge_type"), F.lit("UNKNOWN").alias("confidence")).distinct()
    return edges.select("src", "dst", "edge_type", "confidence").unionByName(named), named.select(F.col("dst").alias("node_key")).distinct()


def _graph(edges: DataFrame, starts: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arcs (src, dst, rank) none of which leaves a target, starts (start, node) and targets (node, target_n)."""
    aims = kept(targets.select(F.col("node_key").alias("node")).distinct().withColumn("target_n", F.monotonically_increasing_id()), "aims")
    own = aims.select(F.col("node").alias("src"), F.lit(True).alias("own"))
    begin = starts.select(F.col("node_key").alias("start")).distinct().join(own.withColumnRenamed("src", "start"), "start", "left")
    begin = kept(begin.select("start", F.when(F.col("own"), F.concat("start", F.lit(AWAY))).otherwise(F.col("start")).alias("node")), "starts")
    # Where a start is a target, its arcs leave from its other name.
    ways = edges.groupBy("src", "dst").agg(F.max(rank_of()).alias("rank")).where("src <> dst").join(own, "src", "left")
    away = begin.where("start <> node").select(F.col("start").alias("src"), F.col("node").alias("away"))
    ways = ways.join(away, "src", "left").withColumn("src", F.when(F.col("own"), F.col("away")).otherwise(F.col("src")))
    return kept(ways.where("src IS NOT NULL").select("src", "dst", "rank"), "arcs"), begin, aims


def _set_bits() -> Column:
    """The targets of a word's bits, as numbers; a table gives the bits of a byte."""
    of_byte = F.from_json(F.lit(json.dumps([[i for i in range(8) if byte >> i & 1] for byte in range(256)])), "array<array<int>>")
    byte = lambda k: (F.call_function("shiftright", F.col("bits"), k * 8).bitwiseAND(F.lit(255).cast("long")) + 1).cast("int")
    places = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.element_at(of_byte, byte(k)), lambda i: k * 8 + i)))
    return F.explode(F.transform(places, lambda i: F.col("word") * 64 + i)).alias("target_n")


def _bits_of(rows: DataFrame, *by: str) -> DataFrame:
    """(by, target_n) as (by, word, bits). A table gives the bit of a number, as shifts take constants only."""
    powers = F.from_json(F.lit(json.dumps([1 << i if i < 63 else -(1 << 63) for i in range(64)])), "array<long>")
    return rows.groupBy(*by, F.floor(F.col("target_n") / 64).alias("word")).agg(F.bit_or(F.element_at(powers, (F.col("target_n") % 64 + 1).cast("int"))).alias("bits"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def levels_to(arcs: DataFrame, aims: DataFrame, most: int) -> DataFrame:
    """Rows (node, left, word, bits): the targets of aims (node, target_n) that are so many steps from the node."""
    frontier = _bits_of(aims, "node")
    levels = [frontier.withColumn("left", F.lit(0))]
    for d in range(1, most + 1):
        came = arcs.join(frontier, arcs["dst"] == frontier["node"]).groupBy(F.col("src").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        old = _union(levels).groupBy("node", "word").agg(F.bit_or("bits").alias("old"))
        fresh = came.join(old, ["node", "word"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0))))).where("bits <> 0").drop("old")
        frontier, n = kept_counted(fresh, "level")
        if not n:
            break
        levels.append(frontier.withColumn("left", F.lit(d)))
    return _union(levels)


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_nodes: int = DEPTH) -> DataFrame:
    """Per start and target the shortest path, the first in text order among equals, with its weakest confidence."""
    arcs, begin, aims = _graph(edges, starts, targets)
    at = levels_to(arcs, aims, max_nodes - 1)
    hits = at.where("left > 0").join(begin, "node").select("start", "node", "left", _set_bits())
    paths, n = kept_counted(hits.select("start", "node", "target_n", "left", F.col("start").alias("path"), (F.col("left") + 1).alias("length"), F.lit(9).alias("weakest")), "paths")
    near = at.select(F.col("node").alias("u"), (F.col("left") + 1).alias("left"), "word", "bits")
    ways = arcs.select(F.col("src").alias("v"), F.col("dst").alias("u"), "rank")
    found = [paths.where("left = 0")]
    while n:
        # The next hop of each (node, target) that some path stands at: the least node that is one step nearer.
        asked = _bits_of(paths.select("node", "left", "target_n").distinct(), "node", "left").withColumnsRenamed({"node": "v", "bits": "asked"})
        both = asked.join(ways, "v").join(near, ["u", "left", "word"]).withColumn("bits", F.col("bits").bitwiseAND(F.col("asked"))).where("bits <> 0")
        hop = both.select(F.col("v").alias("node"), "left", "u", "rank", _set_bits()).groupBy("node", "left", "target_n").agg(F.min(F.struct("u", "rank")).alias("hop"))
        onward = paths.join(hop, ["node", "left", "target_n"])
        path = F.concat("path", F.lit(SEPARATOR), "hop.u").alias("path")
        step = onward.select("start", F.col("hop.u").alias("node"), "target_n", (F.col("left") - 1).alias("left"), path, "length", F.least("weakest", "hop.rank").alias("weakest"))
        made, n = kept_counted(step, "paths", F.col("left") > 0)
        found.append(made.where("left = 0"))
        paths = made.where("left > 0")
    return _union(found).where(F.col("start") != F.col("node")).select("start", F.col("node").alias("target"), "path", "length", named_rank(F.col("weakest")).alias("confidence"))


#: Arcs in one list; states of a start in one step with which its candidates are merged before they meet.
LIST, BUSY = 1024, 1000


def _arc_lists(edges: DataFrame, aims: DataFrame, n_aims: int, begin: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Lists (src, aim, dsts, ranks) of the arcs from nodes to targets that are asked for (aim), and of those to nodes that are no target.

    aims: node, wanted. Arcs that leave a target are left out, but where it is a start they leave from its other name (begin).
    """
    ways = edges.where("src <> dst").select("src", "dst", rank_of().cast("tinyint").alias("rank"))
    ways = ways.join(sent(aims.withColumnRenamed("node", "dst"), n_aims), "dst", "left").where("coalesce(wanted, true)").repartition("src")
    ways = ways.groupBy("src", "dst").agg(F.max("rank").alias("rank"), F.first("wanted").isNotNull().alias("aim"))
    ways = ways.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("src", "aim").orderBy("dst")) - 1) / LIST))
    lists = ways.groupBy("src", "aim", "part").agg(F.collect_list(F.struct("dst", "rank")).alias("arcs")).select("src", "aim", F.col("arcs.dst").alias("dsts"), F.col("arcs.rank").alias("ranks"))
    if nodes is not None:
        lists = lists.join(nodes.select(F.col("node_key").alias("src")).distinct(), "src", "left_semi")
    own = sent(aims.select(F.col("node").alias("src"), F.lit(True).alias("own")), n_aims)
    away = begin.where("away <> origin").select(F.col("origin").alias("src"), "away").distinct()
    lists = lists.join(own, "src", "left").join(away, "src", "left")
    return kept(lists.withColumn("src", F.when(F.col("own"), F.col("away")).otherwise(F.col("src"))).where("src IS NOT NULL").drop("own", "away"), "lists")


def _least(frontier: DataFrame, busy: DataFrame, n_busy: int, lists: DataFrame) -> DataFrame:
    """The least paths (start, node, path, weakest) one arc on from states (start, node, path, weakest), with the path's origin where states have it.

    Starts with few states are dealt as they are, with the lists; those of busy are merged in every task first.
    """
    origin = ["origin"] if "origin" in frontier.columns else []

    def stepped(rows: DataFrame, deal: bool) -> DataFrame:
        met = rows.join(lists.withColumnRenamed("src", "node"), "node").drop("node")
        met = met.repartition("start") if deal else met
        each = met.select("start", *origin, "path", "weakest", "ranks", F.posexplode("dsts").alias("i", "node"))
        first = each.groupBy("start", "node").agg(F.min(F.struct("path", F.least("weakest", F.get("ranks", F.col("i"))).alias("weakest"), *origin)).alias("r"))
        return first.select("start", "node", *(f"r.{c}" for c in origin), F.concat("r.path", F.lit(SEPARATOR), "node").alias("path"), "r.weakest")

    if not n_busy:
        return stepped(frontier, True)
    named = sent(busy, n_busy)
    return stepped(frontier.join(named, "start", "left_anti"), True).unionByName(stepped(frontier.join(named, "start", "left_semi"), False))


def forward_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_nodes: int = DEPTH, nodes: DataFrame | None = None) -> DataFrame:
    """What shortest_paths() gives, by going forward: for starts that reach few nodes before a target ends each way.

    targets may have a column wanted: paths end at all of them, and those to a wanted one are given.
    starts may have a column family: then of each family and target the least path of all its starts is
    given, as (family, start, target, ...). With nodes (node_key), arcs that leave another node are none.
    """
    families = "family" in starts.columns
    wanted = F.bool_or("wanted") if "wanted" in targets.columns else F.lit(True)
    aims, n_aims = kept_counted(targets.where("node_key IS NOT NULL").groupBy(F.col("node_key").alias("node")).agg(wanted.alias("wanted")), "aims")
    begin = starts.where("node_key IS NOT NULL").select(F.col("family" if families else "node_key").alias("start"), F.col("node_key").alias("origin")).distinct()
    begin = begin.join(aims.select(F.col("node").alias("origin"), F.lit(True).alias("own")), "origin", "left")
    begin, n_own = kept_counted(begin.select("start", "origin", F.when(F.col("own"), F.concat("origin", F.lit(AWAY))).otherwise(F.col("origin")).alias("away")), "starts", F.col("away") != F.col("origin"))
    if families and n_own:  # a family's least path to such a target may be one that comes back to its own start, which is none
        each = forward_paths(edges, starts.select("node_key"), targets, max_nodes, nodes).join(starts.select(F.col("node_key").alias("start"), "family").distinct(), "start")
        best = each.groupBy("family", "target").agg(F.min(F.struct("length", "path", "start", "confidence")).alias("r"))
        return best.select("family", "r.start", "target", "r.path", "r.length", "r.confidence")
    lists = _arc_lists(edges, aims, n_aims, begin, nodes)
    onward, ending = (lists.where(c).drop("aim") for c in ("NOT aim", "aim"))
    n_wanted = aims.where("wanted").count()
    frontier = begin.select("start", F.col("away").alias("node"), *(["origin"] if families else []), F.col("origin").alias("path"), F.lit(9).cast("tinyint").alias("weakest"))
    visited, had, found = [], None, []
    for length in range(2, max_nodes + 1):
        visited.append(frontier.select("start", "node"))
        busy, n_busy = kept_counted(frontier.groupBy("start").count().where(F.col("count") > BUSY).select("start"), "busy")
        hits = _least(frontier, busy, n_busy, ending)
        if had is not None:
            hits = hits.join(had, ["start", "node"], "left_anti")
        found.append(hits.withColumn("length", F.lit(length)))
        on = _least(frontier, busy, n_busy, onward)
        # A start that goes on is met again; what others have visited, or had, needs no comparing.
        fresh = on.join(_union(visited), ["start", "node"], "left_anti")
        before, (frontier, n) = frontier, kept_counted(fresh, "states")
        if not n:
            break
        active, n_active = kept_counted(frontier.select("start").distinct(), "active")
        active = sent(active, n_active)
        visited = [_union(visited).join(active, "start", "left_semi")]
        now = _least(before.join(active, "start", "left_semi"), busy, n_busy, ending).select("start", "node")
        had = kept(now if had is None else _union([now, had.join(active, "start", "left_semi")]).distinct(), "had")
        # Starts that have all targets are done; one that is a target itself has its own way back, so it goes on.
        done, n_done = kept_counted(had.groupBy("start").count().where(F.col("count") >= n_wanted).join(begin.where("away <> origin").select("start"), "start", "left_anti").select("start"), "done")
        if n_done:
            frontier = frontier.join(sent(done, n_done), "start", "left_anti")
    every = _union(found) if found else frontier.withColumn("length", F.lit(1)).limit(0)
    origin = F.col("origin" if families else "start")
    return every.where(origin != F.col("node")).select(*([F.col("start").alias("family")] if families else []), origin.alias("start"), F.col("node").alias("target"), "path", "length", named_rank(F.col("weakest").cast("int")).alias("confidence"))


def _on_cycles(arcs: DataFrame, rounds: int = 4) -> DataFrame:
    """Nodes (node) among which are all those that a path may come back to: what is left when nodes without arcs in or out go, a few times over."""
    core = arcs.select("src", "dst")
    for _ in range(rounds):
        ends = core.select(F.col("src").alias("node")).intersect(core.select(F.col("dst").alias("node")))
        left, n = kept_counted(core.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi"), "core")
        if not n:
            return left.select(F.col("src").alias("node"))
        core = left
    return core.select(F.col("src").alias("node")).union(core.select("dst")).distinct()


def _others() -> Column:
    """Over rows of a start: how many targets its words hold, but its own number (target_n, null where it is no target)."""
    holds_own = (F.floor(F.col("target_n") / 64) == F.col("word")) & (F.getbit("bits", F.pmod("target_n", F.lit(64)).cast("int")) == 1)
    return F.sum(F.bit_count("bits") - F.coalesce(holds_own, F.lit(False)).cast("int"))


def _hits(least: DataFrame, length: int) -> DataFrame:
    return least.where("aim AND start <> node").select("start", F.col("node").alias("target"), "path", F.lit(length).alias("length"), "weakest")


def k_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, k: int, max_nodes: int = DEPTH, most: int | None = None, whole: int = 0) -> DataFrame:
    """Per pair the k least paths without a repeated node, by length and then text; with most, the least of all pairs' paths.

    Of paths of up to whole nodes none is left out, however many a pair has.
    """
    arcs, begin, aims = _graph(edges, starts, targets)
    at = levels_to(arcs, aims, max_nodes - 1)
    # How many targets each start reaches: one with k paths to all of them is done.
    own = aims.select(F.col("node").alias("start"), "target_n")
    reached = kept(at.where("left > 0").join(begin, "node").join(own, "start", "left").groupBy("start").agg(_others().alias("n")), "reached")
    usable = at.groupBy(F.col("node").alias("dst")).agg(F.min("left").alias("steps"))
    cyclic = _on_cycles(arcs).select("node", F.lit(True).alias("again"))
    # Arcs from whose end a target can be reached, with the fewest steps to one and whether a path may come back to that end.
    arcs = arcs.join(usable, "dst").join(cyclic.withColumnRenamed("node", "dst"), "dst", "left")
    arcs = kept(arcs.select(F.col("src").alias("node"), "dst", "rank", "steps", F.coalesce("again", F.lit(False)).alias("again")), "arcs")
    none = F.array().cast("array<string>")
    partial = begin.join(cyclic, "node", "left").select(
        "start", "node", F.array("node").alias("nodes"), F.when(F.col("again"), F.array("node")).otherwise(none).alias("passed"), F.col("start").alias("path"), F.lit(9).alias("weakest")
    )
    found: list[DataFrame] = []
    in_order = Window.partitionBy("start", "node", "passed").orderBy("path")
    for length in range(2, max_nodes + 1):
        stepped = partial.join(arcs.where(F.col("steps") <= max_nodes - length), "node").where(~F.array_contains("nodes", F.col("dst")))
        stepped = stepped.select(
            "start", F.col("dst").alias("node"), F.concat("nodes", F.array("dst")).alias("nodes"), F.when(F.col("again"), F.array_sort(F.concat("passed", F.array("dst")))).otherwise(none).alias("passed"),
            F.concat("path", F.lit(SEPARATOR), "dst").alias("path"), F.least("weakest", "rank").alias("weakest"),
        )
        marked = stepped.join(aims.select("node", F.lit(True).alias("aim")), "node", "left")
        marked = marked.withColumns({c: F.when(F.col("aim").isNull(), F.col(c)) for c in ("nodes", "passed")})  # a path that has ended needs them no more
        if length > whole:
            marked = marked.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= k).drop("nth")
        least, n = kept_counted(marked, "partial", F.col("aim").isNull())
        if not n:
            found.append(_hits(least, length))
            break
        found.append(_hits(least, length))
        counts = _union(found).groupBy("start", "target").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
        if most is not None and (counts.agg(F.sum("n")).first()[0] or 0) >= most:
            break
        full = counts.where(F.col("n") == k).groupBy("start").agg(F.count("*").alias("n")).join(reached, ["start", "n"])
        full, n = kept_counted(full, "full")
        partial = least.where("aim IS NULL").drop("aim")
        if n:
            partial = partial.join(full, "start", "left_anti")
            if partial.isEmpty():
                break
    nth = F.row_number().over(Window.partitionBy("start", "target").orderBy("length", "path"))
    short, long = found[: max(whole - 1, 0)], found[max(whole - 1, 0) :]
    if short and long:
        had = _union(short).groupBy("start", "target").agg(F.count("*").alias("had"))
        long = [_union(long).withColumn("nth", nth).join(had, ["start", "target"], "left").where(F.col("nth") + F.coalesce("had", F.lit(0)) <= k).drop("nth", "had")]
    elif long:
        long = [_union(long).withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")]
    every = _union([*short, *long])
    if most is not None:
        every = every.orderBy("length", "path").limit(most)
    return every.select("start", "target", "path", "length", named_rank(F.col("weakest")).alias("confidence"))


def _near(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """The edges on ways of so many steps from starts (node_key)."""
    frontier, n = kept_counted(starts.select(F.col("node_key").alias("src")).where("src IS NOT NULL").distinct(), "near")
    seen, found = [frontier], []
    for _ in range(steps):
        if not n:
            break
        found.append(kept(edges.join(sent(frontier, n), "src", "left_semi"), "near"))
        frontier, n = kept_counted(found[-1].select(F.col("dst").alias("src")).where("src IS NOT NULL").distinct().join(_union(seen), "src", "left_anti"), "near")
        seen.append(frontier)
    return _union(found) if found else edges.limit(0)


def least_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, k: int, most: int, nodes: DataFrame, max_nodes: int = DEPTH) -> DataFrame:
    """k_paths() of all pairs up to most paths, between nodes (node_key), by looking at short paths first.

    Where there are so many paths of a few nodes, longer ones don't count, so only edges near the starts are read into the search.
    """
    starts, targets = kept(starts.select("node_key"), "starts"), kept(targets.select("node_key"), "aims")
    for depth in sorted({min(d, max_nodes) for d in (3, 6, 12, max_nodes)}):
        near = _near(edges, starts, depth - 1)
        for end in ("src", "dst"):
            near = near.join(nodes.select(F.col("node_key").alias(end)), end, "left_semi")
        found, n = kept_counted(k_paths(near, starts, targets, k, depth, most), "paths")
        if n >= most:
            break
    return found.orderBy("length", "path")

"""Code graphs and the knowledge graph as node and edge tables.

Searches are loops over a frontier: one join per step, each step's result written out, ended
when a step finds nothing new. Path searches are in paths.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends exist."""
    keys = nodes.select(F.col("node_key").alias("src"))
    return edges.join(keys, "src", "left_semi").join(keys.withColumnRenamed("src", "dst"), "dst", "left_semi")


def reachable(edges: DataFrame, starts: DataFrame, max_steps: int | None = None) -> DataFrame:
    """node_key and the fewest steps to it from any start (node_key)."""
    arcs = kept(edges.select("src", "dst").distinct(), "arcs")
    found = kept(starts.select("node_key").distinct().withColumn("steps", F.lit(0)), "reach")
    frontier, step = found, 0
    while max_steps is None or step < max_steps:
        step += 1
        fresh = arcs.join(frontier.select(F.col("node_key").alias("src")), "src").select(F.col("dst").alias("node_key")).distinct().join(found.select("node_key"), "node_key", "left_anti")
        frontier = kept(fresh.withColumn("steps", F.lit(step)), "reach")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def neighbours(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """What the given nodes point to, then what points to them."""
    out = edges.join(keys, edges["src"] == keys["node_key"]).select("node_key", F.lit("out").alias("direction"), F.col("dst").alias("other"), "edge_type")
    back = edges.join(keys, edges["dst"] == keys["node_key"]).select("node_key", F.lit("in").alias("direction"), F.col("src").alias("other"), "edge_type")
    return out.unionByName(back)


def fan_out(edges: DataFrame, least: int, kinds: tuple[str, ...] = ("CALLS", "INVOKES")) -> DataFrame:
    """Nodes with at least that many call edges."""
    return edges.where(F.col("edge_type").isin(*kinds)).groupBy("src").agg(F.count("*").alias("degree")).where(F.col("degree") >= least)


def print_of(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def projected_nodes(*sources: DataFrame) -> DataFrame:
    """(analysis_id, node_type, label, provenance) of all sources, with fingerprints, one row each."""
    whole = sources[0]
    for s in sources[1:]:
        whole = whole.unionByName(s)
    named = whole.withColumn("fingerprint", print_of(F.col("analysis_id"), F.col("node_type"), F.col("label")))
    return named.groupBy("analysis_id", "fingerprint", "node_type", "label").agg(F.min("provenance").alias("provenance"))


def projected_edges(nodes: DataFrame, *sources: DataFrame) -> DataFrame:
    """(analysis_id, src_type, src, dst_type, dst, edge_type), kept where both ends are nodes, by fingerprints."""
    whole = sources[0]
    for s in sources[1:]:
        whole = whole.unionByName(s)
    ends = whole.select(
        "analysis_id", print_of(F.col("analysis_id"), F.col("src_type"), F.col("src")).alias("src"), print_of(F.col("analysis_id"), F.col("dst_type"), F.col("dst")).alias("dst"), "edge_type"
    ).distinct()
    keys = nodes.select(F.col("fingerprint").alias("node_key"))
    return connected(ends, keys).withColumn("fingerprint", print_of(F.col("src"), F.col("dst"), F.col("edge_type"))).select("analysis_id", "src", "dst", "edge_type", "fingerprint")


def digest(rows: DataFrame, group: str = "analysis_id", member: str = "fingerprint") -> DataFrame:
    """A digest of each group's members that doesn't depend on their order.

    Members are hashed in 4096 buckets by their first digits, and buckets in order, so no row
    holds a whole group; equal digests still mean equal members.
    """
    listed = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "|"), 256)
    buckets = rows.groupBy(group, F.substring(member, 1, 3).alias("bucket")).agg(F.count("*").alias("n"), listed(F.col(member)).alias("part"))
    return buckets.groupBy(group).agg(F.sum("n").alias("n"), listed(F.concat("bucket", F.lit(":"), "part")).alias("digest"))


def as_dot(edges: DataFrame) -> DataFrame:
    """A DOT line per edge, to be written as text between a head and a foot."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(quoted(F.col("src")), F.lit(" -> "), quoted(F.col("dst")), F.lit(' [label="'), F.col("edge_type"), F.lit('"];')).alias("line"))

"""Joins of many rows to one row per key that keep a frequent key out of a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent with more rows than this, and with more than one in MOST of all rows; so at most MOST keys are.
HOT_ROWS, MOST = 1000, 4096
#: Tasks over which a frequent key's rows are dealt.
SALTS = 64


def join_spread(rows: DataFrame, groups: DataFrame, key: str, by: str, total: int, n: str = "n", how: str = "inner", hot_rows: int = HOT_ROWS, salts: int = SALTS, tasks: int | None = None) -> DataFrame:
    """rows joined to groups, which has one row per key with the number n of rows of that key; total is the number of all rows.

    Frequent keys (a list of at most MOST, so it is broadcast) are dealt by column by over salts
    tasks, and their row of groups is sent to each. Null keys have no group. n isn't kept. With tasks the join has so many,
    however little they read.
    """
    frequent = F.col(n) > max(hot_rows, total // MOST)
    hot = groups.where(frequent).select(F.col(key).alias("_key"), F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), rows[key] == F.col("_key"), "left").drop("_key")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(salts))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    sent = groups.withColumn("_salt", F.explode(F.when(frequent, F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop(n)
    if tasks:
        dealt, sent = dealt.repartition(tasks, key, "_salt"), sent.repartition(tasks, key, "_salt")
    return dealt.join(sent, [key, "_salt"], how).drop("_salt")


#: Rows up to which a table is sent to all tasks.
SMALL = 1 << 20


def sent(df: DataFrame, n: int) -> DataFrame:
    """df, which has n narrow rows, to be joined: sent to all tasks while it is small, so that the other side stays where it is."""
    return F.broadcast(df) if n <= SMALL else df

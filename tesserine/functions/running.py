"""Running totals in which no group is one task: a group is cut by ranges of its order, and each range starts from the totals before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(rows: DataFrame, keys: list[str], order: list[str], shard: Column, totals: dict[str, Column]) -> DataFrame:
    """rows with a running total (this row included) for each of totals, within keys, by order.

    shard is an integer that never falls along order, and its ranges are what one task sorts. Only the
    sums of ranges, one short row each, meet by key. Null keys are a group of their own; order must be total.
    """
    cut = rows.withColumns({"_shard": shard, **{f"_t_{n}": c for n, c in totals.items()}})
    by = [*keys, "_shard"]
    before = Window.partitionBy(*(f"_k_{k}" for k in keys)).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*by).agg(*(F.sum(f"_t_{n}").alias(f"_s_{n}") for n in totals))
    sums = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_shard").alias("_of"), *(f"_s_{n}" for n in totals))
    starts = sums.select("*", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in totals)).drop(*(f"_s_{n}" for n in totals))
    same = F.col("_shard").eqNullSafe(F.col("_of"))
    for k in keys:
        same &= cut[k].eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(starts, same)
    return out.select(*rows.columns, *((F.col(f"_b_{n}") + F.sum(f"_t_{n}").over(within)).cast("long").alias(n) for n in totals))

"""Observations as a stream: classified (P12), deduplicated within a watermark, counted in windows.

An addition for live sessions; the batch operators are the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks


def classified(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """stream: obs_id, ts, session_id, observation_type, class_name, method_name, symbol. Repeats of obs_id within the watermark go."""
    kind = ranks.observed_kind(*(F.col(c) for c in ("observation_type", "class_name", "method_name", "symbol")))
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["obs_id"]).withColumn("kind", kind)


def counted(observed: DataFrame, window: str = "1 hour") -> DataFrame:
    return observed.groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")

"""Tables that cut the lineage of loops, in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def kept_counted(df: DataFrame, tag: str, which: Column | None = None) -> tuple[DataFrame, int]:
    """kept(), and how many of its rows there are (for which something holds), counted while they are written."""
    seen = Observation()
    made = kept(df.observe(seen, (F.count("*") if which is None else F.count_if(which)).alias("n")), tag)
    return made, seen.get["n"]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; only a local session may be without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: Makes Spark delete a job's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again. What was shuffled for it is deleted, so a loop holds the shuffles of one step at a time."""
    spark = df.sparkSession
    path, before = new_path(spark, tag), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)

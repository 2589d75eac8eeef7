"""What the operators of this subpackage share: reading, and tables that outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only a local session may be without one; it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one operator's run, in a folder that drop() deletes when the result is written elsewhere."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.made = spark, new_path(spark, tag), 0

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}-{tag}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Most bytes of one Arrow batch that a Python task gets, so that rows of long texts don't add up.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, or less where the session asks for less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_to = spark.conf.get(name, None)
    if not (set_to or "").isdigit() or not 0 < int(set_to) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df has not, for a column that goes again."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


#: What operators keep in this Python worker, with how to let go of it.
_resident: dict[str, Callable[[], None]] = {}


def only(name: str, clear: Callable[[], None] | None = None) -> None:
    """Called in a worker by an operator that keeps something from batch to batch: what the others keep goes."""
    others = [k for k in _resident if k != name]
    for k in others:
        _resident.pop(k)()
    if clear:
        _resident[name] = clear
    if others:
        trimmed()


def trimmed() -> None:
    """Gives memory that this worker no longer uses back to the system, since workers live on and share an executor's room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))

r"""Operator 11: exact duplicates by stateful streaming.

Files of documents arrive as a stream. A first query gives each row its print: the digest of its
text without white space, the number of its code points, and its content locator (file and row
in the file), without the text. A second query keeps state by digest: the identifier and the
locator of the row that stays (most code points, then the smallest identifier), and how many
rows there are. The state lives in RocksDB on disk, is saved to the shared folder with each
batch, and never expires, so a row that arrives a year later still meets its copy; rows of one
digest are merged within each task before they are dealt to the state. Both queries go on where
they stopped when they are started again with the same folder, over new files only.

Equal digests are only hits. classes() fetches the texts of all hits by their locators and
compares every byte with the retained text; where bytes differ, the rows of that digest are
grouped anew by their whole texts. So results don't rest on the digest.

A digest of any number of rows is no burden: state and messages hold one row per task and
digest, and comparisons of a frequent digest are dealt over many tasks. The one large shuffle
joins texts to hits by locator; over 10 GB Spark's runtime Bloom filter drops other rows before it.

Defined results: a null text is empty and all texts without other characters than white space
are equal; of rows that tie in code points and identifier (repeated rows, null identifiers, which
come last) the first by file and row stays; no files give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.skew import join_spread
from .common import Scratch, new_path, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
#: Most files of one batch of the stream.
FILES = 4096
#: Fixed names: the state store, MB of memory that all stores of an executor share, and no room on disk laid aside
#: for logs nor rows counted, since there are many stores, one a partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _locator() -> list[Column]:
    """File and row. Batches and streams write the start of a local path in different ways."""
    return [F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path"), F.col("_metadata.row_index").alias("row")]


def _last_as_pattern(path: str) -> str:
    """The path as a pattern that fits only it, since a stream reads folders and patterns but no single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _drained(writer, folder: str) -> None:
    """Runs a stream over all there is now."""
    writer.option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()


def ingest(spark: SparkSession, source: str, folder: str, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, files: int = FILES) -> None:
    """Takes the Parquet files of source that are new since the last call into the state that folder holds."""
    schema = spark.read.parquet(source).schema
    wanted = StructType([f for f in schema.fields if f.name in (doc_id, text)])
    arriving = spark.readStream.schema(wanted).option("maxFilesPerTrigger", files).parquet(_last_as_pattern(source))
    whole = text_or_empty(text)
    prints = arriving.select(F.col(doc_id).alias("doc_id"), digest(normalised(whole)).alias("digest"), F.length(whole).alias("n_points"), *_locator())
    _drained(prints.writeStream.format("parquet").option("path", f"{folder}/prints"), f"{folder}/prints-progress")

    seen = spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/prints")
    stays = F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "path", "row")
    retained = seen.groupBy("digest").agg(F.count("*").alias("n"), F.min(stays).alias("keep"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/retained/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        _drained(retained.writeStream.outputMode("update").foreachBatch(put), f"{folder}/retained-progress")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def retained(spark: SparkSession, folder: str) -> DataFrame:
    """The state after the last batch: digest, n, keep. Counts only grow and a row that stays only gives way to a better one."""
    changes = spark.read.option("basePath", f"{folder}/retained").parquet(f"{folder}/retained/*")
    return changes.groupBy("digest").agg(F.max("n").alias("n"), F.min("keep").alias("keep"))


def _by_text(rows: DataFrame) -> DataFrame:
    """Rows of one digest whose texts differ, grouped by digest and text."""
    keyed = rows.withColumn("key", F.concat_ws(" ", "digest", "text"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("stays").alias("keep"))
    joined = join_spread(keyed, groups.withColumn("size", F.col("n")), "key", "place", keyed.count())
    return joined.select("doc_id", "digest", "path", "row", F.col("size").alias("n"), "keep")


def classes(spark: SparkSession, source: str, folder: str, tables: Scratch, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row taken in: doc_id, digest, keep_id, group_size, kept. Its tables are needed until the result is written."""
    seen = spark.read.parquet(f"{folder}/prints")
    place = F.xxhash64("path", "row").alias("place")
    several = tables.written(retained(spark, folder).where("n > 1"), "several")
    rows = seen.withColumn("place", place)
    dealt = join_spread(rows, several.withColumn("size", F.col("n")), "digest", "place", rows.count(), how="left")
    own = F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "path", "row")
    members = tables.written(dealt.select("doc_id", "digest", "path", "row", "place", own.alias("stays"), F.coalesce("size", F.lit(1)).alias("n"), F.coalesce("keep", own).alias("keep")), "members")

    hits = members.where("n > 1")
    content = spark.read.parquet(source).select(text_or_empty(text).alias("text"), *_locator())
    texts = tables.written(content.join(hits, ["path", "row"]).withColumn("text", normalised(F.col("text"))), "hits")
    witness = texts.where(F.col("stays") == F.col("keep")).select("digest", F.col("text").alias("retained_text"), "n")
    compared = join_spread(texts.drop("n"), witness, "digest", "place", texts.count())
    unlike = tables.written(compared.where(F.col("text") != F.col("retained_text")).select("digest").distinct(), "unlike")
    result = members
    if not unlike.isEmpty():
        settled = members.join(unlike, "digest", "left_anti").select("doc_id", "digest", "path", "row", "n", "keep")
        result = settled.unionByName(_by_text(texts.drop("n", "keep").join(unlike, "digest", "left_semi")))
    stands = (F.col("path") == F.col("keep.path")) & (F.col("row") == F.col("keep.row"))
    return result.select("doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stands.alias("kept"))


def op11_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, folder = f"{sf_dir}/documents.parquet", new_path(spark, "stream-dedup")
    ingest(spark, source, folder)
    made = classes(spark, source, folder, Scratch(spark, "stream-dedup"))
    return made.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""

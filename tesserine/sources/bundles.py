"""Bundles of tables that travel between stores: written, validated and imported whole or not at all.

A bundle is a folder: a folder of JSON lines for each table, in files that Spark writes side by
side, then one manifest with the digest and size of every file and a digest over these lines. The manifest is
written last, so a bundle whose writer died has none. Validation joins what the manifest expects
with what is there, in full, so changed, missing and added files all show; files are digested where
they lie, in the JVM. An import that isn't COMPLETE writes nothing; else its tables go into the
store under the bundle's digest and its commit row comes last. Readers see committed imports only,
and importing a bundle again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_bundle-manifest"
#: Bytes of one file, about: digests take a file as one value.
RECORDS_PER_FILE = 100_000


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """The data files of a bundle: name (from the bundle's folder on), n_bytes, sha256."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(f"{folder.rstrip('/')}/tables")
    name = F.regexp_extract("path", r"/tables/(.+)$", 1)
    return found.select(name.alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def checksum(files: DataFrame) -> DataFrame:
    """One row: a digest over the lines of the manifest, in order of names."""
    line = F.concat_ws(":", "name", "n_bytes", "sha256")
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("checksum"), F.count("*").alias("n_files"))


def write(tables: dict[str, DataFrame], folder: str, order: dict[str, list[str]] | None = None) -> str:
    """Writes a bundle of tables, each sorted by its columns of order within its files, and gives its checksum."""
    folder, spark = folder.rstrip("/"), next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        rows = table.repartitionByRange(*order[name]).sortWithinPartitions(*order[name]) if order and name in order else table
        rows.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_PER_FILE).option("ignoreNullFields", "false").json(f"{folder}/tables/{name}")
    files = files_of(spark, folder)
    files.crossJoin(checksum(files)).write.mode("overwrite").json(f"{folder}/{MANIFEST}")  # one row on the other side
    return checksum(files).first().checksum


def validated(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file that is expected or there: name and state, OK, CHANGED, MISSING or ADDED; and for the manifest itself, if it is missing or was changed."""
    folder = folder.rstrip("/")
    if not _exists(spark, f"{folder}/{MANIFEST}"):
        return spark.createDataFrame([(MANIFEST, "MISSING")], "name string, state string")
    wanted = spark.read.schema("name string, n_bytes long, sha256 string, checksum string, n_files long").json(f"{folder}/{MANIFEST}")
    there = files_of(spark, folder) if _exists(spark, f"{folder}/tables") else wanted.select("name", "n_bytes", "sha256").where("1 = 0")
    both = wanted.select("name", F.col("sha256").alias("expected"), F.col("n_bytes").alias("bytes")).join(there.withColumn("there", F.lit(True)), "name", "full")
    state = F.when(F.col("there").isNull(), "MISSING").when(F.col("expected").isNull(), "ADDED").when((F.col("expected") == F.col("sha256")) & (F.col("bytes") == F.col("n_bytes")), "OK").otherwise("CHANGED")
    told = wanted.agg(F.min("checksum").alias("low"), F.max("checksum").alias("high"), F.max("n_files").alias("files")).crossJoin(checksum(wanted))
    own = told.where("low IS NULL OR low <> checksum OR high <> checksum OR files <> n_files").select(F.lit(MANIFEST).alias("name"), F.lit("CHANGED").alias("state"))
    return both.select("name", state.alias("state")).unionByName(own)


def import_bundle(spark: SparkSession, folder: str, store: str, schemas: dict[str, str]) -> DataFrame:
    """Imports the tables of schemas if every file is what it should be. One row: status COMPLETE or FAILED, checksum, n_rows and n_errors."""
    folder, store = folder.rstrip("/"), store.rstrip("/")
    wrong = validated(spark, folder).where("state <> 'OK'").count()
    row = "status string, checksum string, n_rows long, n_errors long"
    if wrong:
        return spark.createDataFrame([("FAILED", None, 0, wrong)], row)
    mark = spark.read.schema("checksum string").json(f"{folder}/{MANIFEST}").first()
    name = mark.checksum if mark else "empty"
    n = 0
    for table, schema in schemas.items():
        at = f"{store}/{table}/import={name}"
        spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/tables/{table}").write.mode("overwrite").parquet(at)
        n += spark.read.parquet(at).count()
    made = spark.createDataFrame([("COMPLETE", name, n, 0)], row)
    made.write.mode("overwrite").parquet(f"{store}/_commits/import={name}")
    return made


def imported(spark: SparkSession, store: str, table: str) -> DataFrame:
    """The rows of a table from all imports that were committed."""
    store = store.rstrip("/")
    done = spark.read.parquet(f"{store}/_commits/*").select(F.col("checksum").alias("import"))
    rows = spark.read.option("basePath", f"{store}/{table}").parquet(f"{store}/{table}/import=*").withColumn("import", F.col("import").cast("string"))
    return rows.join(F.broadcast(done), "import", "left_semi")  # a row an import


def statuses(expected: DataFrame, actual: DataFrame, by: str) -> DataFrame:
    """Of groups of files (name, sha256 and the group) whether an import would take them, and how many files keep it from that."""
    both = expected.select(by, "name", F.col("sha256").alias("a")).join(actual.select(by, "name", F.col("sha256").alias("b")), [by, "name"], "full")
    counted = both.groupBy(by).agg(F.count("*").alias("n_files"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_errors"))
    return counted.withColumn("status", F.when(F.col("n_errors") > 0, "FAILED").otherwise("COMPLETE"))

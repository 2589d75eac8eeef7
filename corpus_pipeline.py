"""The corpus pipeline: five stages, each of which works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir). Its result is written as Parquet into the shared folder
and read again, so a lost executor costs at most the running stage. All but the last return the
columns of documents, with n_chars brought up to date where texts change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import decontamination, near_dedup, pii, quality_classifier, word_bpe
from tesserine.llm.common import read_table, text_or_empty, written

#: No SQL expresses the learnt stages; the tests compare the rows of run() with plain Python versions of the stages.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored as the empty text; repeated rows are judged each; no documents
    give none; columns of docs stay as they are, whatever their names.
    """
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_classifier.fit(docs, labels)
    return docs.where(quality_classifier.score(text_or_empty("text"), model) >= quality_classifier.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one row stays, that of the least doc_id (a null one last).

    Rows are judged by their texts: of exact copies and repeated rows one stays, rows of one doc_id
    with different texts are different documents. Null texts and texts without words all stay.
    """
    return near_dedup.without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go.

    Null and empty texts have no passages and stay; repeated rows are judged each; n_chars follows
    the text; no documents or no items are no special case; all other columns stay as they are.
    """
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return _counted(decontamination.decontaminated(docs, items))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to their kinds in brackets.

    Null texts stay null, empty ones empty; repeated rows are judged each; n_chars follows the text;
    no documents give none; all other columns stay as they are, whatever their names.
    """
    return _counted(pii.without_pii(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids (joined by a space), n_tokens and decoded_text, the ids decoded, which replace columns of these names.

    Null and empty texts have no ids and decode to the empty text; repeated rows are encoded each; no documents give none.
    """
    import public_tokenizers

    return word_bpe.with_encoding(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded_text")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

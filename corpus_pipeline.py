"""A corpus pipeline: quality rules, exact and near deduplication, source mixing, BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.bpe import bpe_round_trip
from latticework.llm.common import TEXT_ROWS, stored, table
from latticework.llm.exact_dedup import exactly_distinct
from latticework.llm.mixing import mixed
from latticework.llm.quality_rules import passing
from latticework.llm.simhash import one_of_each


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of whole texts that this job sends to Python at once, and with them the memory of both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


# Each stage takes null, empty and very long texts, ties, repeated rows, an empty table and extra columns of any name; null texts count as
# empty, rows with a null id count as larger than any, and what comes back has the columns of docs.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line and base rules keep, without the lines that fail.

    A null or empty text has too few words and goes; repeated rows are judged alike; n_chars, where there is one, is counted anew.
    """
    kept = passing(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest id; of rows equal in id and text one stays."""
    small_batches(spark)
    return exactly_distinct(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of close fingerprints and of texts of a Jaccard similarity of 0.8 over five words.

    Texts without words are one component; of a component without ids one row stays.
    """
    small_batches(spark)
    return one_of_each(docs, close=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; a null source is one of its own, texts without words are never taken."""
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): token counts and digests of the ids and the decoded text, one row for each copy."""
    small_batches(spark)
    return bpe_round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Fingerprints and BPE ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries opN_<name>, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.alignment import align
from latticework.llm.bpe import bpe_round_trip
from latticework.llm.common import table
from latticework.llm.exact_dedup import exact_dedup
from latticework.llm.hard_negatives import hard_negatives
from latticework.llm.language_id import identify
from latticework.llm.mixing import mix
from latticework.llm.quality_classifier import classify
from latticework.llm.quality_rules import quality
from latticework.llm.repeats import remove_repeats
from latticework.llm.secret_scan import scan
from latticework.llm.simhash import near_duplicates
from latticework.llm.url_filter import filter_urls
from latticework.llm.warc import archive


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_url_filter, op3_simhash, op4_language_id, op5_mixing, op6_suffix_dedup, op7_bpe, op8_warc, op9_exact_dedup, op10_quality_classifier, op11_hard_negatives, op12_secret_scan, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    from latticework.llm import sql

    return {"op1_quality_rules": sql.OP1, "op5_mixing": sql.OP5, "op8_warc": sql.OP8, "op9_exact_dedup": sql.OP9, "op11_hard_negatives": sql.OP11}

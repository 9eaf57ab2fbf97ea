"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.sources.scratch import released, shared_dir, stored

__all__ = ["SPACE", "TEXT_ROWS", "WORD", "crc_fold", "fields", "picked", "released", "smallest_hashes", "shared_dir", "stored", "table", "text_or_empty", "words_of"]

#: A word is a maximal run of anything but ASCII white space; bytes.split() splits at the same places.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of whole texts that go to Python at once.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def crc_fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null where the id is null."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def fields(row: str, names: list[str]) -> list[Column]:
    """The columns that a struct column holds, under their own names."""
    return [F.col(row).getField(n).alias(n) for n in names]


def picked(docs: DataFrame, keys: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows of docs that keys names, each key once: row, a struct of all columns, beside the columns of keys.

    keys is a stored table that holds each key once, as key_<name> for each of columns, with key_rows, the number of rows of docs
    that have it. Nulls are equal. Rows that share a key are rare; only for them is there a second look at docs.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"key_{name}")) for name in columns])
    once, several = whole.join(keys.filter("key_rows = 1"), same), keys.filter("key_rows > 1")
    return once if several.isEmpty() else once.unionByName(whole.join(several, same).dropDuplicates(list(columns)))


def smallest_hashes(ids: DataFrame, group: str, most: int, twice: int = 2) -> DataFrame:
    """(id, group, place): of each group of distinct rows (id, group) the most with the smallest hash of the id, numbered from 1.

    First the rows above a threshold go, which each group's size gives and which leaves about twice as many as wanted, wherever
    they lie; only those are ranked.
    """
    sizes = ids.groupBy(F.col(group).alias("of_group")).agg(F.count("*").alias("rows"))
    share = F.least(F.lit(1.0), twice * most / F.col("rows"))
    # A hash as a number from 0 to 1.
    at = F.xxhash64("id").cast("double") / float(1 << 64) + 0.5
    near = ids.join(sizes, F.col(group) == F.col("of_group")).filter(at <= share).select("id", group)
    place = F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64("id"), "id"))
    return near.withColumn("place", place).filter(F.col("place") <= most)

"""Mixing sources to target weights by systematic sampling.

Within a source, documents in order of size carry their expected copies one after another; one random offset per
source shifts the running sum, and a document is emitted once for each whole number that its part of the sum
crosses. The running sum is made without collecting a source: rows are dealt out by range of
(source, size, id), and each task adds what the tasks before it hold of that source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.llm.common import WORD, fields, picked, stored, text_or_empty

#: Expected copies are added as whole multiples of 1 / UNIT, so sums are the same in any order.
UNIT = 1 << 20
SEED = "mix-1"
WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MOST_COPIES = 150, 2


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) for rows (source, size).

    Sources by code point, null last, weigh by turns; all share share_percent of the total size. A target stops at
    most_copies times its source's size and the excess goes to the rest by weight. In order of that bound over the
    weight, the stopped sources come first: each order number k gives the level that holds if k sources are
    stopped, and the right one is the first that no further source's bound lies under.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = sums.select("*", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long").alias("weight"))
    bound = most_copies * F.col("source_size")
    before = W.orderBy(bound / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(bound / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(F.lit(1))
    levels = ranked.select(
        "source", "source_size", "weight",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum(bound).over(before), F.lit(0)).alias("stopped"),
        F.sum("weight").over(after).alias("open_weight"),
    ).withColumn("level", (F.col("total") * share_percent / 100 - F.col("stopped")) / F.col("open_weight"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= bound, F.col("level"))).over(every)
    target = F.least(bound.cast("double"), F.col("at") * F.col("weight"))
    return levels.withColumn("at", level).select("source", "source_size", F.coalesce(target, bound.cast("double")).alias("target"))


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A source's random offset, from 0 to UNIT - 1: the first hex digits of an md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("null"))).cast("binary")), 1, 5)
    return F.conv(digits, 16, 10).cast("long") % UNIT


def systematic_copies(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """rows (id, source, size, expected) with copies; expected is a whole number of 1 / UNIT.

    rows are read more than once, so they should come from a stored table.
    """
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = stored(rows.repartitionByRange(int(parts), F.col("source").asc_nulls_first(), "size", F.col("id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "mixing")
    # One row per task and source, however many documents these hold.
    held = dealt.groupBy("source", "part").agg(F.sum("expected").alias("held"))
    ahead = held.select(
        F.col("part").alias("of_part"), F.col("source").alias("of"), F.coalesce(F.sum("held").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    )
    within = W.partitionBy("part", "source").orderBy("size", F.col("id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    upto = dealt.withColumn("upto", F.sum("expected").over(within)).join(ahead, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of")))
    end = F.col("ahead") + F.col("upto") + offset_of(F.col("source"), seed)
    return upto.select("id", "source", "size", (F.floor(end / UNIT) - F.floor((end - F.col("expected")) / UNIT)).alias("copies"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: str = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of docs; size is its number of words.

    A null text has size 0, a null source is a source of its own, a source without words has target 0 and takes
    nothing. Repeated rows are taken each on its own. An empty table gives no rows.
    """
    sized = stored(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("source"), F.regexp_count(text_or_empty(f"`{text_column}`"), F.lit(WORD)).cast("long").alias("size")), "sizes")
    targets = stored(source_targets(sized), "targets")
    t = targets.select(F.col("source").alias("of"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    expected = sized.join(t, F.col("source").eqNullSafe(F.col("of"))).select("id", "source", "size", rate.alias("expected"))
    copies = systematic_copies(expected, seed)
    return copies.join(t, F.col("source").eqNullSafe(F.col("of"))).select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it, columns as they are.

    Nulls, empty texts and repeated rows count as in mix(); other columns may have any names. An empty table gives no rows.
    """
    text = f"`{text_column}`"
    key = {"id": F.col(f"`{id_column}`"), "h": F.xxhash64(text_or_empty(text)), "source": F.col(f"`{source_column}`")}
    slim = docs.select(F.struct(key["id"].alias("id"), key["h"].alias("h")).alias("key"), F.col(text).alias("text"), key["source"].alias("source"))
    taken = mix(slim, "key", "text", "source", seed)
    # Rows that are equal in source, id and text share one entry here, and one of them stands for all.
    entries = taken.groupBy(F.col("id.id").alias("key_id"), F.col("id.h").alias("key_h"), F.col("source").alias("key_source")).agg(F.sum("copies").alias("copies"), F.count("*").alias("key_rows"))
    found = picked(docs, stored(entries.filter("copies > 0"), "taken"), key)
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*fields("row", docs.columns))

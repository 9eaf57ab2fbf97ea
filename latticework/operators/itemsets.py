"""Frequent itemsets by lists of transactions: which sets of items come together in many transactions.

Transactions are numbered within blocks, and each item has one list for each block that it occurs in: numbers of two bytes, or bits where
these are shorter. Pairs are counted from the transactions' own items. After that a set of k + 1 items is made of two sets of k that
differ in their last item; it is looked at only if all its sets of k are frequent, and then its lists are what its two parents' lists share, block by block.
Items are taken in order of their support, the rarest first, so that lists become short early.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.sources.scratch import released, stored

#: Transactions of a block, about; numbers of a list from which bits are shorter.
BLOCK, BITS_FROM = 1 << 15, 1 << 12
BYTES = 1 << 13  # of 65,536 bits


def packed(numbers: np.ndarray) -> bytes:
    """Rising numbers below 65,536 as numbers of two bytes, or as bits."""
    if len(numbers) < BITS_FROM:
        return numbers.astype("<u2").tobytes()
    bits = np.zeros(BYTES * 8, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(content: bytes) -> np.ndarray:
    if len(content) < BYTES:
        return np.frombuffer(content, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(content, np.uint8), bitorder="little"))


def shared(a: bytes, b: bytes) -> np.ndarray:
    """The numbers that two lists have in common."""
    if len(a) < BYTES <= len(b):
        a, b = b, a
    if len(b) == len(a) == BYTES:
        return np.flatnonzero(np.unpackbits(np.frombuffer(a, np.uint8) & np.frombuffer(b, np.uint8), bitorder="little"))
    if len(a) == BYTES:
        n = np.frombuffer(b, "<u2")
        return n[np.frombuffer(a, np.uint8)[n >> 3] >> (n & 7).astype(np.uint8) & 1 == 1].astype(np.int64)
    return np.intersect1d(np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2"), assume_unique=True).astype(np.int64)


@dataclass
class Itemsets:
    """sets: (items, support), items in rising order. lists: (items, block, numbers) of the same sets; places: (tid, block, number)."""

    sets: DataFrame
    lists: DataFrame
    places: DataFrame
    #: Rows of lists that were stored for each length, from 1.
    stored_rows: list[int] = field(default_factory=list)

    def transactions(self) -> DataFrame:
        """(items, tid) of each set and transaction that has it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = [unpacked(c.as_py()) for c in batch["numbers"]]
                of = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
                flat = np.concatenate([np.empty(0, np.int64), *numbers]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["items"].take(pa.array(of)), batch["block"].take(pa.array(of)), pa.array(flat)], ["items", "block", "number"])

        kind = self.lists.schema["items"].dataType.simpleString()
        rows = self.lists.select("items", "block", "numbers").mapInArrow(run, f"items {kind}, block int, number int")
        return rows.join(self.places, ["block", "number"]).select("items", "tid")


def _numbers_of(rows: DataFrame, kind: str) -> DataFrame:
    """(items, block, numbers) of rows (items, block, list), whose lists are arrays in rising order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [packed(np.asarray(x.as_py(), np.int64)) for x in batch["list"]]
            yield pa.RecordBatch.from_arrays([batch["items"], batch["block"], pa.array(lists, pa.binary())], ["items", "block", "numbers"])

    return rows.mapInArrow(run, f"items {kind}, block int, numbers binary")


def _met(rows: DataFrame, kind: str) -> DataFrame:
    """(items, block, numbers, n): what the lists a and b of rows (items, block, a, b) share; none where that is nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared(a.as_py(), b.as_py()) for a, b in zip(batch["a"], batch["b"])]
            n = np.array([len(x) for x in found], np.int64)
            kept = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([batch["items"].take(kept), batch["block"].take(kept), pa.array([packed(x) for x in found if len(x)], pa.binary()), pa.array(n[n > 0])], ["items", "block", "numbers", "n"])

    return rows.mapInArrow(run, f"items {kind}, block int, numbers binary, n long")


def itemsets(tx: DataFrame, least: int, most: int | None = None, longest: int | None = None, shortest: int = 1) -> Itemsets:
    """The sets of shortest to longest items that least transactions or more have; tx is (tid, item), items of a type that has an order.

    most bounds the transactions of a set at each length: as a longer set has no more of them, that leaves out items, and all sets with
    them. None is no bound, of longest too. Repeated rows count once, rows with a null are left out; an empty table gives no sets.
    """
    rows = stored(tx.select("tid", "item").dropna().distinct(), "tx")
    kind = f"array<{rows.schema['item'].dataType.simpleString()}>"
    size = rows.agg(F.count_distinct("tid")).first()[0]
    block = F.pmod(F.xxhash64("tid"), F.lit(max(1, -(-size // BLOCK)))).cast("int")
    tids = rows.select("tid").distinct().withColumn("block", block)
    places = stored(tids.withColumn("number", F.row_number().over(W.partitionBy("block").orderBy("tid")) - 1), "places")
    single = rows.groupBy("item").agg(F.count("*").alias("support")).filter(F.col("support") >= least)
    single = stored(single if most is None else single.filter(F.col("support") <= most), "items")
    held = rows.join(single, "item").join(places, "tid")
    order = F.struct("support", "item").alias("o")
    level = stored(single.select(F.array("item").alias("items"), "support", F.array(order).alias("os")), "itemsets")
    lists = stored(_numbers_of(held.groupBy(F.array("item").alias("items"), "block").agg(F.sort_array(F.collect_list("number")).alias("list")), kind), "lists")
    # Pairs from each transaction's own items, summed before any shuffle of them.
    own = rows.join(single, "item").groupBy("tid").agg(F.sort_array(F.collect_list(order)).alias("os")).filter("size(os) > 1")
    out, counts, k = [(level, lists)], [lists.count()], 1
    while (longest is None or k < longest) and not level.isEmpty():
        if k == 1:
            first = own.select("os", F.posexplode("os").alias("at", "a"))
            pairs = first.select("a", F.explode(F.slice("os", F.col("at") + 2, F.size("os"))).alias("b"))
            made = pairs.groupBy("a", "b").agg(F.count("*").alias("support")).filter(F.col("support") >= least).select(F.array("a", "b").alias("os"))
        else:
            made = _candidates(level, k)
        item = lambda os: F.transform(os, lambda o: o["item"])
        made = made.select("os", F.sort_array(item(F.col("os"))).alias("items"))
        # The parents: all but the last, and all but the one before it.
        last, butlast = F.element_at("os", -1), F.slice("os", 1, F.size("os") - 2)
        made = stored(made.select("os", "items", F.sort_array(item(F.slice("os", 1, F.size("os") - 1))).alias("p"), F.sort_array(item(F.concat(butlast, F.array(last)))).alias("q")), "candidates")
        side = lambda key, name: lists.select(F.col("items").alias(key), "block", F.col("numbers").alias(name))
        both = made.select("items", "p", "q").join(side("p", "a"), "p").join(side("q", "b"), ["q", "block"]).select("items", "block", "a", "b")
        met = stored(_met(both, kind), "lists")
        sums = met.groupBy("items").agg(F.sum("n").alias("support")).filter(F.col("support") >= least)
        level = stored(sums.join(made.select("items", "os"), "items").select("items", "support", "os"), "itemsets")
        lists = stored(met.join(level.select("items"), "items", "left_semi").select("items", "block", "numbers"), "lists")
        counts.append(lists.count())
        for done in (made, met):
            released(done)
        out.append((level, lists))
        k += 1
    kept = out[shortest - 1 :] or [(level.limit(0), lists.limit(0))]
    sets, every = (kept[0][0].select("items", "support"), kept[0][1])
    for more, more_lists in kept[1:]:
        sets, every = sets.unionByName(more.select("items", "support")), every.unionByName(more_lists)
    return Itemsets(sets, every, places, counts)


def _candidates(level: DataFrame, k: int) -> DataFrame:
    """(os) of the sets of k + 1 all whose sets of k are in level: those that two sets with the same first k - 1 items make, tested for the others."""
    prefix: Column = F.slice("os", 1, k - 1)
    one = level.select(prefix.alias("prefix"), F.element_at("os", -1).alias("x"))
    two = one.select("prefix", F.col("x").alias("y"))
    made = one.join(two, "prefix").filter(F.col("x") < F.col("y")).select(F.concat("prefix", F.array("x", "y")).alias("os"))
    known = level.select(F.col("os").alias("part"))
    for gone in range(k - 1):
        part = F.concat(F.slice("os", 1, gone), F.slice("os", gone + 2, k - gone)) if gone else F.slice("os", 2, k)
        made = made.withColumn("part", part).join(known, "part", "left_semi").drop("part")
    return made

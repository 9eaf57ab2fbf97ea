"""Linked lists and permutations as tables, by pointer jumping: rounds grow with the logarithm of the longest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.sources.scratch import released, stored


def cycles(steps: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, cycle) of a permutation (id, next): the least id of each cycle, in rounds that grow with the logarithm of the longest.

    In each round every id takes the least that its reach knows and doubles that reach.
    """
    now = stored(steps.select("id", "next", F.col("id").alias("cycle")), "cycles")
    for _ in range(most_rounds):
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("cycle").alias("theirs"))
        wider = stored(now.join(ahead, "next").select("id", F.col("further").alias("next"), F.least("cycle", "theirs").alias("cycle"), (F.col("theirs") < F.col("cycle")).alias("new")), "cycles")
        settled = wider.filter("new").isEmpty()
        released(now)
        now = wider
        if settled:
            return now.select("id", "cycle")
    raise RuntimeError("cycles did not settle")


def places(steps: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, last, left) of linked lists (id, next), next null at a list's end: the id at the end of each list, and how many steps it is away.

    ids are of any type. A cycle has no end; it must have been cut before.
    """
    now = stored(steps.select("id", "next", F.coalesce("next", "id").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left")), "places")
    for _ in range(most_rounds):
        if now.filter("next is not null").isEmpty():
            return now.select("id", "last", "left")
        ahead = now.select(F.col("id").alias("at"), F.col("next").alias("further"), F.col("last").alias("end"), F.col("left").alias("more"))
        open_ = now.filter("next is not null").join(ahead, F.col("next") == F.col("at")).select("id", F.col("further").alias("next"), F.col("end").alias("last"), (F.col("left") + F.col("more")).alias("left"))
        wider = stored(now.filter("next is null").unionByName(open_), "places")
        released(now)
        now = wider
    raise RuntimeError("lists did not end")

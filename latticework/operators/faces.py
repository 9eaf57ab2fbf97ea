"""Faces of planar subdivisions: half-edges, what follows each around its face, and one label for each cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.operators.chains import cycles
from latticework.sources.scratch import released, stored


def half_edges(edges: DataFrame) -> DataFrame:
    """A stored table (id, next, grp, x1, y1, x2, y2, inside) of edges (grp, x1, y1, x2, y2, left, right) that meet at their ends only.

    Each edge gives two, ids 2 k and 2 k + 1, one for each direction, with what edges say of the side on its left. next is the half-edge
    that follows around the face on the left: at the end of this one, the first one clockwise from the way back. Repeated edges and
    edges without length must be gone before.
    """
    ends = lambda a, b, side, k: F.struct((2 * F.col("k") + k).alias("id"), "grp", *[F.col(f"{c}{s}").alias(f"{c}{t}") for t, s in ((1, a), (2, b)) for c in "xy"], F.col(side).alias("inside"))
    both = stored(edges.withColumn("k", F.monotonically_increasing_id()).select(F.explode(F.array(ends(1, 2, "left", 0), ends(2, 1, "right", 1))).alias("h")).select("h.*"), "half-edges")
    around = W.partitionBy("grp", "x1", "y1").orderBy(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    all_ = around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    clockwise = F.coalesce(F.lag("id").over(around), F.last("id").over(all_))
    # What is clockwise from an edge at its origin follows its twin.
    after = both.select(F.col("id").bitwiseXOR(F.lit(1).cast("long")).alias("id"), clockwise.alias("next"))
    out = stored(both.join(after, "id").select("id", "next", "grp", "x1", "y1", "x2", "y2", "inside"), "half-edges")
    released(both)
    return out


def faces(edges: DataFrame) -> DataFrame:
    """(grp, cycle, sides, area, inside) of the cycles around the faces of edges (grp, x1, y1, x2, y2, left, right).

    A cycle of positive area is the outer border of a bounded face; one of negative area borders what surrounds a connected part.
    """
    h = half_edges(edges)
    each = h.join(cycles(h), "id")
    cross = (F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2")) / 2
    return each.groupBy("grp", "cycle").agg(F.count("*").alias("sides"), F.sum(cross).alias("area"), F.max("inside").alias("inside"))


def summary(edges: DataFrame) -> DataFrame:
    """(grp, vertices, edges, holes, subareas, area): bounded faces inside are subareas, those that aren't are holes; area is that of all that is inside."""
    f = faces(edges)
    bounded = F.col("area") > 1e-9
    by = f.groupBy("grp").agg(
        (F.sum("sides") / 2).cast("long").alias("edges"), F.count(F.when(bounded & ~F.col("inside"), 1)).alias("holes"), F.count(F.when(bounded & F.col("inside"), 1)).alias("subareas"),
        F.coalesce(F.sum(F.when(F.col("inside"), F.col("area"))), F.lit(0.0)).alias("area"),
    )
    ends = edges.select("grp", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).distinct()
    return ends.groupBy("grp").agg(F.count("*").alias("vertices")).join(by, "grp")

"""Loads, masses and boundary conditions of a mesh as tables over unknowns: that of degree of freedom d at node n is dofs n + d.

Conditions are rows (kind, place, id, dof, v0, vx, vy, varies): kind neumann or dirichlet, place segment (an id of mesh segments) or point (an id
of input vertices). A masked degree of freedom has no row. The value at a place is v0 + vx x + vy y where varies is true, else v0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import geometry as G


def element_sums(tri: DataFrame, force: tuple[float, float] = (0.0, 0.0), density: float = 1.0, thickness: float = 1.0) -> DataFrame:
    """(nid, mass, fx, fy): the lumped mass and the load of a body force at each node of linear triangles (elem, n1..y3); a third of each element's to each corner."""
    third = G.tri_area(G.point("x1", "y1"), G.point("x2", "y2"), G.point("x3", "y3")) * thickness / 3
    at = tri.select(third.alias("t"), F.explode(F.array("n1", "n2", "n3")).alias("nid")).groupBy("nid").agg(F.sum("t").alias("t"))
    return at.select("nid", (F.col("t") * density).alias("mass"), (F.col("t") * force[0]).alias("fx"), (F.col("t") * force[1]).alias("fy"))


def pieces(insgm: DataFrame, node: DataFrame) -> DataFrame:
    """(sgm, a, xa, ya, b, xb, yb, length, total) of consecutive nodes of segments (sgm, seq, nid), with the length of the whole segment; a gap in seq parts it."""
    at = insgm.join(node.select("nid", "x", "y"), "nid")
    w = W.partitionBy("sgm").orderBy("seq")
    nxt = lambda c: F.lead(c).over(w)
    p = at.select("sgm", F.col("nid").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), nxt("nid").alias("b"), nxt("x").alias("xb"), nxt("y").alias("yb"), (nxt("seq") - F.col("seq")).alias("gap")).filter("gap = 1").drop("gap")
    p = p.withColumn("length", G.dist(G.point("xa", "ya"), G.point("xb", "yb")))
    return p.join(p.groupBy("sgm").agg(F.sum("length").alias("total")), "sgm")


def _value(x: str, y: str) -> Column:
    return F.col("v0") + F.when(F.col("varies"), F.col("vx") * F.col(x) + F.col("vy") * F.col(y)).otherwise(0.0)


def loads(conditions: DataFrame, insgm: DataFrame, node: DataFrame, vertex: DataFrame, factors: dict[int, float], dofs: int = 2) -> DataFrame:
    """(step, i, f): what neumann conditions add at each unknown, times each step's factor; vertex (id, nid) has the nodes of input vertices.

    A value on a segment that doesn't vary is the whole segment's; each piece has the share of its length and gives half to either end.
    One that varies is a value for each length, by the mean of a piece's two ends.
    """
    told = conditions.filter("kind = 'neumann'")
    on = told.filter("place = 'segment'").withColumnRenamed("id", "sgm").join(pieces(insgm, node), "sgm")
    each = F.when(F.col("varies"), (_value("xa", "ya") + _value("xb", "yb")) / 2 * F.col("length")).otherwise(F.col("v0") * F.col("length") / F.col("total")) / 2
    ends = on.select("dof", each.alias("f"), F.explode(F.array("a", "b")).alias("nid"))
    points = told.filter("place = 'point'").join(vertex.join(node.select("nid", "x", "y"), "nid"), "id").select("dof", _value("x", "y").alias("f"), "nid")
    sums = ends.unionByName(points).groupBy((dofs * F.col("nid") + F.col("dof")).alias("i")).agg(F.sum("f").alias("f"))
    steps = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(float(v)).alias("factor")) for k, v in factors.items()])
    return sums.select("i", "f", F.explode(steps).alias("s")).select("s.step", "i", (F.col("f") * F.col("s.factor")).alias("f"))


def fixed(conditions: DataFrame, insgm: DataFrame, node: DataFrame, vertex: DataFrame, factor: float = 1.0, dofs: int = 2) -> DataFrame:
    """(i, x): the unknowns that dirichlet conditions fix, with their values at the nodes; a point's goes before a segment's, a larger id's before a smaller one's."""
    told = conditions.filter("kind = 'dirichlet'")
    on = told.filter("place = 'segment'").join(insgm.select(F.col("sgm").alias("id"), "nid").distinct(), "id")
    points = told.filter("place = 'point'").join(vertex.select("id", "nid"), "id")
    every = on.unionByName(points).join(node.select("nid", "x", "y"), "nid")
    best = F.max_by(_value("x", "y"), F.struct(F.when(F.col("place") == "point", 1).otherwise(0), F.col("id")))
    return every.groupBy((dofs * F.col("nid") + F.col("dof")).alias("i")).agg((best * factor).alias("x"))

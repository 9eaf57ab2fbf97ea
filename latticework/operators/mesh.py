"""Mesh tables and what is derived from them: (elem, pos, nid), (nid, x, y), faces as (lo, hi)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.operators.components import connected_components
from latticework.sources.scratch import released, stored


def with_corners(elem: DataFrame, node: DataFrame) -> DataFrame:
    """(elem, n1, n2, n3, x1, y1, ..., y3) of triangles (elem, pos, nid) and nodes (nid, x, y)."""
    at = lambda c, k: F.max(F.when(F.col("pos") == k, F.col(c)))
    rows = elem.join(node, "nid").groupBy("elem")
    return rows.agg(*[at("nid", k).alias(f"n{k + 1}") for k in range(3)], *[at(c, k).alias(f"{c}{k + 1}") for k in range(3) for c in "xy"])


def faces(elem: DataFrame) -> DataFrame:
    """(elem, face, lo, hi) of elements with any number of nodes: face k joins node k with the next."""
    w = W.partitionBy("elem").orderBy("pos")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = F.coalesce(F.lead("nid").over(w), F.first("nid").over(whole))
    e = elem.select("elem", F.col("pos").alias("face"), "nid", nxt.alias("nxt"))
    return e.select("elem", "face", F.least("nid", "nxt").alias("lo"), F.greatest("nid", "nxt").alias("hi"))


def edge_table(elem: DataFrame) -> DataFrame:
    return faces(elem).select("lo", "hi").distinct()


def neighbours(elem: DataFrame) -> DataFrame:
    """(src, dst, face, lo, hi): elements that share a face; face is that of src."""
    f = faces(elem)
    other = f.select(F.col("elem").alias("dst"), "lo", "hi")
    return f.join(other, ["lo", "hi"]).filter("elem <> dst").select(F.col("elem").alias("src"), "dst", "face", "lo", "hi")


def boundary_faces(elem: DataFrame) -> DataFrame:
    """(lo, hi, elem, face) of faces that one element has."""
    return faces(elem).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min(F.struct("elem", "face")).alias("of")).filter("n = 1").select("lo", "hi", "of.elem", "of.face")


def dual(elem: DataFrame, ncommon: int) -> DataFrame:
    """(a, b) with a < b of elements that share ncommon nodes, or all but one of either's nodes."""
    n = elem.select("elem", "nid")
    sizes = n.groupBy("elem").agg(F.count("*").alias("size"))
    shared = n.select(F.col("elem").alias("a"), "nid").join(n.select(F.col("elem").alias("b"), "nid"), "nid").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = shared.join(sizes.select(F.col("elem").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("elem").alias("b"), F.col("size").alias("sb")), "b")
    return both.filter((F.col("shared") >= ncommon) | (F.col("shared") >= F.least("sa", "sb") - 1)).select("a", "b")


def areas(elem: DataFrame, tri: DataFrame, walls: DataFrame | None = None) -> DataFrame:
    """(elem, component) by neighbours; faces among walls (lo, hi) block. tri (elem) gives elements without neighbours."""
    links = neighbours(elem)
    if walls is not None:
        links = links.join(walls, ["lo", "hi"], "left_anti")
    found = connected_components(links.filter("src < dst").select("src", "dst"))
    return tri.select("elem").join(found, F.col("elem") == F.col("id"), "left").select("elem", F.coalesce("component", "elem").alias("component"))


def wall_faces(insgm: DataFrame) -> DataFrame:
    """(sgm, lo, hi) of consecutive nodes of input segments (sgm, seq, nid); a gap in seq ends a stretch."""
    w = W.partitionBy("sgm").orderBy("seq")
    e = insgm.select("sgm", "nid", F.lead("nid").over(w).alias("nxt"), (F.lead("seq").over(w) - F.col("seq")).alias("gap")).filter("gap = 1")
    return e.select("sgm", F.least("nid", "nxt").alias("lo"), F.greatest("nid", "nxt").alias("hi"))


def tri_area_of(tri: DataFrame) -> DataFrame:
    return tri.withColumn("area", G.tri_area(G.point("x1", "y1"), G.point("x2", "y2"), G.point("x3", "y3")))


def fans(elem: DataFrame) -> DataFrame:
    """(nid, elem, fan): elements about each node, grouped by the faces at the node that join them; fan is the least element.

    The pair (node, element) is the vertex of the graph; an edge joins two elements that share a face with that node.
    """
    links = neighbours(elem).filter("src < dst")
    at = links.select("src", "dst", F.explode(F.array("lo", "hi")).alias("nid"))
    key = lambda e: F.struct("nid", F.col(e).alias("elem"))
    found = connected_components(at.select(key("src").alias("src"), key("dst").alias("dst")))
    found = found.select(F.col("id.nid").alias("nid"), F.col("id.elem").alias("elem"), F.col("component.elem").alias("fan"))
    return elem.select("nid", "elem").join(found, ["nid", "elem"], "left").select("nid", "elem", F.coalesce("fan", "elem").alias("fan"))


def smoothed(node: DataFrame, elem: DataFrame, insgm: DataFrame, fixed: DataFrame, tol: float, most_rounds: int = 200) -> tuple[DataFrame, int, float]:
    """(node (nid, x, y), rounds, largest move of the last): nodes moved to the mean of their elements' centres until none moves by tol or more.

    Nodes of segments (sgm, seq, nid) slide on the line from their segment's first to its last node; fixed (nid), the ends of segments and nodes of several
    segments stay. An element's centre is the mean of its corners. What has not settled after most_rounds is returned as it is then, with its last move.
    """
    ends = insgm.groupBy("sgm").agg(F.min_by("nid", "seq").alias("first"), F.max_by("nid", "seq").alias("last"))
    at = lambda key, k: node.select(F.col("nid").alias(key), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    line = ends.join(at("first", 1), "first").join(at("last", 2), "last")
    held = insgm.groupBy("nid").agg(F.count_distinct("sgm").alias("n"), F.min("sgm").alias("sgm"))
    stay = fixed.select("nid").unionByName(ends.select(F.explode(F.array("first", "last")).alias("nid"))).unionByName(held.filter("n > 1").select("nid")).distinct().withColumn("stays", F.lit(True))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    slide = held.join(line, "sgm").filter("x1 <> x2 or y1 <> y2").select("nid", "x1", "y1", (dx / F.hypot(dx, dy)).alias("ux"), (dy / F.hypot(dx, dy)).alias("uy"))
    kind = stored(node.select("nid").join(stay, "nid", "left").join(slide, "nid", "left"), "node-kinds")
    now, moved = stored(node.select("nid", "x", "y"), "nodes"), float("inf")
    rounds = 0
    while rounds < most_rounds and moved >= tol:
        centre = elem.join(now, "nid").groupBy("elem").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
        to = elem.join(centre, "elem").groupBy("nid").agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"))
        along = (F.col("cx") - F.col("x1")) * F.col("ux") + (F.col("cy") - F.col("y1")) * F.col("uy")
        new = lambda c: F.when(F.col("stays") | F.col(f"c{c}").isNull(), F.col(c)).when(F.col("ux").isNotNull(), F.col(f"{c}1") + along * F.col(f"u{c}")).otherwise(F.col(f"c{c}"))  # noqa: B023, E731
        step = now.join(kind, "nid").join(to, "nid", "left").select("nid", new("x").alias("x"), new("y").alias("y"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        before, step = now, stored(step, "nodes")
        moved = step.agg(F.max(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))).first()[0] or 0.0
        now = step.select("nid", "x", "y")
        released(before)
        rounds += 1
    return now, rounds, moved


def shape_gradients(tri: DataFrame) -> DataFrame:
    """tri with det (twice the area) and the gradients bx1..by3 of the linear shape functions; det below zero is distorted."""
    det = G.orient(G.point("x1", "y1"), G.point("x2", "y2"), G.point("x3", "y3"))
    t = tri.withColumn("det", det)
    for k, (i, j) in enumerate(((2, 3), (3, 1), (1, 2)), 1):
        t = t.withColumns({f"bx{k}": F.try_divide(F.col(f"y{i}") - F.col(f"y{j}"), "det"), f"by{k}": F.try_divide(F.col(f"x{j}") - F.col(f"x{i}"), "det")})
    return t


def corners_long(tri: DataFrame, *carry: str) -> DataFrame:
    """A row for each corner k of each triangle with its node and gradient."""
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("nid"), F.col(f"bx{k}").alias("bx"), F.col(f"by{k}").alias("by")) for k in (1, 2, 3)])
    return tri.select("elem", "det", *carry, F.explode(items).alias("c")).select("elem", "det", *carry, "c.*")


def strains(tri: DataFrame, field: DataFrame) -> DataFrame:
    """(elem, det, exx, eyy, gxy) of a nodal displacement (nid, comp, value)."""
    u = corners_long(shape_gradients(tri)).join(field, "nid")
    part = lambda c, g: F.sum(F.when(F.col("comp") == c, F.col("value") * F.col(g)))
    return u.groupBy("elem", "det").agg(part(0, "bx").alias("exx"), part(1, "by").alias("eyy"), (part(0, "by") + part(1, "bx")).alias("gxy"))


def stiffness(tri: DataFrame, d: tuple[float, float, float], thickness: float = 1.0) -> DataFrame:
    """(i, j, v) of the assembled matrix; the unknowns of node n are 2 n and 2 n + 1. Blocks of elements are summed by (i, j)."""
    scale = F.col("det") / 2 * thickness
    d11, d12, d33 = (F.lit(v) for v in d)

    def block(k: int, m: int) -> list[list[Column]]:
        ax, ay, cx, cy = (F.col(f"b{c}{n}") for n in (k, m) for c in "xy")
        return [[d11 * ax * cx + d33 * ay * cy, d12 * ax * cy + d33 * ay * cx], [d12 * ay * cx + d33 * ax * cy, d11 * ay * cy + d33 * ax * cx]]

    # An element goes to each of its nodes once, as it is, and gives that node's rows there: a node's blocks are never in more than one task.
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n")) for k in (1, 2, 3)])
    whole = [f"{c}{k}" for k in (1, 2, 3) for c in "nxy"]
    t = shape_gradients(tri.select(F.explode(ends).alias("at"), *whole).select("at.k", "at.n", *whole).repartition("n"))
    blocks = [(k, m, F.struct(F.col(f"n{m}").alias("m"), *[(scale * block(k, m)[p][q]).alias(f"v{p}{q}") for p in (0, 1) for q in (0, 1)])) for k in (1, 2, 3) for m in (1, 2, 3)]
    of = F.when(F.col("k") == 1, F.array(*[b for k, _, b in blocks if k == 1])).when(F.col("k") == 2, F.array(*[b for k, _, b in blocks if k == 2])).otherwise(F.array(*[b for k, _, b in blocks if k == 3]))
    sums = t.select("n", F.explode(of).alias("b")).select("n", "b.*").groupBy("n", "m").agg(*[F.sum(f"v{p}{q}").alias(f"v{p}{q}") for p in (0, 1) for q in (0, 1)])
    cells = [F.struct((2 * F.col("n") + p).alias("i"), (2 * F.col("m") + q).alias("j"), F.col(f"v{p}{q}").alias("v")) for p in (0, 1) for q in (0, 1)]
    return sums.select(F.explode(F.array(*cells)).alias("e")).select("e.*")

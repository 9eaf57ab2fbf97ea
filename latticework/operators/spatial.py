"""Joins of points, circles, polygons and segments through grid cells.

Both sides are dealt out by grid cell and meet in an equi-join; the exact test follows. A side whose shapes span
several cells is exploded over them. A dense cell is a skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.sources.scratch import released, stored


def over_cells(df: DataFrame, size: float, x1: Column, y1: Column, x2: Column, y2: Column) -> DataFrame:
    """df with a row for each cell (bx, by) of the box."""
    wide = df.withColumn("bx", F.explode(F.sequence(G.cell(x1, size), G.cell(x2, size))))
    return wide.withColumn("by", F.explode(F.sequence(G.cell(y1, size), G.cell(y2, size))))


def over_segment_cells(df: DataFrame, size: float, grow: float = G.TOL) -> DataFrame:
    """df with a row for each cell (bx, by) that its segment (x1, y1, x2, y2), grown by a little, may touch: as many as it is long, not as its box is large."""
    low, high = F.least("x1", "x2") - grow, F.greatest("x1", "x2") + grow
    wide = df.withColumn("bx", F.explode(F.sequence(G.cell(low, size), G.cell(high, size))))
    # The part of the segment over this column of cells, one cell wider where rounding might count.
    slope = F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    steep = slope.isNull() | (F.abs(slope) > 1e9)
    at = lambda x: F.col("y1") + slope * (F.greatest(F.least("x1", "x2"), F.least(F.greatest("x1", "x2"), x)) - F.col("x1"))
    left, right = at(F.col("bx") * size - grow), at((F.col("bx") + 1) * size + grow)
    bottom, top = F.least("y1", "y2"), F.greatest("y1", "y2")
    more = grow * (2 + F.abs(F.coalesce(slope, F.lit(0.0))))
    first = F.when(steep, bottom).otherwise(F.greatest(bottom, F.least(left, right) - more)) - grow
    last = F.when(steep, top).otherwise(F.least(top, F.greatest(left, right) + more)) + grow
    return wide.withColumn("by", F.explode(F.sequence(G.cell(first, size), F.greatest(G.cell(first, size), G.cell(last, size)))))


def with_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"bx": G.cell(F.col("x"), size), "by": G.cell(F.col("y"), size)})


def points_in_circles(points: DataFrame, circles: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """Points (pid, x, y) strictly inside circles (cid, cx, cy, r). A point has one cell, so no pair comes twice."""
    c = over_cells(circles, size, F.col("cx") - F.col("r"), F.col("cy") - F.col("r"), F.col("cx") + F.col("r"), F.col("cy") + F.col("r"))
    p = with_cell(points, size)
    inside = F.col("r") * F.col("r") - G.dist2((F.col("x"), F.col("y")), (F.col("cx"), F.col("cy"))) > G.TOL2
    if how == "inner":
        return p.join(c, ["bx", "by"]).filter(inside).drop("bx", "by")
    p = p.withColumnsRenamed({"bx": "px", "by": "py"})
    found = c.join(p, (F.col("bx") == F.col("px")) & (F.col("by") == F.col("py")) & inside, how)
    return found.select(*circles.columns).distinct()


def fitting_cell(points: DataFrame, box, k: float, size: float, bins: int = 64) -> float:
    """A cell size at which a point of box (x1, y1, x2, y2) has about k points in its cell, itself included, told by counts in bins x bins; size where the box has no area."""
    if not (box[2] > box[0] and box[3] > box[1]):
        return size
    at = lambda c, low, high: F.floor((F.col(c) - low) / (high - low) * (bins - 1e-6))
    counts = points.groupBy(at("x", box[0], box[2]).alias("c"), at("y", box[1], box[3]).alias("r")).agg(F.count("*").cast("double").alias("n"))
    squares, n = counts.agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
    return ((box[2] - box[0]) * (box[3] - box[1]) / bins**2 * k * n / squares) ** 0.5


def knn(queries: DataFrame, points: DataFrame, k: int, size: float | None = None, keep: Callable[[Column, Column], Column] | None = None, most_rounds: int = 40, beyond: float = 0.0) -> DataFrame:
    """(qid, pid, dist, rank): the k nearest points of each query (qid, qx, qy) further away than beyond (none at it, if it is above zero), ties by pid, a point of the query's id left out.

    A round looks into the cells of size that the ring from beyond to beyond + size about each open query may touch; without beyond these are 3 x 3. A query is settled
    once its kth distance is no larger than the ring's end, or the ring covers all points; the others go on with cells of twice the size. Where size isn't given, it
    follows from how many points lie in their box, so that a query meets as many points of a larger table as of a small one. keep(distance, pid) is tested before ranking.
    """
    box = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box[0] is None:
        return queries.select("qid", F.lit(None).cast("long").alias("pid"), F.lit(None).cast("double").alias("dist"), F.lit(None).cast("int").alias("rank")).filter("false")
    p = stored(points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(), "points")
    if size is None:
        # Of a ring, cells and points are to be about as many.
        size = fitting_cell(p, box, k if beyond <= 0 else 1.0, 1.0)
    # A query has many rows of cells, so queries are dealt out before.
    open_queries, done = queries.select("qid", "qx", "qy").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))), None
    for _ in range(most_rounds):
        q = (F.col("qx"), F.col("qy"))
        reach = beyond + size
        cells = over_cells(open_queries, size, q[0] - reach, q[1] - reach, q[0] + reach, q[1] + reach) if beyond <= 0 else over_ring_cells(open_queries, size, beyond, reach)
        near = cells.hint("merge").join(with_cell(p, size), ["bx", "by"]).filter("pid <> qid")
        near = near.select("qid", "pid", G.dist((F.col("x"), F.col("y")), q).alias("dist"))
        if beyond > 0:
            near = near.filter(F.col("dist") > beyond)
        if keep is not None:
            near = near.filter(keep(F.col("dist"), F.col("pid")))
        near = near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("dist", "pid"))).filter(F.col("rank") <= k)
        # Ranked once, then read for what is settled and what is open.
        best = stored(near, "near")
        cx, cy = G.cell(q[0], size), G.cell(q[1], size)
        if beyond <= 0:
            # The seen square reaches at least one cell beyond the query's own.
            border = F.least(q[0] - (cx - 1) * size, (cx + 2) * size - q[0], q[1] - (cy - 1) * size, (cy + 2) * size - q[1])
            covers = ((cx - 1) * size <= box[0]) & ((cx + 2) * size >= box[2]) & ((cy - 1) * size <= box[1]) & ((cy + 2) * size >= box[3])
        else:
            border = F.lit(reach)
            covers = F.greatest(*[G.dist(q, (F.lit(x), F.lit(y))) for x in (box[0], box[2]) for y in (box[1], box[3])]) <= reach
        kth = best.groupBy("qid").agg(F.count("*").alias("n"), F.max("dist").alias("kth"))
        state = stored(open_queries.join(kth, "qid", "left").withColumn("settled", F.coalesce(covers | ((F.col("n") >= k) & (F.col("kth") <= border)), F.lit(False))), "queries")
        found = best.join(state.filter("settled").select("qid"), "qid", "left_semi")
        done = found if done is None else done.unionByName(found)
        open_queries = state.filter("not settled").select("qid", "qx", "qy")
        if open_queries.isEmpty():
            return done
        size *= 2
    raise RuntimeError("queries did not settle")


def over_ring_cells(queries: DataFrame, size: float, inner: float, outer: float) -> DataFrame:
    """queries with a row for each cell (bx, by) that may have a point further than inner and no further than outer from (qx, qy)."""
    wide = queries.withColumn("bx", F.explode(F.sequence(G.cell(F.col("qx") - outer, size), G.cell(F.col("qx") + outer, size))))
    # How far the column of cells is from the query at least and at most.
    low, high = F.col("bx") * size - F.col("qx"), (F.col("bx") + 1) * size - F.col("qx")
    more = 1e-9 * (1 + outer + F.abs("qx"))
    near, far = F.greatest(low - more, -high - more, F.lit(0.0)), F.greatest(F.abs(low), F.abs(high)) + more
    # Heights up to half meet the outer circle; cells wholly between -hole and hole lie inside the inner one. Rounding is met by a little more.
    half = F.sqrt(F.greatest(F.lit(outer * outer) - near * near, F.lit(0.0))) + 1e-9 * (1 + outer)
    hole = F.when(far < inner, F.sqrt(F.greatest(F.lit(inner * inner) - far * far, F.lit(0.0))) - 1e-9 * (1 + inner)).otherwise(0.0)
    wide = wide.select("*", half.alias("half"), F.greatest(hole, F.lit(0.0)).alias("hole"))
    # below is the hole's first cell with points outside of it, above its last.
    wide = wide.select(*queries.columns, "bx", "hole", *[G.cell(F.col("qy") + way, size).alias(name) for name, way in (("first", -F.col("half")), ("last", F.col("half")), ("below", -F.col("hole")), ("above", F.col("hole")))])
    rows = F.when(F.expr("hole > 0 and above > below"), F.expr("concat(sequence(first, greatest(first, below)), sequence(least(above, last), last))")).otherwise(F.expr("sequence(first, last)"))
    return wide.select(*queries.columns, "bx", F.explode(rows).alias("by"))


def points_in_polygons(points: DataFrame, rings: DataFrame, size: float, most: int = 1_000) -> DataFrame:
    """(pid, poly_id) of points inside rings (poly_id, seq, x, y), by the parity of edges to the right.

    An edge counts for a point if its ends lie on different sides of the point's height, the lower end included. Rings of up to most edges
    meet points whole, as one row in each cell of their box, so pairs are told where they meet and never shuffled. Edges of longer rings
    meet points by cell on their own, and are counted for each pair.
    """
    e = ring_edges(rings)
    box = [F.min(F.least("y1", "y2")).alias("ly"), F.max(F.greatest("y1", "y2")).alias("hy"), F.min("x1").alias("lx"), F.max("x1").alias("hx"), F.count("*").alias("edges")]
    boxes = e.groupBy("poly_id").agg(*box)
    p = with_cell(points.select("pid", "x", "y"), size)
    right = lambda x1, y1, x2, y2: F.coalesce(((y1 > F.col("y")) != (y2 > F.col("y"))) & (F.col("x") < x1 + F.try_divide(F.col("y") - y1, y2 - y1) * (x2 - x1)), F.lit(False))
    long = e.join(boxes.filter(F.col("edges") > most), "poly_id")
    short = e.join(boxes.filter(F.col("edges") > most).select("poly_id"), "poly_id", "left_anti")
    whole = short.groupBy("poly_id").agg(*box, F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("ring"))
    met = p.join(over_cells(whole, size, F.col("lx"), F.col("ly"), F.col("hx"), F.col("hy")).hint("merge"), ["bx", "by"]).filter("x >= lx and x <= hx and y >= ly and y <= hy")
    crossed = F.aggregate("ring", F.lit(False), lambda odd, s: odd != right(s["x1"], s["y1"], s["x2"], s["y2"]))
    inside = met.filter(crossed).select("pid", "poly_id")
    if long.isEmpty():
        return inside
    cells = over_cells(long, size, F.col("lx"), F.least("y1", "y2"), F.col("hx"), F.greatest("y1", "y2")).hint("merge")
    hit = p.join(cells, ["bx", "by"]).filter("x >= lx and x <= hx and (y1 > y) <> (y2 > y)")
    odd = hit.groupBy("pid", "poly_id").agg(F.sum(right(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).cast("int")).alias("n")).filter("n % 2 = 1")
    return inside.unionByName(odd.select("pid", "poly_id"))


def ring_edges(rings: DataFrame) -> DataFrame:
    """(poly_id, seq, x1, y1, x2, y2): each vertex with the next, the last with the first."""
    w = W.partitionBy("poly_id").orderBy("seq")
    first = W.partitionBy("poly_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(first))
    return rings.select("poly_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def points_on_edges(points: DataFrame, edges: DataFrame, size: float, tol: float = G.TOL, within: list[str] = ()) -> DataFrame:
    """points joined to the edges (x1, y1, x2, y2) that they lie strictly inside of; within names columns that both must share."""
    grow = 2 * tol
    e = over_cells(edges, size, F.least("x1", "x2") - grow, F.least("y1", "y2") - grow, F.greatest("x1", "x2") + grow, F.greatest("y1", "y2") + grow)
    on = G.point_on_segment(G.point("x1", "y1"), G.point("x2", "y2"), G.point("x", "y"), tol)
    return with_cell(points, size).join(e, [*within, "bx", "by"]).filter(on).drop("bx", "by")


def locate(points: DataFrame, triangles: DataFrame, size: float) -> DataFrame:
    """(pid, elem): the first triangle (elem, x1..y3) that contains each point, borders included."""
    xs, ys = [F.col(f"x{k}") for k in (1, 2, 3)], [F.col(f"y{k}") for k in (1, 2, 3)]
    t = over_cells(triangles, size, F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))
    inside = G.point_in_triangle(G.point("x1", "y1"), G.point("x2", "y2"), G.point("x3", "y3"), G.point("x", "y"))
    return with_cell(points.select("pid", "x", "y"), size).join(t, ["bx", "by"]).filter(inside).groupBy("pid").agg(F.min("elem").alias("elem"))


def crossing_pairs(segs: DataFrame, size: float, touching: bool = False, within: list[str] = (), walk: bool = False) -> DataFrame:
    """(a, b) with a < b of segments (sid, x1, y1, x2, y2) that cross, or lie on one line and overlap; within names columns that both must share.

    Where touching is true, an end on the other segment counts too. A pair that shares several cells is reported in
    the lowest of them, so no distinct is needed. With walk, for segments far longer than a cell, they meet in the cells that they cross only, not
    in all of their boxes, and pairs are made distinct in the end. The test is by orientations, which is short enough to compile.
    """
    low_x, low_y = F.least("x1", "x2"), F.least("y1", "y2")
    long = segs.select(*within, "sid", "x1", "y1", "x2", "y2").withColumns({"cx": F.lit(0), "cy": F.lit(0)})
    s = over_segment_cells(long, size) if walk else over_cells(segs.select(*within, "sid", "x1", "y1", "x2", "y2").withColumns({"cx": G.cell(low_x, size), "cy": G.cell(low_y, size)}), size, low_x, low_y, F.greatest("x1", "x2"), F.greatest("y1", "y2"))
    left = s.select(*within, "bx", "by", *[F.col(c).alias(f"a_{c}") for c in ("sid", "x1", "y1", "x2", "y2", "cx", "cy")])
    right = s.select(*within, "bx", "by", *[F.col(c).alias(f"b_{c}") for c in ("sid", "x1", "y1", "x2", "y2", "cx", "cy")])
    lowest = (F.col("bx") == F.greatest("a_cx", "b_cx")) & (F.col("by") == F.greatest("a_cy", "b_cy"))
    a1, a2, b1, b2 = (G.point(f"{s}_x{k}", f"{s}_y{k}") for s in "ab" for k in (1, 2))
    along = lambda p: (p[0] - a1[0]) * (a2[0] - a1[0]) + (p[1] - a1[1]) * (a2[1] - a1[1])
    pairs = left.join(right, [*within, "bx", "by"]).filter((F.col("a_sid") < F.col("b_sid")) & (F.lit(True) if walk else lowest))
    signs = pairs.select(*within, "a_sid", "b_sid", G.orient(a1, a2, b1).alias("o1"), G.orient(a1, a2, b2).alias("o2"), G.orient(b1, b2, a1).alias("o3"), G.orient(b1, b2, a2).alias("o4"), G.dist2(a1, a2).alias("l2"), along(b1).alias("s1"), along(b2).alias("s2"))
    line = (F.abs("o1") < G.TOL) & (F.abs("o2") < G.TOL) & (F.greatest("s1", "s2") > 0) & (F.least("s1", "s2") < F.col("l2"))
    cross = (F.col("o1") * F.col("o2") < 0) & (F.col("o3") * F.col("o4") < 0)
    if touching:
        tol = 1e-9
        cross = (F.col("o1") * F.col("o2") <= tol) & (F.col("o3") * F.col("o4") <= tol) & (F.abs(F.col("o1") - F.col("o2")) > G.TOL)
    found = signs.filter(cross | line).select(*within, F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
    return found.distinct() if walk else found


def near_pairs(points: DataFrame, reach: float, within: list[str] = ()) -> DataFrame:
    """(a, b, d2) with a < b of points closer than reach, by 3 x 3 cells of that size; within names columns that both must share."""
    p = points.select(*within, F.col("pid").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    wide = over_cells(p, reach, F.col("ax") - reach, F.col("ay") - reach, F.col("ax") + reach, F.col("ay") + reach)
    other = with_cell(points.select(*within, F.col("pid").alias("b"), "x", "y"), reach)
    d2 = G.dist2(G.point("ax", "ay"), G.point("x", "y"))
    return wide.join(other, [*within, "bx", "by"]).filter((F.col("a") < F.col("b")) & (d2 < reach * reach)).select(*within, "a", "b", d2.alias("d2"))


def hull_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull, counter-clockwise; points on its sides are none."""
    order = np.lexsort((y, x))
    order = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)][: len(order)]].tolist()

    def half(places: list[int]) -> list[int]:
        out: list[int] = []
        for c in places:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[c] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[c] - x[out[-2]]) <= 0:
                out.pop()
            out.append(c)
        return out

    if len(order) < 3:
        return np.array(order, np.int64)
    return np.array(half(order)[:-1] + half(order[::-1])[:-1], np.int64)


def convex_hull(points: DataFrame, most: int = 1_000_000, fan: int = 16) -> np.ndarray:
    """The corners (x, y) of the convex hull of points; each task keeps its own hull, and hulls meet in ever fewer tasks.

    Only corners come to the driver; beyond most of them it raises. Points with a null are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.empty(0), np.empty(0)
        for batch in batches:
            x, y = np.r_[x, batch["x"].to_numpy()], np.r_[y, batch["y"].to_numpy()]
            at = hull_of(x, y)
            x, y = x[at], y[at]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    now = stored(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().mapInArrow(run, "x double, y double"), "hull")
    parts = now.select(F.input_file_name()).distinct().count()
    while parts > 1:
        parts = -(-parts // fan)
        now = stored(now.coalesce(parts).mapInArrow(run, "x double, y double"), "hull")
    if now.count() > most:
        raise RuntimeError(f"the hull has more than {most} corners")
    table = now.toArrow()
    x, y = table["x"].to_numpy(), table["y"].to_numpy()
    at = hull_of(x, y)
    return np.c_[x[at], y[at]]


def _with_points_left(segs: DataFrame, corners: np.ndarray) -> DataFrame:
    """segs (sid, x1, y1, x2, y2) with a point strictly on their left: then a corner of all points' hull lies there."""
    sent = segs.sparkSession.sparkContext.broadcast(corners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            x1, y1, x2, y2 = (batch[n].to_numpy()[:, None] for n in ("x1", "y1", "x2", "y2"))
            most = np.concatenate([np.full((len(x1), 1), -np.inf), *[((x2 - x1) * (p[:, 1] - y1) - (y2 - y1) * (p[:, 0] - x1)).max(axis=1, keepdims=True) for p in np.array_split(c, max(1, len(c) // 256)) if len(p)]], axis=1).max(axis=1)
            yield batch.take(pa.array(np.flatnonzero(most >= G.TOL)))

    return segs.mapInArrow(run, segs.schema)


def half_plane_candidates(segs: DataFrame, points: DataFrame, size: float, first: int = 1, most_rounds: int = 64) -> DataFrame:
    """(sid, pid, layer): points strictly left of each segment in the first circle through its ends that holds any.

    Circle number l has its centre left of the segment and radius (1 + l) times the segment's length. Left of the segment these circles
    lie in one another, so a point's first circle follows from where it lies. A round looks into a circle for each open segment, over cells of
    the round's size on its left side, for the number of its first circle; segments without any point there go on with a circle and cells of twice the size.
    Pairs are listed last, from the first circles alone, and stored nowhere: they are as many as the result. Segments
    that have no point on their left leave before, by the hull of all points; segments without length or with a null have none.
    """
    a, b = G.point("x1", "y1"), G.point("x2", "y2")
    known = segs.select(F.col("sid"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).dropna().filter("x1 <> x2 or y1 <> y2")
    p = stored(points.select("pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(), "points")
    length = G.dist(a, b)

    def met(s: DataFrame, radius: Column, side: float) -> DataFrame:
        """s with each point left of the segment in its circle of that radius, and the number of the point's first circle."""
        s = s.withColumn("r", radius)
        cx, cy = G.center_from_segment(a, b, F.col("r"))
        s = over_cells(s.withColumns({"cx": cx, "cy": cy}), side, F.col("cx") - F.col("r"), F.col("cy") - F.col("r"), F.col("cx") + F.col("r"), F.col("cy") + F.col("r"))
        corner = lambda i, j: G.orient(a, b, ((F.col("bx") + i) * side, (F.col("by") + j) * side))
        s = s.filter(F.greatest(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)) > 0)
        near = with_cell(p, side).join(s.hint("merge"), ["bx", "by"]).filter(G.half_side(a, b, G.point("x", "y")) & (F.col("r") * F.col("r") - G.dist2(G.point("x", "y"), G.point("cx", "cy")) > G.TOL2))
        # From the middle of the segment: along it, and away from it to the left.
        mx, my = F.col("x") - (F.col("x1") + F.col("x2")) / 2, F.col("y") - (F.col("y1") + F.col("y2")) / 2
        away, half2 = G.orient(a, b, G.point("x", "y")) / length, G.dist2(a, b) / 4
        # A circle whose centre is further left than this one holds the point.
        height = (mx * mx + my * my - half2) / (2 * away)
        layer = F.when(height <= 0, 0).otherwise(F.greatest(F.lit(0), F.floor(F.sqrt(height * height + half2) / length))).cast("long")
        return near.select(*[c for c in ("sid", "low") if c in near.columns], "pid", layer.alias("layer"))

    open_, out = stored(_with_points_left(known, convex_hull(p)), "segments"), None
    for k in range(most_rounds):
        if open_.isEmpty():
            return segs.select("sid").limit(0).select("sid", F.lit(None).cast("long").alias("pid"), F.lit(None).cast("long").alias("layer")) if out is None else out
        side, reach = size * 2.0**k, float(first * 2**k)
        low = stored(met(open_, reach * length, side).groupBy("sid").agg(F.min("layer").alias("low")), "lows")
        settled = stored(open_.join(low, "sid"), "segments")
        # A little wider than the first circle, so that its rim is told by the number alone.
        new = met(settled, F.least(F.lit(reach), F.col("low") + 1.001) * length, side).filter("layer = low").select("sid", "pid", "layer")
        if not settled.isEmpty():
            out = new if out is None else out.unionByName(new)
        before, open_ = open_, stored(open_.join(low, "sid", "left_anti"), "segments")
        released(before)
        released(low)
    raise RuntimeError("segments did not settle")

"""Planar models as tables: vertex (model, vid, x, y), edge (model, eid, v1, v2), hole (model, hid, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.operators import spatial as S
from latticework.operators.chains import places
from latticework.operators.components import connected_components
from latticework.sources.scratch import stored

def edge_ends(vertex: DataFrame, edge: DataFrame) -> DataFrame:
    at = lambda k: vertex.select("model", F.col("vid").alias(f"v{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    return edge.join(at(1), ["model", "v1"]).join(at(2), ["model", "v2"])


def check(vertex: DataFrame, edge: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(model, code): 0 if sound, else the first of 1 no vertices, 2 no edges, 3 repeated vertices, 4 edge ends that don't exist,
    5 repeated edges, 6 edges that cross, 7 a vertex on an edge. Vertices repeat if their squared distance is below tol.

    Models may lie over one another: all joins are by model and cell.
    """
    models = vertex.select("model").unionByName(edge.select("model")).distinct()
    bad = [
        models.join(vertex.select("model"), "model", "left_anti").select("model", F.lit(1).alias("code")),
        models.join(edge.select("model"), "model", "left_anti").select("model", F.lit(2).alias("code")),
        S.near_pairs(vertex.select("model", F.col("vid").alias("pid"), "x", "y"), tol**0.5, ["model"]).select("model", F.lit(3).alias("code")),
        edge.select("model", F.explode(F.array("v1", "v2")).alias("vid")).join(vertex.select("model", "vid"), ["model", "vid"], "left_anti").select("model", F.lit(4).alias("code")),
        edge.groupBy("model", F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b")).count().filter("count > 1").select("model", F.lit(5).alias("code")),
    ]
    e = edge_ends(vertex, edge)
    size = 1.0
    cross = S.crossing_pairs(e.withColumnRenamed("eid", "sid"), size, within=["model"])
    bad.append(cross.select("model", F.lit(6).alias("code")))
    on = S.points_on_edges(vertex.select("model", F.col("vid").alias("pid"), "x", "y"), e, size, tol, ["model"])
    bad.append(on.filter("pid <> v1 and pid <> v2").select("model", F.lit(7).alias("code")))
    all_bad = bad[0]
    for b in bad[1:]:
        all_bad = all_bad.unionByName(b)
    return models.join(all_bad.groupBy("model").agg(F.min("code").alias("code")), "model", "left").select("model", F.coalesce("code", F.lit(0)).alias("code"))


def wires(edge: DataFrame) -> DataFrame:
    """(model, eid, wire): edges that follow one another through vertices of exactly two edges; wire is the least eid."""
    ends = edge.select("model", "eid", F.explode(F.array("v1", "v2")).alias("vid"))
    joints = ends.groupBy("model", "vid").agg(F.count("*").alias("n"), F.min("eid").alias("a"), F.max("eid").alias("b")).filter("n = 2 and a <> b")
    key = lambda e: F.struct("model", F.col(e).alias("eid"))
    found = connected_components(joints.select(key("a").alias("src"), key("b").alias("dst"))).select("id.model", "id.eid", F.col("component.eid").alias("wire"))
    return edge.select("model", "eid").join(found, ["model", "eid"], "left").select("model", "eid", F.coalesce("wire", "eid").alias("wire"))


def wire_order(edge: DataFrame) -> DataFrame:
    """(model, eid, wire, place, forward): each edge's place along its wire from 0, and whether it is walked from v1 to v2.

    A wire with ends begins at that of the smaller vertex (both the same: at its least edge, from the end that it has there), a closed one
    at its least edge from v1. Loops at one vertex are wires of their own.
    """
    named = stored(edge.join(wires(edge), ["model", "eid"]).select("model", "eid", "v1", "v2", "wire"), "wires")
    end = lambda a, b, k: F.struct("model", "wire", "eid", F.lit(k).alias("back"), F.col(a).alias("u"), F.col(b).alias("v"))
    ways = stored(named.select(F.explode(F.array(end("v1", "v2", 0), end("v2", "v1", 1))).alias("e")).select("e.*"), "ways")
    key = F.struct("model", "eid", "back")
    joints = ways.groupBy("model", F.col("u").alias("at")).agg(F.count("*").alias("n"), F.count_distinct("eid").alias("k")).filter("n = 2 and k = 2").select("model", "at")
    # What leaves a joint by its other edge follows.
    onward = ways.select("model", F.col("wire").alias("of"), F.col("u").alias("v"), F.col("eid").alias("next_eid"), F.col("back").alias("next_back"))
    follow = ways.join(joints.withColumnRenamed("at", "v"), ["model", "v"]).join(onward, ["model", "v"]).filter("eid <> next_eid").select("model", "eid", "back", "next_eid", "next_back")
    steps = ways.join(follow, ["model", "eid", "back"], "left")
    # Closed wires have joints only; they are cut before their least edge.
    open_wires = ways.join(joints.withColumnRenamed("at", "u"), ["model", "u"], "left_anti").select("model", "wire").distinct().withColumn("ends", F.lit(True))
    steps = steps.join(open_wires, ["model", "wire"], "left")
    next_ = F.when(F.col("next_eid").isNotNull() & (F.col("ends") | (F.col("next_eid") != F.col("wire"))), F.struct("model", F.col("next_eid").alias("eid"), F.col("next_back").alias("back")))
    found = places(steps.select(key.alias("id"), next_.alias("next")))
    at = found.select("id.model", "id.eid", "id.back", "last", "left").join(ways, ["model", "eid", "back"])
    # The walk of two that begins at the smaller vertex, or at the least edge from v1.
    heads = at.join(open_wires, ["model", "wire"], "left").groupBy("model", "wire", "last").agg(F.max("left").alias("most"), F.max_by(F.struct("u", "eid", "back"), "left").alias("head"), F.max("ends").alias("ends"))
    first = F.when(F.col("ends"), F.struct(F.col("head.u").alias("a"), F.col("head.eid").alias("b"), F.col("head.back").alias("c"))).otherwise(F.struct(F.lit(None).cast("long").alias("a"), F.col("head.eid").alias("b"), F.col("head.back").alias("c")))
    chosen = heads.groupBy("model", "wire").agg(F.min_by(F.struct("last", "most"), first).alias("w")).select("model", "wire", F.col("w.last").alias("last"), "w.most")
    return at.join(chosen, ["model", "wire", "last"]).select("model", "eid", "wire", (F.col("most") - F.col("left")).alias("place"), (F.col("back") == 0).alias("forward"))


def collapse_small(vertex: DataFrame, edge: DataFrame, tol: float, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertex, edge) with the ends of edges shorter than tol merged, at their fixed vertex or else at their mean.

    fixed (model, vid). Chains of short edges merge as a whole; loops and repeated edges that result are dropped.
    """
    e = edge_ends(vertex, edge)
    short = e.filter(G.dist(G.point("x1", "y1"), G.point("x2", "y2")) < tol)
    key = lambda v: F.struct("model", F.col(v).alias("vid"))
    found = connected_components(short.select(key("v1").alias("src"), key("v2").alias("dst"))).select("id.model", "id.vid", F.col("component.vid").alias("to"))
    of = vertex.join(found, ["model", "vid"], "left").withColumn("to", F.coalesce("to", "vid")).join(fixed.select("model", "vid").distinct().withColumn("fixed", F.lit(True)), ["model", "vid"], "left")
    mean = lambda c: F.coalesce(F.min_by(F.when(F.col("fixed"), F.col(c)), F.when(F.col("fixed"), F.col("vid"))), F.avg(c)).alias(c)
    merged = of.groupBy("model", F.col("to").alias("vid")).agg(mean("x"), mean("y"))
    new = of.select("model", "vid", "to")
    moved = edge.join(new.select("model", F.col("vid").alias("v1"), F.col("to").alias("t1")), ["model", "v1"]).join(new.select("model", F.col("vid").alias("v2"), F.col("to").alias("t2")), ["model", "v2"]).filter("t1 <> t2")
    kept = moved.groupBy("model", F.least("t1", "t2").alias("v1"), F.greatest("t1", "t2").alias("v2")).agg(F.min("eid").alias("eid"))
    return merged, kept.select("model", "eid", "v1", "v2")


def subareas(vertex: DataFrame, edge: DataFrame, hole: DataFrame) -> DataFrame:
    """(model, areas): bounded faces of noded models, edges less vertices plus components, less the holes."""
    key = lambda v: F.struct("model", F.col(v).alias("vid"))
    used = edge.select("model", F.explode(F.array("v1", "v2")).alias("vid")).distinct().groupBy("model").agg(F.count("*").alias("n"))
    parts = connected_components(edge.select(key("v1").alias("src"), key("v2").alias("dst"))).select(F.col("component").alias("c")).distinct().groupBy(F.col("c.model").alias("model")).agg(F.count("*").alias("k"))
    m = edge.groupBy("model").agg(F.count("*").alias("m"))
    h = hole.groupBy("model").agg(F.count("*").alias("h"))
    return m.join(used, "model").join(parts, "model").join(h, "model", "left").select("model", (F.col("m") - F.col("n") + F.col("k") - F.coalesce("h", F.lit(0))).alias("areas"))


KINDS = ("combination", "union", "intersection", "difference", "subtraction")


def overlay_sides(a: DataFrame, b: DataFrame, size: float, eps: float = 1e-6) -> DataFrame:
    """A stored table (x1, y1, x2, y2, la, lb, ra, rb) of the sub-edges of ring tables a and b (poly_id, seq, x, y), cut where they meet: whether
    what lies left and right of each is in a and in b.
    """
    ea, eb = S.ring_edges(a), S.ring_edges(b)
    both = ea.select(F.struct(F.lit(0).alias("s"), "poly_id", "seq").alias("sid"), "x1", "y1", "x2", "y2").unionByName(eb.select(F.struct(F.lit(1).alias("s"), "poly_id", "seq").alias("sid"), "x1", "y1", "x2", "y2"))
    pairs = S.crossing_pairs(both, size, touching=True).filter("a.s <> b.s")
    one = lambda s: both.select(F.col("sid").alias(s), *[F.col(c).alias(f"{s}{c}") for c in ("x1", "y1", "x2", "y2")])
    met = pairs.join(one("a"), "a").join(one("b"), "b")
    p = [G.point(f"{s}x{k}", f"{s}y{k}") for s in "ab" for k in (1, 2)]
    cuts = stored(met, "pairs").select("a", "b", G.intersection(*p).alias("i"), *[F.struct(q[0].alias("x"), q[1].alias("y")).alias(f"p{k}") for k, q in enumerate(p)])
    cuts = stored(cuts, "cuts")
    at = cuts.filter("i.x is not null").select(F.explode(F.array("a", "b")).alias("sid"), F.col("i.x").alias("x"), F.col("i.y").alias("y"))
    # Of edges along one line, the ends of either cut the other.
    along = cuts.filter("i.status = 'PARALLEL'").select(F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("p2").alias("p")), F.struct(F.col("a").alias("sid"), F.col("p3").alias("p")), F.struct(F.col("b").alias("sid"), F.col("p0").alias("p")), F.struct(F.col("b").alias("sid"), F.col("p1").alias("p")))).alias("e")).select("e.sid", "e.p.x", "e.p.y")
    ends = both.select("sid", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("sid", "p.x", "p.y")
    stops = ends.unionByName(at).unionByName(along).join(both, "sid").withColumn("u", (F.col("x") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    stops = stops.filter((F.col("u") >= -eps) & (F.col("u") <= G.dist2(G.point("x1", "y1"), G.point("x2", "y2")) + eps)).select("sid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "u")
    w = W.partitionBy("sid").orderBy("u")
    sub = stops.select("sid", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).filter("x2 is not null and (x1 <> x2 or y1 <> y2)")
    first, last = F.least(F.struct("x1", "y1"), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1"))), F.greatest(F.struct("x1", "y1"), F.struct(F.col("x2").alias("x1"), F.col("y2").alias("y1")))
    sub = sub.select(first.alias("p"), last.alias("q")).distinct().select(F.col("p.x1").alias("x1"), F.col("p.y1").alias("y1"), F.col("q.x1").alias("x2"), F.col("q.y1").alias("y2"))
    sub = stored(sub, "sub-edges")
    nx, ny = G.unit_direction(G.point("x1", "y1"), G.point("x2", "y2"))
    side = lambda s: F.struct(F.lit(s).alias("side"), ((F.col("x1") + F.col("x2")) / 2 - s * eps * 50 * ny).alias("x"), ((F.col("y1") + F.col("y2")) / 2 + s * eps * 50 * nx).alias("y"))
    tests = sub.select("x1", "y1", "x2", "y2", F.explode(F.array(side(1), side(-1))).alias("t")).select(F.struct("x1", "y1", "x2", "y2", "t.side").alias("pid"), "t.x", "t.y")
    inside = tests.select("pid")
    for name, rings in (("ia", a), ("ib", b)):
        hit = S.points_in_polygons(tests, rings, size).select("pid").distinct().withColumn(name, F.lit(True))
        inside = inside.join(hit, "pid", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    on = lambda side, name, out: F.max(F.when(F.col("pid.side") == side, F.col(name))).alias(out)
    return stored(inside.groupBy(*[F.col(f"pid.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]).agg(on(1, "ia", "la"), on(1, "ib", "lb"), on(-1, "ia", "ra"), on(-1, "ib", "rb")), "overlay")


def overlaid(sides: DataFrame, kind: str) -> DataFrame:
    """(x1, y1, x2, y2, left, right) of an overlay's sub-edges of one kind, with whether each side is in the result; kind as in overlay."""
    keep = {"combination": lambda a, b: a | b, "union": lambda a, b: a | b, "intersection": lambda a, b: a & b, "difference": lambda a, b: a != b, "subtraction": lambda a, b: a & ~b}[kind]
    found = sides.select("x1", "y1", "x2", "y2", keep(F.col("la"), F.col("lb")).alias("left"), keep(F.col("ra"), F.col("rb")).alias("right"))
    return found if kind == "combination" else found.filter("left <> right")


def overlay(a: DataFrame, b: DataFrame, kind: str, size: float, eps: float = 1e-6) -> DataFrame:
    """Sub-edges (x1, y1, x2, y2) of the overlay of ring tables a and b (poly_id, seq, x, y): combination, union, intersection,
    difference (in one of both only) or subtraction (a less b).

    Edges are cut where they meet. A sub-edge stays if exactly one of its sides is in the result; combination keeps all.
    """
    return overlaid(overlay_sides(a, b, size, eps), kind).select("x1", "y1", "x2", "y2")

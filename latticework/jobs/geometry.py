"""Queries of the row-wise geometry and closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.jobs.registry import query
from latticework.sources import tables as T
from latticework.sources.tables import r6, sql

A, B, C, P, Q = G.point("x1", "y1"), G.point("x2", "y2"), G.point("x3", "y3"), G.point("px", "py"), G.point("qx", "qy")
D12, D23, D31 = "sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2))", "sqrt((x2-x3)*(x2-x3)+(y2-y3)*(y2-y3))", "sqrt((x3-x1)*(x3-x1)+(y3-y1)*(y3-y1))"
DET = "((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1))"
CX = f"(x1 + ((y3-y1)*((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) - (y2-y1)*((x3-x1)*(x3-x1)+(y3-y1)*(y3-y1))) / (2*{DET}))"
CY = f"(y1 + ((x2-x1)*((x3-x1)*(x3-x1)+(y3-y1)*(y3-y1)) - (x3-x1)*((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) / (2*{DET}))"


def _o(a: str, b: str, c: str) -> str:
    """Orientation of three points named by the suffix or prefix of their columns."""
    n = lambda p: (f"x{p}", f"y{p}") if p.isdigit() else (f"{p}x", f"{p}y")
    (ax, ay), (bx, by), (cx, cy) = n(a), n(b), n(c)
    return f"(({bx}-{ax})*({cy}-{ay})-({by}-{ay})*({cx}-{ax}))"


@query(sql(f"SELECT tid, round({D12}, 6) AS d, round({D12}*{D12}, 5) AS d2, round(sqrt(px*px+py*py), 6) AS hyp FROM quads"))
def geo1_dist(spark: SparkSession, d: str) -> DataFrame:
    return T.quads(spark, d).select("tid", r6(G.dist(A, B)).alias("d"), F.round(G.dist2(A, B), 5).alias("d2"), r6(F.hypot("px", "py")).alias("hyp"))


@query(sql(f"SELECT tid, round((x2-x1)/{D12}, 6)+0.0 AS ux, round((y2-y1)/{D12}, 6)+0.0 AS uy FROM triangles"))
def geo2_unit_direction(spark: SparkSession, d: str) -> DataFrame:
    x, y = G.unit_direction(A, B)
    return T.triangles(spark, d).select("tid", r6(x).alias("ux"), r6(y).alias("uy"))


@query(sql(f"SELECT tid, round(CASE WHEN {DET} <= 0 THEN 2*pi()-a ELSE a END, 6) AS angle FROM (SELECT *, acos(greatest(-1.0, least(1.0, ((x1-x2)*(x3-x2)+(y1-y2)*(y3-y2))/({D12}*{D23})))) AS a FROM triangles)"))
def geo3_angle_abc(spark: SparkSession, d: str) -> DataFrame:
    return T.triangles(spark, d).select("tid", r6(G.angle_at(A, B, C)).alias("angle"))


@query(sql(f"SELECT tid, round({DET}, 5)+0.0 AS det, {_o('1', '2', 'p')} >= 1.5e-8 AS left_side FROM quads"))
def geo4_orient(spark: SparkSession, d: str) -> DataFrame:
    return T.quads(spark, d).select("tid", (F.round(G.orient(A, B, C), 5) + 0.0).alias("det"), G.half_side(A, B, P).alias("left_side"))


@query(sql(f"SELECT tid, round(0.5*{DET}, 5) AS area, round((x1+x2+x3)/3, 6)+0.0 AS cx, round((y1+y2+y3)/3, 6)+0.0 AS cy FROM triangles"))
def geo5_area_centroid(spark: SparkSession, d: str) -> DataFrame:
    x, y = G.centroid(A, B, C)
    return T.triangles(spark, d).select("tid", F.round(G.tri_area(A, B, C), 5).alias("area"), r6(x).alias("cx"), r6(y).alias("cy"))


@query(sql(f"SELECT tid, round({D12}*{D23}*{D31}/(2*{DET}), 4) AS radius, round({CX}, 4)+0.0 AS cx, round({CY}, 4)+0.0 AS cy FROM triangles WHERE {DET} > 0.01"))
def geo6_circumcircle(spark: SparkSession, d: str) -> DataFrame:
    x, y = G.circumcenter(A, B, C)
    t = T.triangles(spark, d).filter(G.orient(A, B, C) > 0.01)
    return t.select("tid", F.round(G.circumradius(A, B, C), 4).alias("radius"), (F.round(x, 4) + 0.0).alias("cx"), (F.round(y, 4) + 0.0).alias("cy"))


@query(sql(f"""SELECT tid, round((x1+x2)/2 - (y2-y1)/{D12}*h, 6)+0.0 AS cx, round((y1+y2)/2 + (x2-x1)/{D12}*h, 6)+0.0 AS cy FROM
    (SELECT *, CASE WHEN 100.0 >= {D12}*{D12}/4 THEN sqrt(100.0 - ((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2))/4) END AS h FROM triangles)"""))
def geo7_center_from_segment(spark: SparkSession, d: str) -> DataFrame:
    x, y = G.center_from_segment(A, B, F.lit(10.0))
    return T.triangles(spark, d).select("tid", r6(x).alias("cx"), r6(y).alias("cy"))


@query(sql(f"""SELECT tid, round(CASE WHEN ((x2-x1)*(cy-y1)-(y2-y1)*(cx-x1)) * {DET} < 0 THEN -1 ELSE 1 END * ((cx-x1)*(cx-x1)+(cy-y1)*(cy-y1)), 3) AS dd
    FROM (SELECT *, {CX} AS cx, {CY} AS cy FROM triangles WHERE {DET} > 1)"""))
def geo8_delaunay_dist(spark: SparkSession, d: str) -> DataFrame:
    return T.triangles(spark, d).filter(G.orient(A, B, C) > 1).select("tid", F.round(G.delaunay_dist(A, B, C), 3).alias("dd"))


@query(sql(f"""SELECT tid, round(s, 6) AS shortest, round(l, 6) AS longest, round(r/s, 4) AS ratio, round(asin(least(1.0, 1/(2*r/s))), 6) AS min_angle, round(1/(sqrt(3.0)*r/s), 6) AS quality
    FROM (SELECT tid, least({D12},{D23},{D31}) AS s, greatest({D12},{D23},{D31}) AS l, {D12}*{D23}*{D31}/(2*{DET}) AS r FROM triangles WHERE {DET} > 0.01)"""))
def geo9_tri_shape(spark: SparkSession, d: str) -> DataFrame:
    t = T.triangles(spark, d).filter(G.orient(A, B, C) > 0.01)
    return t.select(
        "tid", r6(G.min_edge(A, B, C)).alias("shortest"), r6(G.max_edge(A, B, C)).alias("longest"), F.round(G.radius_edge_ratio(A, B, C), 4).alias("ratio"),
        r6(G.min_angle(A, B, C)).alias("min_angle"), r6(G.quality(A, B, C)).alias("quality"),
    )


U = "greatest(0.0, least(1.0, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2))))"


@query(sql(f"SELECT tid, round(x1+{U}*(x2-x1), 6)+0.0 AS x, round(y1+{U}*(y2-y1), 6)+0.0 AS y FROM quads"))
def geo10_closest_on_segment(spark: SparkSession, d: str) -> DataFrame:
    x, y = G.closest_on_segment(A, B, P)
    return T.quads(spark, d).select("tid", r6(x).alias("x"), r6(y).alias("y"))


def _cross(a: str, b: str, c: str, e: str) -> str:
    """Whether two open segments cross, by four orientations."""
    return f"({_o(a, b, c)}*{_o(a, b, e)} < 0 AND {_o(c, e, a)}*{_o(c, e, b)} < 0)"


@query(sql(f"""SELECT tid, CASE WHEN abs((x2-x1)*(qy-py)-(y2-y1)*(qx-px)) < 1.5e-8 THEN 'PARALLEL' WHEN {_cross('1', '2', 'p', 'q')} THEN 'INTERSECTED' ELSE 'NOT' END AS status,
    CASE WHEN {_cross('1', '2', 'p', 'q')} THEN round(x1 + (x2-x1)*((px-x1)*(qy-py)-(py-y1)*(qx-px))/((x2-x1)*(qy-py)-(y2-y1)*(qx-px)), 6)+0.0 END AS x FROM quads"""))
def geo11_segment_intersection(spark: SparkSession, d: str) -> DataFrame:
    return T.quads(spark, d).select("tid", G.intersection(A, B, P, Q).alias("i")).select("tid", "i.status", r6(F.col("i.x")).alias("x"))


@query(sql(f"SELECT tid FROM quads WHERE {_cross('1', '2', 'p', 'q')}"))
def geo12_segments_cross(spark: SparkSession, d: str) -> DataFrame:
    return T.quads(spark, d).filter(G.segments_cross(A, B, P, Q)).select("tid")


@query(sql(f"""SELECT tid, {_cross('p', 'q', '1', '2')} OR {_cross('p', 'q', '2', '3')} OR {_cross('p', 'q', '3', '1')} AS hits_triangle,
    64.0 - ((px+u*(qx-px)-x1)*(px+u*(qx-px)-x1) + (py+u*(qy-py)-y1)*(py+u*(qy-py)-y1)) > 1.5e-8 AS hits_circle
    FROM (SELECT *, greatest(0.0, least(1.0, ((x1-px)*(qx-px)+(y1-py)*(qy-py))/((qx-px)*(qx-px)+(qy-py)*(qy-py)))) AS u FROM quads)"""))
def geo13_segment_hits(spark: SparkSession, d: str) -> DataFrame:
    return T.quads(spark, d).select("tid", G.segment_hits_triangle(P, Q, A, B, C).alias("hits_triangle"), G.segment_hits_circle(P, Q, A, F.lit(8.0)).alias("hits_circle"))


@query(sql("""SELECT tid, least(x1,x2,x3) < 1 - 1e-6 AND greatest(x1,x2,x3) > 1 + 1e-6 AS hit, list_transform(list_filter(
    [CASE WHEN least(x1,x2) < 1 AND greatest(x1,x2) > 1 THEN y1 + (1-x1)/(x2-x1)*(y2-y1) END, CASE WHEN least(x2,x3) < 1 AND greatest(x2,x3) > 1 THEN y2 + (1-x2)/(x3-x2)*(y3-y2) END,
     CASE WHEN least(x3,x1) < 1 AND greatest(x3,x1) > 1 THEN y3 + (1-x3)/(x1-x3)*(y1-y3) END], lambda v: v IS NOT NULL), lambda v: round(v, 6))[1] AS cut_y FROM triangles"""))
def geo14_level_set(spark: SparkSession, d: str) -> DataFrame:
    level = F.lit(1.0)
    cuts = G.level_set_points(A, B, C, A[0], B[0], C[0], level)
    return T.triangles(spark, d).select("tid", G.level_set_hits(A[0], B[0], C[0], level).alias("hit"), F.round(F.get(cuts, F.lit(0))["y"], 6).alias("cut_y"))


@query(sql("SELECT tid, tid % 2 = 0 AS inside, false AS other FROM quads"))
def geo15_point_on_segment(spark: SparkSession, d: str) -> DataFrame:
    # The middle of the segment, or a point beyond its end.
    u = F.when(F.col("tid") % 2 == 0, 0.5).otherwise(1.5)
    on = (A[0] + u * (B[0] - A[0]), A[1] + u * (B[1] - A[1]))
    return T.quads(spark, d).select("tid", G.point_on_segment(A, B, on).alias("inside"), G.point_on_segment(A, B, P).alias("other"))


@query(sql(f"SELECT tid, {_o('1', '2', 'p')} > -1.5e-8 AND {_o('2', '3', 'p')} > -1.5e-8 AND {_o('3', '1', 'p')} > -1.5e-8 AS inside FROM quads"))
def geo16_point_in_triangle(spark: SparkSession, d: str) -> DataFrame:
    return T.quads(spark, d).select("tid", G.point_in_triangle(A, B, C, P).alias("inside"))


@query(sql("SELECT tid, px BETWEEN least(x1,x2) AND greatest(x1,x2) AND py BETWEEN least(y1,y2) AND greatest(y1,y2) AS inside FROM quads"))
def geo17_point_in_box(spark: SparkSession, d: str) -> DataFrame:
    low, high = (F.least("x1", "x2"), F.least("y1", "y2")), (F.greatest("x1", "x2"), F.greatest("y1", "y2"))
    return T.quads(spark, d).select("tid", G.point_in_box(P, low, high).alias("inside"))


@query(sql("SELECT tid, (x1-px)*(x2-px)+(y1-py)*(y2-py) < 1.5e-8 AS inside, (x1-px)*(x2-px)+(y1-py)*(y2-py) < -1.5e-8 AS inside_strict FROM quads"))
def geo18_in_diametral_circle(spark: SparkSession, d: str) -> DataFrame:
    return T.quads(spark, d).select("tid", G.in_diametral_circle(A, B, P).alias("inside"), G.in_diametral_circle(A, B, P, strict=True).alias("inside_strict"))


@query(sql(f"SELECT tid, (px-cx)*(px-cx)+(py-cy)*(py-cy) < (x1-cx)*(x1-cx)+(y1-cy)*(y1-cy) AS inside, false AS on_circle FROM (SELECT *, {CX} AS cx, {CY} AS cy FROM quads WHERE {DET} > 1)"))
def geo19_in_circumcircle(spark: SparkSession, d: str) -> DataFrame:
    return T.quads(spark, d).filter(G.orient(A, B, C) > 1).select("tid", G.in_circumcircle(A, B, C, P).alias("inside"), G.cocircular(A, B, C, P).alias("on_circle"))


@query("SELECT pid, round(v*v*v, 4) AS p3, round(pow(v, 9), 2) AS p9, round(2/(1/v + 1/(v+1)), 6) AS harmonic, round(log2(v), 6) AS lg, least(v, 10.0) AS lo, greatest(v, 10.0) AS hi FROM (SELECT event_id AS pid, round(1 + value/100, 4) AS v FROM events)")
def mat1_scalars(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    e = T.read(spark, d, "events").select(F.col("event_id").alias("pid"), F.round(1 + F.col("value") / 100, 4).alias("v"))
    return e.select("pid", F.round(F.pow(v, 3), 4).alias("p3"), F.round(F.pow(v, 9), 2).alias("p9"), F.round(2 / (1 / v + 1 / (v + 1)), 6).alias("harmonic"), F.round(F.log2(v), 6).alias("lg"), F.least(v, F.lit(10.0)).alias("lo"), F.greatest(v, F.lit(10.0)).alias("hi"))


def interpolation_weights(nodes: DataFrame, keys: list[str], x: str, y: str, r: str) -> DataFrame:
    """nodes (keys, k, x, y, r) with the query point qx, qy: weight of each node, a product over the other nodes."""
    z = F.sqrt((F.col(x) - F.col("qx")) ** 2 + (F.col(y) - F.col("qy")) ** 2) / F.col(r)
    phi = nodes.select(*keys, "k", (z * F.log(z + 1)).alias("phi")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "phi"))).alias("n"))
    others = F.transform("n", lambda a: F.struct(a["k"].alias("k"), F.aggregate("n", F.lit(1.0), lambda s, b: F.when(b["k"] == a["k"], s).otherwise(s * b["phi"])).alias("p")))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, b: s + b["p"])
    return phi.select(*keys, others.alias("p")).select(*keys, total(F.col("p")).alias("all"), F.explode("p").alias("e")).select(*keys, F.col("e.k").alias("k"), F.try_divide("e.p", "all").alias("weight"))


Z = lambda k: f"(sqrt((x{k}-px)*(x{k}-px)+(y{k}-py)*(y{k}-py))/5.0)"
PHI = [f"({Z(k)}*ln({Z(k)}+1))" for k in (1, 2, 3)]
SUM = f"({PHI[1]}*{PHI[2]}+{PHI[0]}*{PHI[2]}+{PHI[0]}*{PHI[1]})"


def _corner_nodes(q: DataFrame) -> DataFrame:
    corners = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2, 3)])
    return q.select("tid", F.col("px").alias("qx"), F.col("py").alias("qy"), F.explode(corners).alias("c")).select("tid", "qx", "qy", "c.k", "c.x", "c.y", F.lit(5.0).alias("r"))


@query(sql(f"SELECT tid, unnest([1, 2, 3]) AS k, unnest([round({PHI[1]}*{PHI[2]}/{SUM}, 6), round({PHI[0]}*{PHI[2]}/{SUM}, 6), round({PHI[0]}*{PHI[1]}/{SUM}, 6)]) AS weight FROM quads"))
def mat2_interpolation_weights(spark: SparkSession, d: str) -> DataFrame:
    return interpolation_weights(_corner_nodes(T.quads(spark, d)), ["tid"], "x", "y", "r").select("tid", "k", r6(F.col("weight")).alias("weight"))


def interpolation_gradient(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Gradient of the interpolation weights in the query point, by the product and quotient rules."""
    dist = F.sqrt((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2)
    z = dist / F.col("r")
    slope = F.try_divide(F.log(z + 1) + z / (z + 1), dist * F.col("r"))
    terms = nodes.select(*keys, F.struct("k", (z * F.log(z + 1)).alias("f"), (slope * (F.col("qx") - F.col("x"))).alias("gx"), (slope * (F.col("qy") - F.col("y"))).alias("gy")).alias("n"))
    arrays = terms.groupBy(*keys).agg(F.sort_array(F.collect_list("n")).alias("n"))

    def product(skip: list):
        """Product of f over all nodes but those skipped."""
        return F.aggregate("n", F.lit(1.0), lambda s, b: F.when(F.reduce(F.array(*[b["k"] == k for k in skip]), F.lit(False), lambda u, v: u | v), s).otherwise(s * b["f"]))

    def derivative(a, part: str):
        return F.aggregate("n", F.lit(0.0), lambda s, b: F.when(b["k"] == a["k"], s).otherwise(s + b[part] * product([a["k"], b["k"]])))

    each = F.transform("n", lambda a: F.struct(a["k"].alias("k"), product([a["k"]]).alias("p"), derivative(a, "gx").alias("px"), derivative(a, "gy").alias("py")))
    total = lambda c: F.aggregate("e", F.lit(0.0), lambda s, b: s + b[c])
    sums = arrays.select(*keys, each.alias("e")).select(*keys, "e", total("p").alias("sp"), total("px").alias("sx"), total("py").alias("sy"))
    out = sums.select(*keys, "sp", "sx", "sy", F.explode("e").alias("a"))
    return out.select(*keys, "a.k", F.try_divide(F.col("a.px") * F.col("sp") - F.col("a.p") * F.col("sx"), F.col("sp") * F.col("sp")).alias("gx"), F.try_divide(F.col("a.py") * F.col("sp") - F.col("a.p") * F.col("sy"), F.col("sp") * F.col("sp")).alias("gy"))


@query()
def mat3_interpolation_gradient(spark: SparkSession, d: str) -> DataFrame:
    return interpolation_gradient(_corner_nodes(T.quads(spark, d)), ["tid"]).select("tid", "k", r6(F.col("gx")).alias("gx"), r6(F.col("gy")).alias("gy"))


def gauss_points(spark: SparkSession, n: int) -> DataFrame:
    """Nodes and weights of the n-point rule on -1 to 1."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(n)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, w)], "gx double, gw double")


@query("SELECT event_id AS pid, round((pow(value + 1, 4) - pow(value, 4)) / 4, 2) AS integral FROM events")
def mat4_quadrature(spark: SparkSession, d: str) -> DataFrame:
    # Integral of t^3 over each event's unit interval, by four points, which is exact.
    e = T.read(spark, d, "events").select(F.col("event_id").alias("pid"), F.col("value").alias("a"))
    t = F.col("a") + 0.5 + F.col("gx") / 2
    rule = F.broadcast(gauss_points(spark, 4))
    return e.join(rule, F.lit(True)).groupBy("pid").agg(F.round(F.sum(F.col("gw") * t * t * t) / 2, 2).alias("integral"))


@query(sql("""SELECT tid, round(a*d-b*c, 4)+0.0 AS det, round(d/(a*d-b*c), 6)+0.0 AS i11, round(-b/(a*d-b*c), 6)+0.0 AS i12, round(CASE WHEN h >= 0 THEN h+sqrt(q) ELSE h-sqrt(q) END, 4) AS e1, round(CASE WHEN h >= 0 THEN h-sqrt(q) ELSE h+sqrt(q) END, 4)+0.0 AS e2,
    round(d3, 2)+0.0 AS det3, round((y2*40.0-y3*30.0)/d3, 6)+0.0 AS j11, round((x1*y2-x2*y1)/d3, 6)+0.0 AS j33
    FROM (SELECT *, (a+d)/2 AS h, (a-d)*(a-d)/4+b*c AS q, x1*(y2*40.0-y3*30.0) - x2*(y1*40.0-y3*20.0) + x3*(y1*30.0-y2*20.0) AS d3 FROM (SELECT *, x1 AS a, y1 AS b, y1 AS c, y2 AS d FROM triangles)) WHERE abs(a*d-b*c) > 1 AND abs(d3) > 1"""))
def mat5_small_matrices(spark: SparkSession, d: str) -> DataFrame:
    t = T.triangles(spark, d)
    a, b, c, e = F.col("x1"), F.col("y1"), F.col("y1"), F.col("y2")
    m3 = [F.col(n) for n in ("x1", "x2", "x3", "y1", "y2", "y3")] + [F.lit(v) for v in (20.0, 30.0, 40.0)]
    inv, inv3, (e1, e2) = G.inverse2(a, b, c, e), G.inverse3(m3), G.eigenvalues2(a, b, c, e)
    t = t.filter((F.abs(G.det2(a, b, c, e)) > 1) & (F.abs(G.det3(m3)) > 1))
    r4 = lambda x: F.round(x, 4) + 0.0
    return t.select("tid", r4(G.det2(a, b, c, e)).alias("det"), r6(inv[0]).alias("i11"), r6(inv[1]).alias("i12"), r4(e1).alias("e1"), r4(e2).alias("e2"), (F.round(G.det3(m3), 2) + 0.0).alias("det3"), r6(inv3[0]).alias("j11"), r6(inv3[8]).alias("j33"))


@query(sql("SELECT tid, round(sqrt(x1*x1+x2*x2-x1*x2+3*y1*y1), 6) AS von_mises, round((x1+x2)/2+sqrt((x1-x2)*(x1-x2)/4+y1*y1), 6)+0.0 AS s1, round((x1+x2)/2-sqrt((x1-x2)*(x1-x2)/4+y1*y1), 6)+0.0 AS s2 FROM triangles"))
def eng1_stress(spark: SparkSession, d: str) -> DataFrame:
    s1, s2 = G.principal(F.col("x1"), F.col("x2"), F.col("y1"))
    return T.triangles(spark, d).select("tid", r6(G.von_mises(F.col("x1"), F.col("x2"), F.col("y1"))).alias("von_mises"), r6(s1).alias("s1"), r6(s2).alias("s2"))


@query("""SELECT p_partkey, round(CASE WHEN st THEN e*(1-nu)/((1+nu)*(1-2*nu)) ELSE e/(1-nu*nu) END, 4) AS d11, round(CASE WHEN st THEN e*nu/((1+nu)*(1-2*nu)) ELSE e*nu/(1-nu*nu) END, 4) AS d12, round(e/(2*(1+nu)), 4) AS d33,
    round(e*nu/((1+nu)*(1-2*nu)), 4) AS lambda FROM (SELECT p_partkey, p_retailprice AS e, p_size / 125.0 AS nu, p_partkey % 2 = 0 AS st FROM part)""")
def eng2_material(spark: SparkSession, d: str) -> DataFrame:
    e, nu = F.col("p_retailprice"), F.col("p_size") / 125.0
    d11, d12, d33 = G.elastic_matrix(e, nu, F.col("p_partkey") % 2 == 0)
    return T.read(spark, d, "part").select("p_partkey", F.round(d11, 4).alias("d11"), F.round(d12, 4).alias("d12"), F.round(d33, 4).alias("d33"), F.round(G.lame(e, nu)[0], 4).alias("lambda"))


def damage_history(strain: DataFrame, key: list[str], order: list[str], young: float, nu: float, strength: float, energy: float, length: float) -> DataFrame:
    """strain (key, order, exx, eyy, gxy) with r, the largest equivalent stress so far, and damage."""
    d11, d12, d33 = G.elastic_matrix(F.lit(young), F.lit(nu), F.lit(False))
    sxx, syy, sxy = G.stress((F.col("exx"), F.col("eyy"), F.col("gxy")), (d11, d12, d33))
    s1, s2 = G.principal(sxx, syy, sxy)
    p1, p2 = F.greatest(s1, F.lit(0.0)), F.greatest(s2, F.lit(0.0))
    # The positive part of the stress in its principal axes; the compliance is isotropic.
    tau = F.sqrt((p1 * p1 + p2 * p2 - 2 * nu * p1 * p2) / young)
    r0 = strength / young**0.5
    a = 1 / (energy / length * young / strength**2 - 0.5)
    r = F.greatest(F.lit(r0), F.max(tau).over(W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return strain.select("*", r.alias("r")).withColumn("damage", 1 - r0 / F.col("r") * F.exp(a * (1 - F.col("r") / r0)))


@query(sql("""SELECT event_id, round(r, 6) AS r, round(1 - 0.2/r*exp((1/(10.0/1.0*100.0/4.0-0.5))*(1-r/0.2)), 6) AS damage FROM (SELECT event_id, greatest(0.2, max(tau) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS r FROM
    (SELECT *, sqrt((p1*p1+p2*p2-0.4*p1*p2)/100.0) AS tau FROM (SELECT *, greatest((sx+sy)/2+sqrt((sx-sy)*(sx-sy)/4+t*t), 0) AS p1, greatest((sx+sy)/2-sqrt((sx-sy)*(sx-sy)/4+t*t), 0) AS p2 FROM
    (SELECT *, 100.0/0.96*(exx+0.2*eyy) AS sx, 100.0/0.96*(0.2*exx+eyy) AS sy, 100.0/2.4*gxy AS t FROM (SELECT event_id, user_id, ts, value/10000.0 AS exx, event_id%7/1000.0 AS eyy, event_id%11/2000.0 AS gxy FROM events)))))"""))
def eng3_damage(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("event_id", "user_id", "ts", (F.col("value") / 10000.0).alias("exx"), (F.col("event_id") % 7 / 1000.0).alias("eyy"), (F.col("event_id") % 11 / 2000.0).alias("gxy"))
    return damage_history(e, ["user_id"], ["ts", "event_id"], 100.0, 0.2, 2.0, 10.0, 1.0).select("event_id", r6(F.col("r")).alias("r"), r6(F.col("damage")).alias("damage"))

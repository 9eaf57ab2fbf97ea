"""Queries of the mesh operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.jobs.graph import CC
from latticework.jobs.registry import query
from latticework.operators import conditions as CN
from latticework.operators import mesh as M
from latticework.sources import tables as T
from latticework.sources.tables import r6, sql

A, B, C = G.point("x1", "y1"), G.point("x2", "y2"), G.point("x3", "y3")
DET = "((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1))"


@query(sql("SELECT DISTINCT lo AS src, hi AS dst FROM mesh_face UNION SELECT DISTINCT hi, lo FROM mesh_face"))
def msh1_nodes_by_edges(spark: SparkSession, d: str) -> DataFrame:
    e = M.edge_table(T.mesh_elem(spark, d))
    return e.select(F.col("lo").alias("src"), F.col("hi").alias("dst")).unionByName(e.select(F.col("hi").alias("src"), F.col("lo").alias("dst")))


@query(sql("SELECT src, dst, face FROM mesh_dual"))
def msh2_elements_by_edges(spark: SparkSession, d: str) -> DataFrame:
    return M.neighbours(T.mesh_elem(spark, d)).select("src", "dst", "face")


@query(sql("SELECT DISTINCT a.nid AS src, b.nid AS dst FROM mesh_elem a JOIN mesh_elem b ON a.elem = b.elem AND a.nid <> b.nid"))
def msh3_nodes_by_elements(spark: SparkSession, d: str) -> DataFrame:
    n = T.mesh_elem(spark, d).select("elem", "nid")
    return n.withColumnRenamed("nid", "src").join(n.withColumnRenamed("nid", "dst"), "elem").filter("src <> dst").select("src", "dst").distinct()


@query(sql("SELECT DISTINCT a.elem AS src, b.elem AS dst FROM mesh_elem a JOIN mesh_elem b ON a.nid = b.nid AND a.elem <> b.elem"))
def msh4_elements_by_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = T.mesh_elem(spark, d).select("elem", "nid")
    return n.withColumnRenamed("elem", "src").join(n.withColumnRenamed("elem", "dst"), "nid").filter("src <> dst").select("src", "dst").distinct()


@query(sql("SELECT nid, CAST(count(*) AS BIGINT) AS n, min(elem) AS first, max(elem) AS last FROM mesh_elem GROUP BY nid"))
def msh5_node_elements(spark: SparkSession, d: str) -> DataFrame:
    return T.mesh_elem(spark, d).groupBy("nid").agg(F.count("*").alias("n"), F.min("elem").alias("first"), F.max("elem").alias("last"))


@query(sql("SELECT a.elem AS a, b.elem AS b FROM mesh_elem a JOIN mesh_elem b ON a.nid = b.nid AND a.elem < b.elem GROUP BY 1, 2 HAVING count(*) >= 2"))
def msh6_mesh_to_dual(spark: SparkSession, d: str) -> DataFrame:
    return M.dual(T.mesh_elem(spark, d), 2)


@query(sql("SELECT lo, hi, min(elem) AS elem FROM mesh_face GROUP BY lo, hi HAVING count(*) = 1"))
def msh7_boundary_faces(spark: SparkSession, d: str) -> DataFrame:
    return M.boundary_faces(T.mesh_elem(spark, d)).select("lo", "hi", "elem")


@query(sql("""SELECT lo, hi, round((a.x+b.x)/2, 8) AS mx, round((a.y+b.y)/2, 8) AS my, round((b.y-a.y)/l, 6)+0.0 AS nx, round(-(b.x-a.x)/l, 6)+0.0 AS ny, round(l, 6) AS len
    FROM (SELECT *, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS l FROM (SELECT DISTINCT lo, hi FROM mesh_face) JOIN mesh_node a ON a.nid = lo JOIN mesh_node b ON b.nid = hi)""".replace("SELECT *, sqrt", "SELECT lo, hi, a, b, sqrt")))
def msh8_edge_geometry(spark: SparkSession, d: str) -> DataFrame:
    node = T.mesh_node(spark, d)
    e = M.edge_table(T.mesh_elem(spark, d)).join(node.select(F.col("nid").alias("lo"), F.col("x").alias("x1"), F.col("y").alias("y1")), "lo").join(node.select(F.col("nid").alias("hi"), F.col("x").alias("x2"), F.col("y").alias("y2")), "hi")
    ux, uy = G.unit_direction(A, B)
    return e.select("lo", "hi", F.round((A[0] + B[0]) / 2, 8).alias("mx"), F.round((A[1] + B[1]) / 2, 8).alias("my"), r6(uy).alias("nx"), r6(-ux).alias("ny"), r6(G.dist(A, B)).alias("len"))


@query(sql("SELECT elem, face, dense_rank() OVER (ORDER BY lo, hi) AS eid FROM mesh_face"))
def msh9_find_edge(spark: SparkSession, d: str) -> DataFrame:
    from latticework.operators.graph import ranked

    e = ranked(M.edge_table(T.mesh_elem(spark, d)), ["lo", "hi"]).select("lo", "hi", (F.col("rank") + 1).alias("eid"))
    return M.faces(T.mesh_elem(spark, d)).join(e, ["lo", "hi"]).select("elem", "face", "eid")


@query(sql(f"WITH RECURSIVE open_dual AS (SELECT src, dst FROM mesh_dual d ANTI JOIN (SELECT least(a.nid, b.nid) AS lo, greatest(a.nid, b.nid) AS hi FROM mesh_insgm a JOIN mesh_insgm b ON a.sgm = b.sgm AND b.seq = a.seq + 1) s USING (lo, hi)), {CC.format('open_dual')} SELECT coalesce(comp, elem) AS component, CAST(count(*) AS BIGINT) AS elems, round(sum({DET})/2, 4) AS area FROM mesh_tri LEFT JOIN cc ON id = elem GROUP BY 1"))
def msh10_subareas(spark: SparkSession, d: str) -> DataFrame:
    tri = M.tri_area_of(T.mesh_tri(spark, d))
    c = M.areas(T.mesh_elem(spark, d), tri, M.wall_faces(T.mesh_insgm(spark, d)).select("lo", "hi"))
    return c.join(tri, "elem").groupBy("component").agg(F.count("*").alias("elems"), F.round(F.sum("area"), 4).alias("area"))


@query(sql(f"WITH RECURSIVE {CC.format('mesh_dual')}, a AS (SELECT coalesce(comp, elem) AS component, sum({DET})/2 AS area FROM mesh_tri LEFT JOIN cc ON id = elem GROUP BY 1) SELECT arg_max(component, (area, -component)) AS kept_component, round(max(area), 4) AS kept, round(sum(area) - max(area), 4) AS removed FROM a"))
def msh11_keep_biggest_area(spark: SparkSession, d: str) -> DataFrame:
    tri = M.tri_area_of(T.mesh_tri(spark, d))
    a = M.areas(T.mesh_elem(spark, d), tri).join(tri, "elem").groupBy("component").agg(F.sum("area").alias("area"))
    best = F.max_by("component", F.struct("area", (-F.col("component")).alias("o")))
    return a.agg(best.alias("kept_component"), F.round(F.max("area"), 4).alias("kept"), F.round(F.sum("area") - F.max("area"), 4).alias("removed"))


WALLS = "(SELECT least(a.nid, b.nid) AS lo, greatest(a.nid, b.nid) AS hi FROM mesh_insgm a JOIN mesh_insgm b ON a.sgm = b.sgm AND b.seq = a.seq + 1)"


BLOCK = "({0} // 2 % w // 4, {0} // 2 // w // 4)"


@query(sql(f"""WITH RECURSIVE open_dual AS (SELECT src, dst FROM mesh_dual, mesh_width WHERE {BLOCK.format('src')} = {BLOCK.format('dst')}), {CC.format('open_dual')},
    c AS (SELECT elem, coalesce(comp, elem) AS component FROM (SELECT DISTINCT elem FROM mesh_elem) LEFT JOIN cc ON id = elem), o AS (SELECT elem FROM mesh_face SEMI JOIN (SELECT lo, hi FROM mesh_face GROUP BY lo, hi HAVING count(*) = 1) b USING (lo, hi))
    SELECT component, CAST(count(*) AS BIGINT) AS elems FROM c WHERE component NOT IN (SELECT component FROM c JOIN o USING (elem)) GROUP BY component"""))
def msh12_enclosed_subareas(spark: SparkSession, d: str) -> DataFrame:
    # Walls run between blocks of 4 x 4 cells.
    elem, w = T.mesh_elem(spark, d), T.mesh_width(spark, d)
    block = lambda e: F.struct(F.expr(f"{e} div 2 % {w} div 4").alias("c"), F.expr(f"{e} div 2 div {w} div 4").alias("r"))
    walls = M.neighbours(elem).filter(block("src") != block("dst")).select("lo", "hi").distinct()
    c = T.stored_once(M.areas(elem, elem.select("elem").distinct(), walls))
    outer = c.join(M.boundary_faces(elem).select("elem"), "elem", "left_semi").select("component").distinct()
    return c.join(outer, "component", "left_anti").groupBy("component").agg(F.count("*").alias("elems"))


@query(sql(f"SELECT s.lo, s.hi, CAST(count(f.elem) AS BIGINT) AS sides FROM {WALLS} s LEFT JOIN mesh_face f USING (lo, hi) GROUP BY 1, 2"))
def msh13_segment_sides(spark: SparkSession, d: str) -> DataFrame:
    # None: isolated, to be deleted; two: internal.
    f = M.faces(T.mesh_elem(spark, d)).groupBy("lo", "hi").agg(F.count("*").alias("sides"))
    return M.wall_faces(T.mesh_insgm(spark, d)).select("lo", "hi").join(f, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("sides", F.lit(0)).cast("long").alias("sides"))


@query(sql("""WITH m AS (SELECT poly_id, seq, x - avg(x) OVER (PARTITION BY poly_id) * 7 / 8 AS x, y FROM rings), e AS (SELECT poly_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM m WINDOW w AS (PARTITION BY poly_id ORDER BY seq)),
    c AS (SELECT elem, (x1+x2+x3)/3 AS cx, (y1+y2+y3)/3 AS cy FROM mesh_tri), i AS (SELECT DISTINCT elem FROM (SELECT elem, poly_id FROM c JOIN e ON (y1 > cy) <> (y2 > cy) AND cx < x1 + (cy-y1)/(y2-y1)*(x2-x1) GROUP BY 1, 2 HAVING count(*) % 2 = 1)),
    t AS (SELECT elem, x1 AS px, y1 AS py, x2 AS qx, y2 AS qy FROM mesh_tri UNION ALL SELECT elem, x2, y2, x3, y3 FROM mesh_tri UNION ALL SELECT elem, x3, y3, x1, y1 FROM mesh_tri),
    o AS (SELECT elem, (x2-x1)*(py-y1)-(y2-y1)*(px-x1) AS o1, (x2-x1)*(qy-y1)-(y2-y1)*(qx-x1) AS o2, (qx-px)*(y1-py)-(qy-py)*(x1-px) AS o3, (qx-px)*(y2-py)-(qy-py)*(x2-px) AS o4 FROM t JOIN e ON greatest(px, qx) >= least(x1, x2) AND least(px, qx) <= greatest(x1, x2) AND greatest(py, qy) >= least(y1, y2) AND least(py, qy) <= greatest(y1, y2))
    SELECT elem FROM i WHERE elem NOT IN (SELECT elem FROM o WHERE o1*o2 < 0 AND o3*o4 < 0)"""))
def msh14_drop_outside(spark: SparkSession, d: str) -> DataFrame:
    """Elements whose centre lies in some ring and none of whose edges crosses one."""
    from latticework.operators import spatial as S

    middle = F.avg("x").over(W.partitionBy("poly_id"))
    rings = T.rings(spark, d).select("poly_id", "seq", (F.col("x") - middle * 7 / 8).alias("x"), "y")
    tri = T.mesh_tri(spark, d)
    cx, cy = G.centroid(A, B, C)
    inside = S.points_in_polygons(tri.select(F.col("elem").alias("pid"), cx.alias("x"), cy.alias("y")), rings, 2.0).select(F.col("pid").alias("elem")).distinct()
    walls = S.ring_edges(rings).select((-F.col("poly_id") * 8 - F.col("seq") - 1).alias("sid"), "x1", "y1", "x2", "y2")
    sides = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x1"), F.col(f"y{k}").alias("y1"), F.col(f"x{k % 3 + 1}").alias("x2"), F.col(f"y{k % 3 + 1}").alias("y2")) for k in (1, 2, 3)])
    edges = tri.select("elem", F.explode(sides).alias("e")).select((4 * F.col("elem") + F.col("e.k")).alias("sid"), "e.x1", "e.y1", "e.x2", "e.y2")
    hit = S.crossing_pairs(walls.unionByName(edges), 2.0).filter("a < 0 and b >= 0").select(F.expr("b div 4").alias("elem")).distinct()
    return inside.join(hit, "elem", "left_anti")


@query(sql("""WITH RECURSIVE near AS (SELECT src, dst, lo AS nid FROM mesh_dual UNION ALL SELECT src, dst, hi FROM mesh_dual),
    fan(nid, elem, f) USING KEY (nid, elem) AS (SELECT nid, elem, elem FROM mesh_elem UNION SELECT a.nid, a.dst, min(c.f) FROM fan c JOIN near a ON a.nid = c.nid AND a.src = c.elem JOIN recurring.fan r ON r.nid = a.nid AND r.elem = a.dst WHERE c.f < r.f GROUP BY 1, 2)
    SELECT nid, CAST(count(DISTINCT f) AS BIGINT) AS fans, CAST(count(*) FILTER (f <> low) AS BIGINT) AS outside FROM (SELECT *, min(f) OVER (PARTITION BY nid) AS low FROM fan) GROUP BY nid HAVING count(DISTINCT f) > 1"""))
def msh15_single_point_connections(spark: SparkSession, d: str) -> DataFrame:
    f = M.fans(T.mesh_elem(spark, d))
    n = f.groupBy("nid", "fan").agg(F.count("*").alias("n"))
    return n.groupBy("nid").agg(F.count("*").alias("fans"), (F.sum("n") - F.min_by("n", "fan")).alias("outside")).filter("fans > 1")


FE = "(elem % 13) * 0.5"


@query(sql(f"SELECT nid, round(sum({DET}/6*{FE})/sum({DET}/6), 6) AS value FROM mesh_elem JOIN mesh_tri USING (elem) GROUP BY nid"))
def msh16_element_to_node(spark: SparkSession, d: str) -> DataFrame:
    tri = M.tri_area_of(T.mesh_tri(spark, d)).select("elem", "area", F.expr(FE).alias("v"))
    w = F.col("area") / 3
    return T.mesh_elem(spark, d).join(tri, "elem").groupBy("nid").agg(r6(F.sum(w * F.col("v")) / F.sum(w)).alias("value"))


@query(sql("SELECT elem, comp, round(avg(value), 9) AS value FROM mesh_elem JOIN field_u USING (nid) GROUP BY elem, comp"))
def msh17_node_to_element(spark: SparkSession, d: str) -> DataFrame:
    return T.mesh_elem(spark, d).join(T.field_u(spark, d), "nid").groupBy("elem", "comp").agg(F.round(F.avg("value"), 9).alias("value"))


@query(sql(f"""WITH e AS (SELECT elem, {DET}/6 AS w, 1 + {FE} AS v FROM mesh_tri), n AS (SELECT nid, sum(w*v)/sum(w) AS f FROM mesh_elem JOIN e USING (elem) GROUP BY nid)
    SELECT elem, round(abs(1 - avg(f)/any_value(v)), 6) AS err FROM mesh_elem JOIN n USING (nid) JOIN e USING (elem) GROUP BY elem"""))
def msh18_relative_error(spark: SparkSession, d: str) -> DataFrame:
    tri = M.tri_area_of(T.mesh_tri(spark, d)).select("elem", (F.col("area") / 3).alias("w"), (1 + F.expr(FE)).alias("v"))
    elem = T.mesh_elem(spark, d)
    nodes = elem.join(tri, "elem").groupBy("nid").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("f"))
    back = elem.join(nodes, "nid").groupBy("elem").agg(F.avg("f").alias("f")).join(tri, "elem")
    return back.select("elem", r6(F.when(F.abs("v") < 1e-12, F.abs("f")).otherwise(F.abs(1 - F.col("f") / F.col("v")))).alias("err"))


@query(sql("""WITH u AS (SELECT nid, sum(value) FILTER (comp = 0) AS u0, sum(value) FILTER (comp = 1) AS u1 FROM field_u GROUP BY nid), m AS (SELECT max(sqrt(u0*u0+u1*u1)) AS big FROM u)
    SELECT nid, round(x + u0*0.5/big, 6)+0.0 AS x, round(y + u1*0.5/big, 6)+0.0 AS y FROM mesh_node JOIN u USING (nid), m"""))
def msh19_distort(spark: SparkSession, d: str) -> DataFrame:
    u = T.field_u(spark, d).groupBy("nid").agg(F.sum(F.when(F.col("comp") == 0, F.col("value"))).alias("u0"), F.sum(F.when(F.col("comp") == 1, F.col("value"))).alias("u1"))
    scale = u.agg((0.5 / F.max(F.sqrt(F.col("u0") * F.col("u0") + F.col("u1") * F.col("u1")))).alias("scale"))
    moved = T.mesh_node(spark, d).join(u, "nid").join(F.broadcast(scale), F.lit(True))
    return moved.select("nid", r6(F.col("x") + F.col("u0") * F.col("scale")).alias("x"), r6(F.col("y") + F.col("u1") * F.col("scale")).alias("y"))


SMOOTH = "SELECT n.nid, CASE WHEN b.nid IS NULL THEN m.cx ELSE n.x END AS x, CASE WHEN b.nid IS NULL THEN m.cy ELSE n.y END AS y FROM {0} n JOIN (SELECT e.nid, avg(cx) AS cx, avg(cy) AS cy FROM mesh_elem e JOIN (SELECT elem, avg(x) AS cx, avg(y) AS cy FROM mesh_elem JOIN {0} USING (nid) GROUP BY elem) c USING (elem) GROUP BY e.nid) m USING (nid) LEFT JOIN fixed b USING (nid)"


@query(sql(f"WITH fixed AS (SELECT DISTINCT unnest([lo, hi]) AS nid FROM (SELECT lo, hi FROM mesh_face GROUP BY lo, hi HAVING count(*) = 1)), s1 AS ({SMOOTH.format('mesh_node')}), s2 AS ({SMOOTH.format('s1')}) SELECT nid, round(x, 6) AS x, round(y, 6) AS y FROM s2"))
def msh20_centroid_smoothing(spark: SparkSession, d: str) -> DataFrame:
    elem, node = T.mesh_elem(spark, d), T.mesh_node(spark, d)
    fixed = M.boundary_faces(elem).select(F.explode(F.array("lo", "hi")).alias("nid")).distinct().withColumn("fixed", F.lit(True))
    for _ in range(2):
        c = elem.join(node, "nid").groupBy("elem").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
        to = elem.join(c, "elem").groupBy("nid").agg(F.avg("cx").alias("cx"), F.avg("cy").alias("cy"))
        moved = node.join(to, "nid").join(fixed, "nid", "left")
        node = T.stored_once(moved.select("nid", F.when(F.col("fixed"), F.col("x")).otherwise(F.col("cx")).alias("x"), F.when(F.col("fixed"), F.col("y")).otherwise(F.col("cy")).alias("y")))
    return node.select("nid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Free nodes go to the mean of their elements' centres, nodes of segments along the line between their segment's ends.
SLIDE = """SELECT n.nid, CASE WHEN f.nid IS NOT NULL THEN n.x WHEN l.nid IS NOT NULL THEN l.x1 + ((cx-l.x1)*l.ux + (cy-l.y1)*l.uy)*l.ux ELSE cx END AS x, CASE WHEN f.nid IS NOT NULL THEN n.y WHEN l.nid IS NOT NULL THEN l.y1 + ((cx-l.x1)*l.ux + (cy-l.y1)*l.uy)*l.uy ELSE cy END AS y
    FROM {0} n JOIN (SELECT e.nid, avg(cx) AS cx, avg(cy) AS cy FROM mesh_elem e JOIN (SELECT elem, avg(x) AS cx, avg(y) AS cy FROM mesh_elem JOIN {0} USING (nid) GROUP BY elem) c USING (elem) GROUP BY e.nid) m USING (nid) LEFT JOIN fixed f USING (nid) LEFT JOIN line l USING (nid)"""


@query(sql(f"""WITH ends AS (SELECT sgm, arg_min(nid, seq) AS a, arg_max(nid, seq) AS b FROM mesh_insgm GROUP BY sgm), fixed AS (SELECT DISTINCT unnest([lo, hi]) AS nid FROM (SELECT lo, hi FROM mesh_face GROUP BY lo, hi HAVING count(*) = 1) UNION SELECT a FROM ends UNION SELECT b FROM ends),
    line AS (SELECT i.nid, p.x AS x1, p.y AS y1, (q.x-p.x)/sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) AS ux, (q.y-p.y)/sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) AS uy FROM mesh_insgm i JOIN ends e USING (sgm) JOIN mesh_node p ON p.nid = e.a JOIN mesh_node q ON q.nid = e.b WHERE e.a <> e.b),
    s1 AS ({SLIDE.format('mesh_node')}), s2 AS ({SLIDE.format('s1')}), s3 AS ({SLIDE.format('s2')}) SELECT nid, round(x, 6)+0.0 AS x, round(y, 6)+0.0 AS y FROM s3"""))
def msh20_sliding_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds with nodes that slide on their segments; nodes of the border stay."""
    elem = T.mesh_elem(spark, d)
    border = M.boundary_faces(elem).select(F.explode(F.array("lo", "hi")).alias("nid")).distinct()
    node, _, _ = M.smoothed(T.mesh_node(spark, d), T.stored_once(elem), T.mesh_insgm(spark, d), border, 0.0, 3)
    return node.select("nid", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


GRAD = f"""g AS (SELECT elem, {DET} AS det, unnest([n1, n2, n3]) AS nid, unnest([y2-y3, y3-y1, y1-y2])/{DET} AS bx, unnest([x3-x2, x1-x3, x2-x1])/{DET} AS bhy FROM mesh_tri)"""


@query(sql(f"""WITH {GRAD} SELECT elem, any_value(det) < 0 AS distorted, round(sum(value*bx) FILTER (comp = 0), 9)+0.0 AS exx, round(sum(value*bhy) FILTER (comp = 1), 9)+0.0 AS eyy,
    round(sum(value*bhy) FILTER (comp = 0) + sum(value*bx) FILTER (comp = 1), 9)+0.0 AS gxy FROM g JOIN field_u USING (nid) GROUP BY elem"""))
def msh21_triangle_strain(spark: SparkSession, d: str) -> DataFrame:
    r9 = lambda c: F.round(c, 9) + 0.0
    return M.strains(T.mesh_tri(spark, d), T.field_u(spark, d)).select("elem", (F.col("det") < 0).alias("distorted"), r9("exx").alias("exx"), r9("eyy").alias("eyy"), r9("gxy").alias("gxy"))


@query(sql(f"""WITH {GRAD}, p AS (SELECT a.nid AS na, b.nid AS nb, a.det/2 AS s, a.bx AS ax, a.bhy AS ay, b.bx AS cx, b.bhy AS cy FROM g a JOIN g b USING (elem)),
    t AS (SELECT 2*na+k AS i, 2*nb+l AS j, s * CASE WHEN k = 0 AND l = 0 THEN 2.0*ax*cx+0.7*ay*cy WHEN k = 0 THEN 0.6*ax*cy+0.7*ay*cx WHEN l = 0 THEN 0.6*ay*cx+0.7*ax*cy ELSE 2.0*ay*cy+0.7*ax*cx END AS v FROM p, range(2) x(k), range(2) y(l))
    SELECT i, j, round(sum(v), 6)+0.0 AS v FROM t GROUP BY i, j"""))
def msh22_assemble(spark: SparkSession, d: str) -> DataFrame:
    return M.stiffness(T.mesh_tri(spark, d), (2.0, 0.6, 0.7)).select("i", "j", r6(F.col("v")).alias("v"))


@query(sql(f"""SELECT nid, round(sum(t)*1.5, 6) AS mass, round(sum(t)*0.25, 6) AS fx, round(sum(t)*-9.5, 6)+0.0 AS fy FROM (SELECT unnest([n1, n2, n3]) AS nid, 0.7::DOUBLE*{DET}/6 AS t FROM mesh_tri) GROUP BY nid"""))
def msh22_load_mass(spark: SparkSession, d: str) -> DataFrame:
    """Lumped mass and body load of each node."""
    sums = CN.element_sums(T.mesh_tri(spark, d), (0.25, -9.5), 1.5, 0.7)
    return sums.select("nid", *[r6(F.col(c)).alias(c) for c in ("mass", "fx", "fy")])


# Conditions on the mesh's input segments: a whole value across all, one that varies along every second, a force at the first node of each; some of each are fixed.
CONDITIONS = """SELECT 'neumann' AS kind, 'segment' AS place, sgm AS id, 1 AS dof, 1.0 + sgm AS v0, 0.0 AS vx, 0.0 AS vy, FALSE AS varies FROM s UNION ALL SELECT 'neumann', 'segment', sgm, 0, 1.0, 0.1, -0.2, TRUE FROM s WHERE sgm % 16 = 4 UNION ALL SELECT 'neumann', 'point', sgm, 0, 5.0, 0.0, 0.0, FALSE FROM s
    UNION ALL SELECT 'dirichlet', 'segment', sgm, 0, 2.0, 0.5, 0.0, TRUE FROM s WHERE sgm % 24 = 4 UNION ALL SELECT 'dirichlet', 'point', sgm, 0, -1.0, 0.0, 0.0, FALSE FROM s WHERE sgm % 16 = 4 UNION ALL SELECT 'dirichlet', 'point', sgm, 1, 0.0, 0.0, 3.0, TRUE FROM s"""
CONDITION_SQL = f"s AS (SELECT DISTINCT sgm FROM mesh_insgm), c AS ({CONDITIONS}), v AS (SELECT sgm AS id, arg_min(nid, seq) AS nid FROM mesh_insgm GROUP BY sgm)"


def _conditions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    insgm = T.mesh_insgm(spark, d)
    rows = spark.sql(CONDITIONS.replace(" FROM s", " FROM {s}"), s=insgm.select("sgm").distinct())
    doubles = rows.withColumns({k: F.col(k).cast("double") for k in ("v0", "vx", "vy")})
    return doubles, insgm, T.mesh_node(spark, d), insgm.groupBy(F.col("sgm").alias("id")).agg(F.min_by("nid", "seq").alias("nid"))


@query(sql(f"""WITH {CONDITION_SQL}, p AS (SELECT a.sgm, a.nid AS a, b.nid AS b, p.x AS xa, p.y AS ya, q.x AS xb, q.y AS yb, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) AS l FROM mesh_insgm a JOIN mesh_insgm b ON a.sgm = b.sgm AND b.seq = a.seq + 1 JOIN mesh_node p ON p.nid = a.nid JOIN mesh_node q ON q.nid = b.nid),
    t AS (SELECT *, sum(l) OVER (PARTITION BY sgm) AS total FROM p), e AS (SELECT dof, unnest([a, b]) AS nid, CASE WHEN varies THEN (2*v0 + vx*(xa+xb) + vy*(ya+yb))/4*l ELSE v0*l/total/2 END AS f FROM c JOIN t ON c.id = t.sgm WHERE kind = 'neumann' AND place = 'segment'
    UNION ALL SELECT dof, v.nid, CAST(v0 AS DOUBLE) FROM c JOIN v USING (id) WHERE kind = 'neumann' AND place = 'point')
    SELECT step, 2*nid + dof AS i, round(sum(f)*factor, 6)+0.0 AS f FROM e, (VALUES (1, 0.5::DOUBLE), (2, 2.0::DOUBLE)) k(step, factor) GROUP BY step, factor, 2*nid + dof"""))
def msh23_neumann(spark: SparkSession, d: str) -> DataFrame:
    """What conditions add to the right side in two steps."""
    c, insgm, node, vertex = _conditions(spark, d)
    return CN.loads(c, insgm, node, vertex, {1: 0.5, 2: 2.0}).select("step", "i", r6(F.col("f")).alias("f"))


@query(sql(f"""WITH {CONDITION_SQL}, e AS (SELECT c.*, i.nid FROM c JOIN (SELECT DISTINCT sgm, nid FROM mesh_insgm) i ON c.id = i.sgm WHERE kind = 'dirichlet' AND place = 'segment' UNION ALL SELECT c.*, v.nid FROM c JOIN v USING (id) WHERE kind = 'dirichlet' AND place = 'point')
    SELECT 2*nid + dof AS i, round(arg_max(v0 + CASE WHEN varies THEN vx*x + vy*y ELSE 0 END, CASE WHEN place = 'point' THEN 1 ELSE 0 END), 6)+0.0 AS x FROM e JOIN mesh_node USING (nid) GROUP BY 2*nid + dof"""))
def msh23_dirichlet(spark: SparkSession, d: str) -> DataFrame:
    """Unknowns that conditions fix."""
    return CN.fixed(*_conditions(spark, d)).select("i", r6(F.col("x")).alias("x"))


@query(sql("""SELECT nid, round(sum(f), 6) AS force FROM (SELECT unnest([a.nid, b.nid]) AS nid, 3.0 * sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) / 2 AS f FROM mesh_insgm a JOIN mesh_insgm b ON a.sgm = b.sgm AND b.seq = a.seq + 1
    JOIN mesh_node p ON p.nid = a.nid JOIN mesh_node q ON q.nid = b.nid) GROUP BY nid"""))
def msh23_boundary_load(spark: SparkSession, d: str) -> DataFrame:
    # A force of 3 per length on all input segments, half of it to either end.
    node = T.mesh_node(spark, d)
    s = M.wall_faces(T.mesh_insgm(spark, d)).join(node.select(F.col("nid").alias("lo"), F.col("x").alias("x1"), F.col("y").alias("y1")), "lo").join(node.select(F.col("nid").alias("hi"), F.col("x").alias("x2"), F.col("y").alias("y2")), "hi")
    return s.select(F.explode(F.array("lo", "hi")).alias("nid"), (3.0 * G.dist(A, B) / 2).alias("f")).groupBy("nid").agg(F.round(F.sum("f"), 6).alias("force"))


D12, D23, D31 = "sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2))", "sqrt((x2-x3)*(x2-x3)+(y2-y3)*(y2-y3))", "sqrt((x3-x1)*(x3-x1)+(y3-y1)*(y3-y1))"


@query(sql(f"SELECT elem FROM mesh_tri WHERE {D12}*{D23}*{D31}/(2*{DET}) <= 1/1.37"))
def msh24_alpha_filter(spark: SparkSession, d: str) -> DataFrame:
    return T.mesh_tri(spark, d).filter(G.circumradius(A, B, C) <= 1 / 1.37).select("elem")


@query(sql(f"""WITH t AS (SELECT e.nid, elem, round(greatest({D12},{D23},{D31}), 9) AS l, {D12}*{D23}*{D31}/(2*{DET}) AS r FROM mesh_elem e JOIN mesh_tri USING (elem)), n AS (SELECT nid, arg_min(l, (l, elem)) AS l, arg_min(r, (l, elem)) AS r, arg_min(elem, (l, elem)) AS elem FROM t GROUP BY nid)
    SELECT round(1/arg_max(r, (l, -elem)), 6) AS alpha FROM n"""))
def msh25_least_alpha(spark: SparkSession, d: str) -> DataFrame:
    t = T.mesh_tri(spark, d).select("elem", F.round(G.max_edge(A, B, C), 9).alias("l"), G.circumradius(A, B, C).alias("r"))
    n = T.mesh_elem(spark, d).join(t, "elem").groupBy("nid").agg(F.min(F.struct("l", "elem", "r")).alias("t"))
    return n.agg(F.max_by(F.col("t.r"), F.struct(F.col("t.l"), (-F.col("t.elem")).alias("o"))).alias("r")).select(F.round(1 / F.col("r"), 6).alias("alpha"))


CXY = f"""(x1 + ((y3-y1)*((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) - (y2-y1)*((x3-x1)*(x3-x1)+(y3-y1)*(y3-y1))) / (2*{DET})) AS cx, (y1 + ((x2-x1)*((x3-x1)*(x3-x1)+(y3-y1)*(y3-y1)) - (x3-x1)*((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))) / (2*{DET})) AS cy"""


@query(sql(f"""SELECT elem, nid FROM (SELECT *, (x1-cx)*(x1-cx)+(y1-cy)*(y1-cy) AS r2 FROM (SELECT *, {CXY} FROM mesh_tri)) JOIN mesh_node p ON p.x BETWEEN cx-1.2 AND cx+1.2 AND p.y BETWEEN cy-1.2 AND cy+1.2 AND (p.x-cx)*(p.x-cx)+(p.y-cy)*(p.y-cy) < r2 - 1e-7 AND nid NOT IN (n1, n2, n3)"""))
def msh26_delaunay_check(spark: SparkSession, d: str) -> DataFrame:
    from latticework.operators import spatial as S

    cx, cy = G.circumcenter(A, B, C)
    circles = T.mesh_tri(spark, d).select("elem", "n1", "n2", "n3", cx.alias("cx"), cy.alias("cy"), F.sqrt(G.dist2((cx, cy), A)).alias("r"))
    points = T.mesh_node(spark, d).withColumnRenamed("nid", "pid")
    # A circle is about two wide: in cells of three it has few copies.
    hit = S.points_in_circles(points, circles, 3.0).filter("pid <> n1 and pid <> n2 and pid <> n3 and (x-cx)*(x-cx)+(y-cy)*(y-cy) < r*r - 1e-7")
    return hit.select("elem", F.col("pid").alias("nid"))


@query()
def msh27_delaunay(spark: SparkSession, d: str) -> DataFrame:
    """Triangles over each user's points."""
    from latticework.operators.triangulation import triangulated

    return triangulated(T.points_ev(spark, d).withColumnRenamed("user_id", "grp"))


@query(sql("SELECT CAST(count(*) AS BIGINT) AS points, CAST(0 AS BIGINT) AS euler, CAST(0 AS BIGINT) AS illegal, CAST(0 AS BIGINT) AS dents, 0.0::DOUBLE AS gap FROM (SELECT DISTINCT x, y FROM points_neg)"))
def msh27_one_cloud(spark: SparkSession, d: str) -> DataFrame:
    """One triangulation of all embeddings' points, and what makes it the right one.

    Of n points it has 2 n - 2 - border triangles, no edge whose two triangles see each other's corner in their circle, a border
    without dents, and as much area as the border encloses.
    """
    from latticework.operators.triangulation import triangulated

    p = T.points_neg(spark, d)
    t = T.stored_once(triangulated(p.withColumn("grp", F.lit(0)), bound=500))
    for k in (1, 2, 3):
        t = t.join(p.select(F.col("pid").alias(f"n{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")), f"n{k}")
    t = T.stored_once(t)
    end = lambda k, s: [F.col(f"{c}{k}").alias(f"{c}{s}") for c in "nxy"]
    edge = t.select(F.explode(F.array(*[F.struct(*end(i, "a"), *end(j, "b"), *end(k, "c")) for i, j, k in ((1, 2, 3), (2, 3, 1), (3, 1, 2))])).alias("e")).select("e.*")
    twin = edge.select(F.col("na").alias("nb"), F.col("nb").alias("na"), F.col("nc").alias("nd"), F.col("xc").alias("xd"), F.col("yc").alias("yd"))
    both = T.stored_once(edge.join(twin, ["na", "nb"], "left"))
    # A distance from the circle's rim, so that points on it pass.
    cx, cy = G.circumcenter(G.point("xa", "ya"), G.point("xb", "yb"), G.point("xc", "yc"))
    r2, d2 = G.dist2((cx, cy), G.point("xa", "ya")), G.dist2((cx, cy), G.point("xd", "yd"))
    border = both.filter("nd is null")
    follow = border.select(F.col("na").alias("nb"), F.col("xb").alias("xe"), F.col("yb").alias("ye"))
    dents = border.join(follow, "nb").filter(G.orient(G.point("xa", "ya"), G.point("xb", "yb"), G.point("xe", "ye")) < -1e-9)
    cross = F.expr("xa * yb - xb * ya") / 2
    parts = [
        t.select(F.explode(F.array("n1", "n2", "n3")).alias("n")).distinct().agg(F.count("*").alias("points")), t.agg(F.count("*").alias("triangles"), F.sum(G.tri_area(G.point("x1", "y1"), G.point("x2", "y2"), G.point("x3", "y3"))).alias("area")),
        border.agg(F.count("*").alias("border"), F.sum(cross).alias("hull")), both.filter(F.col("nd").isNotNull() & (d2 < r2 * (1 - 1e-9))).agg(F.count("*").alias("illegal")), dents.agg(F.count("*").alias("dents")),
    ]
    one = parts[0]
    for more in parts[1:]:
        one = one.join(more, F.lit(True))
    return one.select("points", F.expr("triangles - (2 * points - 2 - border)").alias("euler"), "illegal", "dents", r6(F.round(F.col("area") - F.col("hull"), 3)).alias("gap"))


@query(sql("SELECT s.sgm, s.lo, s.hi, min(f.elem) AS first, max(f.elem) AS last FROM (SELECT a.sgm, least(a.nid, b.nid) AS lo, greatest(a.nid, b.nid) AS hi FROM mesh_insgm a JOIN mesh_insgm b ON a.sgm = b.sgm AND b.seq = a.seq + 1) s JOIN mesh_face f USING (lo, hi) GROUP BY 1, 2, 3"))
def msh34_elements_along_segments(spark: SparkSession, d: str) -> DataFrame:
    s = M.wall_faces(T.mesh_insgm(spark, d))
    return s.join(M.faces(T.mesh_elem(spark, d)).select("elem", "lo", "hi"), ["lo", "hi"]).groupBy("sgm", "lo", "hi").agg(F.min("elem").alias("first"), F.max("elem").alias("last"))


@query(sql("""SELECT elem, round(max(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))), 6) AS radius FROM mesh_elem JOIN mesh_node USING (nid) JOIN (SELECT elem, (x1+x2+x3)/3 AS cx, (y1+y2+y3)/3 AS cy FROM mesh_tri) USING (elem) GROUP BY elem"""))
def agg7_elem_radius(spark: SparkSession, d: str) -> DataFrame:
    cx, cy = G.centroid(A, B, C)
    c = T.mesh_tri(spark, d).select("elem", cx.alias("cx"), cy.alias("cy"))
    at = T.mesh_elem(spark, d).join(T.mesh_node(spark, d), "nid").join(c, "elem")
    return at.groupBy("elem").agg(F.round(F.max(G.dist(G.point("x", "y"), G.point("cx", "cy"))), 6).alias("radius"))


def _to_side(i: int, j: int) -> str:
    """The distance of (cx, cy) from the side between two corners."""
    dx, dy = f"(x{j}-x{i})", f"(y{j}-y{i})"
    u = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((cx-x{i})*{dx}+(cy-y{i})*{dy})/({dx}*{dx}+{dy}*{dy})))"
    return f"sqrt((cx-x{i}-{u}*{dx})*(cx-x{i}-{u}*{dx})+(cy-y{i}-{u}*{dy})*(cy-y{i}-{u}*{dy}))"


@query(sql(f"SELECT elem, round(greatest({_to_side(1, 2)}, {_to_side(2, 3)}, {_to_side(3, 1)}), 6) AS apothem FROM (SELECT *, (x1+x2+x3)/3 AS cx, (y1+y2+y3)/3 AS cy FROM mesh_tri)"))
def agg7_elem_apothem(spark: SparkSession, d: str) -> DataFrame:
    """The largest distance of an element's centre from its sides."""
    c = G.centroid(A, B, C)
    return T.mesh_tri(spark, d).select("elem", F.round(F.greatest(*[G.dist(G.closest_on_segment(p, q, c), c) for p, q in ((A, B), (B, C), (C, A))]), 6).alias("apothem"))


@query(sql("SELECT round(max(l), 6) AS max_disp FROM (SELECT sqrt(sum(value*value)) AS l FROM field_u GROUP BY nid)"))
def agg12_max_displacement(spark: SparkSession, d: str) -> DataFrame:
    return T.field_u(spark, d).groupBy("nid").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l")).agg(F.round(F.max("l"), 6).alias("max_disp"))


@query(sql("""WITH n AS (SELECT f.elem, f.face, d.dst FROM mesh_face f LEFT JOIN mesh_dual d ON d.src = f.elem AND d.face = f.face),
    p AS (SELECT elem, max(dst) FILTER (face = 0) AS d0, max(dst) FILTER (face = 1) AS d1, max(dst) FILTER (face = 2) AS d2 FROM n GROUP BY elem)
    SELECT elem, face, CASE face WHEN 0 THEN d2 WHEN 1 THEN d0 ELSE d1 END AS "left", CASE face WHEN 0 THEN d1 WHEN 1 THEN d2 ELSE d0 END AS "right" FROM n JOIN p USING (elem)"""))
def win11_side_neighbours(spark: SparkSession, d: str) -> DataFrame:
    elem = T.mesh_elem(spark, d)
    n = M.neighbours(elem).select(F.col("src").alias("elem"), "face", "dst")
    f = M.faces(elem).join(n, ["elem", "face"], "left")
    sides = F.count("*").over(W.partitionBy("elem"))
    f = f.withColumns({"l": F.pmod(F.col("face") - 1, sides).cast("int"), "r": F.pmod(F.col("face") + 1, sides).cast("int")})
    side = lambda c: n.select("elem", F.col("face").alias(c), F.col("dst").alias({"l": "left", "r": "right"}[c]))
    return f.join(side("l"), ["elem", "l"], "left").join(side("r"), ["elem", "r"], "left").select("elem", "face", "left", "right")

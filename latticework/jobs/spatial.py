"""Queries of the spatial joins, boxes and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.jobs.registry import query
from latticework.operators import spatial as S
from latticework.sources import tables as T
from latticework.sources.tables import r6, sql

INSIDE = "6.25 - ((p.x-cx)*(p.x-cx)+(p.y-cy)*(p.y-cy)) > 2.25e-16"
BX, BY = "CAST(trunc((CASE WHEN x < 0 THEN x - 5.0 ELSE x END) / 5.0) AS BIGINT)", "CAST(trunc((CASE WHEN y < 0 THEN y - 5.0 ELSE y END) / 5.0) AS BIGINT)"


@query(sql(f"SELECT cid, pid FROM circles JOIN points_ev p ON p.x BETWEEN cx-2.5 AND cx+2.5 AND {INSIDE}"))
def join1_points_in_circle(spark: SparkSession, d: str) -> DataFrame:
    return S.points_in_circles(T.points_ev(spark, d).select("pid", "x", "y"), T.circles(spark, d), 2.5).select("cid", "pid")


@query(sql("SELECT DISTINCT cid FROM circles JOIN points_ev p ON p.x BETWEEN cx-1.0 AND cx+1.0 AND 1.0 - ((p.x-cx-0.3)*(p.x-cx-0.3)+(p.y-cy)*(p.y-cy)) > 2.25e-16 WHERE true"))
def join2_any_point_in_circle(spark: SparkSession, d: str) -> DataFrame:
    c = T.circles(spark, d).select("cid", (F.col("cx") + 0.3).alias("cx"), "cy", F.lit(1.0).alias("r"))
    p = T.points_ev(spark, d).select("pid", "x", "y")
    return S.points_in_circles(p, c, 2.0, "left_semi").select("cid")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return T.points_ev(spark, d).filter("pid % 50 = 0").select(F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))


def _knn_sql(k: int, where: str) -> str:
    return sql(f"""SELECT qid, pid, round(d, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, pid) AS rank FROM
        (SELECT q.pid AS qid, p.pid, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) AS d FROM points_ev q JOIN points_ev p ON q.pid % 50 = 0 AND p.pid <> q.pid) WHERE {where}) WHERE rank <= {k}""")


@query(_knn_sql(5, "true"))
def join3_knn(spark: SparkSession, d: str) -> DataFrame:
    return S.knn(_queries(spark, d), T.points_ev(spark, d), 5).select("qid", "pid", r6(F.col("dist")).alias("dist"), "rank")


@query(_knn_sql(4, "d > 5 AND pid % 2 = 1"))
def join4_knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = S.knn(_queries(spark, d), T.points_ev(spark, d), 4, keep=lambda dist, pid: pid % 2 == 1, beyond=5.0)
    return found.select("qid", "pid", r6(F.col("dist")).alias("dist"), "rank")


@query(_knn_sql(1, "pid % 3 <> 0"))
def join5_nearest_except(spark: SparkSession, d: str) -> DataFrame:
    points = T.points_ev(spark, d)
    ignored = points.filter("pid % 3 = 0").select("pid")
    return S.knn(_queries(spark, d), points.join(ignored, "pid", "left_anti"), 1).select("qid", "pid", r6(F.col("dist")).alias("dist"), "rank")


EDGES = "ring_edge AS (SELECT poly_id, seq, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY poly_id ORDER BY seq))"


@query(sql(f"WITH {EDGES} SELECT pid, poly_id FROM points_ev p JOIN ring_edge e ON (y1 > p.y) <> (y2 > p.y) AND p.x < x1 + (p.y-y1)/(y2-y1)*(x2-x1) GROUP BY pid, poly_id HAVING count(*) % 2 = 1"))
def join6_points_in_polygons(spark: SparkSession, d: str) -> DataFrame:
    return S.points_in_polygons(T.points_ev(spark, d), T.rings(spark, d), 3.0)


@query(sql(f"WITH {EDGES} SELECT poly_id, seq, 1000000 * poly_id + seq AS pid FROM ring_edge WHERE seq % 2 = 0"))
def join7_points_on_polygon_boundary(spark: SparkSession, d: str) -> DataFrame:
    # The middles of all edges, the odd ones moved off the line.
    e = S.ring_edges(T.rings(spark, d))
    off = F.when(F.col("seq") % 2 == 0, 0.0).otherwise(0.01)
    mid = e.select((1000000 * F.col("poly_id") + F.col("seq")).alias("pid"), ((F.col("x1") + F.col("x2")) / 2 + off).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), F.col("poly_id").alias("of"))
    return S.points_on_edges(mid, e, 3.0, 1e-6).filter("of = poly_id").select("poly_id", "seq", "pid").distinct()


def _in_mesh(spark: SparkSession, d: str) -> DataFrame:
    p = T.points_ev(spark, d)
    return p.select("pid", F.round(F.col("x") / 8, 6).alias("x"), F.col("y").alias("y"))


@query(sql("""SELECT pid, min(elem) AS elem FROM (SELECT pid, round(x/8, 6) AS x, y FROM points_ev) p JOIN mesh_tri ON p.x BETWEEN least(x1,x2,x3)-1e-6 AND greatest(x1,x2,x3)+1e-6 AND p.y BETWEEN least(y1,y2,y3)-1e-6 AND greatest(y1,y2,y3)+1e-6
    WHERE (x2-x1)*(y-y1)-(y2-y1)*(x-x1) > -1.5e-8 AND (x3-x2)*(y-y2)-(y3-y2)*(x-x2) > -1.5e-8 AND (x1-x3)*(y-y3)-(y1-y3)*(x-x3) > -1.5e-8 GROUP BY pid"""))
def join8_locate_element(spark: SparkSession, d: str) -> DataFrame:
    return S.locate(_in_mesh(spark, d), T.mesh_tri(spark, d), 2.0)


CROSS = """((a.x2-a.x1)*(b.y1-a.y1)-(a.y2-a.y1)*(b.x1-a.x1)) * ((a.x2-a.x1)*(b.y2-a.y1)-(a.y2-a.y1)*(b.x2-a.x1)) < 0
    AND ((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1)) * ((b.x2-b.x1)*(a.y2-b.y1)-(b.y2-b.y1)*(a.x2-b.x1)) < 0"""


@query(sql(f"SELECT a.sid AS a, b.sid AS b FROM segs a JOIN segs b ON a.sid < b.sid AND b.x1 BETWEEN a.x1 - 2.0001 AND a.x1 + 2.0001 AND {CROSS}"))
def join9_segment_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.crossing_pairs(T.segs(spark, d), 1.5)


@query(sql("SELECT sid, 10 * sid + 1 AS pid FROM segs WHERE sid % 2 = 0 AND (x1 <> x2 OR y1 <> y2)"))
def join10_vertices_touching_edges(spark: SparkSession, d: str) -> DataFrame:
    s = T.segs(spark, d)
    at = F.when(F.col("sid") % 2 == 0, 0.25).otherwise(1.25)
    v = s.select((10 * F.col("sid") + 1).alias("pid"), (F.col("x1") + at * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + at * (F.col("y2") - F.col("y1"))).alias("y"))
    return S.points_on_edges(v, s, 1.5).select("sid", "pid").filter("sid = pid div 10")


@query(sql("SELECT a.pid AS a, b.pid AS b FROM points_ev a JOIN points_ev b ON a.pid < b.pid AND b.x BETWEEN a.x - 0.3 AND a.x + 0.3 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) < 0.09"))
def join11_near_duplicate_vertices(spark: SparkSession, d: str) -> DataFrame:
    return S.near_pairs(T.points_ev(spark, d), 0.3).select("a", "b")


@query(sql("""WITH g AS (SELECT *, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) AS q FROM segs WHERE x1 <> x2 OR y1 <> y2),
    h AS (SELECT sid, pid, q, ((p.x-(x1+x2)/2)*(p.x-(x1+x2)/2) + (p.y-(y1+y2)/2)*(p.y-(y1+y2)/2) - q/4) / (2 * ((x2-x1)*(p.y-y1)-(y2-y1)*(p.x-x1)) / sqrt(q)) AS height FROM g, points_ev p WHERE (x2-x1)*(p.y-y1)-(y2-y1)*(p.x-x1) >= 1.5e-8),
    l AS (SELECT sid, pid, CAST(CASE WHEN height <= 0 THEN 0 ELSE floor(sqrt(height*height + q/4) / sqrt(q)) END AS BIGINT) AS layer FROM h), m AS (SELECT sid, min(layer) AS low FROM l GROUP BY sid)
    SELECT sid, pid, layer FROM l JOIN m USING (sid) WHERE layer = low"""))
def join12_half_plane_candidates(spark: SparkSession, d: str) -> DataFrame:
    return S.half_plane_candidates(T.segs(spark, d), T.points_ev(spark, d), 2.0).select("sid", "pid", "layer")


@query(sql("SELECT elem, pos, nid, x, y FROM mesh_elem JOIN mesh_node USING (nid)"))
def join13_node_coords(spark: SparkSession, d: str) -> DataFrame:
    return T.mesh_elem(spark, d).join(T.mesh_node(spark, d), "nid").select("elem", "pos", "nid", "x", "y")


@query(sql("""SELECT pid, round(coalesce(1 - lum/255.0, 1.5e-8) / 0.5, 6) AS density FROM (SELECT pid, CAST(floor(x/720*64) AS INTEGER) AS c, 63 - CAST(floor(y/64) AS INTEGER) AS r FROM points_ev) p
    LEFT JOIN (SELECT r, c, 0.299*ch[1]+0.587*ch[2]+0.114*ch[3] AS lum FROM pixels WHERE img = 0) i USING (r, c)"""))
def join14_image_density(spark: SparkSession, d: str) -> DataFrame:
    p = T.points_ev(spark, d).select("pid", F.floor(F.col("x") / 720 * 64).cast("int").alias("c"), (63 - F.floor(F.col("y") / 64)).cast("int").alias("r"))
    lum = 0.299 * F.col("ch")[0] + 0.587 * F.col("ch")[1] + 0.114 * F.col("ch")[2]
    image = T.pixels(spark, d).filter("img = 0").select("r", "c", lum.alias("lum"))
    return p.join(image, ["r", "c"], "left").select("pid", F.round(F.coalesce(1 - F.col("lum") / 255.0, F.lit(G.TOL)) / 0.5, 6).alias("density"))


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) AS contained FROM part")
def join15_contains(spark: SparkSession, d: str) -> DataFrame:
    part, keys = T.read(spark, d, "part").select("p_partkey"), T.read(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    yes = part.join(keys, "p_partkey", "left_semi").withColumn("contained", F.lit(True))
    return yes.unionByName(part.join(keys, "p_partkey", "left_anti").withColumn("contained", F.lit(False)))


@query(sql("SELECT user_id, min(x) AS lx, min(y) AS ly, max(x) AS hx, max(y) AS hy FROM points_ev GROUP BY user_id"))
def agg1_enveloping_box(spark: SparkSession, d: str) -> DataFrame:
    return T.points_ev(spark, d).groupBy("user_id").agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy"))


@query(sql(f"SELECT CAST(count(*) AS BIGINT) AS bins, CAST(min(n) AS BIGINT) AS fewest, CAST(sum(n) AS BIGINT) AS points FROM (SELECT count(*) AS n FROM (SELECT {BX} AS b1, {BY} AS b2 FROM points_neg) GROUP BY b1, b2)"))
def agg2_bin_counts(spark: SparkSession, d: str) -> DataFrame:
    n = S.with_cell(T.points_neg(spark, d), 5.0).groupBy("bx", "by").count()
    return n.agg(F.count("*").alias("bins"), F.min("count").alias("fewest"), F.sum("count").alias("points"))


@query(sql(f"WITH {EDGES} SELECT poly_id, round(sum(x1*y2-x2*y1)/2, 4) AS area FROM ring_edge GROUP BY poly_id"))
def agg3_polygon_area(spark: SparkSession, d: str) -> DataFrame:
    return S.ring_edges(T.rings(spark, d)).groupBy("poly_id").agg(F.round(F.sum(F.expr("x1*y2-x2*y1")) / 2, 4).alias("area"))


@query(sql(f"""WITH {EDGES}, f AS (SELECT e.poly_id, r.x AS x0, r.y AS y0, x1, y1, x2, y2, (x1-r.x)*(y2-r.y)-(x2-r.x)*(y1-r.y) AS a FROM ring_edge e JOIN rings r ON r.poly_id = e.poly_id AND r.seq = 0)
    SELECT poly_id, round(sum(a*(x0+x1+x2)/3)/sum(a), 6) AS cx, round(sum(a*(y0+y1+y2)/3)/sum(a), 6) AS cy FROM f GROUP BY poly_id"""))
def agg4_polygon_centroid(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("poly_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    e = S.ring_edges(T.rings(spark, d)).withColumns({"x0": F.first("x1").over(w), "y0": F.first("y1").over(w)})
    e = e.withColumn("a", F.expr("(x1-x0)*(y2-y0)-(x2-x0)*(y1-y0)"))
    mean = lambda v: r6(F.sum(F.expr(f"a*({v}0+{v}1+{v}2)/3")) / F.sum("a"))
    return e.groupBy("poly_id").agg(mean("x").alias("cx"), mean("y").alias("cy"))


@query(sql("SELECT (SELECT round(sum((x2-x1)*(y3-y1)-(y2-y1)*(x3-x1))/2, 3) FROM mesh_tri) AS area, (SELECT round(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))), 3) FROM segs) AS length"))
def agg5_mesh_area(spark: SparkSession, d: str) -> DataFrame:
    A, B, C = G.point("x1", "y1"), G.point("x2", "y2"), G.point("x3", "y3")
    area = T.mesh_tri(spark, d).agg(F.round(F.sum(G.tri_area(A, B, C)), 3).alias("area"))
    return area.join(T.segs(spark, d).agg(F.round(F.sum(G.dist(A, B)), 3).alias("length")), F.lit(True))


@query("SELECT user_id, arg_min(event_id, (value, event_id)) AS lowest, arg_max(event_id, (value, -event_id)) AS highest, arg_min(event_id, (abs(value-50), event_id)) AS nearest50 FROM events GROUP BY user_id")
def agg6_argmin_argmax(spark: SparkSession, d: str) -> DataFrame:
    by = lambda v: F.struct(v, "event_id")
    return T.read(spark, d, "events").groupBy("user_id").agg(
        F.min_by("event_id", by(F.col("value"))).alias("lowest"), F.max_by("event_id", F.struct(F.col("value"), (-F.col("event_id")).alias("o"))).alias("highest"), F.min_by("event_id", by(F.abs(F.col("value") - 50))).alias("nearest50")
    )


@query("SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM events GROUP BY user_id")
def agg9_mean_deviation(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"))


@query("SELECT event_id % 97 AS slot, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id * 31 AS event_id FROM events) GROUP BY 1 HAVING count(*) > 1")
def agg13_hash_collisions(spark: SparkSession, d: str) -> DataFrame:
    keys = T.read(spark, d, "events").select((F.col("user_id") * 31).alias("key")).distinct()
    return keys.groupBy(F.pmod("key", F.lit(97)).alias("slot")).agg(F.count("*").alias("n")).filter("n > 1")


@query(sql("SELECT pid, user_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM points_ev WINDOW w AS (PARTITION BY user_id ORDER BY x, pid)"))
def win1_ring_edges(spark: SparkSession, d: str) -> DataFrame:
    rings = T.points_ev(spark, d).select(F.col("user_id").alias("poly_id"), F.struct("x", "pid").alias("seq"), "x", "y")
    return S.ring_edges(rings).select(F.col("seq.pid").alias("pid"), F.col("poly_id").alias("user_id"), "x1", "y1", "x2", "y2")

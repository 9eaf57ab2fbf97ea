"""Queries of the text formats, models and streams; what they write and read again is derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import geometry as G
from latticework.jobs.registry import query
from latticework.operators import faces as FC
from latticework.operators import graph as GR
from latticework.operators import models as M
from latticework.operators import sparse as SP
from latticework.operators import spatial as S
from latticework.sources import formats as FM
from latticework.sources import lines as L
from latticework.sources import tables as T
from latticework.sources import textfiles as X
from latticework.sources.scratch import shared_dir
from latticework.sources.tables import r6, sql


def _fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@query("SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def src1_read_tables(spark: SparkSession, d: str) -> DataFrame:
    r, n, c = (T.read(spark, d, t) for t in ("region", "nation", "customer"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(sql("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(x), 3) AS sx, round(sum(y), 3) AS sy FROM points_ev GROUP BY user_id"))
def src2_points_text(spark: SparkSession, d: str) -> DataFrame:
    # Written as a document for each user, bundled in common files, and read again.
    p = T.points_ev(spark, d)
    path = _fresh(spark, "points")
    L.write_lines(FM.point_lines(p.select(F.col("user_id").alias("key"), "pid", "x", "y")), path, ["pid"], bundles=True)
    back = FM.points_read(L.lines_of(spark, path, bundles=True))
    return back.groupBy(F.expr("try_cast(doc as bigint)").alias("user_id")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"))


def _ring_models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Octagons as models of their own; the last edge closes the ring."""
    r = T.rings(spark, d)
    vertex = r.select(F.col("poly_id").alias("model"), F.col("seq").cast("long").alias("vid"), "x", "y")
    edge = r.select(F.col("poly_id").alias("model"), F.col("seq").cast("long").alias("eid"), F.col("seq").cast("long").alias("v1"), ((F.col("seq") + 1) % 8).cast("long").alias("v2"))
    hole = r.filter("seq = 0 and poly_id % 300 = 0").select(F.col("poly_id").alias("model"), F.lit(0).cast("long").alias("hid"), (F.col("x") - 3).alias("x"), "y")
    return vertex, edge, hole


@query(sql("SELECT CAST(count(*) AS BIGINT) AS vertices, CAST(count(*) AS BIGINT) AS edges, CAST(count(*) FILTER (seq = 0 AND poly_id % 300 = 0) AS BIGINT) AS holes, round(sum(x), 3) AS sx FROM rings"))
def src3_pslg_text(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "pslg")
    L.write_lines(FM.pslg_lines(*_ring_models(spark, d)), path, ["part", "id"], bundles=True)
    back = FM.pslg_read(L.lines_of(spark, path, bundles=True))
    v = back["vertex"].agg(F.count("*").alias("vertices"), F.round(F.sum("x"), 3).alias("sx"))
    return v.join(back["edge"].agg(F.count("*").alias("edges")), F.lit(True)).join(back["hole"].agg(F.count("*").alias("holes")), F.lit(True))


@query(sql("SELECT i, j, v FROM coo"))
def src4_sparse_text(spark: SparkSession, d: str) -> DataFrame:
    m = T.coo(spark, d)
    path = _fresh(spark, "sparse")
    X.sparse_text(m).select(F.concat_ws("\t", F.col("i").cast("string"), "value").alias("value")).write.text(path)
    t = F.split("value", "\t")
    return X.parse_sparse(spark.read.text(path).select(t[0].cast("long").alias("i"), t[1].alias("value")))


def _numbers(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """(i) from 0 to the largest row or column of entries."""
    return spark.range(entries.agg(F.max(F.greatest("i", "j"))).first()[0] + 1).select(F.col("id").alias("i"))


def _symmetric(spark: SparkSession, d: str) -> DataFrame:
    return T.edges_sym(spark, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").cast("double").alias("v"))


@query(sql("SELECT 'plain' AS form, i, j, CAST(v AS DOUBLE) AS v FROM coo UNION ALL SELECT 'sized', i, j, CAST(v AS DOUBLE) FROM coo UNION ALL SELECT 'graph', src, dst, CAST(w AS DOUBLE) FROM edges_sym"))
def src4_matrix_formats(spark: SparkSession, d: str) -> DataFrame:
    """Matrices written and read again in each form, rows without entries too; a header's counts are held against what follows."""
    m, g = T.stored_once(T.coo(spark, d).withColumn("v", F.col("v").cast("double"))), T.stored_once(_symmetric(spark, d))
    out = None
    for form, entries in (("plain", m), ("sized", m), ("graph", g)):
        path = _fresh(spark, "matrix")
        L.write_lines(FM.matrix_lines(entries, _numbers(spark, entries), form).withColumn("key", F.lit(0)), path, ["i"])
        back, _, faults = FM.matrix_read(L.lines_of(spark, path + "/key=*", folders=True), form)
        # A document with a fault gives no rows.
        back = back.join(faults.select("doc"), "doc", "left_anti").select(F.lit(form).alias("form"), "i", "j", "v")
        out = back if out is None else out.unionByName(back)
    return out


@query(sql("""WITH c AS (SELECT max(greatest(i, j)) AS most FROM coo), r AS (SELECT CAST(range AS BIGINT) AS i FROM c, range(0, c.most + 1)),
    l AS (SELECT r.i, coalesce(string_agg((j + 1) || ' ' || CAST(CAST(v AS INTEGER) AS VARCHAR), ' ' ORDER BY j), '') AS line FROM r LEFT JOIN coo USING (i) GROUP BY r.i)
    SELECT i, line FROM l UNION ALL SELECT -1, (SELECT most + 1 FROM c) || ' ' || (SELECT max(j) + 1 FROM coo) || ' ' || (SELECT count(*) FROM coo)"""))
def src5_matrix_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a matrix with a header of rows, columns and entries (i = -1)."""
    m = T.stored_once(T.coo(spark, d).withColumn("v", F.col("v").cast("int")))
    return FM.matrix_lines(m, _numbers(spark, m), "sized")


@query(sql("""WITH g AS (SELECT max(src) AS most FROM edges_sym), r AS (SELECT CAST(range AS BIGINT) AS i FROM g, range(0, g.most + 1))
    SELECT r.i, CAST(count(dst) AS BIGINT) AS degree, CAST(coalesce(sum(w), 0) AS DOUBLE) AS w, CAST(r.i % 5 + 1 AS DOUBLE) AS size, CAST(r.i % 3 AS DOUBLE) AS w1, CAST(r.i % 7 AS DOUBLE) AS w2 FROM r LEFT JOIN edges_sym ON src = r.i GROUP BY r.i"""))
def src6_graph_formats(spark: SparkSession, d: str) -> DataFrame:
    """A graph with vertex sizes, two weights a vertex and edge weights, written under its flags and read again; several files, one document."""
    e = T.stored_once(_symmetric(spark, d))
    path = _fresh(spark, "graph")
    rows = _numbers(spark, e).withColumns({"size": F.col("i") % 5 + 1, "w1": F.col("i") % 3, "w2": F.col("i") % 7})
    L.write_lines(FM.matrix_lines(e, rows, "graph", sizes="size", weights=["w1", "w2"]).withColumn("key", F.lit(0)), path, ["i"])
    entries, vertices, faults = FM.matrix_read(L.lines_of(spark, path + "/key=*", folders=True), "graph")
    sums = entries.groupBy("doc", "i").agg(F.count("*").alias("degree"), F.sum("v").alias("w"))
    whole = vertices.join(faults.select("doc"), "doc", "left_anti").join(sums, ["doc", "i"], "left")
    return whole.select("i", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("w", F.lit(0.0)).alias("w"), "size", F.col("weights")[0].alias("w1"), F.col("weights")[1].alias("w2"))


@query(sql("SELECT i, string_agg((j + 1) || ' ' || CAST(CAST(v AS INTEGER) AS VARCHAR), ' ' ORDER BY j) AS value FROM coo GROUP BY i"))
def src5_write_sparse(spark: SparkSession, d: str) -> DataFrame:
    return X.sparse_text(T.coo(spark, d).withColumn("v", F.col("v").cast("int")))


@query(sql("SELECT src AS i, string_agg(CAST(dst + 1 AS VARCHAR), ' ' ORDER BY dst) AS value FROM edges_sym GROUP BY src"))
def src6_write_graph(spark: SparkSession, d: str) -> DataFrame:
    e = T.edges_sym(spark, d)
    return X.sparse_text(e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v")), values=False)


def _step_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as result steps: a step for each day, a row for each event."""
    p = T.points_ev(spark, d)
    step = (F.floor(F.col("x") / 24) + 1).cast("int")
    rows = p.select(step.alias("step"), step.cast("double").alias("time"), F.lit("value").alias("name"), F.lit("Nodes").alias("support"), F.col("pid").alias("id"), F.posexplode(F.array("x", "y")).alias("comp", "value"))
    return rows


@query(sql("SELECT step, comp, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM (SELECT CAST(floor(x/24) AS INTEGER) + 1 AS step, unnest([0, 1]) AS comp, unnest([x, y]) AS value FROM points_ev) GROUP BY 1, 2"))
def src7_step_fields(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "steps")
    L.write_lines(FM.step_lines(_step_rows(spark, d).withColumn("key", F.lit(0))), path, ["step", "part", "name", "row"])
    back = FM.steps_read(L.lines_of(spark, path + "/key=*", folders=True, comment="#.*$"))
    return back.groupBy("step", "comp").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


HOT_STEP = "CASE WHEN pid % 3 = 0 THEN 1 ELSE CAST(floor(x/24) AS INTEGER) + 1 END"


def _hot_steps(spark: SparkSession, d: str) -> DataFrame:
    """A document of steps with two fields; a third of all rows lies in step 1."""
    p = T.points_ev(spark, d).withColumn("step", F.when(F.col("pid") % 3 == 0, 1).otherwise((F.floor(F.col("x") / 24) + 1).cast("int")))
    base = lambda name, kind: [F.lit(0).alias("key"), "step", (F.col("step") / 4).alias("time"), F.lit(name).alias("name"), F.lit(kind).alias("support"), F.col("pid").alias("id")]
    fields = p.select(*base("place", "Nodes"), F.posexplode(F.array("x", "y")).alias("comp", "value")).unionByName(p.select(*base("level", "Elements"), F.lit(0).alias("comp"), F.col("y").alias("value")))
    path = _fresh(spark, "steps")
    L.write_lines(FM.step_lines(fields), path, ["step", "part", "name", "row"])
    return L.lines_of(spark, path + "/key=*", folders=True, comment="#.*$")


@query(sql(f"SELECT step, step / 4.0::DOUBLE AS time, CAST(row_number() OVER (PARTITION BY step ORDER BY pid) - 1 AS BIGINT) AS id, y AS value, 'Scalar' AS type, 'Elements' AS support FROM (SELECT *, {HOT_STEP} AS step FROM points_ev)"))
def src7_named_field(spark: SparkSession, d: str) -> DataFrame:
    """All steps of one field."""
    return FM.steps_read(_hot_steps(spark, d), name="level").select("step", "time", "id", "value", "type", "support")


@query(sql(f"SELECT DISTINCT step, step / 4.0::DOUBLE AS time FROM (SELECT {HOT_STEP} AS step FROM points_ev)"))
def src7_step_list(spark: SparkSession, d: str) -> DataFrame:
    return FM.step_list(_hot_steps(spark, d)).select("step", "time")


@query(sql("SELECT elem, '3 ' || string_agg(CAST(nid AS VARCHAR), ' ' ORDER BY pos) AS line, 5 AS type FROM mesh_elem GROUP BY elem"))
def src8_mesh_view(spark: SparkSession, d: str) -> DataFrame:
    return X.vtk_cells(T.mesh_elem(spark, d))


@query(sql("""WITH e AS (SELECT elem, dense_rank() OVER (ORDER BY elem) - 1 AS k, pos, nid FROM mesh_elem) SELECT CAST(k AS BIGINT) AS elem, pos, x, y, 5 AS type FROM e JOIN mesh_node USING (nid)"""))
def src8_mesh_text(spark: SparkSession, d: str) -> DataFrame:
    """A mesh as a document of points, cells and types, written and read again."""
    path = _fresh(spark, "mesh")
    L.write_lines(FM.mesh_lines(T.mesh_node(spark, d), T.mesh_elem(spark, d)).withColumn("key", F.lit(0)), path, ["part", "row"])
    t = FM.mesh_read(L.lines_of(spark, path + "/key=*", folders=True))
    tasks = 2 * T.edge_tasks(spark, d)
    placed = t["elem"].repartition(tasks, "doc", "i").join(t["node"], ["doc", "i"])
    return placed.repartition(tasks, "doc", "elem").join(t["type"], ["doc", "elem"]).select("elem", "pos", "x", "y", "type")


@query("SELECT 'k' || event_id AS name, CAST(value AS VARCHAR) AS value, value AS number FROM events WHERE event_id % 5 <> 0")
def src9_assignments(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events")
    arrow = F.when(F.col("event_id") % 2 == 0, " <- ").otherwise(" = ")
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("# k = "), F.col("value").cast("string"))).otherwise(F.concat(F.lit("  k"), F.col("event_id").cast("string"), arrow, F.col("value").cast("string"), F.lit("  // note")))
    return X.settings(e.select(line.alias("line")))


@query(sql("SELECT DISTINCT poly_id AS model, CAST(CASE poly_id % 500 WHEN 100 THEN 5 WHEN 200 THEN 3 WHEN 300 THEN 4 ELSE 0 END AS INTEGER) AS code FROM rings"))
def msh28_check_models(spark: SparkSession, d: str) -> DataFrame:
    # Octagons, some of them damaged: a repeated edge, a repeated vertex, an edge to nowhere.
    v, e, _ = _ring_models(spark, d)
    e = e.unionByName(e.filter("eid = 0 and model % 500 = 100").withColumn("eid", F.lit(8).cast("long"))).unionByName(e.filter("eid = 0 and model % 500 = 300").select("model", F.lit(9).cast("long").alias("eid"), "v1", F.lit(99).cast("long").alias("v2")))
    v = v.unionByName(v.filter("vid = 0 and model % 500 = 200").withColumn("vid", F.lit(8).cast("long")))
    return M.check(v, e)


@query(sql("SELECT poly_id AS model, CAST(seq AS BIGINT) AS eid, CAST(CASE WHEN poly_id % 200 = 0 THEN 0 WHEN seq < 4 THEN 0 ELSE 4 END AS BIGINT) AS wire FROM rings"))
def msh29_wires(spark: SparkSession, d: str) -> DataFrame:
    # Every other ring has spurs at vertices 0 and 4, which cut it into two wires.
    _, e, _ = _ring_models(spark, d)
    spur = e.filter("eid in (0, 4) and model % 200 <> 0").select("model", (F.col("eid") + 10).alias("eid"), "v1", (F.col("v1") + 50).alias("v2"))
    return M.wires(e.unionByName(spur)).filter("eid < 10")


@query(sql("""SELECT poly_id AS model, CAST(seq AS BIGINT) AS eid, CAST(CASE WHEN poly_id % 200 = 0 OR seq < 4 THEN 0 ELSE 4 END AS BIGINT) AS wire,
    CAST(CASE WHEN poly_id % 200 = 0 OR seq < 4 THEN seq ELSE 7 - seq END AS BIGINT) AS place, poly_id % 200 = 0 OR seq < 4 AS forward FROM rings"""))
def msh29_wire_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of edges along their wires: around whole rings, and along both halves of those with spurs from the smaller of their ends."""
    _, e, _ = _ring_models(spark, d)
    spur = e.filter("eid in (0, 4) and model % 200 <> 0").select("model", (F.col("eid") + 10).alias("eid"), "v1", (F.col("v1") + 50).alias("v2"))
    return M.wire_order(e.unionByName(spur)).filter("eid < 10")


@query(sql("SELECT poly_id AS model, CAST(7 AS BIGINT) AS vertices, CAST(7 AS BIGINT) AS edges FROM rings GROUP BY poly_id"))
def msh30_collapse_small(spark: SparkSession, d: str) -> DataFrame:
    # Vertex 1 is moved close to vertex 0, which is fixed.
    v, e, _ = _ring_models(spark, d)
    zero = v.filter("vid = 0").select("model", F.col("x").alias("x0"), F.col("y").alias("y0"))
    v = v.join(zero, "model").select("model", "vid", F.when(F.col("vid") == 1, F.col("x0") + 0.01).otherwise(F.col("x")).alias("x"), F.when(F.col("vid") == 1, F.col("y0")).otherwise(F.col("y")).alias("y"))
    nv, ne = M.collapse_small(v, e, 0.1, v.filter("vid = 0").select("model", "vid"))
    return nv.groupBy("model").agg(F.count("*").alias("vertices")).join(ne.groupBy("model").agg(F.count("*").alias("edges")), "model")


@query(sql("SELECT poly_id AS model, CAST(2 - CASE WHEN poly_id % 300 = 0 THEN 1 ELSE 0 END AS BIGINT) AS areas FROM rings GROUP BY poly_id"))
def msh33_subarea_count(spark: SparkSession, d: str) -> DataFrame:
    v, e, h = _ring_models(spark, d)
    chord = e.filter("eid = 0").select("model", F.lit(8).cast("long").alias("eid"), F.lit(0).cast("long").alias("v1"), F.lit(4).cast("long").alias("v2"))
    return M.subareas(v, e.unionByName(chord), h).select("model", F.col("areas").cast("long").alias("areas"))


@query(sql("""WITH n AS (SELECT f.lo AS a, f.hi AS b FROM (SELECT DISTINCT lo, hi FROM mesh_face) f UNION ALL SELECT f.hi, f.lo FROM (SELECT DISTINCT lo, hi FROM mesh_face) f), d AS (SELECT a, (q.x-p.x)/l AS ux, (q.y-p.y)/l AS uy, ((2*q.x-q.y)-(2*p.x-p.y))/l AS s
    FROM (SELECT a, p, q, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) AS l FROM n JOIN mesh_node p ON p.nid = a JOIN mesh_node q ON q.nid = b)) SELECT a AS nid, 2.0::DOUBLE AS gx, -1.0::DOUBLE AS gy FROM d GROUP BY a HAVING sum(ux*ux)*sum(uy*uy)-sum(ux*uy)*sum(ux*uy) > 1e-6"""))
def msh32_local_derivative(spark: SparkSession, d: str) -> DataFrame:
    """Least-squares gradient of f = 2 x - y at each node from its neighbours, which is (2, -1) up to rounding."""
    from latticework.operators.mesh import edge_table

    e = edge_table(T.mesh_elem(spark, d))
    pairs = e.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(e.select(F.col("hi").alias("a"), F.col("lo").alias("b")))
    node = T.mesh_node(spark, d).withColumn("f", 2 * F.col("x") - F.col("y"))
    at = lambda k, s: node.select(F.col("nid").alias(k), *[F.col(c).alias(f"{c}{s}") for c in ("x", "y", "f")])
    p = pairs.join(at("a", 1), "a").join(at("b", 2), "b")
    ux, uy = G.unit_direction(G.point("x1", "y1"), G.point("x2", "y2"))
    slope = (F.col("f2") - F.col("f1")) / G.dist(G.point("x1", "y1"), G.point("x2", "y2"))
    s = p.select("a", ux.alias("u"), uy.alias("v"), slope.alias("s")).groupBy("a").agg(*[F.sum(F.expr(x)).alias(n) for n, x in (("uu", "u*u"), ("uv", "u*v"), ("vv", "v*v"), ("us", "u*s"), ("vs", "v*s"))])
    det = F.expr("uu*vv - uv*uv")
    return s.filter(det > 1e-6).select(F.col("a").alias("nid"), r6(F.expr("(vv*us - uv*vs)") / det).alias("gx"), r6(F.expr("(uu*vs - uv*us)") / det).alias("gy"))


@query()
def msh31_regularize(spark: SparkSession, d: str) -> DataFrame:
    """Each octagon's vertices moved towards their neighbours: (1 + 2 l) x - l (neighbours) = x, solved for all models at once."""
    v, e, _ = _ring_models(spark, d)
    lam = 0.5
    key = lambda c: F.col("model") * 8 + F.col(c)
    both = e.select(key("v1").alias("i"), key("v2").alias("j")).unionByName(e.select(key("v2").alias("i"), key("v1").alias("j")))
    off = both.select("i", "j", F.lit(-lam).alias("v"))
    m = T.stored_once(SP.added(off, both.groupBy("i").agg((1 + lam * F.count("*")).alias("v")).select("i", F.col("i").alias("j"), "v")))
    x, _, _ = SP.conjugate_gradient(m, v.select(key("vid").alias("i"), "x"), 1e-6)
    y, _, _ = SP.conjugate_gradient(m, v.select(key("vid").alias("i"), F.col("y").alias("x")), 1e-6)
    return x.join(y.select("i", F.col("x").alias("y")), "i").select(F.expr("i div 8").alias("model"), F.expr("i % 8").alias("vid"), r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query()
def set5_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the difference of all octagons with the same shifted by (2, 1), by kind of overlay."""
    r = T.rings(spark, d).select("poly_id", "seq", (F.col("x") + F.col("poly_id") * 1000).alias("x"), "y")
    moved = r.select("poly_id", "seq", (F.col("x") + 2.1).alias("x"), (F.col("y") + 1.3).alias("y"))
    out = None
    for kind in ("combination", "union", "intersection", "difference", "subtraction"):
        e = M.overlay(r, moved, kind, 3.0).agg(F.count("*").alias("edges"), F.round(F.sum(G.dist(G.point("x1", "y1"), G.point("x2", "y2"))), 3).alias("length")).withColumn("kind", F.lit(kind))
        out = e if out is None else out.unionByName(e)
    return out


# A square and a turned one around each of some events' points: what each kind of overlay has for one pair (vertices, edges, holes, subareas, area).
PAIR = {"combination": (16, 24, 0, 9, 5.0), "union": (16, 16, 0, 1, 5.0), "intersection": (8, 8, 0, 1, 3.5), "difference": (16, 24, 1, 8, 1.5), "subtraction": (12, 12, 0, 4, 0.5)}


@query(sql("SELECT kind, n * v AS vertices, n * e AS edges, n * h AS holes, n * s AS subareas, round(n * area, 3) AS area FROM (SELECT count(*) AS n FROM points_ev WHERE pid % 100 = 0), (VALUES " + ", ".join(f"('{k}', {v}, {e}, {h}, {s}, {a}::DOUBLE)" for k, (v, e, h, s, a) in PAIR.items()) + ") t(kind, v, e, h, s, area)"))
def set5_overlay_faces(spark: SparkSession, d: str) -> DataFrame:
    """Vertices, edges, holes and subareas of overlays, from the faces that their edges bound."""
    p = T.points_ev(spark, d).filter("pid % 100 = 0")
    # Pairs lie apart, each in a column of the plane of its own.
    shape = lambda corners: p.select("pid", "y", F.posexplode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in corners])).alias("seq", "c")).select(F.col("pid").alias("poly_id"), "seq", (F.col("pid") * 8 + F.col("c.dx")).alias("x"), (F.floor("y") + F.col("c.dy")).alias("y"))
    square, turned = shape([(1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0), (1.0, -1.0)]), shape([(0.0, 1.5), (-1.5, 0.0), (0.0, -1.5), (1.5, 0.0)])
    sides = M.overlay_sides(square, turned, 2.0)
    each = [M.overlaid(sides, kind).withColumn("grp", F.lit(kind)) for kind in M.KINDS]
    every = each[0]
    for more in each[1:]:
        every = every.unionByName(more)
    return FC.summary(T.stored_once(every)).select(F.col("grp").alias("kind"), "vertices", "edges", "holes", "subareas", F.round("area", 3).alias("area"))


@query(sql("""WITH a AS (SELECT poly_id, sum(x * y2 - y * x2) / 2 AS area FROM (SELECT poly_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY poly_id ORDER BY seq)) GROUP BY poly_id)
    SELECT poly_id AS model, CAST(2 AS BIGINT) AS subareas, round(area, 2) AS area FROM a"""))
def msh33_face_areas(spark: SparkSession, d: str) -> DataFrame:
    """Octagons cut in two by a chord: their bounded faces and the area of these."""
    v, e, _ = _ring_models(spark, d)
    chord = e.filter("eid = 0").select("model", F.lit(8).cast("long").alias("eid"), F.lit(0).cast("long").alias("v1"), F.lit(4).cast("long").alias("v2"))
    ends = M.edge_ends(v, e.unionByName(chord)).select(F.col("model").alias("grp"), "x1", "y1", "x2", "y2", F.lit(True).alias("left"), F.lit(True).alias("right"))
    bounded = FC.faces(ends).filter("area > 0").groupBy("grp").agg(F.count("*").alias("subareas"), F.sum("area").alias("area"))
    return bounded.select(F.col("grp").alias("model"), "subareas", F.round("area", 2).alias("area"))


@query()
def gra10_spectral_partition(spark: SparkSession, d: str) -> DataFrame:
    """Halves of the graph by the order of the second eigenvector of its Laplacian; the first half has the odd vertex. Two parts only: k > 2 isn't built."""
    e = T.stored_once(T.edges_sym(spark, d))
    degree = e.groupBy("src").agg(F.sum("w").alias("d"))
    n = degree.count()
    lap = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v")).unionByName(degree.select(F.col("src").alias("i"), F.col("src").alias("j"), F.col("d").alias("v")))
    _, q = SP.second_vector(lap)
    order = GR.ranked(q, [F.col("x"), F.col("i")])
    return order.select(F.col("i").alias("id"), (F.col("rank") >= (n + 1) // 2).cast("int").alias("part"))


CELL = "CAST(trunc(({0}) / 25.0) AS BIGINT)"


@query(sql(f"SELECT bx, b2 AS by, CAST(sum(delta) AS BIGINT) AS n FROM (SELECT {CELL.format('x')} AS bx, {CELL.format('y')} AS b2, 1 AS delta FROM points_ev UNION ALL SELECT {CELL.format('x')}, {CELL.format('y')}, -1 FROM points_ev WHERE pid % 7 = 0) GROUP BY bx, b2 HAVING sum(delta) > 0").replace("AS by,", 'AS "by",'))
def stm1_live_bin_counts(spark: SparkSession, d: str) -> DataFrame:
    from latticework.streaming.bins import live_bin_counts

    p = T.points_ev(spark, d).select("pid", "x", "y", F.lit(1).alias("delta"))
    changes = p.unionByName(p.filter("pid % 7 = 0").withColumn("delta", F.lit(-1)))
    path = _fresh(spark, "changes")
    changes.repartition(4).write.parquet(path)
    return live_bin_counts(spark, path, 25.0)


@query(sql("SELECT CAST(max(step) AS INTEGER) AS last, CAST(count(*) AS BIGINT) AS steps, CAST(max(step) - count(*) AS BIGINT) AS missing FROM (SELECT DISTINCT CAST(floor(x/24) AS INTEGER) + 1 AS step FROM points_ev WHERE CAST(floor(x/24) AS INTEGER) % 5 <> 3)"))
def stm2_arriving_steps(spark: SparkSession, d: str) -> DataFrame:
    from latticework.streaming.bins import arriving_steps

    path = _fresh(spark, "arriving")
    rows = _step_rows(spark, d).filter("(step - 1) % 5 <> 3")
    # A file for each step, so that no batch holds more of them than it takes files.
    X.steps_text(rows).select("value").write.option("maxRecordsPerFile", 1).text(path, lineSep="\u0001")
    return arriving_steps(spark, path, _fresh(spark, "steps"))

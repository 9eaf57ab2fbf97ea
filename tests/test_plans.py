"""What joins send where, and steps whose work must not outgrow the input."""

from latticework import jobs
from latticework.operators import mesh as M
from latticework.sources import tables as T

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_mesh_tables_are_not_sent_whole(spark):
    for name in ("agg7_elem_radius", "msh18_relative_error"):
        assert "Broadcast" not in planned(jobs.queries()[name](spark, SF)), name


def test_triangles_of_cells_are_those_of_elements_and_nodes(spark):
    joined = M.with_corners(T.mesh_elem(spark, SF), T.mesh_node(spark, SF))
    made = T.mesh_tri(spark, SF)
    assert sorted(map(tuple, made.select(*joined.columns).collect())) == sorted(map(tuple, joined.collect()))


def test_nearest_points_beyond_a_distance_and_by_density(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from latticework.operators import spatial as S

    rng = random.Random(5)
    rows = [(i, round(rng.uniform(-9, 9), 2), round(rng.uniform(-4, 4), 2)) for i in range(600)] + [(1000 + i, float(i % 5 - 2), float(i % 3 - 1)) for i in range(60)]
    points = spark.createDataFrame(rows, "pid long, x double, y double")
    queries = points.filter("pid % 9 = 0").select(F.col("pid").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))

    def brute(k: int, beyond: float) -> set:
        out = set()
        for q, qx, qy in rows:
            if q % 9 == 0:
                near = sorted((math.sqrt((x - qx) ** 2 + (y - qy) ** 2), p) for p, x, y in rows if p != q)
                near = [(d, p) for d, p in near if beyond <= 0 or d > beyond]
                out |= {(q, p, r) for r, (_, p) in enumerate(near[:k], 1)}
        return out

    for k, beyond in ((3, 0.0), (4, 2.0), (2, 5.0), (5, 15.0)):
        got = {(r.qid, r.pid, r["rank"]) for r in S.knn(queries, points, k, beyond=beyond).collect()}
        assert got == brute(k, beyond), (k, beyond)
    # A table of four times the points in the same box gets cells of half the size.
    box = (-9.0, -4.0, 9.0, 4.0)
    four = points.crossJoin(spark.range(4))
    assert abs(S.fitting_cell(points, box, 2, 1.0) / S.fitting_cell(four, box, 2, 1.0) - 2) < 1e-6


def test_points_in_polygons_whole_or_by_edge(spark):
    from latticework.operators import spatial as S

    points, rings = T.points_ev(spark, SF), T.rings(spark, SF)
    whole = S.points_in_polygons(points, rings, 3.0)
    assert "HashAggregate(keys=[pid" not in planned(whole)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, S.points_in_polygons(points, rings, 3.0, most=7).collect()))


def test_similar_rows_sum_products_as_they_meet_or_verify_candidates(spark, monkeypatch):
    from latticework.operators import sparse as SP

    m = SP.normalised(T.coo(spark, SF), 2)
    q = m.filter("i % 10 = 0").selectExpr("i as q", "j", "v")
    tidy = lambda df: sorted((r.q, r.i, r["rank"]) for r in df.collect())
    by_candidates = tidy(SP.similar_rows(m, q, 0.05, 10, direct=0))
    monkeypatch.setattr(SP, "similar_candidates", None)  # no pairs are listed beforehand where columns are rare
    assert tidy(SP.similar_rows(m, q, 0.05, 10)) == by_candidates


def test_a_step_text_is_not_copied_beside_its_rows(spark):
    from latticework.sources.textfiles import parse_steps

    text = "Step 1\nTime = 1.0\nField\nName = \"value\"\nSupport = \"Nodes\"\nData\n1.0 2.0\n3.0 4.0\nEnd Step\n"
    rows = parse_steps(spark.createDataFrame([(text,)], "value string"))
    assert [(r.id, r.comp, r.value) for r in rows.orderBy("id", "comp").collect()] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    generate = [line for line in planned(rows).splitlines() if "Generate posexplode(data" in line]
    assert generate and "f#" not in generate[0]


def test_segments_without_a_listed_pair(spark):
    """The first circles are told before pairs are listed: nothing but segments and points is written."""
    from latticework.operators import spatial as S

    names = []
    real = S.stored
    try:
        S.stored = lambda df, what="table", *a: (names.append(what), real(df, what, *a))[1]
        S.half_plane_candidates(T.segs(spark, SF).limit(50), T.points_ev(spark, SF), 2.0)
    finally:
        S.stored = real
    assert names and set(names) <= {"segments", "points", "hull", "lows"}


def test_elements_are_assembled_by_node_and_circles_meet_few_cells(spark, monkeypatch):
    from latticework.operators import spatial as S

    plan = planned(M.stiffness(T.mesh_tri(spark, SF), (2.0, 0.6, 0.7)))
    assert "hashpartitioning(n#" in plan and "hashpartitioning(i#" not in plan
    sizes, real = [], S.points_in_circles
    monkeypatch.setattr(S, "points_in_circles", lambda p, c, size, *a: (sizes.append(size), real(p, c, size, *a))[1])
    jobs.queries()["msh26_delaunay_check"](spark, SF)
    assert sizes[0] >= 3.0


def test_tasks_of_edges_follow_the_rows(spark, monkeypatch):
    """By their bytes shuffles would be given a few tasks that grow with the input."""
    rows = T.read(spark, SF, "lineitem").count()
    monkeypatch.setattr(T, "TASK_ROWS", 500)
    tasks = -(-rows // 500)
    assert tasks == T.edge_tasks(spark, SF) > 8
    for name, kept in (("agg14_degree", tasks), ("gra12_partition_balance", tasks), ("gra11_cut_quality", tasks), ("gra1_force_symmetry", 2 * tasks)):
        assert f", {kept}), REPARTITION_BY_NUM" in planned(jobs.queries()[name](spark, SF)), name

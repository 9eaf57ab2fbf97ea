"""Operators without SQL, against small loops, golden counts and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import graph as GR
from latticework.operators import models as M
from latticework.operators import ranking as R
from latticework.operators import sparse as SP
from latticework.operators import spatial as S
from latticework.operators.components import connected_components
from latticework.sources import textfiles as X


def square(spark, x, y, side, poly=0):
    return spark.createDataFrame([(poly, k, float(x + dx * side), float(y + dy * side)) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))], "poly_id long, seq int, x double, y double")


@pytest.mark.parametrize("kind, edges", [("combination", 12), ("union", 8), ("intersection", 4), ("difference", 12), ("subtraction", 6)])
def test_overlay_of_two_squares(spark, kind, edges):
    assert M.overlay(square(spark, 0, 0, 2), square(spark, 1, 1, 2), kind, 1.0).count() == edges


def test_overlay_of_squares_along_one_line(spark):
    a, b = square(spark, 0, 0, 2), square(spark, 2, 0.5, 1)
    union = M.overlay(a, b, "union", 1.0)
    assert union.count() == 8 and union.filter("x1 = 2 and x2 = 2 and y1 >= 0.5 and y2 <= 1.5").count() == 0
    assert M.overlay(a, b, "intersection", 1.0).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 5), (7, None)]
    rng.shuffle(edges)
    found = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(100, 160)} == {100} and found[200] == 200
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_matching_equals_the_one_by_one_order(spark):
    rng = random.Random(2)
    edges = {(a, b): float(rng.randint(1, 4)) for a in range(20) for b in range(a + 1, 20) if rng.random() < 0.3}
    free, expected = set(range(20)), set()
    for (a, b), w in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        if a in free and b in free:
            expected.add((a, b, w))
            free -= {a, b}
    got = GR.greedy_matching(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, w double"))
    assert {tuple(r) for r in got.collect()} == expected


def test_ranked_is_dense_over_ties(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "id long, v int")
    got = GR.ranked(df, [F.col("v"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(50)) and [(r["v"], r["id"]) for r in got] == sorted((k % 3, k) for k in range(50))


def test_knn_of_the_zig_zag(spark):
    pts = [(i, 0.5 * i * (1 if (i // 2 + 1) % 2 == 0 else -1), 0.5 * i * (1 if i // 2 % 2 else -1)) for i in range(100)]
    points = spark.createDataFrame(pts, "pid long, x double, y double")
    got = S.knn(spark.createDataFrame([(-1, 0.5, 0.5)], "qid long, qx double, qy double"), points, 10, 1.0).orderBy("rank").collect()
    exact = sorted(((x - 0.5) ** 2 + (y - 0.5) ** 2) ** 0.5 for _, x, y in pts)[:10]
    assert [r["dist"] for r in got] == pytest.approx(exact)
    far = S.knn(spark.createDataFrame([(-1, 0.5, 0.5)], "qid long, qx double, qy double"), points, 10, 1.0, keep=lambda d, p: d > 5)
    assert far.agg(F.min("dist")).first()[0] > 5
    assert S.knn(spark.createDataFrame([(0, 0.0, 0.0)], "qid long, qx double, qy double"), points.limit(0), 3, 1.0).count() == 0


def test_solvers(spark):
    n = 6
    rows = [(i, i, 3.0) for i in range(n)] + [(i, i + 1, -1.0) for i in range(n - 1)] + [(i + 1, i, -1.0) for i in range(n - 1)]
    m = spark.createDataFrame(rows, "i long, j long, v double")
    b = spark.createDataFrame([(i, float(i % 3)) for i in range(n)], "i long, x double")
    x, steps, residual = SP.conjugate_gradient(m, b, 1e-9)
    assert residual < 1e-9 and steps <= n
    off = SP.combined(SP.spmv(m, x), b, 1.0, -1.0)
    assert SP.dot(off, off) ** 0.5 < 1e-8
    import numpy as np

    a = np.zeros((n, n))
    for i, j, v in rows:
        a[i, j] = v
    eig = np.linalg.eigvalsh(a)
    assert SP.lanczos(m, n) == pytest.approx((eig[0], eig[-1]), abs=1e-6)
    assert SP.power_iteration(m, 1, 1e-3, 40)[0][0] == pytest.approx(eig[-1], abs=5e-2)


def test_lehmer_jumps(spark):
    state, states = 12345, []
    for _ in range(20):
        state = state * 16807 % (2**31 - 1)
        states.append(state)
    got = [r["s"] for r in spark.range(1, 21).select("id", R.lehmer(F.col("id"), 12345).alias("s")).orderBy("id").collect()]
    assert got == states


def test_collapse_keeps_corners(spark):
    wire = spark.createDataFrame([(1, k, float(k), 0.0) for k in range(10)] + [(1, 10, 9.0, 5.0)], "wire long, seq long, x double, y double")
    assert sorted(r["seq"] for r in R.collapse_collinear(wire, 1e-6).collect()) == [0, 9, 10]


def test_step_texts_round_trip(spark):
    rows = [(s, 0.5 * s, name, "Nodes", i, c, float(s * 100 + i * 10 + c)) for s in (1, 2) for name in ("u", "v") for i in range(3) for c in range(2)]
    fields = spark.createDataFrame(rows, "step int, time double, name string, support string, id long, comp int, value double")
    back = X.parse_steps(X.steps_text(fields).select("value"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_settings(spark):
    lines = spark.createDataFrame([("a = 1.5 # x",), ("b <- text // y",), ("# only a note",), ("",), (None,)], "line string")
    assert sorted(tuple(r) for r in X.settings(lines).collect()) == [("a", "1.5", 1.5), ("b", "text", None)]


def test_triangulation_has_empty_circles():
    import numpy as np

    from latticework.operators.triangulation import delaunay

    rng = np.random.default_rng(1)
    x, y = rng.random(120), rng.random(120)
    t = delaunay(x, y)
    for a, b, c in t:
        bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
        det = 2 * (bx * cy - by * cx)
        ux, uy = (cy * (bx**2 + by**2) - by * (cx**2 + cy**2)) / det, (bx * (cx**2 + cy**2) - cx * (bx**2 + by**2)) / det
        assert det > 0 and ((x - x[a] - ux) ** 2 + (y - y[a] - uy) ** 2 >= (ux**2 + uy**2) * (1 - 1e-9)).all()
    edges = {tuple(sorted(e)) for q in t.tolist() for e in zip(q, q[1:] + q[:1])}
    assert 120 - len(edges) + len(t) == 1  # vertices less edges plus triangles
    gx, gy = (v.ravel().astype(float) for v in np.meshgrid(np.arange(12) * 10, np.arange(12) * 10))
    assert len(delaunay(gx, gy)) == 2 * 11 * 11 and len(delaunay(gx[:2], gy[:2])) == 0


def test_second_vector_equals_a_dense_solver(spark, monkeypatch):
    import numpy as np

    from latticework.jobs import files

    rng = random.Random(4)
    # Two loose clusters of unequal degree, and a hub.
    edges = {(a, b): float(rng.randint(1, 3)) for a in range(41) for b in range(a + 1, 41) if rng.random() < (0.3 if (a < 20) == (b < 20) else 0.02)} | {(0, b): 2.0 for b in range(1, 20)} | {(20, b): 1.0 for b in range(21, 41)}
    dense = np.zeros((41, 41))
    for (a, b), w in edges.items():
        dense[a, b] = dense[b, a] = -w
    dense -= np.diag(dense.sum(axis=1))
    values, vectors = np.linalg.eigh(dense)
    assert values[1] > 1e-6
    both = spark.createDataFrame([(*e, w) for (a, b), w in edges.items() for e in ((a, b), (b, a))], "src long, dst long, w double")
    monkeypatch.setattr(files.T, "edges_sym", lambda s, d: both)
    part = {r["id"]: r["part"] for r in files.gra10_spectral_partition(spark, "").collect()}
    order = np.argsort(vectors[:, 1])
    one, other = set(order[:21].tolist()), set(order[20:].tolist())  # a vector and its negative are alike
    assert {k for k, p in part.items() if p == 0} in (one, other)


def test_hull_and_candidates_of_a_half_plane(spark):
    import numpy as np

    from latticework.operators import spatial as S

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=400) * 20, rng.normal(size=400) * 20
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(900, None, 1.0)], "pid long, x double, y double")
    corners = S.convex_hull(points.repartition(7), fan=2)
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    for p, q in zip(corners, np.roll(corners, -1, axis=0)):
        assert (((q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0])) >= -1e-9).all()
    assert all(turn(*t) > 0 for t in zip(corners, np.roll(corners, -1, axis=0), np.roll(corners, -2, axis=0)))
    # Short segments, some far outside, some with nothing on their left, one without length.
    ends = [(k, *(rng.normal(size=2) * 25), *(rng.normal(size=2) * 0.4)) for k in range(60)] + [(60, 0.0, 0.0, 0.0, 0.0), (61, 300.0, 0.0, 0.1, 0.0), (62, 300.0, 300.0, -0.1, 0.0), (63, 0.0, 500.0, 0.2, 0.0), (64, 0.0, -500.0, 0.2, 0.0)]
    segs = [(k, float(a), float(b), float(a + c), float(b + d)) for k, a, b, c, d in ends]
    expected, late = set(), 0
    for k, x1, y1, x2, y2 in segs:
        length = np.hypot(x2 - x1, y2 - y1)
        if not length:
            continue
        left = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 1.5e-8
        for layer in range(40_000):
            r = (1 + layer) * length
            h = np.sqrt(r * r - length * length / 4)
            cx, cy = (x1 + x2) / 2 - (y2 - y1) / length * h, (y1 + y2) / 2 + (x2 - x1) / length * h
            hit = np.flatnonzero(left & ((x - cx) ** 2 + (y - cy) ** 2 < r * r))
            if len(hit) or not left.any():
                expected |= {(k, int(i), layer) for i in hit}
                late += layer > 8
                break
    got = S.half_plane_candidates(spark.createDataFrame(segs, "sid long, x1 double, y1 double, x2 double, y2 double"), points, 2.0)
    assert {tuple(r) for r in got.collect()} == expected and late > 5
    assert S.half_plane_candidates(spark.createDataFrame(segs[60:61], "sid long, x1 double, y1 double, x2 double, y2 double"), points, 2.0).isEmpty()


def test_crossings_of_long_segments_by_the_cells_that_they_cross(spark):
    from latticework.operators import spatial as S

    rng = random.Random(12)
    segs = [(k, rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(-40, 40), rng.uniform(-40, 40)) for k in range(90)]
    segs += [(90, -30.0, -30.0, 30.0, 30.0), (91, -10.0, -10.0, 40.0, 40.0), (92, 5.0, -40.0, 5.0, 40.0), (93, -40.0, 2.0, 40.0, 2.0), (94, 5.0, -10.0, 5.0, 60.0), (95, 0.0, 0.0, -20.0, 10.0)]
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    expected = set()
    for i, *a in segs:
        for j, *b in segs:
            p, q, r, s = a[:2], a[2:], b[:2], b[2:]
            o = turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)
            if i < j and (o[0] * o[1] < 0 and o[2] * o[3] < 0 or (i, j) in {(90, 91), (92, 94)}):
                expected.add((i, j))
    table = spark.createDataFrame(segs, "sid long, x1 double, y1 double, x2 double, y2 double")
    for size in (1.0, 7.0):
        assert sorted((r.a, r.b) for r in S.crossing_pairs(table, size, walk=True).collect()) == sorted(expected) == sorted((r.a, r.b) for r in S.crossing_pairs(table, size).collect())
    # About 80 cells along a segment, where its box has 1,600.
    assert S.over_segment_cells(table, 1.0).count() < 120 * len(segs)


def test_smoothing_to_its_end(spark):
    """A grid of quadrilaterals with a segment across it and moved inner nodes, against a loop."""
    import numpy as np

    from latticework.operators import mesh as M

    rng = np.random.default_rng(4)
    n = 7
    number = lambda r, c: r * n + c
    x = {number(r, c): np.array([c, r], float) + (rng.normal(size=2) * 0.2 if 0 < r < n - 1 and 0 < c < n - 1 and r != 3 else 0) for r in range(n) for c in range(n)}
    elems = {r * n + c: [number(r, c), number(r, c + 1), number(r + 1, c + 1), number(r + 1, c)] for r in range(n - 1) for c in range(n - 1)}
    segment = [number(3, c) for c in range(n)]
    for k in segment[1:-1]:
        x[k][0] += rng.normal() * 0.1
    fixed = {number(r, c) for r in range(n) for c in range(n) if r in (0, n - 1) or c in (0, n - 1)}
    node = spark.createDataFrame([(k, float(p[0]), float(p[1])) for k, p in x.items()], "nid long, x double, y double")
    elem = spark.createDataFrame([(e, i, k) for e, ks in elems.items() for i, k in enumerate(ks)], "elem long, pos int, nid long")
    insgm = spark.createDataFrame([(0, i, k) for i, k in enumerate(segment)], "sgm long, seq long, nid long")
    got, rounds, moved = M.smoothed(node, elem, insgm, spark.createDataFrame([(k,) for k in fixed], "nid long"), 0.02)
    s1, u = x[segment[0]].copy(), x[segment[-1]] - x[segment[0]]
    u /= np.hypot(*u)
    expected = 0
    while True:
        centre = {e: np.mean([x[k] for k in ks], axis=0) for e, ks in elems.items()}
        new = {k: p if k in fixed else np.mean([centre[e] for e, ks in elems.items() if k in ks], axis=0) for k, p in x.items()}
        new |= {k: s1 + ((new[k] - s1) @ u) * u for k in segment if k not in fixed}
        far = max(np.hypot(*(new[k] - x[k])) for k in x)
        x, expected = new, expected + 1
        if far < 0.02:
            break
    assert rounds == expected and 1 < rounds < 50 and abs(moved - far) < 1e-9
    for r in got.collect():
        assert np.allclose([r.x, r.y], x[r.nid])
    assert M.smoothed(node, elem, insgm, node.select("nid"), 1e-9)[1:] == (1, 0.0)


def test_fixed_vertices_stay_on_straight_wires(spark):
    from latticework.operators import ranking as R

    rows = [(1, k, float(k), 0.0) for k in range(20)] + [(2, 0, 0.0, 0.0), (2, 1, 1.0, 1.0), (2, 2, 2.0, 0.0)]
    wires = spark.createDataFrame(rows, "wire long, seq long, x double, y double")
    fixed = spark.createDataFrame([(1, 7), (1, 8)], "wire long, seq long")
    found = lambda f: sorted((r.wire, r.seq) for r in R.collapse_collinear(wires, 1e-6, fixed=f).collect())
    assert found(None) == [(1, 0), (1, 19), (2, 0), (2, 1), (2, 2)]
    assert found(fixed) == [(1, 0), (1, 7), (1, 8), (1, 19), (2, 0), (2, 1), (2, 2)]

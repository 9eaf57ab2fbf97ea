"""Triangulations: the kernel against all points, and tiles against one group."""

import numpy as np
import pytest

from latticework.operators import triangulation as M


def is_delaunay(x, y):
    t, cloud = M.delaunay(x, y), M.Cloud(x, y, np.arange(len(x)))
    first = {}
    for k, p in enumerate(zip(x.tolist(), y.tolist())):
        first.setdefault(p, k)
    edges = set()
    for a, b, c in t.tolist():
        assert cloud.turn(a, b, c) > 0
        assert not any(cloud.inside(a, b, c, p) for p in first.values() if p not in (a, b, c))
        assert not edges & {(a, b), (b, c), (c, a)}
        edges |= {(a, b), (b, c), (c, a)}
    if len(t):
        assert len(t) == 2 * len(first) - 2 - sum((b, a) not in edges for a, b in edges)
    return len(t)


def test_kernel_on_scattered_gridded_and_round_points():
    rng = np.random.default_rng(1)
    for n in (3, 4, 5, 8, 20, 60):
        is_delaunay(rng.normal(size=n), rng.normal(size=n))
        is_delaunay(rng.integers(0, 6, n).astype(float), rng.integers(0, 6, n).astype(float))
    turn = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    assert is_delaunay(np.cos(turn), np.sin(turn)) == 38
    grid = np.array([(10.0 * i, 10.0 * j) for i in range(12) for j in range(12)])
    assert is_delaunay(grid[:, 0], grid[:, 1]) == 242
    assert is_delaunay(np.array([0.0, 1, 2, 3]), np.zeros(4)) == 0


def tiled(spark, x, y, grp, bound):
    rows = [(int(g), i, float(a), float(b)) for i, (g, a, b) in enumerate(zip(grp, x, y))]
    return {tuple(r) for r in M.triangulated(spark.createDataFrame(rows, "grp long, pid long, x double, y double"), "grp", bound).collect()}


def in_one(x, y, grp):
    found = set()
    for g in set(grp.tolist()):
        at = np.flatnonzero(grp == g)
        for t in M.delaunay(x[at], y[at], at).tolist():
            r = [int(at[i]) for i in t]
            k = r.index(min(r))
            found.add((g, *r[k:], *r[:k]))
    return found


@pytest.mark.parametrize("kind", ["dense", "grid"])
def test_tiles_give_what_one_group_gives(spark, kind):
    rng = np.random.default_rng(5)
    if kind == "dense":  # two sets, one with a third of its points in a thousandth of its width
        x, y = (np.r_[rng.normal(size=400), rng.normal(size=200) * 1e-3] for _ in "xy")
        grp = np.r_[np.zeros(350, int), np.ones(250, int)]
    else:
        x, y = (10.0 * v.ravel() for v in np.mgrid[0:16, 0:16])
        grp = np.zeros(256, int)
    assert tiled(spark, x, y, grp, 40) == in_one(x, y, grp)


def test_sets_without_triangles(spark):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 1.0, 1.0), (2, 3, 0.0, 0.0), (2, 4, 1.0, 1.0), (2, 5, 2.0, 2.0), (3, 6, 0.0, 0.0), (3, 7, 0.0, 0.0), (3, 8, 1.0, 0.0), (3, 9, 0.0, 1.0), (3, 10, None, 1.0), (None, 11, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "grp long, pid long, x double, y double")
    assert [tuple(r) for r in M.triangulated(df).collect()] == [(3, 6, 8, 9)]
    assert M.triangulated(df.limit(0)).count() == 0

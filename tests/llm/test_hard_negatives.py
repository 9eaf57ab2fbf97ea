"""Hard negatives against all pairs: spread and clustered vectors, ties, copies, odd rows, several rounds."""

import heapq

import numpy as np
import pytest

from latticework.llm import hard_negatives as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, la, va in kept:
        if a % 50:
            continue
        others = [(-score(va, v), i, label) for i, label, v in kept if i != a]
        for s, p, _ in heapq.nsmallest(5, [o for o in others if o[2] == la]):
            near = [o for o in others if o[2] != la and 50 * -s <= 100 * -o[0] <= 95 * -s]
            for rank, (t, n, _) in enumerate(heapq.nsmallest(3, near), 1):
                out.add((a, p, rank, n, -s, -t))
    return out


def found(spark, rows, schema=SCHEMA):
    return {tuple(r) for r in M.hard_negatives(spark.createDataFrame(rows, schema)).collect()}


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties"])
def test_against_all_pairs(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    n, d = 250, 8
    if kind == "spread":
        v = rng.normal(size=(n, d))
    elif kind == "clustered":
        v = rng.normal(size=(20, d))[rng.integers(0, 20, n)] + 0.02 * rng.normal(size=(n, d))
    else:
        v = rng.integers(-1, 2, size=(n, d)) / 4
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 4))) for i in range(n)]
    # Small cells, blocks and rounds, so that searches stop early and go on.
    for name, value in (("CELL_ROWS", 4), ("BLOCK_ROWS", 7), ("BATCH_ROWS", 3), ("FIRST_CELLS", 3), ("WIDER", 6)):
        monkeypatch.setattr(M, name, value)
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50 * k, [0.5, 0.25 * k, 0.1], k % 2) for k in range(6)] + [(k, [0.3, 0.1 * (k % 5), 0.2], k % 3) for k in range(1, 40) if k % 50]
    rows += [(100_050, None, 1), (100_051, [0.5, nan, 0.1], 1), (100_052, [inf, 0.1, 0.1], 0), (100_053, [0.5, None, 0.1], 0), (100_054, [0.5, 0.5, 0.5], None), (100_055, [0.5], 1), (100_056, [], 1), (100_057, [-0.5, -0.5, -0.5], 0)]
    rows += [(3, [0.3, 0.3, 0.2], 0), (3, [0.3, 0.3, 0.2], 0)]  # rows of one id are candidates each
    expected = {r[:2] + r[3:] for r in brute([(i, None if v is None else v + [0.0] * (3 - len(v)), label) for i, v, label in rows])}
    assert {r[:2] + r[3:] for r in found(spark, rows)} == expected
    clashing = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", id long, score long, query long")
    assert clashing.count() and {tuple(r) for r in M.hard_negatives(clashing).collect()} == found(spark, rows)
    assert M.hard_negatives(clashing.limit(0)).count() == 0
    assert found(spark, [(None, [1.0], 1), (50, [1.0], 1)]) == set()


def test_very_large_components_saturate(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 2), (2, [2e29, -3e30], 2), (50, [0.5, 0.5], 2), (51, [0.5, 0.25], 2), (52, [0.4, 0.25], 3)]
    assert all(abs(r[5]) < 1 << 62 for r in found(spark, rows))


def test_walk_visits_all_cells_by_falling_bounds():
    rng = np.random.default_rng(6)
    books = M.Codebooks([rng.normal(size=(6, 3)), rng.normal(size=(5, 3))], [rng.random(6), rng.random(5)], np.arange(30) % 7 != 0)
    walked = list(books.walk(rng.normal(size=6)))
    bounds = [b for b, _ in walked]
    assert sorted(c for _, c in walked) == [c for c in range(30) if c % 7] and bounds == sorted(bounds, reverse=True)


def test_a_bound_is_never_below_a_score():
    rng = np.random.default_rng(7)
    x, q = rng.integers(-300, 300, (500, 6)).astype(float), rng.integers(-300, 300, (20, 6)).astype(float)
    centres = [M.fitted(x[:, :3], 8), M.fitted(x[:, 3:], 8)]
    books = M.Codebooks(centres)
    (i, fi), (j, fj) = books.codes(x)
    books.radii = [np.array([far[c == k].max(initial=0) for k in range(len(m))]) for c, far, m in ((i, fi, centres[0]), (j, fj, centres[1]))]
    books.filled = np.ones(len(centres[0]) * len(centres[1]), bool)
    for v in q:
        bound = dict((c, b) for b, c in books.walk(v))
        assert all(bound[c] >= s for c, s in zip((i * len(centres[1]) + j).tolist(), x @ v))

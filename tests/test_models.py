"""Soundness codes of models that lie over one another."""

from latticework.operators import models as M

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
RING = [(0, 1), (1, 2), (2, 3), (3, 0)]


def test_each_code(spark):
    models = {
        0: (SQUARE, RING), 1: ([], RING), 2: (SQUARE, []),
        # Just on both sides of where a rounded coordinate changes.
        3: ([*SQUARE, (1.0000004999, 0.5), (1.0000005001, 0.5)], RING), 4: (SQUARE, [*RING, (1, 9)]), 5: (SQUARE, [*RING, (1, 0)]), 6: (SQUARE, [(0, 2), (1, 3)]), 7: ([*SQUARE, (0.5, 0.0)], RING),
        # The same square far away, and a vertex where another model has an edge.
        20: ([(x + 1e6, y) for x, y in SQUARE], RING), 21: ([(0.5, 0.0), (3.0, 3.0)], [(0, 1)]),
    }
    vertex = spark.createDataFrame([(m, k, x, y) for m, (v, _) in models.items() for k, (x, y) in enumerate(v)], "model long, vid long, x double, y double")
    edge = spark.createDataFrame([(m, k, a, b) for m, (_, e) in models.items() for k, (a, b) in enumerate(e)], "model long, eid long, v1 long, v2 long")
    found = {r["model"]: r["code"] for r in M.check(vertex, edge).collect()}
    assert found == {m: m if m < 10 else 0 for m in models}

"""Steps on tiles of a matrix: nothing but vectors is shuffled, and products and solvers are those of dense matrices."""

import random

import numpy as np

from latticework.operators import blocks as B
from latticework.operators import sparse as SP


def test_tiles_stay_where_they_are(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i * 1_000_003, j * 1_000_003, float(rng.randint(-4, 4))) for i in range(50) for j in range(50) if i == j or rng.random() < 0.2]
    monkeypatch.setattr(B, "ENTRIES", 20)  # many tiles
    tiles = B.Tiles(spark.createDataFrame([*rows, (1, 10**15, 7.0)], "i long, j long, v double"))
    assert tiles.side > 4
    plan = tiles.products(tiles.start, lambda s: s["i"] * 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(slot") == 1 and "Broadcast" not in plan
    state, (total,) = tiles.step(tiles.start, lambda s: s["i"] * 1.0, lambda s: ({"i": s["i"], "y": s["y"]}, [s["y"].sum()]), ["i", "y"])
    got = {r.i: r.y for r in tiles.rows(state, lambda s: {"y": s["y"]}).collect()}
    expected = dict.fromkeys({i for i, _, _ in rows} | {1}, 0.0)
    for i, j, v in rows:
        expected[i] += v * j
    assert got == expected and total == sum(expected.values())


def test_vectors_are_of_unit_length_and_orthogonal_even_if_not_settled(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(12)], "i long, j long, v double")
    values, vectors = SP.power_iteration(m, 2, 1e-12, 3)
    x, y = (np.array([r.x for r in v.orderBy("i").collect()]) for v in vectors)
    assert abs(x @ x - 1) < 1e-9 and abs(y @ y - 1) < 1e-9 and abs(x @ y) < 1e-9 and abs(x @ a @ x - values[0]) < 1e-9


def test_second_vector_of_a_graph_that_falls_apart(spark):
    from pyspark.sql import functions as F

    edges = [(a, b, 1.0) for k in (0, 10, 30) for a in range(k, k + 4) for b in range(a + 1, k + 4)]
    both = spark.createDataFrame([e for a, b, w in edges for e in ((a, b, -w), (b, a, -w))], "i long, j long, v double")
    lap = both.unionByName(both.groupBy("i").agg((-F.sum("v")).alias("v")).select("i", F.col("i").alias("j"), "v"))
    value, vector = SP.second_vector(lap)
    x = {r.i: r.x for r in vector.collect()}
    assert value == 0 and abs(sum(x.values())) < 1e-9 and abs(sum(v * v for v in x.values()) - 1) < 1e-9
    assert len({round(v, 9) for v in x.values()}) == 3 and all(x[a] == x[b] for a, b, _ in edges)

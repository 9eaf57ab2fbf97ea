"""Components by stretches of edges, against a loop; few vertices are left for the star steps where edges are near one another."""

import random

from pyspark.sql import functions as F

from latticework.operators import components as C


def test_stretches_leave_little_to_the_star_steps(spark, monkeypatch):
    rng = random.Random(7)
    # Paths across all stretches, a hub, random edges, loops, null ends.
    edges = [(k, k + 3) for k in range(3000)] + [(5000, k) for k in range(5001, 5400)] + [(rng.randint(6000, 6400), rng.randint(6000, 6400)) for _ in range(150)] + [(7000, 7000), (None, 7100), (3, None)]
    rng.shuffle(edges)
    monkeypatch.setattr(C, "STRETCH", 200)
    sizes, real = [], C.star_edges
    monkeypatch.setattr(C, "star_edges", lambda e, *a: (sizes.append(e.count()), real(e, *a))[1])
    root: dict = {}

    def find(v):
        root.setdefault(v, v)
        return v if root[v] == v else find(root[v])

    for a, b in edges:
        ends = [find(v) for v in (a, b) if v is not None]
        root[max(ends)] = min(ends)
    expected = {v: find(v) for v in root}
    table = spark.createDataFrame(edges, "src long, dst long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert dict(C.connected_components(table).collect()) == expected
        key = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(c) % 2).alias("h"), F.col(c).alias("k")))
        got = {r.id.k: r.component.k for r in C.connected_components(table.select(key("src").alias("src"), key("dst").alias("dst"))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sizes[0] < len(edges) / 8
    best: dict = {}
    for v, c in expected.items():
        best[c] = min(best.get(c, v), v, key=lambda k: (k % 2, k))
    assert got == {v: best[c] for v, c in expected.items()}

"""Similar rows by bounds against all pairs, with a column that every row has."""

import random

import numpy as np

from latticework.operators import sparse as S


def test_candidates_and_results_with_a_common_column(spark):
    rng = random.Random(3)
    n, width = 300, 400
    m = np.zeros((n, width))
    for i in range(n):
        m[i, 0] = 0.05 + 0.01 * rng.random()
        base = i % 60 if i < 180 else None  # rows in threes that are alike, the others on their own
        own = random.Random(base if base is not None else 1000 + i)
        for j in own.sample(range(1, width), 12):
            m[i, j] = own.random() * (1 if rng.random() < 0.9 else 0)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    entries = [(i, int(j), float(m[i, j])) for i in range(n) for j in np.flatnonzero(m[i])]
    rows = spark.createDataFrame(entries, "i long, j long, v double")
    queries = rows.filter("i % 5 = 0").selectExpr("i as q", "j", "v")
    least, most = 0.3, 4
    sim = m @ m.T
    expected = {}
    for q in range(0, n, 5):
        best = sorted((-sim[q, i], i) for i in range(n) if i != q and sim[q, i] >= least)[:most]
        expected |= {(q, i): rank for rank, (_, i) in enumerate(best, 1)}
    assert {(r.q, r.i): r["rank"] for r in S.similar_rows(rows, queries, least, most).collect()} == expected and len(expected) > 60
    # All 60 x 299 pairs share the common column; a small part of them is looked at.
    looked = S.similar_candidates(rows, queries, least).count()
    assert len([1 for q in range(0, n, 5) for i in range(n) if i != q and sim[q, i] >= least]) <= looked < 0.45 * 60 * 299

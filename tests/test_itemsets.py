"""Frequent itemsets against all subsets of all transactions."""

import random
from collections import Counter
from itertools import combinations

import numpy as np

from latticework.operators import itemsets as M


def counted(tx, least, most, longest, shortest):
    held = {}
    for t, i in tx:
        held.setdefault(t, set()).add(i)
    single = Counter(i for items in held.values() for i in items)
    kept = {i for i, n in single.items() if n >= least and (most is None or n <= most)}
    found, where = Counter(), {}
    for t, items in held.items():
        items = sorted(items & kept)
        for k in range(shortest, (longest or len(items)) + 1):
            for c in combinations(items, k):
                found[c] += 1
                where.setdefault(c, set()).add(t)
    return {c: n for c, n in found.items() if n >= least}, {(c, t) for c, ts in where.items() if len(ts) >= least for t in ts}


def test_lists_pack_and_meet():
    rng = np.random.default_rng(3)
    lists = [np.sort(rng.choice(65536, n, replace=False)) for n in (0, 1, 5, 4095, 4096, 30_000, 65536)]
    for a in lists:
        assert (M.unpacked(M.packed(a)) == a).all()
        for b in lists:
            assert M.shared(M.packed(a), M.packed(b)).tolist() == np.intersect1d(a, b).tolist()


def test_sets_of_all_lengths_with_bounds(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 16)
    rng = random.Random(7)
    tx = [(f"t{k}", item) for k in range(90) for item in "abcdefgh" if rng.random() < 0.15 + 0.1 * "abcdefgh".index(item)]
    df = spark.createDataFrame([*tx, *tx[:20], (None, "a"), ("t1", None)], "tid string, item string")
    for least, most, longest, shortest in ((5, None, None, 1), (3, 50, 4, 2), (20, None, 3, 3)):
        found = M.itemsets(df, least, most, longest, shortest)
        sets, where = counted(tx, least, most, longest, shortest)
        assert {tuple(r["items"]): r["support"] for r in found.sets.collect()} == sets
        assert {(tuple(r["items"]), r["tid"]) for r in found.transactions().collect()} == where
    assert M.itemsets(df.limit(0), 1).sets.isEmpty()


def test_fewer_rows_than_transactions_and_pairs(spark):
    rng = random.Random(8)
    tx = [(k, i) for k in range(2000) for i in rng.sample(range(12), 6)]
    found = M.itemsets(spark.createDataFrame(tx, "tid long, item long"), 100, longest=3)
    # 2,000 transactions have 30,000 pairs and 40,000 sets of three.
    assert found.stored_rows[0] == 12 and found.stored_rows[1] == 66 and found.stored_rows[2] <= 220

"""Order along wires and breadth-first order against loops."""

import random

from latticework.operators import graph as G
from latticework.operators import models as M
from latticework.operators.chains import places


def test_places_in_long_lists(spark):
    ids = list(range(700))
    random.Random(4).shuffle(ids)
    steps, expected, at = [], {}, 0
    for n in (1, 2, 37, 660):
        part = ids[at : at + n]
        at += n
        steps += list(zip(part, [*part[1:], None]))
        expected |= {i: (part[-1], n - 1 - k) for k, i in enumerate(part)}
    assert {r.id: (r.last, r.left) for r in places(spark.createDataFrame(steps, "id long, next long")).collect()} == expected


def test_order_along_wires(spark):
    rng = random.Random(6)
    edges, expected = [], {}

    def wire(model, vertices, eids):
        """vertices in the order of the walk; ends of open wires have a third edge's worth of neighbours or one only."""
        for k, (eid, a, b) in enumerate(zip(eids, vertices, vertices[1:])):
            forward = rng.random() < 0.5
            if vertices[0] == vertices[-1] and k == 0:
                forward = True  # a closed wire is walked along its least edge
            edges.append((model, eid, a, b) if forward else (model, eid, b, a))
            expected[model, eid] = (min(eids), k, forward)

    chain = list(range(1, 130))
    rng.shuffle(chain)
    if chain[0] > chain[-1]:
        chain.reverse()
    eids = list(range(500, 628))
    rng.shuffle(eids)
    wire(1, chain, eids)
    ring = list(range(200, 260))
    rest = list(range(701, 760))
    rng.shuffle(rest)
    wire(1, [*ring, ring[0]], [700, *rest])
    wire(2, [1, 2], [9])
    wire(2, [5, 5], [3])
    found = {(r.model, r.eid): (r.wire, r.place, r.forward) for r in M.wire_order(spark.createDataFrame(edges, "model long, eid long, v1 long, v2 long")).collect()}
    assert {k: v for k, v in found.items() if k != (2, 3)} == {k: v for k, v in expected.items() if k != (2, 3)}
    assert found[2, 3][:2] == (3, 0)


def test_breadth_first_order(spark):
    rng = random.Random(9)
    pairs = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(110)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    first = min(near)
    queue, seen = [(first, 0)], {first}
    for v, level in queue:
        for w in sorted(near[v] - seen):
            seen.add(w)
            queue.append((w, level + 1))
    edges = spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "src long, dst long")
    found = G.bfs_order(edges, spark.createDataFrame([(first,)], "id long")).collect()
    assert [(r.id, r.level) for r in sorted(found, key=lambda r: r.place)] == queue and sorted(r.place for r in found) == list(range(len(queue)))

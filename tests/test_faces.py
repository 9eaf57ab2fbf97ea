"""Faces of overlays of squares, and cycles of permutations."""

import random

from latticework.operators import faces as FC
from latticework.operators import models as M

RING = "poly_id long, seq int, x double, y double"
SQUARE = [(1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0), (1.0, -1.0)]


def rings(spark, *shapes):
    return spark.createDataFrame([(k, i, *p) for k, shape in enumerate(shapes) for i, p in enumerate(shape)], RING)


def test_cycles_have_their_least_id(spark):
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    lengths, at, steps, expected = [1, 2, 3, 50, 100, 144], 0, [], {}
    for n in lengths:
        part = ids[at : at + n]
        at += n
        steps += list(zip(part, part[1:] + part[:1]))
        expected |= {i: min(part) for i in part}
    assert {r.id: r.cycle for r in FC.cycles(spark.createDataFrame(steps, "id long, next long")).collect()} == expected


def test_faces_of_a_square_in_a_square(spark):
    """A ring between two squares is one subarea with a hole; the inner square's border has a cycle on either side."""
    from pyspark.sql import functions as F

    outer = [(3 * x, 3 * y) for x, y in SQUARE]
    sides = M.overlay_sides(rings(spark, outer), rings(spark, SQUARE), 2.0)
    got = {}
    for kind in M.KINDS:
        r = FC.summary(M.overlaid(sides, kind).withColumn("grp", F.lit(0))).first()
        got[kind] = (r.vertices, r.edges, r.holes, r.subareas, round(r.area, 6))
    assert got == {"combination": (8, 8, 0, 2, 36.0), "union": (4, 4, 0, 1, 36.0), "intersection": (4, 4, 0, 1, 4.0), "difference": (8, 8, 1, 1, 32.0), "subtraction": (8, 8, 1, 1, 32.0)}

"""Golden values of the expressions."""

import math

import pytest
from pyspark.sql import functions as F

from latticework.functions import geometry as G


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def p(x, y):
    return F.lit(float(x)), F.lit(float(y))


def test_unit_shapes(spark):
    a, b, c = p(0, 0), p(1, 0), p(1, 1)
    assert value(spark, G.dist(a, c)) == pytest.approx(math.sqrt(2))
    assert value(spark, G.dist2(a, c)) == pytest.approx(2)
    assert value(spark, G.orient(a, b, c)) == 1
    assert value(spark, G.delaunay_dist(a, b, c)) == pytest.approx(0.5)
    assert value(spark, G.delaunay_dist(p(0, 0), p(2, 0), p(1, 0.5))) < 0
    assert value(spark, G.circumradius(a, b, c)) == pytest.approx(math.sqrt(0.5))
    assert value(spark, G.angle_at(c, a, b)) == pytest.approx(math.pi / 4)
    assert value(spark, G.quality(p(0, 0), p(1, 0), p(0.5, math.sqrt(0.75)))) == pytest.approx(1)


def test_degenerate_is_null(spark):
    line = p(0, 0), p(1, 1), p(2, 2)
    assert value(spark, G.circumradius(*line)) is None
    assert value(spark, G.circumcenter(*line)[0]) is None
    assert value(spark, G.unit_direction(p(1, 1), p(1, 1))[0]) is None
    assert value(spark, G.center_from_segment(p(0, 0), p(2, 0), F.lit(0.5))[0]) is None


@pytest.mark.parametrize(
    "b, status",
    [((0.5, -1, 0.5, 1), "INTERSECTED"), ((0, 1, 1, 1), "PARALLEL"), ((0, -1, 0, 1), "ON_A1"), ((1, -1, 1, 1), "ON_A2"), ((0.5, 0, 0.5, 1), "ON_B1"), ((0.5, 1, 0.5, 0), "ON_B2"), ((2, -1, 2, 1), "NOT")],
)
def test_intersection_states(spark, b, status):
    assert value(spark, G.intersection(p(0, 0), p(1, 0), p(*b[:2]), p(*b[2:])))["status"] == status


@pytest.mark.parametrize("v, expected", [(0.0, 0), (0.5, 0), (1.0, 1), (-0.5, -1), (-1.0, -2), (-1.5, -2)])
def test_cells_of_negatives(spark, v, expected):
    assert value(spark, G.cell(F.lit(v), 1.0)) == expected


def test_in_circle(spark):
    a, b, c = p(0, 0), p(1, 0), p(1, 1)
    assert value(spark, G.in_circumcircle(a, b, c, p(0.5, 0.5))) and not value(spark, G.in_circumcircle(a, b, c, p(2, 2)))
    assert value(spark, G.cocircular(a, b, c, p(0, 1)))
    assert value(spark, G.in_diametral_circle(a, b, p(0.5, 0.1))) and not value(spark, G.in_diametral_circle(a, b, p(0.5, 0.6)))


def test_small_matrices(spark):
    m = [F.lit(float(v)) for v in (2, 0, 1, 0, 3, 0, 1, 0, 2)]
    assert value(spark, G.det3(m)) == pytest.approx(9)
    inv = [value(spark, c) for c in G.inverse3(m)]
    assert inv == pytest.approx([2 / 3, 0, -1 / 3, 0, 1 / 3, 0, -1 / 3, 0, 2 / 3])
    assert value(spark, G.eigenvalues2(*[F.lit(float(v)) for v in (0, 1, 1, 0)])[0]) == 1

"""Geometry of points, segments and triangles as column expressions.

Points are pairs of columns. Triangles are three points, counter-clockwise where a sign matters. Values that have no
definite result (a circle through collinear points, a unit vector of no length) are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = "tuple[Column, Column] | Named"
#: Tolerances of lengths, of squared lengths, of the in-circle test and of level sets (fixed values).
TOL, TOL2, CIRCLE_TOL, LEVEL_TOL = 1.5e-8, 2.25e-16, 1e-9, 1e-6


class Named:
    """A point by the names of its columns, which it looks up when used, so that it can be made without a session."""

    def __init__(self, x: str, y: str):
        self.names = x, y

    def __getitem__(self, k: int) -> Column:
        return F.col(self.names[k])

    def __iter__(self) -> Iterator[Column]:
        return (F.col(n) for n in self.names)


def point(x: str, y: str) -> Named:
    return Named(x, y)


def dist2(a: Point, b: Point) -> Column:
    return (a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])


def dist(a: Point, b: Point) -> Column:
    return F.sqrt(dist2(a, b))


def unit_direction(a: Point, b: Point) -> Point:
    d = dist(a, b)
    return F.try_divide(b[0] - a[0], d), F.try_divide(b[1] - a[1], d)


def orient(a: Point, b: Point, c: Point) -> Column:
    """Twice the signed area; positive if c lies left of a to b."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def half_side(a: Point, b: Point, c: Point) -> Column:
    return orient(a, b, c) >= TOL


def angle_at(a: Point, b: Point, c: Point) -> Column:
    """The angle at b from a to c, in 0 to 2 pi."""
    dot = (a[0] - b[0]) * (c[0] - b[0]) + (a[1] - b[1]) * (c[1] - b[1])
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, dist(a, b) * dist(c, b)))))
    return F.when(orient(a, b, c) <= 0, 2 * F.pi() - angle).otherwise(angle)


def tri_area(a: Point, b: Point, c: Point) -> Column:
    return 0.5 * orient(a, b, c)


def centroid(a: Point, b: Point, c: Point) -> Point:
    return (a[0] + b[0] + c[0]) / 3, (a[1] + b[1] + c[1]) / 3


def circumradius(a: Point, b: Point, c: Point) -> Column:
    return F.try_divide(dist(a, b) * dist(b, c) * dist(c, a), 2 * orient(a, b, c))


def circumcenter(a: Point, b: Point, c: Point) -> Point:
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    b2, c2, det = bx * bx + by * by, cx * cx + cy * cy, 2 * (bx * cy - by * cx)
    return a[0] + F.try_divide(cy * b2 - by * c2, det), a[1] + F.try_divide(bx * c2 - cx * b2, det)


def center_from_segment(a: Point, b: Point, r: Column) -> Point:
    """Centre left of a to b of a circle of radius r through both; null if r is too small."""
    half2 = dist2(a, b) / 4
    h = F.when(r * r >= half2, F.sqrt(r * r - half2))
    ux, uy = unit_direction(a, b)
    return (a[0] + b[0]) / 2 - uy * h, (a[1] + b[1]) / 2 + ux * h


def delaunay_dist(a: Point, b: Point, c: Point) -> Column:
    """Squared circumradius; negative if the centre and c lie on different sides of a to b."""
    center = circumcenter(a, b, c)
    r2 = dist2(center, a)
    return F.when(orient(a, b, center) * orient(a, b, c) < 0, -r2).otherwise(r2)


def min_edge(a: Point, b: Point, c: Point) -> Column:
    return F.least(dist(a, b), dist(b, c), dist(c, a))


def max_edge(a: Point, b: Point, c: Point) -> Column:
    return F.greatest(dist(a, b), dist(b, c), dist(c, a))


def radius_edge_ratio(a: Point, b: Point, c: Point) -> Column:
    return F.try_divide(circumradius(a, b, c), min_edge(a, b, c))


def min_angle(a: Point, b: Point, c: Point) -> Column:
    return F.asin(F.least(F.lit(1.0), F.try_divide(F.lit(1.0), 2 * radius_edge_ratio(a, b, c))))


def quality(a: Point, b: Point, c: Point) -> Column:
    """1 for an equilateral triangle."""
    return F.try_divide(F.lit(1.0), F.sqrt(F.lit(3.0)) * radius_edge_ratio(a, b, c))


def closest_on_segment(a: Point, b: Point, p: Point) -> Point:
    u = F.try_divide((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]), dist2(a, b))
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(u, F.lit(0.0))))
    return a[0] + u * (b[0] - a[0]), a[1] + u * (b[1] - a[1])


def intersection(a1: Point, a2: Point, b1: Point, b2: Point) -> Column:
    """struct(status, x, y) of two segments' lines: PARALLEL, ON_A1, ON_A2, ON_B1, ON_B2, INTERSECTED or NOT."""
    ax, ay, bx, by = a2[0] - a1[0], a2[1] - a1[1], b2[0] - b1[0], b2[1] - b1[1]
    det = ax * by - ay * bx
    t = F.try_divide((b1[0] - a1[0]) * by - (b1[1] - a1[1]) * bx, det)
    u = F.try_divide((b1[0] - a1[0]) * ay - (b1[1] - a1[1]) * ax, det)
    inside = lambda v: (v > 0) & (v < 1)
    x, y = a1[0] + t * ax, a1[1] + t * ay
    at = lambda p: (x - p[0]) * (x - p[0]) + (y - p[1]) * (y - p[1]) < TOL2
    closed = lambda v: (v >= -TOL) & (v <= 1 + TOL)
    status = (
        F.when(F.abs(det) < TOL, "PARALLEL")
        .when(at(a1) & closed(u), "ON_A1")
        .when(at(a2) & closed(u), "ON_A2")
        .when(at(b1) & closed(t), "ON_B1")
        .when(at(b2) & closed(t), "ON_B2")
        .when(inside(t) & inside(u), "INTERSECTED")
        .otherwise("NOT")
    )
    crosses = ~status.isin("PARALLEL", "NOT")
    return F.struct(status.alias("status"), F.when(crosses, x).alias("x"), F.when(crosses, y).alias("y"))


def segments_cross(a1: Point, a2: Point, b1: Point, b2: Point) -> Column:
    return intersection(a1, a2, b1, b2)["status"] == "INTERSECTED"


def segment_hits_triangle(p: Point, q: Point, a: Point, b: Point, c: Point) -> Column:
    return segments_cross(p, q, a, b) | segments_cross(p, q, b, c) | segments_cross(p, q, c, a)


def segment_hits_circle(p: Point, q: Point, center: Point, r: Column) -> Column:
    return r * r - dist2(closest_on_segment(p, q, center), center) > TOL


def level_set_hits(v1: Column, v2: Column, v3: Column, level: Column) -> Column:
    """Whether the level lies strictly between the corner values."""
    return (F.least(v1, v2, v3) < level - LEVEL_TOL) & (F.greatest(v1, v2, v3) > level + LEVEL_TOL)


def level_set_points(a: Point, b: Point, c: Point, v1: Column, v2: Column, v3: Column, level: Column) -> Column:
    """array of struct(x, y) where the level crosses the triangle's edges, in edge order."""

    def cut(p: Point, q: Point, vp: Column, vq: Column) -> Column:
        t = F.try_divide(level - vp, vq - vp)
        return F.when((F.least(vp, vq) < level) & (F.greatest(vp, vq) > level), F.struct((p[0] + t * (q[0] - p[0])).alias("x"), (p[1] + t * (q[1] - p[1])).alias("y")))

    return F.filter(F.array(cut(a, b, v1, v2), cut(b, c, v2, v3), cut(c, a, v3, v1)), lambda p: p.isNotNull())


def point_on_segment(a: Point, b: Point, p: Point, tol: float = TOL) -> Column:
    """Strictly inside the segment, off its line by less than tol."""
    u = F.try_divide((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]), dist2(a, b))
    return F.coalesce((F.abs(orient(a, b, p)) < tol * dist(a, b)) & (u > 0) & (u < 1), F.lit(False))


def point_in_triangle(a: Point, b: Point, c: Point, p: Point) -> Column:
    return (orient(a, b, p) > -TOL) & (orient(b, c, p) > -TOL) & (orient(c, a, p) > -TOL)


def point_in_box(p: Point, low: Point, high: Point) -> Column:
    return p[0].between(low[0], high[0]) & p[1].between(low[1], high[1])


def diametral_dot(a: Point, b: Point, p: Point) -> Column:
    return (a[0] - p[0]) * (b[0] - p[0]) + (a[1] - p[1]) * (b[1] - p[1])


def in_diametral_circle(a: Point, b: Point, p: Point, strict: bool = False) -> Column:
    return diametral_dot(a, b, p) < (-TOL if strict else TOL)


def in_circle_det(a: Point, b: Point, c: Point, p: Point) -> Column:
    """Positive if p lies inside the circle through a, b, c in counter-clockwise order."""
    ax, ay, bx, by, cx, cy = (v - p[k] for q in (a, b, c) for k, v in enumerate(q))
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx)


def in_circumcircle(a: Point, b: Point, c: Point, p: Point) -> Column:
    return in_circle_det(a, b, c, p) > CIRCLE_TOL


def cocircular(a: Point, b: Point, c: Point, p: Point) -> Column:
    return F.abs(in_circle_det(a, b, c, p)) <= CIRCLE_TOL


def cell(v: Column, size: float) -> Column:
    """The grid cell of a coordinate: negatives are shifted by one cell, then truncated."""
    return F.when(v < 0, F.ceil((v - size) / size)).otherwise(F.floor(v / size)).cast("long")


# One matrix or tensor per row.


def det2(a: Column, b: Column, c: Column, d: Column) -> Column:
    return a * d - b * c


def inverse2(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, ...]:
    det = det2(a, b, c, d)
    return F.try_divide(d, det), F.try_divide(-b, det), F.try_divide(-c, det), F.try_divide(a, det)


def eigenvalues2(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Real eigenvalues, the one of larger absolute value first; null if they are complex."""
    half, disc = (a + d) / 2, (a - d) * (a - d) / 4 + b * c
    root = F.when(disc >= 0, F.sqrt(disc))
    large = F.when(half >= 0, half + root).otherwise(half - root)
    return large, 2 * half - large


def det3(m: list[Column]) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse3(m: list[Column]) -> list[Column]:
    """Row by row, by cofactors; null if singular."""
    det = det3(m)
    minor = lambda r, c: reduce(lambda x, y: x - y, [m[3 * ((r + 1) % 3) + (c + 1) % 3] * m[3 * ((r + 2) % 3) + (c + 2) % 3], m[3 * ((r + 1) % 3) + (c + 2) % 3] * m[3 * ((r + 2) % 3) + (c + 1) % 3]])
    return [F.try_divide(minor(c, r), det) for r in range(3) for c in range(3)]


def von_mises(sxx: Column, syy: Column, sxy: Column) -> Column:
    return F.sqrt(sxx * sxx + syy * syy - sxx * syy + 3 * sxy * sxy)


def principal(sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column]:
    mean, radius = (sxx + syy) / 2, F.sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)
    return mean + radius, mean - radius


def elastic_matrix(e: Column, nu: Column, plane_strain: Column) -> tuple[Column, Column, Column]:
    """d11, d12, d33 of the plane material law."""
    stress = F.try_divide(e, 1 - nu * nu)
    strain = F.try_divide(e, (1 + nu) * (1 - 2 * nu))
    return F.when(plane_strain, strain * (1 - nu)).otherwise(stress), F.when(plane_strain, strain * nu).otherwise(stress * nu), e / (2 * (1 + nu))


def lame(e: Column, nu: Column) -> tuple[Column, Column]:
    return F.try_divide(e * nu, (1 + nu) * (1 - 2 * nu)), e / (2 * (1 + nu))


def stress(strain: tuple[Column, Column, Column], d: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return d[0] * strain[0] + d[1] * strain[1], d[1] * strain[0] + d[0] * strain[1], d[2] * strain[2]

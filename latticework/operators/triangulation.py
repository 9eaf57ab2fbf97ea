"""Delaunay triangulation of point sets of any size, tile by tile.

A round deals the open points to square tiles that hold no more than a bound of them, triangulates each tile together with a
halo, and keeps the triangles whose circle lies in the area that the tile has seen: no open point elsewhere can be in it. A point whose
triangles close around it is finished. Every triangle that is still missing has three open corners, and it has no open point in its circle, so
the next round needs the open points only, on larger tiles. What a later round finds where triangles were kept before is told by its
corner: there a kept triangle covers its direction. When a set's open points fit one tile, all that is left is found.

Points on one circle are triangulated as if each were moved by a vanishing amount that depends on its number only, so that
all tiles agree.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.sources.scratch import released, stored

#: Points of a tile at most, without its halo; the halo's width as a part of the tile's side.
BOUND, HALO = 1000, 0.5
CORNERS = "n1 long, n2 long, n3 long, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"


class Cloud:
    """Points in order of x and y with exact signs: of a turn, and of a point against a circle."""

    def __init__(self, x: np.ndarray, y: np.ndarray, number: np.ndarray):
        self.x, self.y, self.number = x.tolist(), y.tolist(), number.tolist()

    def turn(self, a: int, b: int, c: int) -> float:
        """Above zero where a, b, c turn left, zero where they lie on one line."""
        x, y = self.x, self.y
        left, right = (x[b] - x[a]) * (y[c] - y[a]), (y[b] - y[a]) * (x[c] - x[a])
        d = left - right
        if abs(d) > 4e-16 * (abs(left) + abs(right)):
            return d
        ax, ay, bx, by, cx, cy = map(Fraction, (x[a], y[a], x[b], y[b], x[c], y[c]))
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def inside(self, a: int, b: int, c: int, d: int) -> bool:
        """Whether d lies in the circle of the left-turning a, b, c; points on it are told apart by their numbers."""
        x, y = self.x, self.y
        dx, dy = x[d], y[d]
        ax, ay, bx, by, cx, cy = x[a] - dx, y[a] - dy, x[b] - dx, y[b] - dy, x[c] - dx, y[c] - dy
        aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        p, q, r = bx * cy - cx * by, cx * ay - ax * cy, ax * by - bx * ay
        det = aa * p + bb * q + cc * r
        size = aa * (abs(bx * cy) + abs(cx * by)) + bb * (abs(cx * ay) + abs(ax * cy)) + cc * (abs(ax * by) + abs(bx * ay))
        if abs(det) > 2e-15 * size:
            return det > 0
        fx, fy = [Fraction(x[k]) for k in (a, b, c, d)], [Fraction(y[k]) for k in (a, b, c, d)]
        u, v = [f - fx[3] for f in fx[:3]], [f - fy[3] for f in fy[:3]]
        w = [s * s + t * t for s, t in zip(u, v)]
        minors = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        exact = sum(s * t for s, t in zip(w, minors))
        if exact:
            return exact > 0
        # Lifts raised by vanishing amounts, the smallest number's the largest: its share in the determinant decides.
        share = {a: minors[0], b: minors[1], c: minors[2], d: -sum(minors)}
        return next(share[k] for k in sorted(share, key=self.number.__getitem__) if share[k]) > 0


def delaunay(x: np.ndarray, y: np.ndarray, number: np.ndarray | None = None) -> np.ndarray:
    """Counter-clockwise triangles as rows of three places; points from left to right join the hull, and edges flip until none is illegal.

    number tells points on one circle apart (their place if not given). Of points that repeat, the first place counts. Fewer than three
    points, or points on one line, give no triangles.
    """
    number = np.arange(len(x)) if number is None else number
    order = np.lexsort((number, y, x))
    first = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)][: len(order)]
    order = order[first]
    cloud, n = Cloud(x[order], y[order], number[order]), len(order)
    k = 2
    while k < n and cloud.turn(0, 1, k) == 0:
        k += 1
    if k >= n:
        return np.zeros((0, 3), np.int64)
    across: dict[tuple[int, int], int] = {}  # the third corner of the triangle to the left of an edge

    def add(a: int, b: int, c: int) -> None:
        across[a, b] = c
        across[b, c] = a
        across[c, a] = b

    def legalise(edges: list[tuple[int, int]]) -> None:
        while edges:
            a, b = edges.pop()
            c, d = across.get((a, b)), across.get((b, a))
            if c is None or d is None or not cloud.inside(a, b, c, d):
                continue
            del across[a, b], across[b, a]
            add(c, d, b)
            add(d, c, a)
            edges += [(a, d), (d, b), (b, c), (c, a)]

    # The first points lie on one line; the first beside it makes a fan with them.
    up = cloud.turn(0, 1, k) > 0
    chain = list(range(k)) if up else list(range(k - 1, -1, -1))
    after: dict[int, int] = {}
    before: dict[int, int] = {}
    ring = [*chain, k]
    for a, b in zip(chain, chain[1:]):
        add(a, b, k)
    for a, b in zip(ring, ring[1:] + ring[:1]):
        after[a], before[b] = b, a
    legalise([(a, b) for a, b in list(across)])
    for p in range(k + 1, n):
        edges, right = [], p - 1
        # The last point is on the hull; from there the new one sees a stretch on both sides.
        while cloud.turn(right, after[right], p) < 0:
            q = after[right]
            add(q, right, p)
            edges.append((q, right))
            right = q
        left = p - 1
        while cloud.turn(before[left], left, p) < 0:
            q = before[left]
            add(left, q, p)
            edges.append((left, q))
            left = q
        after[left], before[p], after[p], before[right] = p, left, right, p
        legalise(edges)
    rows = [(a, b, c) for (a, b), c in across.items() if a < b and a < c]
    return order[np.array(rows, np.int64).reshape(-1, 3)]


def circles(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, radius) of the circles of triangles."""
    ax, ay = x[t[:, 0]], y[t[:, 0]]
    bx, by, cx, cy = x[t[:, 1]] - ax, y[t[:, 1]] - ay, x[t[:, 2]] - ax, y[t[:, 2]] - ay
    with np.errstate(divide="ignore", invalid="ignore"):
        det = 2 * (bx * cy - by * cx)
        b2, c2 = bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (cy * b2 - by * c2) / det, (bx * c2 - cx * b2) / det
        return ax + ux, ay + uy, np.sqrt(ux * ux + uy * uy)


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """The triangles of one tile whose circles lie in what the tile has seen; beyond the set's own box there is nothing to see."""
    x, y, ids = (rows[c].to_numpy() for c in ("x", "y", "pid"))
    t = delaunay(x, y, ids)
    f = rows.iloc[0]
    if len(t) and not f["alone"]:
        cx, cy, r = circles(x, y, t)
        r = r * (1 + 1e-9)
        # A circle that leaves the set's box on one side needs to be seen on that side up to the box only.
        sure = np.ones(len(t), bool)
        for c, low, high, least, most in ((cx, f["tx1"], f["tx2"], f["bx1"], f["bx2"]), (cy, f["ty1"], f["ty2"], f["by1"], f["by2"])):
            sure &= (np.maximum(c - r, least) >= low) & (np.minimum(c + r, most) <= high)
        t = t[sure]
    columns = {f"n{k + 1}": ids[t[:, k]] for k in range(3)}
    columns |= {f"{c}{k + 1}": v[t[:, k]] for k in range(3) for c, v in (("x", x), ("y", y))}
    return pd.DataFrame({"grp": f["grp"], **columns})


def _dealt(points: DataFrame, bound: int) -> DataFrame:
    """points (grp, pid, x, y) with their set's box and the tile that holds them: level, ix, iy, side, alone where the set is one tile.

    Tiles begin with sides that would hold a quarter of the bound if points lay evenly; those that hold more are quartered twice a pass.
    """
    box = points.groupBy("grp").agg(F.count("*").alias("n"), *[f(c).alias(f"b{c}{k}") for c in "xy" for k, f in ((1, F.min), (2, F.max))])
    area = F.greatest((F.col("bx2") - F.col("bx1")) * (F.col("by2") - F.col("by1")), (F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")) / 1e3) ** 2)
    box = box.withColumn("alone", F.col("n") <= bound).withColumn("side0", F.sqrt(area * (bound / 4) / F.col("n")))
    now = stored(points.join(box.drop("n"), "grp").withColumn("level", F.lit(0)), "tiles")
    while True:
        tiled = now.withColumn("side", F.col("side0") / F.pow(F.lit(2.0), F.col("level")))
        at = lambda c: F.when(F.col("alone"), 0).otherwise(F.floor((F.col(c) - F.col(f"b{c}1")) / F.col("side"))).cast("long")
        tiled = tiled.withColumns({"ix": at("x"), "iy": at("y")})
        full = stored(tiled.filter("not alone").groupBy("grp", "level", "ix", "iy").agg(F.count("*").alias("held")).filter(F.col("held") > bound), "full-tiles")
        if full.isEmpty():
            released(full)
            return tiled
        quartered = tiled.join(full, ["grp", "level", "ix", "iy"], "left").withColumn("level", F.col("level") + F.when(F.col("held").isNotNull(), 2).otherwise(0)).select(*now.columns)
        before, now = now, stored(quartered, "tiles")
        for old in (before, full):
            released(old)


def _seen(tiled: DataFrame, bound: int) -> DataFrame:
    """The rows of each tile: its own points and those of its halo, with the box that it sees; a tile whose halo holds over three bounds has none."""
    tiles = tiled.groupBy("grp", "level", "ix", "iy").agg(F.first("side").alias("side"), F.first("alone").alias("alone"), *[F.first(f"b{c}{k}").alias(f"b{c}{k}") for c in "xy" for k in (1, 2)])
    levels = tiled.select("grp", "level", "side0").distinct().withColumn("s", F.col("side0") / F.pow(F.lit(2.0), F.col("level"))).select("grp", F.col("level").alias("l"), "s")
    # A point beside a tile of some level lies in that tile's halo if it does when moved by the halo's width.
    base = tiled.select("grp", "pid", "x", "y", "alone", "bx1", "by1", "level", "ix", "iy")
    moved = base.filter("not alone").join(levels, "grp").select("grp", "pid", "x", "y", F.col("level").alias("own"), F.col("ix").alias("own_x"), F.col("iy").alias("own_y"), "l", "s", "bx1", "by1")
    step = lambda c, sign: F.floor((F.col(c) - F.col(f"b{c}1") + sign * HALO * F.col("s")) / F.col("s"))
    spread = moved.select("grp", "pid", "x", "y", "own", "own_x", "own_y", F.col("l").alias("level"), F.explode(F.sequence(step("x", -1), step("x", 1))).alias("ix"), step("y", -1).alias("low"), step("y", 1).alias("high"))
    spread = spread.select("grp", "pid", "x", "y", "own", "own_x", "own_y", "level", "ix", F.explode(F.sequence("low", "high")).alias("iy")).filter("not (own = level and own_x = ix and own_y = iy)")
    halo = spread.select("grp", "level", "ix", "iy", "pid", "x", "y").join(tiles.select("grp", "level", "ix", "iy"), ["grp", "level", "ix", "iy"], "left_semi").withColumn("halo", F.lit(True))
    every = stored(tiled.select("grp", "level", "ix", "iy", "pid", "x", "y", F.lit(False).alias("halo")).unionByName(halo), "tile-points")
    wide = every.groupBy("grp", "level", "ix", "iy").agg((F.count("*") <= 4 * bound).alias("wide"))
    w = F.when(F.col("wide"), HALO).otherwise(0.0) * F.col("side")
    edge = lambda c, k: F.col(f"b{c}1") + (F.col(f"i{c}") + k) * F.col("side") + (w if k else -w)
    seen = every.join(tiles.join(wide, ["grp", "level", "ix", "iy"]), ["grp", "level", "ix", "iy"]).filter("wide or not halo")
    return seen.withColumns({f"t{c}{k + 1}": edge(c, k) for c in "xy" for k in (0, 1)})


def _corners(triangles: DataFrame) -> DataFrame:
    """(grp, v, xv, yv, a, xa, ya, b, xb, yb): each triangle's corners with the one before and the one after, counter-clockwise."""
    one = lambda k, m, n: F.struct(*[F.col(f"{s}{i}").alias(f"{d}{t}") for i, t in ((k, "v"), (m, "a"), (n, "b")) for s, d in (("n", "n"), ("x", "x"), ("y", "y"))])
    return triangles.select("grp", F.explode(F.array(one(1, 2, 3), one(2, 3, 1), one(3, 1, 2))).alias("c")).select("grp", F.col("c.nv").alias("v"), "c.xv", "c.yv", F.col("c.na").alias("a"), "c.xa", "c.ya", F.col("c.nb").alias("b"), "c.xb", "c.yb")


def _turn_at(v: str, a: str, mx: Column, my: Column) -> Column:
    """The turn from the ray of corner v to a towards the point (mx, my); one expression for both triangles at a ray."""
    return (F.col(f"x{a}") - F.col(f"x{v}")) * (my - F.col(f"y{v}")) - (F.col(f"y{a}") - F.col(f"y{v}")) * (mx - F.col(f"x{v}"))


def triangulated(points: DataFrame, key: str = "grp", bound: int = BOUND) -> DataFrame:
    """(grp, n1, n2, n3) of each set's points (grp, pid, x, y): counter-clockwise, n1 the smallest; sets of any number and size.

    Of points at one place the smallest pid counts; points with a null are left out; a set of fewer than three points or on one line has no
    triangles. No task holds more than four bounds of points of one tile. The bound doubles in a round after which over half of the open points stay open
    (sets with nearly all points on their hull); otherwise the rounds grow with the logarithm of the largest set.
    """
    open_ = points.select(F.col(key).cast("long").alias("grp"), F.col("pid").cast("long").alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    # Zero has one sign here.
    open_ = stored(open_.groupBy("grp", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.min("pid").alias("pid")), "open-points")
    found, fans, count = None, None, open_.count()
    schema = "grp long, " + CORNERS
    while count:
        tiled = _dealt(open_, bound)
        new = _seen(tiled, bound).groupBy("grp", "level", "ix", "iy").applyInPandas(_tile, schema)
        # The same triangle may be sure in several tiles.
        turn = lambda k: F.struct(*[F.col(f"{s}{(k + i) % 3 + 1}").alias(f"{s}{i + 1}") for i in range(3) for s in "nxy"])
        least = F.least("n1", "n2", "n3")
        new = new.select("grp", F.when(F.col("n1") == least, turn(0)).when(F.col("n2") == least, turn(1)).otherwise(turn(2)).alias("t")).select("grp", "t.*").dropDuplicates(["grp", "n1", "n2", "n3"])
        if fans is not None:
            mx, my = (F.col("x1") + F.col("x2") + F.col("x3")) / 3, (F.col("y1") + F.col("y2") + F.col("y3")) / 3
            fan = fans.select(F.col("grp").alias("of"), "v", "xv", "yv", "xa", "ya", "xb", "yb")
            covered = (F.col("grp") == F.col("of")) & (F.col("n1") == F.col("v")) & (_turn_at("v", "a", mx, my) >= 0) & (_turn_at("v", "b", mx, my) <= 0)
            new = new.join(fan, covered, "left_anti")
        new = stored(new, "triangles")
        found = new if found is None else found.unionByName(new)
        corners = _corners(new)
        corners = stored(corners if fans is None else corners.unionByName(fans), "corners")
        # Around a finished point each neighbour comes once before and once after.
        spokes = corners.select("grp", "v", F.col("a").alias("m"), F.lit(1).alias("s")).unionByName(corners.select("grp", "v", F.col("b").alias("m"), F.lit(-1).alias("s")))
        closed = spokes.groupBy("grp", "v", "m").agg(F.sum("s").alias("s")).groupBy("grp", "v").agg(F.max(F.abs("s")).alias("s")).filter("s = 0").select("grp", F.col("v").alias("pid"))
        # A set that was one tile is done.
        left = tiled.filter("not alone").select("grp", "pid", "x", "y").join(closed, ["grp", "pid"], "left_anti")
        before, open_ = open_, stored(left, "open-points")
        was, count = count, open_.count()
        old, fans = fans, stored(corners.join(open_.select("grp", F.col("pid").alias("v")), ["grp", "v"], "left_semi"), "fans")
        for done in (before, corners, *([old] if old is not None else [])):
            released(done)
        if 2 * count > was:
            bound *= 2
    if found is None:
        return points.sparkSession.createDataFrame([], f"{key} long, n1 long, n2 long, n3 long")
    return found.select(F.col("grp").alias(key), "n1", "n2", "n3")

"""Sparse matrices (i, j, v) and vectors (i, x) as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.operators.blocks import Tiles
from latticework.operators.components import connected_components
from latticework.operators.graph import ranked
from latticework.sources.scratch import stored


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def spmv(m: DataFrame, x: DataFrame) -> DataFrame:
    """(i, x): the product with x (i, x)."""
    return m.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def combined(x: DataFrame, y: DataFrame, a: float | Column = 1.0, b: float | Column = 1.0) -> DataFrame:
    """a x + b y; an entry that one side lacks is zero."""
    a, b = (c if isinstance(c, Column) else F.lit(c) for c in (a, b))
    both = x.select("i", (a * F.col("x")).alias("x")).unionByName(y.select("i", (b * F.col("x")).alias("x")))
    return both.groupBy("i").agg(F.sum("x").alias("x"))


def added(*matrices: DataFrame) -> DataFrame:
    """Entries at the same place are summed."""
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out.groupBy("i", "j").agg(F.sum("v").alias("v"))


def dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.select("i", F.col("x").alias("y")), "i").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0))).first()[0]


def asymmetry(m: DataFrame) -> DataFrame:
    """(norm): the root of the summed squares of a_ij - a_ji over pairs i > j, also where one of both is missing."""
    pair = m.filter("i <> j").select(F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b"), F.when(F.col("i") > F.col("j"), F.col("v")).otherwise(-F.col("v")).alias("v"))
    return pair.groupBy("a", "b").agg(F.sum("v").alias("d")).agg(F.coalesce(F.sqrt(F.sum(F.col("d") * F.col("d"))), F.lit(0.0)).alias("norm"))


def dirichlet(m: DataFrame, rhs: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matrix, rhs) with the unknowns fixed (i, value): identity rows and columns, and what they contribute moved to the right."""
    f = fixed.select(F.col("i").alias("f"), "value")
    moved = m.join(f, m.j == F.col("f")).select("i", (-F.col("v") * F.col("value")).alias("x"))
    free = rhs.unionByName(moved).join(fixed.select("i"), "i", "left_anti").groupBy("i").agg(F.sum("x").alias("x"))
    inner = m.join(fixed.select("i"), "i", "left_anti").join(fixed.select(F.col("i").alias("j")), "j", "left_anti").select("i", "j", "v")
    ones = fixed.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    return inner.unionByName(ones), free.unionByName(fixed.select("i", F.col("value").alias("x")))


def conjugate_gradient(m: DataFrame, b: DataFrame, tol: float = 1e-8, most_steps: int = 1000, jacobi: bool = True) -> tuple[DataFrame, int, float]:
    """(x, steps, residual) for a symmetric positive definite matrix, in tiles (see blocks.py). Vectors x, r, p are carried from step to step."""
    diagonal = m.filter("i = j").select("i", F.col("v").alias("diag"))
    tiles = Tiles(m, b.select("i", F.col("x").alias("b")).join(diagonal, "i"))
    state, step, alpha, beta = tiles.start, 0, 0.0, 0.0
    over = lambda s: s["diag"] if jacobi else 1.0
    rz, rr = tiles.summed(state, lambda s: [s["b"] @ (s["b"] / over(s)), s["b"] @ s["b"]])
    while step < most_steps and rr and rr**0.5 >= tol:
        # x and r of the last step are told from what it stored, so a vector is written once.
        def moved(s: dict, alpha: float = alpha, beta: float = beta) -> dict:
            if "p" not in s:
                return {"x": 0.0 * s["b"], "r": s["b"], "p": s["b"] / over(s)}
            r = s["r"] - alpha * s["q"]
            return {"x": s["x"] + alpha * s["p"], "r": r, "p": r / over(s) + beta * s["p"]}

        def then(s: dict, moved=moved) -> tuple[dict, list[float]]:
            new = moved(s) | {"i": s["i"], "diag": s["diag"], "q": s["y"]}
            return new, [new["p"] @ new["q"]]

        state, (pq,) = tiles.step(state, lambda s, moved=moved: moved(s)["p"], then, ["i", "diag", "x", "r", "p", "q"])
        alpha, was = rz / pq, rz

        def left(s: dict, alpha: float = alpha) -> list[float]:
            r = s["r"] - alpha * s["q"]
            return [r @ (r / over(s)), r @ r]

        rz, rr = tiles.summed(state, left)
        beta, step = rz / was, step + 1
    x = tiles.rows(state, lambda s: {"x": s["x"] + alpha * s["p"] if "p" in s else 0.0 * s["b"]})
    tiles.drop()
    return x, step, float(rr or 0.0) ** 0.5


def power_iteration(m: DataFrame, count: int, tol: float = 1e-6, most_steps: int = 300) -> tuple[list[float], list[DataFrame]]:
    """The count eigenvalues of largest absolute value of a symmetric matrix, with unit vectors; found ones are projected out. In tiles (see blocks.py)."""
    values: list[float] = []
    # Any starts that aren't orthogonal to the vectors sought; hashed signs with a lean.
    start = [(1.0 + F.pmod(F.xxhash64("i", F.lit(k)), F.lit(1000)) / 1000.0).alias(f"s{k}") for k in range(count)]
    tiles = Tiles(m, m.select("i").distinct().select("i", *start))
    state = tiles.start
    for k in range(count):
        found, later = [f"v{j}" for j in range(k)], [f"s{j}" for j in range(k + 1, count)]
        source, value = f"s{k}", 0.0
        dots = lambda s, x: [x @ x, *[x @ s[v] for v in found]]
        sums = tiles.summed(state, lambda s, source=source: dots(s, s[source]))
        for _ in range(most_steps):
            along = sums[-k:] if k else np.zeros(0)
            norm = max(sums[-1 - k] - along @ along, 0.0) ** 0.5

            def unit(s: dict, source: str = source, along: np.ndarray = along, norm: float = norm) -> np.ndarray:
                return (s[source] - sum(a * s[v] for a, v in zip(along, found))) / norm

            def then(s: dict, unit=unit, near: float = value) -> tuple[dict, list[float]]:
                q, y = unit(s), s["y"]
                off = y - near * q
                return s | {"q": q, "w": y}, [y @ q, off @ off, *dots(s, y)]

            state, sums = tiles.step(state, unit, then, ["i", *found, "q", "w", *later])
            source, before, value = "w", value, float(sums[0])
            along = sums[-k:] if k else np.zeros(0)
            # ||y - value q|| from the sum at the value before, less what lies along found vectors.
            off = max(sums[1] - (value - before) ** 2 - along @ along, 0.0) ** 0.5
            if off < tol * max(1.0, abs(value)):
                break
        values.append(value)
        if k + 1 < count:
            state = _renamed(state, {"q": f"v{k}"}, [*found, *later])
    vectors = [tiles.rows(state, lambda s, v=v: {"x": s[v]}) for v in [f"v{j}" for j in range(count - 1)] + ["q"]]
    tiles.drop()
    return values, vectors


def _renamed(state: DataFrame, names: dict[str, str], others: list[str]) -> DataFrame:
    return stored(state.select("block", "i", *others, *[F.col(a).alias(b) for a, b in names.items()], "sums"), "vectors")


def lanczos(m: DataFrame, steps: int) -> tuple[float, float]:
    """The least and the largest eigenvalue of a symmetric matrix, from steps of Lanczos' recurrence with full reorthogonalisation. In tiles (see blocks.py)."""
    tiles = Tiles(m, m.select("i").distinct().select("i", (1.0 + F.pmod(F.xxhash64("i"), F.lit(1000)) / 1000.0).alias("w")))
    state, alpha, beta = tiles.start, [], []
    norm = tiles.summed(state, lambda s: [s["w"] @ s["w"]])[0] ** 0.5
    rest = lambda s, along: s["w"] - sum(a * s[f"q{j}"] for j, a in enumerate(along))
    along = np.zeros(0)
    for k in range(steps):
        basis = [f"q{j}" for j in range(k + 1)]
        new = lambda s, along=along, norm=norm: rest(s, along) / norm

        def then(s: dict, new=new, k: int = k, basis: list[str] = basis) -> tuple[dict, list[float]]:
            s = s | {f"q{k}": new(s), "w": s["y"]}
            return s, [s["w"] @ s[b] for b in basis]

        state, once = tiles.step(state, new, then, ["i", *basis, "w"])
        alpha.append(float(once[k]))
        # Twice is enough.
        *again, size = tiles.summed(state, lambda s, once=once, basis=basis: (lambda w: [*[w @ s[b] for b in basis], w @ w])(rest(s, once)))
        along = once + np.array(again)
        norm = max(size - np.dot(again, again), 0.0) ** 0.5
        if norm < 1e-10:
            break
        beta.append(norm)
    tiles.drop()
    n = len(alpha)
    # As many numbers as steps.
    ends = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[: n - 1], 1) + np.diag(beta[: n - 1], -1))
    return float(ends[0]), float(ends[-1])


def second_vector(lap: DataFrame, tol: float = 1e-4, most_steps: int = 1200) -> tuple[float, DataFrame]:
    """(value, unit vector) of the least eigenvalue of a graph's Laplacian on the vectors that sum to zero.

    A locally optimal conjugate gradient step (vector, residual over the diagonal, last direction) until the residual ||L x - value x|| is at most tol
    times the value; raises where it isn't reached. A step is one product in tiles (see blocks.py); sums of three vectors' products reach the driver.
    Where the graph falls apart, the value is zero and the vector is constant on each component, another for each.
    """
    m = stored(lap, "laplacian")
    diagonal = m.filter("i = j").select("i", F.col("v").alias("diag"))
    n = diagonal.count()
    if n < 2:
        raise ValueError("a graph of one vertex has no second vector")
    parts = stored(connected_components(m.filter("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"))), "components")
    parts = diagonal.select("i").join(parts, F.col("i") == F.col("id"), "left").select("i", F.coalesce("component", "i").alias("component"))
    held = stored(parts.groupBy("component").count(), "components")
    if held.count() > 1:
        places = ranked(held, [F.col("component")]).select("component", F.col("rank").cast("double").alias("x"), "count")
        mean, square = places.agg(F.sum(F.col("x") * F.col("count")) / n, F.sum(F.col("x") * F.col("x") * F.col("count"))).first()
        size = (square - n * mean * mean) ** 0.5
        return 0.0, stored(parts.join(places, "component").select("i", ((F.col("x") - mean) / size).alias("x")), "second")
    tiles = Tiles(m, diagonal.withColumn("s", F.pmod(F.xxhash64("i"), F.lit(1_000_003)) / 1_000_003.0 - 0.5))
    state, mixed = tiles.start, None
    for _ in range(most_steps):

        def now(s: dict, mixed=mixed) -> dict:
            """The vectors of this step: x and p of those of the last, w the residual over the diagonal."""
            if mixed is None:
                return {"w": s["s"]}
            value, weights, mean = mixed
            names = [c for c in ("x", "w", "p") if c in s]
            x, ax = (sum(a * s[k + c] for a, c in zip(weights, names)) for k in ("", "a"))
            p, ap = (sum(a * s[k + c] for a, c in zip(weights, names) if c != "x") for k in ("", "a"))
            x = x - mean
            new = {"x": x, "ax": ax, "w": (ax - value * x) / s["diag"]}
            return new | ({"p": p, "ap": ap} if "x" in s else {})

        def then(s: dict, now=now) -> tuple[dict, list[float]]:
            new = now(s) | {"aw": s["y"]}
            names = [c for c in ("x", "w", "p") if c in new]
            sums = [np.sum(new[c]) for c in names] + [new[a] @ new[k + b] for k in ("", "a") for a in names for b in names]
            return new | {"i": s["i"], "diag": s["diag"]}, sums

        have = ["w"] if mixed is None else ["x", "w"] if "x" not in state.columns else ["x", "w", "p"]
        state, sums = tiles.step(state, lambda s, now=now: now(s)["w"], then, ["i", "diag", *have, *[f"a{c}" for c in have]])
        k = len(have)
        mean, gram, image = sums[:k] / n, sums[k : k + k * k].reshape(k, k), sums[k + k * k :].reshape(k, k)
        gram = gram - n * np.outer(mean, mean)
        scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
        gram, image = (a * scale[:, None] * scale for a in (gram, (image + image.T) / 2))
        sizes, axes = np.linalg.eigh(gram)
        axes = axes[:, sizes > 1e-13 * sizes[-1]] / np.sqrt(sizes[sizes > 1e-13 * sizes[-1]])
        values, vectors = np.linalg.eigh(axes.T @ image @ axes)
        value, weights = float(values[0]), scale * (axes @ vectors[:, 0])
        mixed = value, weights, float(mean @ weights)

        def best(s: dict, mixed=mixed, have=have) -> tuple[np.ndarray, np.ndarray]:
            x, ax = (sum(a * s[k + c] for a, c in zip(mixed[1], have)) for k in ("", "a"))
            return x - mixed[2], ax

        off = tiles.summed(state, lambda s, best=best, value=value: (lambda x, ax: [np.sum((ax - value * x) ** 2)])(*best(s)))[0] ** 0.5
        if off <= tol * max(value, 1e-6):
            found = tiles.rows(state, lambda s: {"x": best(s)[0]})
            tiles.drop()
            return value, found
    raise RuntimeError(f"the second vector's residual is {off:.3g} at value {value:.3g} after {most_steps} steps")


def jacobi_sweeps(m: DataFrame, b: DataFrame, sweeps: int) -> DataFrame:
    """(i, x) after sweeps from zero."""
    diagonal = m.filter("i = j").select("i", F.col("v").alias("diag"))
    x = b.select("i", F.lit(0.0).alias("x"))
    for _ in range(sweeps):
        off = spmv(m.filter("i <> j"), x).select("i", F.col("x").alias("s"))
        x = stored(b.join(diagonal, "i").join(off, "i", "left").select("i", ((F.col("x") - F.coalesce("s", F.lit(0.0))) / F.col("diag")).alias("x")), "jacobi")
    return x


# Rows as sparse documents.


def normalised(m: DataFrame, norm: int = 2) -> DataFrame:
    """Rows divided by their sum or Euclidean length; rows whose sum isn't positive stay."""
    total = F.sum(F.col("v") * F.col("v") if norm == 2 else F.col("v")).over(W.partitionBy("i"))
    return m.select("i", "j", F.when(total > 0, F.col("v") / (F.sqrt(total) if norm == 2 else total)).otherwise(F.col("v")).alias("v"))


def scaled(m: DataFrame, kind: str, n_rows: int) -> DataFrame:
    """Values by one of the usual term weightings; n_rows counts empty rows too."""
    v, top = F.col("v"), F.max(F.abs("v")).over(W.partitionBy("i"))
    power = {"SQRT": 0.5, "POW25": 0.25, "POW65": 0.65, "POW75": 0.75, "POW85": 0.85}
    if kind in power:
        return m.select("i", "j", (F.signum(v) * (0.1 + F.pow(F.abs(v), power[kind]))).alias("v"))
    if kind == "MAXTF":
        return m.select("i", "j", (0.5 + 0.5 * v / top).alias("v"))
    if kind == "MAXTF2":
        return m.select("i", "j", (0.1 + 0.9 * v / top).alias("v"))
    if kind == "LOG":
        return m.select("i", "j", (F.signum(v) * (1 + F.log2(F.abs(v)))).alias("v"))
    df = m.groupBy("j").agg(F.count("*").alias("df"))
    if kind == "IDF":
        return m.join(df, "j").select("i", "j", (v * F.log(n_rows / F.col("df"))).alias("v"))
    if kind == "IDF2":
        size = m.agg(F.greatest(F.lit(10.0), F.floor(0.5 * F.count("*") / F.count_distinct("j"))).alias("b"))
        return m.join(df, "j").join(F.broadcast(size), F.lit(True)).select("i", "j", (v * F.log((n_rows + 2 * F.col("b")) / (F.col("b") + F.col("df")))).alias("v"))
    raise ValueError(kind)


def low_filter(m: DataFrame, norm: int, fraction: float) -> DataFrame:
    """Each row's largest entries, as long as the sum before an entry is at most fraction of the row's."""
    size = F.abs("v") if norm == 1 else F.col("v") * F.col("v")
    w = W.partitionBy("i").orderBy(size.desc(), "j")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return m.select("i", "j", "v", before.alias("before"), F.sum(size).over(W.partitionBy("i")).alias("total")).filter(F.col("before") <= fraction * F.col("total")).select("i", "j", "v")


def nth_largest(v: DataFrame, n: int) -> DataFrame:
    """(i, x): the n-th largest entry of a vector (i, x), ties by smaller i; none where there are fewer."""
    top = v.orderBy(F.desc("x"), "i").limit(n).select("i", "x")
    return top.orderBy("x", F.desc("i")).limit(1).join(top.agg(F.count("*").alias("k")).filter(F.col("k") == n), F.lit(True)).select("i", "x")


def topk_plus(m: DataFrame, k: int, keep: float) -> DataFrame:
    """Each row's k largest entries and all others of at least keep."""
    place = F.row_number().over(W.partitionBy("i").orderBy(F.desc("v"), "j"))
    return m.withColumn("place", place).filter((F.col("place") <= k) | (F.col("v") >= keep)).select("i", "j", "v")


def zscore_filter(m: DataFrame, zscore: float) -> DataFrame:
    n = F.count("*").over(W.partitionBy("i"))
    return m.withColumn("n", n).filter(F.col("v") > zscore / F.col("n")).select("i", "j", "v")


def compacted(m: DataFrame) -> DataFrame:
    """Columns renumbered from 0 by falling count, then by number; the order is that of the distinct columns only."""
    from latticework.operators.graph import ranked

    counts = m.groupBy("j").agg(F.count("*").alias("n"))
    new = ranked(counts, [F.desc("n"), F.col("j")]).select("j", F.col("rank").alias("new"))
    return m.join(new, "j").select("i", F.col("new").alias("j"), "v")


def similarity(m: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """pairs (a, b) with sim of rows a and b: COS, JAC (Tanimoto), MIN or AMIN; rows without a common column have 0."""
    both = pairs.join(m.select(F.col("i").alias("a"), "j", F.col("v").alias("va")), "a").join(m.select(F.col("i").alias("b"), "j", F.col("v").alias("vb")), ["b", "j"])
    met = both.groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"), F.sum(F.least("va", "vb")).alias("least"))
    size = m.groupBy("i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    of = pairs.join(met, ["a", "b"], "left").join(size.select(F.col("i").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")), "a").join(size.select(F.col("i").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb")), "b")
    value = {
        "COS": F.col("dot") / F.sqrt(F.col("qa") * F.col("qb")),
        "JAC": F.col("dot") / (F.col("qa") + F.col("qb") - F.col("dot")),
        "MIN": F.col("least") / (F.col("sa") + F.col("sb") - F.col("least")),
        "AMIN": F.col("least") / F.col("sa"),
    }[kind]
    return of.select("a", "b", F.coalesce(value, F.lit(0.0)).alias("sim"))


def _after_prefix(rows: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """rows (key, j, value, n, most) without each row's leading columns, the commonest first, whose products can't reach least.

    What those columns add is at most the sum of |value| times most, the other side's largest of that column, and at most
    the length of that part of the row where the other side's rows have length 1.
    """
    so_far = W.partitionBy(key).orderBy(F.desc("n"), "j")
    reach = F.least(F.sum(F.abs(value) * F.col("most")).over(so_far), F.sqrt(F.sum(F.col(value) * F.col(value)).over(so_far)))
    return rows.withColumn("reach", reach).filter(F.col("reach") >= least - 1e-9).select(key, "j", value)


def similar_candidates(m: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(q, i): pairs of unit rows that may have a dot product of least or more; the others surely haven't.

    Columns have one order, the commonest first, and a row's leading part that can't reach least by itself is left out on both sides. Of two such parts
    the longer has all that the rows share before its end, so a pair above least shares a column after both. A column that nearly all
    rows have comes first and is rarely met under.
    """
    sizes = m.groupBy("j").agg(F.count("*").alias("n"), F.max(F.abs("v")).alias("most_v"))
    asked = queries.groupBy("j").agg(F.max(F.abs("v")).alias("most_q"))
    both = stored(sizes.join(asked, "j"), "columns")
    index = _after_prefix(m.join(both.select("j", "n", F.col("most_q").alias("most")), "j"), "i", "v", least)
    probes = _after_prefix(queries.join(both.select("j", "n", F.col("most_v").alias("most")), "j"), "q", "v", least)
    return probes.select("q", "j").join(index.select("i", "j"), "j").filter("q <> i").select("q", "i").distinct()


def similar_rows(m: DataFrame, queries: DataFrame, least: float, most: int, direct: int = 64) -> DataFrame:
    """(q, i, sim, rank): for each query row (q, j, v) the most similar unit rows by dot product of at least least, which is above zero; ties by i.

    Where columns are rare, so that rows meet no more than direct times the entries, products are summed as they meet. Else candidates meet under their rarer
    columns only and are verified on whole rows.
    """
    sizes = m.groupBy("j").agg(F.count("*").alias("n")).join(queries.groupBy("j").agg(F.count("*").alias("asked")), "j")
    entries, meets = sizes.agg(F.sum("n"), F.sum(F.col("n") * F.col("asked"))).first()
    if (meets or 0) <= direct * (entries or 0):
        met = m.join(queries.select("q", "j", F.col("v").alias("qv")), "j").filter("q <> i")
    else:
        pairs = stored(similar_candidates(m, queries, least), "candidates")
        met = pairs.join(m, "i").join(queries.select("q", "j", F.col("v").alias("qv")), ["q", "j"])
    dots = met.groupBy("q", "i").agg(F.sum(F.col("qv") * F.col("v")).alias("sim")).filter(F.col("sim") >= least)
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "i"))
    return dots.withColumn("rank", place).filter(F.col("rank") <= most)


def density_map(m: DataFrame, n: int, plot: int) -> DataFrame:
    """(r, c, share): stored entries per block of an n x n matrix, divided by those of the fullest block."""
    side = n / plot
    counts = m.groupBy(F.floor(F.col("i") / side).alias("r"), F.floor(F.col("j") / side).alias("c")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), F.lit(True)).select("r", "c", (F.col("n") / F.col("top")).alias("share"))

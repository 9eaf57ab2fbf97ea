"""Connected components of an edge table: stretches of edges by themselves, then alternating star steps on what they share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from latticework.sources.scratch import released, stored

#: Edges of a stretch.
STRETCH = 1_000_000


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two sums over their hashes; equal marks mean equal edge sets."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def star_edges(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) for each vertex that is not its component's smallest; edges need not be stored both ways.

    One round hangs each larger neighbour on the smallest neighbour, then each vertex's smaller neighbours on the
    smallest of them. The rounds grow with the logarithm of the longest path. Minima are aggregated before the
    shuffle and joined back, so that a vertex with very many edges is split like any skewed join key.
    Null ends and loops are dropped; an empty table gives no rows.
    """
    a, b = F.least(src, dst), F.greatest(src, dst)
    now = stored(edges.filter(F.col(src) != F.col(dst)).select(b.alias("a"), a.alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(now.join(low, "a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        before, now = now, stored(small.filter("a <> b").distinct(), "edges")
        released(before)
        was, mark = mark, _mark(now)
        if was == mark:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _whole(kind: ST.DataType) -> bool:
    return all(isinstance(f.dataType, ST.IntegralType) for f in kind.fields) if isinstance(kind, ST.StructType) else isinstance(kind, ST.IntegralType)


def _columns(vertices: pa.Array) -> list[np.ndarray]:
    """Numbers by which vertices are ordered as Spark orders them, nulls first."""
    fields = vertices.flatten() if pa.types.is_struct(vertices.type) else [vertices]
    return [x for f in fields for x in ([f.is_valid().to_numpy(False)] if f.null_count else []) + [f.fill_null(0).to_numpy(False)]]


def _least(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the smallest that edges a, b lead to. At least every other root hooks on a smaller one in a round."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            return root
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _stretches(batches):
    """(v, l) for each vertex of a stretch of edges (a, b): the smallest vertex that it has a way to within the stretch."""
    held, size = [], 0

    def told():
        ends = pa.concat_arrays([c for side in ("a", "b") for t in held for c in [t.column(side)]])
        columns = _columns(ends)
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        vertices = ends.take(pa.array(order[new]))
        root = _least(code[: len(code) // 2], code[len(code) // 2 :], len(vertices))
        for k in range(0, len(root), 100_000):
            yield pa.record_batch({"v": vertices[k : k + 100_000], "l": vertices.take(pa.array(root[k : k + 100_000]))})

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= STRETCH:
            yield from told()
            held, size = [], 0
    if size:
        yield from told()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex of edges; the component is its smallest vertex.

    Edges in order of their ends are told in stretches, each by itself, whatever holds it together; star steps then join the stretches' smallest
    vertices where a vertex lies in several stretches. Vertices are whole numbers or structs of these, else all edges go through star steps.
    """
    if not _whole(edges.schema[src].dataType) or edges.schema[src].dataType != edges.schema[dst].dataType:
        found = star_edges(edges, src, dst)
        alone = edges.select(F.explode(F.array(src, dst)).alias("id")).filter("id is not null").distinct().join(found, "id", "left")
        return alone.select("id", F.coalesce("component", "id").alias("component"))
    kept = stored(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")), "edges")
    links = kept.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartitionByRange("a").sortWithinPartitions("a")
    kind = edges.schema[src].dataType
    both = ST.StructType([ST.StructField("v", kind), ST.StructField("l", kind)])
    forest = stored(links.mapInArrow(_stretches, both), "stretches")
    lone = kept.filter("a = b or a is null or b is null").select(F.explode(F.array("a", "b")).alias("v")).filter("v is not null")
    low = forest.unionByName(lone.select("v", F.col("v").alias("l"))).groupBy("v").agg(F.min("l").alias("m"), F.max("l").alias("x"))
    shared = low.filter("m <> x").select("v", "m")
    found = star_edges(forest.join(shared, "v").filter("l <> m").select("m", "l"), "m", "l")
    return low.join(found.withColumnRenamed("id", "m"), "m", "left").select(F.col("v").alias("id"), F.coalesce("component", "m").alias("component"))

"""Graph operators on edge tables (src, dst, w)."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.sources.scratch import released, stored

#: Rows of a task that sorts.
TASK_ROWS = 400_000
#: Edges of a matching whose ends are sent to all tasks.
SENT_ROWS = 250_000
#: Edges that one task goes through one by one, and of these, edges that are Python objects at once.
PASS_ROWS, SLICE = 4_000_000, 100_000
#: Share of a pass's edges that must be left in its turn, or all edges are rid of used vertices.
PASS_SHARE = 0.5
#: For a round of a matching: least share of different weights in the edges, least share of the edges that the round before did away with.
WEIGHTS_SHARE, ROUND_SHARE = 0.1, 0.25


def force_symmetry(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges both ways, each once; tasks says how many tasks compare them."""
    e = edges.select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (both.repartition(tasks, "src", "dst") if tasks else both).distinct()


def extend_adjacency(edges: DataFrame, hops: int) -> DataFrame:
    """edges (both ways) with those to vertices hops further away; a new weight is the sum by the smallest vertex between."""
    known = edges.select("src", "dst", "w")
    front = known
    for _ in range(hops):
        step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("w").alias("w2"))
        further = front.join(step, "dst").filter("src <> to").groupBy("src", "to").agg(F.min(F.struct(F.col("dst").alias("m"), (F.col("w") + F.col("w2")).alias("w"))).alias("b"))
        front = further.select("src", F.col("to").alias("dst"), F.col("b.w").alias("w")).join(known.select("src", "dst"), ["src", "dst"], "left_anti")
        front = stored(front, "frontier") if hops > 1 else front
        known = known.unionByName(front)
    return known


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def bfs(edges: DataFrame, start: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, level) from the vertices start (id); edges both ways. One job per level."""
    reached = stored(start.select("id", F.lit(0).alias("level")), "levels")
    front = reached
    for level in range(1, most_rounds):
        nxt = front.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(reached, "id", "left_anti")
        front = stored(nxt.select("id", F.lit(level).alias("level")), "levels")
        if front.isEmpty():
            return reached
        reached = reached.unionByName(front)
    raise RuntimeError("the graph is deeper than most_rounds")


def bfs_order(edges: DataFrame, start: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, level, place) from one vertex start (id), as a queue would take them: place 0 is the start, then come each vertex's new neighbours in order of id.

    Within a level vertices are in the order of their first parent's place, then of their id; range partitions number them.
    """
    reached = stored(start.select("id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("place")), "order")
    front, before = reached, 1
    for level in range(1, most_rounds):
        met = front.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("place").alias("parent"))
        new = stored(met.join(reached, "id", "left_anti"), "order")
        held = new.count()
        if not held:
            return reached
        front = stored(ranked(new, [F.col("parent"), F.col("id")]).select("id", F.lit(level).alias("level"), (F.col("rank") + before).alias("place")), "order")
        reached, before = reached.unionByName(front), before + held
    raise RuntimeError("the graph is deeper than most_rounds")


def shortest_paths(edges: DataFrame, start: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, cost) of the cheapest ways from start (id) over non-negative weights. Only improved vertices go on."""
    known = stored(start.select("id", F.lit(0.0).alias("cost")), "costs")
    front = known
    for _ in range(most_rounds):
        tried = front.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        front = stored(tried.join(known, "id", "left").filter("cost is null or new < cost").select("id", F.col("new").alias("cost")), "costs")
        if front.isEmpty():
            return known
        known = stored(known.join(front.select("id"), "id", "left_anti").unionByName(front), "costs")
    raise RuntimeError("costs did not settle")


def join_tasks(df: DataFrame, rows: int) -> int:
    """Tasks for so many rows; sides that are dealt out to fewer than the session's shuffle partitions would be dealt out again for a join."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def best_at_both_ends(edges: DataFrame, tasks: int) -> DataFrame:
    """Those of edges (a, b, w) that no edge at either end comes before."""
    order = F.struct("w", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
    ends = edges.repartition(tasks, "a").select(F.explode(F.array("a", "b")).alias("id"), order.alias("o")).groupBy("id").agg(F.max("o").alias("o"))
    return ends.groupBy("o").count().filter("count = 2").select((-F.col("o.na")).alias("a"), (-F.col("o.nb")).alias("b"), F.col("o.w").alias("w"))


def without_ends(edges: DataFrame, taken: list[DataFrame], held: int, tasks: int) -> DataFrame:
    """Edges (a, b, ..) with no end in taken, which has held edges. Few ends are sent to all edges; else both sides are dealt out, and only the ends are held by a task, unsorted."""
    columns = edges.columns
    for end in ("a", "b") if taken else ():
        ids = reduce(DataFrame.unionByName, taken).select(F.explode(F.array("a", "b")).alias(end))
        edges = edges.join(F.broadcast(ids), end, "left_anti") if held <= SENT_ROWS else edges.repartition(tasks, end).join(ids.repartition(tasks, end).hint("shuffle_hash"), end, "left_anti")
    return edges.select(*columns)


def one_by_one(edges: DataFrame) -> DataFrame:
    """Those of edges (a, b, w, place) that one task takes by their places, each if both of its ends are free; for edges of bounded number."""

    def take(batches):
        if not (batches := list(batches)):
            return
        table, used, free = pa.Table.from_batches(batches), set(), []
        a, b, order = table.column("a").to_numpy(), table.column("b").to_numpy(), np.argsort(table.column("place").to_numpy())
        for at in range(0, len(order), SLICE):
            rows = order[at : at + SLICE]
            for row, x, y in zip(rows.tolist(), a[rows].tolist(), b[rows].tolist()):
                if x not in used and y not in used:
                    free.append(row)
                    used.update((x, y))
        yield from table.select(["a", "b", "w"]).take(pa.array(free, pa.int64())).to_batches()

    return edges.repartition(1).mapInArrow(take, edges.drop("place").schema)


def in_passes(edges: DataFrame, held: int, most: int) -> list[DataFrame]:
    """Those of edges (a, b, w) that the one-by-one order takes, in most tables at most.

    Edges are cut into ranges of the order. A pass goes through as many of the next ranges as one task may. Used vertices' edges leave a range before its
    turn; all that are left are rid of them once that has left a pass too small, so not where passes hardly meet the same vertices.
    """
    order, ranges = [F.col("w").desc(), F.col("a"), F.col("b")], max(1, -(-held // TASK_ROWS))
    left = edges.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    if held <= PASS_ROWS:
        return [stored(one_by_one(left), "matching")]
    left, taken, since, used, sizes = stored(left, "matching"), [], [], 0, None
    for _ in range(most):
        sizes = sizes or sorted(left.groupBy(F.shiftright("place", 33)).count().collect())
        small = False
        if sizes:
            now = max(1, bisect_right(list(accumulate(n for _, n in sizes)), PASS_ROWS))
            rows, first, end = sum(n for _, n in sizes[:now]), sizes[0][0] << 33, sizes[now - 1][0] + 1 << 33
            turn = left.filter((F.col("place") >= first) & (F.col("place") < end))
            if since:
                turn = stored(without_ends(turn, since, used, join_tasks(edges, rows + 2 * used)), "matching")
                small = turn.count() < PASS_SHARE * rows
            since.append(stored(one_by_one(turn), "matching"))
            if len(since) > 1:
                released(turn)
            taken.append(since[-1])
            used, sizes = used + since[-1].count(), sizes[now:]
        if not sizes:
            released(left)
            return taken
        if small:
            left, last = stored(without_ends(left.filter(F.col("place") >= end), since, used, join_tasks(edges, held)), "matching"), left
            released(last)
            since, used, sizes = [], 0, None
    raise RuntimeError("matching did not end")


def greedy_matching(edges: DataFrame, least: float = 1e-6, most_rounds: int = 10_000) -> DataFrame:
    """(a, b, w): what taking the heaviest edge with free ends again and again gives; ties by the smaller a, then b.

    An edge that is the best at both of its ends is one that the one-by-one order would take, so a round takes all of these. Where weights differ, rounds
    shrink quickly. Where many are equal, an edge waits for those of smaller vertices, these for others, and there are as many rounds as the longest such
    chain has links. So rounds are for weights that differ, and go on only while each does away with its share of the edges; the rest goes through the order.
    """
    left = stored(edges.filter((F.col("src") < F.col("dst")) & (F.col("w") >= least)).select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), "matching")
    held, weights = left.agg(F.count("*"), F.approx_count_distinct("w")).first()
    taken, before = [], None
    while held > PASS_ROWS and weights >= WEIGHTS_SHARE * held and (before is None or before - held >= ROUND_SHARE * before) and len(taken) < most_rounds:
        tasks = join_tasks(left, held)
        taken.append(stored(best_at_both_ends(left, tasks), "matching"))
        left, last, before = stored(without_ends(left, taken[-1:], taken[-1].count(), tasks), "matching"), left, held
        released(last)
        held = left.count()
    taken += in_passes(left, held, most_rounds)
    released(left)
    return reduce(DataFrame.unionByName, taken)


def laplacian(edges: DataFrame, shift: float = 1e-9) -> DataFrame:
    """(i, j, v) of D - W of a graph stored both ways, with a small shift on the diagonal."""
    d = edges.groupBy("src").agg((F.sum("w") + shift).alias("v")).select(F.col("src").alias("i"), F.col("src").alias("j"), "v")
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v")).unionByName(d)


def with_parts(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """edges with part_src and part_dst of parts (id, part)."""
    p = parts.select("id", "part")
    e = edges.join(p.select(F.col("id").alias("src"), F.col("part").alias("part_src")), "src")
    return e.join(p.select(F.col("id").alias("dst"), F.col("part").alias("part_dst")), "dst")


def cut_quality(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(cut, volume, most_cut): weight across parts, distinct other parts summed over vertices, the largest cut of one part."""
    across = with_parts(edges, parts).filter("part_src <> part_dst")
    cut = across.agg((F.coalesce(F.sum("w"), F.lit(0.0)) / 2).alias("cut"))
    volume = across.select("src", "part_dst").distinct().agg(F.count("*").alias("volume"))
    most = across.groupBy("part_src").agg(F.sum("w").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0.0)).alias("most_cut"))
    return cut.join(volume, F.lit(True)).join(most, F.lit(True))


def balance(weighted: DataFrame, part: str = "part", weight: str = "w") -> DataFrame:
    """Number of parts times the heaviest part's share of (part, w)."""
    sums = weighted.groupBy(part).agg(F.sum(weight).alias("s"))
    return sums.agg((F.count("*") * F.max("s") / F.sum("s")).alias("balance"))


def common_neighbours(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the number n of vertices that both are linked with."""
    one = pairs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("m")), "a")
    both = one.join(edges.select(F.col("src").alias("b"), F.col("dst").alias("m")), ["b", "m"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def relabel(table: DataFrame, perm: DataFrame, columns: list[str]) -> DataFrame:
    """table with each id column replaced by perm (old, new)."""
    for c in columns:
        table = table.join(perm.select(F.col("old").alias(c), F.col("new").alias("new_id")), c).drop(c).withColumnRenamed("new_id", c)
    return table


def ranked(df: DataFrame, order: list) -> DataFrame:
    """df with rank 0.. in a total order, without a single task: counts by range partition give the offsets."""
    held = stored(df, "ranks")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // TASK_ROWS))
    # Rows of a sorted partition are counted as they are written.
    place = F.monotonically_increasing_id()
    dealt = stored(held.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place_", place), "ranks")
    part = F.shiftright("place_", 33)
    before = F.coalesce(F.sum("n").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = dealt.groupBy(part.alias("part_")).agg(F.count("*").alias("n"), F.min("place_").alias("start")).select("part_", (before - F.col("start")).alias("ahead_"))
    return dealt.withColumn("part_", part).join(F.broadcast(ahead), "part_").withColumn("rank", F.col("ahead_") + F.col("place_")).select(*df.columns, "rank")

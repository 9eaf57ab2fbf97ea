"""Hard negatives by an inverted multi-index over whole-number vectors.

Two codebooks, one for each half of the components, make cells of (code of the first half, code of the second). A cell's rows
lie in blocks of bounded size. For a query the codes of a half have bounds: the inner product with the centre plus the query's
length times the code's radius, the largest distance of any row of that code from its centre. A heap walks the pairs of
codes by the sum of their two bounds, the greatest first, so a query stops where the next sum can't better what it has: its window's answer
is certified then. Searches go in rounds, each over more cells of each open query; queries travel in batches, and a batch meets
a block once for all its queries that visit the block's cell.

The codebooks are fitted on SAMPLE_ROWS rows at most; every row is indexed, and results are exact whatever the codebooks are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.llm.common import released, stored

#: Rows that fit the codebooks, codes of a half at most, rows wanted in a cell, rows of a block and of a batch of queries.
SAMPLE_ROWS, MOST_CODES, CELL_ROWS, BLOCK_ROWS, BATCH_ROWS = 8192, 1024, 512, 1024, 256
#: Cells that a query visits in the first round; each further round has this many times more.
FIRST_CELLS, WIDER = 16, 16
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LEAST = -(1 << 62)
BLOCK = "block long, cell int, ids binary, labels binary, vectors binary"
BATCH = "batch long, query_ids binary, query_labels binary, query_vectors binary"


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, v) of the rows that take part: label and vector there, every component a finite number; v is floor(256 x).

    Components beyond 2^27 count as 2^27, so that a score fits a long for vectors of up to 512 components.
    """
    v, limit = F.col(f"`{vector_column}`"), F.lit(float(1 << 27))
    x = lambda c: F.floor(F.greatest(-limit, F.least(limit, F.lit(float(SCALE)) * c.cast("double")))).cast("int")
    # Nulls, NaN and infinities fail the comparison; a null vector fails as well.
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(c.cast("double"), F.lit(0.0))))
    return rows.filter(F.col(f"`{id_column}`").isNotNull() & F.col(f"`{label_column}`").isNotNull() & sound).select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("long").alias("label"), F.transform(v, x).alias("v")
    )


class Codebooks:
    """Centres and radii of both halves, and the walk over their cells."""

    def __init__(self, centres: list[np.ndarray], radii: list[np.ndarray] | None = None, filled: np.ndarray | None = None):
        self.centres, self.radii, self.filled = centres, radii, filled
        self.cut = centres[0].shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    def codes(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(code, distance from its centre) of each row, for both halves."""
        return [nearest(h, c) for h, c in zip(self.halves(x), self.centres)]

    def walk(self, query: np.ndarray) -> Iterator[tuple[float, int]]:
        """(upper bound of a score, cell) of the filled cells, the greatest bound first."""
        bounds = [c @ h[0] + np.linalg.norm(h) * r for c, h, r in zip(self.centres, self.halves(query[None]), self.radii)]
        orders = [np.argsort(-b, kind="stable") for b in bounds]
        (u, v), k = (b[o].tolist() for b, o in zip(bounds, orders)), len(bounds[1])
        i_cell, j_cell = orders[0].tolist(), orders[1].tolist()
        heap = [(-u[0] - v[0], 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            # Each place (i, j) is pushed once: along a row from its left neighbour, down the first column only.
            if j + 1 < len(v):
                heapq.heappush(heap, (-u[i] - v[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-u[i + 1] - v[0], i + 1, 0))
            cell = i_cell[i] * k + j_cell[j]
            if self.filled[cell]:
                # Bounds are floats and scores whole numbers: a little more is always safe.
                yield -bound + 1e-6 * abs(bound) + 1, cell


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, distance from it) of each row."""
    if not centres.shape[1]:
        return np.zeros(len(rows), np.int64), np.zeros(len(rows))
    code = np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)
    return code, np.linalg.norm(rows - centres[code], axis=1)


def fitted(sample: np.ndarray, codes: int, steps: int = 8) -> np.ndarray:
    """Centres by Lloyd's steps from rows of the sample that lie far apart in its order; fewer where distinct rows are fewer."""
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.unique(np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int))]
    for _ in range(steps):
        code, _ = nearest(sample, centres)
        count = np.bincount(code, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, code, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, zeros after those that are shorter."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int32)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by floats where they can't pass 2^53."""
    largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.stack([(b.astype(np.int64) * row.astype(np.int64)).sum(axis=1) for row in a]) if len(a) else np.zeros((0, len(b)), np.int64)


class Index:
    """Blocks of rows by cell, with the codebooks that found the cells."""

    def __init__(self, rows: DataFrame):
        """rows: a stored table (id, label, v)."""
        self.spark = rows.sparkSession
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
        self.rows, self.width = size["n"], max(size["width"] or 1, 1)
        width, cut = self.width, self.width // 2
        chosen = rows.filter(F.xxhash64("id").cast("double") / float(1 << 64) + 0.5 <= min(1.0, 2 * SAMPLE_ROWS / max(self.rows, 1))).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v")
        sample = matrix(chosen.toArrow()["v"].combine_chunks(), width).astype(np.float64) if self.rows else np.zeros((1, width))
        if not len(sample):
            sample = np.zeros((1, width))
        codes = min(MOST_CODES, max(1, 1 << (isqrt(self.rows // CELL_ROWS).bit_length())))
        books = Codebooks([fitted(sample[:, :cut], codes), fitted(sample[:, cut:], codes)])
        k = len(books.centres[1])

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                (i, far_i), (j, far_j) = books.codes(matrix(batch["v"], width).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["v"], pa.array((i * k + j).astype(np.int32)), pa.array(far_i), pa.array(far_j)], ["id", "label", "v", "cell", "far_1", "far_2"])

        cells = stored(rows.select("id", "label", "v").mapInArrow(coded, "id long, label long, v array<int>, cell int, far_1 double, far_2 double"), "cells")
        # One row for each cell that has rows, MOST_CODES squared at most.
        stats = cells.groupBy("cell").agg(F.max("far_1").alias("far_1"), F.max("far_2").alias("far_2")).toArrow()
        cell, far = stats["cell"].to_numpy(), [stats[f"far_{h}"].to_numpy() for h in (1, 2)]
        books.radii = [np.zeros(len(c)) for c in books.centres]
        np.maximum.at(books.radii[0], cell // k, far[0])
        np.maximum.at(books.radii[1], cell % k, far[1])
        books.filled = np.zeros(len(books.centres[0]) * k, bool)
        books.filled[cell] = True
        self.books = self.spark.sparkContext.broadcast(books)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            block = TaskContext.get().partitionId() << 40
            for batch in batches:
                cell = batch["cell"].to_numpy()
                ids, labels, v = batch["id"].to_numpy(), batch["label"].to_numpy(), matrix(batch["v"], width)
                out = []
                for part in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
                    for at in range(0, len(part), BLOCK_ROWS):
                        p, block = part[at : at + BLOCK_ROWS], block + 1
                        out.append((block, int(cell[p[0]]), ids[p].tobytes(), labels[p].tobytes(), v[p].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["block", "cell", "ids", "labels", "vectors"])

        # By cell, and within a cell by a hash, so that ranges part a cell with very many rows.
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        spread = cells.withColumn("h", F.xxhash64("id")).repartitionByRange(parts, "cell", "h").sortWithinPartitions("cell", "h").drop("h", "far_1", "far_2")
        self.blocks = stored(spread.mapInArrow(blocks, BLOCK), "blocks", 8 * BLOCK_ROWS)
        released(cells)

    def search(self, queries: DataFrame, windows: DataFrame, most: int, same: bool) -> DataFrame:
        """A stored table (query, window, place, id, score): for each window of a query the first most rows by score, then by id.

        queries: (batch, query, label, v) with query a number of its own in the batch's rows. windows: (batch, query, window, low,
        high), whole scores, both ends included. Rows of the query's label are searched where same is true, all others where not;
        the query itself (query is its id) never.
        """
        spark, width, books = self.spark, self.width, self.books

        def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                of = [part["queries"][k].values for k in range(part.num_rows)]
                columns = [[pc.struct_field(q, n).to_numpy().astype(np.int64).tobytes() for q in of] for n in ("query", "label")]
                columns.append([matrix(pc.struct_field(q, "v"), width).tobytes() for q in of])
                yield pa.RecordBatch.from_arrays([part["batch"], *[pa.array(c, pa.binary()) for c in columns]], ["batch", "query_ids", "query_labels", "query_vectors"])

        grouped = queries.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("query", "label", "v"))).alias("queries"))
        batches = stored(grouped.mapInArrow(packed, BATCH), "batches", 64)
        cell_blocks = self.blocks.select("cell", "block")
        found, cells, seen = None, FIRST_CELLS, 0
        open_ = stored(windows.withColumn("floor", F.col("low")), "windows")
        while not open_.isEmpty():
            visits = stored(self._visits(batches, open_, seen, seen + cells), "visits")
            pairs = visits.join(cell_blocks, "cell").select("batch", "block", "members")
            grouped = open_.groupBy("batch").agg(F.collect_list(F.struct("query", "window", "floor", "high")).alias("windows"))
            met = pairs.join(self.blocks.drop("cell"), "block").join(batches.join(grouped, "batch"), "batch").select("members", "ids", "labels", "vectors", "query_ids", "query_labels", "query_vectors", "windows")
            hits = met.mapInArrow(_scorer(width, most, same), "query long, window int, id long, score long")
            if found is not None:
                hits = hits.unionByName(found.drop("place"))
            place = F.row_number().over(W.partitionBy("query", "window").orderBy(F.col("score").desc(), "id"))
            better = stored(hits.withColumn("place", place).filter(F.col("place") <= most), "found")
            seen, cells = seen + cells, cells * WIDER
            floors = better.groupBy("query", "window").agg(F.count("*").alias("n"), F.min("score").alias("last"))
            left = open_.join(floors, ["query", "window"], "left")
            # A full window is bettered by higher scores only, or by as high ones of a smaller id.
            left = left.withColumn("floor", F.when(F.col("n") >= most, F.greatest("last", "floor")).otherwise(F.col("floor"))).drop("n", "last")
            still = stored(left.join(self._unseen(batches, left, seen), ["batch", "query"], "left_semi"), "windows")
            for old in (visits, open_, *([found] if found is not None else [])):
                released(old)
            found, open_ = better, still
        for old in (batches, open_):
            released(old)
        return found if found is not None else spark.createDataFrame([], "query long, window int, id long, score long, place int")

    def _walks(self, batches: DataFrame, windows: DataFrame, take: str, schema: str, start: int, stop: int) -> DataFrame:
        """What a batch's queries with open windows find between two places of their walks."""
        width, books = self.width, self.books
        grouped = windows.groupBy("batch").agg(F.collect_list(F.struct("query", "floor", "high")).alias("windows"))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for at in range(part.num_rows):
                    row = {n: part[n][at] for n in part.schema.names}
                    lowest: dict[int, int] = {}
                    for w in row["windows"].as_py():
                        lowest[w["query"]] = min(w["floor"], lowest.get(w["query"], w["floor"]))
                    members: dict[int, list[int]] = {}
                    vectors = np.frombuffer(row["query_vectors"].as_buffer(), np.int32).reshape(-1, width).astype(np.float64)
                    for k, query in enumerate(np.frombuffer(row["query_ids"].as_buffer(), np.int64).tolist()):
                        if query not in lowest:
                            continue
                        for n, (bound, cell) in enumerate(books.value.walk(vectors[k])):
                            if n >= stop or bound < lowest[query]:
                                break
                            if n >= start:
                                members.setdefault(cell if take == "cell" else query, []).append(k)
                    keys, size = list(members), [row["batch"].as_py()] * len(members)
                    arrays = [pa.array(size, pa.int64()), pa.array(keys, pa.int32() if take == "cell" else pa.int64())]
                    names = ["batch", take]
                    if take == "cell":
                        arrays.append(pa.array([np.array(members[c], np.int32).tobytes() for c in keys], pa.binary()))
                        names.append("members")
                    yield pa.RecordBatch.from_arrays(arrays, names)

        return batches.join(grouped, "batch").select("batch", "query_ids", "query_vectors", "windows").mapInArrow(run, schema)

    def _visits(self, batches: DataFrame, windows: DataFrame, start: int, stop: int) -> DataFrame:
        return self._walks(batches, windows, "cell", "batch long, cell int, members binary", start, stop)

    def _unseen(self, batches: DataFrame, windows: DataFrame, start: int) -> DataFrame:
        """Queries whose next cell may still hold something."""
        return self._walks(batches, windows, "query", "batch long, query long", start, start + 1)


def _scorer(width: int, most: int, same: bool):
    """Scores the queries of each batch that visit a block against its rows; the best of each window come out."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for k in range(part.num_rows):
                get = lambda n: part[n][k]  # noqa: B023, E731
                ids, labels = np.frombuffer(get("ids").as_buffer(), np.int64), np.frombuffer(get("labels").as_buffer(), np.int64)
                rows = np.frombuffer(get("vectors").as_buffer(), np.int32).reshape(-1, width)
                members = np.frombuffer(get("members").as_buffer(), np.int32)
                query, label = (np.frombuffer(get(n).as_buffer(), np.int64)[members] for n in ("query_ids", "query_labels"))
                score = products(np.frombuffer(get("query_vectors").as_buffer(), np.int32).reshape(-1, width)[members], rows)
                fits = (label[:, None] == labels) == same
                fits &= query[:, None] != ids
                windows = get("windows").values
                of, window, floor, high = (pc.struct_field(windows, n).to_numpy() for n in ("query", "window", "floor", "high"))
                place = {q: m for m, q in enumerate(query.tolist())}
                for w in np.flatnonzero(np.isin(of, query)).tolist():
                    m = place[int(of[w])]
                    at = np.flatnonzero(fits[m] & (score[m] >= floor[w]) & (score[m] <= high[w]))
                    if not len(at):
                        continue
                    at = at[np.lexsort((ids[at], -score[m][at]))[:most]]
                    for column, values in zip(out, (np.full(len(at), of[w]), np.full(len(at), window[w]), ids[at], score[m][at])):
                        column.append(values)
            joined = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(joined, (np.int64, np.int32, np.int64, np.int64))], ["query", "window", "id", "score"])

    return run


def hard_negatives(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", every: int = 50, moved: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), one row for each negative of an anchor and positive.

    Rows whose id, label or vector is null, or that have a null, NaN or infinite component, take no part. Where the id is divisible by moved the label
    first becomes (label + 1) % labels. Anchors are the rows whose id is divisible by every. An anchor's positives are its first 5 other rows of its label
    by score, a positive's negatives the first 3 rows of other labels whose score is from 50 to 95 hundredths of the positive's; ties by
    smaller id. A positive of negative score has none, one of score zero those of score zero. Repeated rows of one id are candidates each, and as an anchor count once,
    with the smallest label and vector. Shorter vectors end in zeros; an empty vector is all zeros. Other columns may have any names; an empty table gives no rows.
    """
    whole = whole_vectors(rows, id_column, vector_column, label_column)
    table = stored(whole.withColumn("label", F.when(F.col("id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))), "vectors")
    index = Index(table)
    anchors = table.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select(F.col("id").alias("query"), "row.label", "row.v")
    # Batches of neighbours in the table's own hash order, of about BATCH_ROWS each.
    many = max(1, -(-(index.rows // every + 1) // BATCH_ROWS))
    queries = stored(anchors.withColumn("batch", F.pmod(F.xxhash64("query"), F.lit(many))), "anchors")
    wide = queries.select("batch", "query", F.lit(0).alias("window"), F.lit(LEAST).alias("low"), F.lit(-LEAST).alias("high"))
    positives = index.search(queries, wide, POSITIVES, True)
    score = F.col("score")
    # 50 p <= 100 n <= 95 p in whole numbers.
    windows = queries.select("batch", "query").join(positives.filter("score >= 0"), "query").select("batch", "query", F.col("place").alias("window"), F.shiftright(score + 1, 1).alias("low"), F.expr("score div 100 * 95 + score % 100 * 95 div 100").alias("high"))
    negatives = index.search(queries, windows.filter("low <= high"), NEGATIVES, False)
    of = positives.select("query", F.col("place").alias("window"), F.col("id").alias("positive_id"), score.alias("positive_score"))
    return negatives.join(of, ["query", "window"]).select(
        F.col("query").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )

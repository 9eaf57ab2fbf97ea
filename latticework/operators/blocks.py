"""Steps of solvers on large sparse matrices: the entries stay where they are, and only vectors move.

Rows are dealt by a hash into blocks, and the matrix into tiles of a block of rows by a block of columns, written once as a bucketed table in the
shared folder. A vector's block goes to the tiles of its columns, their partial products to the block of their rows: about 2 x side x 8 bytes for each
row and step, whatever the number of entries. The side grows so that a tile has no more than ENTRIES entries on average.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.sources.scratch import CLEAN, _settings, released, shared_dir, stored

ENTRIES = 4_000_000
LEAST_SIDE = 4
#: Rows are blocks of vectors or tiles here, so few of them go to Python at once.
BATCH = 2

Vectors = dict[str, np.ndarray]


def _block(c: str, side: int) -> Column:
    return F.pmod(F.hash(F.col(c).cast("long")), F.lit(side)).cast("int")


def _slots(spark: SparkSession, count: int) -> list[int]:
    """Numbers that hash partitioning deals to count different partitions, one to each."""
    found = spark.range(60 * count).select(F.col("id").cast("int").alias("slot")).groupBy(F.pmod(F.hash("slot"), F.lit(count)).alias("at")).agg(F.min("slot").alias("slot"))
    return [r["slot"] for r in found.orderBy("at").collect()]


def _read(row: dict) -> Vectors:
    return {k: np.frombuffer(v, np.int64 if k == "i" else np.float64) for k, v in row.items() if isinstance(v, bytes)}


def _row(block: int, vectors: Vectors, sums: list[float] = ()) -> pa.Table:
    columns = {k: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for k, v in vectors.items()}
    return pa.table({"block": pa.array([block], pa.int32()), **columns, "sums": pa.array([[float(s) for s in sums]], pa.list_(pa.float64()))})


def _schema(names: list[str]) -> str:
    return "block int, " + "".join(f"{n} binary, " for n in names) + "sums array<double>"


class Tiles:
    """A square matrix (i, j, v) cut into tiles, for steps on vectors of its rows."""

    def __init__(self, m: DataFrame, rows: DataFrame | None = None):
        """rows (i, ...) are the unknowns with what is known of each; without them they are the matrix's rows."""
        self.spark = m.sparkSession
        self.side = max(LEAST_SIDE, math.ceil(math.sqrt(m.count() / ENTRIES)))
        self.start = self._packed(m.select("i").distinct() if rows is None else rows)
        self.name = f"tiles_{uuid.uuid4().hex}"
        self.slots = F.array(*[F.lit(s) for s in _slots(self.spark, self.side**2)])
        self._cut(m)

    def _slot(self, row: Column, column: Column) -> Column:
        return F.element_at(self.slots, (row * self.side + column + 1).cast("int"))

    def _others(self, of: Callable[[Column], Column]) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(self.side - 1)), of)).alias("slot")

    def _packed(self, rows: DataFrame) -> DataFrame:
        """One row for each block: ids in order, and each column as numbers in their order."""
        names = [c for c in rows.columns if c != "i"]

        def pack(t: pa.Table) -> pa.Table:
            ids = t["i"].to_numpy()
            order = np.argsort(ids)
            return _row(t["block"][0].as_py(), {"i": ids[order], **{c: t[c].to_numpy()[order] for c in names}})

        known = rows.select(_block("i", self.side).alias("block"), F.col("i").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in names])
        return stored(known.groupBy("block").applyInArrow(pack, _schema(["i", *names])), "vectors")

    def _cut(self, m: DataFrame) -> None:
        side, count = self.side, self.side**2

        def cut(entries: pa.Table, ids: pa.Table) -> pa.Table:
            at = {r["kind"]: (r["block"], np.frombuffer(r["i"], np.int64)) for r in ids.to_pylist()}
            empty = len(at) < 2 or not len(entries)
            columns: dict = {"slot": [], "block": [], "size": [], "r": [], "c": [], "v": []}
            if not empty:
                (block, row_ids), (_, column_ids) = at["row"], at["column"]
                i, j, v = (entries[c].to_numpy() for c in ("i", "j", "v"))
                r, c = np.searchsorted(row_ids, i), np.searchsorted(column_ids, j)
                ok = (row_ids[np.minimum(r, len(row_ids) - 1)] == i) & (column_ids[np.minimum(c, len(column_ids) - 1)] == j)
                values = (entries["slot"][0].as_py(), block, len(row_ids), *(x[ok].astype(t).tobytes() for x, t in ((r, np.int32), (c, np.int32), (v, np.float64))))
                columns = {k: [x] for k, x in zip(columns, values)}
            return pa.table({k: pa.array(x, pa.int32() if k in ("slot", "block", "size") else pa.binary()) for k, x in columns.items()})

        entries = m.select(self._slot(_block("i", side), _block("j", side)).alias("slot"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
        ids = self.start.select("block", "i")
        kinds = [ids.select(self._others(of), F.lit(kind).alias("kind"), "block", "i") for kind, of in (("row", lambda k: self._slot(F.col("block"), k)), ("column", lambda k: self._slot(k, F.col("block"))))]
        both = kinds[0].unionByName(kinds[1]).repartition(count, "slot").groupBy("slot")
        tiles = entries.repartition(count, "slot").groupBy("slot").cogroup(both).applyInArrow(cut, "slot int, block int, size int, r binary, c binary, v binary")
        with _settings(self.spark, CLEAN):
            tiles.write.bucketBy(count, "slot").option("path", f"{shared_dir(self.spark)}/{self.name}").saveAsTable(self.name)

    def products(self, state: DataFrame, x: Callable[[Vectors], np.ndarray]) -> DataFrame:
        """(block, y): partial products of the matrix with the vector x of state's vectors."""

        def send(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield pa.record_batch({"block": pa.array([row["block"]], pa.int32()), "x": pa.array([x(_read(row)).tobytes()], pa.binary())})

        def multiply(batches):
            sums: dict = {}
            for batch in batches:
                for row in batch.to_pylist():
                    r, c = np.frombuffer(row["r"], np.int32), np.frombuffer(row["c"], np.int32)
                    y = np.bincount(r, np.frombuffer(row["v"], np.float64) * np.frombuffer(row["x"], np.float64)[c], row["size"])
                    sums[row["block"]] = sums[row["block"]] + y if row["block"] in sums else y
            for block, y in sums.items():
                yield pa.record_batch({"block": pa.array([block], pa.int32()), "y": pa.array([y.tobytes()], pa.binary())})

        sent = state.mapInArrow(send, "block int, x binary").select(self._others(lambda k: self._slot(k, F.col("block"))), "x")
        met = self.spark.table(self.name).join(sent.hint("shuffle_hash"), "slot")
        return met.select("block", "size", "r", "c", "v", "x").mapInArrow(multiply, "block int, y binary")

    def step(self, state: DataFrame, x: Callable[[Vectors], np.ndarray], then: Callable[[Vectors], tuple[Vectors, list[float]]], names: list[str], last: bool = True) -> tuple[DataFrame, np.ndarray]:
        """(state, sums) after y, the product with x(state): then gives each block's vectors names of its vectors and y, and sums over it. last: state is read no more."""

        def end(parts: pa.Table, own: pa.Table) -> pa.Table:
            (row,) = own.to_pylist()
            vectors = _read(row)
            y = np.zeros(len(vectors["i"]))
            for part in parts["y"].to_pylist():
                y = y + np.frombuffer(part, np.float64)
            new, sums = then(vectors | {"y": y})
            return _row(row["block"], {n: new[n] for n in names}, sums)

        parts = self.products(state, x)
        made = stored(parts.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(end, _schema(names)), "vectors", batch_rows=BATCH)
        sums = np.sum([r["sums"] for r in made.select("sums").collect()], axis=0)
        if last and state is not self.start:
            released(state)
        return made, sums

    def summed(self, state: DataFrame, of: Callable[[Vectors], list[float]]) -> np.ndarray:
        """Sums over all blocks."""

        def each(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield pa.record_batch({"sums": pa.array([[float(s) for s in of(_read(row))]], pa.list_(pa.float64()))})

        with _settings(self.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
            return np.sum([r["sums"] for r in state.mapInArrow(each, "sums array<double>").collect()], axis=0)

    def rows(self, state: DataFrame, of: Callable[[Vectors], Vectors]) -> DataFrame:
        """A stored table (i, ...) of the vectors that of gives."""
        names = list(of({k: np.zeros(1, np.int64 if k == "i" else np.float64) for k in state.columns if k not in ("block", "sums")}))

        def each(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    vectors = _read(row)
                    columns = {"i": vectors["i"]} | of(vectors)
                    for k in range(0, len(vectors["i"]), 100_000):
                        yield pa.record_batch({n: pa.array(c[k : k + 100_000]) for n, c in columns.items()})

        return stored(state.mapInArrow(each, "i long, " + ", ".join(f"{n} double" for n in names)), "solved", batch_rows=BATCH)

    def drop(self) -> None:
        """Forgets the table's name; its files stay in the shared folder as other tables do."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

"""Exact deduplication of whole texts by Grace hash partitioning.

Each task first finds the copies within its own rows, so that a text with very many copies leaves one
representative per task. Representatives are dealt out by a hash of their text. A task enters them into an open-addressing
table that holds each content once, however many copies come; once it is full, representatives of contents that it
doesn't hold are spilled to partition files by further bits of the hash, and each file is a bucket that is treated alike, until all fit.
The table compares complete contents, so equal hashes of different texts do no harm.
What a representative's bucket decides goes back to the rows it stands for by a join on the representative.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import SPACE, text_or_empty

#: Bytes of content that one open-addressing table may hold, partition files of each level of spilling, and rows of a batch of results.
TABLE_BYTES, FAN_OUT, RESULT_ROWS = 16 << 20, 16, 2000


def normalised(column: str = "text") -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(text_or_empty(column), SPACE, " ")


class Table:
    """An open-addressing table of contents with linear probing; entries are numbered in the order in which they come."""

    def __init__(self):
        self.slots, self.mask, self.hashes, self.contents, self.bytes = [-1] * 16, 15, [], [], 0

    def find(self, h: int, content: bytes) -> int:
        """The entry of this content, or -1."""
        s = h & self.mask
        while (j := self.slots[s]) >= 0 and (self.hashes[j] != h or self.contents[j] != content):
            s = (s + 1) & self.mask
        return j

    def _place(self, h: int, j: int) -> None:
        s = h & self.mask
        while self.slots[s] >= 0:
            s = (s + 1) & self.mask
        self.slots[s] = j

    def insert(self, h: int, content: bytes) -> int:
        """A new entry for a content that the table doesn't hold."""
        j = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * j > self.mask:
            self.mask = 2 * self.mask + 1
            self.slots = [-1] * (self.mask + 1)
            for k, g in enumerate(self.hashes):
                self._place(g, k)
        else:
            self._place(h, j)
        return j


def distinct_slots(hashes: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """For each row the first row of equal content."""
    table, first, of = Table(), [], np.empty(len(contents), np.int64)
    for i, (h, content) in enumerate(zip(hashes.tolist(), contents)):
        if (j := table.find(h, content)) < 0:
            j = table.insert(h, content)
            first.append(i)
        of[i] = first[j]
    return of


def _smallest_first(ids: pa.Array) -> np.ndarray:
    """Row numbers by id, nulls last, ties as they come."""
    ids = ids.to_pylist()
    return np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0)), np.int64)


def _local(batches: Iterator[pa.RecordBatch], out: pa.Schema, table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Copies within the task: a row with the text for each distinct content, and one with the ids it stands for."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    made = 0

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal made
        contents = rows["norm"].to_pylist()
        first = distinct_slots(np.asarray(rows["h"]), contents)
        ids = rows["id"].combine_chunks()
        order = _smallest_first(ids)
        order = order[np.argsort(first[order], kind="stable")]
        starts = np.flatnonzero(np.r_[True, first[order][1:] != first[order][:-1]])
        leaders, sizes = order[starts], np.diff(np.r_[starts, len(order)])
        rep = pa.array((np.int64(task) << 32) + made + np.arange(len(leaders)))
        made += len(leaders)
        shas = pa.array([hashlib.sha256(contents[i]).hexdigest() for i in leaders])
        lead = rows.take(pa.array(leaders))
        none = pa.nulls(len(leaders))
        columns = {"rep": rep, "h": lead["h"].combine_chunks(), "id": lead["id"].combine_chunks(), "n": pa.array(sizes), "norm": lead["norm"].combine_chunks(), "row": lead["row"].combine_chunks()}
        yield _batch(out, columns | {"members": none, "sha": none}, len(leaders))
        members = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)], pa.int32()), ids.take(pa.array(order)))
        yield _batch(out, {"rep": rep, "members": members, "sha": shas}, len(leaders))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) > table_bytes:
            yield from flush(pa.Table.from_batches(held))
            held = []
    if held:
        yield from flush(pa.Table.from_batches(held))


def _batch(schema: pa.Schema, columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    def one(field: pa.Field) -> pa.Array:
        column = columns.get(field.name)
        if column is None or pa.types.is_null(column.type):
            return pa.nulls(n, field.type)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column if column.type == field.type else column.cast(field.type)

    return pa.RecordBatch.from_arrays([one(f) for f in schema], schema=schema)


def _grace(batches: Iterator[pa.RecordBatch], out: pa.Schema, table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Decides representatives bucket by bucket; the rows with ids pass by."""

    def bucket(rows: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        table = Table()
        # Of each representative its number, entry and copies; of each entry the smallest (id, number) with its row, and the copies.
        reps, entries, best, row, copies = [], [], [], [], []
        folder, files = None, {}
        try:
            for batch in rows:
                stands = batch["norm"].is_null()
                if (known := batch.filter(stands)).num_rows:
                    yield _batch(out, {"rep": known["rep"], "members": known["members"], "sha": known["sha"]}, known.num_rows)
                new = batch.filter(pa.compute.invert(stands))
                full: list[int] = []
                for i, (rep, h, id_, n, content) in enumerate(zip(*(new[c].to_pylist() for c in ("rep", "h", "id", "n")), new["norm"])):
                    content = content.as_py()
                    if (j := table.find(h, content)) < 0:
                        if table.contents and table.bytes + len(content) > table_bytes:
                            full.append(i)
                            continue
                        j = table.insert(h, content)
                        best.append(None)
                        row.append(None)
                        copies.append(0)
                    order = (id_ is None, id_ if id_ is not None else 0, rep)
                    if best[j] is None or order < best[j]:
                        best[j], row[j] = order, new["row"].take(pa.array([i]))
                    copies[j] += n
                    reps.append(rep)
                    entries.append(j)
                if full:
                    folder = folder or tempfile.mkdtemp(prefix="grace-")
                    spilled = new.take(pa.array(full))
                    # Each level removes what its table holds, so buckets end even where the hash has no bits left.
                    part = (np.asarray(spilled["h"]) >> np.int64(min(60, 4 * level + 8))) & (FAN_OUT - 1)
                    for k in np.unique(part).tolist():
                        if k not in files:
                            files[k] = pa.ipc.new_file(f"{folder}/{k}", spilled.schema)
                        files[k].write_batch(spilled.filter(pa.array(part == k)))
            table = None
            for at in range(0, len(reps), RESULT_ROWS):
                rep, entry = reps[at : at + RESULT_ROWS], entries[at : at + RESULT_ROWS]
                leads = [best[j][2] == r for r, j in zip(rep, entry)]
                keep = pa.array([None if best[j][0] else best[j][1] for j in entry], out.field("keep_id").type)
                none = pa.nulls(1, out.field("row").type)
                whole = pa.concat_arrays([row[j] if lead else none for j, lead in zip(entry, leads)])
                yield _batch(out, {"rep": pa.array(rep), "keep_id": keep, "group_size": pa.array([copies[j] for j in entry]), "leads": pa.array(leads), "row": whole}, len(rep))
            reps, entries, best, row, copies = [], [], [], [], []
            for k, writer in sorted(files.items()):
                writer.close()
                with pa.OSFile(f"{folder}/{k}") as source:
                    reader = pa.ipc.open_file(source)
                    yield from bucket((reader.get_batch(i) for i in range(reader.num_record_batches)), level + 1)
                os.remove(f"{folder}/{k}")
        finally:
            if folder:
                shutil.rmtree(folder, ignore_errors=True)

    yield from bucket(batches, 0)


def grouped(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: bool = False, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """What the buckets decide: (rep, keep_id, group_size, leads, row) for a representative, (rep, members, sha) for its ids.

    row holds all of the staying row's columns where rows is true, else it is null.
    """
    id_type = docs.schema[id_column].dataType
    row_type = docs.schema if rows else T.BooleanType()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if rows else F.lit(None).cast("boolean")
    norm = normalised(f"`{text_column}`")
    source = docs.select(F.col(f"`{id_column}`").alias("id"), norm.cast("binary").alias("norm"), F.xxhash64(norm).alias("h"), row.alias("row"))
    local = T.StructType.fromDDL("rep long, h long, n long, norm binary, sha string").add("id", id_type).add("members", T.ArrayType(id_type)).add("row", row_type)
    after = T.StructType.fromDDL("rep long, group_size long, leads boolean, sha string").add("keep_id", id_type).add("members", T.ArrayType(id_type)).add("row", row_type)
    from pyspark.sql.pandas.types import to_arrow_schema

    local_arrow, after_arrow = to_arrow_schema(local), to_arrow_schema(after)
    first = source.mapInArrow(lambda batches: _local(batches, local_arrow, table_bytes), local)
    dealt = first.repartition(F.coalesce("h", F.xxhash64("rep")))
    return dealt.mapInArrow(lambda batches: _grace(batches, after_arrow, table_bytes), after)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept and text_sha256 of the normalised text.

    A null text counts as empty. The smallest id of a group stays; null ids come last. Of rows that are equal in id
    and text, one stays. Ids may be of any type that has an order, texts of any length. An empty table gives no rows. Other columns of
    docs are not read and may have any names.
    """
    found = grouped(docs, id_column, text_column, table_bytes=table_bytes)
    by_rep = found.groupBy("rep").agg(
        F.first("keep_id", ignorenulls=True).alias("keep_id"),
        F.max("group_size").alias("group_size"),
        F.max("leads").alias("leads"),
        F.first("members", ignorenulls=True).alias("members"),
        F.max("sha").alias("sha"),
    )
    return by_rep.select("*", F.posexplode("members").alias("at", "member")).select(
        F.col("member").alias(id_column), "keep_id", "group_size", (F.col("leads") & (F.col("at") == 0)).alias("kept"), F.col("sha").alias("text_sha256")
    )


def exactly_distinct(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, whole: one of each group of equal texts.

    Nulls, empty and very long texts, ties and repeated rows count as in exact_dedup(); other columns may have any names and come back
    as they are. An empty table gives no rows.
    """
    found = grouped(docs, id_column, text_column, rows=True).filter("leads")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

"""WARC archives: a deterministic sharded writer and a reader.

Records are dealt out by range of page id: a histogram of a fixed number of bins gives the shard of each bin, so that
the shards are the same in every run and of about equal size. A bin of more than a shard's bytes, as an outlying id, ids that
are null or repeated, or a very large table make it, takes several shards, between which a hash of id and digest divides its
records. A task sorts its shards, regenerates each record's headers and digests, gzips record by record, and rolls to the next
file once one reaches its compressed size. A file is written under a temporary name and moved when whole; what files there are is
a manifest table, which Spark commits, and only files that it names are read, once their size and digest agree with it. A task
that is run again writes the same bytes under the same names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.llm.common import shared_dir, text_or_empty

#: Bins of the histogram, payload bytes of a shard, compressed bytes of a file, payload bytes from which a copy is a revisit.
BINS, SHARD_BYTES, FILE_BYTES, LEAST_REVISIT = 4096, 64 << 20, 16 << 20, 100
DATE, PROFILE = "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: WARC headers, HTTP headers, and for a response its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.encode('unicode_escape').decode()}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as a gzip member with no time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Roller:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, file_bytes: int):
        (self.fs, self.folder), self.shard, self.most = _fs(folder), shard, file_bytes
        self.out, self.done, self.seq = None, [], 0

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:08d}-{self.seq:05d}.warc.gz"
            self.fs.create_dir(f"{self.folder}/_temporary", recursive=True)
            self.temporary = f"{self.folder}/_temporary/{self.name}-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.size, self.sha.hexdigest()))
            self.out, self.seq = None, self.seq + 1


MANIFEST = "shard long, file string, records long, bytes long, sha256 string"


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages below folder and returns the manifest, read back from there.

    Of equal payloads of at least 100 bytes that of the smallest id is a response and the others revisit it; of
    repeated rows one is the response. A null payload counts as empty, a null url has no target header; null ids come first,
    have an empty record id and are responses unless a row with an id holds the payload. Ids are cast to long. Payloads may be of any
    length; one above file_bytes has a file of its own. Other columns may have any names. An empty table writes no file.
    """
    payload = text_or_empty(f"`{payload_column}`")
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{url_column}`").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    slim = rows.select("id", "digest", "size")
    low, high = slim.agg(F.min("id"), F.max("id")).first()
    low, width = low or 0, max(1, ((high or 0) - (low or 0)) // BINS + 1)
    of = F.coalesce(F.floor((F.col("id") - low) / width).cast("long"), F.lit(-1).cast("long"))
    # At most BINS + 1 rows, whatever the input.
    bins = slim.groupBy(of.alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    size = F.col("bytes") + 512 * F.col("n")
    before = F.coalesce(F.sum(size).over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = bins.select("bin", F.floor(before / shard_bytes).cast("long").alias("first"), F.greatest(F.lit(1), F.floor(size / shard_bytes)).cast("long").alias("slices"))
    count = shards.agg(F.max(F.col("first") + F.col("slices"))).first()[0]
    if count is None:
        return pages.sparkSession.createDataFrame([], MANIFEST)
    owners = slim.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("n")).filter("n > 1 and owner is not null").select("digest", "owner")
    revisits = slim.filter(F.col("size") >= LEAST_REVISIT).join(owners, "digest").filter(~F.col("id").eqNullSafe(F.col("owner"))).select("id", "digest", "owner").distinct()
    told = revisits.select(of.alias("bin"), "id", F.lit(0).alias("step"), "digest", "owner", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    kept = rows.select(of.alias("bin"), "id", F.lit(1).alias("step"), "digest", F.lit(None).cast("long").alias("owner"), "url", F.col("payload").cast("binary").alias("payload"))
    both = told.unionByName(kept).join(F.broadcast(shards), "bin")
    shard = (F.col("first") + F.pmod(F.xxhash64("id", "digest"), "slices")).alias("shard")
    # Equal shards stay together in a range, and there are as many ranges as shards.
    ranges = both.select(shard, "id", "step", "digest", "owner", "url", "payload").repartitionByRange(int(count), "shard")
    dealt = ranges.sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "digest", "step", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, known, last = None, {}, None
        done: list[tuple] = []
        for batch in batches:
            for shard, i, step, digest, owner, url, payload in zip(*(batch[c].to_pylist() for c in ("shard", "id", "step", "digest", "owner", "url", "payload"))):
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        done += roller.done
                    roller, last = _Roller(folder, shard, file_bytes), None
                if (i, digest) != last:
                    known, last, written = {}, (i, digest), False
                if step == 0:
                    known["owner"] = owner
                    continue
                refers = known.get("owner", i if written and i is not None and len(payload) >= LEAST_REVISIT else None)
                roller.write(member(record("response" if refers is None else "revisit", i, url, payload, digest, refers)))
                written = True
        if roller:
            roller.close()
            done += roller.done
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "records", "bytes", "sha256"), d)) for d in done], schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(content: bytes) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of each record of one archive, digests verified."""
    page = lambda s: int(s[10:-1]) if s and len(s) > 11 else None
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := f.readline()) != b"\r\n":
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[key] = value
            block = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n" or "sha256:" + hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"]:
                raise ValueError(f"damaged record {head['WARC-Record-ID']}")
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b": ")[2])
            digest = head["WARC-Payload-Digest"][7:]
            if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"damaged payload {head['WARC-Record-ID']}")
            yield page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], page(head.get("WARC-Refers-To")), payload


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the files that folder's manifest names."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "bytes", "sha256")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        for batch in batches:
            for file, size, sha in zip(*(batch[c].to_pylist() for c in ("file", "bytes", "sha256"))):
                with fs.open_input_stream(f"{path}/{file}", compression=None) as f:
                    content = f.read()
                if len(content) != size or hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{file} isn't the file that the manifest names")
                found = [r[:5] for r in records_of(content)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.repartition(F.xxhash64("file")).mapInArrow(read, RECORD)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages to a fresh folder in the shared one and reads the archives back; an empty table gives no rows."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    if write_archives(pages, folder).isEmpty():
        return pages.sparkSession.createDataFrame([], RECORD)
    return read_archives(pages.sparkSession, folder)

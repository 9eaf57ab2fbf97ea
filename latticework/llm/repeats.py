"""Removal of passages that occur elsewhere, by suffix arrays and their common-prefix intervals.

Finding. Every window of LEAST bytes picks an anchor: its K-gram of smallest hash, the leftmost on ties. Equal windows
pick equal anchors at equal offsets, so only occurrences of one anchor need to meet. An occurrence stands for the
windows that picked it; together these span its context, at most 2 * LEAST - K bytes. Each different context of an anchor
is one piece, with the number of its occurrences.

Comparing. The pieces of one anchor go to one task, which builds the enhanced suffix array of the pieces that it has: their suffixes of
LEAST bytes or more in order, with the prefix that each shares with the one before. A stack scan gives the tree of common-prefix
intervals, a piece that occurs several times being a leaf of several members. Intervals whose members are preceded by different
bytes are the maximal repeats; each is reported with all its occurrences, and only what is reported is removed.

Many pieces under one anchor, as a line that stands in very many documents has them, are split first: the windows with
much before the anchor share more bytes on its left, those with little share more on its right. Each half goes on
under the bytes that its windows share, halved again as often as needed; after eight halvings it is one window, which is one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import TEXT_ROWS, released, stored, text_or_empty

#: Bytes of a repeat at least, bytes of an anchor, pieces that one suffix array takes of one anchor, positions hashed at once.
LEAST, GRAM, CONTEXTS, CHUNK = 200, 32, 256, 1 << 19
#: Pieces that are sorted together, whole anchors beyond, and bytes of a batch that leaves Python.
TOGETHER, BATCH_BYTES = 512, 4 << 20
#: Odd multipliers of the K-gram hash.
MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes of data, by doubling; GRAM is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * MIX_2
    size = 1
    while size < GRAM:
        h = (h[:-size] * MIX_1 + h[size:]) * MIX_2
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def anchors(content: bytes, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(key, place, first, last): each anchor's hash and place, and the first and last start of the windows that picked it."""
    found: list[tuple[np.ndarray, ...]] = []
    n, width = len(content), least - GRAM + 1
    for at in range(0, max(0, n - least + 1), CHUNK):
        data = np.frombuffer(content, np.uint8, min(CHUNK + least - 1, n - at), at)
        h = gram_hashes(data)
        # The hash's upper bits with the place below them: the smallest is the leftmost of the smallest hash.
        key = (h >> np.uint64(20) << np.uint64(20)) + np.arange(len(h), dtype=np.uint64)
        windows = len(h) - width + 1
        padded = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], windows] - 1
        found.append((h[place[first]], place[first] + at, first + at, last + at))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def suffix_array(pieces: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place, common): suffixes of least bytes or more in order, and the prefix that each shares with the one before.

    Shorter suffixes share less than least bytes with any other, so they are left out. Suffixes are sorted as rows padded with
    zeros; of those that differ in zeros at their end only, the shorter comes first.
    """
    lengths = np.array([len(p) for p in pieces])
    width = int(lengths.max())
    data = np.zeros((len(pieces), 2 * width), np.uint8)
    data[np.arange(2 * width) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
    counts = np.maximum(0, lengths - least + 1)
    piece = np.repeat(np.arange(len(pieces)), counts)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = lengths[piece] - place
    by_length = np.argsort(left, kind="stable")
    rows = np.lib.stride_tricks.sliding_window_view(data.ravel(), width)[(piece * 2 * width + place)[by_length]]
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows, order = rows[order], by_length[order]
    piece, place, left = piece[order], place[order], left[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return piece, place, np.r_[0, np.minimum(common, np.minimum(left[1:], left[:-1]))]


def repeat_intervals(pieces: list[bytes], arrays: tuple[np.ndarray, ...], least: int, times: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(length, low, high): the places low to high, high left out, of the suffix array whose suffixes are the occurrences of a maximal repeat.

    An interval comes before those that contain it, which are of shorter repeats. times says how often each piece occurs.
    """
    piece, place, common = arrays
    # The byte before each suffix; the start of a piece counts as a byte of its own.
    starts = np.cumsum([0, *map(len, pieces)])[:-1]
    joined = np.frombuffer(b"".join(pieces), np.uint8)
    before = np.where(place > 0, joined[np.clip(starts[piece] + place - 1, 0, len(joined) - 1)].astype(np.int64), 256 + np.arange(len(piece)))
    if times is not None:
        # A whole piece of several occurrences is a leaf with as many members, whatever precedes each of them.
        for leaf in np.flatnonzero((place == 0) & (np.array(times)[piece] > 1)).tolist():
            yield len(pieces[piece[leaf]]), leaf, leaf + 1
    long = np.flatnonzero(common >= least)
    for run in np.split(long, np.flatnonzero(np.diff(long) > 1) + 1) if len(long) else ():
        yield from _intervals(int(run[0]) - 1, common[run].tolist(), before[run[0] - 1 : run[-1] + 1].tolist())


def _intervals(base: int, common: list[int], before: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of one run: suffixes base.. whose neighbours share common bytes; a left byte of -1 means several."""
    stack: list[list[int]] = []  # shared length, left end, left byte
    for k, shared in enumerate([*common, 0]):
        left, byte = k, before[k]
        while stack and stack[-1][0] > shared:
            length, start, own = stack.pop()
            own = own if own == byte else -1
            if own == -1:
                yield length, base + start, base + k + 1
            left, byte = start, own
        if stack and stack[-1][0] == shared:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else -1
        elif shared:
            stack.append([shared, left, byte])


def maximal_repeats(pieces: list[bytes], least: int, times: list[int] | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(piece, place)...]) of each maximal repeat of least bytes or more within and across pieces.

    A repeat is maximal if not all of its occurrences go on with the same byte, nor are preceded by the same byte; the
    ends of a piece differ from everything. Occurrences are all there are, not only neighbours in the order; where a piece
    occurs several times, one entry stands for all of these.
    """
    if max(map(len, pieces), default=0) >= least:
        piece, place, common = suffix_array(pieces, least)
        for length, low, high in repeat_intervals(pieces, (piece, place, common), least, times):
            yield length, list(zip(piece[low:high].tolist(), place[low:high].tolist()))


def covered(pieces: list[bytes], least: int, times: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, stop): the merged ranges of bytes that maximal repeats cover."""
    piece, place, common = suffix_array(pieces, least)
    longest = np.zeros(len(piece), np.int64)
    for length, low, high in repeat_intervals(pieces, (piece, place, common), least, times):
        # Longer repeats come first, and what they cover of a suffix holds what shorter ones cover.
        inside = longest[low:high]
        inside[inside == 0] = length
    at = np.flatnonzero(longest)
    at = at[np.lexsort((place[at], piece[at]))]
    width = 2 * max(map(len, pieces))
    start = piece[at] * width + place[at]
    stop = np.maximum.accumulate(start + longest[at])
    first = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]]) if len(at) else np.zeros(0, np.int64)
    of = piece[at[first]]
    return of, start[first] - of * width, stop[np.r_[first[1:], len(at)] - 1 if len(at) else first] - of * width


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Where an occurrence lies in one number: the first window's start, windows less one, the anchor's offset.
def packed(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (first << 16) + (last - first << 8) + (place - first)


def anchor_place() -> Column:
    return F.shiftright("at", 16) + F.col("at").bitwiseAND(F.lit(255))


def numbered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A stored table (no, id, packed) with a number of its own for each row and its text compressed."""
    import zstandard

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([pack(t.as_py()) for t in batch["text"]], pa.binary())], ["id", "packed"])

    out = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("packed", T.BinaryType())])
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(f"`{text_column}`").cast("binary").alias("text")).mapInArrow(squeezed, out)
    return stored(rows.select(F.monotonically_increasing_id().alias("no"), "id", "packed"), "texts", TEXT_ROWS)


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(t.as_py()) for t in batch["packed"])


def _occurrences(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    names = ["key", "ctx", "no", "at"]
    for batch in batches:
        rows: list[pa.RecordBatch] = []
        size = 0
        for no, content in zip(batch["no"].to_pylist(), _unpacked(batch)):
            key, place, first, last = anchors(content, least)
            if not len(key):
                continue
            ctx = np.array([xxhash.xxh64_intdigest(content[a : b + least], p) for a, b, p in zip(first.tolist(), last.tolist(), (place - first).tolist())], np.uint64)
            rows.append(pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(np.full(len(key), no)), pa.array(packed(first, last, place))], names))
            size += rows[-1].nbytes
            if size > BATCH_BYTES:
                yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
                rows, size = [], 0
        if rows:
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches()


#: A piece of an anchor: where it stands in the tree of halvings, how often it occurs, its bytes before the anchor, and all of them.
PIECE = "core long, same long, times long, lead int, context binary"


def _pieces(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The pieces that rows (packed, wanted) name."""
    names = ["core", "same", "times", "lead", "context"]
    for batch in batches:
        wanted = batch["wanted"]
        limits = np.asarray(wanted.offsets).tolist()
        core, same, times, at = (np.asarray(wanted.values.field(c)) for c in ("key", "ctx", "n", "at"))
        first, span = at >> 16, at >> 8 & 255
        held, size, begin = [], 0, limits[0]

        def emitted(a: int, b: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(core[a:b]), pa.array(same[a:b]), pa.array(times[a:b]), pa.array((at[a:b] & 255).astype(np.int32)), pa.array(held, pa.binary())], names)

        for k, content in enumerate(_unpacked(batch)):
            for i in range(limits[k], limits[k + 1]):
                held.append(content[first[i] : first[i] + span[i] + least])
                size += len(held[-1])
            if size > BATCH_BYTES:
                yield emitted(begin, limits[k + 1])
                held, size, begin = [], 0, limits[k + 1]
        if held:
            yield emitted(begin, limits[-1])


SPAN = "core long, same long, start int, stop int"


def _compared(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(core, same, start, stop): what repeats cover of each piece, counted from its anchor. Rows arrive sorted by core."""
    names = ["core", "same", "start", "stop"]

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        core, same, lead = (np.asarray(rows[c]) for c in ("core", "same", "lead"))
        of, start, stop = covered(rows["context"].to_pylist(), least, rows["times"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(core[of]), pa.array(same[of]), pa.array((start - lead[of]).astype(np.int32)), pa.array((stop - lead[of]).astype(np.int32))], names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            held.append(batch.slice(at, TOGETHER))
            rows = pa.Table.from_batches(held)
            core = np.asarray(rows["core"])
            whole = int(np.searchsorted(core, core[-1]))
            held = rows.slice(whole).combine_chunks().to_batches()
            if whole:
                yield from search(rows.slice(0, whole))
    if held and sum(b.num_rows for b in held):
        yield from search(pa.Table.from_batches(held))


def halved(level: DataFrame, least: int) -> DataFrame:
    """Pieces (key, ctx, a, b, times, lead, context) of windows a..b before their anchor, cut into those of either half.

    core names the bytes that all windows of a half share, same the whole piece of this context's windows in it.
    """
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = []
    for a, b in ((F.col("a"), middle), (middle + 1, F.col("b"))):
        low, high = F.greatest(a, F.col("lead") + least - F.length("context")), F.least(b, F.col("lead"))
        context = F.substring("context", F.col("lead") - high + 1, high - low + least)
        core = F.substring("context", F.col("lead") - a + 1, a - b + least)
        parts.append(
            level.filter(low <= high).select(
                F.xxhash64(a, b, core).alias("core"), F.xxhash64(high, context).alias("same"), "key", "ctx", a.alias("a"), b.alias("b"), "times", high.cast("int").alias("lead"), context.alias("context")
            )
        )
    return parts[0].unionByName(parts[1])


def _searched(pieces: DataFrame, least: int) -> DataFrame:
    """The ranges (core, same, start, stop) that repeats cover of pieces with few under each core."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.select("core", "same", "times", "lead", "context").repartition(parts, "core").sortWithinPartitions("core")
    return dealt.mapInArrow(lambda b: _compared(b, least), SPAN)


def repeated_spans(texts: DataFrame, least: int = LEAST, contexts: int = CONTEXTS) -> DataFrame:
    """(no, start, stop): bytes of texts (no, packed) that a string of least bytes covers which also starts elsewhere."""
    rows = texts.select("no", "packed")
    found = stored(rows.mapInArrow(lambda b: _occurrences(b, least), "key long, ctx long, no long, at long"), "occurrences")
    again = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    met = stored(found.join(again, "key"), "anchors")
    released(found)
    groups = stored(met.groupBy("key", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("no", "at")).alias("one")), "contexts")
    kinds = groups.groupBy("key").agg(F.count("*").alias("kinds"))
    each = stored(groups.join(kinds, "key").select("key", "ctx", "n", "one.no", "one.at", (F.col("kinds") > contexts).alias("many")), "pieces")
    released(groups)

    def cut(some: DataFrame) -> DataFrame:
        # A text has no more pieces than anchors.
        wanted = some.groupBy("no").agg(F.collect_list(F.struct("key", "ctx", "n", "at")).alias("wanted"))
        return rows.join(wanted, "no").select("packed", "wanted").mapInArrow(lambda b: _pieces(b, least), PIECE)

    spans = stored(_searched(cut(each.filter("not many")), least).withColumnsRenamed({"core": "key", "same": "ctx"}), "spans")
    if not (many := each.filter("many")).isEmpty():
        whole = cut(many).select(F.lit(0).alias("a"), F.lit(least - GRAM).alias("b"), F.col("core").alias("key"), F.col("same").alias("ctx"), "times", "lead", "context")
        level = stored(halved(whole, least), "halves")
        while True:
            alike = level.groupBy("core", "same").agg(F.sum("times").alias("times"), F.first(F.struct("lead", "context")).alias("one")).select("core", "same", "times", "one.lead", "one.context")
            alike = stored(alike, "halves-alike")
            kinds = stored(alike.groupBy("core").agg(F.count("*").alias("kinds")), "kinds")
            few = alike.join(kinds.filter(F.col("kinds") <= contexts).select("core"), "core")
            ranges = _searched(few, least)
            spans = spans.unionByName(stored(level.select("core", "same", "key", "ctx").join(ranges, ["core", "same"]).select("key", "ctx", "start", "stop"), "spans"))
            # One window is one piece, so these can be halved.
            left = level.join(kinds.filter(F.col("kinds") > contexts).select("core"), "core").drop("core", "same")
            if left.isEmpty():
                break
            level = stored(halved(left, least), "halves")
    start = anchor_place()
    return met.join(spans, ["key", "ctx"]).select("no", (start + F.col("start")).alias("start"), (start + F.col("stop")).alias("stop"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, contexts: int = CONTEXTS, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs, with spans and kept bytes where with_text is true.

    Texts count as UTF-8 bytes, a null one as empty; a text shorter than least has nothing to remove. All occurrences go, the first
    one too. Repeated rows remove each other. Each row counts for itself, so ids may be null or shared and of any type; other
    columns may have any names. Texts may be of any length that a row can have. An empty table gives no rows.
    """
    texts = numbered(docs, id_column, text_column)
    spans = repeated_spans(texts, least, contexts)
    of = spans.groupBy("no").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = texts.join(of, "no", "left").select("id", "packed", "spans")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["removed", "kept"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, marks in zip(_unpacked(batch), batch["spans"]):
                ranges = merged(list(zip(*(marks.values.field(c).to_pylist() for c in ("start", "stop"))))) if marks.is_valid else []
                ends = [0, *[x for r in ranges for x in r], len(content)]
                kept = b"".join([content[a:b] for a, b in zip(ends[::2], ends[1::2])]) if ranges else content
                out.append((len(content), len(content) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), [list(r) for r in ranges], kept)[: len(names)])
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)]], ["id", *names])

    kinds = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", removed array<array<long>>, kept binary" * with_text)
    out = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *kinds])
    return joined.mapInArrow(cut, out).select(F.col("id").alias(id_column), *names)

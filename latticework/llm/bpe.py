"""Byte-level BPE encoding and decoding with a public vocabulary.

Texts of a batch lie in one array of code points; classes of neighbouring characters say where words begin. Distinct words
are merged once for each batch: words of one number of parts stand in the rows of contiguous arrays that hold each part and the
rank of each adjacent pair; the lowest rank of each row is found by scanning, its boundary is deleted and the two neighbouring
ranks are refreshed, for all rows of that width at once. Long words would cost the square of their length that way; they
take a heap. Decoding looks up the bytes of each id.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import text_or_empty

#: What byte-level BPE takes for letters, numbers and white space, and the endings that are words of their own (fixed values of the format).
CLASSES = (r"\s", r"\p{L}", r"\p{N}")
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE, LETTER, NUMBER, OTHER = range(4)
NO_RANK = 1 << 30
#: Bytes of a word up to which its ranks are scanned, and characters of text that are encoded together.
SHORT, TOGETHER = 128, 1 << 18
#: A space that begins a word, whatever stands before and after: long texts may be cut there.
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Odd multipliers of hashes.
MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
POWERS = np.cumprod(np.full(1024, MIX_2))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 as itself, the others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    """The class of each code point."""
    of = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for k, pattern in enumerate(CLASSES):
        for m in regex.finditer(f"{pattern}+", every):
            of[ord(m[0][0]) : ord(m[0][-1]) + 1] = k
    return of


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] numbers, then count[1] numbers from first[1], and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


class PairTable:
    """Ranks of pairs of ids in an open-addressing table; all pairs of a call are probed at once."""

    BITS = 18

    def __init__(self, pairs: list[tuple[int, int]]):
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        self.key, self.rank = np.full(1 << self.BITS, -1), np.full(1 << self.BITS, NO_RANK)
        left, step, self.probes = np.arange(len(key)), 0, 0
        while len(left):
            slot = self._slot(key[left], step)
            free = self.key[slot] < 0
            self.key[slot[free]] = key[left[free]]
            placed = self.key[slot] == key[left]
            self.rank[slot[placed]] = left[placed]
            left, step = left[~placed], step + 1
        self.probes = step

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        return ((key.astype(np.uint64) * MIX_1 >> np.uint64(64 - self.BITS)).astype(np.int64) + step) & ((1 << self.BITS) - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        slot = self._slot(key, 0)
        found = np.where(self.key[slot] == key, self.rank[slot], NO_RANK)
        # Those that met another key look on until a free slot.
        open_ = np.flatnonzero((self.key[slot] != key) & (self.key[slot] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            slot = self._slot(key[open_], step)
            hit = self.key[slot] == key[open_]
            found[open_[hit]] = self.rank[slot[hit]]
            open_ = open_[~hit & (self.key[slot] >= 0)]
        return found


class Codec:
    """Encodes and decodes texts by the vocabulary, merges and added tokens of a tokenizer file's contents."""

    def __init__(self, content: str):
        file = json.loads(content)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.vocab = {raw(token): i for token, i in file["model"]["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.ranks = {(raw(left), raw(right)): rank for rank, (left, right) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.classes = character_classes()
        self.first = np.array([self.vocab[bytes([b])] for b in range(256)])
        self.rank_of = PairTable([(self.vocab[a], self.vocab[b]) for a, b in self.ranks])
        self.made = np.array([self.vocab[a + b] for a, b in self.ranks])
        # Bytes of each id, one after another, and its digits with a comma in a row of fixed width, zeros left over.
        bytes_of = {i: token for token, i in self.vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        tokens = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.size = np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        width = len(str(len(tokens))) + 1
        self.digits = np.frombuffer("".join(f"{i},".ljust(width, "\0") for i in range(len(tokens))).encode(), np.uint8).reshape(-1, width)
        self.shown = (self.digits != 0).sum(axis=1)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, count, ids): the ids of each word lie in ids from start on."""
        sizes = np.array([len(w) for w in words], np.int64)
        found = self._scanned(words, sizes)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            found.append((np.array([i]), np.array([[self.vocab[part] for part in self._heaped(words[i])]])))
        count = np.zeros(len(words), np.int64)
        for row, parts in found:
            count[row] = parts.shape[1]
        start = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int64)
        for row, parts in found:
            ids[start[row][:, None] + np.arange(parts.shape[1])] = parts
        return start, count, ids

    def _scanned(self, words: list[bytes], sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places of words of SHORT bytes at most, with a row of ids for each, by number of ids."""
        order = np.argsort(sizes, kind="stable")
        limits = np.searchsorted(sizes[order], np.arange(SHORT + 2))
        found = []
        row, parts, ranks = np.empty(0, np.int64), np.empty((0, SHORT + 1), np.int64), np.empty((0, SHORT), np.int64)
        # Each merge leaves a row one part shorter, so rows that come down meet the words that begin at that width.
        for width in range(SHORT, 0, -1):
            new = order[limits[width] : limits[width + 1]]
            if len(new):
                fresh = self.first[np.frombuffer(b"".join([words[i] for i in new.tolist()]), np.uint8).reshape(-1, width)]
                row, parts = np.r_[row, new], np.concatenate([parts[:, :width], fresh])
                ranks = np.concatenate([ranks[:, : width - 1], self.rank_of(fresh[:, :-1].ravel(), fresh[:, 1:].ravel()).reshape(len(new), width - 1)])
            if not len(row):
                continue
            if width == 1:
                found.append((row, parts))
                break
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(row)), at]
            if (ended := low == NO_RANK).any():
                found.append((row[ended], parts[ended]))
                row, parts, ranks, at, low = (x[~ended] for x in (row, parts, ranks, at, low))
            n, k = np.arange(len(row)), np.arange(width)
            parts[n, at] = self.made[low]
            parts = parts[k != at[:, None] + 1].reshape(len(row), width - 1)
            ranks = ranks[k[:-1] != at[:, None]].reshape(len(row), width - 2)
            for has, shift in ((np.flatnonzero(at > 0), -1), (np.flatnonzero(at < width - 2), 0)):
                i = at[has] + shift
                ranks[has, i] = self.rank_of(parts[has, i], parts[has, i + 1])
        return found

    def _heaped(self, word: bytes) -> list[bytes]:
        n, get = len(word), self.ranks.get
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]), NO_RANK)) < NO_RANK]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] is not left or j >= n or parts[j] is not right:
                continue
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := get((parts[a], parts[b]), NO_RANK)) < NO_RANK:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def word_starts(self, codes: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Where words begin; opens marks the first characters of pieces, which no word crosses."""
        kind = self.classes[codes]
        white = kind == WHITE
        run = opens.copy()
        run[1:] |= kind[1:] != kind[:-1]
        follows = np.r_[~opens[1:], False]  # the next character belongs to the same piece
        after_space = np.r_[False, codes[:-1] == 32] & ~opens
        last_white = white & follows & np.r_[~white[1:], False]
        # The last white space before a word stands alone or, if it is a space, begins that word.
        starts = (run & ~(after_space & ~white)) | last_white
        mark = np.flatnonzero((codes == 39) & starts & follows)
        mark = mark[kind[mark + 1] == LETTER]
        if len(mark):
            padded = np.r_[codes, np.zeros(2, codes.dtype)]
            two = mark[follows[mark + 1]]
            for ending in ENDINGS:
                at = mark if len(ending) == 1 else two
                for k, c in enumerate(ending):
                    at = at[padded[at + 1 + k] == ord(c)]
                starts[at + 1] = False
                ends = at + 1 + len(ending)
                starts[ends[ends < len(codes)]] = True
        return np.flatnonzero(starts)

    def _distinct(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, which): one word of each spelling, and for each word which of these it equals."""
        offset = spread(np.zeros_like(size), size)
        h = (codes.astype(np.uint64) + np.uint64(1)) * MIX_1
        h ^= h >> np.uint64(31)
        _, first, which = np.unique(np.add.reduceat(h * POWERS[offset & 1023], start), return_index=True, return_inverse=True)
        like = first[which]
        if (size == size[like]).all() and (codes == codes[offset + np.repeat(start[like], size)]).all():
            return first, which
        # Unlike words of one hash: complete spellings decide.
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(codes[a : a + n].tobytes(), len(seen)) for a, n in zip(start.tolist(), size.tolist())])
        return np.unique(which, return_index=True)[1], which

    def pieces_coded(self, pieces: list[str], fixed: dict[int, int]) -> list[tuple[int, bytes, bytes]]:
        """(ids, their digits with commas, what they decode to) of each piece; fixed has the id of pieces that are added tokens."""
        joined = "".join(pieces)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = np.cumsum([0, *map(len, pieces)])
        if not len(codes):
            return [(0, b"", b"")] * len(pieces)
        opens = np.zeros(len(codes), bool)
        opens[begin[:-1][begin[:-1] < len(codes)]] = True
        start = self.word_starts(codes, opens)
        size = np.diff(np.r_[start, len(codes)])
        first, which = self._distinct(codes, start, size)
        at, count, ids = self.merged([joined[a : a + n].encode() for a, n in zip(start[first].tolist(), size[first].tolist())])
        if fixed:
            own = np.searchsorted(start, begin[list(fixed)])
            which[own] = len(at) + np.arange(len(own))
            at, count, ids = np.r_[at, len(ids) + np.arange(len(own))], np.r_[count, np.ones(len(own), np.int64)], np.r_[ids, list(fixed.values())]
        words = np.searchsorted(start, begin)
        count = count[which]
        tokens = ids[spread(at[which], count)]
        limits = np.r_[0, np.cumsum(count)][words]
        digits = self.digits[tokens]
        digits = digits[digits != 0].tobytes()
        decoded = self.bytes[spread(self.start[tokens], self.size[tokens])].tobytes()
        d, b = (np.r_[0, np.cumsum(x[tokens])][limits].tolist() for x in (self.shown, self.size))
        n = np.diff(limits).tolist()
        return [(n[k], digits[d[k] : d[k + 1]], decoded[b[k] : b[k + 1]]) for k in range(len(pieces))]

    def coded(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, ids as decimals joined by commas, the bytes that they decode to) of each whole text.

        An added token's own spelling gives its id, as in the library.
        """
        pieces, fixed, ends, begun, size = [], {}, [], [], 0

        def flush() -> Iterator[tuple[int, bytes, bytes]]:
            found, begin = self.pieces_coded(pieces, fixed), 0
            for end in ends:
                yield self._joined([*begun, *found[begin:end]])
                begun.clear()
                begin = end
            begun.extend(found[begin:])
            pieces.clear()
            fixed.clear()
            ends.clear()

        for text in texts:
            for piece in self._pieces(text):
                if isinstance(piece, int):
                    fixed[len(pieces)] = piece
                    piece = "x"
                pieces.append(piece)
                size += len(piece)
                if size > TOGETHER:
                    yield from flush()
                    size = 0
            ends.append(len(pieces))
        yield from flush()

    def _joined(self, parts: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
        return sum(p[0] for p in parts), b"".join([p[1] for p in parts]).removesuffix(b","), b"".join([p[2] for p in parts])

    def _pieces(self, text: str) -> Iterator[str | int]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._cut(text[at : m.start()])
            yield self.added[m[0]]
            at = m.end()
        yield from self._cut(text[at:])

    def _cut(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > TOGETHER and (m := SINGLE_SPACE.search(text, at + TOGETHER)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]


_codecs: dict[int, Codec] = {}


def _codec(content: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    if (key := hash(content)) not in _codecs:
        _codecs[key] = Codec(content)
    return _codecs[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, with ids and decoded text where with_ids is true.

    vocabulary is the path of a tokenizer file on the driver; its contents, of fixed size, go to the executors.
    A null or empty text has no tokens and decodes to the empty text. Each row is encoded alone, so repeated rows, ties and
    other columns change nothing, whatever their names, and an empty table gives no rows. Whole texts are encoded, however
    long; the id may be of any type and its column of any name.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(content.value)
        for batch in batches:
            found = []
            for n, ids, raw in codec.coded(t.as_py() for t in batch["text"]):
                decoded = raw.decode("utf-8", "replace")
                row = (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                found.append((*row, ids.decode(), decoded) if with_ids else row)
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * len(names), [pa.int64()] + [pa.string()] * 4)]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns], ["id", *names])

    out = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *[T.StructField(n, T.LongType() if n == "n_tokens" else T.StringType()) for n in names]])
    coded = docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(f"`{text_column}`").alias("text")).mapInArrow(run, out)
    return coded.select(F.col("id").alias(id_column), *names)

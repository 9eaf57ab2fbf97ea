"""Alignment of two tokenizers: which tokens of one share bytes with which of the other, and how often over all documents.

The tokens of both sides lie in flat arrays with their end offsets in bytes. One state vector holds a pointer into each side for
every lane of a batch; a step compares the two ends of all lanes at once, emits the pair under the pointers as a link and, where
the ends are equal, a cut, and advances the side that ends first or both. Finished lanes are compacted away. A lane is a document;
a long one is cut into several at spaces between words, which are ends on both sides.

Groups between cuts with several tokens on both sides link all their pairs, also those that share no byte; those are added after.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.bpe import byte_letters, default_vocabulary, spread
from latticework.llm.common import TEXT_ROWS, released, stored, text_or_empty

#: Bytes of text aligned together, A tokens of a lane, spellings that a worker keeps.
TOGETHER, LANE, KEPT = 1 << 21, 512, 400_000
#: The words of byte-level BPE (fixed pattern of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of a group that are listed one by one; larger groups count their distinct ids first.
LISTED = 1 << 14
#: First bytes of characters some of which are white space, besides ASCII: of two bytes and of three.
WHITE_2, WHITE_3 = (0xC2,), (0xE1, 0xE2, 0xE3)
ASCII_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
MAY_BE_WHITE = ASCII_WHITE | np.isin(np.arange(256), WHITE_2 + WHITE_3)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def cut_spaces(codes: np.ndarray) -> np.ndarray:
    """Places of single spaces between characters that aren't white space: a token begins there on both sides, whatever stands around.

    A space beside a character whose first byte some white space has is left out, which costs no more than a longer spelling.
    """
    at = np.flatnonzero(codes[1:-1] == 32) + 1
    before = MAY_BE_WHITE[codes[at - 1]] | np.isin(codes[at - 2], WHITE_2) | np.isin(codes[at - 3], WHITE_3)
    return at[~before & ~MAY_BE_WHITE[codes[at + 1]]]


def low_bits(pieces: sentencepiece.SentencePieceProcessor) -> int:
    return (pieces.get_piece_size() - 1).bit_length()


class Tokens:
    """Ids of both sides for each spelling, in flat arrays that grow."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.start = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.count = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.sound = np.empty(0, bool)

    def add(self, ids: list[np.ndarray], count: list[np.ndarray], sound: np.ndarray) -> None:
        for side in (0, 1):
            self.start[side] = np.r_[self.start[side], len(self.ids[side]) + np.cumsum(count[side]) - count[side]]
            self.count[side] = np.r_[self.count[side], count[side]]
            self.ids[side] = np.r_[self.ids[side], ids[side]]
        self.sound = np.r_[self.sound, sound]


class Aligner:
    """Tokens, groups and links of whole texts under a byte-level vocabulary (A) and a piece model (B)."""

    def __init__(self, vocabulary: str, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        from tokenizers import Tokenizer

        letters = byte_letters()
        file = json.loads(vocabulary)
        self.a = Tokenizer.from_str(vocabulary)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        of_a = {i: bytes(letters[c] for c in t) for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in file["added_tokens"]}
        self.ranks = self._ranks(file, of_a)
        of_b = {i: self._piece(i) for i in range(self.b.get_piece_size())}
        tokens = [[of.get(i, b"") for i in range(max(of) + 1)] for of in (of_a, of_b)]
        self.size = [np.array([len(t) for t in of]) for of in tokens]
        self.first = [np.cumsum(n) - n for n in self.size]
        self.bytes = [np.frombuffer(b"".join(of), np.uint8) for of in tokens]
        #: A pair's key has B's id in its lowest bits.
        self.bits = low_bits(self.b)
        width = len(str(max(map(len, tokens)) - 1))
        self.digits = np.frombuffer("".join(f"{i}".ljust(width, "\0") + "," for i in range(max(map(len, tokens)))).encode(), np.uint8).reshape(-1, width + 1)
        # Where a piece goes on over a space, texts can't be cut at spaces.
        self.cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.tokens = Tokens()

    def _ranks(self, file: dict, of_a: dict[int, bytes]) -> tiktoken.Encoding | None:
        """A faster encoder of the same ids, where ids follow the merges and words are found by the usual pattern."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        number = file["model"]["vocab"]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        followed = all(number.get("".join(m)) == 256 + k for k, m in enumerate(pairs)) and len(number) == 256 + len(pairs)
        if not followed or file["normalizer"] or not usual.items() <= (file["pre_tokenizer"] or {}).items():
            return None
        return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks={of_a[i]: i for i in number.values()}, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _slices(self, text: bytes) -> Iterator[bytes]:
        """The text with a space before it, cut before single spaces into slices of about TOGETHER bytes."""
        text, at = b" " + text, 0
        while self.cuts and len(text) - at > TOGETHER:
            found = cut_spaces(np.frombuffer(text, np.uint8, min(len(text) - at, 2 * TOGETHER), at))
            found = found[found >= TOGETHER // 2]
            if not len(found):
                break
            yield text[at : at + found[0]]
            at += int(found[0])
        yield text[at:]

    def _spelled(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place of each spelling in the flat arrays, number of spellings of each slice); new spellings are encoded once."""
        whole = b"".join(slices)
        begin = np.cumsum([0, *map(len, slices)])
        opens = np.zeros(len(whole), bool)
        opens[begin[:-1]] = True
        if self.cuts:
            opens[cut_spaces(np.frombuffer(whole, np.uint8))] = True
        starts = np.flatnonzero(opens)
        offsets = np.r_[starts, len(whole)].astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(whole)).dictionary_encode()
        known = self.tokens.known
        places = np.array([known.setdefault(w, len(known)) for w in words.dictionary.to_pylist()], np.int64)
        if len(known) > len(self.tokens.sound):
            self._encode(list(islice(reversed(known), len(known) - len(self.tokens.sound)))[::-1])
        return places[words.indices.to_numpy()], np.add.reduceat(opens, begin[:-1], dtype=np.int64)

    def _encode(self, new: list[str]) -> None:
        """Encodes spellings; on side A those that begin and end as between two cuts as one text, the others each alone."""
        raw = [w.encode() for w in new]
        plain = np.array([self.cuts and len(w) > 3 and not (MAY_BE_WHITE[w[1]] or ASCII_WHITE[w[-1]] or w[-2] in WHITE_2 or w[-3] in WHITE_3) for w in raw], bool)
        joint = np.array(self._a_ids(["".join([w for w, p in zip(new, plain.tolist()) if p])])[0], np.int64)
        ends = np.cumsum([len(w) for w, p in zip(raw, plain.tolist()) if p])
        upto = np.searchsorted(np.cumsum(self.size[0][joint]), ends, "right")
        alone = self._a_ids([w for w, p in zip(new, plain.tolist()) if not p])
        flat = np.r_[joint, np.fromiter(chain.from_iterable(alone), np.int64)]
        count = np.r_[np.diff(np.r_[0, upto]), np.fromiter(map(len, alone), np.int64, len(alone))].astype(np.int64)
        at = np.argsort(np.argsort(~plain, kind="stable"), kind="stable")
        pieces = self.b.encode([w[1:] for w in new], num_threads=1)
        counts = [count[at], np.fromiter(map(len, pieces), np.int64, len(pieces))]
        ids = [flat[spread((np.cumsum(count) - count)[at], count[at])], np.fromiter(chain.from_iterable(pieces), np.int64)]
        wanted, sound = b"".join(raw), np.ones(len(new), bool)
        spelt = [self._spelt(k, ids[k]) for k in (0, 1)]
        if spelt != [wanted, wanted]:
            own = [np.r_[0, np.cumsum(self.size[k][ids[k]])][np.r_[0, np.cumsum(counts[k])]].tolist() for k in (0, 1)]
            sound = np.array([all(spelt[k][own[k][i] : own[k][i + 1]] == w for k in (0, 1)) for i, w in enumerate(raw)], bool)
        self.tokens.add(ids, counts, sound)

    def _a_ids(self, texts: list[str]) -> list[list[int]]:
        if self.ranks:
            return [self.ranks.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelt(self, side: int, ids: np.ndarray) -> bytes:
        return self.bytes[side][spread(self.first[side][ids], self.size[side][ids])].tobytes()

    def aligned(self, texts: Iterable[str]) -> Iterator[list[dict]]:
        """Lists of documents' results, in order, as each lot of texts ends: n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""
        lot, owner, open_, size = [], [], [], 0

        def flush() -> list[dict]:
            if lot:
                self._lot(lot, np.array(owner), open_)
            done = [_result(d) for d in open_[:-1]]
            del open_[:-1]
            lot.clear()
            owner.clear()
            if len(self.tokens.known) > KEPT or len(self.tokens.ids[0]) > 8 * KEPT:
                self.tokens = Tokens()
            return done

        for text in texts:
            open_.append({"sound": bool(text), "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": hashlib.sha256(), "parts": []})
            for part in self._slices(text.encode()) if text else ():
                lot.append(part)
                owner.append(len(open_) - 1)
                size += len(part)
                if size > TOGETHER:
                    if done := flush():
                        yield done
                    size = 0
        open_.append({})
        if done := flush():
            yield done

    def _lot(self, lot: list[bytes], owner: np.ndarray, docs: list[dict]) -> None:
        """Aligns a lot of slices and adds what it finds to their documents, owner[k] for each slice."""
        place, spellings = self._spelled(lot)
        doc = np.repeat(owner, spellings)
        tokens = self.tokens
        bad = np.unique(doc[~tokens.sound[place]])
        for d in bad.tolist():
            docs[d]["sound"] = False
        if len(bad):
            keep = ~np.isin(doc, bad)
            place, doc = place[keep], doc[keep]
        if not len(place):
            return
        count = [tokens.count[k][place] for k in (0, 1)]
        ids = [tokens.ids[k][spread(tokens.start[k][place], count[k])] for k in (0, 1)]
        ends = [np.cumsum(self.size[k][ids[k]]) for k in (0, 1)]
        first = [np.cumsum(c) - c for c in count]
        # A lane ends with its document, or where it has LANE tokens.
        opens = np.r_[True, doc[1:] != doc[:-1]]
        within = first[0] - np.repeat(first[0][opens], np.diff(np.r_[np.flatnonzero(opens), len(doc)]))
        opens[1:] |= within[1:] // LANE != within[:-1] // LANE
        at = np.flatnonzero(opens)
        cut_a, cut_b, link_a, link_b = lockstep(ends[0], ends[1], first[0][at], first[1][at], np.r_[first[0][at][1:], len(ids[0])])
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        n_a, n_b = np.diff(np.r_[-1, last_a]), np.diff(np.r_[-1, last_b])
        doc_a = np.repeat(doc, count[0])
        of_group = doc_a[last_a]
        pairs, times, of_pair = self._pairs(ids, doc_a, link_a, link_b, last_a, last_b, n_a, n_b)
        text, upto = self._text(ids, last_a, last_b, n_a, n_b)
        numbers = of_group[np.flatnonzero(np.r_[True, of_group[1:] != of_group[:-1]])]
        low, high = np.searchsorted(of_group, numbers), np.searchsorted(of_group, numbers, "right")
        pair_low, pair_high = np.searchsorted(of_pair, numbers), np.searchsorted(of_pair, numbers, "right")
        sums = [np.r_[0, np.cumsum(x)] for x in (n_a, n_b, n_a * n_b)]
        for k, d in enumerate(numbers.tolist()):
            i, j, of = low[k], high[k], docs[d]
            for name, s in zip(("n_a", "n_b", "n_links"), sums):
                of[name] += int(s[j] - s[i])
            # A document that goes on in the next lot has a separator between its groups there.
            of["sha"].update((b";" if of["n_groups"] else b"") + text[upto[i] : upto[j] - 1])
            of["n_groups"] += int(j - i)
            of["parts"].append((pairs[pair_low[k] : pair_high[k]], times[pair_low[k] : pair_high[k]]))

    def _pairs(self, ids, doc_a, link_a, link_b, last_a, last_b, n_a, n_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, times, document) of each distinct linked pair of ids of a document, by document."""
        wide = (n_a > 1) & (n_b > 1)
        key = ids[0] << self.bits
        # A document and a pair in one number.
        top = self.bits + (len(self.first[0]) - 1).bit_length()
        of_a = doc_a << top | key
        narrow = ~np.repeat(wide, n_a)[link_a]
        sets = [of_a[link_a[narrow]] | ids[1][link_b[narrow]]]
        listed = np.flatnonzero(wide & (n_a * n_b <= LISTED))
        if len(listed):
            # All pairs of a group, A by A.
            a = spread(last_a[listed] - n_a[listed] + 1, n_a[listed])
            of = np.repeat(listed, n_a[listed])
            b = spread(last_b[of] - n_b[of] + 1, n_b[of])
            sets.append(np.repeat(of_a[a], n_b[of]) | ids[1][b])
        found = np.sort(np.concatenate(sets))
        begin = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
        times = np.diff(np.r_[begin, len(found)])
        found = found[begin]
        large = np.flatnonzero(wide & (n_a * n_b > LISTED)).tolist()
        if large:
            sets, counts = [found], [times]
            for g in large:
                (a, many_a), (b, many_b) = (np.unique(x[last[g] - n[g] + 1 : last[g] + 1], return_counts=True) for x, last, n in ((of_a, last_a, n_a), (ids[1], last_b, n_b)))
                sets.append((a[:, None] | b).ravel())
                counts.append(np.outer(many_a, many_b).ravel())
            found, which = np.unique(np.concatenate(sets), return_inverse=True)
            # In whole numbers: sums of floats end at 2^53.
            times = np.zeros(len(found), np.int64)
            np.add.at(times, which, np.concatenate(counts))
        return found & ((1 << top) - 1), times, found >> top

    def _text(self, ids, last_a, last_b, n_a, n_b) -> tuple[bytes, np.ndarray]:
        """The groups as text, and where each begins: ids joined by commas, sides by a bar, each group with a semicolon after it."""
        count = np.stack([n_a, n_b], axis=1).ravel()
        start = np.stack([last_a - n_a + 1, len(ids[0]) + last_b - n_b + 1], axis=1).ravel()
        order = np.concatenate(ids)[spread(start, count)]
        shown = self.digits[order]
        ends = np.cumsum(count) - 1
        shown[ends[::2], -1] = ord("|")
        shown[ends[1::2], -1] = ord(";")
        full = shown != 0
        width = np.r_[0, np.cumsum(full.sum(axis=1))]
        return shown[full].tobytes(), width[np.r_[0, ends[1::2] + 1]]


def lockstep(end_a: np.ndarray, end_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, stop_a: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cut after each A token, cut after each B token, A of each link, B of each link) of lanes from at_a, at_b up to stop_a.

    Both sides of a lane cover the same bytes, so a lane's last step is a cut.
    """
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    a, b = at_a.copy(), at_b.copy()
    while len(a):
        links_a.append(a.copy())
        links_b.append(b.copy())
        left, right = end_a[a], end_b[b]
        both = left == right
        cut_a[a[both]] = True
        cut_b[b[both]] = True
        a += left <= right
        b += right <= left
        going = a < stop_a
        if not going.all():
            a, b, stop_a = a[going], b[going], stop_a[going]
    return cut_a, cut_b, np.concatenate(links_a), np.concatenate(links_b)


def _result(doc: dict) -> dict:
    if not doc["sound"]:
        return {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": np.empty(0, np.int64), "times": np.empty(0, np.int64)}
    pairs, times = (np.concatenate(x) for x in zip(*doc["parts"]))
    if len(doc["parts"]) > 1:
        pairs, which = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, which, times)
        times = sums
    return {k: doc[k] for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": doc["sha"].hexdigest(), "pairs": pairs, "times": times}


_aligners: dict[int, Aligner] = {}


def _aligner(vocabulary: str, pieces: bytes) -> Aligner:
    """One aligner for each Python worker and pair of tokenizers."""
    if (key := hash((vocabulary, pieces))) not in _aligners:
        _aligners[key] = Aligner(vocabulary, pieces)
    return _aligners[key]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def linked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """A stored row for each row of docs: id, chunk, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, chunk_pairs, chunk_docs.

    pairs are the keys of linked id pairs, times how often each is linked, both as little-endian numbers of 8 bytes. A chunk is
    the documents aligned together; its first row has the chunk's distinct pairs and in how many of its documents each is.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        side_a = f.read()
    with open(pieces or default_pieces(), "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast((side_a, f.read()))
    row = T.StructType([docs.schema[id_column]])
    out = T.StructType([T.StructField("id", row[0].dataType), T.StructField("chunk", T.LongType()), *[T.StructField(n, T.LongType()) for n in NUMBERS], T.StructField("groups_sha256", T.StringType())])
    out = out.add("pairs", T.BinaryType()).add("times", T.BinaryType()).add("chunk_pairs", T.ArrayType(T.LongType())).add("chunk_docs", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(*content.value)
        chunk = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for found in aligner.aligned(t.as_py() for t in batch["text"]):
                keys, in_docs = np.unique(np.concatenate([d["pairs"] for d in found]), return_counts=True)
                chunk += 1
                none = [None] * (len(found) - 1)
                columns = [pa.array([chunk] * len(found), pa.int64()), *[pa.array([d[n] for d in found], pa.int64()) for n in NUMBERS], pa.array([d["groups_sha256"] for d in found], pa.string())]
                columns += [pa.array([d["pairs"].astype("<i8").tobytes() for d in found], pa.binary()), pa.array([d["times"].astype("<i8").tobytes() for d in found], pa.binary())]
                columns += [pa.array([x, *none], pa.list_(pa.int64())) for x in (keys, in_docs)]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(at, len(found)), *columns], out.names)
                at += len(found)

    return stored(docs.select(F.col(f"`{id_column}`").alias("id"), text_or_empty(f"`{text_column}`").alias("text")).mapInArrow(run, out), "linked", TEXT_ROWS)


def pair_counts(links: DataFrame, bits: int) -> DataFrame:
    """(pair, docs, best): in how many documents of all each pair is linked, and whether no pair of its A id is in more."""
    each = links.filter("chunk_pairs IS NOT NULL").select(F.explode(F.arrays_zip("chunk_pairs", "chunk_docs")).alias("p")).select(F.col("p.chunk_pairs").alias("pair"), F.col("p.chunk_docs").alias("docs"))
    counts = stored(each.groupBy("pair").agg(F.sum("docs").alias("docs")), "pair_counts")
    a = F.shiftright("pair", bits)
    most = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return counts.join(most, a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _scored(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one chunk with n_best and count_sum, by the counts of the chunk's pairs."""
    key, count, best = (found[n].to_numpy(zero_copy_only=False) for n in ("pair", "docs", "best"))
    order = np.argsort(key)
    key, count, best = key[order], count[order], best[order]
    n_best, count_sum = [], []
    for pairs, times in zip(docs["pairs"], docs["times"]):
        at, times = np.searchsorted(key, np.frombuffer(pairs.as_py(), "<i8")), np.frombuffer(times.as_py(), "<i8")
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    return docs.drop_columns(["pairs", "times", "chunk"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for each row of docs.

    A is the byte-level vocabulary over a space and the text, B the piece model over the text, which adds that space. A text that is
    null or empty, or whose tokens of either side don't spell a space and the text, has no tokens: zeros and an empty digest. Every
    row counts as a document of its own, repeated rows too; ids may be null, repeated and of any type, their column and others of
    any name; an empty table gives no rows. Whole texts are aligned, however long. Pairs are counted over all documents; what a chunk needs
    of the counts comes to it by a join on the pair, each pair once for a chunk.
    """
    links = linked(docs, id_column, text_column, vocabulary, pieces)
    bits = low_bits(sentencepiece.SentencePieceProcessor(model_file=pieces or default_pieces()))
    wanted = links.filter("chunk_pairs IS NOT NULL").select(F.col("chunk").alias("of_chunk"), F.explode("chunk_pairs").alias("pair"))
    found = wanted.join(pair_counts(links, bits), "pair")
    out = T.StructType([links.schema["id"], *[T.StructField(n, T.LongType()) for n in NUMBERS], T.StructField("groups_sha256", T.StringType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    scored = links.drop("chunk_pairs", "chunk_docs").groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(_scored, out)
    return scored.select(F.col("id").alias(id_column), *NUMBERS, "n_best", "count_sum", "groups_sha256")

"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank: neighbours differ in few bits. Ranges of that order are the leaves that Spark deals
out. Of each leaf the bits that all its fingerprints share are factored out as a mask and a pattern, of groups of leaves again, and so on
up to a root. A fingerprint goes down these upper nodes with the differences added up from mask to mask, and a whole group is
dropped once they pass the limit; it visits the leaves that are left. Within a leaf its fingerprints form a tree of
the same kind, down to single ones, which visitors go down likewise. Each pair meets once, in the later one's leaf.

Links leave a leaf as a forest, never as all pairs; components() joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.close_copies import close_links
from latticework.llm.common import TEXT_ROWS, fields, picked, stored, text_or_empty
from latticework.operators.components import star_edges

BITS, SHINGLE, SEED = 2, 3, 42
#: Children of a node, leaves at least, and pairs held in one step.
FAN, LEAVES, FRONTIER = 8, 64, 1 << 19


def fingerprint(content: bytes, words_per_shingle: int = SHINGLE) -> int:
    """The fingerprint of one text in UTF-8; 0 if it has no word."""
    words = content.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - words_per_shingle + 1
    for at in range(0, n, 1 << 14):
        to = min(n, at + (1 << 14))
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + words_per_shingle - 1 : to + words_per_shingle - 1].tolist())], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Tree:
    """Nodes over things in Gray order that have a mask of bits and a pattern on it: of each level the masks, the patterns and, above the lowest, where children begin."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray):
        self.levels = [(mask, pattern, np.arange(len(mask) + 1))]
        while len(self.levels[-1][0]) > 1:
            mask, pattern, _ = self.levels[-1]
            starts = np.arange(0, len(mask), FAN)
            first = np.repeat(pattern[starts], np.diff(np.r_[starts, len(mask)]))
            differ = np.bitwise_or.reduceat((pattern ^ first) | ~mask, starts)
            self.levels.append((~differ, pattern[starts] & ~differ, np.r_[starts, len(mask)]))

    def reach(self, fp: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in fp, place of a thing) whose differences on the thing's mask, and so on any above it, are at most bits."""
        (mask, pattern, _), step = self.levels[-1], max(1, FRONTIER // FAN // 8)
        for at in range(0, len(fp), step):
            query = np.arange(at, min(len(fp), at + step))
            off = np.bitwise_count((fp[query] ^ pattern[0]) & mask[0]).astype(np.int64)
            near = off <= bits
            frontier = [(query[near], np.zeros(near.sum(), np.int64), off[near], len(self.levels) - 1)]
            while frontier:
                q, group, off, depth = frontier.pop()
                if not depth:
                    yield q, group
                    continue
                above, _, children = self.levels[depth]
                child_mask, child_pattern, _ = self.levels[depth - 1]
                width = children[group + 1] - children[group]
                if len(q) > 1 and width.sum() > FRONTIER:
                    half = len(q) // 2
                    frontier += [(q[:half], group[:half], off[:half], depth), (q[half:], group[half:], off[half:], depth)]
                    continue
                parent = np.repeat(np.arange(len(q)), width)
                child = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + children[group][parent]
                # What differs on the mask above has been counted there.
                new = child_mask[child] & ~above[group][parent]
                total = off[parent] + np.bitwise_count((fp[q[parent]] ^ child_pattern[child]) & new)
                near = total <= bits
                if near.any():
                    frontier.append((q[parent[near]], child[near], total[near], depth - 1))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the smallest row that the pairs connect it with."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest links within leaves; rows arrive by leaf, its own fingerprints in Gray order first, then its visitors."""
    leaf, own, tree = None, [], None

    def linked(fps: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        label = forest(len(fps), pairs)
        at = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[at].view(np.int64)), pa.array(fps[label[at]].view(np.int64))], ["src", "dst"])

    def planted() -> Iterator[pa.RecordBatch]:
        """Makes the leaf's tree of its own fingerprints, and gives their links."""
        nonlocal own, tree
        own = np.concatenate(own)
        tree = Tree(np.full(len(own), ~np.uint64(0)), own)
        yield linked(own, ((q[q > g], g[q > g]) for q, g in tree.reach(own)))

    for batch in batches:
        of, visits, fp = np.asarray(batch["leaf"]), batch["visits"].to_numpy(zero_copy_only=False), np.asarray(batch["fp"]).view(np.uint64)
        cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (visits[1:] != visits[:-1])]) if len(of) else ()
        for a, b in zip(cuts, np.r_[cuts[1:], len(of)] if len(of) else ()):
            if of[a] != leaf:
                if leaf is not None and tree is None:
                    yield from planted()
                leaf, own, tree = of[a], [], None
            if not visits[a]:
                own.append(fp[a:b])
                continue
            if tree is None:
                yield from planted()
            yield linked(np.r_[own, fp[a:b]], ((q + len(own), g) for q, g in tree.reach(fp[a:b])))
    if leaf is not None and tree is None:
        yield from planted()


def near_links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(src, dst) over distinct fingerprints fp (long) with their Gray rank (long): forests that connect what links."""
    parts = max(LEAVES, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    leaves = stored(distinct.select("fp", "rank").repartitionByRange(parts, "rank").withColumn("leaf", F.spark_partition_id()).coalesce(-(-parts // FAN)), "leaves")
    # A row for each range, of which there are as many as shuffle partitions, and LEAVES at least.
    shared = leaves.groupBy("leaf").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any")).orderBy("leaf").toArrow()
    number, ones, some = (np.asarray(shared[c]) for c in ("leaf", "ones", "any"))
    mask = ~(ones ^ some).view(np.uint64)
    sent = distinct.sparkSession.sparkContext.broadcast((number, mask, ones.view(np.uint64) & mask))

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, mask, pattern = sent.value
        upper = Tree(mask, pattern) if len(mask) else None
        for batch in batches:
            fp, rank, home = (np.asarray(batch[c]) for c in ("fp", "rank", "leaf"))
            for q, g in upper.reach(fp.view(np.uint64), bits) if len(fp) else ():
                later = number[g] >= home[q]
                q, leaf = q[later], number[g[later]]
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(leaf != home[q]), pa.array(rank[q]), pa.array(fp[q])], ["leaf", "visits", "rank", "fp"])

    dealt = leaves.mapInArrow(visiting, "leaf int, visits boolean, rank long, fp long").repartition("leaf").sortWithinPartitions("leaf", "visits", "rank")
    return dealt.select("leaf", "visits", "fp").mapInArrow(_links, "src long, dst long")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, text_hash, fp, rank) for each row of docs; a null text counts as empty."""
    text = text_or_empty(f"`{text_column}`")
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text_hash"], pa.array(fp.view(np.int64)), pa.array(gray_rank(fp).view(np.int64))], ["id", "text_hash", "fp", "rank"])

    return source.mapInArrow(run, f"id {docs.schema[id_column].dataType.simpleString()}, text_hash long, fp long, rank long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", close: bool = False) -> DataFrame:
    """(id, fingerprint, component_id, text_hash, root) for each row of docs.

    component_id is the smallest id reachable over links, null ids left out; a component of null ids only has null. root
    is a fingerprint that stands for the component. With close, texts of a Jaccard similarity of 0.8 over five words link too.
    Texts without words all have fingerprint zero. Repeated rows and equal texts share a fingerprint and meet there,
    before any search. Texts may be of any length, ids of any type that has an order; other columns are not read. An empty table
    gives no rows.
    """
    prints = stored(fingerprints(docs, id_column, text_column), "fingerprints", TEXT_ROWS)
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least"), F.first("rank").alias("rank")), "distinct-fingerprints")
    links = near_links(distinct)
    if close:
        text = text_or_empty(f"`{text_column}`")
        links = close_links(docs.select(F.xxhash64(text).alias("doc"), text.alias("text")), prints.select(F.col("text_hash").alias("doc"), "fp"), stored(links, "near-links"))
    roots = star_edges(links)
    rooted = distinct.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    # Only components of several fingerprints need another look.
    several = rooted.join(roots.select(F.col("component").alias("root")).distinct(), "root")
    named = several.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = several.join(named, "root").select("fp", "component_id", "root")
    single = rooted.join(roots.select(F.col("component").alias("root")).distinct(), "root", "left_anti").select("fp", F.col("least").alias("component_id"), "root")
    of = stored(linked.unionByName(single), "components")
    return prints.join(of, "fp").select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", close: bool = False) -> DataFrame:
    """The rows of docs that stay: of each component one row with the smallest id, columns as they are.

    Of repeated rows one stays, of several texts with that id the one of smallest hash. Rows without an id count as
    larger than any; where a component has no others, one of its rows stays. close is as in near_duplicates. Other columns may have any
    names. An empty table gives no rows.
    """
    found = near_duplicates(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")), "id", close=close)
    least = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", F.when(F.col("id").isNull(), F.col("root")).alias("alone"), "text_hash").agg(F.count("*").alias("key_rows"))
    stay = least.groupBy(F.col("id").alias("key_id"), "alone").agg(F.min(F.struct("text_hash", "key_rows")).alias("m")).select("key_id", F.col("m.text_hash").alias("key_h"), "m.key_rows")
    key = {"id": F.col(f"`{id_column}`"), "h": F.xxhash64(text_or_empty(f"`{text_column}`"))}
    return picked(docs, stored(stay, "staying"), key).select(*fields("row", docs.columns))

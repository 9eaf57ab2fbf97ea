"""Close copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The search is exact but for equal 64-bit hashes. A set of n shingles shares at least ceil(0.8 n) of them with a close one,
so n - ceil(0.8 n) at most are its own. Three filters follow; the first two are for an order of the shingles that holds for all texts:

- In order of hash, the first n - ceil(0.8 n) + l shingles of both sets share l at least. A text with too many shingles there
  that no other text has there has no close copy; most texts leave here, and only these leading shingles are shuffled.
- The rest have all shingles counted. Of the n - ceil(0.8 n) + 1 rarest, close sets share one, under which they meet. The first that
  they share has all others behind it in both sets, so a pair is looked at only if enough are left there for its similarity.

- Each set has a sketch of 256 bits: whether an odd number of its hashes fall on that bit. Sketches differ in no more bits than sets do
  in shingles, and close sets differ in a ninth of both sizes together at most, so pairs of sketches further apart are no pairs.

Pairs that links connect already need no look. Under a shingle that many texts share, a few texts are compared with all
others first, so that a large group of copies becomes one component without all its pairs; the texts outside the largest
component go on, eight times as many in each round, until each pair that is left lies within one component. Candidates are
verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import TEXT_ROWS, released, stored
from latticework.operators.components import star_edges

#: Words of a shingle; further leading shingles of each ten; pairs for each row that are looked at in one go; texts compared first.
WORDS, FURTHER, PAIRS, FIRST = 5, 0.1, 8, 2
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def shingles(content: bytes) -> np.ndarray:
    """Hashes of the distinct shingles in rising order; none for a text of fewer words."""
    words = content.lower().split()
    if len(words) < WORDS:
        return np.empty(0, np.uint64)
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    each = np.array([_hashes[w] for w in words], np.uint64)
    n = len(words) - WORDS + 1
    h = each[:n].copy()
    for k in range(1, WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return np.unique(h ^ (h >> np.uint64(31)))


def own(n: int) -> int:
    """How many of n shingles a close set may lack."""
    return n - (4 * n + 4) // 5


#: A sketch's words of 64 bits.
SKETCH = ["s0", "s1", "s2", "s3"]


def sketch(tokens: np.ndarray) -> np.ndarray:
    """256 bits as whole numbers: whether an odd number of hashes fall on each."""
    odd = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(texts: DataFrame, leading: bool) -> DataFrame:
    """(doc, n, own, tokens and, of whole sets, the sketch) of the texts (doc, text) that have shingles: the leading ones in order of hash, or all."""
    more = [] if leading else SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch["text"]]
            n = [len(x) for x in found]
            kept = [x[: own(k) + 1 + int(FURTHER * k)] if leading else x for x, k in zip(found, n)]
            ends = np.cumsum([0] + [len(x) for x in kept])
            tokens = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.empty(0, np.uint64), *kept]).view(np.int64))).cast(pa.list_(pa.int64()))
            bits = np.array([sketch(x) for x in found], np.int64).reshape(-1, len(SKETCH)) if more else None
            columns = [batch["doc"], pa.array(n, pa.int32()), pa.array([own(k) for k in n], pa.int32()), tokens, *[pa.array(bits[:, k]) for k in range(len(more))]]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "own", "tokens", *more])

    schema = "doc long, n int, own int, tokens array<long>" + "".join(f", {s} long" for s in more)
    return texts.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema).filter("n > 0")


def _in_play(texts: DataFrame) -> DataFrame:
    """(doc) of the texts whose leading shingles allow a close copy. Equal texts take each other's shingles as shared."""
    # A last row of each text, without a shingle, carries its limit; so texts are cut into shingles once.
    lead = _sets(texts, True).select("doc", "own", F.explode(F.concat("tokens", F.array(F.lit(None).cast("long")))).alias("token"))
    key = [F.col("token"), F.when(F.col("token").isNull(), F.col("doc"))]
    met = lead.groupBy(*key).agg(F.count("*").alias("rows"), F.min("doc").alias("doc"), F.min("own").alias("own")).filter("rows = 1 or token is null")
    return met.groupBy("doc").agg(F.count("token").alias("alone"), F.min(F.when(F.col("token").isNull(), F.col("own"))).alias("own")).filter("alone <= own").select("doc")


def close(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b shingles with common ones in both have a similarity of 0.8 or more."""
    return 9 * common >= 4 * (a + b)


def may_be_close(side_a: str, side_b: str, a: Column, b: Column) -> Column:
    """Whether the sketches of sets of a and b shingles leave a similarity of 0.8 possible; columns are the sketch's with a letter before them."""
    apart = [F.bit_count(F.col(side_a + s).bitwiseXOR(F.col(side_b + s))) for s in SKETCH]
    return 9 * sum(apart[1:], apart[0]) <= a + b


def close_links(texts: DataFrame, prints: DataFrame, near: DataFrame) -> DataFrame:
    """(src, dst) over fingerprints: near and further links that connect all fingerprints whose texts (doc, text) are close.

    doc is a hash of the text, prints (doc, fp) its fingerprint, near a stored table of links. Equal texts may come more than once.
    The further ones lie between fingerprints that stand for components, each pair of components once in a round. Tables of one round go
    once the next has read them.
    """
    play = stored(_in_play(texts), "in-play", TEXT_ROWS)
    chosen = texts.join(play, "doc").dropDuplicates(["doc"])
    prints = stored(prints.join(play, "doc").distinct(), "close-prints")
    sets = stored(_sets(chosen, False), "shingle-sets", TEXT_ROWS)
    rows = sets.select("doc", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    # Those that no other text has are the rarest of all; they take the first places of a prefix.
    shared = rows.join(counts, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).join(sets.select("doc", "n", "own", *SKETCH), "doc")
    rarest = shared.select("doc", "n", *SKETCH, F.size("t").alias("shared"), F.slice("t", 1, F.greatest(F.lit(0), F.col("own") + 1 - (F.col("n") - F.size("t")))).alias("t"))
    # left: shingles from this one on, in order of rarity.
    member = held = stored(rarest.select("doc", "n", *SKETCH, "shared", F.posexplode("t.token").alias("at", "token")).select("doc", "n", *SKETCH, "token", (F.col("shared") - F.col("at")).alias("left")), "prefixes")
    # Components by near's links; after that only links between components are looked at, so that no round meets older links again.
    of = prints.join(star_edges(near), F.col("fp") == F.col("id"), "left").select("doc", F.coalesce("component", "fp").alias("comp"))
    member, links, most, step = member.join(of, "doc"), near, FIRST, 0
    while True:
        now = stored(member, "members")
        released(held)
        sizes = now.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq"), F.max("c").alias("top_c"), F.max_by("comp", "c").alias("top")).filter("m > top_c")
        first = F.pmod(F.xxhash64("doc", F.lit(step)), F.col("m") - F.col("top_c")) < most
        pivot = (F.col("comp") != F.col("top")) & ((F.col("m") * F.col("m") - F.col("sq") <= PAIRS * F.col("m")) | first)
        live = held = stored(now.join(sizes, "token").select("token", "doc", "n", *SKETCH, "left", "comp", pivot.alias("pivot")), "members")
        released(now)
        if live.isEmpty():
            for done in (held, sets, prints, play):
                released(done)
            return links
        a = live.filter("pivot").select("token", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("comp").alias("ca"), *[F.col(s).alias(f"a{s}") for s in SKETCH])
        b = live.select("token", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("comp").alias("cb"), *[F.col(s).alias(f"b{s}") for s in SKETCH])
        met = a.join(b, "token").filter("ca <> cb").filter(close(F.least("la", "lb"), F.col("na"), F.col("nb")) & may_be_close("a", "b", F.col("na"), F.col("nb")))
        turned = F.col("a") > F.col("b")
        pairs = stored(met.select(*[F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("ca", "cb"), ("cb", "ca"))]).distinct(), "close-candidates")
        side = lambda k: sets.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        right = stored(both.filter(close(F.size(F.array_intersect("ta", "tb")), F.col("na"), F.col("nb"))).select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct(), "close-links")
        released(pairs)
        links = links.unionByName(right)
        # What has met all others of its shingle is done there.
        member = live.filter("not pivot").join(star_edges(right), F.col("comp") == F.col("id"), "left").select("doc", "n", *SKETCH, "token", "left", F.coalesce("component", "comp").alias("comp"))
        most, step = most * 8, step + 1

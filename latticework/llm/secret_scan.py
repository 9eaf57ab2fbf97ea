"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that finds more.

The field tags tokens as secret begin, inside or outside. A token's scores add up weights of its shape, of what stands between it and
its neighbours, of the words before and after it, and of the file. It is trained on the driver by its likelihood: on windows of a bounded sample of
documents, tagged by the patterns, and on labelled lines that a rule writes (`labelled_lines`), with secrets the patterns don't know and
with look-alikes. Viterbi decodes whole texts. Where a token's outside score leads by more than any transitions can make up
for, it is outside on every best path; the text falls apart at such tokens, and only runs of the others are decoded.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import text_or_empty

KINDS = ("assign", "access", "hex", "crf")
#: Letters of the words in either case, ASCII only.
EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = re.compile(rf"""({EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Documents of the sample that fits the field, and characters of each; tokens of a training window; steps of training.
SAMPLE_DOCS, SAMPLE_CHARS, WINDOW, STEPS = 600, 20_000, 40, 90
#: Characters of text whose tokens are scored together.
TOGETHER = 1 << 20
BUCKETS = 1 << 12
#: Stands three times before and after each text, as tokens that are outside; a private character.
EDGE = " \uf8ff \uf8ff \uf8ff "
BEGIN, INSIDE, OUTSIDE = range(3)
#: Classes of characters within tokens (0: between tokens).
LOWER, UPPER, DIGIT, MARK, OTHER = 1, 2, 3, 4, 5
HEX_DIGIT = 8


def character_classes() -> np.ndarray:
    of = np.full(0x110000, OTHER, np.uint8)
    of[:128] = 0
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), ("+/_.-", MARK)):
        of[[ord(c) for c in chars]] = kind
    of[[ord(c) for c in "0123456789abcdef"]] |= HEX_DIGIT
    for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xAB, 0xBB, *range(0x2018, 0x2020)):
        of[c] = 0  # white space and quotes
    return of


CLASSES = character_classes()
#: What stands before a token: quotes, assignments, line ends and other signs, as bits.
SIGNS = np.zeros(0x110000, np.uint8)
for _chars, _bit in (("=", 1), (":", 2), ("\"'`", 4), ("\n", 8), ("@&?#%$*|<>()[]{};,!\\~^", 16)):
    SIGNS[[ord(c) for c in _chars]] = _bit
SIZES = np.array([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64, 128])
#: Blocks of features: (name, values). Each token has one value of each.
BLOCKS = {"shape": 1024, "pair": 1024, "size": 16 * 8, "runs": 16 * 16, "before": 32 * 32, "after": 32, "word": BUCKETS, "word_1": BUCKETS, "word_2": BUCKETS, "next": BUCKETS, "file": 64}
STARTS = dict(zip(BLOCKS, np.cumsum([0, *BLOCKS.values()])[:-1].tolist()))
FEATURES = sum(BLOCKS.values())
MIX, POWER = np.uint64(0x9E3779B97F4A7C15), np.cumprod(np.full(64, 0xC2B2AE3D27D4EB4F, np.uint64))


def file_feature(text: str) -> int:
    """How much a text looks like code or settings: how often it has assignments and line ends, in 64 steps."""
    n = max(len(text), 1)
    often = lambda count, per: min(7, (count * per // n).bit_length())
    return often(text.count("=") + text.count(":") + text.count(";"), 1000) * 8 + often(text.count("\n"), 1000)


def tokens_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of token characters."""
    inside = np.r_[False, CLASSES[codes] > 0, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def features_of(codes: np.ndarray, start: np.ndarray, end: np.ndarray, file: np.ndarray | int) -> np.ndarray:
    """A row of feature numbers for each token of texts between edges; file is that of the text, for all or for each token."""
    n = len(start)
    if not n:
        return np.empty((0, len(BLOCKS)), np.int64)
    size = end - start
    kind = CLASSES[codes]
    limits = np.stack([start, end], axis=1).ravel()
    if limits[-1] == len(codes):
        limits = limits[:-1]
    sums = lambda x: np.add.reduceat(x, limits, dtype=np.int32)[::2]
    low = kind & 7
    count = [sums(low == k) for k in (LOWER, UPPER, DIGIT, MARK, OTHER)]
    hexed = sums(kind >= HEX_DIGIT) == size
    first = low[start]
    # Changes of class within a token: random strings change often, words rarely.
    turns = np.r_[False, (low[1:] != low[:-1]) & (low[1:] > 0) & (low[:-1] > 0)]
    turn = np.minimum(sums(turns) * 16 // np.maximum(size, 1), 15)
    long = np.searchsorted(SIZES, size)
    signs = SIGNS[codes]
    # Signs between tokens, as a set of bits.
    gap = np.zeros(n + 1, np.int64)
    begin = np.r_[0, end]
    stop = np.r_[start, len(codes)]
    filled = np.flatnonzero(stop > begin)
    if len(filled):
        cuts = np.stack([begin[filled], stop[filled]], axis=1).ravel()
        cuts = cuts[:-1] if cuts[-1] == len(codes) else cuts
        gap[filled] = np.bitwise_or.reduceat(signs, cuts)[::2]
    folded = codes | ((low == UPPER) * 32).astype(codes.dtype)
    place = np.arange(len(codes), dtype=np.int64)
    origin = np.zeros(len(codes), np.int64)
    origin[start] = start
    place -= np.maximum.accumulate(origin)
    hashed = (folded.astype(np.uint64) + np.uint64(1)) * MIX
    hashed ^= hashed >> np.uint64(29)
    word = (np.add.reduceat(hashed * POWER[place & 63], limits)[::2] >> np.uint64(20)).astype(np.int64) % (BUCKETS - 1) + 1
    known = np.where(count[2] + count[3] * 2 < 3, word, 0)  # long strings of digits and marks are no words
    back = lambda k: np.r_[np.zeros(min(k, n), np.int64), known[:-k]] if k < n else np.zeros(n, np.int64)
    share = np.minimum(count[2] * 8 // np.maximum(size, 1), 7)
    mask = sum((c > 0).astype(np.int64) << k for k, c in enumerate(count))
    columns = {
        "pair": mask * 32 + np.r_[0, mask[:-1]],
        "shape": mask * 32 + hexed * 16 + first * 2 + (size >= 20), "size": long * 8 + share, "runs": turn * 16 + long,
        "before": gap[:-1] * 32 + np.r_[0, gap[:-2]] if n > 1 else gap[:-1] * 32, "after": gap[1:], "word": np.where(size <= 16, known, 0),
        "word_1": back(1), "word_2": back(2), "next": np.r_[known[1:], 0], "file": np.broadcast_to(file, n),
    }
    return np.stack([columns[b] + STARTS[b] for b in BLOCKS], axis=1)


class Field:
    """Weights of features by tag, and of a tag after another; a text begins and ends outside."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        # Only differences to outside matter.
        self.against = np.ascontiguousarray(weights[:, :OUTSIDE] - weights[:, OUTSIDE:])
        # More than two transitions can be worth.
        self.lead = 2 * float(moves.max() - moves.min()) + 1e-6

    def scores(self, features: np.ndarray) -> np.ndarray:
        """What begin and inside have over outside, for each token."""
        out = self.against[features[:, 0]]
        for k in range(1, features.shape[1]):
            out += self.against[features[:, k]]
        return out

    def tags(self, scores: np.ndarray) -> np.ndarray:
        """The best tags of tokens of which the first and the last are outside."""
        tags = np.full(len(scores), OUTSIDE)
        open_ = np.flatnonzero(scores.max(axis=1) > -self.lead)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            if len(run):
                tags[run] = viterbi(np.c_[scores[run], np.zeros(len(run))], self.moves)
        return tags

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of the secrets of whole texts; short texts are scored together, long ones slice by slice."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        lot, size = [], 0
        for k, text in enumerate(texts):
            if len(text) > TOGETHER:
                found[k] = self._long(text)
                continue
            lot.append(k)
            size += len(text)
            if size > TOGETHER:
                self._together(texts, lot, found)
                lot, size = [], 0
        self._together(texts, lot, found)
        return found

    def _scored(self, texts: list[str], files: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text, scores) of the tokens of texts with edges around them; the edges' own tokens are far outside."""
        codes = np.frombuffer((EDGE + EDGE.join(texts) + EDGE).encode("utf-32-le", "surrogatepass"), np.uint32)
        start, end = tokens_of(codes)
        begin = len(EDGE) + np.cumsum([0, *(len(t) + len(EDGE) for t in texts)])
        text = np.searchsorted(begin, start, "right") - 1
        edge = (text < 0) | (start >= (begin[1:] - len(EDGE))[np.minimum(text, len(texts) - 1)])
        scores = self.scores(features_of(codes, start, end, np.array(files)[np.clip(text, 0, len(texts) - 1)]))
        scores[edge] = -1e9
        return start - begin[text], end - begin[text], np.where(edge, -1, text), scores

    def _together(self, texts: list[str], lot: list[int], found: list[list[tuple[int, int]]]) -> None:
        if lot:
            start, end, text, scores = self._scored([texts[k] for k in lot], [file_feature(texts[k]) for k in lot])
            for i, j in runs_of(self.tags(scores)):
                k = lot[text[i]]
                found[k].append((int(start[i]), trimmed(texts[k], int(start[i]), int(end[j]))))

    def _long(self, text: str) -> list[tuple[int, int]]:
        """A slice ends at a token that is surely outside; the next begins three tokens before, for what stands before its own."""
        file, found, at, done, step = file_feature(text), [], 0, 0, TOGETHER
        while True:
            start, end, _, scores = self._scored([text[at : at + step]], [file])
            start, end, last, whole = start + at, end + at, len(start), at + step >= len(text)
            if not whole:
                # The last tokens lack what follows them; three edges stand on either side.
                sure = np.flatnonzero(scores[:-8].max(axis=1, initial=-1e9) <= -self.lead) if len(start) > 16 else np.empty(0, int)
                sure = sure[(start[sure] > done) & (sure >= 7)]
                if not len(sure):
                    step *= 2
                    continue
                last = int(sure[-1])
            fresh = np.flatnonzero(start[:last] >= done)
            for i, j in runs_of(self.tags(scores[fresh])):
                found.append((int(start[fresh[i]]), trimmed(text, int(start[fresh[i]]), int(end[fresh[j]]))))
            if whole:
                return found
            done, at, step = int(start[last]), int(start[last - 3]), TOGETHER


def trimmed(text: str, start: int, end: int) -> int:
    """The end of a span without full stops after it, with padding signs."""
    while end > start + 1 and text[end - 1] in ".-/":
        end -= 1
    while end < len(text) and text[end] == "=":
        end += 1
    return end


def runs_of(tags: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) token of each secret: a begin and the insides after it; an inside after an outside begins one as well."""
    at = np.flatnonzero(tags != OUTSIDE)
    if len(at):
        opens = np.r_[True, np.diff(at) > 1] | (tags[at] == BEGIN)
        first = np.flatnonzero(opens)
        yield from zip(at[first].tolist(), at[np.r_[first[1:] - 1, len(at) - 1]].tolist())


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of tokens that stand between outside tokens; the first of equal ones."""
    back = np.empty((len(scores), 3), np.int8)
    best = scores[0] + moves[OUTSIDE]
    for t in range(1, len(scores)):
        through = best[:, None] + moves
        back[t] = through.argmax(axis=0)
        best = through[back[t], (0, 1, 2)] + scores[t]
    tags = np.empty(len(scores), np.int64)
    tags[-1] = int((best + moves[:, OUTSIDE]).argmax())
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def trained(sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = 0.2, decay: float = 2e-4) -> Field:
    """The field of greatest penalised likelihood on (features, tags) of sequences, by adaptive gradient steps; outside tokens pad them."""
    n, width = len(sequences), max([len(t) for _, t in sequences], default=1)
    features = np.zeros((n, width, len(BLOCKS)), np.int64)
    tags, there = np.full((n, width), OUTSIDE), np.zeros((n, width), bool)
    for k, (f, t) in enumerate(sequences):
        features[k, : len(t)], tags[k, : len(t)], there[k, : len(t)] = f, t, True
    used, which = np.unique(features[there], return_inverse=True)
    which = which.reshape(-1, len(BLOCKS))
    weights, moves = np.zeros((len(used), 3)), np.zeros((3, 3))
    moments = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    held = np.eye(3)[tags]
    # What the tags themselves count; a text begins and ends outside, and padding is outside.
    follow = lambda a: np.concatenate([np.broadcast_to(np.eye(3)[OUTSIDE], (n, 1, 3)), a], axis=1)
    last_tag = np.concatenate([held, np.broadcast_to(np.eye(3)[OUTSIDE], (n, 1, 3))], axis=1)
    own_moves = np.einsum("nti,ntj->ij", follow(held), last_tag)
    for step in range(1, steps + 1):
        scores = np.full((n, width, 3), -1e3)
        scores[..., OUTSIDE] = 0
        scores[there] = weights[which].sum(axis=1)
        marginal, pairs = marginals(scores, moves)
        away = (held - marginal)[there]
        gradient = np.stack([np.bincount(which.ravel(), np.repeat(away[:, k], len(BLOCKS)), len(used)) for k in range(3)], axis=1) / n - decay * weights
        move_gradient = (own_moves - pairs) / n - decay * moves
        for x, g, m, v in ((weights, gradient, *moments[:2]), (moves, move_gradient, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    full = np.zeros((FEATURES, 3))
    full[used] = weights
    return Field(full, moves)


def marginals(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each tag of each token, expected number of each transition) of sequences that begin and end outside."""
    n, width, _ = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e, m = np.exp(scores - top), np.exp(moves - moves.max())
    forward, backward = np.empty_like(e), np.empty_like(e)
    at = m[OUTSIDE] * e[:, 0]
    forward[:, 0] = at / at.sum(axis=1, keepdims=True)
    for t in range(1, width):
        at = forward[:, t - 1] @ m * e[:, t]
        forward[:, t] = at / at.sum(axis=1, keepdims=True)
    backward[:, -1] = m[:, OUTSIDE]
    for t in range(width - 1, 0, -1):
        at = (backward[:, t] * e[:, t]) @ m.T
        backward[:, t - 1] = at / at.sum(axis=1, keepdims=True)
    whole = forward * backward
    marginal = whole / whole.sum(axis=2, keepdims=True)
    pairs = np.zeros((3, 3))
    for t in range(1, width):
        joint = forward[:, t - 1, :, None] * m * (e[:, t] * backward[:, t])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    pairs[OUTSIDE] += marginal[:, 0].sum(axis=0)
    pairs[:, OUTSIDE] += marginal[:, -1].sum(axis=0)
    return marginal, pairs


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, by start and kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def with_added(base: list[tuple[int, int, int]], spans: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The base spans, and those of the field that touch none of them."""
    taken = sorted((a, b) for a, _, b in base)
    added, k, reach = [], 0, -1
    for a, b in sorted(spans):
        while k < len(taken) and taken[k][0] < b:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= a:
            added.append((a, 3, b))
    return sorted([*base, *added])


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


#: Labelled lines: words that announce a secret and words that announce a look-alike.
SECRET_WORDS = "password passwd pwd passphrase secret token apikey api_key auth_token access_token client_secret private_key credential bearer authorization signing_key webhook_secret db_password session_key".split()
OTHER_WORDS = "commit sha256 md5 checksum digest etag uuid request_id trace_id build version revision doi isbn order_id tracking path file image hash fingerprint serial model parent blob tree".split()
PLAIN_WORDS = "the of and to in we you for is on that it with as at by from this be are or was not have new set up see for use run die der und la le de el que les des please send note value config server user host port mail name time".split()


def labelled_lines(seed: int, many: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the spans of their secrets, as a rule writes them."""
    rng = random.Random(seed)
    alpha, lower, digits, hexed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    random_strings = [
        lambda: some(hexed, 16, 40), lambda: some(alpha + lower + digits, 16, 44), lambda: some(alpha + lower + digits + "+/", 20, 60), lambda: some(lower + digits, 12, 32),
        lambda: some(lower, 2, 4) + "_" + some(alpha + lower + digits, 16, 36), lambda: some(alpha + digits, 16, 24), lambda: "-".join(some(lower + digits, 4, 6) for _ in range(4)),
        lambda: ".".join(some(alpha + lower + digits + "_-", 12, 40) for _ in range(3)),
    ]
    looks = [lambda: some(hexed, 7, 40), lambda: "-".join(some(hexed, n, n) for n in (8, 4, 4, 4, 12)), lambda: ".".join(some(digits, 1, 3) for _ in range(3)), lambda: "/".join(rng.choice(PLAIN_WORDS) for _ in range(4)), lambda: some(digits, 4, 16)]
    words = lambda a, b: [rng.choice(PLAIN_WORDS) if rng.random() < 0.5 else some(lower, 2, 10) for _ in range(rng.randint(a, b))]
    lines = []
    for _ in range(many):
        secret = rng.random() < 0.5
        name = rng.choice(SECRET_WORDS if secret else OTHER_WORDS)
        if rng.random() < 0.3:
            name = rng.choice([str.upper, str.title])(name)
        line, spans = " ".join(words(0, 8)), []
        line += " " * bool(line) + name + rng.choice([" = ", "=", ": ", ":", " is ", " ", " -> ", ' = "', "='", ': "'])
        parts = [rng.choice(random_strings if secret else looks)()]
        if secret and rng.random() < 0.15:
            parts = [some(lower + digits, 4, 4) for _ in range(4)]
        for k, part in enumerate(parts):
            line += " " * bool(k)
            spans.append((len(line), len(line) + len(part)))
            line += part
        line += rng.choice(["", '"', ";", ",", "\n"]) + " ".join(["", *words(0, 8)])
        if rng.random() < 0.2:
            line += f" {rng.choice(words(1, 1))}{rng.randint(1, 99)}@{some(lower, 3, 8)}.example.org {rng.randint(1, 9999)}.{rng.randint(0, 99)} "
        lines.append((line, [(spans[0][0], spans[-1][1])] if secret else []))
    return lines


def sequences_of(text: str, spans: list[tuple[int, int]], keep: Iterable[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of a text's tokens with their tags; keep names the windows that are wanted besides those with a secret."""
    codes = np.frombuffer((EDGE + text + EDGE).encode("utf-32-le", "surrogatepass"), np.uint32)
    start, end = tokens_of(codes)
    features, tags = features_of(codes, start, end, file_feature(text))[3:-3], np.full(len(start) - 6, OUTSIDE)
    start, end = start[3:-3] - len(EDGE), end[3:-3] - len(EDGE)
    for a, b in spans:
        at = np.flatnonzero((start < b) & (end > a))
        tags[at], tags[at[:1]] = INSIDE, BEGIN
    wanted = None if keep is None else set(keep)
    for k, at in enumerate(range(0, len(tags), WINDOW)):
        part = tags[at : at + WINDOW]
        if wanted is None or k in wanted or (part != OUTSIDE).any():
            yield features[at : at + WINDOW], part


def fitted(texts: Iterable[str], seed: int = 12, lines: int = 3000) -> Field:
    """The field of the labelled lines and of windows of texts: those with a pattern's match and another of each text."""
    found = [s for line, spans in labelled_lines(seed, lines) for s in sequences_of(line, spans)]
    rng = random.Random(seed)
    for text in texts:
        # What a pattern matches beside its word is the secret: the second group, or the whole match.
        spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] + [(a, b) for a, k, b in base_spans(text) if k]
        found += list(sequences_of(text, spans, [rng.randrange(1 + len(text) // (8 * WINDOW)) for _ in range(1)]))
    return trained(found)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_added, base_sha256, spans) for each row of docs.

    spans lists kind:start:end by start and kind, in code points, the end exclusive: all matches of the fixed patterns, and as crf those of the
    field that touch none of them. A null or empty text has none: an empty list and the digest of the empty string. Every row
    is read alone, so ties and repeated rows change nothing; ids may be null and of any type, columns of any name; an empty table gives no rows,
    and the field then knows the labelled lines only. Whole texts are read, however long. The field is fitted on SAMPLE_DOCS documents at most, those
    with the smallest hash of their text, and SAMPLE_CHARS characters of each.
    """
    text = text_or_empty(f"`{text_column}`")
    size = docs.count()
    # A threshold that leaves about twice the sample, wherever its rows lie; of equal texts one is enough.
    near = docs.select(text.alias("text")).filter((F.col("text") != "") & (F.xxhash64("text").cast("double") / float(1 << 64) + 0.5 <= min(1.0, 2 * SAMPLE_DOCS / max(size, 1))))
    cut = near.select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), F.xxhash64("text").alias("h")).dropDuplicates(["h"])
    field = fitted(r["text"] for r in cut.orderBy("h").limit(SAMPLE_DOCS).toLocalIterator())
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves))
    names = ["n_assign", "n_access", "n_hex", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        for batch in batches:
            counts, digests, lists = [], [], []
            texts = batch["text"].to_pylist()
            for text, more in zip(texts, field.spans(texts)):
                base = base_spans(text)
                spans = with_added(base, more)
                counts.append([sum(s[1] == k for s in spans) for k in range(4)])
                digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                lists.append(shown(spans))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch["id"], *columns, pa.array(digests, pa.string()), pa.array(lists, pa.string())], ["id", *names, "base_sha256", "spans"])

    out = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *[T.StructField(n, T.LongType()) for n in names], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    found = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text")).mapInArrow(run, out)
    return found.select(F.col("id").alias(id_column), *names, "base_sha256", "spans")

"""Language identification of words, spans and documents.

A word's script narrows the candidates to the languages that were learned in that script. Each candidate scores the
word by the log-likelihood of its character n-grams. A Viterbi pass with a penalty for each switch labels the words,
so that a text of several languages falls into spans; the document's language is the one with most letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.common import SPACE, crc_fold, smallest_hashes, stored

#: First code points of blocks, and the script from there on (fixed values; blocks without a script of their own count as other).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
STARTS = np.array([start for start, _ in SCRIPTS])
NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])
#: Learned rows of each language at most, n-gram lengths, bits of the hash, smoothing, cost of a switch, words and bytes of scores a worker remembers.
LEARN_ROWS, GRAMS, BUCKET_BITS, SMOOTH, SWITCH, REMEMBERED, REMEMBERED_BYTES = 1000, (1, 2, 3), 15, 0.5, 12.0, 500_000, 64 << 20
BUCKETS = 1 << BUCKET_BITS
#: Characters of a word from which it is forgotten at once, and bytes of text that are looked up together.
LONG, TOGETHER = 64, 1 << 20
NOT_LETTERS, NOT_IN_WORD = regex.compile(r"[^\p{L}\n]+"), regex.compile(r"[^\p{L}\p{M}\n]+")
#: Odd multipliers of the n-gram hash.
MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(words: list[str]) -> tuple[np.ndarray, ...]:
    """(letters, script, bucket, word): of each word its letters and the script of the first one as a place in NAMES;
    then each n-gram's bucket and the place of its word, n-grams taken in lower case between boundary marks.
    """
    joined = "\n".join(words)
    letters = np.array([len(w) for w in NOT_LETTERS.sub("", joined).split("\n")], np.int64)
    marked = "^" + NOT_IN_WORD.sub("", joined).lower().replace("\n", "$^") + "$"
    code = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    opens = code == ord("^")
    word = np.cumsum(opens) - 1
    script = SCRIPT_OF[np.searchsorted(STARTS, code[np.flatnonzero(opens) + 1], "right") - 1]
    buckets, of = [], []
    wide = code.astype(np.uint64)
    for n in GRAMS:
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ wide[k : len(code) - n + 1 + k]) * MIX_1
            h ^= h >> np.uint64(29)
        inside = word[: len(h)] == word[n - 1 :]
        buckets.append(((h * MIX_2) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[inside])
        of.append(word[: len(h)][inside])
    return letters, script, np.concatenate(buckets), np.concatenate(of)


class Model:
    """Log-likelihoods of buckets by language, and the languages of each script."""

    def __init__(self, languages: list[str], logs: np.ndarray, allowed: np.ndarray):
        self.languages, self.logs, self.allowed = languages, logs, allowed
        self.known: dict[bytes, int] = {}
        self.used = 0
        self.most = min(REMEMBERED, REMEMBERED_BYTES // (8 * max(1, len(languages))))
        self.rows = np.zeros((1 << 12, len(languages)))
        self.letters = np.zeros(1 << 12, np.int64)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Rows of the words in the table of scores, which grows by those not met before."""
        if self.used > self.most:
            self.known.clear()
            self.used = 0
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            end = self.used + len(new)
            while end > len(self.rows):
                self.rows, self.letters = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.rows[self.used : end], self.letters[self.used : end] = self.scores([w.decode() for w in new])
            known.update(zip(new, range(self.used, end)))
            self.used = end
        found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) > LONG:
                del known[w]
        return found

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by language, at most 0, and their letters. Without letters or candidates all are 0."""
        letters, script, bucket, of = features(words)
        n = len(words)
        s = np.stack([np.bincount(of, weights=self.logs[bucket, k], minlength=n) for k in range(len(self.languages))], axis=1)
        can = self.allowed[script]
        s = np.where(can, s, -np.inf)
        top = s.max(axis=1)
        flat = ~can.any(axis=1) | (letters == 0)
        # A language is never worse off than by a fixed bound, so that one odd word doesn't decide a text.
        s = np.maximum(s - np.where(flat, 0, top)[:, None], -3.0 * SWITCH)
        s[flat] = 0
        return s, letters

    def spans(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the language of each word, as a place in languages, and the letters of each word."""
        split = [t.split() for t in texts]
        at = self.look_up([w for words in split for w in words])
        begin = 0
        for words in split:
            own = at[begin : begin + len(words)]
            begin += len(words)
            yield viterbi(self.rows[own]), self.letters[own]

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        out = []
        for path, letters in self.spans([t or b"" for t in texts]):
            by = np.bincount(path, weights=letters, minlength=len(self.languages))
            best = int(by.argmax())
            out.append((self.languages[best], float(by[best] / by.sum())) if by[best] else ("und", 0.0))
        return out


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best path over words x languages with a cost for each switch; ties go to the first language.

    Most texts end without a step per word, at a bound: take the path of the one best language, and another path with k stretches
    between two of its words, or before the first or after the last. The stretches of a middle part cost a switch more than there are
    of them, those of an end as many as there are, those of a path that never takes that language one less. So the one
    language is best if no stretch gains more than a switch over it, and no two stretches at the two ends do so together.
    """
    n, m = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    before = np.r_[np.zeros((1, m)), gain]
    middle = (gain - np.minimum.accumulate(before[:-1], axis=0)).max()
    ends = before.max() + (gain[-1] - before).max()
    if max(middle, ends) <= switch:
        return np.full(n, best)
    value, back = scores[0].tolist(), np.zeros((n, m), np.int16 if m < 1 << 15 else np.int32)
    langs = range(m)
    rows = scores.tolist()
    for t in range(1, n):
        top = max(value)
        lead, bar = value.index(top), top - switch
        row, step = rows[t], back[t]
        for k in langs:
            if value[k] >= bar:
                step[k] = k
            else:
                step[k], value[k] = lead, bar
            value[k] += row[k]
    path = np.empty(n, np.int64)
    k = value.index(max(value))
    for t in range(n - 1, -1, -1):
        path[t] = k
        k = int(back[t, k])
    return path


def learn(docs: DataFrame, folds: int = 5, held: int = 0) -> Model:
    """The model from rows (id, text, lang): at most LEARN_ROWS of each language, those of the smallest hash of the id.

    Held-out rows and rows without an id, text or language are never read as examples. Spark counts n-grams in a fixed number of buckets for each language.
    """
    can = docs.filter("lang is not null and text is not null and id is not null").filter(crc_fold("id", folds) != held)
    ids = stored(smallest_hashes(can.select("id", "lang").distinct(), "lang", LEARN_ROWS).select("id", F.col("lang").alias("of")), "language-sample")
    words = can.join(ids, "id").filter("lang = of").select("lang", F.explode(F.split("text", SPACE)).alias("word")).groupBy("lang", "word").count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, n = np.array(batch["lang"].to_pylist(), object), np.asarray(batch["count"]).astype(float)
            letters, script, bucket, of = features(batch["word"].to_pylist())
            n[letters == 0] = 0
            for lang in set(langs):
                own = langs == lang
                take = own[of]
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket[take], weights=n[of[take]], minlength=BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(script[own], weights=n[own], minlength=len(NAMES))
        for lang, counts in sums.items():
            whole = np.r_[counts, scripts[lang]]
            at = np.flatnonzero(whole)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(whole[at])], ["lang", "at", "n"])

    parts = words.repartition("lang", "word").mapInArrow(count, "lang string, at long, n double")
    # A row for each language and bucket or script at most.
    table = parts.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = table["lang"].to_pylist()
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0), bool))
    whole = np.zeros((BUCKETS + len(NAMES), len(languages)))
    whole[np.asarray(table["at"]), np.searchsorted(languages, names)] = np.asarray(table["n"])
    counts, scripts = whole[:BUCKETS], whole[BUCKETS:]
    logs = np.log((counts + SMOOTH) / (counts + SMOOTH).sum(axis=0))
    return Model(languages, logs, scripts >= 0.01 * scripts.sum(axis=0))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", folds: int = 5, held: int = 0) -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of docs; score is the share of letters in spans of lang_pred.

    und with score 0 where the text is null or has no letter, or nothing could be learned. A null id isn't held out.
    Repeated rows are judged alike; whole texts are judged, however long; the id may be of any type, and other columns may have any
    names. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang"))
    model = learn(rows, folds, held)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs, model.allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(*sent.value)
        for batch in batches:
            found, texts, size = [], [], 0
            for t in batch["text"]:
                texts.append(t.as_py())
                size += len(texts[-1] or b"")
                if size > TOGETHER:
                    found += judge.predict(texts)
                    texts, size = [], 0
            found += judge.predict(texts)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    held_out = F.coalesce(crc_fold("id", folds) == held, F.lit(False)).alias("held_out")
    out = T.StructType([T.StructField("id", docs.schema[id_column].dataType), *T.StructType.fromDDL("held_out boolean, lang_pred string, score double")])
    judged = rows.select("id", held_out, F.col("text").cast("binary").alias("text")).mapInArrow(run, out)
    return judged.select(F.col("id").alias(id_column), "held_out", "lang_pred", "score")

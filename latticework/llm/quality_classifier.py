"""A quality classifier by compression.

Two zstandard dictionaries hold pieces of good and of bad labelled text. A text is cut into pieces, each piece is
compressed with either dictionary, and the difference of the summed sizes per byte of text says which kind of text
it resembles. A logistic curve, fitted on other labelled rows, makes a calibrated score of it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.llm.common import crc_fold, smallest_hashes, stored, text_or_empty

#: Bounds of the fit: labelled rows of each label, and a dictionary's pieces. Of seven rows four go to the dictionaries, three fit the curve.
SAMPLE_ROWS, DICT_PIECES, DICT_PIECE_CHARS = 3500, 256, 1024
#: How texts are compressed.
PIECE_BYTES, LEVEL = 2048, 6


@functools.lru_cache(4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made)


def difference(text: bytes, good: bytes, bad: bytes) -> float:
    """Bytes by which the good dictionary compresses the text better than the bad one, per byte; 0 for an empty text."""
    with_good, with_bad = _compressor(good).compress, _compressor(bad).compress
    gain = 0
    for at in range(0, len(text), PIECE_BYTES):
        piece = text[at : at + PIECE_BYTES]
        gain += len(with_bad(piece)) - len(with_good(piece))
    return gain / max(1, len(text))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve by Newton's method on standardised x."""
    mean, scale = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    design = np.c_[(x - mean) / scale, np.ones(len(x))]
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(2), design.T @ (weight * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * mean / scale)


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    Rows whose crc32 of the id, modulo folds, is held are held out: their labels are never read. The others give at
    most SAMPLE_ROWS rows of each label, those of the smallest hash of the id. A null text counts as empty
    and has a score; a null id isn't held out. Without labelled rows of both kinds the score is the share of label 1,
    or 0.5. Several labels of one id count as the largest. Repeated rows score alike; whole texts are compressed, piece by piece, however
    long; other columns may have any names. An empty table gives no rows.
    """
    name = f"`{id_column}`"
    known = labels.select(F.col(name).alias("id"), F.col(f"`{label_column}`").cast("int").alias("y")).filter("y in (0, 1) and id is not null").filter(crc_fold("id", folds) != held)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    sample = stored(smallest_hashes(known, "y", SAMPLE_ROWS), "quality-labels")
    shares = dict(known.groupBy("y").count().collect())
    total = sum(shares.values())
    base = shares.get(1, 0) / total if total else 0.5
    texts = docs.select(F.col(name).alias("id"), text_or_empty(f"`{text_column}`").alias("text"))
    # The sample's rows are bounded, so it may be broadcast.
    chosen = stored(texts.join(F.broadcast(sample), "id"), "quality-sample")

    pieces = chosen.filter("place % 7 < 4").select("id", "y", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / DICT_PIECE_CHARS).cast("int")), lambda k: F.substring(F.col("text"), k * DICT_PIECE_CHARS + 1, F.lit(DICT_PIECE_CHARS)))).alias("k", "piece"))
    first = F.row_number().over(W.partitionBy("y").orderBy(F.xxhash64("id", "k"), "id", "k", "piece"))
    rows = pieces.filter("piece <> ''").withColumn("at", first).filter(F.col("at") <= DICT_PIECES).orderBy("y", "at").collect()
    good, bad = ("".join(r["piece"] for r in rows if r["y"] == y).encode() for y in (1, 0))
    usable = bool(good and bad)
    sent = docs.sparkSession.sparkContext.broadcast((good, bad))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [difference(t.as_py(), *sent.value) if usable else 0.0 for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(x, pa.float64())], ["id", "x"])

    def scored(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"id {docs.schema[id_column].dataType.simpleString()}, x double")

    slope, intercept = 0.0, float(np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
    if usable:
        fit = scored(chosen.filter("place % 7 >= 4")).join(F.broadcast(sample), "id").select("x", "y").collect()
        if len({r["y"] for r in fit}) == 2:
            x, y = np.array([r["x"] for r in fit]), np.array([r["y"] for r in fit], float)
            weight = np.where(y == 1, base / y.mean(), (1 - base) / (1 - y.mean()))
            slope, intercept = logistic(x, y, weight)
    score = 1 / (1 + F.exp(-(F.col("x") * slope + intercept)))
    out = scored(texts).select(F.col("id").alias(id_column), F.coalesce(crc_fold("id", folds) == held, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

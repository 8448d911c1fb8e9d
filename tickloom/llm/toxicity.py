"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words (letters and digits, A-Z lower-cased), of their
first STEM bytes, of pairs in a row and of pairs with one word between. Per-coordinate rates and the L1 term leave few non-zero weights;
they are at most DIMENSIONS numbers, so they travel with the scoring function.

Training reads about SAMPLE labelled documents (those with the smallest hashes of their id), by text and
label alone.

Defined results: a null or empty text has no features and gets the score of the bias; null labels are left
out; of rows that repeat an id each is used; with no labelled rows every score is 0.5 or less; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import rolling as R
from .common import by_batch, full_text, sampled

DIMENSIONS = 1 << 20
#: Labelled rows read in training, about.
SAMPLE = 12_000
EPOCHS = 2
#: Bytes of the word beginnings that stand in for rare forms of a word.
STEM = 4
ALPHA, BETA, L1, L2 = 0.2, 1.0, 1.5, 1.0
_WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, word beginning, pair and skip pair, repeats included."""
    data = _WORD[data]
    start, end, first = R.words(data, offsets)
    hashes = R.Hashes(R.byte_symbols(data))
    row, h = R.rows_of(first), hashes.spans(start, end)
    rows, found = [row, row], [R.mix(h), R.mix(hashes.spans(start, np.minimum(start + STEM, end)) ^ np.uint64(0x632BE59BD9B4E019))]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            ok = row[gap:] == row[:-gap]
            rows.append(row[gap:][ok])
            found.append(R.mix(h[:-gap][ok] * np.uint64(salt) + h[gap:][ok]))
    return np.concatenate(rows), (np.concatenate(found) & np.uint64(DIMENSIONS - 1)).astype(np.int32)


class Ftrl:
    """Per-coordinate state of FTRL-proximal; coordinate DIMENSIONS is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, x: np.ndarray) -> np.ndarray:
        z, n = self.z[x], self.n[x]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, x: np.ndarray, y: float) -> None:
        w = self.weights(x)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        n = self.n[x]
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[x] = n + g * g


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero. labels: doc_id, label 0/1."""
    few = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label"))
    few = sampled(few, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text")).join(F.broadcast(few), "doc_id")

    def featured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in R.slices(batch):
            row, x = features(data, offsets)
            key = np.unique(row.astype(np.int64) * DIMENSIONS + x)
            cut = np.searchsorted(key, np.arange(rows.num_rows + 1) * DIMENSIONS)
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array((key % DIMENSIONS).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), lists], names=["doc_id", "label", "x"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(y.as_py(), np.append(x.values.to_numpy(), np.int32(DIMENSIONS))) for b in batches for y, x in zip(b.column(1), b.column(2), strict=True)]
        order, model = np.random.default_rng(5), Ftrl()
        for _ in range(EPOCHS):
            for i in order.permutation(len(seen)):
                model.learn(seen[i][1], seen[i][0])
        w = model.weights(np.arange(DIMENSIONS + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    # one task, of about ``sample`` rows whatever the input
    table = by_batch(texts.select("doc_id", "text", "label"), featured, "doc_id long, label double, x array<int>").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(learned, "at long, w double").toPandas()
    return table["at"].to_numpy(np.int64), table["w"].to_numpy(np.float64)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], column: str = "score") -> DataFrame:
    """docs with ``column`` (0 to 1), the score of every row's text; other columns stay."""
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs have a column {column} already")
    at, weight = model

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = np.zeros(DIMENSIONS + 1)
        table[at] = weight
        for rows, data, offsets in R.slices(batch):
            row, x = features(data, offsets)
            hit = np.flatnonzero(table[x])
            key = np.unique(row[hit].astype(np.int64) * DIMENSIONS + x[hit])
            total = np.bincount(key // DIMENSIONS, weights=table[key % DIMENSIONS], minlength=rows.num_rows) + table[DIMENSIONS]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))], names=[*rows.schema.names, column])

    return by_batch(docs, each, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def accepted(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs whose score stays under 0.5."""
    column = "score"
    while column.lower() in (c.lower() for c in docs.columns):
        column += "_"
    return score(docs, model, column).where(F.col(column) < 0.5).drop(column)


def held_out(doc_id: str = "doc_id"):
    """Whether a document's labels are kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, learned from labels of documents not held out."""
    usable = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    model = train(docs, usable)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

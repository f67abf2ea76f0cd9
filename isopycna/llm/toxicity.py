"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct single words, pairs of neighbours and pairs
with one word between, hashed into ``2**BITS`` coordinates; words are runs of
letters, digits and non-ASCII bytes, A-Z lower-cased.  Each coordinate has its
own learning rate, and the L1 term leaves most weights at exactly zero, so a
model is a short list of (coordinate, weight), bounded by ``2**BITS``.

The model is fitted on at most ``SAMPLE`` labelled rows, those of lowest
xxhash64(doc_id), then of lowest hash of the text, among the rows that may be learnt
from; rows equal in id and text count once.  Everything is scored, whole texts of any
length.  Where a document has several labels the highest counts; null labels don't.

Null texts count as empty; an empty text has the score of the intercept; repeated rows
score alike; a null id is never learnt from and not held out.  Without any labelled row
every score is 0; an empty table gives no rows.  Other columns are kept as asked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import documents, short_batches

BITS = 20
SAMPLE = 8000
EPOCHS = 8
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 3.0, 1.0, 5.0, 0.0
U64 = np.uint64


def features(texts: pa.Array, first: int, last: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the features of rows ``first`` to ``last``, with repeats, and the row of each."""
    words, bounds = textkit.word_hashes(texts, first, last, textkit.MARKS)
    row = np.repeat(np.arange(last - first), np.diff(bounds))
    found, rows = [words], [row]
    for gap, salt in ((1, 0x2545F4914F6CDD1D), (2, 0x9E6C63D0876A9A47)):
        same = row[:-gap] == row[gap:] if len(row) > gap else np.zeros(0, bool)
        if same.any():
            found.append(textkit.mix(words[:-gap] * U64(salt) + words[gap:])[same])
            rows.append(row[gap:][same])
    return (np.concatenate(found) & U64((1 << bits) - 1)).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal for 0/1 features; coordinate 0 of the extra slot is the intercept, without L1."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.size = alpha, beta, l1, l2, size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == self.size, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, self.size)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(np.arange(self.size + 1))
        at = np.flatnonzero(w)
        return at, w[at]


def fit(examples: Iterable[tuple[np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    examples = list(examples)
    model = Ftrl(1 << bits)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            model.learn(*examples[i])
    return model.sparse()


def score_texts(texts: pa.Array, first: int, last: int, dense: np.ndarray, bits: int = BITS) -> np.ndarray:
    at, row = features(texts, first, last, bits)
    live = dense[at] != 0
    pairs = np.unique(row[live] << (bits + 1) | at[live])
    total = np.bincount(pairs >> (bits + 1), dense[pairs & ((1 << bits) - 1)], last - first)
    return 1.0 / (1.0 + np.exp(-np.clip(total + dense[-1], -35.0, 35.0)))


def may_learn(key: Column) -> Column:
    """Whether labels may be learnt from the row: crc32 of the id as text is not 1 modulo 3."""
    return F.crc32(key.cast("string")) % 3 != 1


def sample_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, _h, text, _label)`` of the at most ``sample`` rows to learn from."""
    chosen = (
        labels.where(may_learn(F.col("doc_id")) & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # At most ``sample`` rows each, so the broadcasts are bounded by that parameter; so are the texts in one task.
    digest = F.xxhash64("text").alias("_h")
    keys = docs.select("doc_id", digest).join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_h").limit(sample)
    return docs.select("doc_id", "text", digest).join(F.broadcast(keys), ["doc_id", "_h"]).groupBy("doc_id", "_h").agg(F.first("text").alias("text"), F.max("_label").alias("_label"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights fitted on the labelled documents that may be learnt from."""
    rows = sample_rows(docs, labels, label, sample)
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "_h").select("text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            texts, label_of = textkit.filled(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for first, last in textkit.chunks(texts):
                at, row = features(texts, first, last, bits)
                keys = np.unique(row << bits | at)
                cuts = np.searchsorted(keys >> bits, np.arange(last - first + 1))
                keys &= (1 << bits) - 1
                examples += [(keys[cuts[i] : cuts[i + 1]].astype(np.int32), label_of[first + i]) for i in range(last - first)]
        at, w = fit(examples, bits) if examples else (np.array([1 << bits]), np.array([-40.0]))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["at", "w"])

    with short_batches(docs.sparkSession, 1000):
        model = rows.mapInArrow(textkit.lean(run), "at long, w double").toArrow()
    if not model.num_rows:
        return np.array([1 << bits]), np.array([-40.0])
    return model["at"].to_numpy(), model["w"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``toxicity``, the score of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = keep.index("text") if "text" in keep else len(keep)
    rows = docs.select(*keep) if own < len(keep) else docs.select(*keep, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = w
        for batch in batches:
            texts = textkit.filled(batch.column(own))
            parts = [score_texts(texts, a, b, dense, bits) for a, b in textkit.chunks(texts)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(scores)], [*keep, "toxicity"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[: len(keep)])
    return rows.mapInArrow(textkit.lean(run), f"{fields}, toxicity double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op2_toxicity": op2_toxicity}

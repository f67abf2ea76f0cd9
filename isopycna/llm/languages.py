"""Language identification with string kernels: Nyström landmarks and one-versus-rest kernel ridge regression.

A text is the set of its n-grams of 1 to 4 bytes, A-Z lower-cased and every other ASCII
character that is no letter read as a blank; the blended-spectrum presence kernel of two
texts is the number of n-grams that both have.  ``LANDMARKS`` texts span the space: a text
is its kernels with the landmarks, divided by the landmarks' norms, times the inverse root of the landmarks' own kernel
matrix, scaled to length 1, so that long and short texts compare.  On that, ridge
regression gives each language a score (1 for its own texts, -1 for others, each language
weighing the same); the highest wins, and ``score`` is it mapped from -1..1 to 0..1.
Texts are scored in blocks: presence matrix times landmark matrix times weights.

N-grams are mapped to ``2**BITS`` slots; those that no landmark has don't count in any kernel
and are dropped as they are found.  A text of any length is read whole, ``PIECE`` bytes at a time.

The model is fitted on at most ``SAMPLE`` rows: of each of the ``LANGS`` most frequent languages
the up to ``PER_LANG`` whose hash of doc_id is lowest, taken in turn from all languages, among the
rows that may be learnt from; rows equal in text and language count once.  The first ``LANDMARKS`` of these are the
landmarks.  Only text and language are learnt from, and only the text is scored.

Null texts and texts without a letter (Unicode category L) are ``und`` with score 0, as is
every text where there is nothing to learn from.  Texts with letters but without any known n-gram
get what the intercepts say.  Ties go to the first language in code-point order; repeated rows score alike; a null
id or language is never learnt from; a null id isn't held out; the empty string is a language like others.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .common import documents, short_batches

LONGEST = 4
BITS = 21
LANGS = 1000
PER_LANG = 500
SAMPLE = 4000
LANDMARKS = 128
RIDGE = 1e-3
#: Texts that are laid out in one matrix, and bytes that are looked at at once.
BLOCK = 64
PIECE = 1 << 18
UNKNOWN = "und"

_BYTE = np.full(256, 0x20, np.uint32)
_BYTE[128:] = np.arange(128, 256)
_BYTE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_BYTE[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(texts: pa.Array, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the n-grams of rows ``first`` to ``last``, with repeats, and the row of each, counted from ``first``; piece by piece."""
    offsets = textkit.offsets_of(texts)[first : last + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return
    raw = np.frombuffer(texts.buffers()[2], np.uint8, hi - lo, lo)
    for begin in range(0, hi - lo, PIECE):
        part = raw[begin : begin + PIECE + LONGEST - 1]
        row = np.searchsorted(offsets - lo, np.arange(begin, begin + len(part)), side="right") - 1
        byte = _BYTE[part]
        code = np.zeros(len(part), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(part) < n:
                break
            # Up to four bytes fit a code exactly; n-grams that reach into the next row are none.
            code = (code[: len(part) - n + 1] << np.uint32(8)) | byte[n - 1 :]
            inside = row[: len(code)] == row[n - 1 :]
            slots = ((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            yield slots[inside], row[: len(code)][inside]


@dataclass
class Model:
    """``langs``; the ``slots`` that landmarks have; which landmark has which, as bits; and the weights from kernels to scores."""

    langs: list[str]
    slots: np.ndarray
    bits: np.ndarray
    norms: np.ndarray
    root: np.ndarray
    weights: np.ndarray

    def matrix(self) -> np.ndarray:
        """Slots times landmarks, each landmark divided by its norm."""
        return np.unpackbits(self.bits, axis=1, count=len(self.norms)).astype(np.float32) / self.norms.astype(np.float32)


def places(slots: np.ndarray) -> np.ndarray:
    table = np.full(1 << BITS, -1, np.int32)
    table[slots] = np.arange(len(slots), dtype=np.int32)
    return table


def kernels(texts: pa.Array, first: int, last: int, table: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Kernels of rows ``first`` to ``last`` with the landmarks, up to each row's own norm."""
    out = np.zeros((last - first, matrix.shape[1]), np.float32)
    present = np.zeros((min(BLOCK, last - first), len(matrix)), np.float32)
    for start in range(first, last, BLOCK):
        stop = min(start + BLOCK, last)
        present[:] = 0
        for slots, row in grams(texts, start, stop):
            at = table[slots]
            present[row[at >= 0], at[at >= 0]] = 1
        out[start - first : stop - first] = present[: stop - start] @ matrix
    return out


def mapped(kernel: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Coordinates of unit length and a last one for the intercept."""
    phi = kernel.astype(np.float64) @ root
    length = np.sqrt((phi * phi).sum(axis=1, keepdims=True))
    return np.hstack([phi / np.where(length > 0, length, 1.0), np.ones((len(phi), 1))])


def scores(kernel: np.ndarray, model: Model) -> np.ndarray:
    return mapped(kernel, model.root) @ model.weights


def landmarks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots, bits, norms and inverse root of the kernel matrix of the landmark ``texts``."""
    found = [np.unique(np.concatenate([s for s, _ in grams(texts, i, i + 1)] or [np.zeros(0, np.uint32)])) for i in range(len(texts))]
    slots = np.unique(np.concatenate(found))
    has = np.zeros((len(slots), len(texts)), np.float32)
    for i, x in enumerate(found):
        has[np.searchsorted(slots, x), i] = 1
    norms = np.sqrt(np.maximum(has.sum(axis=0, dtype=np.float64), 1.0))
    kernel = (has.T @ has).astype(np.float64) / np.outer(norms, norms)
    value, vector = np.linalg.eigh(kernel)
    # Landmarks that are copies of each other add nothing.
    keep = value > 1e-6 * max(value.max(), 1e-12)
    return slots.astype(np.int32), np.packbits(has.astype(bool), axis=1), norms, vector[:, keep] / np.sqrt(value[keep])


def ridge(phi: np.ndarray, label: np.ndarray, classes: int, strength: float = RIDGE) -> np.ndarray:
    """Weights by class of rows ``phi`` with class numbers ``label``; classes weigh the same, whatever their number of rows."""
    weight = 1.0 / np.maximum(np.bincount(label, minlength=classes), 1)[label]
    weight /= weight.sum()
    target = np.where(label[:, None] == np.arange(classes), 1.0, -1.0)
    left = (phi * weight[:, None]).T @ phi + strength * np.diag(np.append(np.ones(phi.shape[1] - 1), 0.0))
    return np.linalg.lstsq(left, (phi * weight[:, None]).T @ target, rcond=None)[0]


def fit(batches: Iterator[tuple[pa.Array, list[str]]], most: int = LANDMARKS) -> Model | None:
    """A model of the rows (texts, languages), of which the first ``most`` are the landmarks."""
    waiting, ahead, spoken, rows, parts = [], [], [], 0, None
    kernel: list[np.ndarray] = []

    def begin() -> tuple:
        first = pa.concat_arrays(waiting).slice(0, most)
        slots, bits, norms, root = landmarks(textkit.filled(first))
        shape = Model([], slots, bits, norms, root, np.zeros(0))
        return shape, places(slots), shape.matrix()

    def take(texts: pa.Array) -> None:
        kernel.append(kernels(texts, 0, len(texts), parts[1], parts[2]))

    for texts, langs in batches:
        spoken += langs
        rows += len(texts)
        if parts is None:
            waiting.append(texts)
            if rows < most:
                continue
            parts = begin()
            ahead, waiting = waiting, []
            for x in ahead:
                take(x)
        else:
            take(texts)
    if not rows:
        return None
    if parts is None:
        parts = begin()
        for x in waiting:
            take(x)
    shape = parts[0]
    known = sorted(set(spoken))
    label = np.searchsorted(known, spoken)
    weights = ridge(mapped(np.concatenate(kernel), shape.root), label, len(known))
    return Model(known, shape.slots, shape.bits, shape.norms, shape.root, weights)


def may_learn(key: Column) -> Column:
    """Whether the row may be learnt from: crc32 of the id as text is not 2 modulo 4."""
    return F.crc32(key.cast("string")) % 4 != 2


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def sample_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, sample: int = SAMPLE) -> DataFrame:
    """``(_k, _h, lang, text)`` of the at most ``sample`` rows to learn from; the first pass reads only ids and languages."""
    docs = docs.select(F.col(key).alias("_key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(may_learn(F.col("_key")) & F.col("lang").isNotNull())
    ids = docs.select("_key", "lang")
    # At most LANGS rows.  Of a language twice as many ids as are wanted pass, so that no task ranks all ids of a frequent one.
    sizes = ids.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGS)
    spread = F.shiftrightunsigned(F.xxhash64("_key"), 11) / float(1 << 53)
    near = ids.join(F.broadcast(sizes), "lang").where(spread < (2 * per_lang + 100) / F.col("_n")).select("_key", "lang", spread.alias("_s"))
    turn = Window.partitionBy("lang").orderBy("_s", "_key")
    chosen = near.withColumn("_k", F.row_number().over(turn)).where(F.col("_k") <= per_lang)
    chosen = chosen.orderBy("_k", "lang").limit(sample).groupBy("_key").agg(F.min("_k").alias("_k"))
    # At most ``sample`` ids; rows that share an id are bounded again.
    rows = docs.join(F.broadcast(chosen), "_key").where(has_letter(F.col("text")))
    rows = rows.groupBy("lang", F.xxhash64("text").alias("_h")).agg(F.min("_k").alias("_k"), F.first("text").alias("text"))
    return rows.orderBy("_k", "_h", "lang").limit(sample)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, sample: int = SAMPLE, most: int = LANDMARKS) -> Model | None:
    """The model of the bounded sample, fitted in one task; None where there is nothing to learn from."""
    rows = sample_rows(docs, key, text, lang, per_lang, sample).repartition(1).sortWithinPartitions("_k", "_h", "lang").select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(((textkit.filled(b.column(0)), b.column(1).to_pylist()) for b in batches if b.num_rows), most)
        if model is not None:
            flat = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([model.langs]), *map(flat, (model.slots, model.bits, model.norms, model.root, model.weights))], ["langs", "slots", "bits", "norms", "root", "weights"])

    with short_batches(docs.sparkSession, 500):
        out = rows.mapInArrow(textkit.lean(run), "langs array<string>, slots binary, bits binary, norms binary, root binary, weights binary").toArrow()
    if not out.num_rows:
        return None
    array = lambda name, kind: np.frombuffer(out[name][0].as_py(), kind)
    langs, slots, norms = out["langs"][0].as_py(), array("slots", np.int32), array("norms", np.float64)
    return Model(langs, slots, array("bits", np.uint8).reshape(len(slots), -1), norms, array("root", np.float64).reshape(len(norms), -1), array("weights", np.float64).reshape(-1, len(langs)))


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row's whole text."""
    if model is None:
        return docs.select(F.col(key).alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), has_letter(F.col(text)).alias("_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table, matrix, names = places(m.slots), m.matrix(), np.array(m.langs, object)
        for batch in batches:
            texts, letter = textkit.filled(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            found = scores(kernels(texts, 0, len(texts), table, matrix), m) if len(texts) else np.zeros((0, len(names)))
            # Rounded, so that the last bits of a product don't decide between languages.
            best = np.round(found, 9).argmax(axis=1)
            top = np.clip((found[np.arange(len(found)), best] + 1.0) / 2.0, 0.0, 1.0)
            said = np.where(letter, names[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(np.where(letter, top, 0.0), pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(textkit.lean(run), f"doc_id {rows.dtypes[0][1]}, lang_pred string, score double")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of each row, learnt from the rows that may be."""
    out = predict(docs, train(docs, key, text, lang), key, text)
    return out.select("doc_id", F.coalesce(~may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


QUERIES = {"op11_languages": op11_languages}

"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; where its top bits are zero, and the
chunk has at least ``LEAST`` bytes, a chunk ends, at the latest after ``MOST`` bytes.
The gear adds the table value of each byte and shifts left by one, so that in 16
bits a byte is forgotten after 16 steps: what was inserted before moves no later
boundary.  Cuts fall between characters only.  Chunks are told apart by two 64-bit
digests and their length.

A chunk repeats if it occurs at another place; runs of repeated chunks of at least
``RUN`` characters are passages.  The occurrence that comes first by (doc_id, row,
start) is the original; later ones are duplicates, which ``deduplicated`` cuts out.

Counting is combined map-side and only the digests that repeat are joined back,
from a table, so that AQE can split a passage that a third of all texts have.
Null texts count as empty and have no chunks; repeated rows are repeats of each
other; null ids come last; other columns, of whatever names, are kept by
``deduplicated`` and ignored by the query.  A text of any length is cut as a whole, in
memory in proportion to it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import documents, kept

LEAST, MOST = 16, 160
#: A cut is possible at one position in so many.
SPARSE_BITS = 5
RUN = 80
GEAR = np.random.default_rng(5).integers(0, 1 << 16, 256, dtype=np.uint16)
_TABLES = np.random.default_rng(6).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def cut_points(raw: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each text; ``bounds`` are the texts' places in ``raw``."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    ends = np.flatnonzero(h >> np.uint16(16 - SPARSE_BITS) == 0) + 1
    inner = np.append(raw, np.uint8(0))[ends] & np.uint8(0xC0) == 0x80
    ends = ends[~inner]
    starts = np.searchsorted(ends, bounds)
    out = []
    for i in range(len(bounds) - 1):
        at, stop = int(bounds[i]), int(bounds[i + 1])
        found = []
        for end in ends[starts[i] : starts[i + 1]].tolist():
            # The gear has not seen 16 bytes of this text before that.
            if end - at < LEAST or end >= stop:
                continue
            while end - at > MOST:
                at = _character(raw, at + MOST)
                found.append(at)
            if end - at >= LEAST:
                found.append(end)
                at = end
        while stop - at > MOST:
            at = _character(raw, at + MOST)
            found.append(at)
        if stop > at:
            found.append(stop)
        out.append(found)
    return out


def _character(raw: np.ndarray, at: int) -> int:
    while raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    out = []
    n = len(raw)
    for which in range(2):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES[which][raw] * textkit._power("up", textkit.BASE, n)[:n], out=total[1:])
        h = (total[ends] - total[starts]) * textkit._power("down", textkit.BASE_INVERSE, n + 1)[starts]
        out.append(textkit.mix(h + (ends - starts).astype(np.uint64)).view(np.int64))
    return out


def chunk(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``row`` (unique) and ``chunks``: array of struct(a, b, s, n): digests, start and length in characters."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = textkit.filled(batch.column(len(keep)))
            offsets = textkit.offsets_of(texts)
            for first, last in textkit.chunks(texts):
                k, lo = last - first, int(offsets[first])
                bounds = offsets[first : last + 1] - lo
                data = texts.buffers()[2]
                raw = np.frombuffer(data, np.uint8, int(bounds[-1]), lo) if data is not None and bounds[-1] else np.zeros(0, np.uint8)
                cuts = cut_points(raw, bounds)
                sizes = np.array([len(x) for x in cuts])
                ends = np.array([e for x in cuts for e in x], np.int64)
                row_start = np.repeat(bounds[:-1], sizes)
                starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
                starts = np.maximum(starts, row_start)
                letters = np.concatenate([[0], np.cumsum((raw & np.uint8(0xC0)) != 0x80)])
                a, b = _digests(raw, starts, ends)
                s = (letters[starts] - letters[row_start]).astype(np.int32)
                n = (letters[ends] - letters[starts]).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array(n)], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, k) for i in range(len(keep))), pa.array((task << 33) + done + np.arange(k)), lists], [*keep, "row", "chunks"]
                )
                done += k

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(textkit.lean(run), f"{fields}, row long, chunks array<struct<a:long,b:long,s:int,n:int>>")


PASSAGE = "array<struct<s:int,e:int>>"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring repeated chunks, of ``RUN`` characters at least: all, and those that come later than their originals."""
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for found in batch.column(1).to_pylist():
            found.sort(key=lambda x: x["s"])
            for only_later, result in zip((False, True), out):
                runs: list[dict] = []
                for x in found:
                    if only_later and not x["later"]:
                        continue
                    if runs and runs[-1]["e"] == x["s"]:
                        runs[-1]["e"] += x["n"]
                    else:
                        runs.append({"s": x["s"], "e": x["s"] + x["n"]})
                result.append([r for r in runs if r["e"] - r["s"] >= RUN])
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], kind), pa.array(out[1], kind)], ["row", "repeated", "duplicate"])


def passages(chunked: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(row, repeated, duplicate)`` for the rows of ``chunk`` (a kept table) that have repeated chunks."""
    rows = chunked.select(F.col(key).alias("id"), "row", F.explode("chunks").alias("c")).select("id", "row", "c.*")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "s")
    counted = rows.groupBy("a", "b", "n").agg(F.count("*").alias("times"), F.min(place).alias("first"))
    again = kept(counted.where("times > 1").select("a", "b", "n", F.col("first.row").alias("first_row"), F.col("first.s").alias("first_s")))
    later = (F.col("row") != F.col("first_row")) | (F.col("s") != F.col("first_s"))
    found = rows.join(again, ["a", "b", "n"]).select("row", F.struct("s", "n", later.alias("later")).alias("x"))
    found = found.groupBy("row").agg(F.collect_list("x").alias("found"))
    return found.mapInArrow(textkit.lean(_passages), f"row long, repeated {PASSAGE}, duplicate {PASSAGE}")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the later copies of passages cut out of ``text``; other columns as they are."""
    packed = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.struct(*docs.columns).alias("doc"))
    chunked = kept(chunk(packed, "text", ("id", "doc")))
    found = passages(chunked, "id").select("row", "duplicate")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    t = F.col("doc")[text]
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"])).alias("out"), x["e"].alias("at"))
    clean = F.aggregate("duplicate", start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    joined = chunked.drop("chunks").join(found, "row", "left")
    return joined.select(F.col("doc").withField(text, F.when(F.size("duplicate") > 0, clean).otherwise(t)).alias("doc")).select("doc.*")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = kept(chunk(documents(spark, sf_dir).select("doc_id", "text")))
    found = passages(chunked)
    spans = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["s"], x["e"])), ","), F.lit(""))
    letters = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"]), F.lit(0).cast("long"))
    slim = chunked.select("doc_id", "row", F.size("chunks").cast("long").alias("n_chunks"))
    return slim.join(found, "row", "left").select(
        "doc_id",
        "n_chunks",
        letters("repeated").alias("repeated_chars"),
        letters("duplicate").alias("duplicate_chars"),
        spans("repeated").alias("repeated_spans"),
        spans("duplicate").alias("duplicate_spans"),
    )


QUERIES = {"op8_substrings": op8_substrings}

"""Embedding near-dedup: sign hashing in several tables, exact cosines, components.

Each table has its own random hyperplanes; the signs of a vector against them are
its bucket.  Vectors of one bucket meet twice, in blocks of at most about ``BLOCK`` x
``BLOCK``; a bucket of many vectors is dealt over as many tasks as it has pairs of
blocks.  First only their ids and sketches meet, ``SKETCH`` signs against further
hyperplanes, and a block keeps the vectors that have a partner in it whose sketch is
near enough; only those send their vectors, in the precision they came in, to be compared
by exact cosine in double precision.  A pair counts in the first table where it shares a
bucket, so nobody has to list pairs to count each once: a task returns, per vector, how
many links it found, and enough links to connect what it found connected.

*Crowds.*  Near copies of one vector would be compared all with all.  So of each
bucket of more than ``BLOCK`` vectors in the first table a few members are leaders, and
vectors within half the angle of the threshold of a leader are its core: by the
triangle inequality any two of them link.  Pairs of a core are counted by its size
alone; its vectors get blocks of their own, and two blocks of one core never meet.

The number of planes follows the number of vectors (buckets keep about ``FILL``
vectors where vectors are spread evenly) and the number of tables follows from
it: a pair at the threshold is missed with a chance of at most ``MISS``, a closer
pair with less.  Of that chance a hundredth is for sketches: the signs that differ
between two vectors are a binomial number, and its tail tells how many are let pass.  Equal vectors are one vector that counts as often as it occurs.
A cosine is the product of the two vectors, each divided by its length; one that is
0.95 up to rounding may fall to either side.

Vectors that are null, empty, zero or hold a null or a number that isn't finite
link with nothing; so do vectors of different lengths.  Rows that repeat count
as other vectors; where rows share an id they share its component, and a null id
links and gets the component of its vector.  Labels and other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .common import components, forget, kept, short_batches
from .jaccard import runs

THRESHOLD = 0.95
MISS = 1e-4
FILL = 64
BLOCK = 512
LEADERS = 4
SEED = 11
#: Signs of a sketch, rows of blocks that are compared by sketches at once, rows of a partition of them.
SKETCH = 128
TOGETHER = 30_000
PART = 200_000


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Planes per table and tables for ``n`` vectors."""
    same = 1.0 - math.acos(threshold) / math.pi
    planes = min(30, max(6, math.ceil(math.log2(max(n, 1) / FILL + 1))))
    return planes, math.ceil(math.log(0.99 * miss) / math.log1p(-(same**planes)))


def sketch_limit(threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The least number of signs that more of differ in a pair at the threshold with a chance of at most a hundredth of ``miss`` only."""
    other = math.acos(threshold) / math.pi
    beyond, most = 1.0, -1
    while beyond > 0.01 * miss and most < SKETCH:
        most += 1
        beyond -= math.comb(SKETCH, most) * other**most * (1 - other) ** (SKETCH - most)
    return most


def signs(vectors: np.ndarray, planes: int, tables: int) -> np.ndarray:
    """Bucket of each vector in each table; the same for the first tables however many follow."""
    normals = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((tables * planes, vectors.shape[1]))
    bits = (vectors @ normals.T > 0).reshape(len(vectors), tables, planes)
    return bits.astype(np.int64) @ (1 << np.arange(planes))


def sketches(vectors: np.ndarray) -> np.ndarray:
    """``SKETCH`` signs of each vector against planes of their own, as rows of 64-bit numbers."""
    normals = np.random.default_rng([SEED, vectors.shape[1], 1]).standard_normal((SKETCH, vectors.shape[1]))
    return np.packbits(vectors @ normals.T > 0, axis=1).view(np.int64)


def _number(kind: T.DataType | pa.DataType) -> type:
    """What vectors are carried as: single precision if they are stored so."""
    return np.float32 if kind in (T.FloatType(), pa.float32()) else np.float64


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a vector that can link, and the vector as bytes of its numbers."""
    for batch in batches:
        column = batch.column(1)
        number = _number(column.type.value_type)
        n = np.array(column.value_lengths().fill_null(0), np.int64)
        flat = column.flatten().cast(pa.from_numpy_dtype(number)).to_numpy(zero_copy_only=False) + number(0.0)
        bounds = np.concatenate([[0], np.cumsum(n)])
        count = lambda which: (c := np.concatenate([[0], np.cumsum(which)]))[bounds[1:]] - c[bounds[:-1]]
        good = (count(np.isfinite(flat)) == n) & (count(flat != 0) > 0)
        offsets = np.concatenate([[0], np.cumsum(np.where(good, n, 0))]) * flat.itemsize
        data = flat[np.repeat(good, n)]
        raw = pa.Array.from_buffers(pa.large_binary(), len(n), [pa.array(good).buffers()[1], pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([batch.column(0), raw.cast(pa.binary())], ["vec_id", "raw"])


def _lengths(raw: pa.Array) -> np.ndarray:
    return np.diff(textkit.offsets_of(raw))


def _unit(raw: pa.Array, number: type) -> np.ndarray:
    """Vectors of one length, each divided by its length, in double precision."""
    offsets = textkit.offsets_of(raw)
    size = np.dtype(number).itemsize
    x = np.frombuffer(raw.buffers()[2], number, int(offsets[-1] - offsets[0]) // size, int(offsets[0])).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _runs_of_length(raw: pa.Array) -> Iterator[np.ndarray]:
    lengths = _lengths(raw)
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by ``keys`` as tables of ``TOGETHER`` rows or more that no run of equal keys goes on beyond, and where their runs start."""
    waiting: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(waiting).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            c = table[k].to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return table, np.flatnonzero(change)

    for batch in batches:
        waiting.append(batch)
        if sum(x.num_rows for x in waiting) >= TOGETHER:
            table, starts = joined()
            cut = int(starts[-1])
            waiting = table.slice(cut).to_batches()
            if cut:
                yield table.slice(0, cut), starts[:-1]
    if sum(x.num_rows for x in waiting):
        yield joined()


def _near(starts: np.ndarray, block: np.ndarray, across: np.ndarray, core: np.ndarray, sketch: np.ndarray, most: int) -> np.ndarray:
    """Which rows have a partner in their run whose sketch is near and whose core is another; ``across``: only of the other block."""
    n = len(block)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    found = np.zeros(n, bool)
    i = np.arange(n)
    step = 0
    while True:
        step += 1
        i = i[end[i] > i + step]
        if not len(i):
            return found
        j = i + step
        near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= most
        near &= ((core[i] < 0) | (core[i] != core[j])) & (~across[i] | (block[i] != block[j]))
        found[i[near]] = True
        found[j[near]] = True


def _compare(table: pa.Table, threshold: float, number: type) -> tuple[np.ndarray, ...] | None:
    """Of one pair of blocks: (node, links, low), ``low`` the smallest node that links lead to."""
    here, p, q = table["t"][0].as_py(), table["p"][0].as_py(), table["q"][0].as_py()
    block, node, times, core = (table[c].to_numpy() for c in ("block", "node", "times", "core"))
    unit = _unit(textkit.filled(table["raw"]), number)
    buckets = table["buckets"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)[:, :here]
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    linked = np.zeros((len(left), len(right)), bool)
    step = max(1, 1_000_000 // max(1, len(right) * (here + 2)))
    for a in range(0, len(left), step):
        i = left[a : a + step]
        near = (unit[i] @ unit[right].T) >= threshold
        if here:
            near &= ~(buckets[i][:, None, :] == buckets[right][None, :, :]).any(axis=2)
        near &= (core[i][:, None] != core[right][None, :]) | (core[i][:, None] < 0)
        linked[a : a + step] = near & (node[i][:, None] != node[right][None, :])
    links = np.zeros(len(node), np.int64)
    links[left] += linked @ times[right]
    if p != q:
        links[right] += times[left] @ linked
    return (node, links, _lowest(linked, node[left], node[right], left, right, len(node))) if linked.any() else None


def _lowest(linked: np.ndarray, x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Of each vector, the smallest node that the links of this pair of blocks lead to."""
    low = np.zeros(n, np.int64)
    low[left], low[right] = x, y
    big = np.iinfo(np.int64).max
    while True:
        old = low.copy()
        low[left] = np.minimum(low[left], np.where(linked, low[right][None, :], big).min(axis=1))
        low[right] = np.minimum(low[right], np.where(linked, low[left][:, None], big).min(axis=0))
        if (old == low).all():
            return low


def _cores(vectors: DataFrame, threshold: float, number: type = np.float64) -> DataFrame:
    """``(node, core)`` of the vectors near a leader of their crowd, a kept table; ``core`` is the leader's node."""
    place = ["first", "length"]
    rows = vectors.select("node", "length", "raw", F.get("buckets", F.lit(0)).alias("first"))
    lots = [F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), "node")).alias(f"l{j}") for j in range(LEADERS)]
    crowds = kept(rows.groupBy(*place).agg(F.count("*").alias("m"), *lots).where(F.col("m") > BLOCK))
    chosen = crowds.select(*place, F.explode(F.array_distinct(F.array(*(F.col(f"l{j}.node") for j in range(LEADERS))))).alias("node"))
    # At most LEADERS of a crowd are gathered; a crowd is dealt over parts, each with the leaders.
    leaders = chosen.join(vectors.select("node", "raw"), "node").groupBy(*place).agg(F.collect_list(F.struct("node", "raw")).alias("leaders"))
    parts = F.ceil(F.col("m") / (8 * BLOCK)).cast("int")
    leaders = leaders.join(crowds.select(*place, parts.alias("parts")), place)
    leaders = kept(leaders.select(*place, "leaders", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    members = rows.join(crowds.select(*place, parts.alias("parts")), place).withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    members = members.join(leaders, [*place, "part"]).select("node", "raw", "leaders")
    # Half the angle, and a little less for rounding.
    near = math.cos(math.acos(threshold) / 2) + 1e-9

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in _runs_of_length(batch.column(1)):
                node, raw, lists = (c.take(pa.array(at)) for c in batch.columns)
                row = np.repeat(np.arange(len(at)), np.array(lists.value_lengths()))
                names, raws = lists.flatten().flatten()
                names = names.to_numpy()
                hit = np.einsum("ij,ij->i", _unit(raw, number)[row], _unit(raws, number)) >= near
                # The same order of preference for all members.
                core = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(core, row[hit], names[hit])
                inside = np.flatnonzero(np.bincount(row[hit], minlength=len(at)))
                yield pa.RecordBatch.from_arrays([node.take(pa.array(inside)), pa.array(core[inside])], ["node", "core"])

    cores = kept(members.mapInArrow(textkit.lean(choose), "node long, core long"))
    forget(crowds, leaders)
    return cores


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``rows``."""
    with short_batches(rows.sparkSession):
        return _near_duplicates(rows, key, vector, threshold)


def _near_duplicates(rows: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    number = _number(rows.schema[vector].dataType.elementType)
    usable = kept(rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")).mapInArrow(textkit.lean(_usable), f"vec_id {kind}, raw binary").withColumn("digest", F.md5("raw")))
    distinct = kept(
        usable.where("raw is not null").groupBy("digest").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("times"), F.first("raw").alias("raw"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    n = distinct.count()
    planes, tables = plan(n, threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2)
            for at in _runs_of_length(raw):
                chosen = batch.take(pa.array(at))
                unit = _unit(chosen.column(2), number)
                got = signs(unit, planes, tables).astype(np.int32)
                sketch = sketches(unit)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, tables), pa.int32()), pa.array(got.ravel()))
                length = pa.array(_lengths(chosen.column(2)))
                words = [pa.array(np.ascontiguousarray(w)) for w in sketch.T]
                yield pa.RecordBatch.from_arrays([*chosen.columns, length, lists, *words], ["node", "times", "raw", "length", "buckets", "s0", "s1"])

    vectors = kept(distinct.select("node", "times", "raw").mapInArrow(textkit.lean(hashed), "node long, times long, raw binary, length long, buckets array<int>, s0 long, s1 long"))
    cores = _cores(vectors, threshold, number)
    inside = kept(cores.join(vectors.select("node", "times"), "node"))
    core_sizes = inside.groupBy("core").agg(F.sum("times").alias("all"), F.min("node").alias("low"))
    # Links among the vectors of a core, and a star that connects it.
    proven = inside.join(core_sizes, "core").select("node", (F.col("all") - F.col("times")).alias("links"), "low")

    place = ["t", "bucket", "length"]
    lone = F.coalesce("core", F.lit(-1).cast("long")).alias("core")
    sketched = kept(vectors.select("node", "length", "buckets", "s0", "s1").join(cores, "node", "left").withColumn("core", lone))
    slots = sketched.select("node", "core", "length", "s0", "s1", F.posexplode("buckets").alias("t", "bucket"))
    sizes = kept(slots.groupBy(*place, "core").agg(F.count("*").alias("m")))
    # A core with more than a block of its own in a bucket has blocks to itself; the others share theirs.
    own = F.when(F.col("m") > BLOCK, F.col("core")).otherwise(F.lit(-1).cast("long"))
    mine = sizes.select(*place, "core", own.alias("label"))
    shared = sizes.withColumn("label", own).groupBy(*place, "label").agg(F.sum("m").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    crowds = shared.select(*place, "m", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct("label", i.alias("i")))).alias("b"), (F.col("b.i") == 0).alias("once"))
    # One entry for each BLOCK vectors of a bucket.
    crowds = kept(crowds.groupBy(*place).agg(F.sum(F.when(F.col("once"), F.col("m")).otherwise(0)).alias("m"), F.array_sort(F.collect_list("b")).alias("list")).where("m > 1"))
    met = crowds.agg(F.sum(F.col("m") * F.size("list"))).first()[0]
    dealt = slots.join(mine.where("label >= 0"), [*place, "core"], "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long"))).join(crowds.drop("m"), place)
    count = F.size(F.filter("list", lambda b: b["label"] == F.col("label")))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("node", "t"), count).cast("int")).withColumn("block", (F.array_position("list", F.struct("label", "i")) - 1).cast("int"))
    dealt = dealt.select(*place, "node", "core", "s0", "s1", "label", "block", F.posexplode("list").alias("o", "b")).where("label < 0 or b.label <> label")
    cut = [*place, "p", "q"]
    dealt = dealt.select(*place, F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "block", "node", "core", "s0", "s1")
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(max(least_parts, math.ceil((met or 0) / PART)), *cut).sortWithinPartitions(*cut)
    most = sketch_limit(threshold)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole(batches, cut):
            p, q, block, core = (table[c].to_numpy() for c in ("p", "q", "block", "core"))
            sketch = np.stack([table[c].to_numpy() for c in ("s0", "s1")], axis=1).view(np.uint64)
            stay = table.filter(pa.array(_near(starts, block, p != q, core, sketch, most))).drop_columns(["s0", "s1"])
            yield from stay.to_batches()

    near = kept(dealt.mapInArrow(textkit.lean(thin), "t int, bucket int, length long, p int, q int, block int, node long, core long"))
    parts = max(least_parts, math.ceil(near.count() / (PART / 2)))
    near_vectors = near.join(vectors.select("node", "times", "raw", "buckets"), "node")
    near_vectors = near_vectors.repartition(parts, *cut).sortWithinPartitions(*cut).select(*cut, "block", "node", "core", "times", "raw", "buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, count = [], 0
        for table in runs(batches, cut):
            got = _compare(table, threshold, number)
            if got is not None:
                found.append(got)
                count += len(got[0])
            if count > 100_000:
                yield _summed(found)
                found, count = [], 0
        if found:
            yield _summed(found)

    found = kept(near_vectors.mapInArrow(textkit.lean(compare), "node long, links long, low long").union(proven.where("links > 0")))
    comps = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    links = kept(found.groupBy("node").agg(F.sum("links").alias("links")))
    each = kept(
        distinct.select("digest", "node", "times", "low_id").join(links, "node", "left").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node"))
    )
    least = kept(each.groupBy("root").agg(F.min("low_id").alias("least")))
    named = kept(each.join(least, "root").select("digest", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "least"))
    forget(distinct, vectors, cores, inside, sketched, sizes, crowds, near, found, links, each, least)
    out = usable.select("vec_id", "digest").join(named, "digest", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _summed(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Links summed by (node, low); a star of smallest nodes."""
    node, links, low = (np.concatenate(x) for x in zip(*found))
    node, links, low = (x[links > 0] for x in (node, links, low))
    pairs, at = np.unique(np.stack([node, low]), axis=1, return_inverse=True)
    total = np.bincount(at.ravel(), links).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(total), pa.array(pairs[1])], ["node", "links", "low"])


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES = {
    "op1_embeddings": """
with recursive v as (select vec_id, case when len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0 then embedding::double[] end e from embeddings),
linked as (select a.vec_id x, b.vec_id y from v a join v b on a.vec_id <> b.vec_id and a.e is not null and b.e is not null and len(a.e) = len(b.e)
  and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select x, y from linked union select r.x, l.y from reach r join linked l on r.y = l.x),
named as (select vec_id, (select count(*) from linked where x = vec_id) n_links, coalesce(least(vec_id, (select min(y) from reach where x = vec_id)), vec_id) component_id from v)
select vec_id, n_links, component_id, vec_id = component_id as kept from named"""
}
QUERIES = {"op1_embeddings": op1_embeddings}

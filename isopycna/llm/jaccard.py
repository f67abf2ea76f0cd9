"""N-gram Jaccard join by parity sketches; exact, and without all pairs of a group.

A text is the set of its distinct runs of ``WIDTH`` words, hashed to 64 bits; two
texts link when 100 * |A and B| >= 75 * |A or B|.  Equal sets are one class, so
copies meet only once.

*Sketches.*  XOR-ing the hash of every token into one of P cells gives a parity
sketch: a token that is in only one of two sets changes one cell, so the number
of unequal cells is at most the symmetric difference d, and for linked sets of
sizes s <= t, d <= (s + t) / 7 <= s / 3.  Sizes are split into bands, each with
its own P > d, so by the pigeonhole principle linked sets of a band share a
cell.  Each set emits the cells that are not empty, in its own band and, if a
smaller set could link to it, in the band below.  A set with at most d such
cells might share only empty ones; its links can only be missed if the other
set is short of cells too, and those sets also join on the tokens of a prefix.

*Candidates.*  Cells that classes share are groups.  A group proposes each
member with its smallest member, all pairs if there are at most ``SMALL``.  The
pairs pass a second sketch (one bit for each token, whose Hamming distance
bounds d in the same way) and are verified on whole sets.  Groups that then
still lie in several components compare all members of different components by
that sketch, in blocks, and what passes is verified too.  As linked sets share
more cells than one, each leaves out its largest groups first.

*Recovery and skew.*  Tasks forward a cell that repeats in their own rows only
once, so no group in the exchange grows with the number of members in a task.
Results of stages are tables in the shared folder.  Which texts are needed for
verification is told by a bit set of fixed size; what passes it by chance is
dropped by the join that follows.

Null and empty texts have no shingles and link with nothing; texts with fewer
words are one shingle, their whole sequence.  Rows that repeat are one class.
A null doc_id is never a component's id unless nothing else is there.  A text of any
length is hashed as a whole, in memory in proportion to it; an empty table gives no
rows; other columns, of whatever names, are ignored, or kept by ``one_of_each``.
Classes are told apart by a 64-bit digest of their sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit
from .common import components, documents, forget, kept, short_batches, whole_row

WIDTH = 5
SMALL = 4
HOT = 64
#: Cells a band has for each token of its largest set, over the least of 1/3.
CELLS = 1 / 2.5
PREFIX_BAND = 99
#: Added to the band of a class that goes on for a whole group that its task has closed.
FORWARDED = 128
#: Cells that a worker holds before it hands them on, shingles for each partition, buckets of a partition, cells in a
#: closed piece, members of a block.
FLUSH = 300_000
PART = 2_000_000
BUCKETS = 16
CLOSED = 20_000
BLOCK = 512
#: Bits of the set of wanted classes for each of them, and the least and the most bits.
WANTED, WANTED_LEAST, WANTED_MOST = 16, 1 << 20, 1 << 27
#: Groups with one leader are compared as one if that takes at most so many times the pairs.
MERGE = 2.0
U64 = np.uint64


def token_sets(texts: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens of each row, one after the other, and the rows' bounds in them."""
    h, bounds = textkit.shingles(*textkit.word_hashes(texts, first, last), WIDTH)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(h)]] = True
    sizes = np.concatenate([[0], np.cumsum(fresh)])[bounds]
    return h[fresh], sizes


def digests(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    n = np.diff(bounds).astype(np.uint64)
    part = lambda v: (c := np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)]))[bounds[1:]] - c[bounds[:-1]]
    one = part(textkit.mix(tokens ^ U64(0x7F4A7C15F39CC060)))
    two = part(textkit.mix(tokens + U64(0x1CEB9FE1A85EC53F)))
    return textkit.mix(one + textkit.mix(two + n))


def bit_sketches(tokens: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity of the tokens on each of 2**k >= 4 * size bits, at least 64."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        bits = 64
        while bits < 4 * (b - a):
            bits *= 2
        odd = np.bincount((tokens[a:b] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as those of fewer bits."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def band(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1] - 1


def cells(tokens: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the cells of each set with its class, the band, and by how many cells (0 to 255) it is safe from being missed."""
    n = np.diff(bounds)
    own = band(np.maximum(n, 1))
    low = band(np.maximum(-(-3 * n // 4), 1))
    short = np.zeros(len(n), bool)
    found = []
    for bands, live in ((own, n > 0), (low, (n > 0) & (low < own))):
        rows = np.flatnonzero(live)
        if not len(rows):
            continue
        take = np.repeat(live, n)
        t, row = tokens[take], np.repeat(np.arange(len(n)), np.where(live, n, 0))
        width = (np.exp2(bands + 1.0) * CELLS).astype(np.int64) + 1
        cell = ((t >> U64(24)) % width.astype(np.uint64)[row]).astype(np.int64)
        place = row << 34 | cell
        order = np.argsort(place, kind="stable")
        place, t = place[order], t[order]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parity = np.bitwise_xor.reduceat(textkit.mix(t), starts)
        row, cell = place[starts] >> 34, place[starts] & ((1 << 34) - 1)
        slack = np.bincount(row, minlength=len(n)) - n // 3
        short |= live & (slack <= 0)
        key = textkit.mix(parity + cell.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + textkit.mix(bands[row].astype(np.uint64)))
        found.append((key, classes[row], bands[row].astype(np.uint8), np.clip(slack[row], 0, 255).astype(np.uint8)))
    if short.any():
        rank = np.arange(len(tokens)) - np.repeat(bounds[:-1], n)
        lead = np.repeat(short, n) & (rank < np.repeat(n - (-(-3 * n // 4)) + 1, n))
        k = int(lead.sum())
        found.append((textkit.mix(tokens[lead] ^ U64(0x5BD1E9955BD1E995)), np.repeat(classes, n)[lead], np.full(k, PREFIX_BAND, np.uint8), np.zeros(k, np.uint8)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    return tuple(np.concatenate(x) for x in zip(*found))


CELL_SCHEMA = "bucket int, closed boolean, key binary, cls binary, band binary, slack binary"
CELL_TYPES = (np.uint64, np.uint64, np.uint8, np.uint8)
GROUP_SCHEMA = "pair boolean, key long, cls long, other long, band int, slack int"


def _sorted_cells(arrays: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Distinct (key, class), sorted, a forwarded one before its like; starts and lengths of the keys."""
    key, cls, bands = arrays[:3]
    order = np.lexsort((bands < FORWARDED, cls, key))
    key, cls = key[order], cls[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    order = order[fresh]
    arrays = tuple(x[order] for x in arrays)
    key = arrays[0]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return arrays, starts, np.diff(np.append(starts, len(key)))


def _cell_batch(buckets: list[int], closed: bool, pieces: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*pieces)]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([closed] * len(buckets)), *columns], ["bucket", "closed", "key", "cls", "band", "slack"])


def hand_on(arrays: tuple[np.ndarray, ...], buckets: int) -> Iterator[pa.RecordBatch]:
    """A worker's cells by bucket; a cell with many classes among them is closed here and only its first class goes on."""
    arrays, starts, lengths = _sorted_cells(arrays)
    if not len(starts):
        return
    many = lengths > HOT
    inside = np.repeat(many, lengths)
    if inside.any():
        ends = np.cumsum(lengths[many])
        a = 0
        while a < ends[-1]:
            # Whole keys, of about CLOSED cells together.
            b = int(ends[min(np.searchsorted(ends, a + CLOSED), len(ends) - 1)])
            closed = tuple(x[inside][a:b] for x in arrays)
            yield _cell_batch([int(closed[0][0] % U64(buckets))], True, [closed])
            a = b
        onward = ~inside
        onward[starts[many]] = True
        arrays[2][starts[many]] |= FORWARDED
        arrays = tuple(x[onward] for x in arrays)
    bucket = (arrays[0] % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    arrays = tuple(x[order] for x in arrays)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    for a in range(0, len(some), 512):
        here = some[a : a + 512].tolist()
        yield _cell_batch(here, False, [tuple(x[cuts[k] : cuts[k + 1]] for x in arrays) for k in here])


def _group_batches(arrays: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """Members of the cells that classes share, and the pairs they propose."""
    arrays, starts, lengths = _sorted_cells(arrays)
    shared = lengths > 1
    if not shared.any():
        return
    key, cls, bands, slack = (x[np.repeat(shared, lengths)] for x in arrays)
    forwarded, bands = bands >= FORWARDED, bands & np.uint8(FORWARDED - 1)
    lengths = lengths[shared]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    pairs = [(np.repeat(cls[starts], lengths), cls)]
    for size in range(3, SMALL + 1):
        at = starts[lengths == size]
        pairs += [(cls[at + i], cls[at + j]) for i in range(1, size) for j in range(i + 1, size)]
    a, b = (np.concatenate(x) for x in zip(*pairs))
    both = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
    # Groups all of whose pairs are proposed here are done with, unless a task has more members of them.
    open_ = np.repeat((lengths > SMALL) | np.logical_or.reduceat(forwarded, starts), lengths)
    key, cls, bands, slack = key[open_], cls[open_], bands[open_], slack[open_]
    n, m = len(key), both.shape[1]
    none = lambda k, t: pa.nulls(k, t)
    long = lambda x: pa.array(x.view(np.int64), pa.int64())
    names = ["pair", "key", "cls", "other", "band", "slack"]
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), long(key), long(cls), none(n, pa.int64()), pa.array(bands.astype(np.int32)), pa.array(slack.astype(np.int32))], names)
    if m:
        both = np.ascontiguousarray(both)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), none(m, pa.int64()), long(both[0]), long(both[1]), none(m, pa.int32()), none(m, pa.int32())], names)


def _bytes_of(column: pa.Array, dtype: type) -> np.ndarray:
    """The values of a binary column one after the other, as numbers."""
    offsets = textkit.offsets_of(column)
    data = column.buffers()[2]
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, dtype, int(offsets[-1] - offsets[0]) // size, int(offsets[0])) if data is not None else np.zeros(0, dtype)


def find_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of whole buckets, as rows of ``GROUP_SCHEMA``; cells are held as they came and grouped part by part."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        closed = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for row in np.flatnonzero(closed):
            piece = batch.slice(int(row), 1)
            yield from _group_batches(tuple(_bytes_of(piece.column(i + 2), t).copy() for i, t in enumerate(CELL_TYPES)))
        open_ = batch.filter(pa.array(~closed))
        if open_.num_rows:
            held.append(tuple(_bytes_of(open_.column(i + 2), t).copy() for i, t in enumerate(CELL_TYPES)))
    # A key's bucket is told by its low bits; other bits deal the keys of the partition once more.
    for part in range(BUCKETS):
        masks = [textkit.mix(x[0] ^ U64(0x2127599BF4325C37)) % U64(BUCKETS) == U64(part) for x in held]
        if held:
            yield from _group_batches(tuple(np.concatenate([x[i][m] for x, m in zip(held, masks)]) for i in range(len(CELL_TYPES))))


def describe(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_shingles, cls, sketch)``; class and sketch are null where there are no shingles."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textkit.filled(batch.column(1))
            for first, last in textkit.chunks(texts):
                tokens, bounds = token_sets(texts, first, last)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(digests(tokens, bounds).view(np.int64), pa.int64(), mask=n == 0),
                     pa.array(bit_sketches(tokens, bounds), pa.binary(), mask=n == 0)],
                    ["doc_id", "n_shingles", "cls", "sketch"],
                )

    return rows.mapInArrow(textkit.lean(run), f"doc_id {rows.dtypes[0][1]}, n_shingles long, cls long, sketch binary")


def shared_cells(docs: DataFrame, total: int, text: str = "text") -> DataFrame:
    """Rows of ``GROUP_SCHEMA`` for all cells that classes share; ``total`` is the number of shingles in ``docs``."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART))
    buckets = 2 * parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            texts = textkit.filled(batch.column(0))
            for first, last in textkit.chunks(texts):
                tokens, bounds = token_sets(texts, first, last)
                held.append(cells(tokens, bounds, digests(tokens, bounds)))
                count += len(held[-1][0])
                if count >= FLUSH:
                    yield from hand_on(tuple(np.concatenate(x) for x in zip(*held)), buckets)
                    held, count = [], 0
        if held:
            yield from hand_on(tuple(np.concatenate(x) for x in zip(*held)), buckets)

    return docs.select(F.col(text).alias("_text")).mapInArrow(textkit.lean(run), CELL_SCHEMA).repartition(parts, "bucket").mapInArrow(textkit.lean(find_groups), GROUP_SCHEMA)


def may_link(n_a: np.ndarray, n_b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether sizes and a lower bound of the symmetric difference leave room for a link."""
    return (4 * np.minimum(n_a, n_b) >= 3 * np.maximum(n_a, n_b)) & (7 * distance <= n_a + n_b)


def _words(sketch: pa.Scalar) -> np.ndarray:
    return np.frombuffer(sketch.as_buffer(), np.uint64)


def sketch_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(a, b, n_a, n_b, sk_a, sk_b)`` that sizes and sketches leave open, as ``(a, b)``."""
    for batch in batches:
        n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
        distance = np.zeros(batch.num_rows, np.int64)
        for i in np.flatnonzero(may_link(n_a, n_b, distance)):
            x, y = _words(batch.column(4)[i])[None], _words(batch.column(5)[i])[None]
            width = min(x.shape[1], y.shape[1])
            distance[i] = np.bitwise_count(folded(x, width) ^ folded(y, width)).sum()
        yield batch.select(["a", "b"]).filter(pa.array(may_link(n_a, n_b, distance)))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that are equal in ``keys``, of batches sorted by them."""
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        if waiting and any(waiting[-1][k][-1].as_py() != table[k][0].as_py() for k in keys):
            yield pa.concat_tables(waiting)
            waiting = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            piece = table.slice(a, b - a)
            waiting.append(piece)
            if b < table.num_rows:
                yield pa.concat_tables(waiting)
                waiting = []
    if waiting:
        yield pa.concat_tables(waiting)


def _compare(left: dict, right: dict, same: bool) -> Iterator[np.ndarray]:
    """Pairs of classes of different components that the sketches leave open; each side of one sketch length."""
    width = min(left["sketch"].shape[1], right["sketch"].shape[1])
    x, y = folded(left["sketch"], width), folded(right["sketch"], width)
    step = max(1, 500_000 // max(1, len(y) * width))
    for a in range(0, len(x), step):
        b = a + step
        distance = np.bitwise_count(x[a:b, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
        open_ = may_link(left["n"][a:b, None], right["n"][None, :], distance) & (left["comp"][a:b, None] != right["comp"][None, :])
        if same:
            open_ &= left["cls"][a:b, None] < right["cls"][None, :]
        i, j = np.nonzero(open_)
        if len(i):
            yield np.stack([left["cls"][a:b][i], right["cls"][j]])


#: What tells the pairs of blocks of the groups to be compared.
GROUP = ["merged", "gid", "p", "q"]


def compare_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pairs ``(a, b)`` of each group, or of each two blocks ``p <= q`` of a large one; each about once from a task."""
    held, count = [], 0
    for table in runs(batches, GROUP):
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        block = table["block"].to_numpy()
        raw = table["sketch"].combine_chunks()
        lengths = np.array([len(x) for x in raw.to_pylist()])
        numbers = {c: table[c].to_numpy() for c in ("cls", "n", "comp")}
        sides: dict[tuple[int, int], dict] = {}
        for which in {p, q}:
            for length in np.unique(lengths[block == which]).tolist():
                at = np.flatnonzero((block == which) & (lengths == length))
                words = np.frombuffer(b"".join(raw[int(i)].as_py() for i in at), np.uint64).reshape(len(at), -1)
                sides[which, length] = {c: v[at] for c, v in numbers.items()} | {"sketch": words}
        found = []
        for (b1, l1), left in sides.items():
            for (b2, l2), right in sides.items():
                if p != q and b1 == p and b2 == q:
                    found += _compare(left, right, False)
                elif p == q and l1 <= l2:
                    found += _compare(left, right, l1 == l2)
        held += found
        count += sum(x.shape[1] for x in found)
        if count > 500_000:
            held = [_distinct(held)]
            count = held[0].shape[1]
            if count > 250_000:
                yield _pair_batch(held[0])
                held, count = [], 0
    if held:
        yield _pair_batch(_distinct(held))


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs], ["a", "b"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``(a, b, set_a, set_b)`` that link, as ``(a, b)``."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = _words(batch.column(2)[i]), _words(batch.column(3)[i])
            both = np.sort(np.concatenate([x, y]))
            shared = int((both[1:] == both[:-1]).sum())
            good[i] = 100 * shared >= 75 * (len(both) - shared)
        yield batch.select(["a", "b"]).filter(pa.array(good))


def sets_of(docs: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """``(cls, tokens)`` of at least the classes in ``pairs(a, b)``, each once."""
    spark = docs.sparkSession
    wanted = kept(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct())
    size = WANTED_LEAST
    while size < min(WANTED_MOST, WANTED * wanted.count()):
        size *= 2
    slot = F.pmod(F.col("cls"), F.lit(size))
    # At most WANTED_MOST / 32 rows of a bit set reach the driver.
    words = wanted.select(slot.alias("s")).select((F.col("s") / 32).cast("int").alias("w"), F.expr("shiftleft(1L, cast(s % 32 as int))").alias("bit"))
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(size // 32, np.uint32)
    table[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            texts = textkit.filled(batch.column(0))
            for first, last in textkit.chunks(texts):
                tokens, bounds = token_sets(texts, first, last)
                names = digests(tokens, bounds)
                at = names % U64(size)
                hit = (bits[(at // U64(32)).astype(np.int64)] >> (at % U64(32)).astype(np.uint32)) & np.uint32(1)
                rows = [i for i in np.flatnonzero(hit & (np.diff(bounds) > 0)) if int(names[i]) not in seen]
                rows = list({int(names[i]): i for i in rows}.values())
                if len(seen) < 1_000_000:
                    seen.update(int(names[i]) for i in rows)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[rows].view(np.int64)), pa.array([tokens[bounds[i] : bounds[i + 1]].tobytes() for i in rows], pa.binary())], ["cls", "tokens"]
                    )

    found = docs.select(F.col(text).alias("_text")).mapInArrow(textkit.lean(run), "cls long, tokens binary")
    return found.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))


def links_among(docs: DataFrame, pairs: DataFrame, text: str = "text") -> DataFrame:
    """The pairs ``(a, b)`` of classes that link."""
    sets = kept(sets_of(docs, pairs, text))
    a = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("set_a"))
    b = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("set_b"))
    return kept(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(textkit.lean(verify), "a long, b long"))


def unresolved(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``(merged, gid, p, q, block, cls, comp)`` of the groups whose members are to be compared with each other, a kept table.

    Groups with the same smallest member, the leader, mostly hold the same
    members: they are compared as one group unless that would take more than ``MERGE``
    times the pairs.  A group is dealt in blocks by a hash of the member, each two
    blocks by themselves, so that no task grows with a group.
    """
    named = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    named = kept(named)
    spread = [F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")]
    open_ = kept(named.groupBy("key").agg(*spread).where((F.col("low") != F.col("high")) & (F.col("size") > SMALL)).select("key", "size"))
    rows = named.join(open_, "key")
    # Linked sets share at least ``slack`` cells.  With all cells in one order, small groups first, they share
    # one even if each set leaves out its last ``slack - 1``: nobody needs the largest groups to be found.
    largest = Window.partitionBy("cls", "band").orderBy(F.desc("size"), "key")
    rows = kept(rows.withColumn("place", F.row_number().over(largest)).where("place >= slack").select("key", "cls", "comp"))
    size = [F.count("*").alias("size"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("sum"), F.min("cls").alias("lead")]
    groups = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *size).where("low <> high")
    groups = kept(groups.groupBy("sum", "size", "lead").agg(F.min("key").alias("key")).select("key", "lead", "size"))
    rows = rows.join(groups, "key").select("key", "lead", "size", "cls", "comp")
    union = rows.groupBy("lead", "cls").agg(F.first("comp").alias("comp"))
    square = F.sum(F.col("size").cast("double") * F.col("size"))
    whole = union.groupBy("lead").agg(F.count("*").alias("all")).join(groups.groupBy("lead").agg(square.alias("pairs")), "lead")
    whole = kept(whole.select("lead", "all", (F.col("all").cast("double") * F.col("all") <= MERGE * F.col("pairs")).alias("merged")))
    one = union.join(whole.where("merged"), "lead").select("merged", F.col("lead").alias("gid"), F.col("all").alias("size"), "cls", "comp")
    each = rows.join(whole.where("not merged").select("lead", "merged"), "lead").select("merged", F.col("key").alias("gid"), "size", "cls", "comp")
    rows = one.unionByName(each)
    blocks = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("size") / BLOCK)))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.expr(f"cast(pmod(xxhash64(cls, {BLOCK}), blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    rows = rows.select("merged", "gid", "cls", "comp", "block", other)
    dealt = kept(rows.select("merged", "gid", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "block", "cls", "comp"))
    forget(named, open_)
    return dealt


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the smallest doc_id that links lead to, for each row of ``docs``."""
    with short_batches(docs.sparkSession):
        return _near_duplicates(docs, text, key)


def _near_duplicates(docs: DataFrame, text: str, key: str) -> DataFrame:
    described = kept(describe(docs, text, key))
    total = described.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    classes = kept(described.where("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    groups = kept(shared_cells(docs, total, text))
    proposed = groups.where("pair").select(F.col("cls").alias("a"), F.col("other").alias("b")).distinct()
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sk_{x}"))
    pairs = proposed.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sk_a", "sk_b")
    pairs = kept(pairs.mapInArrow(textkit.lean(sketch_filter), "a long, b long"))
    comps = components(links_among(docs, pairs, text))

    members = groups.where("not pair").select("key", "cls", "band", "slack").distinct()
    rest = unresolved(members, comps)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rest.count() / 50_000))
    more = rest.join(classes, "cls").repartition(parts, *GROUP).sortWithinPartitions(*GROUP)
    more = more.select(*GROUP, "block", "cls", "comp", "n", "sketch").mapInArrow(textkit.lean(compare_groups), "a long, b long")
    order = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    more = kept(more.select(*order).distinct().join(pairs.select(*order), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        edges = links_among(docs, more, text).union(comps.select(F.col("node").alias("a"), F.col("root").alias("b")))
        comps = components(edges)

    named = kept(
        described.drop("sketch").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    )
    least = kept(named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")))
    return named.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of smallest doc_id, null ids last, then of smallest hash of the row.

    Rows that are equal in all columns are one row.  Rows without words all stay.
    """
    rows = docs.select(whole_row(docs).alias("row"), F.col(key).alias("id"), F.col(text).alias("text"), F.struct(*docs.columns).alias("doc"))
    name = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    found = near_duplicates(rows.select(name.alias("name"), "text"), "text", "name")
    stay = kept(found.where("doc_id <=> component_id").select(F.col("doc_id.row").alias("row")).distinct())
    apart = F.when(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")), F.lit(-1)).otherwise(F.monotonically_increasing_id())
    return rows.select("row", apart.alias("apart"), "doc").join(stay, "row", "left_semi").dropDuplicates(["row", "apart"]).select("doc.*")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: From ``{docs}(doc_id, text)`` to ``components(doc_id, n_shingles, component_id)``.
COMPONENT_SQL = rf"""
words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') w from {{docs}}),
sets as (select doc_id, list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from words),
tokens as (select doc_id, len(s) n, unnest(s) t from sets),
linked as (select a.doc_id x, b.doc_id y from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach as (select x, y from linked union select r.x, l.y from reach r join linked l on r.y = l.x),
components as (select s.doc_id, cast(len(s.s) as bigint) n_shingles, coalesce(least(s.doc_id, (select min(r.y) from reach r where r.x = s.doc_id)), s.doc_id) component_id from sets s)
"""
ORACLES = {"op9_jaccard": f"with recursive {COMPONENT_SQL.format(docs='documents')} select * from components"}
QUERIES = {"op9_jaccard": op9_jaccard}

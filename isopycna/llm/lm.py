"""LM scoring: a gated recurrent model over a corpus-wide count table.

*Counts.*  Every token of every text that may be learnt from is counted: words
(A-Z lower-cased, runs outside white space), then one end token per text.  Tasks
sum their own words first; the table of all counts stays distributed.

*Model.*  The most frequent words are the vocabulary of a gated recurrent model
(``gru``); any other word is "another word" times its share of the remaining mass,
(c + 0.5) / (what is left of N + 0.5 * (V + 1)), which leaves 0.5 for the unseen.  So
a text's probability is one over whole texts, as the unigram base is.  The
recurrent part is trained on all these texts, each once, in ``ROUNDS`` rounds: a
round deals its share to partitions of about ``WORKER_TOKENS`` tokens, each trains from
the model so far, and the parameters are averaged by tokens, ``FAN`` sets at a time.
The number of partitions grows with the corpus, not their size; what is dealt are
the numbers of the words in the vocabulary, two bytes a token, in a table.

*Scoring.*  Texts run side by side in lanes, each from its own beginning to its
end with the state carried across windows.  Counts of the most frequent words
are broadcast (``HEAD`` words at most); rarer words of a text look theirs up in
the distributed table through a join.

Null texts count as empty, and an empty text is the end token alone.  Rows that
repeat are scored each for itself; rows with a null id are never learnt from and
are not held out.  Words are told apart by 64-bit hashes.  Texts of any length are one
row of numbers in one task.  Without a text to learn from, counts are zero and the
network is untrained; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import documents, forget, kept
from .gru import CLASS_SIZE, CLASSES, Gru, score, train

HEAD = 1 << 17
WORKER_TOKENS = 2_000_000
ROUNDS = 2
FAN = 16
PARAMETER_PARTS = 16
LN10 = float(np.log(10.0))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(False))


def may_learn(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 != 1, F.lit(False))


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows, each row's end token included, and the rows' bounds."""
    parts, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, last in textkit.chunks(texts):
        words, bounds = textkit.word_hashes(texts, first, last)
        parts.append(np.insert(words, bounds[1:], textkit.END))
        lengths.append(np.diff(bounds) + 1)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, c = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(h)
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.add.reduceat(c, at)


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(h, c)``: hash and count of each token of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = textkit.filled(batch.column(0))
            for first, last in textkit.chunks(texts):
                words, _ = token_stream(texts.slice(first, last - first))
                held.append(np.unique(words, return_counts=True))
                size += len(held[-1][0])
                if size > 1_500_000:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield _counts_batch(held[0])
                        held, size = [], 0
        if held:
            yield _counts_batch(_merged(held))

    return docs.select(F.col(text).alias("_text")).mapInArrow(textkit.lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _counts_batch(counts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts[0].view(np.int64)), pa.array(counts[1].astype(np.int64))], ["h", "c"])


class Lookup:
    """Place of a hash in a fixed list of distinct hashes, the first ones found fastest; -1 for others."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.append(hashes, np.uint64(0))
        self.mask = np.uint64((1 << self.BITS) - 1)
        slots = (hashes & self.mask).astype(np.int64)
        self.table = np.full(1 << self.BITS, len(hashes), np.int32)
        self.table[slots[::-1]] = np.arange(len(hashes))[::-1]
        crowded = np.flatnonzero(self.table[slots] != np.arange(len(hashes)))
        order = np.argsort(hashes[crowded])
        self.rest, self.rest_at = hashes[crowded][order], crowded[order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = self.table[(h & self.mask).astype(np.int64)]
        at[(self.hashes[at] != h) | (at == len(self.hashes) - 1)] = -1
        if len(self.rest):
            lost = np.flatnonzero(at < 0)
            i = np.minimum(np.searchsorted(self.rest, h[lost]), len(self.rest) - 1)
            hit = self.rest[i] == h[lost]
            at[lost[hit]] = self.rest_at[i[hit]]
        return at


class Model:
    """What scoring needs, of bounded size: head words and counts, totals, network parameters."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int):
        self.hashes, self.counts, self.tokens, self.distinct = hashes, counts, tokens, distinct
        self.mass = tokens + 0.5 * (distinct + 1)
        known = CLASSES * CLASS_SIZE - 1
        top = counts[:known] + 0.5
        self.rest = max(self.mass - top.sum(), 0.5)
        self.network_mass = np.zeros(CLASSES * CLASS_SIZE)
        self.network_mass[0] = self.rest
        self.network_mass[1 : len(top) + 1] = top
        self.parameters = Gru(self.network_mass).packed()

    def network(self) -> Gru:
        network = Gru(self.network_mass)
        network.unpack(self.parameters)
        return network

    def numbers(self, places: np.ndarray) -> np.ndarray:
        """Network numbers of head places; 0 for words outside its vocabulary."""
        return np.where((places >= 0) & (places < CLASSES * CLASS_SIZE - 1), places + 1, 0).astype(np.int32)


def fit(docs: DataFrame, counts: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """The model of ``docs``, all of which may be learnt from, and their ``counts``."""
    spark = docs.sparkSession
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.orderBy(F.desc("c"), "h").limit(HEAD).toArrow()
    model = Model(head["h"].to_numpy().astype(np.int64).view(np.uint64), head["c"].to_numpy().astype(np.float64), int(tokens), int(distinct))
    if not tokens:
        return model
    streams = kept(_streams(docs, model, text, key))
    workers = max(1, round(tokens / ROUNDS / WORKER_TOKENS))
    for turn in range(ROUNDS):
        model.parameters = _round(spark, streams.where(F.col("turn") == turn), model, workers)
    forget(streams)
    return model


def _streams(docs: DataFrame, model: Model, text: str, key: str) -> DataFrame:
    """``(place, turn, numbers)``: of each text its place in a random order, its round and the network numbers of its tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    turn = F.pmod(F.xxhash64(F.lit("turn"), F.col(key)), F.lit(ROUNDS)).cast("int")
    rows = docs.select(F.xxhash64(F.lit("train"), F.col(key)).alias("place"), turn.alias("turn"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lookup = Lookup(model.hashes)
        for batch in batches:
            texts = textkit.filled(batch.column(2))
            for first, last in textkit.chunks(texts):
                words, bounds = token_stream(texts.slice(first, last - first))
                numbers = model.numbers(lookup(words)).astype(np.uint16)
                raw = pa.array([numbers[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), raw], ["place", "turn", "numbers"])

    return rows.mapInArrow(textkit.lean(run), "place long, turn int, numbers binary")


def _round(spark: SparkSession, streams: DataFrame, model: Model, workers: int) -> np.ndarray:
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [x for b in batches for x in b.column(0).to_pylist()]
        if not raw:
            return
        numbers = np.frombuffer(b"".join(raw), np.uint16).astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])])
        del raw
        network = shared.value.network()
        train(network, numbers, bounds)
        salt = TaskContext.get().partitionId()
        parts = np.array_split(network.packed(), PARAMETER_PARTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PARAMETER_PARTS), pa.int32()), pa.array([salt] * PARAMETER_PARTS, pa.int32()), pa.array([float(len(numbers))] * PARAMETER_PARTS), pa.array([p.tobytes() for p in parts], pa.binary())],
            ["part", "salt", "weight", "mean"],
        )

    def add(table: pa.Table) -> pa.Table:
        weights = table["weight"].to_pylist()
        total = sum(np.frombuffer(x.as_py(), np.float32) * w for x, w in zip(table["mean"], weights)) / sum(weights)
        salt = pa.array([table["salt"][0].as_py() // FAN], pa.int32())
        return pa.table([table["part"][:1], salt, pa.array([sum(weights)]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "salt", "weight", "mean"])

    schema = "part int, salt int, weight double, mean binary"
    # No more partitions than there are shares of work: each returns a whole set of parameters.
    means = streams.repartition(workers).sortWithinPartitions("place", "numbers").select("numbers").mapInArrow(textkit.lean(run), schema)
    # A tree of means: no task holds more than FAN sets of a part, and one row for each part reaches the driver.
    left = workers
    while left > 1:
        means = means.groupBy("part", F.expr(f"salt div {FAN}")).applyInArrow(add, schema)
        left = -(-left // FAN)
    got = means.toArrow().sort_by("part")
    return np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in got["mean"]]) if got.num_rows else model.parameters


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_tokens, n_known, base_score, score`` (base-10 logarithms)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        network, lookup = model.network(), Lookup(model.hashes)
        logs = np.append(np.log10(model.counts + 0.5), 0.0)
        shift = float(np.log10(model.rest))
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = textkit.filled(batch.column(len(keep)))
            for first, last in textkit.chunks(texts, 8_000_000):
                n = last - first
                words, bounds = token_stream(texts.slice(first, n))
                row = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
                places = lookup(words)
                numbers = model.numbers(places)
                own = logs[places]
                base = np.bincount(row, own, n)
                value = score(network, numbers, bounds).astype(np.float64) / LN10
                other = numbers == 0
                value[other] += own[other] - shift
                del own, other, numbers
                rare = places < 0
                order = np.lexsort((words[rare], row[rare]))
                w, r = words[rare][order], row[rare][order]
                at = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])])) if len(w) else np.zeros(0, np.int64)
                times = np.diff(np.append(at, len(w)))
                cuts = pa.array(np.searchsorted(r[at], np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(first, n) for i in range(len(keep))),
                     pa.array((task << 33) + done + np.arange(n)), pa.array(np.diff(bounds)), pa.array(np.bincount(row, ~rare, n).astype(np.int64)),
                     pa.array(base), pa.array(np.bincount(row, value, n)),
                     pa.ListArray.from_arrays(cuts, pa.array(w[at].view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))],
                    [*keep, "_row", "n_tokens", "_known", "_base", "_score", "_rare", "_times"],
                )
                done += n

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    got = kept(rows.mapInArrow(textkit.lean(run), f"{fields}, _row long, n_tokens long, _known long, _base double, _score double, _rare array<long>, _times array<int>"))
    rare = got.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("x")).select("_row", F.col("x._rare").alias("h"), F.col("x._times").alias("times"))
    rare = rare.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = kept(rare.groupBy("_row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("_sum"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_more")
    ))
    extra = F.coalesce("_sum", F.lit(0.0))
    return got.join(sums, "_row", "left").select(
        *keep,
        "n_tokens",
        (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        (F.col("_base") + extra - F.col("n_tokens") * float(np.log10(model.mass))).alias("base_score"),
        (F.col("_score") + extra).alias("score"),
    )


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    learnt = docs.where(may_learn(F.col("doc_id")))
    counts = kept(count_tokens(learnt))
    model = fit(learnt, counts)
    return score_texts(docs, model, counts).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


QUERIES = {"op10_lm": op10_lm}

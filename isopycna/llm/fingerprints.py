"""Homomorphic document fingerprints, in DataFrame functions only.

A text is a multiset of paragraphs, its lines, and each paragraph one of pieces: it is cut at
marks that end sentences and clauses, and at ``PIECE`` characters.  Both are hashed to
wide vectors, and the vectors are summed modulo 2**32, lane by lane:

* ``EQUAL_LANES`` lanes of uniform 32-bit values, one vector for each paragraph that isn't empty and one
  for each line end, decide equality: texts have equal lanes when they have the same paragraphs, empty ones
  included, in any order;
* ``SIGN_LANES`` lanes that sum +1/-1, one vector for each piece, are a random projection of the multiset of
  pieces, whose cosine estimates how much two texts have in common.  (With paragraphs here, one edit would
  leave nothing of a document of two lines.)

Sums make fingerprints independent of the order of paragraphs, and inserting or
deleting paragraphs is one addition or subtraction (``combine``).  A fingerprint is an array of
signed ints, printed as the lanes in hexadecimal, 8 digits each.

Null texts count as empty; the empty text has no paragraph and the zero vector.  The likeness of
equal fingerprints is 1, of an empty text and another 0.  It differs from the
cosine c of the multisets by a standard error of about (1 - c*c) / sqrt(SIGN_LANES), and is cut off at 0.

The query pairs each row with the next in descending order of doc_id; null ids come
last, rows that share an id are ordered by a hash of the text, and rows equal in both
stand next to each other.  A table of one row is followed by itself, an empty
table gives no rows, other columns (of whatever names) are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, kept

PIECE = 24
PIECES = rf"[^\n.,!?;:|]{{1,{PIECE}}}[\n.,!?;:|\x20]*|[\n.,!?;:|\x20]+"
EQUAL_LANES = 8
#: Each hash gives 62 signs: two in each of 31 sums, so that a piece costs a few additions.
SIGN_HASHES = 2
SIGN_LANES = 62 * SIGN_HASHES
MASK = (1 << 32) - 1


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def wrapped(x: Column) -> Column:
    """A long modulo 2**32, as a signed int."""
    return ((x + (1 << 31)).bitwiseAND(F.lit(MASK)) - (1 << 31)).cast("int")


def fingerprints(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys`` and ``fp``, an array of ints: the sum of the vectors of the pieces of ``text``, for each key.

    Rows of one key must have the same text; repeats are divided out.  Paragraphs and pieces are
    exploded and summed in generated code, each row where it lies, before
    anything is exchanged; the text isn't.  A sum holds two lanes, 31 bits apart, of
    how many pieces have a bit set; n pieces of which c have it are a sign sum of 2*c - n.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = rows.select(*keys, F.posexplode_outer(F.when(whole != "", F.split(whole, "\n"))).alias("_line", "_t"))
    split = lines.select(*keys, "_line", "_t", F.posexplode_outer(pieces(F.col("_t"))).alias("_at", "_p"))
    # The first piece of a paragraph stands for it; an empty paragraph has a row without a piece, and only its line end counts.
    opens, ended = F.col("_at") == 0, (F.col("_line") > 0) & (F.coalesce("_at", F.lit(0)) == 0)
    begins = (F.coalesce("_line", F.lit(0)) == 0) & (F.coalesce("_at", F.lit(0)) == 0)
    sums, lanes = [F.count("_p").alias("_n"), F.sum(F.when(begins, 1).otherwise(0)).alias("_times")], []
    once = lambda c: F.expr(f"{c} div _times")
    for i in range(EQUAL_LANES // 2):
        h, end = F.when(opens, F.xxhash64("_t", F.lit(i))).otherwise(0), F.when(ended, F.xxhash64(F.lit("\n"), F.lit(i))).otherwise(0)
        for k, part in enumerate((lambda x: x.bitwiseAND(F.lit(MASK)), lambda x: F.shiftrightunsigned(x, 32))):
            sums.append(F.sum(part(h) + part(end)).alias(f"_e{2 * i + k}"))
    lanes += [once(f"_e{i}") for i in range(EQUAL_LANES)]
    n = once("_n")
    for i in range(SIGN_HASHES):
        h = F.when(F.col("_p").isNotNull(), F.xxhash64("_p", F.lit(EQUAL_LANES // 2 + i))).otherwise(0)
        sums += [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(1 | 1 << 31))).alias(f"_s{i}_{k}") for k in range(31)]
        for k in range(31):
            s = once(f"_s{i}_{k}")
            lanes += [2 * s.bitwiseAND(F.lit((1 << 31) - 1)) - n, 2 * F.shiftrightunsigned(s, 31) - n]
    # Keys and sums of fixed width are hashed, not sorted.
    return split.groupBy(*keys).agg(*sums).select(*keys, F.array(*map(wrapped, lanes)).alias("fp"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint after inserting (``sign`` 1) or deleting (-1) the pieces of ``b``."""
    return F.zip_with(a, b, lambda x, y: wrapped(x.cast("long") + sign * y.cast("long")))


def printed(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(MASK)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two multisets of pieces, from 0 to 1; 1 for equal fingerprints."""
    part = lambda v: F.transform(F.slice(v, EQUAL_LANES + 1, SIGN_LANES), lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, z: acc + z)
    x, y = part(a), part(b)
    cosine = dot(x, y) / F.nullif(F.sqrt(dot(x, x) * dot(y, y)), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


#: Ranges of the order for each shuffle partition.
RANGES = 4


def _order(key: str, text: str) -> list[Column]:
    """Descending ``key``, nulls last, then a hash of the text; all ascending, and of fixed width."""
    return [F.col(key).isNull().cast("int").alias("_o0"), F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit(0).cast("long")).alias("_o1"), F.xxhash64(text).alias("_o2")]


def _search(bounds: list[tuple], at: list[Column]) -> Column:
    """Number of ``bounds`` (sorted, at least one) that are not above ``at``: a binary search in a constant."""
    packed = json.dumps([{"a": a, "b": b, "c": c} for a, b, c in bounds])
    table = F.from_json(F.lit(packed), "array<struct<a:int,b:long,c:long>>")
    want = F.struct(at[0].alias("a"), at[1].alias("b"), at[2].alias("c"))
    lo, hi = (lambda s: s["lo"]), (lambda s: s["hi"])
    middle = lambda s: F.shiftright(lo(s) + hi(s), 1)

    def step(s: Column, _: Column) -> Column:
        below = F.get(table, middle(s)) <= want
        on = lo(s) < hi(s)
        return F.struct(F.when(on & below, middle(s) + 1).otherwise(lo(s)).alias("lo"), F.when(on & ~below, middle(s)).otherwise(hi(s)).alias("hi"))

    first = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), first, step, lambda s: s["lo"])


def in_order(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` dealt by ranges of ``key``, with ``_r``, the range, and the ``(_r, _next)`` text that follows the last row of each.

    The first pass exchanges only keys and hashes of texts, to find the first row
    of each range; so many of those, ``RANGES`` for a partition, reach the driver.
    The second exchanges whole rows, once.  Equal rows over several ranges are
    dealt over them by a hash of their place, for any of them may stand first.
    """
    spark = rows.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["_o0", "_o1", "_o2"]
    keys = rows.select(*_order(key, text), F.xxhash64(F.monotonically_increasing_id()).alias("_o3"))
    firsts = keys.repartitionByRange(ranges, *names, "_o3").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*names)).alias("low"))
    bounds = sorted((x.low._o0, x.low._o1, x.low._o2) for x in firsts.collect())
    bounds = bounds or [(0, 0, 0)]
    same: dict[tuple, int] = {}
    for x in bounds:
        same[x] = same.get(x, 0) + 1
    at = [F.col(c) for c in names]
    placed = rows.select("*", *_order(key, text)).withColumn("_r", F.greatest(F.lit(0), _search(bounds, at) - 1))
    crowded = {i: same[x] for i, x in enumerate(bounds) if same[x] > 1 and (i + 1 == len(bounds) or bounds[i + 1] != x)}
    if crowded:
        # Rows that are equal to the first row of several ranges: the search gives the last of them.
        table = F.create_map(*(F.lit(v) for i, x in crowded.items() for v in (i, x)))
        where = F.create_map(*(F.lit(v) for i in crowded for v in (i, json.dumps(bounds[i]))))
        mine = F.concat(F.lit("["), F.concat_ws(", ", *(c.cast("string") for c in at)), F.lit("]"))
        back = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.try_element_at(table, F.col("_r"))).cast("int")
        placed = placed.withColumn("_r", F.when(F.try_element_at(where, F.col("_r")) == mine, F.col("_r") - back).otherwise(F.col("_r")))
    starts = spark.createDataFrame([(i, *x) for i, x in enumerate(bounds)], "_r int, a int, b long, c long")
    # At most a row for each range, a number set above.
    wanted = F.broadcast(starts.select("a", "b", "c").distinct())
    found = rows.select(F.col(text).alias("_next"), *_order(key, text)).join(wanted, (F.col("_o0") == F.col("a")) & (F.col("_o1") == F.col("b")) & (F.col("_o2") == F.col("c")))
    found = found.groupBy("a", "b", "c").agg(F.first("_next").alias("_next"))
    edges = kept(found.join(starts, ["a", "b", "c"]).select(F.pmod(F.col("_r") - 1, F.lit(len(bounds))).alias("_r"), "_next"))
    return placed, edges


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as much from the beginning of ``following``."""
    third = F.expr("cast(_chars div 3 as int)")
    return F.concat(F.left(text, F.col("_chars") - third), F.left(following, third))


def compared(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp`` of each row, which the row of the next lower ``key`` follows.

    Nulls of ``key`` come last, rows of one key are ordered by a hash of the text,
    and after the last row comes the first.  The text is exchanged once.
    """
    rows = rows.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed, edges = in_order(rows, "doc_id", "text")
    order = Window.partitionBy("_r").orderBy("_o0", "_o1", "_o2")
    near = placed.withColumn("_lead", F.lead("text").over(order)).withColumn("_i", F.row_number().over(order))
    near = near.withColumn("_chars", F.length("text")).join(edges, "_r", "left")
    both = F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("t"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(1).alias("which"), F.col("_after").alias("t"), F.sha2("_after", 256).alias("sha")),
    )
    near = near.withColumn("_after", edited(F.col("text"), F.coalesce("_lead", "_next")))
    each = near.select("_r", "_i", "doc_id", "_chars", F.explode(both).alias("x")).select("_r", "_i", "doc_id", "_chars", "x.*")
    # The keys are constant within (_r, _i, which), by whose first column the rows are dealt already.
    summed = fingerprints(each, ["_r", "_i", "doc_id", "_chars", "which", "sha"], F.col("t"))
    pairs = Window.partitionBy("_r").orderBy("_i", "which")
    summed = summed.withColumn("edited_fp", F.lead("fp").over(pairs)).withColumn("sha", F.lead("sha").over(pairs)).withColumn("next_fp", F.lead("fp", 2).over(pairs))
    first = fingerprints(edges, ["_r"], F.col("_next")).withColumnRenamed("fp", "_first")
    out = summed.where("which = 0").join(first, "_r", "left")
    return out.select("doc_id", F.col("_chars").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), "fp", "edited_fp", F.coalesce("next_fp", "_first").alias("next_fp"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of ``documents``, repeats and null ids included; other columns are ignored."""
    return compared(documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("fp")).alias("fingerprint"),
        printed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


QUERIES = {"op7_fingerprints": op7_fingerprints}

"""Mixing sources to target weights by systematic sampling.

The size of a document is its number of words ``[^\\x20\\x09-\\x0D]+``.  Sources
in code-point order (null last) weigh 3, 1, 2, 3, 1, 2, ... and share ``SHARE`` of
all sizes; no target exceeds ``LIMIT`` times its source's size, and what a full
source leaves over is shared again by weight until none is above.

Within a source every document expects ``target / source_size`` copies.  The
documents are put in the order (size, md5 of doc_id, doc_id, digest of the row): sorting by size
makes the words taken follow the target to within about one document.  With a
random offset u per source, the document of rank r (from 0) is emitted once for
each integer in ``(u + r*e, u + (r+1)*e]``; that is at most twice.

Ranks need no source in one task: a rank is the number of smaller sizes in the
source, plus the number of smaller digest prefixes of that size, plus the place
within (source, size, prefix).  Prefixes lengthen with the root of the row count.

Null texts have size 0; null is a source of its own; equal rows are neighbours
in the order and are sampled one by one; other columns are kept.  An empty table
gives an empty result.  Targets are 0 where all sizes are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, kept, whole_row

SHARE = 1.5
LIMIT = 2.0
WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def targets(sizes: DataFrame, share: float = SHARE, limit: float = LIMIT, weights: tuple = WEIGHTS) -> DataFrame:
    """``(source, source_size, n)`` with ``target``: a row per source, so windows over all rows are small.

    Water-filling in closed form: sources fill up in the order of size over
    weight; the level is what is left of the total over the weight that is left,
    at the first source which that level does not fill.
    """
    everything = Window.partitionBy(F.lit(0))
    cycle = F.array(*map(F.lit, weights))
    s = sizes.withColumn("_i", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("_w", F.element_at(cycle, (F.col("_i") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", limit * F.col("source_size")).withColumn("_total", share * F.sum("source_size").over(everything))
    s = s.withColumn("_fill", F.col("_cap") / F.col("_w"))
    before = everything.orderBy("_fill", "_i").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / weight)
    level = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct(F.col("_fill"), F.col("_i"), F.col("_level")))).over(everything)
    s = s.withColumn("_at", level["_level"])
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_at") * F.col("_w")))
    return s.select("source", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` and ``row_hash`` of each row of ``docs``; ``mixed`` gives the mixture itself."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    columns = [F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), whole_row(docs).alias("row_hash")]
    return _mix(kept(docs.select(*columns)))


def _mix(rows: DataFrame) -> DataFrame:
    n = rows.count()
    digits = max(1, math.ceil(math.log(max(n, 1), 16) / 2))
    # Rows without an id are told apart by what else they hold.
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.col("row_hash"))))
    rows = rows.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, digits))
    by_prefix = kept(rows.groupBy("source", "size", "prefix").agg(F.count("*").alias("m")))
    by_size = kept(by_prefix.groupBy("source", "size").agg(F.sum("m").alias("m")))
    sources = targets(
        by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    )
    low = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("below", F.coalesce(F.sum("m").over(low), F.lit(0))).drop("m")
    same = Window.partitionBy("source", "size").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    by_prefix = by_prefix.withColumn("ahead", F.coalesce(F.sum("m").over(same), F.lit(0))).drop("m")
    place = kept(
        by_prefix.alias("p")
        .join(by_size.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.size") == F.col("s.size")))
        .join(sources.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .select("p.source", "p.size", "p.prefix", (F.col("below") + F.col("ahead")).alias("first"), "source_size", "target")
    )
    inside = Window.partitionBy("source", "size", "prefix").orderBy("digest", F.col("doc_id").asc_nulls_last(), "row_hash")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1)
    ranked = ranked.alias("r").join(
        place.alias("p"),
        F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")) & (F.col("r.prefix") == F.col("p.prefix")),
    )
    rank = F.col("first") + F.col("place")
    expected = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    name = F.concat(F.lit(SEED + ":"), F.coalesce("r.source", F.lit("")))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 4294967296.0
    copies = F.least(F.lit(int(LIMIT)), F.floor(offset + (rank + 1) * expected) - F.floor(offset + rank * expected))
    return ranked.select(
        "r.doc_id", "r.source", "r.size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("r.size")).cast("long").alias("taken"), "row_hash"
    )


def mixed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the mix takes it.

    Rows that are equal in all columns share their copies; of them one row stands for all.
    """
    picks = kept(mix(docs, text, key, source).where("copies > 0").groupBy("row_hash").agg(F.sum("copies").alias("_copies")))
    rows = docs.select(whole_row(docs).alias("row_hash"), F.struct(*docs.columns).alias("doc"))
    out = rows.join(picks, "row_hash").dropDuplicates(["row_hash"])
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


SIZE_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
#: From ``{docs}(doc_id, source, text)`` to the rows of ``mix``.
MIX_SQL = f"""
sized as (select doc_id, source, text, cast({SIZE_SQL} as bigint) as size from {{docs}}),
per as (select source, cast(sum(size) as bigint) source_size from sized group by source),
weighed as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3e0 when 1 then 1e0 else 2e0 end w,
  row_number() over (order by source nulls last) i, 2e0 * source_size cap, 1.5e0 * sum(source_size) over () total from per),
levels as (select *, (total - coalesce(sum(cap) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0e0))
  / (sum(w) over () - coalesce(sum(w) over (order by cap / w, i rows between unbounded preceding and 1 preceding), 0e0)) lev from weighed),
shares as (select source, source_size, coalesce(least(cap, w * (select lev from levels where lev <= cap / w order by cap / w, i limit 1)), cap) target from levels),
ranked as (select *, row_number() over (partition by source order by size, md5(coalesce(cast(doc_id as varchar), 'null')), doc_id nulls last) - 1 rank from sized),
offsets as (select r.*, p.source_size, p.target, coalesce(p.target / nullif(cast(p.source_size as double), 0e0), 0e0) e,
  cast(cast('0x' || md5('mix:' || coalesce(r.source, ''))[1:8] as bigint) as double) / 4294967296e0 u
  from ranked r join shares p on r.source is not distinct from p.source),
taken as (select *, least(2, cast(floor(u + (rank + 1) * e) - floor(u + rank * e) as bigint)) copies from offsets)
"""
ORACLES = {
    "op6_mixing": f"with {MIX_SQL.format(docs='documents')} select doc_id, size, source_size, target, cast(copies * size as bigint) taken, source, copies from taken"
}
QUERIES = {"op6_mixing": op6_mixing}

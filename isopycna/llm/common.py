"""What the corpus operators share: tables in the shared folder and connected components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_unset: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset and all is one process (tests), a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _unset:
        _unset[app] = "file://" + tempfile.mkdtemp(prefix="isopycna-")
    return _unset[app]


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage with a table that outlives executors, and gives later
    joins a plain exchange on this side, which AQE can split when it is skewed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/isopycna/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``kept`` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 2000, size: int = 2_000_000):
    """While this lasts, jobs hand rows to Python in batches of at most ``rows`` and about ``size`` bytes, for texts are long."""
    before = {}
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def whole_row(docs: DataFrame) -> Column:
    """A digest of all columns of a row, 128 bits as hexadecimal text: rows that share it are taken to be equal, so that any of them may stand for another.

    Hashes skip nulls, so which columns are null is hashed as well; nested values, which may
    hold nulls of their own, are hashed as JSON that keeps them.  Two hashes from different seeds, each chained
    over all columns, make up the digest: two of n different rows share one with a chance of about n*n / 2**129.
    """
    columns = [(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in docs.schema.fields]
    nested = ("array<", "map<", "struct<", "variant")
    values = [F.to_json(c, {"ignoreNullFields": "false"}) if t.startswith(nested) else c for c, t in columns]
    void = [c.isNull() for c, _ in columns]
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *void, *values)), 16, "0")
    return F.concat(half(0x2545F4914F6CDD1D), half(0x1B873593CC9E2D51))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``, root the smallest node.

    Only nodes that have an edge to another node appear; self-loops, repeats
    and rows with a null end are ignored.  Alternates large-star and small-star
    contractions; each step replaces the edges by at most as many, sums are
    combined map-side, and each result is a table in the shared folder, so
    neither a long chain nor a hub with a third of all nodes lands in one task.
    """
    e = kept(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(rounds):
        before = e
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = kept(large)
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = kept(small)
        forget(before, low, large, least)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

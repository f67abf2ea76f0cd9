"""Sinks and reloads: results by model, cubes by variable, lists and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def save(results: DataFrame, path: str, by: tuple[str, ...] = ("model",)) -> None:
    """Replace the partitions that ``results`` has and leave others; the committer makes each visible at once."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``save`` has written so far; no rows where there is nothing."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def put(spark: SparkSession, new: str, path: str) -> None:
    """Rename ``new`` to ``path``; where another run was first, its result stays."""
    at, files = _at(spark, path)
    if files.exists(at) or not files.rename(_at(spark, new)[0], at):
        if not files.exists(at):
            raise OSError(f"cannot rename {new}")
        files.delete(_at(spark, new)[0], True)


def replace(table: DataFrame, path: str, by: tuple[str, ...] = (), **options: str) -> None:
    """Write ``table`` beside ``path`` and put it there by renaming.

    The new table is whole before the old one is touched; if the second rename fails the
    first is undone, and a run that died between the two is made good by the next, from what lies
    beside.  A reader in that moment finds no table, never half of one.
    """
    spark = table.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    (at, files), before = _at(spark, path), _at(spark, old)[0]
    if not files.exists(at) and files.exists(before):
        files.rename(before, at)
    table.write.mode("overwrite").options(**options).parquet(new, partitionBy=list(by) or None)
    files.delete(before, True)
    if files.exists(at) and not files.rename(at, before):
        raise OSError(f"cannot rename {path}")
    if not files.rename(_at(spark, new)[0], at):
        if files.exists(before):
            files.rename(before, at)
        raise OSError(f"cannot rename {new}")
    files.delete(before, True)


def save_cube(cube: DataFrame, path: str, months: int = 12) -> None:
    """A long cube (variable, month, lat_bin, lon_bin, value), compressed, in chunks of ``months`` of a variable, each in the order of its axes."""
    chunk = F.floor(F.col("month") / months).cast("int").alias("chunk")
    dealt = cube.select("variable", "month", "lat_bin", "lon_bin", "value", chunk).repartition("variable", "chunk")
    ordered = dealt.sortWithinPartitions("variable", "chunk", "month", "lat_bin", "lon_bin")
    replace(ordered, path, ("variable", "chunk"), compression="zstd")


def save_batches(results: DataFrame, path: str, size: int = 5, key: str = "model") -> None:
    """``results`` in numbered batches of ``size`` keys each, in the order of the keys, which are few."""
    names = results.select(key).distinct().withColumn("batch", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size).cast("int"))
    replace(results.join(names, key), path, ("batch",))


def save_list(names: DataFrame, path: str) -> None:
    """One name per line."""
    names.select(names.columns[0]).coalesce(1).write.mode("overwrite").text(path)


def save_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def remaining(candidates: DataFrame, done: DataFrame, key: str = "model") -> DataFrame:
    """Candidates that ``done`` does not have: what a run that was stopped goes on with."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")

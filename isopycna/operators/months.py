"""Selection and checks along the month axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import checks


def islands(rows: DataFrame, by: tuple[str, ...] = ("model",), ym: str = "ym") -> DataFrame:
    """Runs of consecutive months."""
    w = Window.partitionBy(*by).orderBy(ym)
    runs = rows.select(*by, ym).distinct().withColumn("_run", F.col(ym) - F.row_number().over(w))
    return runs.groupBy(*by, "_run").agg(F.min(ym).alias("start_ym"), F.max(ym).alias("end_ym"), F.count("*").alias("n")).drop("_run")


def common(rows: DataFrame, kinds: int, months: int) -> DataFrame:
    """Last ``months`` of the latest run of months that all ``kinds`` variables have; ``short`` tells where the run has fewer."""
    shared = rows.groupBy("model", "ym").agg(F.countDistinct("variable").alias("k")).where(F.col("k") == kinds)
    runs = islands(shared)
    w = Window.partitionBy("model").orderBy(F.desc("end_ym"))
    last = runs.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    first = F.greatest("start_ym", F.col("end_ym") - months + 1)
    return last.select("model", (F.col("n") < months).alias("short"), F.explode(F.sequence(first, F.col("end_ym"))).alias("ym"))


def trailing(rows: DataFrame, years: int, keep: int) -> DataFrame:
    """Months of each (model, variable) in the window that ends with the earliest last month of the model's variables; at most ``keep`` of each."""
    checks.whole_years(12 * years)
    ends = rows.groupBy("model", "variable").agg(F.max("ym").alias("last")).groupBy("model").agg(F.min("last").alias("end"))
    inside = rows.join(ends, "model").where((F.col("ym") <= F.col("end")) & (F.col("ym") >= F.col("end") - 12 * years))
    w = Window.partitionBy("model", "variable").orderBy(F.desc("ym"))
    return inside.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).select("model", "variable", "ym")


def last(rows: DataFrame, n: int, by: tuple[str, ...] = ("model",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("ym"))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def rolling(rows: DataFrame, value: str, by: tuple[str, ...], order: str, half: int = 2) -> DataFrame:
    """Centred mean of ``2 * half + 1`` values; NULL where some are missing."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    x = F.when(F.count(value).over(w) == 2 * half + 1, F.avg(value).over(w))
    return rows.withColumn("rolling", x)


def normalized(rows: DataFrame, value: str, by: tuple[str, ...], order: str, first: int = 5) -> DataFrame:
    """``value`` over the mean of the first ``first`` values."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("_n", F.row_number().over(w.orderBy(order)))
    base = F.avg(F.when(F.col("_n") <= first, F.col(value))).over(w)
    return rows.withColumn("normalized", F.col(value) / F.nullif(base, F.lit(0.0))).drop("_n")

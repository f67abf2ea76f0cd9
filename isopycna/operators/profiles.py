"""Summaries and comparisons of density profiles (model, bin_idx, rho, fgen, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def negative_part(x: Column) -> Column:
    """``max(-x, 0)``; NULL stays NULL, which ``greatest`` alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(-x, F.lit(0.0)))


def percent_difference(value: Column, reference: Column) -> Column:
    return F.when(reference != 0, 100.0 * (value - reference) / F.abs(reference))


def trapezoid(rows: DataFrame, x: str, y: Column, by: tuple[str, ...], name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(x)
    rows = rows.withColumn("_y", y)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col("_y") + F.lag("_y").over(w)) / 2.0
    return rows.withColumn("_step", step).groupBy(*by).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias(name))


def at_minimum(rows: DataFrame, by: tuple[str, ...], value: str = "fgen", at: str = "rho") -> DataFrame:
    """The first row of smallest ``value``: a minimum of structs, combined map-side."""
    low = F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value), F.col(at))))
    return rows.groupBy(*by).agg(low.alias("_m")).select(*by, F.col(f"_m.{at}").alias("rho_at_min"), F.col(f"_m.{value}").alias("fgen_min"))


def summary(rows: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    low = rows.groupBy(*by).agg(F.min("fgen").alias("fgen_min"), F.sum("area_sum").alias("area_total"))
    return low.join(trapezoid(rows, "rho", negative_part(F.col("fgen")), by, "negative_integral"), list(by))


def compare(rows: DataFrame, reference: str) -> DataFrame:
    """Differences of each method of ``rows`` (model, method, bin_idx, rho, fgen, area_sum) from ``reference``, by model.

    Profiles are matched on the number of the class by a window over the few
    methods, so nothing is computed twice and nothing is joined.
    """
    own = F.col("method") == reference
    at = Window.partitionBy("model", "bin_idx")
    along = Window.partitionBy("model", "method").orderBy("rho")
    low = negative_part(F.col("fgen"))
    t = rows.withColumn("_d", F.col("fgen") - F.max(F.when(own, F.col("fgen"))).over(at))
    t = t.withColumn("_y", low).withColumn("_s", (F.col("rho") - F.lag("rho").over(along)) * (F.col("_y") + F.lag("_y").over(along)) / 2.0)
    t = t.groupBy("model", "method").agg(
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"), F.max(F.abs("_d")).alias("max_abs"),
        F.min("fgen").alias("fgen_min"), F.coalesce(F.sum("_s"), F.lit(0.0)).alias("negative_integral"), F.sum("area_sum").alias("area_total"),
    )
    whole = Window.partitionBy("model")
    pct = [percent_difference(F.col(c), F.max(F.when(own, F.col(c))).over(whole)).alias(f"{c}_pct") for c in ("fgen_min", "negative_integral", "area_total")]
    return t.select("model", "method", "rmse", "max_abs", *pct).where(F.col("method") != reference)

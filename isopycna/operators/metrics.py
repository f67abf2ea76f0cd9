"""Metrics of months and fields: conditional areas, weighted means, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area_where(cells: DataFrame, condition: Column, by: tuple[str, ...] = ("model", "ym")) -> DataFrame:
    """Area of the cells under ``condition``, 0 for months without any."""
    return cells.groupBy(*by).agg(F.coalesce(F.sum(F.when(condition, F.col("area"))), F.lit(0.0)).alias("area_sum"))


def weighted_mean(cells: DataFrame, value: str, condition: Column, by: tuple[str, ...] = ("model", "ym")) -> DataFrame:
    """Area-weighted mean, its two sums and the number of cells; NULL mean where there is no area."""
    a, v = F.when(condition, F.col("area")), F.when(condition, F.col(value) * F.col("area"))
    total, area = F.sum(v), F.sum(a)
    return cells.groupBy(*by).agg(
        (total / F.nullif(area, F.lit(0.0))).alias("mean"), F.coalesce(area, F.lit(0.0)).alias("area_sum"), F.coalesce(total, F.lit(0.0)).alias("weighted_sum"),
        F.count(a).alias("n_points"),
    )


def field_summary(cells: DataFrame, value: str, by: tuple[str, ...] = ("model",)) -> DataFrame:
    x = F.col(value)
    return cells.groupBy(*by).agg(F.avg(x.isNotNull().cast("double")).alias("finite_fraction"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"))


def series_summary(series: DataFrame, value: str, by: tuple[str, ...] = ("model",)) -> DataFrame:
    x = F.col(value)
    return series.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.stddev_samp(x).alias("std"))


def linear_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of degree one; no R2 for a constant ``y``."""
    fit = points.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("_r2"), F.var_pop(y).alias("_var"), F.count("*").alias("n")
    )
    return fit.select("slope", "intercept", F.when(F.col("_var") > 0, F.col("_r2")).alias("r2"), "n")

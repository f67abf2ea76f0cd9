"""Overturning strength from (model, ym, basin, lev, lat, msftmz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In order of preference; the last matches any label that has the letter.
PREFERRED = ("atlantic_arctic_ocean", "atlantic_ocean", "atlantic", "north_atlantic", "a")


def label(*names: Column) -> Column:
    return F.lower(F.trim(F.coalesce(*names)))


def chosen_basin(labels: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Of each key's labels (label, idx) the first that equals or contains the earliest preference."""
    rank = F.lit(None).cast("int")
    for k in reversed(range(len(PREFERRED))):
        rank = F.when(F.contains("label", F.lit(PREFERRED[k])), k).otherwise(rank)
    hits = labels.withColumn("rank", rank).where("rank is not null")
    return hits.groupBy(*by).agg(F.min(F.struct("rank", "idx", "label")).alias("m")).select(*by, "m.label", "m.rank")


def atlantic(rows: DataFrame) -> DataFrame:
    return rows.where(label(F.col("basin")) == PREFERRED[0])


def climatology(rows: DataFrame, factor: float = 1e9) -> DataFrame:
    return rows.groupBy("model", "lev", "lat").agg((F.avg("msftmz") / factor).alias("sv"))


def strength(mean: DataFrame, south: float = 0.0, north: float = 60.0, depth: float = 250.0) -> DataFrame:
    """Maximum of the mean field."""
    return mean.where(F.col("lat").between(south, north) & (F.col("lev") >= depth)).groupBy("model").agg(F.max("sv").alias("strength"))


def yearly_strength(rows: DataFrame, depth: float | None = 250.0) -> DataFrame:
    """Mean over each year's months of the monthly maximum, strictly below ``depth``."""
    t = rows if depth is None else rows.where(F.col("lev") > depth)
    top = t.groupBy("model", "ym").agg((F.max("msftmz") / 1026.0 / 1e6).alias("sv"))
    return top.groupBy("model", F.floor(F.col("ym") / 12).cast("int").alias("year")).agg(F.avg("sv").alias("sv"), F.count("*").alias("n"))

"""Places on the sphere and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def north_atlantic(lat: Column, nlon: Column) -> Column:
    """Strictly north of 45, between 90 west and 60 east inclusive."""
    return (lat > 45.0) & nlon.between(-90.0, 60.0)


def region(lat: Column, nlon: Column, south: float = 50.0, north: float = 70.0, west: float = -90.0, east: float = 60.0) -> Column:
    return lat.between(south, north) & nlon.between(west, east)


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def bin_of(x: Column, low: float, size: float, count: int) -> Column:
    """Index of the half-open bin that holds ``x``; NULL outside, the upper end included."""
    k = F.floor((x - low) / size).cast("int")
    return F.when((x >= low) & (x < low + size * count), k)


def month_text(ym: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(ym / 12).cast("int"), (ym % 12 + 1).cast("int"))


def yyyymm(ym: Column) -> Column:
    return (F.floor(ym / 12) * 100 + ym % 12 + 1).cast("int")


def years_before(ym: Column, years: int) -> Column:
    """The same month ``years`` earlier, in any calendar."""
    return ym - 12 * years


def same_day_before(day: Column, years: int) -> Column:
    """The same month and day ``years`` earlier; 28 February where 29 does not exist."""
    return F.add_months(day, -12 * years)


def fixed_areas(cells: DataFrame, doubled: tuple[str, ...] = (), reversed_: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` (model, j, i, ...) without the last row of ``doubled`` models, which repeats the one before, and with ``j`` turned around for ``reversed_`` ones."""
    ends = cells.groupBy("model").agg(F.max("j").alias("_mj"))
    t = cells.join(F.broadcast(ends), "model").where(~(F.col("model").isin(*doubled) & (F.col("j") == F.col("_mj"))))
    return t.withColumn("j", F.when(F.col("model").isin(*reversed_), F.col("_mj") - F.col("j")).otherwise(F.col("j"))).drop("_mj")

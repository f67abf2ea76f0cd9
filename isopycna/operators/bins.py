"""Integration of surface forcing over density classes.

Bins are numbered from 0; bin k holds densities from ``lower + k * step``.  Sums
are two-phase aggregates on (model, month or nothing, bin), so a month's cells
never meet in one task; empty bins are filled from a range, not from the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Classes:
    """Density classes as ``numpy.arange(rho_min - step, rho_max + step, step)`` makes them."""

    rho_min: float = 1015.0
    rho_max: float = 1030.0
    step: float = 0.05

    def __post_init__(self):
        if not self.step > 0 or not self.rho_max > self.rho_min:
            raise ValueError("step must be positive and rho_min below rho_max")

    @property
    def edges(self) -> np.ndarray:
        return np.arange(self.rho_min - self.step, self.rho_max + self.step, self.step)

    @property
    def lower(self) -> float:
        return float(self.edges[0])

    @property
    def upper(self) -> float:
        return float(self.edges[-1] + self.step)

    @property
    def count(self) -> int:
        return len(self.edges)

    def index(self, rho: Column) -> Column:
        """Class of ``rho``: an inner edge belongs to the class above, both ends to none."""
        k = F.floor((rho - self.lower) / self.step).cast("int")
        return F.when((rho > self.lower) & (rho < self.upper), F.least(k, F.lit(self.count - 1)))

    def center(self, index: Column) -> Column:
        return F.round(self.lower + index * self.step + self.step / 2.0, 6)


SUMS = {"fgen": "fsurf", "heat_flux": "heat", "freshwater_flux": "fw"}


def class_sums(cells: DataFrame, by: list[str], index: Column, scale: float) -> DataFrame:
    """Area-weighted sums of the forcing and the area, by ``by`` and class.

    A NULL flux adds nothing; the area of a cell counts wherever its density is known.
    """
    sums = [(F.coalesce(F.sum(F.col(x) * F.col("area")), F.lit(0.0)) / scale).alias(n) for n, x in SUMS.items()]
    return cells.withColumn("bin_idx", index).where("bin_idx is not null").groupBy(*by, "bin_idx").agg(*sums, F.sum("area").alias("area_sum"))


def filled(sums: DataFrame, frame: DataFrame, by: list[str], classes: Classes) -> DataFrame:
    """``sums`` with a row of zeros for each class that a row of ``frame`` (columns ``by``) lacks."""
    bins = frame.select(*by, F.explode(F.sequence(F.lit(0), F.lit(classes.count - 1))).alias("bin_idx"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in (*SUMS, "area_sum")]
    return bins.join(sums, [*by, "bin_idx"], "left").select(*by, "bin_idx", classes.center(F.col("bin_idx")).alias("rho"), *zero)


def monthly(cells: DataFrame, months: DataFrame, classes: Classes) -> DataFrame:
    """Every class of each (model, ym) of ``months``."""
    return filled(class_sums(cells, ["model", "ym"], classes.index(F.col("rho")), classes.step * 1e6), months, ["model", "ym"], classes)


def profile(cells: DataFrame, months: DataFrame, classes: Classes, index: Column | None = None) -> DataFrame:
    """Mean over all months of ``months``, those with an empty class included."""
    n_time = months.groupBy("model").agg(F.count("*").alias("n_time"))
    k = classes.index(F.col("rho")) if index is None else index
    sums = filled(class_sums(cells, ["model"], k, classes.step * 1e6), n_time.select("model"), ["model"], classes)
    return sums.join(n_time, "model").select("model", "bin_idx", "rho", *((F.col(c) / F.col("n_time")).alias(c) for c in (*SUMS, "area_sum")))


def strict_index(classes: Classes) -> Column:
    """A density on an edge belongs to no class."""
    k = classes.index(F.col("rho"))
    return F.when(F.col("rho") != classes.lower + k * classes.step, k)


def right_open(cells: DataFrame, step: float) -> DataFrame:
    """Sums by (model, ym) and class [a, b), classes counted from the lowest density of the model's first month; only classes with cells."""
    first = cells.groupBy("model").agg(F.min("ym").alias("ym"))
    low = cells.join(first, ["model", "ym"]).groupBy("model").agg(F.min("rho").alias("low"), F.max("rho").alias("high"))
    near = cells.join(low, "model").where((F.col("rho") >= F.col("low")) & (F.col("rho") < F.col("high")))
    return class_sums(near, ["model", "ym"], F.floor((F.col("rho") - F.col("low")) / step).cast("int"), step * 1e6)

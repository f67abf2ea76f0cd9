"""Checks that gate a result: each returns the rows that break a rule, or raises with them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A result broke a rule; the message has the first offenders."""


def whole_years(months: int) -> int:
    """The years that ``months`` make up; raises where there is a part of a year, or none."""
    if months != int(months) or months <= 0 or months % 12:
        raise ValueError(f"{months} months are no whole years")
    return int(months) // 12


def ordered(**ends: tuple[float, float]) -> None:
    """Raise unless the first end of each range is below the second, and both are finite numbers."""
    for name, (low, high) in ends.items():
        if not (math.isfinite(low) and math.isfinite(high) and low < high):
            raise ValueError(f"{name}: {low} must be below {high}")


def none_of(offenders: DataFrame, rule: str, shown: int = 5) -> None:
    """Raise unless ``offenders`` is empty."""
    rows = offenders.limit(shown).collect()
    if rows:
        raise CheckFailed(f"{rule}: {[r.asDict() for r in rows]}")


def empty_grids(models: DataFrame, cells: DataFrame) -> DataFrame:
    """Models without a single cell."""
    return models.select("model").distinct().join(cells.select("model").distinct(), "model", "left_anti")


def mixed_units(attrs: DataFrame) -> DataFrame:
    """Variables whose models disagree in ``units``."""
    return attrs.groupBy("variable").agg(F.sort_array(F.collect_set("units")).alias("units")).where(F.size("units") > 1)


def cohort_faults(have: DataFrame, expected: list[str], excluded: list[str] = ()) -> DataFrame:
    """Models that are missing, unexpected or excluded; names are a short list given by hand."""
    if set(expected) & set(excluded):
        raise ValueError("a model is both expected and excluded")
    want = have.sparkSession.createDataFrame([(m,) for m in expected], "model string")
    names = have.select("model").distinct()
    missing = want.join(names, "model", "left_anti").withColumn("fault", F.lit("missing"))
    more = names.join(want, "model", "left_anti").withColumn("fault", F.when(F.col("model").isin(*excluded), "excluded").otherwise("unexpected") if excluded else F.lit("unexpected"))
    return missing.unionByName(more)


def derived_gaps(cells: DataFrame, inputs: tuple[str, ...], derived: str) -> DataFrame:
    """Rows where all ``inputs`` are present but ``derived`` is not."""
    ok = F.lit(True)
    for c in inputs:
        ok = ok & F.col(c).isNotNull()
    return cells.where(ok & F.col(derived).isNull())


def broken_months(rows: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Months that occur twice in a key."""
    return rows.groupBy(*by, "ym").agg(F.count("*").alias("n")).where("n > 1")

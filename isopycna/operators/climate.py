"""Monthly climatologies and the equal-weight multi-model mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import eos, forcing

FIELDS = ("tos", "sos", "hfds", "wfo")
PRODUCTS = (*FIELDS, "rho", "heat", "fw", "fsurf")


def climatology(binned: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Mean of the present values by model, calendar month and target cell, and how many there were."""
    month = (F.col("ym") % 12 + 1).cast("int").alias("month")
    out = [F.avg(f).alias(f) for f in fields] + [F.count(f).alias(f"n_{f}") for f in fields]
    return binned.groupBy("model", month, "lat_bin", "lon_bin").agg(*out)


def model_products(climate: DataFrame) -> DataFrame:
    """Density and forcing of each model's climatology; only cells where all four fields are present."""
    ok = F.lit(True)
    for f in FIELDS:
        ok = ok & F.col(f).isNotNull()
    return forcing.with_forcing(eos.with_density(climate.where(ok)))


def multi_model_mean(products: DataFrame) -> DataFrame:
    """Mean over models by month and cell with the number of models; derived fields are means of each model's own."""
    return products.groupBy("month", "lat_bin", "lon_bin").agg(*(F.avg(c).alias(c) for c in PRODUCTS), F.count("*").alias("model_count"))


def mean_area(area: DataFrame, n_models: int) -> DataFrame:
    """Mean area over all models, a missing one counting as 0."""
    return area.groupBy("lat_bin", "lon_bin").agg((F.sum("area") / n_models).alias("area"))

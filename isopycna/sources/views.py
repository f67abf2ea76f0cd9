"""The canonical tables: monthly surface fields, cells, overturning, the file catalogue.

Each is a long DataFrame; missing values, NaN and infinities are NULL from here on,
so that sums and means skip them.  Months are counted as ``ym = year * 12 + month - 1``,
which survives any model calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import eos, forcing, geo, means


def finite(x: Column) -> Column:
    """``x``, or NULL where it is NaN or infinite."""
    bad = F.isnan(x) | (x == float("inf")) | (x == float("-inf"))
    return F.when(~bad, x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month_index(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


FIELDS = ("tos", "sos", "hfds", "wfo")
#: Where they cancel out, the sign of the forcing is that of their rounding errors.
FLUXES = ("hfds", "wfo")


def surface_rows(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(model, ym, cell_id, tos, sos, hfds, wfo) as they come, any number of rows for a model, month and cell.

    With ``only``, rows of other cells are dropped.
    """
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", month_index(F.col("l_shipdate")).alias("ym"))
    model = F.col("l_suppkey") % 8
    if only is not None:
        t = t.join(only.select(F.col("cell_id").alias("l_partkey")), "l_partkey", "left_semi")
    t = t.where((F.col("ym") * 7 + model) % 29 != 0)
    tos = F.sqrt((F.round(F.col("l_extendedprice") * 100.0).cast("long") % 3999).cast("double") + 0.5) / 2.0
    return t.select(
        F.concat(F.lit("M"), model.cast("string")).alias("model"),
        "ym",
        F.col("l_partkey").alias("cell_id"),
        finite(F.when(F.col("l_linenumber") != 7, tos)).alias("tos"),
        finite(30.0 + F.col("l_quantity") * 0.1 + F.col("l_discount") * 10.0).alias("sos"),
        finite((F.col("l_tax") - 0.04) * 5000.0).alias("hfds"),
        finite(F.when(F.col("l_linenumber") != 6, (F.col("l_discount") - 0.05) * 0.001)).alias("wfo"),
    )


def surface_cells(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, exact: tuple[str, ...] = ()) -> DataFrame:
    """(model, ym, cell_id, tos, sos, hfds, wfo), one row for each model, month and cell.

    With ``only``, rows of other cells are dropped before anything is aggregated.  Means of the fields in ``exact``
    don't depend on the order of rows.
    """
    mean = {f: means.exact_mean if f in exact else F.avg for f in FIELDS}
    return surface_rows(spark, sf_dir, only).groupBy("model", "ym", "cell_id").agg(*(mean[f](F.col(f)).alias(f) for f in FIELDS))


def model_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, ym) that have any cell, from the two columns that tell it."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("k"), month_index(F.col("l_shipdate")).alias("ym"))
    return t.where((F.col("ym") * 7 + F.col("k")) % 29 != 0).select(F.concat(F.lit("M"), F.col("k").cast("string")).alias("model"), "ym").distinct()


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, j, i, lat, lon, area)."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("cell_id"),
        F.floor(k / 50.0).cast("long").alias("j"),
        (k % 50).alias("i"),
        (((k * 37) % 1800) / 10.0 - 90.0 + 0.05).alias("lat"),
        (((k * 91) % 3600) / 10.0).alias("lon"),
        ((k % 97 + 1) * 1e9).alias("area"),
    )


def with_corners(places: DataFrame) -> DataFrame:
    """Cells with ``corners``: four places around each, counter-clockwise from the lower left, a skewed convex quadrilateral."""
    h = F.least(F.lit(4.0), (90.0 - F.abs("lat")) / 2.0)
    at = lambda up, right: F.struct((F.col("lat") + h * up).alias("lat"), (F.col("lon") + right).alias("lon"))
    return places.withColumn("corners", F.array(at(-1.0, -3.0), at(-0.5, 3.0), at(1.0, 2.0), at(0.5, -3.5)))


def mesh(places: DataFrame) -> DataFrame:
    """(cell_id, j, i, lat, lon): the cells on a wavy mesh of 50 columns, of which the last meets the first."""
    rows = places.agg((F.max("j") + 1).alias("_n"))
    i, j = F.radians(F.col("i") * 7.2), F.radians(F.col("j") * 40.0)
    lat = -75.0 + 150.0 * (F.col("j") + 0.3 * F.sin(i)) / F.col("_n")
    return places.crossJoin(F.broadcast(rows)).select("cell_id", "j", "i", lat.alias("lat"), (F.col("i") * 7.2 + 3.0 * F.cos(j) - 180.0).alias("lon"))


def overturning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, ym, basin, lev, lat, msftmz); basin names as they come, with trailing blanks."""
    k = F.col("o_orderkey")
    basin = F.when(k % 3 == 0, "atlantic_arctic_ocean ").when(k % 3 == 1, "indian_pacific_ocean").otherwise("global_ocean")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("M"), (F.col("o_custkey") % 8).cast("string")).alias("model"),
        month_index(F.col("o_orderdate")).alias("ym"),
        basin.alias("basin"),
        (((k * 7) % 20) * 250.0).alias("lev"),
        (((k * 13) % 180) - 90.0 + 0.5).alias("lat"),
        ((F.col("o_totalprice") - 150000.0) * 100000.0).alias("msftmz"),
    )


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, variable, grid, start_ym, end_ym, version, seq)."""
    k = F.col("o_orderkey")
    variable = F.when(k % 5 == 0, "tos").when(k % 5 == 1, "sos").when(k % 5 == 2, "hfds").when(k % 5 == 3, "wfo").otherwise("msftmz")
    start = month_index(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").where(k % 6 == 0).select(
        F.concat(F.lit("M"), (F.col("o_custkey") % 40).cast("string")).alias("model"),
        variable.alias("variable"),
        F.when(k % 4 == 0, "gr").otherwise("gn").alias("grid"),
        start.alias("start_ym"),
        (start + 5 + k % 60).alias("end_ym"),
        (k % 9).alias("version"),
        k.alias("seq"),
    )


def derived(spark: SparkSession, sf_dir: str, mask: Column | None = None, exact: tuple[str, ...] = ()) -> DataFrame:
    """Surface cells with their place, density, contraction and expansion, and forcing; of the cells under ``mask`` (lat, nlon) only.

    What looks at the sign of the forcing takes ``exact`` means of ``FLUXES``.
    """
    place = cells(spark, sf_dir).withColumn("nlon", geo.normalized_longitude(F.col("lon")))
    if mask is not None:
        place = place.where(mask)
    t = surface_cells(spark, sf_dir, None if mask is None else place, exact).join(place, "cell_id")
    return forcing.with_forcing(eos.with_density(t))

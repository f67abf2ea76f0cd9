"""The file catalogue: names, groups, versions, coverage and availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SURFACE = ("tos", "sos", "hfds", "wfo")
#: var_table_model_experiment_variant_grid_start-end.nc, or without dates.
TIME_NAME = r"^([A-Za-z0-9]+)_([A-Za-z0-9]+)_([A-Za-z0-9-]+)_([A-Za-z0-9-]+)_(r\d+i\d+p\d+f\d+)_(g[a-z0-9]+)_(\d{6})-(\d{6})\.nc$"
STATIC_NAME = r"^([A-Za-z0-9]+)_([A-Za-z0-9]+)_([A-Za-z0-9-]+)_([A-Za-z0-9-]+)_(r\d+i\d+p\d+f\d+)_(g[a-z0-9]+)\.nc$"


def parse(files: DataFrame, name: str = "filename") -> DataFrame:
    """``files`` with the parts of the name; NULL parts and kind ``other`` where it does not parse."""
    timed, static = F.regexp_like(F.col(name), F.lit(TIME_NAME)), F.regexp_like(F.col(name), F.lit(STATIC_NAME))
    part = lambda i: F.when(timed, F.regexp_extract(name, TIME_NAME, i)).when(static, F.regexp_extract(name, STATIC_NAME, i))
    date = lambda i: F.when(timed, F.regexp_extract(name, TIME_NAME, i)).try_cast("int")
    names = ("p_variable", "p_table", "p_model", "p_experiment", "p_variant", "p_grid")
    return files.withColumns(
        {n: part(i + 1) for i, n in enumerate(names)}
        | {"p_start": date(7), "p_end": date(8), "kind": F.when(timed, "time").when(static, "static").otherwise("other")}
    )


def with_all(files: DataFrame, variables: tuple[str, ...] = SURFACE, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Keys that have every one of ``variables``."""
    hit = files.where(F.col("variable").isin(*variables))
    return hit.groupBy(*by).agg(F.countDistinct("variable").alias("n")).where(F.col("n") == len(variables)).select(*by)


def newest(files: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def required(files: DataFrame, by: tuple[str, ...], months: int) -> DataFrame:
    """Files that reach into the last ``months`` of their key, with ``threshold, last`` and ``start`` clipped to it."""
    w = Window.partitionBy(*by)
    last = F.max("end_ym").over(w)
    t = files.withColumn("last", last).withColumn("threshold", F.col("last") - months + 1)
    return t.where("end_ym >= threshold").withColumn("start", F.greatest("start_ym", "threshold"))


def _sweep(by: tuple[str, ...]) -> tuple[Column, Window]:
    w = Window.partitionBy(*by).orderBy("start", "end_ym", "seq")
    return F.max("end_ym").over(w.rowsBetween(Window.unboundedPreceding, -1)), w


def gaps(files: DataFrame, by: tuple[str, ...], months: int) -> DataFrame:
    """First month that no file covers, by key; NULL where there is none."""
    before, _ = _sweep(by)
    t = required(files, by, months).withColumn("before", before)
    cursor = F.coalesce(F.col("before") + 1, F.col("threshold"))
    return t.groupBy(*by).agg(F.min(F.when(F.col("start") > cursor, cursor)).alias("gap_from"), F.count("*").alias("n_files"))


def overlaps(files: DataFrame, by: tuple[str, ...], months: int) -> DataFrame:
    before, _ = _sweep(by)
    t = required(files, by, months).withColumn("before", before)
    return t.groupBy(*by).agg(F.coalesce(F.bool_or(F.col("start") <= F.col("before")), F.lit(False)).alias("overlap"))


def availability(files: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """0/1 by model and variable."""
    return files.groupBy("model").pivot("variable", list(variables)).agg(F.max(F.lit(1))).fillna(0, list(variables))


def greedy_cover(files: DataFrame, by: tuple[str, ...], years: int) -> DataFrame:
    """Files chosen walking back from the last year: of those that cover the year the one that starts first, then ends last, then comes first.

    The steps of a key depend on each other, so this is a recursive query: each
    step is one join of one open year per key, and keys run side by side.
    """
    spark = files.sparkSession
    keys = ", ".join(by)
    # The walk moves by years, so only the distinct intervals of a key in years matter.
    slim = files.select(*by, F.floor(F.col("start_ym") / 12).cast("int").alias("y0"), F.floor(F.col("end_ym") / 12).cast("int").alias("y1"), "seq")
    slim = slim.groupBy(*by, "y0", "y1").agg(F.min("seq").alias("seq"))
    # For each year of a key, the file that would be chosen.
    w = Window.partitionBy(*by, "y").orderBy("y0", F.desc("y1"), "seq")
    every = slim.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    last = Window.partitionBy(*by)
    every = every.withColumn("top", F.max("y1").over(last)).withColumn("low", F.col("top") - years + 1).where("y >= low")
    on = " and ".join(f"e.{k} = c.{k}" for k in by)
    return spark.sql(f"""
        with recursive chosen({keys}, y0, y1, seq, low, step) max recursion level 1000 as (
          select {keys}, y0, y1, seq, low, 1 from {{every}} where y = top
          union all
          select e.{", e.".join(by)}, e.y0, e.y1, e.seq, e.low, c.step + 1 from {{every}} e join chosen c on {on} and e.y = c.y0 - 1 where c.y0 - 1 >= c.low)
        select {keys}, y0, y1, seq, step from chosen""", every=every)

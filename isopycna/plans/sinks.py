"""Queries that go through files: sinks and what is read back from them, and NetCDF written and scanned."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regrid
from ..sources import adapters, results, scratch, views
from . import runs
from .registry import query
from .sql import given

GRID = regrid.Grid(10.0)
MONTHLY = "select model, ym, count(*) n, round(sum(area) / 1e9, 3) area from surface_cells join cells using (cell_id) where tos is not null group by 1, 2"


def _monthly(spark, d) -> DataFrame:
    t = views.surface_cells(spark, d).where("tos is not null").join(views.cells(spark, d).select("cell_id", "area"), "cell_id")
    return t.groupBy("model", "ym").agg(F.count("*").alias("n"), F.round(F.sum("area") / 1e9, 3).alias("area"))


def _field(spark, d) -> DataFrame:
    cells = views.cells(spark, d).withColumn("nlon", F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0)
    return regrid.binned(views.surface_cells(spark, d).join(cells, "cell_id"), "tos", GRID).select("model", "ym", "lat_bin", "lon_bin", F.col("tos").alias("value"))


@query("result_reload", given("surface_cells", "cells") + MONTHLY)
def result_reload(spark, d) -> DataFrame:
    """Saved for some models, then for others, then read back as one."""
    path, t = scratch.folder(spark), _monthly(spark, d)
    results.save(t.where("model < 'M4'"), path)
    results.save(t.where("model >= 'M4'"), path)
    return results.load(spark, path, t.schema).select("model", "ym", "n", "area")


@query("result_replace", given("surface_cells", "cells") + f"select * from ({MONTHLY}) where n > 1")
def result_replace(spark, d) -> DataFrame:
    """A whole result replaced by another under the same name."""
    path, t = scratch.folder(spark), _monthly(spark, d)
    results.replace(t, path)
    results.replace(t.where("n > 1"), path, compression="zstd")
    return spark.read.schema(t.schema).parquet(path)


@query("cube_write", given("binned") + "select ym % 12 \"month\", lat_bin, lon_bin, round(avg(tos), 6) tos, cast(ym % 12 // 6 as int) chunk from binned where tos is not null group by 1, 2, 3, 5")
def cube_write(spark, d) -> DataFrame:
    path = scratch.folder(spark)
    cells = GRID.assign(views.cells(spark, d).withColumn("nlon", F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0))
    t = views.surface_cells(spark, d).where("tos is not null").join(cells.select("cell_id", "lat_bin", "lon_bin"), "cell_id")
    cube = t.groupBy((F.col("ym") % 12).cast("int").alias("month"), "lat_bin", "lon_bin").agg(F.avg("tos").alias("value")).withColumn("variable", F.lit("tos"))
    results.save_cube(cube, path, 6)
    return spark.read.parquet(path).where("variable = 'tos'").select("month", "lat_bin", "lon_bin", F.round("value", 6).alias("tos"), "chunk")


@query("batch_dump", given("surface_cells", "cells", t=MONTHLY, b="select model, cast((row_number() over (order by model) - 1) // 3 as int) batch from (select distinct model from surface_cells)")
       + "select t.*, batch from t join b on b.model = t.model")
def batch_dump(spark, d) -> DataFrame:
    path = scratch.folder(spark)
    results.save_batches(_monthly(spark, d), path, 3)
    return spark.read.parquet(path).select("model", "ym", "n", "area", "batch")


@query("list_sink", given("surface_cells") + "select distinct model as \"name\" from surface_cells")
def list_sink(spark, d) -> DataFrame:
    path = scratch.folder(spark)
    results.save_list(views.model_months(spark, d).select("model").distinct(), path)
    return spark.read.text(path).withColumnRenamed("value", "name")


@query("report_sink", given("surface_cells", "cells") + f"select model, cast(count(*) as bigint) n_months, cast(sum(n) as bigint) n_cells from ({MONTHLY}) group by 1")
def report_sink(spark, d) -> DataFrame:
    path = scratch.folder(spark)
    results.save_report(_monthly(spark, d).groupBy("model").agg(F.count("*").alias("n_months"), F.sum("n").alias("n_cells")), path)
    return spark.read.schema("model string, n_months long, n_cells long").json(path)


THIN = "thin as (select *, n < 0.8e0 * (select avg(n) from t) bad from t), m as (select model, count(*) n, count(case when bad then 1 end) faults, min(case when bad then 'month ' || ym || ' has ' || n || ' cells' end) first from thin group by 1)"


def _isolated(spark, d, times: int) -> str:
    """So many runs of all models, of which those with more than two months of few cells fail: all the others are made, once."""
    path, t = scratch.folder(spark), _once(spark, _monthly(spark, d))
    usual = t.agg(F.avg("n").alias("usual"))
    rows = t.crossJoin(F.broadcast(usual))
    fault = F.when(F.col("n") < 0.8 * F.col("usual"), F.concat(F.lit("month "), F.col("ym").cast("string"), F.lit(" has "), F.col("n").cast("string"), F.lit(" cells")))
    for _ in range(times):
        runs.run_checked(spark, path, {"step": 0.05}, rows, fault, tolerated=2)
    return path


@query("error_isolation", given("surface_cells", "cells", t=MONTHLY) + f""", {THIN} select model, case when faults > 2 then 'failed' else 'done' end status, case when faults > 2 then faults || ' faults, first: ' || first end message,
 case when faults > 2 then 2 else 1 end tries, case when faults > 2 then 0 else n end saved from m""")
def error_isolation(spark, d) -> DataFrame:
    """What became of each model, how often it was tried, and how many months of it are there."""
    path = _isolated(spark, d, 2)
    log = runs.log(spark, path).groupBy("model", "status", "message").agg(F.count("*").cast("int").alias("tries"))
    there = spark.read.parquet(f"{path}/results").groupBy("model").agg(F.count("*").alias("saved"))
    return log.join(there, "model", "left").fillna(0, ["saved"])


@query("timing_capture", given("surface_cells", "cells", t=MONTHLY) + f", {THIN} select model, round(n / sum(n) over (), 6) share from m")
def timing_capture(spark, d) -> DataFrame:
    """Every model has its share of the seconds of the run, good or bad."""
    t = runs.log(spark, _isolated(spark, d, 1))
    total = t.agg(F.sum("seconds").alias("all"))
    return t.crossJoin(F.broadcast(total)).select("model", F.round(F.col("seconds") / F.col("all"), 6).alias("share"))


@query("checkpoint_document", given("surface_cells", "cells", t=MONTHLY) + "select model, count(*) n_months, min(ym) first_ym, max(ym) last_ym, round(max(area), 3) area, max(area) > 0 passed from t group by 1")
def checkpoint_document(spark, d) -> DataFrame:
    """What a run keeps of each model beside its result: the window, areas and the checks, as a document under the run's fingerprint."""
    path, t = scratch.folder(spark), _monthly(spark, d)
    rows = t.groupBy("model").agg(F.count("*").alias("n_months"), F.min("ym").alias("first_ym"), F.max("ym").alias("last_ym"), F.round(F.max("area"), 3).alias("area"), (F.max("area") > 0).alias("passed"))
    runs.save_document(spark, path, {"step": 0.05}, rows)
    return runs.load_document(spark, path, {"step": 0.05}, rows.schema)


# -- NetCDF -------------------------------------------------------------------------------

FIELD = "select model, ym, lat_bin, lon_bin, sum(tos * area) / sum(area) tos from binned where tos is not null and area > 0 group by 1, 2, 3, 4"


def _written(spark, d) -> str:
    """Fields as classic files, two of each model, by halves of its time axis, and a few bad ones; gives the pattern that finds them."""
    path, field = scratch.folder(spark), _once(spark, _field(spark, d))
    middle = field.groupBy("model").agg(F.floor((F.min("ym") + F.max("ym")) / 2).alias("_mid"))
    field = field.join(F.broadcast(middle), "model").withColumn("half", F.when(F.col("ym") > F.col("_mid"), "2").otherwise("1")).drop("_mid")
    adapters.save_grid(field, path, "tos", GRID.resolution, {"units": "degC", "long_name": "temperature"}, ("model", "half")).count()
    files, root = adapters._files(path)
    for name, content in (("tos_empty_1.nc", b""), ("tos_other_1.nc", b"\x89HDF not classic"), ("tos_static_1.nc", adapters.classic_bytes({"x": 2}, {"tos": (("x",), np.ones(2), {})}))):
        with files.open_output_stream(f"{root}/{name}") as f:
            f.write(content)
    return f"{path}/*.nc"


def _once(spark, t: DataFrame) -> DataFrame:
    """``t`` from a table, so that it is computed once."""
    path = scratch.folder(spark)
    t.write.parquet(path)
    return spark.read.schema(t.schema).parquet(path)


def _scanned(spark, pattern: str) -> DataFrame:
    t = adapters.netcdf(spark, pattern, "tos", skip_bad="true", deep_check="true")
    return t.withColumn("model", F.regexp_extract("path", r"tos_(M\d+)_", 1))


@query("scan_netcdf", given("binned", f=FIELD) + "select model, ym, round(-85e0 + lat_bin * 10e0, 4) lat, round(-175e0 + lon_bin * 10e0, 4) lon, round(tos, 6) tos from f")
def scan_netcdf(spark, d) -> DataFrame:
    """Several files of a model as one table, bad files left out; coordinates come from the first file."""
    pattern = _written(spark, d)
    t = _scanned(spark, pattern)
    places = adapters.first_coordinates(spark, pattern, t, "tos")
    found = t.where("value is not null").join(F.broadcast(places.select("model", "cell", "lat", "lon")), ["model", "cell"])
    return found.select("model", "ym", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("value", 6).alias("tos"))


@query("override_concat", given("binned", f=FIELD) + "select model, cast(dense_rank() over (partition by model order by ym) - 1 as int) step, ym, count(*) n, round(sum(tos), 4) total from f group by 1, 3")
def override_concat(spark, d) -> DataFrame:
    """The files of a model stacked on one time axis by position."""
    t = adapters.on_one_axis(_scanned(spark, _written(spark, d))).where("value is not null")
    return t.groupBy("model", "step", "ym").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


KINDS = ("axes", "mesh", "list")
#: Model number k has its file on the grid of kind k % 3.
KIND = "list_extract(['axes', 'mesh', 'list'], cast(substr(model, 2) as int) % 3 + 1)"
ON_CELLS = "select s.model, ym, s.cell_id, lat, lon, tos from surface_cells s join cells c on c.cell_id = s.cell_id where tos is not null"


def _three_kinds(spark, d) -> str:
    """A file of each model: on axes of latitude and longitude, on a curvilinear mesh, or as a list of cells; gives the pattern that finds them."""
    path = scratch.folder(spark)
    kind = F.get(F.array(*map(F.lit, KINDS)), F.substring("model", 2, 9).cast("int") % 3)
    binned = _field(spark, d).withColumn("kind", kind).where("kind = 'axes'")
    adapters.save_grid(binned, path, "tos", GRID.resolution, {"units": "degC"}).count()
    places = _once(spark, views.with_corners(views.cells(spark, d)))
    field = views.surface_cells(spark, d).where("tos is not null").withColumn("kind", kind).where("kind <> 'axes'").join(places.select("cell_id", "j", "i"), "cell_id")
    field = _once(spark, field.select("model", "ym", "j", "i", F.col("tos").alias("value"), "kind"))
    # Models are few, and each file has all cells.
    models = views.model_months(spark, d).select("model").distinct().withColumn("kind", kind)
    each = places.crossJoin(F.broadcast(models))
    for k in KINDS[1:]:
        adapters.save_cells(field.where(F.col("kind") == k), each.where(F.col("kind") == k), path, "tos", {"units": "degC"}, mesh=k == "mesh").count()
    return f"{path}/*.nc"


def _of_models(t: DataFrame) -> DataFrame:
    return t.withColumn("model", F.regexp_extract("path", r"tos_(M\d+)", 1))


@query("scan_grids", given("surface_cells", "cells", "binned", f=FIELD, c=ON_CELLS)
       + f"""select model, {KIND} kind, ym, round(-85e0 + lat_bin * 10e0, 4) lat, round(-175e0 + lon_bin * 10e0, 4) lon, round(tos, 6) tos from f where {KIND} = 'axes'
 union all select model, {KIND} kind, ym, round(lat, 4) lat, round(lon, 4) lon, round(tos, 6) tos from c where {KIND} <> 'axes'""")
def scan_grids(spark, d) -> DataFrame:
    """Files of three kinds of grid as one table: a row per cell and month, with its place."""
    pattern = _three_kinds(spark, d)
    t = _of_models(adapters.netcdf(spark, pattern, "tos"))
    places = adapters.first_coordinates(spark, pattern, t, "tos").select("model", "cell", "lat", "lon")
    found = t.where("value is not null").join(places, ["model", "cell"])
    kind = F.get(F.array(*map(F.lit, KINDS)), F.substring("model", 2, 9).cast("int") % 3)
    return found.select("model", kind.alias("kind"), "ym", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("value", 6).alias("tos"))


#: Places of the mesh, and cells on it.
MESH = "select (max(j) + 1) * 50 places, count(*) n from cells"


@query("grid_cells", given("surface_cells", "cells", "binned", f=FIELD, m=MESH, e="select sum(4 * lat) lat, sum(4 * lon - 1.5e0) lon from cells",
                           months="select model, count(distinct ym) n_months from surface_cells where tos is not null group by 1", on_axes="select model, count(distinct ym) n_months from f group by 1")
       + f"""select model, {KIND} kind, 648 n_places, 648 n_cells, cast(n_months * 648 as bigint) n_rows, 0e0 lat_sum, 0e0 lon_sum from on_axes where {KIND} = 'axes'
 union all select model, {KIND} kind, case when {KIND} = 'mesh' then places else n end n_places, n n_cells, n_months * case when {KIND} = 'mesh' then places else n end n_rows, round(lat, 3) lat_sum, round(lon, 3) lon_sum
 from months, m, e where {KIND} <> 'axes'""")
def grid_cells(spark, d) -> DataFrame:
    """What each file has: places, those of them with coordinates, rows of the scan (one for each place and month, never more), and the sums of the corners."""
    pattern = _three_kinds(spark, d)
    t = _of_models(adapters.netcdf(spark, pattern, "tos"))
    files = t.groupBy("model").agg(F.first("path").alias("path"), F.count("*").alias("n_rows"))
    cells = adapters.cells_of(files, pattern.rpartition("/")[0], "tos")
    total = lambda c: F.aggregate("corners", F.lit(0.0), lambda acc, x: acc + x[c])
    kind = F.get(F.array(*map(F.lit, KINDS)), F.substring("model", 2, 9).cast("int") % 3)
    there = F.col("lat").isNotNull()
    sums = [(F.round(F.sum(F.when(there, total(c))), 3) + 0.0).alias(f"{c}_sum") for c in ("lat", "lon")]
    return cells.groupBy("model", "n_rows", kind.alias("kind")).agg(F.count("*").alias("n_places"), F.count("lat").alias("n_cells"), *sums)


def _cut_short(spark, pattern: str) -> None:
    """Beside each file of the second half of a model, one that lacks its last 9 bytes, and with them a whole step."""
    folder = pattern.rpartition("/")[0]

    def look(f, name: str) -> list[dict]:
        if "_2.nc" in name:
            files, root = adapters._files(folder)
            with files.open_output_stream(f"{root}/{name.replace('_2.nc', '_short_3.nc')}") as out:
                out.write(f.read()[:-9])
        return []

    adapters._each(spark, pattern, look, "name string").count()


@query("bad_files", given("binned", f=FIELD, m="select model, (min(ym) + max(ym)) // 2 mid from f group by 1",
                          n="select f.model, count(distinct ym) n from f join m on m.model = f.model where ym > mid group by 1")
       + "select 'tos_' || k as \"name\", why from (values ('empty_1.nc', 'empty'), ('other_1.nc', 'not a classic NetCDF file'), ('static_1.nc', 'tos has no time axis')) t(k, why) "
       "union all select 'tos_' || model || '_short_3.nc', 'truncated: ' || (n - 1) || ' of ' || n || ' steps of tos' from n")
def bad_files(spark, d) -> DataFrame:
    """Files that the deep check leaves out, and why: what is no such file, what has no time, and what has fewer steps than it says."""
    pattern = _written(spark, d)
    _cut_short(spark, pattern)
    return adapters.faults(spark, pattern, "tos").select("name", "why")


@query("grid_writer", given("binned", f=FIELD, m="select model, (min(ym) + max(ym)) // 2 mid from f group by 1")
       + "select f.model, case when ym > mid then '2' else '1' end half, cast(count(distinct ym) as int) steps, count(*) cells, 'degC' units, -90e0 south, 180e0 east from f join m on m.model = f.model group by 1, 2")
def grid_writer(spark, d) -> DataFrame:
    """What the files on the standard grid hold: steps, cells, attributes and the ends of the bounds."""
    return adapters.described(spark, _written(spark, d), "tos").select(
        F.regexp_extract("name", r"tos_(M\d+)_", 1).alias("model"), F.regexp_extract("name", r"_(\d)\.nc", 1).alias("half"), "steps", "cells", "units", "south", "east"
    )


"""Queries of regridding, climatologies, multi-model means and overturning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import bins, climate, mesh, months, overturn, regrid, spherical, triangles
from ..sources import scratch, views
from .registry import query
from .sql import given
from .surface import C05, center_sql, index_sql, rounded

GRID, FINE = regrid.Grid(10.0), regrid.Grid(5.0)
FIELDS = climate.FIELDS


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return views.cells(spark, d).withColumn("nlon", geo.normalized_longitude(F.col("lon")))


def _binned(spark: SparkSession, d: str) -> DataFrame:
    """The four fields on the target grid by model and month: each mean over the area where that field is present."""
    t = GRID.assign(views.surface_cells(spark, d).join(_cells(spark, d), "cell_id"))
    a = F.col("area")
    mean = lambda f: (F.sum(F.col(f) * a) / F.sum(F.when(F.col(f).isNotNull(), a))).alias(f)
    return t.groupBy("model", "ym", "lat_bin", "lon_bin").agg(*map(mean, FIELDS))


BINNED = "select model, ym, lat_bin, lon_bin, " + ", ".join(f"sum({f} * area) / sum(case when {f} is not null then area end) {f}" for f in FIELDS) + " from binned group by 1, 2, 3, 4"
CLIM = "select model, cast(ym % 12 + 1 as int) mon, lat_bin, lon_bin, " + ", ".join(f"avg({f}) {f}, count({f}) n_{f}" for f in FIELDS) + " from regridded group by 1, 2, 3, 4"
OK = " and ".join(f"{f} is not null" for f in FIELDS)


def _eos(source: str) -> str:
    """Density and forcing of ``source`` as the derived view computes them."""
    from .sql import VIEWS

    inner = "select *, sqrt(0.0248826675584615e0 * sos + 0.5971840214030754e0) x, 0.025e0 * tos y from " + source
    text = VIEWS["derived"]
    start = text.index(" select s.*, c.j")
    return text[:start] + inner + ")))"


# Everything on the target grid, by month: the model's own fields, density and forcing.
PRODUCTS = {"regridded": BINNED, "clim": CLIM, "joint": f"select * from clim where {OK}", "products": _eos("joint")}
MMM = PRODUCTS | {"mmm": "select mon, lat_bin, lon_bin, " + ", ".join(f"avg({c}) {c}" for c in climate.PRODUCTS) + ", count(*) model_count from products group by 1, 2, 3"}


def _climate(spark, d):
    return climate.climatology(_binned(spark, d))


def _products(spark, d):
    return climate.model_products(_climate(spark, d))


def _mmm(spark, d):
    return climate.multi_model_mean(_products(spark, d))


def _area(spark, d):
    return GRID.assign(_cells(spark, d)).groupBy("lat_bin", "lon_bin").agg(F.sum("area").alias("area"))


AREA = "select cast(floor((lat + 90e0) / 10e0) as int) lat_bin, cast(floor((nlon + 180e0) / 10e0) as int) lon_bin, sum(area) area from (select *, ((lon + 180e0) % 360e0) - 180e0 nlon from cells) where lat >= -90 and lat < 90 group by 1, 2"


CENTRES = "select cast(a.range as int) lat_bin, cast(b.range as int) lon_bin, round(-90e0 + (a.range + 0.5e0) * 10e0, 4) lat, round(-180e0 + (b.range + 0.5e0) * 10e0, 4) lon from range(18) a, range(36) b"


@query("standard_grid", given("cells", grid=CENTRES, a=AREA.replace("sum(area) area", "sum(area) area, count(*) n"))
       + "select g.*, coalesce(n, 0) n_cells, round(coalesce(area, 0e0) / 1e6, 3) area from grid g left join a using (lat_bin, lon_bin)")
def standard_grid(spark, d):
    """The target grid with what it has of the source: cells and their area, none included."""
    have = GRID.assign(_cells(spark, d)).groupBy("lat_bin", "lon_bin").agg(F.count("*").alias("n_cells"), F.round(F.sum("area") / 1e6, 3).alias("area"))
    return rounded(GRID.mesh(spark), 4, "lat", "lon").join(have, ["lat_bin", "lon_bin"], "left").fillna(0, ["n_cells", "area"])


@query("target_mesh", given("binned", grid=CENTRES, v="select lat_bin, lon_bin, count(tos) n from binned group by 1, 2")
       + "select lat_bin * 36 + lon_bin cell, lat, lon, coalesce(n, 0) n_values from grid left join v using (lat_bin, lon_bin)")
def target_mesh(spark, d):
    """The cross product of two axes, with the number of values of the field that fall into each of its cells."""
    lat = spark.range(GRID.n_lat).select(F.col("id").alias("a"))
    lon = spark.range(GRID.n_lon).select(F.col("id").alias("b"))
    mesh_ = lat.crossJoin(lon).select((F.col("a") * GRID.n_lon + F.col("b")).cast("int").alias("cell"), F.round(-90.0 + (F.col("a") + 0.5) * 10.0, 4).alias("lat"), F.round(-180.0 + (F.col("b") + 0.5) * 10.0, 4).alias("lon"))
    places = GRID.assign(_cells(spark, d)).select("cell_id", (F.col("lat_bin") * GRID.n_lon + F.col("lon_bin")).alias("cell"))
    values = views.surface_cells(spark, d).where("tos is not null").join(places, "cell_id").groupBy("cell").agg(F.count("*").alias("n_values"))
    return mesh_.join(values, "cell", "left").fillna(0, ["n_values"])


@query("bin_assign", given("cells") + "select cell_id, cast(floor((lat + 90e0) / 10e0) as int) lat_bin, cast(floor((nlon + 180e0) / 10e0) as int) lon_bin from (select *, ((lon + 180e0) % 360e0) - 180e0 nlon from cells) where lat >= -90 and lat < 90")
def bin_assign(spark, d):
    return GRID.assign(_cells(spark, d)).select("cell_id", "lat_bin", "lon_bin")


@query("regrid_binned", given("binned") + "select model, ym, lat_bin, lon_bin, round(sum(tos * area) / sum(area), 6) tos, round(sum(area) / 1e6, 3) source_area_sum from binned where tos is not null and area > 0 group by 1, 2, 3, 4")
def regrid_binned(spark, d):
    t = regrid.binned(views.surface_cells(spark, d).join(_cells(spark, d), "cell_id"), "tos", GRID)
    return t.select("model", "ym", "lat_bin", "lon_bin", F.round("tos", 6).alias("tos"), F.round(F.col("source_area_sum") / 1e6, 3).alias("source_area_sum"))


@query("source_area_total", given("derived") + "select model, ym, round(coalesce(sum(case when tos is not null and area > 0 and lat < 90 then area end), 0e0) / 1e6, 3) area from derived group by 1, 2")
def source_area_total(spark, d):
    t = views.surface_cells(spark, d).join(views.cells(spark, d), "cell_id")
    ok = F.col("tos").isNotNull() & (F.col("area") > 0) & (F.col("lat") < 90)
    return t.groupBy("model", "ym").agg(F.round(F.coalesce(F.sum(F.when(ok, F.col("area"))), F.lit(0.0)) / 1e6, 3).alias("area"))


@query("area_conservation", given("binned", a="select model, ym, sum(area) x from (select model, ym, lat_bin, lon_bin, sum(area) area from binned where tos is not null group by 1, 2, 3, 4) group by 1, 2", b="select model, ym, sum(area) y from derived where tos is not null and lat < 90 group by 1, 2")
       + "select a.model, count(*) n, round(max(abs(x - y) / y), 9) worst, max(abs(x - y) / y) <= 1e-6 passed from a join b on a.model = b.model and a.ym = b.ym group by 1")
def area_conservation(spark, d):
    cells = views.surface_cells(spark, d).join(_cells(spark, d), "cell_id")
    got = regrid.binned(cells, "tos", GRID).groupBy("model", "ym").agg(F.sum("source_area_sum").alias("x"))
    want = cells.where("tos is not null and area > 0 and lat < 90").groupBy("model", "ym").agg(F.sum("area").alias("y"))
    gap = F.max(F.abs(F.col("x") - F.col("y")) / F.col("y"))
    return got.join(want, ["model", "ym"]).groupBy("model").agg(F.count("*").alias("n"), F.round(gap, 9).alias("worst"), (gap <= 1e-6).alias("passed"))


@query("binned_area", given("cells") + f"select lat_bin, lon_bin, round(area / 1e6, 3) area from ({AREA})")
def binned_area(spark, d):
    return _area(spark, d).withColumn("area", F.round(F.col("area") / 1e6, 3))


@query("coarsen_weighted", given("derived") + "select model, ym, j // 2 j_block, i // 2 i_block, round(coalesce(sum(tos * area), 0e0) / nullif(sum(area), 0e0), 6) tos, round(sum(area) / 1e6, 3) area from derived group by 1, 2, 3, 4")
def coarsen_weighted(spark, d):
    parts = regrid.parts(views.table(spark, d, "lineitem"))
    t = regrid.coarsened_rows(views.surface_rows(spark, d), views.cells(spark, d), "tos", parts)
    return t.select("model", "ym", "j_block", "i_block", F.round("tos", 6).alias("tos"), F.round(F.col("area") / 1e6, 3).alias("area"))


@query("coarsen_area", given("cells") + "select j // 2 j_block, i // 2 i_block, round(sum(area) / 1e6, 3) area, round(avg(lat), 6) lat, round(degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))), 6) lon, count(*) n from cells group by 1, 2 having count(*) = 4")
def coarsen_area(spark, d):
    rad = F.radians("lon")
    t = regrid.blocks(views.cells(spark, d), (), 2).agg(
        F.round(F.sum("area") / 1e6, 3).alias("area"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), 6).alias("lon"), F.count("*").alias("n")
    )
    return t.where("n = 4")


@query("nearest_axis", given("cells", tgt="select -90e0 + (range + 0.5e0) * 10e0 t from range(18)")
       + "select round(t, 4) target, round(lat, 4) lat from (select t, lat, row_number() over (partition by t order by round(abs(lat - t), 9), lat) k from tgt cross join (select distinct lat from cells)) where k = 1")
def nearest_axis(spark, d):
    t = regrid.nearest_on_axis(views.cells(spark, d), "lat", -90.0, 10.0, 18)
    return t.select(F.round("target", 4).alias("target"), F.round("value", 4).alias("lat"))


def _vector(lat: str, lon: str) -> list[str]:
    return [f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"]


SQUARE = " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(_vector("t.lat", "t.lon"), _vector("s.lat", "s.nlon")))


@query("nearest_regrid", given("cells", s="select cell_id, lat, ((lon + 180e0) % 360e0) - 180e0 nlon from cells", t="select cast(a.range as int) lat_bin, cast(b.range as int) lon_bin, -90e0 + (a.range + 0.5e0) * 10e0 lat, -180e0 + (b.range + 0.5e0) * 10e0 lon from range(18) a, range(36) b",
       pairs=f"select lat_bin, lon_bin, cell_id, round(sqrt({SQUARE}), 9) chord from t cross join s")
       + "select lat_bin, lon_bin, cell_id, round(chord, 6) chord from (select *, row_number() over (partition by lat_bin, lon_bin order by chord, cell_id) k from pairs where chord < 2e0 * sin(radians(30e0) / 2e0)) where k = 1")
def nearest_regrid(spark, d):
    return regrid.nearest(_cells(spark, d), GRID, spark).withColumn("chord", F.round("chord", 6))


def _weights_sql(periodic: bool) -> str:
    wrap = "((x0 + dx) % 36 + 36) % 36" if periodic else "x0 + dx"
    return f"""select lat_bin, lon_bin, cast(s_lat as int) s_lat, cast(s_lon as int) s_lon, w from (
 select lat_bin, lon_bin, y0 + dy s_lat, {wrap} s_lon, (1e0 - abs(y - y0 - dy)) * (1e0 - abs(x - x0 - dx)) w from (
 select *, floor(y) y0, floor(x) x0 from (select cast(a.range as int) lat_bin, cast(b.range as int) lon_bin, (a.range + 0.5e0) * 5e0 / 10e0 - 0.5e0 y, (b.range + 0.5e0) * 5e0 / 10e0 - 0.5e0 x from range(36) a, range(72) b))
 cross join (select range dy from range(2)) cross join (select range dx from range(2))) where s_lat between 0 and 17 and s_lon between 0 and 35 and w > 0"""


FIELD_SQL = "select model, ym, lat_bin, lon_bin, sum(tos * area) / sum(area) tos from binned where tos is not null and area > 0 group by 1, 2, 3, 4"


def _weighted_sql(periodic: bool) -> str:
    return given("binned", field=FIELD_SQL, weights=_weights_sql(periodic)) + (
        "select model, ym, w.lat_bin, w.lon_bin, round(sum(w * tos), 6) tos from field f join weights w on w.s_lat = f.lat_bin and w.s_lon = f.lon_bin group by 1, 2, 3, 4 having sum(w) >= 1e0 - 1e-9"
    )


def _field(spark, d, by=("model", "ym")):
    """Fields on the target grid, of each month or of all."""
    return regrid.binned(views.surface_cells(spark, d).join(_cells(spark, d), "cell_id"), "tos", GRID, by).select(*by, "lat_bin", "lon_bin", "tos")


def _weighted(spark, d, periodic):
    weights = regrid.bilinear_weights(spark, GRID, FINE, periodic)
    return rounded(regrid.apply_weights(_field(spark, d), weights, "tos", ("model", "ym")), 6, "tos")


@query("sparse_weights", _weighted_sql(False))
def sparse_weights(spark, d):
    return _weighted(spark, d, False)


@query("regrid_periodic", _weighted_sql(True))
def regrid_periodic(spark, d):
    return _weighted(spark, d, True)


#: Cells of 15 degrees, which share edges with those of ten only here and there.
WIDE = regrid.Grid(15.0)
ALL_MONTHS = "select model, lat_bin, lon_bin, sum(tos * area) / sum(area) tos from binned where tos is not null and area > 0 group by 1, 2, 3"
OVERLAP = """select lat_bin, lon_bin, s_lat, s_lon, wy * wx w from (
 select cast(a.range as int) lat_bin, cast(b.range as int) s_lat, (sin(radians(least(-75e0 + a.range * 15e0, -80e0 + b.range * 10e0))) - sin(radians(greatest(-90e0 + a.range * 15e0, -90e0 + b.range * 10e0))))
  / (sin(radians(-75e0 + a.range * 15e0)) - sin(radians(-90e0 + a.range * 15e0))) wy from range(12) a, range(18) b),
 (select cast(a.range as int) lon_bin, cast(b.range as int) s_lon, (least((a.range + 1) * 15e0, (b.range + 1) * 10e0) - greatest(a.range * 15e0, b.range * 10e0)) / 15e0 wx from range(24) a, range(36) b) where wy > 1e-12 and wx > 1e-12"""


@query("regrid_conservative", given("binned", field=ALL_MONTHS, weights=OVERLAP)
       + "select model, w.lat_bin, w.lon_bin, round(sum(w * tos), 6) tos from field f join weights w on w.s_lat = f.lat_bin and w.s_lon = f.lon_bin group by 1, 2, 3 having sum(w) >= 1e0 - 1e-9")
def regrid_conservative(spark, d):
    weights = regrid.conservative_weights(spark, GRID, WIDE)
    return rounded(regrid.apply_weights(_field(spark, d, ("model",)), weights, "tos", ("model",)), 6, "tos")


@query("regrid_conservative_normed", given("binned", field=FIELD_SQL, weights=OVERLAP)
       + "select model, ym, w.lat_bin, w.lon_bin, round(sum(w * tos) / sum(w), 6) tos, round(sum(w), 6) covered from field f join weights w on w.s_lat = f.lat_bin and w.s_lon = f.lon_bin group by 1, 2, 3, 4")
def regrid_conservative_normed(spark, d):
    weights = regrid.conservative_weights(spark, GRID, WIDE)
    return rounded(regrid.apply_normed(_field(spark, d), weights, "tos", ("model", "ym")), 6, "tos", "covered")


@query("regrid_nearest_s2d", given("binned", field=FIELD_SQL)
       + """select model, ym, lat_bin, lon_bin, round(tos, 6) tos from (select cast(a.range as int) lat_bin, cast(b.range as int) lon_bin, least(17, ceil((a.range + 0.5e0) * 1.5e0) - 1) y, least(35, ceil((b.range + 0.5e0) * 1.5e0) - 1) x from range(12) a, range(24) b) t
 join (select model, ym, lat_bin f_lat, lon_bin f_lon, tos from field) f on f_lat = y and f_lon = x""")
def regrid_nearest_s2d(spark, d):
    weights = regrid.nearest_weights(spark, GRID, WIDE)
    return rounded(regrid.apply_weights(_field(spark, d), weights, "tos", ("model", "ym")), 6, "tos")


@query("regrid_nearest_d2s", given("binned", field=FIELD_SQL)
       + "select model, ym, cast(least(11, ceil((lat_bin + 0.5e0) / 1.5e0) - 1) as int) lat_bin, cast(least(23, ceil((lon_bin + 0.5e0) / 1.5e0) - 1) as int) lon_bin, round(avg(tos), 6) tos, count(*) n from field group by 1, 2, 3, 4")
def regrid_nearest_d2s(spark, d):
    weights = regrid.nearest_weights(spark, GRID, WIDE, to_target=False)
    t = regrid.apply_normed(_field(spark, d), weights, "tos", ("model", "ym"))
    return rounded(t, 6, "tos").select("model", "ym", "lat_bin", "lon_bin", "tos", F.col("covered").cast("long").alias("n"))


@query("triangulated", given("binned", field=ALL_MONTHS,
       sq="select a.model, y, x, (select tos from field f where f.model = a.model and f.lat_bin = y and f.lon_bin = x) v0, (select tos from field f where f.model = a.model and f.lat_bin = y and f.lon_bin = x + 1) v1, (select tos from field f where f.model = a.model and f.lat_bin = y + 1 and f.lon_bin = x) v2, (select tos from field f where f.model = a.model and f.lat_bin = y + 1 and f.lon_bin = x + 1) v3 from (select distinct model from field) a, (select cast(range as int) y from range(17)), (select cast(range as int) x from range(35))",
       pts="select *, (lat - (-90e0 + (y + 0.5e0) * 10e0)) / 10e0 b, (lon - (-180e0 + (x + 0.5e0) * 10e0)) / 10e0 a from sq, (select cast(range * 3 - 90 as int) lat from range(61)), (select cast(range * 3 - 180 as int) lon from range(121))",
       vals="select model, y, x, lat, lon, case when a + b <= 1e0 then v0 + a * (v1 - v0) + b * (v2 - v0) else v3 + (1e0 - a) * (v2 - v3) + (1e0 - b) * (v1 - v3) end v from pts where a between 0e0 and 1e0 and b between 0e0 and 1e0")
       + "select model, lat, lon, round(v, 6) tos from (select *, row_number() over (partition by model, lat, lon order by y, x) k from vals where v is not null) where k = 1")
def triangulated(spark, d):
    return rounded(regrid.triangulated(_field(spark, d, ("model",)), GRID, 3, "tos", ("model",)), 6, "tos")


# -- cells with corners -------------------------------------------------------------------


def _excess(*corners: tuple[str, str]) -> str:
    """SQL of the area of a polygon of (lat, lon), by triangles from its first corner, in steradians."""
    v = [_vector(lat, lon) for lat, lon in corners]
    dot = lambda a, b: "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b)) + ")"
    cross = lambda a, b: [f"(({a[1]}) * ({b[2]}) - ({a[2]}) * ({b[1]}))", f"(({a[2]}) * ({b[0]}) - ({a[0]}) * ({b[2]}))", f"(({a[0]}) * ({b[1]}) - ({a[1]}) * ({b[0]}))"]
    parts = [f"2e0 * atan2({dot(v[0], cross(b, c))}, 1e0 + {dot(v[0], b)} + {dot(b, c)} + {dot(c, v[0])})" for b, c in zip(v[1:], v[2:])]
    return " + ".join(parts)


#: Half the height of a cell, and its four corners.
H = "least(4e0, (90e0 - abs(lat)) / 2e0)"
CORNERS = [(f"(lat + {H} * {up}e0)", f"(lon + {right}e0)") for up, right in ((-1, -3), (-0.5, 3), (1, 2), (0.5, -3.5))]
OWN = f"select cell_id, {_excess(*CORNERS)} e from cells"


@query("corner_mesh", given("cells", m="select max(j) mj, max(i) mi from cells",
                            p=" union all ".join(f"select j + {dj} j, i + {di} i, {lat} lat, {lon} lon from cells, m where {ok}" for (lat, lon), dj, di, ok in zip(CORNERS, (0, 0, 1, 1), (0, 1, 1, 0), ("true", "i = mi", "i = mi and j = mj", "j = mj"))))
       + "select j, i, round(lat, 4) lat, round(lon, 4) lon from p")
def corner_mesh(spark, d):
    """The corners of the cells as a mesh of one more row and column."""
    return regrid.corner_mesh(views.with_corners(views.cells(spark, d))).select("j", "i", F.round("corner.lat", 4).alias("lat"), F.round("corner.lon", 4).alias("lon"))


def _cornered(spark, d) -> DataFrame:
    return views.with_corners(views.cells(spark, d)).select("cell_id", "corners")


@query("conservative_cells", given("cells", own=OWN) + "select cell_id, round(e * 1e6, 4) area, 1e0 covered, round(e * 1e6, 4) overlap from own")
def conservative_cells(spark, d):
    """How much of each cell the target cells that it meets have of it: all."""
    t = spherical.overlaps(_cornered(spark, d), GRID).groupBy("cell_id").agg(F.max("area").alias("area"), F.sum("overlap").alias("x"))
    return t.select("cell_id", F.round(F.col("area") * 1e6, 4).alias("area"), F.round(F.col("x") / F.col("area"), 8).alias("covered"), F.round(F.col("x") * 1e6, 4).alias("overlap"))


@query("conservative_regrid", given("surface_cells", "cells", own=OWN)
       + "select model, ym, round(sum(tos * e), 6) total, round(sum(e), 6) area from surface_cells join own using (cell_id) where tos is not null group by 1, 2")
def conservative_regrid(spark, d):
    """The integral of a field over its cells, taken from its means over target cells; weights are read back by a second call."""
    folder = scratch.folder(spark)
    spherical.stored(_cornered(spark, d), GRID, folder)
    weights, _ = spherical.stored(_cornered(spark, d), GRID, folder)
    t = spherical.applied(views.surface_cells(spark, d).select("model", "ym", "cell_id", "tos"), weights, "tos", ("model", "ym"))
    return t.groupBy("model", "ym").agg(F.round(F.sum(F.col("tos") * F.col("overlap")), 6).alias("total"), F.round(F.sum("overlap"), 6).alias("area"))


@query("target_areas", given("cells", own="select distinct cast(floor((lat + 90e0) / 10e0) as int) lat_bin from cells where lat >= -90 and lat < 90")
       + f"select lat_bin, round(({_excess(('(lat_bin * 10e0 - 90e0)', '0e0'), ('(lat_bin * 10e0 - 90e0)', '10e0'), ('(lat_bin * 10e0 - 80e0)', '10e0'), ('(lat_bin * 10e0 - 80e0)', '0e0'))}) * 1e6, 4) area from own")
def target_areas(spark, d):
    """Areas of the target cells of the rows that have cells, by formula."""
    rows = GRID.assign(_cells(spark, d)).select("lat_bin").distinct()
    return rows.select("lat_bin", F.round(spherical.target_area(GRID, F.col("lat_bin")) * 1e6, 4).alias("area"))


def _inverse(k: int) -> str:
    """SQL of where corner ``k`` stands as seen from a target centre: depth, x and y."""
    a, b, d = "radians(t.lat)", f"radians(q.lat{k})", f"radians(q.lon{k} - t.lon)"
    depth = f"(sin({a}) * sin({b}) + cos({a}) * cos({b}) * cos({d}))"
    return f"{depth} d{k}, cos({b}) * sin({d}) / {depth} x{k}, (cos({a}) * sin({b}) - sin({a}) * cos({b}) * cos({d})) / {depth} y{k}"


MESHED = {
    "mesh": "select c.*, -75e0 + 150e0 * (j + 0.3e0 * sin(radians(i * 7.2e0))) / n y, i * 7.2e0 + 3e0 * cos(radians(j * 40e0)) - 180e0 x from cells c, (select max(j) + 1 n from cells)",
    "q": "select a.j, a.i, " + ", ".join(f"{p}.y lat{k}, {p}.x lon{k}, {p}.area / 1e9 v{k}" for k, p in enumerate("abcd"))
    + " from mesh a join mesh b on b.j = a.j and b.i = (a.i + 1) % 50 join mesh c on c.j = a.j + 1 and c.i = (a.i + 1) % 50 join mesh d on d.j = a.j + 1 and d.i = a.i",
    "t": "select cast(a.range as int) lat_bin, cast(b.range as int) lon_bin, -90e0 + (a.range + 0.5e0) * 10e0 lat, -180e0 + (b.range + 0.5e0) * 10e0 lon from range(18) a, range(36) b",
    "seen": "select j, i, v0, v1, v2, v3, lat_bin, lon_bin, " + ", ".join(map(_inverse, range(4))) + " from t, q",
    "near": "select *, " + ", ".join(f"{c}1 - {c}0 e{c}, {c}3 - {c}0 f{c}, {c}0 - {c}1 + {c}2 - {c}3 g{c}, -{c}0 h{c}" for c in "xy") + " from seen where d0 > 1e-6 and d1 > 1e-6 and d2 > 1e-6 and d3 > 1e-6",
    "square": "select *, gx * fy - gy * fx k2, ex * fy - ey * fx + hx * gy - hy * gx k1, hx * ey - hy * ex k0 from near",
    "halves": "select *, -0.5e0 * (k1 + case when k1 < 0 then -1 else 1 end * sqrt(case when k1 * k1 - 4e0 * k0 * k2 >= 0 then k1 * k1 - 4e0 * k0 * k2 end)) half from square",
    "roots": "select *, unnest([half / nullif(k2, 0e0), k0 / nullif(half, 0e0)]) tt from halves",
    "solved": "select *, case when abs(ex + gx * tt) >= abs(ey + gy * tt) then (hx - fx * tt) / nullif(ex + gx * tt, 0e0) else (hy - fy * tt) / nullif(ey + gy * tt, 0e0) end ss from roots",
    "chosen": "select *, row_number() over (partition by lat_bin, lon_bin order by j, i) k from solved where tt between -1e-10 and 1.0000000001e0 and ss between -1e-10 and 1.0000000001e0",
}


@query("bilinear_mesh", given("cells", **MESHED) + "select lat_bin, lon_bin, round((1e0 - ss) * (1e0 - tt) * v0 + ss * (1e0 - tt) * v1 + ss * tt * v2 + (1e0 - ss) * tt * v3, 6) as value from chosen where k = 1")
def bilinear_mesh(spark, d):
    """A field on a curvilinear mesh with a seam, at the centres of the target grid; every centre is tried against every square in SQL."""
    cells = views.cells(spark, d)
    weights = mesh.bilinear(views.mesh(cells), GRID, n_i=50)
    field = cells.select("cell_id", (F.col("area") / 1e9).alias("value"))
    return mesh.applied(field, weights, "value", ()).select("lat_bin", "lon_bin", F.round("value", 6).alias("value"))


@query("patch_mesh", given("cells", **MESHED, ends="select max(j) + 1 n from cells")
       + "select lat_bin, lon_bin, 1e0 total, 0e0 slope, 0e0 bend from chosen, ends where k = 1 and j >= 1 and j <= n - 3")
def patch_mesh(spark, d):
    """Away from the rim patches are exact on quadratic fields: in the plane of each centre, weights add up to 1, and those of places and of their squares to 0."""
    cells = views.mesh(views.cells(spark, d))
    weights = mesh.patch(cells, GRID, n_i=50)
    inner = mesh.bilinear(cells, GRID, n_i=50).join(cells.select("cell_id", "j"), "cell_id").groupBy("lat_bin", "lon_bin").agg(F.min("j").alias("low"), F.max("j").alias("high"))
    ends = cells.agg((F.max("j") + 1).alias("n"))
    t = weights.join(cells.select("cell_id", "lat", "lon"), "cell_id").join(inner, ["lat_bin", "lon_bin"]).crossJoin(F.broadcast(ends)).where("low >= 1 and high <= n - 2")
    a, b, dl = F.radians(-85.0 + F.col("lat_bin") * 10.0), F.radians("lat"), F.radians(F.col("lon") + 175.0 - F.col("lon_bin") * 10.0)
    depth = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(dl)
    t = t.withColumns({"x": F.cos(b) * F.sin(dl) / depth, "y": (F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl)) / depth})
    most = lambda *terms: F.round(F.greatest(*(F.abs(F.sum(F.col("w") * x)) for x in terms)), 6)
    x, y = F.col("x"), F.col("y")
    return t.groupBy("lat_bin", "lon_bin").agg(F.round(F.sum("w"), 6).alias("total"), most(x, y).alias("slope"), most(x * x, x * y, y * y).alias("bend"))


VALID = """valid as (select model, ym, s.cell_id, lat, ((lon + 180e0) % 360e0) - 180e0 nlon from surface_cells s join cells c on c.cell_id = s.cell_id where tos is not null and area > 0),
t as (select cast(a.range as int) lat_bin, cast(b.range as int) lon_bin, -90e0 + (a.range + 0.5e0) * 10e0 lat, -180e0 + (b.range + 0.5e0) * 10e0 lon from range(18) a, range(36) b),
pairs as (select model, ym, lat_bin, lon_bin, cell_id, round(sqrt(""" + SQUARE + """), 9) chord from t cross join valid s)"""


@query("nearest_valid", given("surface_cells", "cells") + f", {VALID} select model, ym, count(*) n, sum(cell_id)::bigint cells, round(sum(chord), 4) chords from "
       "(select *, row_number() over (partition by model, ym, lat_bin, lon_bin order by chord, cell_id) k from pairs where chord < 2e0 * sin(radians(30e0) / 2e0)) where k = 1 group by 1, 2")
def nearest_valid(spark, d):
    """For each month the nearest cell that has a value then; summed up by month."""
    field = views.surface_cells(spark, d).join(_cells(spark, d), "cell_id").where("area > 0")
    t = regrid.nearest_valid(field, "tos", GRID)
    return t.groupBy("model", "ym").agg(F.count("*").alias("n"), F.sum("cell_id").alias("cells"), F.round(F.sum("chord"), 4).alias("chords"))


#: Places of the cells in a plane, and circles of at most seven degrees.
PLANE = {
    "pts": "select cell_id id, ((lon + 180e0) % 360e0) - 180e0 + 1.5e0 * sin(cell_id) x, lat + cos(cell_id * 1.7e0) y, area / 1e9 v from cells",
    "near": "select a.id a, b.id b, a.x ax, a.y ay, b.x bx, b.y by_ from pts a join pts b on a.id < b.id and abs(a.x - b.x) <= 14 and abs(a.y - b.y) <= 14",
    "three": "select n.*, m.b c, m.bx cx, m.by_ cy from near n join near m on m.a = n.a and m.b > n.b",
    "det": "select *, 2e0 * ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) d, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) p, (cx - ax) * (cx - ax) + (cy - ay) * (cy - ay) q from three",
    "round_": "select *, ((cy - ay) * p - (by_ - ay) * q) / d ux, ((bx - ax) * q - (cx - ax) * p) / d uy from det where abs(d) > 1e-9",
    "small": "select *, ux * ux + uy * uy r2 from round_ where ux * ux + uy * uy <= 49",
    "held": "select distinct s.a, s.b, s.c from small s join pts o on o.x between ax + ux - 7 and ax + ux + 7 and o.id not in (s.a, s.b, s.c) and (o.x - ax - ux) * (o.x - ax - ux) + (o.y - ay - uy) * (o.y - ay - uy) < r2",
    "tri": "select s.* from small s anti join held f on f.a = s.a and f.b = s.b and f.c = s.c",
}


def _plane(spark, d) -> DataFrame:
    k = F.col("cell_id")
    return _cells(spark, d).select(k.alias("id"), (F.col("nlon") + 1.5 * F.sin(k.cast("double"))).alias("x"), (F.col("lat") + F.cos(k * 1.7)).alias("y"), (F.col("area") / 1e9).alias("value"))


@query("delaunay_triangles", given("cells", **PLANE) + "select a, b, c, round(sqrt(r2), 5) radius from tri")
def delaunay_triangles(spark, d):
    """Triangles of scattered points whose circles hold no other; every triple is tried in SQL."""
    return triangles.triangulation(_plane(spark, d).drop("value"), 7.0).select("a", "b", "c", F.round("radius", 5).alias("radius"))


@query("scattered_linear", given("cells", **PLANE,
       box="select *, unnest(range(cast(ceil(least(ax, bx, cx) / 3e0) as bigint), cast(floor(greatest(ax, bx, cx) / 3e0) as bigint) + 1)) nx from tri",
       box2="select *, nx * 3e0 x, unnest(range(cast(ceil(least(ay, by_, cy) / 3e0) as bigint), cast(floor(greatest(ay, by_, cy) / 3e0) as bigint) + 1)) * 3e0 y from box",
       bary="select *, ((bx - x) * (cy - y) - (by_ - y) * (cx - x)) / (d / 2e0) wa, ((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / (d / 2e0) wb from box2",
       vals="select bary.x, bary.y, wa * p.v + wb * q.v + (1 - wa - wb) * r.v v, row_number() over (partition by bary.x, bary.y order by a, b, c) k from bary join pts p on p.id = a join pts q on q.id = b join pts r on r.id = c where wa >= -1e-12 and wb >= -1e-12 and 1 - wa - wb >= -1e-12")
       + "select round(x, 4) x, round(y, 4) y, round(v, 6) as value from vals where k = 1")
def scattered_linear(spark, d):
    """A field of scattered points at every third degree, linear in each triangle."""
    points = _plane(spark, d)
    weights = triangles.at_points(triangles.triangulation(points.drop("value"), 7.0), 3.0)
    t = triangles.interpolated(points.select("id", "value"), weights, "value", ())
    return t.select(F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("value", 6).alias("value"))


@query("cyclic_point", given("cells") + f"select lat_bin, lon_bin, round(area / 1e6, 3) area from ({AREA}) union all select lat_bin, 36, round(area / 1e6, 3) from ({AREA}) where lon_bin = 1")
def cyclic_point(spark, d):
    """The column that is repeated at the end is the second one, as the plots have it."""
    t = binned_area(spark, d)
    return t.union(t.where("lon_bin = 1").withColumn("lon_bin", F.lit(GRID.n_lon)).select(*t.columns))


@query("area_match", given("cells") + "select j // 2 j_block, i // 2 i_block, round(sum(area) / 1e6, 3) area, max(abs(lat - (lat + 0.0005e0))) <= 1e-3 and max(abs((lon + 360e0) % 360e0 - lon % 360e0)) <= 1e-3 matched from cells group by 1, 2")
def area_match(spark, d):
    """A finer area grid is summed by blocks, and both grids agree to a thousandth of a degree."""
    fine = views.cells(spark, d)
    other = fine.select("j", "i", (F.col("lat") + 0.0005).alias("lat2"), (F.col("lon") + 360.0).alias("lon2"))
    near = (F.max(F.abs(F.col("lat") - F.col("lat2"))) <= 1e-3) & (F.max(F.abs(F.col("lon2") % 360.0 - F.col("lon") % 360.0)) <= 1e-3)
    return regrid.blocks(fine.join(other, ["j", "i"]), (), 2).agg(F.round(F.sum("area") / 1e6, 3).alias("area"), near.alias("matched"))


@query("exact_align", given("surface_cells", a="select model, ym, cell_id from surface_cells where tos is not null", b="select model, ym, cell_id from surface_cells where wfo is not null")
       + "select a.model, count(*) n, count(case when b.model is null then 1 end) only_left, count(case when b.model is not null then 1 end) matched from a left join b on a.model = b.model and a.ym = b.ym and a.cell_id = b.cell_id group by 1")
def exact_align(spark, d):
    t = views.surface_cells(spark, d).select("model", "ym", "cell_id", "tos", "wfo")
    left = t.where("tos is not null").select("model", "ym", "cell_id")
    right = t.where("wfo is not null").select("model", "ym", "cell_id", F.lit(True).alias("hit"))
    out = left.join(right, ["model", "ym", "cell_id"], "left")
    return out.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNull()).alias("only_left"), F.count("hit").alias("matched"))


@query("inner_align", given("surface_cells", a="select model, ym, cell_id, tos from surface_cells where tos is not null", b="select model, ym, cell_id, wfo from surface_cells where wfo is not null")
       + "select a.model, a.ym, count(*) n, round(sum(tos * wfo) * 1e3, 6) s from a join b on a.model = b.model and a.ym = b.ym and a.cell_id = b.cell_id group by 1, 2")
def inner_align(spark, d):
    t = views.surface_cells(spark, d)
    a, b = t.where("tos is not null").select("model", "ym", "cell_id", "tos"), t.where("wfo is not null").select("model", "ym", "cell_id", "wfo")
    return a.join(b, ["model", "ym", "cell_id"]).groupBy("model", "ym").agg(F.count("*").alias("n"), F.round(F.sum(F.col("tos") * F.col("wfo")) * 1e3, 6).alias("s"))


@query("grid_equal", given("surface_cells", g="select model, count(distinct cell_id) n, sum(distinct cell_id) s from surface_cells group by 1")
       + "select a.model, b.model other, a.n - b.n n_gap, a.n = b.n and a.s = b.s equal from g a join g b on a.model < b.model")
def grid_equal(spark, d):
    """Models are few: their grids are compared by count and sum of distinct cells."""
    t = views.surface_cells(spark, d).select("model", "cell_id").distinct().groupBy("model").agg(F.count("*").alias("n"), F.sum("cell_id").alias("s"))
    u = t.withColumnsRenamed({"model": "other", "n": "n2", "s": "s2"})
    return t.join(u, F.col("model") < F.col("other")).select("model", "other", (F.col("n") - F.col("n2")).alias("n_gap"), ((F.col("n") == F.col("n2")) & (F.col("s") == F.col("s2"))).alias("equal"))


# -- climatology and multi-model mean ---------------------------------------------------


@query("climatology", given("binned", regridded=BINNED, clim=CLIM) + "select model, mon as \"month\", lat_bin, lon_bin, " + ", ".join(f"round({f} * 1e3, 5) {f}, n_{f}" for f in FIELDS) + " from clim")
def climatology(spark, d):
    return _climate(spark, d).withColumns({f: F.round(F.col(f) * 1e3, 5) for f in FIELDS})


SCALES = {"tos": 1e3, "sos": 1e3, "hfds": 1e3, "wfo": 1e6, "rho": 1e3, "heat": 1e6, "fw": 1e6, "fsurf": 1e6}


@query("mmm_fields", given("binned", **MMM) + "select mon as \"month\", lat_bin, lon_bin, model_count, " + ", ".join(f"round({c} * {k:.0f}e0, 5) {c}" for c, k in SCALES.items()) + " from mmm")
def mmm_fields(spark, d):
    return _mmm(spark, d).select("month", "lat_bin", "lon_bin", "model_count", *(F.round(F.col(c) * k, 5).alias(c) for c, k in SCALES.items()))


ATLANTIC_BINS = "-90e0 + (lat_bin + 0.5e0) * 10e0 > 45 and -180e0 + (lon_bin + 0.5e0) * 10e0 between -90 and 60"


def _mmm_profile(spark, d):
    lat, lon = -90.0 + (F.col("lat_bin") + 0.5) * 10.0, -180.0 + (F.col("lon_bin") + 0.5) * 10.0
    cells = _mmm(spark, d).where(geo.north_atlantic(lat, lon)).join(_area(spark, d), ["lat_bin", "lon_bin"]).withColumn("model", F.lit("MMM"))
    frame = spark.range(1, 13).select(F.lit("MMM").alias("model"), F.col("id").cast("int").alias("ym"))
    return bins.profile(cells, frame, C05)


@query("mmm_profile", given("binned", **MMM, areas=AREA, sums=f"select {index_sql(C05)} bin_idx, sum(fsurf * area) f, sum(heat * area) h, sum(fw * area) w, sum(area) a from mmm join areas using (lat_bin, lon_bin) where {ATLANTIC_BINS} group by 1")
       + f"select 'MMM' model, b.bin_idx, {center_sql(C05)} rho, round(coalesce(f, 0e0) / 5e4 / 12, 6) fgen, round(coalesce(h, 0e0) / 5e4 / 12, 6) heat_flux, round(coalesce(w, 0e0) / 5e4 / 12, 6) freshwater_flux, round(coalesce(a, 0e0) / 12e6, 4) area_sum from (select cast(range as int) bin_idx from range({C05.count})) b left join sums s on s.bin_idx = b.bin_idx")
def mmm_profile(spark, d):
    from .surface import shown

    return shown(_mmm_profile(spark, d))


@query("order_qc", given("binned", **MMM, early="select model, ym, lat_bin, lon_bin, sum(rho * area) / sum(case when rho is not null then area end) r from binned group by 1, 2, 3, 4",
       eclim="select model, cast(ym % 12 + 1 as int) mon, lat_bin, lon_bin, avg(r) r from early group by 1, 2, 3, 4")
       + "select p.model, count(r - rho) n, round(avg(r - rho) * 1e3, 5) mean, round(sqrt(avg((r - rho) * (r - rho))) * 1e3, 5) rmse, round(max(abs(r - rho)) * 1e3, 5) max_abs, round(min(r - rho) * 1e3, 5) low, round(max(r - rho) * 1e3, 5) high from products p join eclim e on e.model = p.model and e.mon = p.mon and e.lat_bin = p.lat_bin and e.lon_bin = p.lon_bin group by 1")
def order_qc(spark, d):
    """Mean of derived density against density of the mean fields, from one pass over the cells."""
    a = F.col("area")
    mean = lambda f, name: (F.sum(F.col(f) * a) / F.sum(F.when(F.col(f).isNotNull(), a))).alias(name)
    t = GRID.assign(views.derived(spark, d)).groupBy("model", "ym", "lat_bin", "lon_bin").agg(*(mean(f, f) for f in FIELDS), mean("rho", "r"))
    x = climate.model_products(climate.climatology(t, (*FIELDS, "r")))
    gap = F.col("r") - F.col("rho")
    show = lambda c, n: F.round(c * 1e3, 5).alias(n)
    return x.groupBy("model").agg(F.count(gap).alias("n"), show(F.avg(gap), "mean"), show(F.sqrt(F.avg(gap * gap)), "rmse"), show(F.max(F.abs(gap)), "max_abs"), show(F.min(gap), "low"), show(F.max(gap), "high"))


@query("coverage_by_month", given("binned", **MMM) + "select mon as \"month\", count(*) covered, min(model_count) low, round(avg(model_count), 6) mean, max(model_count) high, count(case when model_count = 8 then 1 end) n_full from mmm group by 1")
def coverage_by_month(spark, d):
    c = F.col("model_count")
    return _mmm(spark, d).groupBy("month").agg(F.count("*").alias("covered"), F.min(c).alias("low"), F.round(F.avg(c), 6).alias("mean"), F.max(c).alias("high"), F.count_if(c == 8).alias("n_full"))


@query("count_histogram", given("binned", **MMM) + "select model_count, count(*) n from mmm where model_count > 0 group by 1")
def count_histogram(spark, d):
    return _mmm(spark, d).where("model_count > 0").groupBy("model_count").agg(F.count("*").alias("n")).orderBy("model_count")


@query("effective_area", given("cells", areas=AREA) + f"select round(sum(area) / 1e6, 3) world, round(sum(case when {ATLANTIC_BINS} then area end) / 1e6, 3) atlantic, count(case when area > 0 then 1 end) n from areas where area > 0")
def effective_area(spark, d):
    lat, lon = -90.0 + (F.col("lat_bin") + 0.5) * 10.0, -180.0 + (F.col("lon_bin") + 0.5) * 10.0
    return _area(spark, d).where("area > 0").agg(F.round(F.sum("area") / 1e6, 3).alias("world"), F.round(F.sum(F.when(geo.north_atlantic(lat, lon), F.col("area"))) / 1e6, 3).alias("atlantic"), F.count("*").alias("n"))


@query("cache_violations", given("binned", regridded=BINNED, clim=CLIM) + "select model, count(*) n, count(case when (tos is not null) <> (n_tos > 0) then 1 end) mask_faults, count(case when n_tos < 0 or n_tos > 20 then 1 end) count_faults, count(case when mon < 1 or mon > 12 then 1 end) month_faults from clim group by 1")
def cache_violations(spark, d):
    t = _climate(spark, d)
    return t.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(F.col("tos").isNotNull() != (F.col("n_tos") > 0)).alias("mask_faults"),
        F.count_if((F.col("n_tos") < 0) | (F.col("n_tos") > 20)).alias("count_faults"), F.count_if(~F.col("month").between(1, 12)).alias("month_faults"),
    )


@query("final_violations", given("binned", **MMM) + "select count(*) n, count(case when rho is null or fsurf is null then 1 end) missing, count(case when rho <= 0 then 1 end) bad_rho, count(case when abs(fsurf - heat - fw) > 1e-18 + 1e-9 * abs(fsurf) then 1 end) open_sums from mmm")
def final_violations(spark, d):
    gap = F.abs(F.col("fsurf") - F.col("heat") - F.col("fw")) > 1e-18 + 1e-9 * F.abs("fsurf")
    return _mmm(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("rho").isNull() | F.col("fsurf").isNull()).alias("missing"), F.count_if(F.col("rho") <= 0).alias("bad_rho"), F.count_if(gap).alias("open_sums"))


@query("union_models", given("cells", areas=AREA) + "select 'M0' model, lat_bin, lon_bin, round(area / 1e6, 3) area from areas union all select 'M1', lat_bin, lon_bin, round(area * 2e0 / 1e6, 3) from areas")
def union_models(spark, d):
    a = _area(spark, d)
    each = [a.select(F.lit(m).alias("model"), "lat_bin", "lon_bin", F.round(F.col("area") * k / 1e6, 3).alias("area")) for m, k in (("M0", 1.0), ("M1", 2.0))]
    return each[0].unionByName(each[1])


# -- overturning -------------------------------------------------------------------------


@query("basin_labels", given("overturning") + "select distinct model, lower(trim(basin)) label from overturning")
def basin_labels(spark, d):
    return views.overturning(spark, d).select("model", overturn.label(F.lit(None).cast("string"), F.col("basin")).alias("label")).distinct()


@query("basin_choice", given("overturning", labels="select model, lower(trim(basin)) label, min(length(basin)) idx from overturning group by 1, 2")
       + """select model, label, cast(rank as int) rank from (select *, row_number() over (partition by model order by rank, idx) k from (
 select *, case when contains(label, 'atlantic_arctic_ocean') then 0 when contains(label, 'atlantic_ocean') then 1 when contains(label, 'atlantic') then 2 when contains(label, 'north_atlantic') then 3 when contains(label, 'a') then 4 end rank from labels) where rank is not null) where k = 1""")
def basin_choice(spark, d):
    labels = views.overturning(spark, d).groupBy("model", overturn.label(F.col("basin")).alias("label")).agg(F.min(F.length("basin")).alias("idx"))
    return overturn.chosen_basin(labels)


ATL = {"atl": "select * from overturning where lower(trim(basin)) = 'atlantic_arctic_ocean'"}


@query("year_range", given("overturning", **ATL) + "select model, ym // 12 y, count(*) n from atl where ym // 12 between 1994 and 1996 group by 1, 2")
def year_range(spark, d):
    y = F.floor(F.col("ym") / 12)
    return overturn.atlantic(views.overturning(spark, d)).where(y.between(1994, 1996)).groupBy("model", y.alias("y")).agg(F.count("*").alias("n"))


@query("amoc_climatology", given("overturning", **ATL) + "select model, lev, lat, round(avg(msftmz) / 1e9, 6) sv from atl group by 1, 2, 3")
def amoc_climatology(spark, d):
    return rounded(overturn.climatology(overturn.atlantic(views.overturning(spark, d))), 6, "sv")


STRENGTH = ATL | {"amoc": "select model, lev, lat, avg(msftmz) / 1e9 sv from atl group by 1, 2, 3", "strengths": "select model, max(sv) strength from amoc where lat between 0 and 60 and lev >= 250 group by 1"}


def _strength(spark, d):
    return overturn.strength(overturn.climatology(overturn.atlantic(views.overturning(spark, d))))


@query("amoc_strength", given("overturning", **STRENGTH) + "select model, round(strength, 6) strength from strengths")
def amoc_strength(spark, d):
    return rounded(_strength(spark, d), 6, "strength")


@query("sort_strength", given("overturning", **STRENGTH) + "select model, round(strength, 6) strength, row_number() over (order by strength desc, model) place from strengths")
def sort_strength(spark, d):
    """One row per model, so one ordering of all is small."""
    return rounded(_strength(spark, d).withColumn("place", F.row_number().over(Window.orderBy(F.desc("strength"), "model")).cast("long")), 6, "strength").orderBy("place")


YEARLY = ATL | {"tops": "select model, ym, max(msftmz) / 1026e0 / 1e6 sv from atl where lev > 250 group by 1, 2", "yearly": "select model, cast(ym // 12 as int) y, avg(sv) sv, count(*) n from tops group by 1, 2"}


def _yearly(spark, d):
    return overturn.yearly_strength(overturn.atlantic(views.overturning(spark, d)))


@query("yearly_strength", given("overturning", **YEARLY) + "select model, y as \"year\", round(sv, 6) sv, n from yearly")
def yearly_strength(spark, d):
    return rounded(_yearly(spark, d), 6, "sv")


@query("rolling5", given("overturning", **YEARLY) + "select model, y as \"year\", round(case when count(sv) over w = 5 then avg(sv) over w end, 6) rolling from yearly window w as (partition by model order by y rows between 2 preceding and 2 following)")
def rolling5(spark, d):
    return rounded(months.rolling(_yearly(spark, d), "sv", ("model",), "year"), 6, "rolling").select("model", "year", "rolling")


@query("baseline_norm", given("overturning", **YEARLY, numbered="select *, row_number() over (partition by model order by y) k from yearly") + "select model, y as \"year\", round(sv / avg(case when k <= 5 then sv end) over (partition by model), 6) normalized from numbered")
def baseline_norm(spark, d):
    return rounded(months.normalized(_yearly(spark, d), "sv", ("model",), "year"), 6, "normalized").select("model", "year", "normalized")


@query("year_slice_mean", given("overturning", **YEARLY, numbered="select *, row_number() over (partition by model order by y) k from yearly") + "select model, round(avg(sv), 6) sv, count(*) n from numbered where k between 2 and 4 group by 1")
def year_slice_mean(spark, d):
    w = Window.partitionBy("model").orderBy("year")
    t = _yearly(spark, d).withColumn("k", F.row_number().over(w)).where(F.col("k").between(2, 4))
    return t.groupBy("model").agg(F.round(F.avg("sv"), 6).alias("sv"), F.count("*").alias("n"))

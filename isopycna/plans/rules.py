"""Queries for checks, calendars, orders and special cases of single models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendars, eos, geo
from ..operators import catalog, checks
from ..sources import adapters, views
from .registry import query
from .sql import VOLUME_SQL, _number, _terms, given

COHORT, EXCLUDED = [f"M{k}" for k in range(2, 11)], ["M1"]


@query("empty_grids", given("file_catalog", "surface_cells") + "select distinct model from file_catalog where model not in (select model from surface_cells)")
def empty_grids(spark, d) -> DataFrame:
    return checks.empty_grids(views.file_catalog(spark, d), views.model_months(spark, d))


@query("mixed_units", given("file_catalog", u="select distinct variable, case when variable in ('tos', 'wfo') and version = 3 then 'other' when variable = 'tos' then 'degC' else '1' end units from file_catalog")
       + "select variable, string_agg(units, ',' order by units) units from u group by 1 having count(*) > 1")
def mixed_units(spark, d) -> DataFrame:
    odd = F.col("variable").isin("tos", "wfo") & (F.col("version") == 3)
    units = F.when(odd, "other").when(F.col("variable") == "tos", "degC").otherwise("1")
    return checks.mixed_units(views.file_catalog(spark, d).select("variable", units.alias("units"))).select("variable", F.array_join("units", ",").alias("units"))


@query("cohort_faults", given("surface_cells", have="select distinct model from surface_cells", want="select concat('M', cast(range as varchar)) model from range(2, 11)")
       + "select model, 'missing' fault from want where model not in (select model from have) union all select model, case when model = 'M1' then 'excluded' else 'unexpected' end from have where model not in (select model from want)")
def cohort_faults(spark, d) -> DataFrame:
    return checks.cohort_faults(views.model_months(spark, d), COHORT, EXCLUDED)


@query("derived_gaps", given("derived") + "select model, count(*) n from derived where tos is not null and sos is not null and hfds is not null and fsurf is null group by 1")
def derived_gaps(spark, d) -> DataFrame:
    """Forcing is missing where its freshwater part is, although the other inputs are there."""
    return checks.derived_gaps(views.derived(spark, d), ("tos", "sos", "hfds"), "fsurf").groupBy("model").agg(F.count("*").alias("n"))


@query("broken_months", given("file_catalog") + "select model, start_ym ym, count(*) n from file_catalog group by 1, 2 having count(*) > 1")
def broken_months(spark, d) -> DataFrame:
    return checks.broken_months(views.file_catalog(spark, d).withColumnRenamed("start_ym", "ym"))


@query("sort_files", given("files") + "select model, filename, seq, row_number() over (partition by model order by start_ym, end_ym desc, seq) place from files")
def sort_files(spark, d) -> DataFrame:
    """Several keys, one of them descending; places are within a model, so that no task orders all files."""
    order = Window.partitionBy("model").orderBy("start_ym", F.desc("end_ym"), "seq")
    named = views.file_catalog(spark, d).withColumn("place", F.row_number().over(order).cast("long"))
    stamp = lambda c: (F.floor(F.col(c) / 12) * 100 + F.col(c) % 12 + 1).cast("string")
    name = F.concat(F.col("variable"), F.lit("_Omon_"), F.col("model"), F.lit("_piControl_r1i1p1f1_"), F.col("grid"), F.lit("_"), stamp("start_ym"), F.lit("-"), stamp("end_ym"), F.lit(".nc"))
    return named.select("model", name.alias("filename"), "seq", "place")


@query("sort_coordinates", given("overturning") + "select model, lev, lat, round(sum(msftmz) / 1e9, 4) msftmz, row_number() over (partition by model order by lev, lat) place from overturning group by 1, 2, 3")
def sort_coordinates(spark, d) -> DataFrame:
    t = views.overturning(spark, d).groupBy("model", "lev", "lat").agg(F.round(F.sum("msftmz") / 1e9, 4).alias("msftmz"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy("lev", "lat")).cast("long"))


@query("implicit_join", given("surface_cells", "cells", a="select model, ym, cell_id, hfds from surface_cells where hfds is not null", b="select model, ym, cell_id, tos from surface_cells where tos is not null")
       + "select a.model, round(sum(hfds * tos * area) / 1e15, 6) total, count(*) n from a join b on a.model = b.model and a.ym = b.ym and a.cell_id = b.cell_id join cells c on c.cell_id = a.cell_id group by 1")
def implicit_join(spark, d) -> DataFrame:
    """The product of two fields and an area takes what all three have, by their coordinates."""
    t = views.surface_cells(spark, d)
    a, b = t.where("hfds is not null").select("model", "ym", "cell_id", "hfds"), t.where("tos is not null").select("model", "ym", "cell_id", "tos")
    joined = a.join(b, ["model", "ym", "cell_id"]).join(views.cells(spark, d).select("cell_id", "area"), "cell_id")
    return joined.groupBy("model").agg(F.round(F.sum(F.col("hfds") * F.col("tos") * F.col("area")) / 1e15, 6).alias("total"), F.count("*").alias("n"))


# -- calendars --------------------------------------------------------------------------


@query("subtract_years", "select o_orderkey, cast(cast(cast(o_orderdate as date) - interval 21 year as date) as varchar) back, cast(year(o_orderdate) * 12 + month(o_orderdate) - 1 - 252 as int) ym from orders")
def subtract_years(spark, d) -> DataFrame:
    """The same month and day so many years before; the last of February where that day does not exist."""
    t = views.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return t.select("o_orderkey", geo.same_day_before(F.col("day"), 21).cast("string").alias("back"), geo.years_before(views.month_index(F.col("day")), 21).cast("int").alias("ym"))


#: Days before each month of a year without and with a leap day.
BEFORE = [[sum(calendars.month_length(2001, m, kind) for m in range(1, k)) for k in range(1, 13)] for kind in ("noleap", "all_leap")]


def _by_length(name: str, length: int, before: list[int]) -> str:
    """SQL of dates in a calendar whose years have one length."""
    month = f"len(list_filter({before}, lambda x: x <= n % {length}))"
    return f"select o_orderkey, '{name}' calendar, cast(1990 + n // {length} as int) y, cast({month} as int) m, cast(n % {length} - list_extract({before}, {month}) + 1 as int) d from t"


@query("calendar_dates", "with t as (select o_orderkey, (o_orderkey * 37) % 40000 n from orders) "
       + "select o_orderkey, '360_day' calendar, cast(1990 + n // 360 as int) y, cast(n % 360 // 30 + 1 as int) m, cast(n % 30 + 1 as int) d from t"
       + "".join(f" union all select o_orderkey, '{c}' calendar, year(g)::int y, month(g)::int m, day(g)::int d from (select o_orderkey, date '1990-01-01' + n::int g from t)" for c in ("standard", "julian"))
       + f" union all {_by_length('noleap', 365, BEFORE[0])} union all {_by_length('all_leap', 366, BEFORE[1])}")
def calendar_dates(spark, d) -> DataFrame:
    """Dates so many days after 1 January 1990 in each calendar; up to 2099 the Julian one counts as the Gregorian does."""
    t = views.table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 37) % 40000).alias("n"))

    def of(name: str) -> Column:
        y, m, day = calendars.date(F.col("n") + calendars.day_number(1990, 1, 1, name), name)
        return F.struct(F.lit(name).alias("calendar"), y.cast("int").alias("y"), m.cast("int").alias("m"), day.cast("int").alias("d"))

    each = t.select("o_orderkey", F.explode(F.array(*map(of, ("360_day", "standard", "julian", "noleap", "all_leap")))).alias("x"))
    return each.select("o_orderkey", "x.*")


@query("synthetic_calendar", given("surface_cells", k="select model, ym, row_number() over (partition by model order by ym) - 1 n from (select distinct model, ym from surface_cells)")
       + "select model, ym, cast(n as int) step, cast(2501 + n // 12 as int) y, cast(n % 12 + 1 as int) mon, cast((n // 12) * 365 + list_extract([0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334], n % 12 + 1) as int) n_days from k")
def synthetic_calendar(spark, d) -> DataFrame:
    """The steps of each model, whose months don't count, as months from 2501 on in a calendar without leap days, with the days since the first."""
    k = F.row_number().over(Window.partitionBy("model").orderBy("ym")) - 1
    year, month = 2501 + F.floor(F.col("step") / 12), F.col("step") % 12 + 1
    since = calendars.day_number(year, month, F.lit(1), "noleap") - calendars.day_number(2501, 1, 1, "noleap")
    t = views.model_months(spark, d).withColumn("step", k.cast("int"))
    return t.select("model", "ym", "step", year.cast("int").alias("y"), month.cast("int").alias("mon"), since.cast("int").alias("n_days"))


@query("legacy_30y", given("files", p="select filename, model, end_ym // 12 y from files") + "select model, count(*) n from p where y >= y - 30 and filename like '%.nc' group by 1")
def legacy_30y(spark, d) -> DataFrame:
    """The filter of the old script holds for every file that parses, so it is that alone."""
    k = F.col("end_ym")
    stamp = lambda c: (F.floor(c / 12) * 100 + c % 12 + 1).cast("string")
    name = F.concat(F.col("variable"), F.lit("_Omon_"), F.col("model"), F.lit("_piControl_r1i1p1f1_"), F.col("grid"), F.lit("_"), stamp(F.col("start_ym")), F.lit("-"), stamp(k), F.lit(".nc"))
    parsed = catalog.parse(views.file_catalog(spark, d).withColumn("filename", name)).where("kind = 'time'")
    return parsed.groupBy("model").agg(F.count("*").alias("n"))


# -- single models and old formulas ------------------------------------------------------


@query("drop_level", given("overturning", f="select model, ym, lat, cast(lev / 250e0 as int) lev_idx, round(sum(msftmz) / 1e9, 4) msftmz from overturning group by 1, 2, 3, 4")
       + "select model, ym, lat, msftmz from f where lev_idx = 0")
def drop_level(spark, d) -> DataFrame:
    t = views.overturning(spark, d).withColumn("lev_idx", (F.col("lev") / 250.0).cast("int"))
    t = adapters.without_level(t)
    return t.groupBy("model", "ym", "lat").agg(F.round(F.sum("msftmz") / 1e9, 4).alias("msftmz"))


@query("area_fixes", given("cells", m="select max(j) mj from cells", models="select range k from range(4)")
       + """select concat('M', cast(k as varchar)) model, case when k = 3 then mj - j else j end j, i, round(case when k = 0 then area * 2e0 else area end / 1e6, 3) areacello,
 case when k = 1 then 'areacella' else 'areacello' end source from cells, m, models where not (k = 2 and j = mj)""")
def area_fixes(spark, d) -> DataFrame:
    """Areas of models that need a hand: another model's file, another name, a row that is there twice, rows that run backwards."""
    cells = views.cells(spark, d).select("j", "i", "area")
    files = cells.withColumn("models", F.explode(F.array(*(F.struct(F.lit(f"M{k}").alias("model"), F.lit(2.0 if k == 0 else 1.0).alias("factor"), F.lit("areacella" if k == 1 else "areacello").alias("name")) for k in range(4)))))
    files = files.select("models.*", "j", "i", "area")
    own = files.select("model", "j", "i", (F.col("area") * F.when(F.col("model") == "M0", F.col("factor")).otherwise(1.0)).alias("area"), F.col("name").alias("source"))
    return geo.fixed_areas(own, doubled=("M2",), reversed_=("M3",)).select("model", "j", "i", F.round(F.col("area") / 1e6, 3).alias("areacello"), "source")


def _density_sql() -> str:
    rows = [_terms([*map(_number, r)], "t") if r else "0e0" for r in eos.ENTHALPY]
    volume = [_terms([*map(_number, r)], "y") for r in eos.VOLUME]
    return f"""select model, ym, cell_id, round(1e0 / ({_terms(volume, "x")}), 6) rho, round(ct, 6) ct from (
 select *, sqrt({eos.SALINITY_SCALE!r}e0 * sa + {eos.SALINITY_SHIFT!r}e0) x, 0.025e0 * ct y from (
 select *, {_terms(rows, "s")} / {eos.HEAT_CAPACITY!r}e0 ct from (
 select *, sqrt({eos.SALINITY_SCALE!r}e0 * sa) s, 0.025e0 * tos t from (select *, sos * {eos.SALINITY_RATIO!r}e0 sa from surface_cells where tos is not null))))"""


@query("density_converted", given("surface_cells") + _density_sql())
def density_converted(spark, d) -> DataFrame:
    """Density of absolute salinity and conservative temperature, which the old method converted to first."""
    t = views.surface_cells(spark, d).where("tos is not null").withColumn("sa", eos.absolute_salinity(F.col("sos")))
    t = t.withColumn("ct", eos.conservative_temperature(F.col("sa"), F.col("tos")))
    x, y = F.sqrt(eos.SALINITY_SCALE * F.col("sa") + eos.SALINITY_SHIFT), eos.TEMPERATURE_SCALE * F.col("ct")
    volume = eos.horner([eos.horner(list(map(F.lit, r)), F.col("_y")) for r in eos.VOLUME], F.col("_x"))
    return t.withColumns({"_x": x, "_y": y}).select("model", "ym", "cell_id", F.round(1.0 / volume, 6).alias("rho"), F.round("ct", 6).alias("ct"))


def _converted_sql(columns: str) -> str:
    rows = [_terms([*map(_number, r)], "t") if r else "0e0" for r in eos.ENTHALPY]
    return f"""select {columns} from (select *, {VOLUME_SQL} from (
 select *, sqrt({eos.SALINITY_SCALE!r}e0 * sa + {eos.SALINITY_SHIFT!r}e0) x, 0.025e0 * ct y from (
 select *, {_terms(rows, "s")} / {eos.HEAT_CAPACITY!r}e0 ct from (
 select *, sqrt({eos.SALINITY_SCALE!r}e0 * sa) s, 0.025e0 * tos t from (select *, sos * {eos.SALINITY_RATIO!r}e0 sa from surface_cells where tos is not null)))))"""


@query("coefficients_converted", given("surface_cells") + _converted_sql("model, ym, cell_id, round(25e0 * vy / v, 6) alpha, round(-0.0248826675584615e0 * 0.5e0 * vx / (x * v) * 1e3, 6) beta"))
def coefficients_converted(spark, d) -> DataFrame:
    """Thermal expansion and haline contraction, in 1e-3, of absolute salinity and conservative temperature."""
    t = views.surface_cells(spark, d).where("tos is not null").withColumn("sa", eos.absolute_salinity(F.col("sos")))
    t = eos.with_density(t.withColumn("ct", eos.conservative_temperature(F.col("sa"), F.col("tos"))), "sa", "ct")
    return t.select("model", "ym", "cell_id", F.round(F.col("alpha") * 1e3, 6).alias("alpha"), F.round(F.col("beta") * 1e3, 6).alias("beta"))


@query("homogenize", given("cells") + "select cell_id, lat, lon, lat - 1e0 lat_low, lon + 1e0 lon_high from cells")
def homogenize(spark, d) -> DataFrame:
    """Coordinates and bounds under the names of one model, brought under the common ones."""
    t = views.cells(spark, d)
    edges = lambda c: F.array(F.col(c) - 1.0, F.col(c) + 1.0)
    foreign = t.select("cell_id", F.col("lat").alias("nav_lat"), F.col("lon").alias("TLONG"), edges("lat").alias("bounds_nav_lat"), edges("lon").alias("lon_vertices"))
    return adapters.homogenized(foreign).select("cell_id", "lat", "lon", F.get("lat_bounds", F.lit(0)).alias("lat_low"), F.get("lon_bounds", F.lit(1)).alias("lon_high"))

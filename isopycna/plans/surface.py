"""Scalar expressions, masks and density-class metrics of the surface fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import eos, forcing, geo
from ..operators import bins, metrics
from ..sources import views
from .registry import query
from .sql import given

C05, C50 = bins.Classes(), bins.Classes(step=0.5)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def atlantic(spark: SparkSession, d: str, exact: tuple[str, ...] = ()) -> DataFrame:
    return views.derived(spark, d, geo.north_atlantic(F.col("lat"), F.col("nlon")), exact)


def months(spark: SparkSession, d: str) -> DataFrame:
    """All months of each model, those included that the mask leaves empty."""
    return views.model_months(spark, d)


def index_sql(c: bins.Classes, rho: str = "rho") -> str:
    return f"case when {rho} > {c.lower!r}e0 and {rho} < {c.upper!r}e0 then least(cast(floor(({rho} - {c.lower!r}e0) / {c.step!r}e0) as int), {c.count - 1}) end"


def center_sql(c: bins.Classes) -> str:
    return f"round({c.lower!r}e0 + b.bin_idx * {c.step!r}e0 + {c.step / 2!r}e0, 6)"


def profile_sql(c: bins.Classes, source: str = "atlantic", index: str | None = None, prefix: str = "") -> dict[str, str]:
    """CTEs up to ``{prefix}profiles(model, bin_idx, rho, fgen, heat_flux, freshwater_flux, area_sum)``."""
    p, s = prefix, f"({c.step!r}e0 * 1e6)"
    return {
        f"{p}times": "select model, count(distinct ym) n_time from surface_cells group by model",
        f"{p}sums": f"select model, bin_idx, sum(fsurf * area) f, sum(heat * area) h, sum(fw * area) w, sum(area) a from (select *, {index or index_sql(c)} bin_idx from {source}) where bin_idx is not null group by model, bin_idx",
        f"{p}profiles": f"""select t.model, b.bin_idx, {center_sql(c)} rho, coalesce(f, 0e0) / {s} / n_time fgen, coalesce(h, 0e0) / {s} / n_time heat_flux,
 coalesce(w, 0e0) / {s} / n_time freshwater_flux, coalesce(a, 0e0) / n_time area_sum
 from {p}times t cross join (select cast(range as int) bin_idx from range({c.count})) b left join {p}sums s on s.model = t.model and s.bin_idx = b.bin_idx""",
    }


PROFILE_SELECT = "select model, bin_idx, rho, round(fgen, 6) fgen, round(heat_flux, 6) heat_flux, round(freshwater_flux, 6) freshwater_flux, round(area_sum / 1e6, 4) area_sum from profiles"


def shown(profile: DataFrame) -> DataFrame:
    return rounded(profile.withColumn("area_sum", F.col("area_sum") / 1e6), 6, "fgen", "heat_flux", "freshwater_flux").withColumn("area_sum", F.round("area_sum", 4))


# -- profiles and metrics -----------------------------------------------------------


@query("fgen_profile", given("atlantic", **profile_sql(C05)) + PROFILE_SELECT)
def fgen_profile(spark, d):
    return shown(bins.profile(atlantic(spark, d), months(spark, d), C05))


STRICT = f"case when rho <> {C05.lower!r}e0 + ({index_sql(C05)}) * 0.05e0 then {index_sql(C05)} end"


@query("fgen_strict", given("atlantic", **profile_sql(C05, index=STRICT)) + PROFILE_SELECT)
def fgen_strict(spark, d):
    return shown(bins.profile(atlantic(spark, d), months(spark, d), C05, bins.strict_index(C05)))


@query(
    "fgen_monthly",
    given("atlantic", times="select distinct model, ym from surface_cells",
          sums=f"select model, ym, bin_idx, sum(fsurf * area) f, sum(heat * area) h, sum(fw * area) w, sum(area) a from (select *, {index_sql(C50)} bin_idx from atlantic) where bin_idx is not null group by 1, 2, 3")
    + f"""select t.model, t.ym, b.bin_idx, {center_sql(C50)} rho, round(coalesce(f, 0e0) / 5e5, 6) fgen, round(coalesce(h, 0e0) / 5e5, 6) heat_flux, round(coalesce(w, 0e0) / 5e5, 6) freshwater_flux,
 round(coalesce(a, 0e0) / 1e6, 4) area_sum from times t cross join (select cast(range as int) bin_idx from range({C50.count})) b left join sums s on s.model = t.model and s.ym = t.ym and s.bin_idx = b.bin_idx""",
)
def fgen_monthly(spark, d):
    return shown(bins.monthly(atlantic(spark, d), months(spark, d), C50))


@query(
    "fgen_right_open",
    given("atlantic", low="select a.model, min(rho) low, max(rho) high from atlantic a join (select model, min(ym) ym from atlantic group by model) f on a.model = f.model and a.ym = f.ym group by a.model")
    + """select a.model, ym, cast(floor((rho - low) / 0.05e0) as int) bin_idx, round(coalesce(sum(fsurf * area), 0e0) / 5e4, 6) fgen, round(coalesce(sum(heat * area), 0e0) / 5e4, 6) heat_flux,
 round(coalesce(sum(fw * area), 0e0) / 5e4, 6) freshwater_flux, round(sum(area) / 1e6, 4) area_sum from atlantic a join low l on a.model = l.model where rho >= low and rho < high group by 1, 2, 3""",
)
def fgen_right_open(spark, d):
    return shown(bins.right_open(atlantic(spark, d), 0.05))


@query(
    "fgen_signed",
    given("derived", recursive=False, times="select model, count(distinct ym) n_time from surface_cells group by model",
          sums=f"select model, bin_idx, sum(-heat * area) h, sum(-fw * area) w from (select *, {index_sql(C05)} bin_idx from derived where lat > 30) where bin_idx is not null group by 1, 2")
    + f"""select t.model, b.bin_idx, {center_sql(C05)} rho, round(coalesce(h, 0e0) / 50e0 / n_time, 4) heat_flux, round(coalesce(w, 0e0) / 50e0 / n_time, 4) freshwater_flux
 from times t cross join (select cast(range as int) bin_idx from range({C05.count})) b left join sums s on s.model = t.model and s.bin_idx = b.bin_idx""",
)
def fgen_signed(spark, d):
    signed = forcing.with_forcing(views.derived(spark, d, F.col("lat") > 30), forcing.SIGNED)
    out = bins.profile(signed, months(spark, d), C05)
    return out.select("model", "bin_idx", "rho", *(F.round(F.col(c) * (C05.step * 1e6) / (C05.step * 1e3), 4).alias(c) for c in ("heat_flux", "freshwater_flux")))


@query("areasum", given("atlantic") + "select model, ym, round(coalesce(sum(case when fsurf < 0 and rho > 1025 then area end), 0e0) / 1e6, 3) area_sum from atlantic group by 1, 2")
def areasum(spark, d):
    out = metrics.area_where(atlantic(spark, d, views.FLUXES), (F.col("fsurf") < 0) & (F.col("rho") > 1025.0))
    return out.withColumn("area_sum", F.round(F.col("area_sum") / 1e6, 3))


@query("areasum_nosign", given("atlantic") + "select model, ym, round(coalesce(sum(case when fsurf is not null and rho > 1025 then area end), 0e0) / 1e6, 3) area_sum from atlantic group by 1, 2")
def areasum_nosign(spark, d):
    out = metrics.area_where(atlantic(spark, d), F.col("fsurf").isNotNull() & (F.col("rho") > 1025.0))
    return out.withColumn("area_sum", F.round(F.col("area_sum") / 1e6, 3))


@query(
    "avg_heatflux",
    given("derived")
    + """select model, ym, round(sum(case when ok then hfds * area end) / nullif(sum(case when ok then area end), 0e0), 6) average_heat_flux, round(coalesce(sum(case when ok then area end), 0e0) / 1e6, 3) area_sum,
 round(coalesce(sum(case when ok then hfds * area end), 0e0) / 1e6, 3) weighted_sum, count(case when ok then 1 end) n_points
 from (select *, hfds is not null and fsurf is not null and rho is not null and area > 0 ok from derived where lat between 50 and 70 and nlon between -90 and 60) group by 1, 2""",
)
def avg_heatflux(spark, d):
    cells = views.derived(spark, d, geo.region(F.col("lat"), F.col("nlon")))
    ok = F.col("hfds").isNotNull() & F.col("fsurf").isNotNull() & F.col("rho").isNotNull() & (F.col("area") > 0)
    out = metrics.weighted_mean(cells, "hfds", ok)
    return out.select("model", "ym", F.round("mean", 6).alias("average_heat_flux"), F.round(F.col("area_sum") / 1e6, 3).alias("area_sum"), F.round(F.col("weighted_sum") / 1e6, 3).alias("weighted_sum"), "n_points")


# -- masks and expressions ------------------------------------------------------------


@query("normalize_lon", given("cells") + "select cell_id, round(((lon + 180e0) % 360e0) - 180e0, 6) nlon from cells")
def normalize_lon(spark, d):
    return views.cells(spark, d).select("cell_id", F.round(geo.normalized_longitude(F.col("lon")), 6).alias("nlon"))


def _placed(spark, d):
    return views.cells(spark, d).withColumn("nlon", geo.normalized_longitude(F.col("lon")))


@query("na_mask", given("cells") + "select cell_id, round(lat, 4) lat from (select *, ((lon + 180e0) % 360e0) - 180e0 nlon from cells) where lat > 45 and nlon between -90 and 60")
def na_mask(spark, d):
    return _placed(spark, d).where(geo.north_atlantic(F.col("lat"), F.col("nlon"))).select("cell_id", F.round("lat", 4).alias("lat"))


@query("region_mask", given("cells") + "select cell_id, round(lat, 4) lat from (select *, ((lon + 180e0) % 360e0) - 180e0 nlon from cells) where lat between 50 and 70 and nlon between -90 and 60")
def region_mask(spark, d):
    return _placed(spark, d).where(geo.region(F.col("lat"), F.col("nlon"))).select("cell_id", F.round("lat", 4).alias("lat"))


@query("lat_mask", given("cells") + "select cell_id, lat > 45 north45, lat > 30 north30 from cells where lat > 30")
def lat_mask(spark, d):
    return views.cells(spark, d).where("lat > 30").select("cell_id", (F.col("lat") > 45).alias("north45"), (F.col("lat") > 30).alias("north30"))


@query("region_isin", given("cells") + "select cell_id, cast(cell_id % 12 as int) region from cells where cell_id % 12 in (6, 8, 9, 10) and lat > 45")
def region_isin(spark, d):
    code = (F.col("cell_id") % 12).cast("int")
    return views.cells(spark, d).where(code.isin(6, 8, 9, 10) & (F.col("lat") > 45)).select("cell_id", code.alias("region"))


@query("outlier_mask", given("surface_cells") + "select model, ym, cell_id, round(case when hfds < 100 then hfds end, 6) hfds from surface_cells")
def outlier_mask(spark, d):
    return views.surface_cells(spark, d).select("model", "ym", "cell_id", F.round(F.when(F.col("hfds") < 100.0, F.col("hfds")), 6).alias("hfds"))


@query("joint_valid", given("derived") + "select model, count(*) n, count(case when rho is not null and fsurf is not null and area > 0 and fsurf < 0 and rho > 1020 then 1 end) n_valid from derived group by model")
def joint_valid(spark, d):
    ok = F.col("rho").isNotNull() & F.col("fsurf").isNotNull() & (F.col("area") > 0) & (F.col("fsurf") < 0) & (F.col("rho") > 1020.0)
    return views.derived(spark, d, exact=views.FLUXES).groupBy("model").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


@query("surface_density", given("derived") + "select model, ym, cell_id, round(rho, 8) rho, round(alpha * 1e4, 8) alpha4, round(beta * 1e4, 8) beta4 from derived")
def surface_density(spark, d):
    t = eos.with_density(views.surface_cells(spark, d).join(views.cells(spark, d).select("cell_id"), "cell_id"))
    return t.select("model", "ym", "cell_id", F.round("rho", 8).alias("rho"), F.round(F.col("alpha") * 1e4, 8).alias("alpha4"), F.round(F.col("beta") * 1e4, 8).alias("beta4"))


FORCING = "select model, ym, cell_id, round({0} * 1e6, 6) heat, round({1} * 1e6, 6) fw, round(({0} + {1}) * 1e6, 6) fsurf from derived"


def _forced(df):
    return df.select("model", "ym", "cell_id", *(F.round(F.col(c) * 1e6, 6).alias(c) for c in ("heat", "fw", "fsurf")))


@query("surface_forcing", given("derived") + FORCING.format("heat", "fw"))
def surface_forcing(spark, d):
    return _forced(views.derived(spark, d))


@query("forcing_cloud", given("derived") + FORCING.format("(alpha / 4090e0 * hfds)", "(1026e0 / 1000e0 * beta * 35e0 * wfo)"))
def forcing_cloud(spark, d):
    return _forced(forcing.with_forcing(views.derived(spark, d), forcing.CLOUD))


@query("forcing_const", given("derived") + FORCING.format("(1.391022569339093e-4 / 3990e0 * hfds)", "(1027e0 / 1000e0 * 7.600059551595953e-4 * 35e0 * wfo)"))
def forcing_const(spark, d):
    return _forced(forcing.with_forcing(views.derived(spark, d), alpha=F.lit(forcing.CONSTANT_ALPHA), beta=F.lit(forcing.CONSTANT_BETA)))


@query("forcing_signed", given("derived") + FORCING.format("(-heat)", "(-fw)"))
def forcing_signed(spark, d):
    return _forced(forcing.with_forcing(views.derived(spark, d), forcing.SIGNED))


@query("freshwater_sum", given("surface_cells") + "select model, ym, cell_id, round((wfo + hfds * 1e-6 + sos * 1e-5 + tos * 1e-5 + wfo * 2e0) * 1e6, 4) freshwater from surface_cells")
def freshwater_sum(spark, d):
    parts = [F.col("wfo"), F.col("hfds") * 1e-6, F.col("sos") * 1e-5, F.col("tos") * 1e-5, F.col("wfo") * 2.0]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return views.surface_cells(spark, d).select("model", "ym", "cell_id", F.round(total * 1e6, 4).alias("freshwater"))


@query("unit_convert", given("overturning") + "select model, ym, basin, lev, lat, round(msftmz / 1e9, 6) sv_evaluation, round(msftmz / 1026e0 / 1e6, 6) sv_scenario, round(lev * 1e3 / 1e4, 4) scaled from overturning")
def unit_convert(spark, d):
    m = F.col("msftmz")
    return views.overturning(spark, d).select("model", "ym", "basin", "lev", "lat", F.round(m / 1e9, 6).alias("sv_evaluation"), F.round(m / 1026.0 / 1e6, 6).alias("sv_scenario"), F.round(F.col("lev") * 1e3 / 1e4, 4).alias("scaled"))


@query("weighted_fields", given("derived") + "select model, ym, cell_id, round(fsurf * area, 4) wf, round(heat * area, 4) wh, round(fw * area, 4) ww from derived")
def weighted_fields(spark, d):
    return views.derived(spark, d).select("model", "ym", "cell_id", *(F.round(F.col(a) * F.col("area"), 4).alias(b) for a, b in (("fsurf", "wf"), ("heat", "wh"), ("fw", "ww"))))


@query("ym_codec", given("surface_cells") + """select distinct model, ym, printf('%04d-%02d', ym // 12, ym % 12 + 1) month_text, cast((ym // 12) * 100 + ym % 12 + 1 as int) yyyymm,
 cast((((ym // 12) * 100 + ym % 12 + 1) // 100) * 12 + ((ym // 12) * 100 + ym % 12 + 1) % 100 - 1 as int) again from surface_cells""")
def ym_codec(spark, d):
    text, number = geo.month_text(F.col("ym")), geo.yyyymm(F.col("ym"))
    return months(spark, d).select("model", "ym", text.alias("month_text"), number.alias("yyyymm"), (F.floor(number / 100) * 12 + number % 100 - 1).cast("int").alias("again"))


@query("neg_clip", given("derived") + "select model, ym, cell_id, round(case when fsurf is not null then greatest(-fsurf, 0e0) end * 1e6, 6) clipped from derived")
def neg_clip(spark, d):
    from ..operators.profiles import negative_part

    return views.derived(spark, d).select("model", "ym", "cell_id", F.round(negative_part(F.col("fsurf")) * 1e6, 6).alias("clipped"))


@query("unit_vectors", given("cells") + "select cell_id, round(cos(radians(lat)) * cos(radians(lon)), 9) x, round(cos(radians(lat)) * sin(radians(lon)), 9) y, round(sin(radians(lat)), 9) z from cells")
def unit_vectors(spark, d):
    v = geo.unit_vector(F.col("lat"), F.col("lon"))
    return views.cells(spark, d).select("cell_id", *(F.round(c, 9).alias(n) for c, n in zip(v, "xyz")))


@query("fill_to_null", given("overturning") + "select model, ym, basin, lev, lat, round(case when msftmz > 1e10 then null else msftmz end / 1e6, 4) msftmz from overturning where ym > 23940 and lev < 3000")
def fill_to_null(spark, d):
    m = F.col("msftmz")
    return views.overturning(spark, d).where((F.col("ym") > 23940) & (F.col("lev") < 3000)).select("model", "ym", "basin", "lev", "lat", F.round(F.when(~(m > 1e10), m) / 1e6, 4).alias("msftmz"))


@query("grid_class", given("cells", shape="select cell_id % 3 family, count(distinct lat) n_lat, count(distinct lon) n_lon, count(*) n from cells group by 1")
       + "select cast(family as int) family, n, case when n_lat * n_lon = n then 'rectilinear' when n_lat = n and n_lon = n then 'unstructured' else 'curvilinear' end grid_type from shape")
def grid_class(spark, d):
    shape = views.cells(spark, d).groupBy((F.col("cell_id") % 3).cast("int").alias("family")).agg(F.countDistinct("lat").alias("a"), F.countDistinct("lon").alias("b"), F.count("*").alias("n"))
    kind = F.when(F.col("a") * F.col("b") == F.col("n"), "rectilinear").when((F.col("a") == F.col("n")) & (F.col("b") == F.col("n")), "unstructured").otherwise("curvilinear")
    return shape.select("family", "n", kind.alias("grid_type"))


@query("latlon_to_ji", given("cells", places="select cell_id, floor(lat / 5e0) * 5e0 a, floor(lon / 5e0) * 5e0 b from cells")
       + "select cell_id, cast(dense_rank() over (order by a) - 1 as int) j, cast(dense_rank() over (order by b) - 1 as int) i from places")
def latlon_to_ji(spark, d):
    """Axis positions are ranked on the two short axes, not over all cells."""
    from pyspark.sql import Window

    p = views.cells(spark, d).select("cell_id", (F.floor(F.col("lat") / 5.0) * 5.0).alias("a"), (F.floor(F.col("lon") / 5.0) * 5.0).alias("b"))
    axis = lambda c, n: p.select(c).distinct().select(c, (F.row_number().over(Window.orderBy(c)) - 1).cast("int").alias(n))
    return p.join(axis("a", "j"), "a").join(axis("b", "i"), "b").select("cell_id", "j", "i")


@query("coord_correction", given("cells", moved="select *, lat + case when j = 0 or j = mj then 0.3e0 else 0.0004e0 end lat2, (lon + 360e0) lon2 from cells, (select max(j) mj from cells)")
       + """select cell_id, abs(lat2 - lat) <= case when j = 0 or j = mj then 0.5e0 else 1e-3 end and abs(lon2 % 360e0 - lon % 360e0) <= 1e-3 ok,
 round(case when abs(lat2 - lat) <= case when j = 0 or j = mj then 0.5e0 else 1e-3 end then lat else lat2 end, 4) lat from moved""")
def coord_correction(spark, d):
    """Coordinates that differ from the area grid's by a tolerance, more at the poles, are replaced by them."""
    cells = views.cells(spark, d)
    ends = cells.agg(F.max("j").alias("mj"))
    pole = (F.col("j") == 0) | (F.col("j") == F.col("mj"))
    moved = cells.crossJoin(F.broadcast(ends)).withColumn("lat2", F.col("lat") + F.when(pole, 0.3).otherwise(0.0004)).withColumn("lon2", F.col("lon") + 360.0)
    near = F.abs(F.col("lat2") - F.col("lat")) <= F.when(pole, 0.5).otherwise(1e-3)
    same = F.abs(F.col("lon2") % 360.0 - F.col("lon") % 360.0) <= 1e-3
    return moved.select("cell_id", (near & same).alias("ok"), F.round(F.when(near, F.col("lat")).otherwise(F.col("lat2")), 4).alias("lat"))


# -- summaries ------------------------------------------------------------------------


@query("field_summary", given("derived") + "select model, round(avg(case when fsurf is not null then 1e0 else 0e0 end), 9) finite_fraction, round(min(fsurf) * 1e6, 6) low, round(max(fsurf) * 1e6, 6) high, round(avg(fsurf) * 1e6, 6) mean from derived group by model")
def field_summary(spark, d):
    out = metrics.field_summary(views.derived(spark, d), "fsurf")
    return out.select("model", F.round("finite_fraction", 9).alias("finite_fraction"), *(F.round(F.col(c) * 1e6, 6).alias(c) for c in ("low", "high", "mean")))


@query("global_mean", given("derived") + "select model, round(avg(alpha) * 1e4, 8) alpha4, round(avg(beta) * 1e4, 8) beta4 from derived group by model")
def global_mean(spark, d):
    return views.derived(spark, d).groupBy("model").agg(F.round(F.avg("alpha") * 1e4, 8).alias("alpha4"), F.round(F.avg("beta") * 1e4, 8).alias("beta4"))


@query("domain_bounds", given("atlantic", cellmean="select model, cell_id, avg(rho) r from atlantic group by 1, 2", firsts="select a.model, min(rho) low0, max(rho) high0 from atlantic a join (select model, min(ym) ym from atlantic group by 1) f on a.model = f.model and a.ym = f.ym group by 1")
       + "select c.model, round(min(r), 6) low, round(max(r), 6) high, round(any_value(low0), 6) low0, round(any_value(high0), 6) high0 from cellmean c join firsts f on c.model = f.model group by 1")
def domain_bounds(spark, d):
    cells = atlantic(spark, d)
    mean = cells.groupBy("model", "cell_id").agg(F.avg("rho").alias("r")).groupBy("model").agg(F.round(F.min("r"), 6).alias("low"), F.round(F.max("r"), 6).alias("high"))
    first = cells.groupBy("model").agg(F.min("ym").alias("ym"))
    at = cells.join(first, ["model", "ym"]).groupBy("model").agg(F.round(F.min("rho"), 6).alias("low0"), F.round(F.max("rho"), 6).alias("high0"))
    return mean.join(at, "model")


@query("yearly_mean", given("derived") + "select model, cast(ym // 12 as int) as \"year\", round(avg(rho), 6) rho, count(rho) n from derived group by 1, 2")
def yearly_mean(spark, d):
    return views.derived(spark, d).groupBy("model", F.floor(F.col("ym") / 12).cast("int").alias("year")).agg(F.round(F.avg("rho"), 6).alias("rho"), F.count("rho").alias("n"))


@query("series_summary", given("atlantic", series="select model, ym, coalesce(sum(case when fsurf < 0 and rho > 1025 then area end), 0e0) / 1e9 a from atlantic group by 1, 2")
       + "select model, count(a) n, round(avg(a), 6) mean, round(min(a), 6) low, round(max(a), 6) high, round(stddev_samp(a), 6) std from series group by 1")
def series_summary(spark, d):
    s = metrics.area_where(atlantic(spark, d, views.FLUXES), (F.col("fsurf") < 0) & (F.col("rho") > 1025.0)).withColumn("a", F.col("area_sum") / 1e9)
    return rounded(metrics.series_summary(s, "a"), 6, "mean", "low", "high", "std")


@query("forcing_closure", given("derived") + "select model, count(*) n, count(case when abs(fsurf - heat - fw) > 1e-18 + 1e-12 * abs(fsurf) then 1 end) violations from derived group by 1")
def forcing_closure(spark, d):
    gap = F.abs(F.col("fsurf") - F.col("heat") - F.col("fw"))
    return views.derived(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count_if(gap > 1e-18 + 1e-12 * F.abs("fsurf")).alias("violations"))


@query("area_join", given("surface_cells", "cells") + "select model, ym, count(*) n, round(sum(area) / 1e9, 3) area from surface_cells s join cells c using (cell_id) group by 1, 2")
def area_join(spark, d):
    return views.surface_cells(spark, d).join(views.cells(spark, d), "cell_id").groupBy("model", "ym").agg(F.count("*").alias("n"), F.round(F.sum("area") / 1e9, 3).alias("area"))


@query("mask_semi", given("surface_cells", "cells") + "select model, ym, cell_id, round(tos, 6) tos from surface_cells where cell_id in (select cell_id from cells where lat > 45)")
def mask_semi(spark, d):
    keep = views.cells(spark, d).where("lat > 45")
    return views.surface_cells(spark, d).join(keep, "cell_id", "left_semi").select("model", "ym", "cell_id", F.round("tos", 6).alias("tos"))


@query("fill_zero", given("surface_cells") + "select model, ym, cell_id, round(coalesce(tos, 0e0), 6) tos, round(coalesce(wfo, 0e0) * 1e6, 6) wfo from surface_cells")
def fill_zero(spark, d):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return views.surface_cells(spark, d).select("model", "ym", "cell_id", F.round(z("tos"), 6).alias("tos"), F.round(z("wfo") * 1e6, 6).alias("wfo"))

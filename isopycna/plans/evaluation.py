"""Queries that compare profiles and metrics across models and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bins, metrics, profiles
from ..sources import views
from . import ocean
from .registry import query
from .sql import given
from .surface import C50, atlantic, index_sql, months, profile_sql, rounded

#: Three ways to get a profile: all cells, the cells of even rows, and all cells with coarser weights.
METHODS = {"native": "true", "rows": "j % 2 = 0", "thirds": "cell_id % 3 <> 0"}


def _profile(spark: SparkSession, d: str, method: str = "native") -> DataFrame:
    cells = atlantic(spark, d).where(METHODS[method])
    return bins.profile(cells, months(spark, d), C50)


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of all methods from one pass over the cells."""
    named = F.array_compact(F.array(*(F.when(F.expr(where), F.lit(m)) for m, where in METHODS.items())))
    cells = atlantic(spark, d).withColumn("method", F.explode(named))
    n_time = months(spark, d).groupBy("model").agg(F.count("*").alias("n_time"))
    by = ["model", "method"]
    sums = bins.class_sums(cells, by, C50.index(F.col("rho")), C50.step * 1e6)
    frame = n_time.select("model", F.explode(F.array(*map(F.lit, METHODS))).alias("method"))
    out = bins.filled(sums, frame, by, C50).join(n_time, "model")
    return out.select(*by, "bin_idx", "rho", *((F.col(c) / F.col("n_time")).alias(c) for c in (*bins.SUMS, "area_sum")))


def _others(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).where("method <> 'native'")


def _all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m, where in METHODS.items():
        out[f"{m}_cells"] = f"select * from atlantic where {where}"
        out |= profile_sql(C50, source=f"{m}_cells", prefix=f"{m}_")
    out["reference"] = "select * from native_profiles"
    out["others"] = "select *, 'rows' method from rows_profiles union all select *, 'thirds' method from thirds_profiles"
    return out


ALL = _all_sql()
ONE = profile_sql(C50)
STEPS = "(rho - lag(rho) over w) * (greatest(-fgen, 0e0) + lag(greatest(-fgen, 0e0)) over w) / 2e0"
SUMMARY = """select model, min(fgen) fgen_min, sum(area_sum) area_total, coalesce(sum(s), 0e0) negative_integral from (select *, {steps} s from {source} window w as (partition by model order by rho)) group by model"""
PCT = "case when {b} <> 0 then 100e0 * ({a} - {b}) / abs({b}) end"
COMPARE = ALL | {
    "gaps": "select o.model, o.method, sqrt(avg((o.fgen - r.fgen) * (o.fgen - r.fgen))) rmse, max(abs(o.fgen - r.fgen)) max_abs from others o join reference r on o.model = r.model and o.bin_idx = r.bin_idx group by 1, 2",
    "old": SUMMARY.format(steps=STEPS, source="reference"),
    "new": "select model, method, min(fgen) fgen_min, sum(area_sum) area_total, coalesce(sum(s), 0e0) negative_integral from (select *, " + STEPS + " s from others window w as (partition by model, method order by rho)) group by 1, 2",
    "compared": "select g.model, g.method, rmse, max_abs, " + ", ".join(PCT.format(a=f"n.{c}", b=f"o.{c}") + f" {c}_pct" for c in ("fgen_min", "negative_integral", "area_total"))
    + " from gaps g join new n on n.model = g.model and n.method = g.method join old o on o.model = g.model",
}
NUMBERS = ("rmse", "max_abs", "fgen_min_pct", "negative_integral_pct", "area_total_pct")


def _compared(spark, d):
    return profiles.compare(_profiles(spark, d), "native")


@query("profile_min", given("atlantic", **ONE) + "select model, round(min(fgen), 6) fgen_min, round(min(heat_flux), 6) heat_min, round(min(freshwater_flux), 6) freshwater_min from profiles group by 1")
def profile_min(spark, d):
    names = {"fgen": "fgen_min", "heat_flux": "heat_min", "freshwater_flux": "freshwater_min"}
    return _profile(spark, d).groupBy("model").agg(*(F.round(F.min(a), 6).alias(b) for a, b in names.items()))


@query("neg_integral", given("atlantic", **ONE, summed=SUMMARY.format(steps=STEPS, source="profiles")) + "select model, round(negative_integral, 6) negative_integral from summed")
def neg_integral(spark, d):
    return rounded(profiles.trapezoid(_profile(spark, d), "rho", profiles.negative_part(F.col("fgen")), ("model",), "negative_integral"), 6, "negative_integral")


@query("trapz", given("atlantic", **ONE) + "select model, round(coalesce(sum(s), 0e0), 6) heat_integral from (select model, (rho - lag(rho) over w) * (heat_flux + lag(heat_flux) over w) / 2e0 s from profiles window w as (partition by model order by rho)) group by 1")
def trapz(spark, d):
    return rounded(profiles.trapezoid(_profile(spark, d), "rho", F.col("heat_flux"), ("model",), "heat_integral"), 6, "heat_integral")


@query("argmin_rho", given("atlantic", **ONE) + "select model, rho rho_at_min, round(fgen, 6) fgen_min from (select *, row_number() over (partition by model order by fgen, rho) k from profiles) where k = 1")
def argmin_rho(spark, d):
    return rounded(profiles.at_minimum(_profile(spark, d), ("model",)), 6, "fgen_min")


@query("profile_join", given("atlantic", **ALL) + "select r.model, r.bin_idx, round(r.fgen, 6) native, round(o.fgen, 6) other from reference r left join rows_profiles o on o.model = r.model and o.bin_idx = r.bin_idx where o.fgen is not null and r.fgen is not null")
def profile_join(spark, d):
    """On the number of the class; densities themselves are doubles."""
    a = _profile(spark, d).select("model", "bin_idx", F.round("fgen", 6).alias("native"))
    b = _profile(spark, d, "rows").select("model", "bin_idx", F.round("fgen", 6).alias("other"))
    return a.join(b, ["model", "bin_idx"], "left").dropna()


@query("rho_grid_equal", given("atlantic", **ALL) + "select r.model, count(*) n, count(case when r.rho = o.rho then 1 end) n_equal from reference r full join rows_profiles o on o.model = r.model and o.bin_idx = r.bin_idx group by 1")
def rho_grid_equal(spark, d):
    a = _profile(spark, d).select("model", "bin_idx", "rho")
    b = _profile(spark, d, "rows").select("model", "bin_idx", F.col("rho").alias("rho2"))
    return a.join(b, ["model", "bin_idx"], "full").groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("rho") == F.col("rho2")).alias("n_equal"))


@query("method_compare", given("atlantic", **COMPARE) + "select model, method, " + ", ".join(f"round({c}, 6) {c}" for c in NUMBERS) + " from compared")
def method_compare(spark, d):
    return rounded(_compared(spark, d), 6, *NUMBERS)


@query("method_means", given("atlantic", **COMPARE) + "select method, " + ", ".join(f"round(avg({c}), 6) {c}" for c in NUMBERS) + " from compared group by 1")
def method_means(spark, d):
    return _compared(spark, d).groupBy("method").agg(*(F.round(F.avg(c), 6).alias(c) for c in NUMBERS))


@query("topk_per_method", given("atlantic", **COMPARE) + "select method, model, round(rmse, 6) rmse from (select *, row_number() over (partition by method order by rmse desc, model) k from compared) where k <= 5")
def topk_per_method(spark, d):
    w = Window.partitionBy("method").orderBy(F.desc("rmse"), "model")
    return rounded(_compared(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 5").select("method", "model", "rmse"), 6, "rmse").orderBy("method", F.desc("rmse"))


@query("pct_diff", given("atlantic", **COMPARE) + "select n.model, n.method, round(" + PCT.format(a="n.fgen_min", b="o.fgen_min") + ", 6) pct from new n join old o on o.model = n.model")
def pct_diff(spark, d):
    return _compared(spark, d).select("model", "method", F.round("fgen_min_pct", 6).alias("pct"))


@query("equal_model_mean", given("atlantic", **ONE) + "select bin_idx, round(avg(fgen), 6) fgen, count(fgen) = 8 complete from profiles group by 1")
def equal_model_mean(spark, d):
    return _profile(spark, d).groupBy("bin_idx").agg(F.round(F.avg("fgen"), 6).alias("fgen"), (F.count("fgen") == 8).alias("complete"))


METRICS = """select n.model, n.method, round(l.fgen, 6) fgen_min, l.rho rho_at_min, round(g.rmse, 6) rmse, round(g.max_abs, 6) max_abs, round(h.x, 6) dense_integral
from new n join gaps g on g.model = n.model and g.method = n.method
join (select *, row_number() over (partition by model, method order by fgen, rho) k from others) l on l.k = 1 and l.model = n.model and l.method = n.method
join (select model, method, coalesce(sum(s), 0e0) x from (select *, {steps} s from others where rho >= 1020 window w as (partition by model, method order by rho)) group by 1, 2) h on h.model = n.model and h.method = n.method"""


@query("metric_table", given("atlantic", **COMPARE) + METRICS.format(steps=STEPS))
def metric_table(spark, d):
    by = ["model", "method"]
    others = _others(spark, d)
    low = profiles.at_minimum(others, tuple(by))
    dense = profiles.trapezoid(others.where("rho >= 1020"), "rho", profiles.negative_part(F.col("fgen")), tuple(by), "dense_integral")
    out = _compared(spark, d).select(*by, "rmse", "max_abs").join(low, by).join(dense, by)
    return rounded(out, 6, "fgen_min", "rmse", "max_abs", "dense_integral")


@query("profile_validity", given("atlantic", **ONE) + "select model, count(*) n, count(distinct rho) n_rho, count(case when s <= 0 then 1 end) not_increasing, count(case when fgen is null then 1 end) n_null from (select *, rho - lag(rho) over (partition by model order by bin_idx) s from profiles) group by 1")
def profile_validity(spark, d):
    w = Window.partitionBy("model").orderBy("bin_idx")
    t = _profile(spark, d).withColumn("s", F.col("rho") - F.lag("rho").over(w))
    return t.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("rho").alias("n_rho"), F.count_if(F.col("s") <= 0).alias("not_increasing"), F.count_if(F.col("fgen").isNull()).alias("n_null"))


JOINED = ocean.STRENGTH | ONE | {"summed": SUMMARY.format(steps=STEPS, source="profiles"), "joined": "select s.model, strength, fgen_min, negative_integral from strengths s join summed p on p.model = s.model"}


def _joined(spark, d):
    return ocean._strength(spark, d).join(profiles.summary(_profile(spark, d)), "model")


@query("strength_vs_metric", given("atlantic", "overturning", **JOINED) + "select model, round(strength, 6) strength, round(fgen_min, 6) fgen_min, round(negative_integral, 6) negative_integral from joined")
def strength_vs_metric(spark, d):
    return rounded(_joined(spark, d).select("model", "strength", "fgen_min", "negative_integral"), 6, "strength", "fgen_min", "negative_integral").orderBy(F.desc("strength"))


@query("exclusion_anti", given("atlantic", "overturning", **JOINED) + "select model, round(strength, 6) strength from joined where model not in ('M2', 'M5')")
def exclusion_anti(spark, d):
    out = spark.createDataFrame([("M2",), ("M5",)], "model string")
    return rounded(_joined(spark, d).join(out, "model", "left_anti").select("model", "strength"), 6, "strength")


@query("linear_fit", given("atlantic", "overturning", **JOINED) + "select round(regr_slope(strength, negative_integral), 6) slope, round(regr_intercept(strength, negative_integral), 6) intercept, round(case when var_pop(strength) > 0 then regr_r2(strength, negative_integral) end, 6) r2, count(*) n from joined where model not in ('M2', 'M5')")
def linear_fit(spark, d):
    kept = _joined(spark, d).where(~F.col("model").isin("M2", "M5"))
    return rounded(metrics.linear_fit(kept, "negative_integral", "strength"), 6, "slope", "intercept", "r2")


@query("cohort_overlap", given("file_catalog", a="select distinct model from file_catalog where variable = 'tos' and grid = 'gr'", b="select distinct model from file_catalog where variable = 'hfds' and grid = 'gr'")
       + "select coalesce(a.model, b.model) model, case when b.model is null then 'left' when a.model is null then 'right' else 'both' end side from a full join b on a.model = b.model")
def cohort_overlap(spark, d):
    t = views.file_catalog(spark, d).where("grid = 'gr'")
    a = t.where("variable = 'tos'").select("model").distinct().withColumn("l", F.lit(1))
    b = t.where("variable = 'hfds'").select("model").distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("r").isNull(), "left").when(F.col("l").isNull(), "right").otherwise("both")
    return a.join(b, "model", "full").select("model", side.alias("side"))


@query("timings_pivot", given("file_catalog", lasts="select model, variable, end_ym - start_ym s from (select *, row_number() over (partition by model, variable order by seq desc) k from file_catalog) where k = 1")
       + "select model, " + ", ".join(f"max(case when variable = '{v}' then s end) {v}" for v in ("tos", "sos", "hfds", "wfo", "msftmz")) + " from lasts group by 1")
def timings_pivot(spark, d):
    """The last value of each cell: the value at the largest sequence number, combined map-side."""
    t = views.file_catalog(spark, d).withColumn("s", F.col("end_ym") - F.col("start_ym"))
    return t.groupBy("model").pivot("variable", ["tos", "sos", "hfds", "wfo", "msftmz"]).agg(F.max_by("s", "seq"))

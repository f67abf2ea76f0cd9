"""Surface water-mass transformation by model, held against the overturning of the same months.

    python -m jobs.transformation INPUT OUTPUT [--config settings.json]

For each model of the input tables: the cells of the region with density and forcing; of
the months in which all four fields are there, the last ``years`` years of the
latest unbroken run; the forcing over density classes in each of those months; and from
their mean a summary: smallest value and its density, integral of the negative part, area,
strength of the overturning in the same months, and what is wrong with the model, if anything.

Output, each partitioned by model, under a folder named by a digest of the settings:

    OUTPUT/<digest>/cells     the prepared cells, from which all else is computed
    OUTPUT/<digest>/monthly   ym, bin_idx, rho, fgen, heat_flux, freshwater_flux, area_sum
    OUTPUT/<digest>/summary   a row per model

A run replaces the partitions of the models that the input has, each as a whole, so a
rerun gives the same files and one that was stopped is simply run again.  Models that the
input no longer has keep what they had.  A model without a common month has a summary with that fault and
no months.  Null fields add nothing; empty tables give empty output.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopycna.functions import geo
from isopycna.operators import bins, checks, months, overturn, profiles
from isopycna.plans import runs
from isopycna.plans.sql import VIEWS, given
from isopycna.sources import results, scratch, views

from .common import command, rows_of, saved, settings

log = logging.getLogger("jobs.transformation")
DEFAULT = "transformation.json"
FIELDS = ("tos", "sos", "hfds", "wfo")
CELLS = "ym int, cell_id long, tos double, sos double, hfds double, wfo double, rho double, fsurf double, heat double, fw double, area double, model string"
MONTHLY = "ym int, bin_idx int, rho double, fgen double, heat_flux double, freshwater_flux double, area_sum double, model string"
SUMMARY = "n_months long, fgen_min double, rho_at_min double, negative_integral double, area_total double, strength double, fault string, model string"


def place(output: str, config: dict) -> str:
    return f"{output.rstrip('/')}/{runs.fingerprint(config)[:12]}"


def checked(config: dict) -> bins.Classes:
    """The density classes; raises where the settings make no sense."""
    checks.whole_years(12 * config["years"])
    checks.ordered(longitudes=(config["west"], config["east"]), latitudes=(config["strength_south"], config["strength_north"]), latitude=(config["south"], 90.0))
    return bins.Classes(config["rho_min"], config["rho_max"], config["rho_step"])


def window(cells: DataFrame, years: int) -> DataFrame:
    """``(model, ym, short)``: the months of each model that are looked at."""
    there = cells.groupBy("model", "ym").agg(*(F.count(f).alias(f) for f in FIELDS))
    each = there.unpivot(["model", "ym"], list(FIELDS), "variable", "n").where("n > 0")
    return months.common(each, len(FIELDS), 12 * years)


def summaries(monthly: DataFrame, frame: DataFrame, strength: DataFrame, models: DataFrame) -> DataFrame:
    """A row for each of ``models``."""
    mean = monthly.groupBy("model", "bin_idx", "rho").agg(F.avg("fgen").alias("fgen"), F.avg("area_sum").alias("area_sum"))
    found = profiles.summary(mean).join(profiles.at_minimum(mean, ("model",)).select("model", "rho_at_min"), "model")
    looked = frame.groupBy("model").agg(F.count("*").alias("n_months"), F.bool_or("short").alias("short"))
    out = models.join(looked, "model", "left").join(found, "model", "left").join(strength, "model", "left")
    fault = F.when(F.col("n_months").isNull(), "no common month").when(F.col("area_total") <= 0, "no cell in any class").when(F.col("short"), "short window").when(F.col("strength").isNull(), "no overturning")
    return out.select(F.coalesce("n_months", F.lit(0)).alias("n_months"), "fgen_min", "rho_at_min", "negative_integral", "area_total", "strength", fault.alias("fault"), "model")


def run(spark: SparkSession, source: str, output: str, config: dict) -> dict:
    """One run over the tables in ``source``; gives the numbers of rows written."""
    classes, out = checked(config), place(output, config)
    mask = (F.col("lat") > config["south"]) & (F.col("nlon") >= config["west"]) & (F.col("nlon") <= config["east"])
    prepared = views.derived(spark, source, mask).select(*(c.split()[0] for c in CELLS.split(", ")))
    wrote = {"cells": saved(prepared, f"{out}/cells", ("model",))}
    log.info("read %s from %s, wrote %d cells to %s/cells", rows_of(spark, source, "lineitem", "part"), source, wrote["cells"], out)
    # What this run has read: models that only earlier runs had are not computed again.
    models = views.model_months(spark, source).select("model").distinct()
    cells = results.load(spark, f"{out}/cells", spark.createDataFrame([], CELLS).schema).join(models, "model", "left_semi")
    frame = window(cells, config["years"])
    inside = cells.join(frame.select("model", "ym"), ["model", "ym"])
    monthly = bins.monthly(inside, frame.select("model", "ym"), classes)
    wrote["monthly"] = saved(monthly, f"{out}/monthly", ("model",))
    log.info("read %s/cells, wrote %d classes of months to %s/monthly", out, wrote["monthly"], out)
    monthly = results.load(spark, f"{out}/monthly", spark.createDataFrame([], MONTHLY).schema).join(models, "model", "left_semi")
    flow = overturn.atlantic(views.overturning(spark, source)).join(frame.select("model", "ym"), ["model", "ym"])
    strength = overturn.strength(overturn.climatology(flow), config["strength_south"], config["strength_north"], config["strength_depth"])
    wrote["summary"] = saved(summaries(monthly, frame, strength, models), f"{out}/summary", ("model",))
    log.info("read %s from %s, and %s/monthly, wrote %d models to %s/summary", rows_of(spark, source, "orders"), source, out, wrote["summary"], out)
    return wrote


def tables(spark: SparkSession, output: str, config: dict) -> tuple[DataFrame, DataFrame]:
    """The monthly classes and the summaries as they stand."""
    out = place(output, config)
    read = lambda name, kind: results.load(spark, f"{out}/{name}", spark.createDataFrame([], kind).schema)
    return read("monthly", MONTHLY), read("summary", SUMMARY)


def job1_transformation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one new folder, and all that is there after them: each model's months and classes beside its summary."""
    out, config = scratch.folder(spark), settings(None, DEFAULT)
    for _ in range(2):
        run(spark, sf_dir, out, config)
    monthly, summary = tables(spark, out, config)
    r = lambda c, digits=6, scale=1.0: F.round(F.col(c) / scale, digits).alias(c)
    return summary.join(monthly, "model", "left").select(
        "model", "ym", "bin_idx", "rho", r("fgen"), r("heat_flux"), r("freshwater_flux"), r("area_sum", 4, 1e6),
        "n_months", r("fgen_min"), r("rho_at_min"), r("negative_integral"), r("area_total", 4, 1e6), r("strength"), "fault",
    )


C = bins.Classes(step=0.5)
CENTER = f"round({C.lower!r}e0 + b.bin_idx * 0.5e0 + 0.25e0, 6)"
SQL = given("atlantic", overturning=VIEWS["overturning"],
    have="select model, ym from atlantic group by 1, 2 having count(tos) > 0 and count(sos) > 0 and count(hfds) > 0 and count(wfo) > 0",
    numbered="select *, ym - row_number() over (partition by model order by ym) g from have",
    stretches="select model, min(ym) a, max(ym) b, count(*) n from numbered group by model, g",
    latest="select * from stretches qualify row_number() over (partition by model order by b desc) = 1",
    frame="select model, n < 24 short, cast(unnest(range(greatest(a, b - 23), b + 1)) as int) ym from latest",
    sums=f"""select model, ym, bin_idx, sum(fsurf * area) f, sum(heat * area) h, sum(fw * area) w, sum(area) a from (select *,
 case when rho > {C.lower!r}e0 and rho < {C.upper!r}e0 then least(cast(floor((rho - {C.lower!r}e0) / 0.5e0) as int), {C.count - 1}) end bin_idx from atlantic) where bin_idx is not null group by 1, 2, 3""",
    monthly=f"""select t.model, t.ym, b.bin_idx, {CENTER} rho, coalesce(f, 0e0) / 5e5 fgen, coalesce(h, 0e0) / 5e5 heat_flux, coalesce(w, 0e0) / 5e5 freshwater_flux, coalesce(a, 0e0) area_sum
 from frame t cross join (select cast(range as int) bin_idx from range({C.count})) b left join sums s on s.model = t.model and s.ym = t.ym and s.bin_idx = b.bin_idx""",
    profile="select model, bin_idx, rho, avg(fgen) fgen, avg(area_sum) area_sum from monthly group by 1, 2, 3",
    steps="select *, (rho - lag(rho) over w) * (greatest(-fgen, 0e0) + lag(greatest(-fgen, 0e0)) over w) / 2e0 s from profile window w as (partition by model order by rho)",
    lows="select model, min(fgen) fgen_min, sum(area_sum) area_total, coalesce(sum(s), 0e0) negative_integral from steps group by 1",
    deepest="select model, rho rho_at_min from profile qualify row_number() over (partition by model order by fgen, rho) = 1",
    flow="select o.model, lev, lat, avg(msftmz) / 1e9 sv from overturning o join frame f on f.model = o.model and f.ym = o.ym where lower(trim(basin)) = 'atlantic_arctic_ocean' group by 1, 2, 3",
    strong="select model, max(sv) strength from flow where lat between 0 and 60 and lev >= 250 group by 1",
    looked="select model, count(*) n_months, bool_or(short) short from frame group by 1",
    summary="""select t.model, coalesce(n_months, 0) n_months, fgen_min, rho_at_min, negative_integral, area_total, strength,
 case when n_months is null then 'no common month' when area_total <= 0 then 'no cell in any class' when short then 'short window' when strength is null then 'no overturning' end fault
 from (select distinct model from surface_cells) t left join looked k on k.model = t.model left join lows l on l.model = t.model left join deepest a on a.model = t.model left join strong s on s.model = t.model""",
) + """select s.model, ym, bin_idx, rho, round(fgen, 6) fgen, round(heat_flux, 6) heat_flux, round(freshwater_flux, 6) freshwater_flux, round(area_sum / 1e6, 4) area_sum, n_months, round(fgen_min, 6) fgen_min,
 round(rho_at_min, 6) rho_at_min, round(negative_integral, 6) negative_integral, round(area_total / 1e6, 4) area_total, round(strength, 6) strength, fault from summary s left join monthly m on m.model = s.model"""  # fmt: skip

QUERIES = {"job1_transformation": job1_transformation}
ORACLES = {"job1_transformation": SQL}

if __name__ == "__main__":
    command(run, DEFAULT, "Surface transformation by model, partitioned by model.")

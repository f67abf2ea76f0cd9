"""Queries of the file catalogue and of the month axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import catalog, months
from ..sources import views
from .registry import query
from .sql import given

VARIABLES = (*catalog.SURFACE, "msftmz")
FOUR = "('tos', 'sos', 'hfds', 'wfo')"


def named(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue with file names."""
    date = lambda c: geo.yyyymm(F.col(c)).cast("string")
    name = F.concat(F.concat_ws("_", "variable", F.lit("Omon"), "model", F.lit("piControl"), F.lit("r1i1p1f1"), "grid", F.concat_ws("-", date("start_ym"), date("end_ym"))), F.lit(".nc"))
    return views.file_catalog(spark, d).withColumn("filename", name)


def number(model: str = "model") -> Column:
    return F.substring(model, 2, 9).cast("int")


def _model_months(spark, d):
    """(model, variable, ym): months for which a model has a value of the variable."""
    t = views.surface_cells(spark, d).groupBy("model", "ym").agg(*(F.count(v).alias(v) for v in catalog.SURFACE))
    return t.unpivot(["model", "ym"], list(catalog.SURFACE), "variable", "n").where("n > 0").where(~((F.col("variable") == "wfo") & (F.col("ym") % 23 == 0))).select("model", "variable", "ym")


MODEL_MONTHS = """select model, variable, ym from (
 select model, ym, 'tos' variable, count(tos) n from surface_cells group by 1, 2 union all select model, ym, 'sos', count(sos) from surface_cells group by 1, 2 union all
 select model, ym, 'hfds', count(hfds) from surface_cells group by 1, 2 union all select model, ym, 'wfo', count(wfo) from surface_cells group by 1, 2) where n > 0 and not (variable = 'wfo' and ym % 23 = 0)"""


@query("file_groups", given("files") + "select split_part(filename, '_', 3) model, count(*) n, array_to_string(list(filename order by filename), ';') paths from files where len(string_split(filename, '_')) >= 3 group by 1")
def file_groups(spark, d):
    parts = F.split("filename", "_")
    files = named(spark, d).where(F.size(parts) >= 3)
    return files.groupBy(parts[2].alias("model")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("filename")), ";").alias("paths"))


@query("file_registry", given("files") + "select model, " + ", ".join(f"count(case when variable = '{v}' then 1 end) {v}" for v in VARIABLES) + ", min(filename) first_file from files group by model")
def file_registry(spark, d):
    return named(spark, d).groupBy("model").agg(*(F.count_if(F.col("variable") == v).alias(v) for v in VARIABLES), F.min("filename").alias("first_file"))


@query("candidate_models", given("file_catalog") + f"select model from file_catalog where variable in {FOUR} and model not in ('M3', 'M7') and cast(model[2:] as int) < 30 group by model having count(distinct variable) = 4")
def candidate_models(spark, d):
    excluded = spark.createDataFrame([("M3",), ("M7",)], "model string")
    included = spark.range(30).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("model"))
    return catalog.with_all(views.file_catalog(spark, d)).join(excluded, "model", "left_anti").join(included, "model", "left_semi").orderBy("model")


@query("scan_surface", given("surface_cells") + "select model, count(*) n, count(tos) n_tos, count(wfo) n_wfo, min(ym) low, max(ym) high from surface_cells group by model")
def scan_surface(spark, d):
    return views.surface_cells(spark, d).groupBy("model").agg(F.count("*").alias("n"), F.count("tos").alias("n_tos"), F.count("wfo").alias("n_wfo"), F.min("ym").alias("low"), F.max("ym").alias("high"))


NATIVE = "select concat('M', cast(cell_id % 8 as varchar)) model, sum(area) area, count(*) n from cells where cell_id % 8 <> 5 group by 1"
ALL_MODELS = "select concat('M', cast(range as varchar)) model from range(8)"


def _native(spark, d):
    t = views.cells(spark, d).where("cell_id % 8 <> 5")
    return t.groupBy(F.concat(F.lit("M"), (F.col("cell_id") % 8).cast("string")).alias("model")).agg(F.sum("area").alias("area"), F.count("*").alias("n"))


@query("area_alias", given("cells", native=NATIVE, models=ALL_MODELS) + "select m.model, round(coalesce(a.area, b.area) / 1e9, 3) area, a.area is null aliased from models m left join native a on a.model = m.model left join native b on m.model = 'M5' and b.model = 'M1'")
def area_alias(spark, d):
    models = spark.range(8).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("model"))
    alias = spark.createDataFrame([("M5", "M1")], "model string, other string")
    own = _native(spark, d)
    stand_in = own.select(F.col("model").alias("other"), F.col("area").alias("area2"))
    out = models.join(own, "model", "left").join(alias, "model", "left").join(stand_in, "other", "left")
    return out.select("model", F.round(F.coalesce("area", "area2") / 1e9, 3).alias("area"), F.col("area").isNull().alias("aliased"))


@query("area_native", given("cells", native=NATIVE, models=ALL_MODELS) + "select m.model, round(a.area / 1e9, 3) area, a.area is null missing from models m left join native a on a.model = m.model")
def area_native(spark, d):
    models = spark.range(8).select(F.concat(F.lit("M"), F.col("id").cast("string")).alias("model"))
    return models.join(_native(spark, d), "model", "left").select("model", F.round(F.col("area") / 1e9, 3).alias("area"), F.col("area").isNull().alias("missing"))


@query("first_steps", given("surface_cells") + "select model, ym from (select model, ym, row_number() over (partition by model order by ym) n from (select distinct model, ym from surface_cells)) where n <= 5")
def first_steps(spark, d):
    w = Window.partitionBy("model").orderBy("ym")
    return views.model_months(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 5").drop("n")


@query("catalog_search", given("files") + "select distinct model from files where variable = 'tos' and grid = 'gn' and version >= 3")
def catalog_search(spark, d):
    return named(spark, d).where((F.col("variable") == "tos") & (F.col("grid") == "gn") & (F.col("version") >= 3)).select("model").distinct()


@query("latest_dataset", given("files") + "select model, filename, version from (select *, row_number() over (partition by model order by filename desc, seq desc) n from files) where n = 1")
def latest_dataset(spark, d):
    return catalog.newest(named(spark, d), ["model"], F.desc("filename"), F.desc("seq")).select("model", "filename", "version")


@query("facet_pairs", given("file_catalog", pairs="select model, count(case when grid = 'gr' then 1 end) n from file_catalog group by model") + "select model name, n from pairs where n > 0")
def facet_pairs(spark, d):
    """Flat lists [name, count, name, count, ...]: even places are names."""
    t = views.file_catalog(spark, d).groupBy("model").agg(F.count_if(F.col("grid") == "gr").alias("n"))
    flat = t.groupBy(F.pmod(F.hash("model"), F.lit(16)).alias("shelf")).agg(F.flatten(F.collect_list(F.array("model", F.col("n").cast("string")))).alias("facets"))
    pairs = flat.select("facets", F.posexplode("facets").alias("pos", "name")).where("pos % 2 = 0")
    return pairs.select("name", F.try_element_at("facets", F.col("pos") + 2).cast("long").alias("n")).where("n > 0")


@query("discover_models", given("file_catalog") + "select model from file_catalog where variable = 'tos' intersect select model from file_catalog where variable = 'sos' intersect select model from file_catalog where variable = 'msftmz'")
def discover_models(spark, d):
    nodes = [views.file_catalog(spark, d).where(F.col("seq") % 5 == k) for k in range(5)]
    everything = nodes[0]
    for n in nodes[1:]:
        everything = everything.unionByName(n)
    of = lambda v: everything.where(F.col("variable") == v).select("model").distinct()
    return of("tos").intersect(of("sos")).intersect(of("msftmz")).orderBy("model")


@query("availability_scan", given("file_catalog") + "select variable, model, count(*) n from file_catalog group by 1, 2")
def availability_scan(spark, d):
    """Lines ``NAME (count)``: the name is what stands before the first blank."""
    lines = views.file_catalog(spark, d).groupBy("variable", "model").agg(F.count("*").alias("n"))
    lines = lines.select("variable", F.concat("model", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("value"))
    return lines.select("variable", F.split("value", " ")[0].alias("model"), F.regexp_extract("value", r"\((\d+)\)", 1).cast("long").alias("n"))


@query("parse_filenames", given("files") + "select filename, variable p_variable, 'Omon' p_table, model p_model, grid p_grid, cast((start_ym // 12) * 100 + start_ym % 12 + 1 as int) p_start, cast((end_ym // 12) * 100 + end_ym % 12 + 1 as int) p_end, 'time' kind from files")
def parse_filenames(spark, d):
    return catalog.parse(named(spark, d).select("filename")).select("filename", "p_variable", "p_table", "p_model", "p_grid", "p_start", "p_end", "kind")


@query("cesm_scan", given("files") + "select split_part(filename, '_', 1) variable, count(*) n, min(filename) first_file from files group by 1")
def cesm_scan(spark, d):
    return named(spark, d).groupBy(F.substring_index("filename", "_", 1).alias("variable")).agg(F.count("*").alias("n"), F.min("filename").alias("first_file"))


@query("batch_merge", given("file_catalog") + "select model, batch, n, overlap from (select model, seq % 4 batch, count(*) n, count(*) over (partition by model) > 1 overlap, row_number() over (partition by model order by seq % 4 desc) k from file_catalog group by model, seq % 4) where k = 1")
def batch_merge(spark, d):
    """Of numbered batches of results the later one stands."""
    t = views.file_catalog(spark, d).groupBy("model", (F.col("seq") % 4).alias("batch")).agg(F.count("*").alias("n"))
    t = t.withColumn("overlap", F.count("*").over(Window.partitionBy("model")) > 1)
    return catalog.newest(t, ["model"], F.desc("batch")).select("model", "batch", "n", "overlap")


@query("overturning_models", given("file_catalog") + "select model, count(*) n from file_catalog where variable = 'msftmz' group by model having count(*) > 0")
def overturning_models(spark, d):
    return views.file_catalog(spark, d).where("variable = 'msftmz'").groupBy("model").agg(F.count("*").alias("n")).where("n > 0")


@query("grid_labels", given("files") + f"""select model, array_to_string(list_sort(coalesce(list(distinct grid) filter (variable in {FOUR}), list(distinct grid))), ',') grids from files group by model""")
def grid_labels(spark, d):
    label = F.regexp_extract("filename", r"r1i1p1f1_([^_.]+)", 1)
    t = named(spark, d).withColumn("label", label).groupBy("model").agg(
        F.collect_set(F.when(F.col("variable").isin(*catalog.SURFACE), F.col("label"))).alias("surface"), F.collect_set("label").alias("any")
    )
    return t.select("model", F.array_join(F.sort_array(F.when(F.size("surface") > 0, F.col("surface")).otherwise(F.col("any"))), ",").alias("grids"))


GAP = """cover as (select *, greatest(start_ym, threshold) start from (select *, max(end_ym) over (partition by model, variable) last, max(end_ym) over (partition by model, variable) - 359 threshold from file_catalog) where end_ym >= threshold),
sweep as (select *, max(end_ym) over (partition by model, variable order by start, end_ym, seq rows between unbounded preceding and 1 preceding) before from cover)"""


@query("coverage_gaps", given("file_catalog") + f", {GAP} select model, variable, min(case when start > coalesce(before + 1, threshold) then coalesce(before + 1, threshold) end) gap_from, count(*) n_files from sweep group by 1, 2")
def coverage_gaps(spark, d):
    return catalog.gaps(views.file_catalog(spark, d), ("model", "variable"), 360)


@query("coverage_overlap", given("file_catalog") + f", {GAP} select model, variable, coalesce(bool_or(start <= before), false) overlap from sweep group by 1, 2")
def coverage_overlap(spark, d):
    return catalog.overlaps(views.file_catalog(spark, d), ("model", "variable"), 360)


@query("running_max", given("file_catalog") + "select model, variable, seq, max(end_ym) over (partition by model, variable order by start_ym, end_ym, seq rows between unbounded preceding and 1 preceding) before from file_catalog")
def running_max(spark, d):
    w = Window.partitionBy("model", "variable").orderBy("start_ym", "end_ym", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return views.file_catalog(spark, d).select("model", "variable", "seq", F.max("end_ym").over(w).alias("before"))


@query("dedup_version", given("files") + """select filename, version, seq, n from (select filename, nullif(version, 8) version, seq, count(*) over (partition by filename) n,
 row_number() over (partition by filename order by coalesce(nullif(version, 8), -1) desc, seq) k from files) where k = 1""")
def dedup_version(spark, d):
    t = named(spark, d).withColumn("version", F.nullif(F.col("version"), F.lit(8))).withColumn("n", F.count("*").over(Window.partitionBy("filename")))
    return catalog.newest(t, ["filename"], F.coalesce("version", F.lit(-1)).desc(), F.col("seq")).select("filename", "version", "seq", "n")


RULE = "msftmz = 1 and wfo = 1 and hfds = 1 and tos = 1 and sos = 1"


@query("availability_rule", given("file_catalog", matrix="select model, " + ", ".join(f"max(case when variable = '{v}' then 1 else 0 end) {v}" for v in VARIABLES) + " from file_catalog where grid = 'gr' group by model") + f"select *, {RULE} complete from matrix")
def availability_rule(spark, d):
    return catalog.availability(views.file_catalog(spark, d).where("grid = 'gr'"), VARIABLES).select("model", *VARIABLES, F.expr(RULE).alias("complete"))


@query("last_n_year_files", given("files") + """select filename, start_ym, end_ym from (select *, max(end_ym // 12) over (partition by model, variable) - 29 threshold from files) where end_ym // 12 >= threshold""")
def last_n_year_files(spark, d):
    year = F.floor(F.col("end_ym") / 12)
    t = named(spark, d).withColumn("threshold", F.max(year).over(Window.partitionBy("model", "variable")) - 29)
    return t.where(year >= F.col("threshold")).select("filename", "start_ym", "end_ym").orderBy("start_ym", "end_ym", "filename")


@query("greedy_cover", given("file_catalog", recursive=True, slim="select model, variable, start_ym // 12 y0, end_ym // 12 y1, min(seq) seq from file_catalog group by 1, 2, 3, 4",
       every="""select *, max(y1) over (partition by model, variable) top from (select s.*, y.range y, row_number() over (partition by model, variable, y.range order by y0, y1 desc, seq) k from slim s join range(1900, 2200) y on y.range between y0 and y1) where k = 1""",
       chosen="""select model, variable, y0, y1, seq, top - 29 low, 1 step from every where y = top union all
 select e.model, e.variable, e.y0, e.y1, e.seq, c.low, c.step + 1 from chosen c join every e on e.model = c.model and e.variable = c.variable and e.y = c.y0 - 1 where c.y0 - 1 >= c.low""")
       + "select model, variable, cast(y0 as int) y0, cast(y1 as int) y1, seq, step from chosen")
def greedy_cover(spark, d):
    return catalog.greedy_cover(views.file_catalog(spark, d), ("model", "variable"), 30)


@query("grid_match", given("file_catalog", common=f"select model, grid from file_catalog where variable in {FOUR} group by 1, 2 having count(distinct variable) = 4", area="select distinct model, grid from file_catalog where variable = 'msftmz'")
       + "select c.model, c.grid, a.grid is not null matched from common c left join area a on a.model = c.model and a.grid = c.grid")
def grid_match(spark, d):
    t = views.file_catalog(spark, d)
    area = t.where("variable = 'msftmz'").select("model", "grid").distinct().withColumn("matched", F.lit(True))
    return catalog.with_all(t, by=("model", "grid")).join(area, ["model", "grid"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


@query("wanted_grids", given("file_catalog", wanted=f"select model, grid from file_catalog where variable in {FOUR} group by 1, 2 having count(distinct variable) = 4", have="select model, grid, count(*) n from file_catalog where variable = 'msftmz' group by 1, 2")
       + "select w.model, w.grid, coalesce(h.n, 0) n, h.n is null missing from wanted w left join have h on h.model = w.model and h.grid = w.grid")
def wanted_grids(spark, d):
    t = views.file_catalog(spark, d)
    have = t.where("variable = 'msftmz'").groupBy("model", "grid").agg(F.count("*").alias("n"))
    out = catalog.with_all(t, by=("model", "grid")).join(have, ["model", "grid"], "left")
    return out.select("model", "grid", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


VERDICT = f"""{GAP}, state as (select model, variable, min(case when start > coalesce(before + 1, threshold) then 1 else 0 end) is not null has, max(case when start > coalesce(before + 1, threshold) then 1 else 0 end) gap from sweep group by 1, 2),
perm as (select model, count(distinct variable) n_var, coalesce(sum(gap), 0) n_gap from state where variable in {FOUR} group by model),
grids as (select model, count(*) n_grid from (select model, grid from file_catalog where variable in {FOUR} group by 1, 2 having count(distinct variable) = 4) where (model, grid) in (select (model, grid) from file_catalog where variable = 'msftmz') group by 1)"""


@query("model_verdict", given("file_catalog") + f", {VERDICT} select p.model, n_var, cast(n_gap as bigint) n_gap, coalesce(n_grid, 0) n_grid, n_var = 4 and n_gap = 0 and coalesce(n_grid, 0) > 0 passed from perm p left join grids g on g.model = p.model")
def model_verdict(spark, d):
    t = views.file_catalog(spark, d)
    state = catalog.gaps(t, ("model", "variable"), 360).where(F.col("variable").isin(*catalog.SURFACE))
    state = state.groupBy("model").agg(F.countDistinct("variable").alias("n_var"), F.count("gap_from").alias("n_gap"))
    grids = grid_match(spark, d).where("matched").groupBy("model").agg(F.count("*").alias("n_grid"))
    out = state.join(grids, "model", "left").withColumn("n_grid", F.coalesce("n_grid", F.lit(0)))
    return out.withColumn("passed", (F.col("n_var") == 4) & (F.col("n_gap") == 0) & (F.col("n_grid") > 0))


@query("stage_plan", given("files") + f", {VERDICT}, passed as (select p.model from perm p join grids g on g.model = p.model where n_var = 4 and n_gap <= 4 and n_grid > 0) select filename from files where model in (select model from passed) and model not in (select model from file_catalog where seq % 50 = 0)")
def stage_plan(spark, d):
    """Files of passing models that the target does not have yet."""
    passing = model_verdict(spark, d).where("n_var = 4 and n_gap <= 4 and n_grid > 0")
    there = views.file_catalog(spark, d).where("seq % 50 = 0").select("model")
    return named(spark, d).join(passing, "model", "left_semi").join(there, "model", "left_anti").select("filename")


@query("completion_matrix", given("file_catalog") + "select model, max(case when grid = 'gn' then 1 else 0 end) gn, max(case when grid = 'gr' then 1 else 0 end) gr, count(distinct grid) / 2e0 fraction from file_catalog where variable = 'tos' group by model")
def completion_matrix(spark, d):
    t = views.file_catalog(spark, d).where("variable = 'tos'").groupBy("model").pivot("grid", ["gn", "gr"]).agg(F.max(F.lit(1))).fillna(0, ["gn", "gr"])
    return t.withColumn("fraction", (F.col("gn") + F.col("gr")) / 2.0)


@query("common_cohort", given("file_catalog") + "select model, count(distinct variable) n, count(distinct variable) = 5 in_all from file_catalog group by model")
def common_cohort(spark, d):
    return views.file_catalog(spark, d).groupBy("model").agg(F.countDistinct("variable").alias("n")).withColumn("in_all", F.col("n") == 5)


@query("run_summary", given("file_catalog") + "select variable, count(*) n, count(case when version > 4 then 1 end) processed, count(case when version = 0 then 1 end) failed, count(case when version between 1 and 4 then 1 end) skipped from file_catalog group by variable")
def run_summary(spark, d):
    v = F.col("version")
    return views.file_catalog(spark, d).groupBy("variable").agg(F.count("*").alias("n"), F.count_if(v > 4).alias("processed"), F.count_if(v == 0).alias("failed"), F.count_if(v.between(1, 4)).alias("skipped"))


# -- sets and limits --------------------------------------------------------------------


def _of(spark, d, variable):
    return views.file_catalog(spark, d).where(F.col("variable") == variable).select("model")


@query("set_union", given("file_catalog") + "select model from file_catalog where variable = 'tos' union select model from file_catalog where variable = 'wfo'")
def set_union(spark, d):
    return _of(spark, d, "tos").union(_of(spark, d, "wfo")).distinct()


@query("set_intersect", given("file_catalog") + "select model from file_catalog where variable = 'tos' and grid = 'gr' intersect select model from file_catalog where variable = 'wfo' and grid = 'gr'")
def set_intersect(spark, d):
    t = views.file_catalog(spark, d).where("grid = 'gr'")
    return t.where("variable = 'tos'").select("model").intersect(t.where("variable = 'wfo'").select("model"))


@query("set_except", given("file_catalog") + "select distinct model from file_catalog where variable = 'tos' except select model from file_catalog where variable = 'wfo' and grid = 'gr' and version = 3")
def set_except(spark, d):
    return _of(spark, d, "tos").distinct().exceptAll(views.file_catalog(spark, d).where("variable = 'wfo' and grid = 'gr' and version = 3").select("model").distinct())


@query("limit_models", given("file_catalog") + "select distinct model from file_catalog order by model limit 5")
def limit_models(spark, d):
    return views.file_catalog(spark, d).select("model").distinct().orderBy("model").limit(5)


@query("resume_anti", given("file_catalog") + "select model, count(*) n from file_catalog where model not in (select model from file_catalog where variable = 'msftmz' and version = 8) group by model")
def resume_anti(spark, d):
    """Models that the output does not hold yet."""
    done = views.file_catalog(spark, d).where("variable = 'msftmz' and version = 8").select("model").distinct()
    return views.file_catalog(spark, d).join(done, "model", "left_anti").groupBy("model").agg(F.count("*").alias("n"))


@query("config_hash", given("file_catalog", manifest="""select model, array_to_string(list(concat('{"end":', end_ym, ',"seq":', seq, ',"start":', start_ym, '}') order by seq), ',') j from file_catalog group by model""") + "select model, sha256(concat('[', j, ']')) fingerprint from manifest")
def config_hash(spark, d):
    row = F.struct("seq", F.to_json(F.struct(F.col("end_ym").alias("end"), "seq", F.col("start_ym").alias("start"))).alias("j"))
    t = views.file_catalog(spark, d).groupBy("model").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return t.select("model", F.sha2(F.concat(F.lit("["), F.array_join(F.col("rows.j"), ","), F.lit("]")), 256).alias("fingerprint"))


# -- names, links and numbers -------------------------------------------------------------


@query("json_coerce", "select event_id, coalesce(json_extract_string(props, '$.a'), json_extract_string(props, '$[0]')) first_value, try_cast(json_extract_string(props, '$.k') as int) as k, try_cast(coalesce(event_type, '') as int) bad from events")
def json_coerce(spark, d):
    e = views.table(spark, d, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.a"), F.get_json_object("props", "$[0]")).alias("first_value"), F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.coalesce("event_type", F.lit("")).try_cast("int").alias("bad"))


@query("url_pick", """select page_id, case when page_id % 3 <> 0 then split_part(concat(url, '|application/netcdf|HTTPServer'), '|', 1) else url end picked from pages""")
def url_pick(spark, d):
    """First link of a list ``url|mime|service`` that HTTPServer offers, else the first that is a plain address."""
    served = F.when(F.col("page_id") % 3 != 0, F.concat("url", F.lit("|application/netcdf|HTTPServer")))
    links = F.array_compact(F.array(F.concat(F.lit("gsiftp://x/"), F.col("page_id").cast("string"), F.lit("|application/gridftp|GridFTP")), served, F.col("url")))
    http = F.filter(links, lambda x: F.element_at(F.split(x, r"\|"), -1) == "HTTPServer")
    plain = F.filter(links, lambda x: x.startswith("http"))
    pick = F.coalesce(F.split(F.get(http, F.lit(0)), r"\|")[0], F.get(plain, F.lit(0)))
    return views.table(spark, d, "pages").select("page_id", pick.alias("picked"))


@query("version_extract", given("file_catalog") + "select seq, case when version % 3 = 0 then null else cast(20190000 + version as int) end version from file_catalog")
def version_extract(spark, d):
    v = F.concat(F.lit("CMIP6.x.v"), (F.col("version") + 20190000).cast("string"), F.lit("|node"))
    ids = F.array(F.when(F.col("version") % 3 == 1, v), F.lit("no version"), F.when(F.col("version") % 3 == 2, v))
    found = F.transform(F.array_compact(ids), lambda x: F.nullif(F.regexp_extract(x, r"\.v(\d+)", 1), F.lit("")))
    return views.file_catalog(spark, d).select("seq", F.get(F.array_compact(found), F.lit(0)).try_cast("int").alias("version"))


@query("format_helpers", """select o_orderkey, case when b < 1024 then printf('%d B', b) when b < 1048576 then printf('%.1f KiB', b / 1024e0) else printf('%.1f MiB', b / 1048576e0) end size_text,
 case when s < 60 then printf('%ds', s) when s < 3600 then printf('%dm %ds', s // 60, s % 60) else printf('%dh %dm %ds', s // 3600, s % 3600 // 60, s % 60) end duration_text,
 concat(replace(cast(case when o_orderkey % 2 = 0 then '1.5' else '2' end as varchar), '.', 'p'), 'deg') resolution_text
 from (select o_orderkey, o_orderkey * 37 % 2000000 * 2 + 1 b, o_orderkey * 13 % 9000 s from orders)""")
def format_helpers(spark, d):
    k = F.col("o_orderkey")
    b, s = k * 37 % 2000000 * 2 + 1, k * 13 % 9000
    size = F.when(b < 1024, F.format_string("%d B", b)).when(b < 1048576, F.format_string("%.1f KiB", b / 1024.0)).otherwise(F.format_string("%.1f MiB", b / 1048576.0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    time = F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%dh %dm %ds", h, m, r))
    grid = F.concat(F.replace(F.when(k % 2 == 0, F.lit("1.5")).otherwise(F.lit("2")), F.lit("."), F.lit("p")), F.lit("deg"))
    return views.table(spark, d, "orders").select("o_orderkey", size.alias("size_text"), time.alias("duration_text"), grid.alias("resolution_text"))


# -- months ---------------------------------------------------------------------------------


@query("islands", given("surface_cells") + "select model, min(ym) start_ym, max(ym) end_ym, count(*) n from (select model, ym, ym - row_number() over (partition by model order by ym) g from (select distinct model, ym from surface_cells)) group by model, g")
def islands(spark, d):
    return months.islands(views.model_months(spark, d))


@query("common_months", given("surface_cells", mm=MODEL_MONTHS, shared="select model, ym from mm group by 1, 2 having count(distinct variable) = 4",
       runs="select model, min(ym) s, max(ym) e, count(*) n from (select model, ym, ym - row_number() over (partition by model order by ym) g from shared) group by model, g",
       lastrun="select * from (select *, row_number() over (partition by model order by e desc) k from runs) where k = 1")
       + "select s.model, n < 12 short, s.ym from lastrun l join shared s on s.model = l.model and s.ym between greatest(l.s, l.e - 11) and l.e")
def common_months(spark, d):
    return months.common(_model_months(spark, d), 4, 12)


@query("trailing_window", given("surface_cells", mm=MODEL_MONTHS, ends="select model, min(l) e from (select model, variable, max(ym) l from mm group by 1, 2) group by 1")
       + "select model, variable, ym from (select m.*, row_number() over (partition by m.model, variable order by ym desc) k from mm m join ends x on x.model = m.model where ym <= e and ym >= e - 24) where k <= 20")
def trailing_window(spark, d):
    return months.trailing(_model_months(spark, d), 2, 20)


@query("month_counts", given("surface_cells") + "select model, cast(ym % 12 + 1 as int) as \"month\", count(distinct ym) n from surface_cells group by 1, 2")
def month_counts(spark, d):
    return views.model_months(spark, d).groupBy("model", (F.col("ym") % 12 + 1).cast("int").alias("month")).agg(F.count("*").alias("n"))


@query("ym_duplicates", given("file_catalog") + "select model, variable, start_ym, count(*) n from file_catalog group by 1, 2, 3 having count(*) > 1")
def ym_duplicates(spark, d):
    return views.file_catalog(spark, d).groupBy("model", "variable", "start_ym").agg(F.count("*").alias("n")).where("n > 1")


@query("last_n_months", given("surface_cells") + "select model, ym from (select model, ym, row_number() over (partition by model order by ym desc) k from (select distinct model, ym from surface_cells)) where k <= 24")
def last_n_months(spark, d):
    return months.last(views.model_months(spark, d), 24)


@query("spacing_check", given("surface_cells", m="select distinct model, ym from surface_cells") + "select model, count(*) n, max(s) max_step, count(case when s <> 1 then 1 end) breaks from (select model, ym - lag(ym) over (partition by model order by ym) s from m) group by model")
def spacing_check(spark, d):
    w = Window.partitionBy("model").orderBy("ym")
    t = views.model_months(spark, d).withColumn("s", F.col("ym") - F.lag("ym").over(w))
    return t.groupBy("model").agg(F.count("*").alias("n"), F.max("s").alias("max_step"), F.count_if(F.col("s") != 1).alias("breaks"))


@query("time_index", given("surface_cells") + "select model, ym, cast(row_number() over (partition by model order by ym) - 1 as int) time_index from (select distinct model, ym from surface_cells)")
def time_index(spark, d):
    w = Window.partitionBy("model").orderBy("ym")
    return views.model_months(spark, d).withColumn("time_index", F.row_number().over(w) - 1)

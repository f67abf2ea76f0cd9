"""Checks and resumable runs."""

import pytest
from pyspark.sql import functions as F

from isopycna.functions import geo
from isopycna.operators import checks
from isopycna.plans import runs


def test_checks(spark):
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    models = df([("A",), ("B",)], "model string")
    assert [r.model for r in checks.empty_grids(models, df([("A", 1)], "model string, cell_id long")).collect()] == ["B"]
    units = df([("tos", "A", "degC"), ("tos", "B", "K"), ("sos", "A", "1")], "variable string, model string, units string")
    assert [r.variable for r in checks.mixed_units(units).collect()] == ["tos"]
    faults = {(r.model, r.fault) for r in checks.cohort_faults(models, ["A", "C"], ["B"]).collect()}
    assert faults == {("C", "missing"), ("B", "excluded")}
    cells = df([(1.0, None), (None, None), (1.0, 2.0)], "tos double, rho double")
    assert checks.derived_gaps(cells, ("tos",), "rho").count() == 1
    months = df([("A", 1), ("A", 1), ("A", 2)], "model string, ym int")
    with pytest.raises(checks.CheckFailed, match="twice"):
        checks.none_of(checks.broken_months(months), "months occur twice")
    checks.none_of(checks.broken_months(months.distinct()), "months occur twice")
    assert spark.range(1).select(geo.years_before(F.lit(24000), 20)).first()[0] == 23760


def test_runs_resume_and_keep_errors(spark, tmp_path):
    calls = []

    def make(models):
        calls.append(tuple(models))
        if "bad" in models:
            raise ValueError("no such grid")
        return spark.createDataFrame([(m, 1.0) for m in models], "model string, v double")

    path = f"{tmp_path}/run"
    first = {r.model: (r.status, r.message) for r in runs.run(spark, path, {"a": 1}, ["x", "bad"], make).collect()}
    assert first == {"x": ("done", None), "bad": ("failed", "no such grid")}
    runs.run(spark, path, {"a": 1}, ["x", "y"], make)
    assert calls == [("x", "bad"), ("x",), ("bad",), ("y",)]
    assert runs.fingerprint({"a": 1, "b": 2}) == runs.fingerprint({"b": 2, "a": 1}) != runs.fingerprint({"a": 2})


def test_checked_runs_are_one_pass(spark, tmp_path):
    """A bad model is left out and looked at again; the others are saved in the same pass, once."""
    path = f"{tmp_path}/run"
    rows = [("A", 1, 5.0), ("A", 2, 5.0), ("B", 1, -1.0), ("B", 2, -2.0), ("B", 3, 1.0), ("C", 1, -1.0), ("C", 2, 3.0)]
    table = lambda r: spark.createDataFrame(r, "model string, ym int, v double")
    fault = F.when(F.col("v") < 0, F.concat(F.lit("below 0 in "), F.col("ym").cast("string")))
    run = lambda r, config: {(x.model, x.status, x.message) for x in runs.run_checked(spark, path, config, table(r), fault, 1).collect()}
    held = lambda: sorted(tuple(r) for r in spark.read.parquet(f"{path}/results").select("model", "ym", "v").collect())
    want = {("A", "done", None), ("B", "failed", "2 faults, first: below 0 in 1"), ("C", "done", None)}
    assert run(rows, {"a": 1}) == want
    assert held() == sorted(r for r in rows if r[0] != "B")
    # Only what isn't done is looked at: A and C may change, B is mended.
    mended = [("A", 1, 7.0), ("B", 1, 1.0), ("C", 1, 7.0)]
    assert run(mended, {"a": 1}) == want | {("B", "done", None)}
    assert held() == sorted([r for r in rows if r[0] != "B"] + [("B", 1, 1.0)])
    assert run([], {"a": 1}) == want | {("B", "done", None)}
    # Another configuration starts anew.
    run(mended, {"a": 2})
    assert held() == sorted(mended)
    log = runs.log(spark, path).groupBy("model").count().collect()
    assert {r.model: r["count"] for r in log} == {"A": 2, "B": 3, "C": 2}


def test_arguments():
    assert checks.whole_years(240) == 20
    for wrong in (0, -12, 18, 12.5):
        with pytest.raises(ValueError, match="whole years"):
            checks.whole_years(wrong)
    checks.ordered(a=(0, 1), b=(-1.0, 0.5))
    for low, high in ((1, 1), (2, 1), (float("nan"), 1), (0, float("inf"))):
        with pytest.raises(ValueError, match="must be below"):
            checks.ordered(a=(low, high))

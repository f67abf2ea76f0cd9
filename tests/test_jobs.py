"""The jobs: against SQL, over growing input, stopped half-way, and on odd rows."""

import json
import os
import re
import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import catalogue, common, harvest, transformation

from .compare import duck, same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, name):
    before = spark.conf.getAll
    same(catalogue.QUERIES[name](spark, DIR), duck(DIR), catalogue.ORACLES[name])
    assert {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.")} == {k: v for k, v in before.items() if k.startswith("spark.sql.")}


def test_command_line(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"sections": ["en"]}))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.harvest", DIR, f"{tmp_path}/out", "--config", str(config)], cwd=root, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert re.search(r"jobs.harvest read \d+ pages in 1 batches of", done.stderr) and re.search(r"jobs.harvest wrote \d+ entries", done.stderr)
    assert len(os.listdir(tmp_path / "out")) == 1


def test_unknown_settings_are_refused(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"yeers": 3}')
    with pytest.raises(ValueError, match="yeers"):
        common.settings(str(tmp_path / "c.json"), "transformation.json")
    (tmp_path / "d.json").write_text('{"years": 3}')
    assert common.settings(f"file://{tmp_path}/d.json", "transformation.json", spark)["years"] == 3


# -- harvest --------------------------------------------------------------------------------

CONFIG = common.settings(None, harvest.DEFAULT)


def page(*links):
    return "<html>" + "".join(f'<li><a href="{x}">x</a>' for x in links)


ODD = [
    (1, "http://www.a.org/en/1", page("/x", "/y", "/x", "/y?q=1", "#top", "")),
    (2, "https://A.org:8080/en", page("/x")),
    (2, "https://a.org/fr/?p", page("/x#1")),
    (3, "http://m.b.net", page("/ü", "/日本")),
    (None, "http://b.net/de/1", page("/only null")),
    (None, "http://b.net/de/1", page("/z")),
    (9, "http://b.net/de/1", page("/z")),
    (4, None, page("/lost")),
    (5, "", page("/lost")),
    (6, "no scheme/en/1", page("/lost")),
    (7, "http://c.com/en/1", None),
    (8, "http://c.com/en/1", ""),
    (10, "http://c.com/es/x/y", 'no <a href="/open'),
    (11, "http://d.io/es/1", page(*(f"/{i % 700}" for i in range(20_000)))),
]


def naive(rows):
    """(site, section, entry) to (n_pages, first, last)."""
    out = defaultdict(list)
    for key, url, html in rows:
        at = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:(?:www|m)\.)?([^/?#:]+)", url or "")
        if at:
            section = re.match(r"[^:]+://[^/?#]+/([^/?#]*)", url)
            for link in set(re.findall(r'<a href="([^"?#]*)[^"]*"', html or "")):
                out[at[1].lower(), section[1] if section else "", link].append(key)
    known = lambda keys: [k for k in keys if k is not None]
    return {k: (len(v), min(known(v), default=None), max(known(v), default=None)) for k, v in out.items()}


def held(spark, out, config=CONFIG):
    rows = harvest.catalogue(spark, out, config).collect()
    got = {(r.site, r.section, r.entry): (r.n_pages, r.first_page, r.last_page) for r in rows}
    assert len(got) == len(rows)
    return got, {r.site: r.asDict() for r in rows}


def put(spark, folder, rows):
    spark.createDataFrame(rows, harvest.PAGES).coalesce(1).write.mode("append").parquet(f"{folder}/pages.parquet")


def test_growing_input(spark, tmp_path):
    pages = [tuple(r) for r in spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    cut = len(pages) // 3
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, src, pages[:cut])
    first = harvest.run(spark, src, out, CONFIG)
    assert (first["pages"], first["batches"]) == (cut, 1)
    assert held(spark, out)[0] == naive(pages[:cut])
    put(spark, src, pages[cut:])
    put(spark, src, ODD)
    one_each = CONFIG | {"files_per_batch": 1}
    second = harvest.run(spark, src, out, one_each)
    assert (second["pages"], second["batches"]) == (len(pages) - cut + len(ODD), 2)
    want = naive(pages + ODD)
    assert held(spark, out)[0] == want
    third = harvest.run(spark, src, out, CONFIG)
    assert third == {"pages": 0, "batches": 0, "entries": 0, "sites": 0, "shelves": 0}
    assert held(spark, out)[0] == want


def test_only_touched_shelves_are_summed(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, src, ODD)
    assert harvest.run(spark, src, out, CONFIG)["shelves"] == len({spark.range(1).select(F.substring(F.md5(F.lit(s)), 1, 1)).first()[0] for s in ("a.org", "b.net", "d.io")})
    put(spark, src, [(12, "http://d.io/en/1", page("/new"))])
    second = harvest.run(spark, src, out, CONFIG)
    assert second["shelves"] == 1 and second["pages"] == 1
    assert held(spark, out)[0] == naive(ODD + [(12, "http://d.io/en/1", page("/new"))])


def test_sites(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, src, ODD)
    config = CONFIG | {"sections": ["en", "fr"]}
    harvest.run(spark, src, out, config)
    sites = held(spark, out, config)[1]
    assert {s: (r["has_en"], r["has_fr"], r["complete"]) for s, r in sites.items()} == {"a.org": (1, 1, True), "b.net": (0, 0, False), "d.io": (0, 0, False)}
    assert sites["d.io"]["n_entries"] == 700 and sites["a.org"]["n_entries"] == 3


def test_stopped_anywhere(spark, tmp_path, monkeypatch):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, src, ODD[:6])
    # Batches are taken, but nothing is folded.
    harvest.take(spark, f"{src}/pages.parquet*", harvest.place(out, CONFIG), CONFIG)
    assert held(spark, out)[0] == {}
    put(spark, src, ODD[6:])
    # The catalogue is written, its marks are not.
    real = harvest.saved
    monkeypatch.setattr(harvest, "saved", lambda t, path, by: 1 / 0 if path.endswith("sites") else real(t, path, by))
    with pytest.raises(ZeroDivisionError):
        harvest.run(spark, src, out, CONFIG)
    monkeypatch.setattr(harvest, "saved", real)
    assert harvest.run(spark, src, out, CONFIG)["pages"] == 0
    assert held(spark, out)[0] == naive(ODD)
    # A batch that was written but not committed is taken again under its number.
    commits = [p for p in (tmp_path / "out").glob("*/checkpoint/commits/*1") if not p.name.endswith("crc")]
    assert len(commits) == 1
    for p in (commits[0], commits[0].with_name(".1.crc")):
        p.unlink(missing_ok=True)
    harvest.run(spark, src, out, CONFIG)
    assert held(spark, out)[0] == naive(ODD)


def test_pages_that_list_nothing(spark, tmp_path):
    """A batch of which nothing is left, then one that lists something."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, src, [r for r in ODD if r[0] in (4, 5, 6, 7, 8)])
    assert harvest.run(spark, src, out, CONFIG) == {"pages": 5, "batches": 1, "entries": 0, "sites": 0, "shelves": 0}
    put(spark, src, ODD[:3])
    assert harvest.run(spark, src, out, CONFIG)["pages"] == 3
    assert held(spark, out)[0] == naive(ODD[:3])


def test_no_pages(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [])
    assert harvest.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", CONFIG)["entries"] == 0
    assert held(spark, f"{tmp_path}/out") == ({}, {})


@pytest.mark.parametrize("wrong", [{"digits": 0}, {"sections": []}, {"sections": ["a", "a"]}, {"files_per_batch": 0}])
def test_wrong_harvest_settings(spark, tmp_path, wrong):
    with pytest.raises(ValueError):
        harvest.run(spark, DIR, str(tmp_path), CONFIG | wrong)


# -- transformation -------------------------------------------------------------------------

SETTINGS = common.settings(None, transformation.DEFAULT)


def copy(spark, folder, where):
    for name in ("part", "orders", "lineitem"):
        t = spark.read.parquet(f"{DIR}/{name}.parquet")
        (t.where(where) if name == "lineitem" else t).write.parquet(f"{folder}/{name}.parquet")
    return folder


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_models_are_replaced_as_a_whole(spark, tmp_path):
    out = f"{tmp_path}/out"
    transformation.run(spark, DIR, out, SETTINGS)
    before = [rows_of(t) for t in transformation.tables(spark, out, SETTINGS)]
    some = copy(spark, f"{tmp_path}/in", "l_suppkey % 8 < 3 and l_shipdate < '1996-01-01'")
    wrote = transformation.run(spark, some, out, SETTINGS)
    assert wrote["summary"] == 3
    monthly, summary = transformation.tables(spark, out, SETTINGS)
    assert summary.count() == 8
    assert monthly.where("model < 'M3'").agg(F.max("ym")).first()[0] < 1996 * 12 <= monthly.where("model >= 'M3'").agg(F.max("ym")).first()[0]
    transformation.run(spark, DIR, out, SETTINGS)
    again = [rows_of(t) for t in transformation.tables(spark, out, SETTINGS)]
    assert [len(x) for x in again] == [len(x) for x in before]
    # Other settings have a place of their own.
    assert transformation.tables(spark, out, SETTINGS | {"years": 1})[0].count() == 0


def test_window_is_the_latest_run_of_common_months(spark):
    kind = "model string, ym int, tos double, sos double, hfds double, wfo double"
    full = [("A", m, 1.0, 1.0, 1.0, 1.0) for m in (*range(10, 15), *range(20, 50), 60)]
    lacking = [("B", m, 1.0, 1.0, 1.0, 1.0) for m in range(3)] + [("B", 3, None, 1.0, 1.0, 1.0), ("B", 3, None, 2.0, 1.0, 1.0)] + [("C", 1, 1.0, None, 1.0, 1.0)]
    got = defaultdict(list)
    for r in transformation.window(spark.createDataFrame(full[:-1] + lacking, kind), 1).collect():
        got[r.model, r.short].append(r.ym)
    assert {k: sorted(v) for k, v in got.items()} == {("A", False): list(range(38, 50)), ("B", True): [0, 1, 2]}


def test_faults(spark):
    months = spark.createDataFrame([("A", 1, False), ("B", 1, True), ("C", 1, False), ("D", 1, False)], "model string, ym int, short boolean")
    monthly = spark.createDataFrame([(m, 1, k, 1020.0 + k, -float(k), 0.0 if m == "D" else 1.0) for m in "ABCD" for k in range(3)], "model string, ym int, bin_idx int, rho double, fgen double, area_sum double")
    strength = spark.createDataFrame([("A", 5.0), ("B", 5.0)], "model string, strength double")
    models = spark.createDataFrame([(m,) for m in "ABCDE"], "model string")
    got = {r.model: r for r in transformation.summaries(monthly, months, strength, models).collect()}
    assert {m: r.fault for m, r in got.items()} == {"A": None, "B": "short window", "C": "no overturning", "D": "no cell in any class", "E": "no common month"}
    assert (got["A"].fgen_min, got["A"].rho_at_min, got["A"].negative_integral, got["E"].n_months) == (-2.0, 1022.0, 2.0, 0)


def test_empty_tables(spark, tmp_path):
    src = copy(spark, f"{tmp_path}/in", "false")
    assert transformation.run(spark, src, f"{tmp_path}/out", SETTINGS) == {"cells": 0, "monthly": 0, "summary": 0}
    assert [t.count() for t in transformation.tables(spark, f"{tmp_path}/out", SETTINGS)] == [0, 0]


@pytest.mark.parametrize("wrong", [{"years": 0}, {"years": 1.5}, {"west": 70}, {"strength_north": -1}, {"rho_step": 0}, {"rho_max": 1000}])
def test_wrong_settings(spark, tmp_path, wrong):
    with pytest.raises(ValueError):
        transformation.run(spark, DIR, str(tmp_path), SETTINGS | wrong)


def test_jobs_stand_alone():
    """Jobs import nothing from the corpus side."""
    done = subprocess.run([sys.executable, "-c", "import sys, jobs.catalogue; print([m for m in sys.modules if 'llm' in m or m == 'corpus_pipeline'])"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.stdout.strip() == "[]", done.stderr

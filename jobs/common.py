"""What the jobs share: settings, counted writes and the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from isopycna.session import SETTINGS
from isopycna.sources import results


def settings(path: str | None, default: str, spark: SparkSession | None = None) -> dict:
    """The settings of a job: those of ``path``, a JSON file anywhere Spark can read, over those that ship with it."""
    out = json.loads((Path(__file__).parent / default).read_text())
    if path:
        text = spark.read.text(path, wholetext=True).first().value if "://" in path else Path(path).read_text()
        given = json.loads(text)
        unknown = set(given) - set(out)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= given
    return out


def saved(table: DataFrame, path: str, by: tuple[str, ...]) -> int:
    """Replace the partitions of ``by`` that ``table`` has, and give the number of rows written, counted as they pass.

    Rows are dealt by partition, large ones over several tasks, so that neither many small files nor a task with a large partition come of it.
    """
    seen = Observation()
    results.save(table.hint("rebalance", *by).observe(seen, F.count(F.lit(1)).alias("rows")), path, by)
    return seen.get["rows"]


def rows_of(spark: SparkSession, source: str, *names: str) -> str:
    """How many rows the input tables have, from what their files say of themselves."""
    return ", ".join(f"{spark.read.parquet(f'{source}/{n}.parquet').count()} rows of {n}" for n in names)


def command(run: Callable[[SparkSession, str, str, dict], dict], default: str, about: str) -> None:
    """The command line of a job; only here is a session made and ended."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("input", help="folder of the input tables")
    p.add_argument("output", help="folder of the output; with the same one a run goes on where the last has ended")
    p.add_argument("--config", help=f"settings that differ from {default}")
    args = p.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName(Path(default).stem)
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        run(spark, args.input, args.output, settings(args.config, default, spark))
    finally:
        spark.stop()

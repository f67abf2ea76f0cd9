"""Runs that can be stopped and resumed: a fingerprint, a log, and errors kept by model."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import results

LOG = "fingerprint string, model string, status string, seconds double, message string"


def fingerprint(config: dict) -> str:
    """Digest of a configuration, independent of the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def log(spark: SparkSession, path: str) -> DataFrame:
    return results.load(spark, f"{path}/log", spark.createDataFrame([], LOG).schema)


def run(spark: SparkSession, path: str, config: dict, models: list[str], make: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Results of ``make`` for the models that ``path`` lacks under this configuration.

    All that are left are one job.  Only if it fails are they run one by one, so
    that a bad model costs itself alone; its error is kept in the log.
    """
    print_ = fingerprint(config)
    done = {r.model for r in log(spark, path).where(f"fingerprint = '{print_}' and status = 'done'").select("model").collect()}
    left = [m for m in models if m not in done]
    rows = []
    for group in [left] if left else []:
        began = time.perf_counter()
        try:
            results.save(make(group), f"{path}/results")
            rows += [(print_, m, "done", (time.perf_counter() - began) / len(group), None) for m in group]
        except Exception:
            for m in group:
                began = time.perf_counter()
                try:
                    results.save(make([m]), f"{path}/results")
                    rows.append((print_, m, "done", time.perf_counter() - began, None))
                except Exception as e:
                    rows.append((print_, m, "failed", time.perf_counter() - began, str(e)[:500]))
    if rows:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    return log(spark, path)


def run_checked(spark: SparkSession, path: str, config: dict, rows: DataFrame, fault: Column, tolerated: int = 0) -> DataFrame:
    """Results of all models of ``rows`` that ``path`` lacks under this configuration, from one pass over them.

    ``fault`` is what is wrong with a row, or NULL.  A model with more than ``tolerated`` such rows fails, with their number
    and the first of them as its message, and its rows are left out; the others are saved as if it weren't there, so
    a bad model costs no second run.  Failed models are looked at again by the next run.  The log has of each model
    its share of the run's seconds, by its share of the rows.  A row per model is all that is gathered.
    """
    print_ = fingerprint(config)
    done = log(spark, path).where(f"fingerprint = '{print_}' and status = 'done'").select("model").distinct()
    began = time.perf_counter()
    # Kept beside the results: the pass is made once, and what failed can be looked at.
    results.replace(results.remaining(rows.withColumn("fault", fault), done), f"{path}/checked")
    seen = results.load(spark, f"{path}/checked", rows.withColumn("fault", F.lit("")).schema)
    each = seen.groupBy("model").agg(F.count("*").alias("n"), F.count("fault").alias("faults"), F.min("fault").alias("first"))
    failed = each.where(F.col("faults") > tolerated)
    results.save(seen.join(failed.select("model"), "model", "left_anti").select(*rows.columns), f"{path}/results")
    seconds = time.perf_counter() - began
    total = each.agg(F.sum("n").alias("all"))
    bad = F.col("faults") > tolerated
    entries = each.crossJoin(F.broadcast(total)).select(
        F.lit(print_).alias("fingerprint"), "model", F.when(bad, "failed").otherwise("done").alias("status"), (F.lit(seconds) * F.col("n") / F.col("all")).alias("seconds"),
        F.when(bad, F.concat(F.col("faults").cast("string"), F.lit(" faults, first: "), F.col("first"))).alias("message"),
    )
    entries.coalesce(1).write.mode("append").parquet(f"{path}/log")
    return log(spark, path)


def save_document(spark: SparkSession, path: str, config: dict, rows: DataFrame) -> None:
    """The checkpoint of a run: what is known of each model, under the fingerprint of its configuration, replaced as a whole."""
    results.replace(rows, f"{path}/checkpoint-{fingerprint(config)}")


def load_document(spark: SparkSession, path: str, config: dict, schema: StructType) -> DataFrame:
    """The checkpoint of this configuration; no rows where there is none."""
    return results.load(spark, f"{path}/checkpoint-{fingerprint(config)}", schema)

"""Density-class sums over monthly files as they arrive.

The state holds one row of sums per (model, month, class); months come as whole
files, so there is no event time to wait for, and a file that is added updates
only its own months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import bins


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def class_sums(cells: DataFrame, classes: bins.Classes) -> DataFrame:
    """Sums by model, month and class of a stream of derived cells (model, ym, rho, fsurf, heat, fw, area)."""
    from pyspark.sql import functions as F

    return bins.class_sums(cells, ["model", "ym"], classes.index(F.col("rho")), classes.step * 1e6)


def start(sums: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Updates of ``sums`` into the table ``name`` in memory; for other sinks use ``foreachBatch``."""
    return sums.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()

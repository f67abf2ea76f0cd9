"""A folder that driver and executors share, for tables that live as long as a run."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset and all is one process (tests), under a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="isopycna-")
    return f"{named.rstrip('/')}/isopycna/{uuid.uuid4().hex}"

"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh path under spark.checkpoint.dir; where that is unset (as in tests), a local one is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        top = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"

"""Places in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (as in tests), a local one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        top = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """DataFrame.checkpoint() needs the folder on the context too."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared one."""
    return f"{checkpoint_root(spark)}/{what}-{uuid.uuid4().hex}"

"""Deletes as plans: rows that say what would be done; nothing here removes a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def delete_plan(gone: DataFrame, source: str, dest: str, archive: str = ".archive") -> DataFrame:
    """(path, action, target): a mirror deletes, an archive keeps the relative path below its folder; unknown modes archive."""
    mirror = F.col("mode") == "mirror"
    target = P.map_path(F.col("path"), source, f"{dest.rstrip('/')}/{archive}")
    return gone.select("path", F.when(mirror, "delete").otherwise("archive").alias("action"), F.when(~mirror, target).alias("target"))

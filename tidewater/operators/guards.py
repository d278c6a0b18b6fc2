"""Preconditions on manifests and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_parent(manifests: DataFrame) -> DataFrame:
    """The generation before, where its length, chunk size, chunker and grid are the same."""
    same = ["length", "chunk_mib", "chunker", "grid"]
    p = manifests.select((F.col("generation") + 1).alias("generation"), F.col("generation").alias("parent"), *same)
    return manifests.select("generation", *same).join(p, ["generation", *same]).select("generation", "parent")

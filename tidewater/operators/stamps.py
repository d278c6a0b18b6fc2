"""Small keyed tables: job stamps and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def keyed_replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, value) with the newest (largest seq) of the new rows in place of the old."""
    last = new.groupBy("name").agg(F.max_by("value", "seq").alias("new_value"))
    return old.join(last, "name", "full").select("name", F.coalesce("new_value", "value").alias("value"))


def counted(df: DataFrame, **metrics: Column) -> DataFrame:
    """One row of metrics that are gathered by observation while the rows pass, without a query of their own."""
    seen = Observation()
    df.observe(seen, *(c.alias(name) for name, c in metrics.items())).write.format("noop").mode("overwrite").save()
    got = seen.get
    return df.sparkSession.createDataFrame([tuple(got[name] for name in metrics)], ", ".join(f"{name} long" for name in metrics))

"""Listings for people and for JSON consumers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def first_n(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The n smallest values of each group, joined, and how many more there are.  No group is gathered whole."""
    ranked = df.select(group, value, F.row_number().over(Window.partitionBy(group).orderBy(value)).alias("rn"))
    firsts = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.when(F.col("rn") <= n, F.col(value)))).alias("l"), F.count("*").alias("n"))
    text = F.array_join(F.transform("l", lambda x: x.cast("string")), ", ")
    return firsts.select(group, F.when(F.col("n") > n, F.concat(text, F.lit(" (+"), (F.col("n") - n).cast("string"), F.lit(" more)"))).otherwise(text).alias("sample"))


def versions_json(versions: DataFrame) -> DataFrame:
    """One JSON object a version, for a JSON lines sink or an array put together by the consumer."""
    return versions.select("id", F.to_json(F.struct("source", "file", "timestamp", "size", "pinned")).alias("json"))


def global_index(df: DataFrame, order: str, partitions: int) -> DataFrame:
    """Rows numbered from 0 in the order of a column, without one task that sees them all.

    Rows are dealt out by ranges and sorted inside them; each range starts where the ranges before it
    end, which takes one bounded row a range.  Spark samples for the bounds of ranges anew in each plan, so
    the dealt rows are written in the shared folder once, and counted and numbered from there.
    """
    path = shared_folder(df.sparkSession, "ranges")
    df.repartitionByRange(partitions, order).withColumn("range", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    starts = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return dealt.withColumn("place", place).join(F.broadcast(starts), "range").withColumn("index", (F.col("start") + F.col("place")).cast("long")).drop("range", "place", "start")


def prefix_sum(df: DataFrame, bucket: Column, order: list[str], value: str, name: str, *, inclusive: bool = True) -> DataFrame:
    """Sums of a column over all rows up to each one in an order that buckets follow, without one task that sees them all.

    Buckets are a function of the row, as spans of the order's first column; each starts at the sum of
    those before it, which takes one row a bucket.
    """
    d = df.withColumn("_bucket", bucket)
    per = d.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    starts = per.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return d.withColumn("_run", F.coalesce(within, F.lit(0))).join(starts, "_bucket").withColumn(name, F.col("_start") + F.col("_run")).drop("_bucket", "_run", "_start")

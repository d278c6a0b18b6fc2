"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, *, per_class: dict[int, int], key: str = "doc_id", text: str = "text", more: list[Column] = ()) -> DataFrame:
    """(key, text, more, label, fold 0-2) of at most so many documents of each label, those of the smallest id hashes.

    Ids are chosen from the labels alone, so the join that fetches texts has a side of a bounded size.
    A document with several labels takes the largest; null labels and ids don't count.  The sample is
    written in the shared folder, to be read several times.
    """
    spark = docs.sparkSession
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.max(label).cast("int").alias("label"))
    one = one.where(~held_out(F.col("key")))
    parts = [one.where(F.col("label") == value).orderBy(F.xxhash64("key"), "key").limit(most) for value, most in per_class.items()]
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *more).join(F.broadcast(ids), "key")
    path = shared_dir(spark, f"sample-{label}")
    rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(3)).cast("int")).write.parquet(path)
    return spark.read.parquet(path)

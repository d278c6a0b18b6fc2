"""Manifest and layout documents: signed JSON, one a line, with a list of chunks or partitions; and back to one row an element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hmac_sha256

MANIFEST = "generation BIGINT, name STRING, created STRING, length BIGINT, chunk_mib INT, chunker STRING, parent BIGINT, prev_digest STRING, chunks ARRAY<STRUCT<idx: BIGINT, digest: BIGINT, size: BIGINT, is_hole: BOOLEAN, base: BIGINT>>"
LAYOUT = "schema_version INT, generation BIGINT, disk BIGINT, partitions ARRAY<STRUCT<number: BIGINT, offset: BIGINT>>"
#: Layouts of a newer schema are refused, never migrated: extents could be misplaced.
LAYOUT_VERSION = 1


def _body(columns: list[str]) -> Column:
    """What is signed: the document without its signature."""
    return F.to_json(F.struct(*columns))


def save(documents: DataFrame, path: str, key: str) -> None:
    """Documents with their signatures, as JSON lines."""
    signed = documents.select("*", hmac_sha256(F.lit(key), _body(documents.columns)).alias("hmac"))
    signed.write.mode("errorifexists").json(path)


def load(spark: SparkSession, path: str, schema: str, key: str, version: int | None = None) -> DataFrame:
    """Documents whose signatures hold; a malformed, altered or newer one stops the read."""
    rows = spark.read.schema(schema + ", hmac STRING").option("mode", "FAILFAST").json(path)
    names = [c for c in rows.columns if c != "hmac"]
    bad = F.coalesce(F.col("hmac"), F.lit("")) != hmac_sha256(F.lit(key), _body(names))
    problem = F.when(bad, F.concat(F.lit("failed verification: "), F.substring(_body(names), 1, 80)))
    if version is not None:
        problem = problem.when(F.col("schema_version") > version, F.concat(F.lit("unsupported schema version "), F.col("schema_version").cast("string")))
    checked = F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(F.lit(True))
    return rows.where(checked).select(*names)


def nest(entries: DataFrame) -> DataFrame:
    """A manifest's list is bounded by its volume."""
    return entries.groupBy("generation").agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "size", "is_hole", "base"))).alias("chunks"))


def explode_chunks(manifests: DataFrame) -> DataFrame:
    return manifests.select("generation", F.inline("chunks"))

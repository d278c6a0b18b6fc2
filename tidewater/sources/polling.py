"""Polling: two inventories of the same tree, compared."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..operators.sync import snapshot_diff

#: Seconds between polls, at least.
LEAST_INTERVAL = 10
#: Ticks at 1970-01-01.
EPOCH = 621355968000000000


def scan(spark: SparkSession, path: str, partitions: int = 64) -> DataFrame:
    """A tree as an inventory (path, mtime, size), empty files too; file contents are never read.

    The driver lists the top folder only; executors list what lies below each of its folders.  The
    path is a URI that pyarrow knows.
    """
    store, top = fs.FileSystem.from_uri(path)
    first = store.get_file_info(fs.FileSelector(top))
    rows = [(i.path, i.type == fs.FileType.Directory, EPOCH + i.mtime_ns // 100 if i.mtime_ns else None, i.size) for i in first]

    def below(batches):
        mine, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, folder, mtime, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [(name, mtime, size)] if not folder else [(i.path, EPOCH + i.mtime_ns // 100, i.size) for i in mine.get_file_info(fs.FileSelector(name, recursive=True)) if i.type == fs.FileType.File]
                columns = list(zip(*found, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "mtime", "size"])

    entries = spark.createDataFrame(rows, "path string, folder boolean, mtime long, size long").repartition(partitions, "path")
    return entries.mapInArrow(below, "path string, mtime long, size long")


def poll(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Changes since the previous poll; the first one only sets the baseline."""
    return snapshot_diff(current, previous)

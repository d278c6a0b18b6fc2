"""Change feeds: debouncing, pairing, journal translation, batching; batch and streaming forms share their expressions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.present import prefix_sum

# Reason bits of a change journal (fixed values).
OVERWRITE, EXTEND, CREATE, DELETE, RENAME_OLD, RENAME_NEW, CLOSE = 0x1, 0x2, 0x100, 0x200, 0x1000, 0x2000, 0x80000000
WATCH_MASK = 0x00FFFF77
DIRECTORY = 0x10


def debounce(events: DataFrame, key: str, gap: str) -> DataFrame:
    """The last event of each session of a key: every event pushes the deadline out by the gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max_by("change_type", F.struct("ts", "event_id")).alias("change_type"))
    return s.select(key, F.unix_micros("w.end").alias("due_us"), "events", "change_type")


def last_event_wins(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by("change_type", F.struct("ts", "event_id")).alias("change_type"))


def reason_type(reason: Column, attributes: Column) -> Column:
    """Delete before rename-old, rename-new, create, modify; a directory's modification is dropped (null)."""
    has = lambda bit: reason.bitwiseAND(F.lit(bit).cast("long")) != 0
    is_dir = attributes.bitwiseAND(F.lit(DIRECTORY).cast("long")) != 0
    return F.when(has(DELETE), "Deleted").when(has(RENAME_OLD), "RenameOld").when(has(RENAME_NEW), "RenameNew").when(has(CREATE), "Created").when(has(WATCH_MASK) & ~is_dir, "Modified")


def journal_read(records: DataFrame, cursor: int, mask: int = WATCH_MASK) -> DataFrame:
    """Records after the cursor whose reasons are watched."""
    return records.where((F.col("usn") > cursor) & (F.col("reason").bitwiseAND(F.lit(mask).cast("long")) != 0))


def rename_pairs(records: DataFrame) -> DataFrame:
    """Old and new names of a file joined to Renamed, in journal order.

    An old name is kept until the file's next new name, which pairs with the latest one, or until the
    file is deleted; on its own it gives nothing.  A new name without an old one is Created; after a
    rename, another new name or a creation repeats it and is silent.  A deletion starts the file afresh.
    """
    kind, is_new = F.col("kind"), (F.col("kind") == "RenameNew").cast("int")
    before = lambda *by: Window.partitionBy("file_ref", *by).orderBy("usn").rowsBetween(Window.unboundedPreceding, -1)
    r = records.select("file_ref", "usn", "name", reason_type(F.col("reason"), F.col("attributes")).alias("kind")).where("kind IS NOT NULL")
    r = r.withColumn("life", F.coalesce(F.sum((kind == "Deleted").cast("int")).over(before()), F.lit(0)))
    r = r.withColumn("turn", F.coalesce(F.sum(is_new).over(before("life")), F.lit(0)))
    r = r.withColumn("old", F.when(kind == "RenameNew", F.last(F.when(kind == "RenameOld", F.col("name")), True).over(before("life", "turn"))))
    r = r.withColumn("renamed", F.coalesce(F.max(F.col("old").isNotNull()).over(before("life")), F.lit(False)))
    created = F.when(~F.col("renamed"), "Created")
    out = F.when(kind == "RenameNew", F.when(F.col("old").isNotNull(), "Renamed").otherwise(created)).when(kind == "Created", created).when(kind != "RenameOld", kind)
    return r.select("file_ref", "usn", "name", F.col("old").alias("old_name"), out.alias("change_type")).where("change_type IS NOT NULL")


def sweep(expired: DataFrame, existing: DataFrame, parents: DataFrame) -> DataFrame:
    """An expired debounce looked at again: the file exists, only its parent does, or neither."""
    e = existing.select("path", F.lit(True).alias("there"))
    p = parents.select("parent", F.lit(True).alias("above"))
    kind = F.when(F.col("there"), "Modified").when(F.col("above"), "Deleted")
    return expired.join(e, "path", "left").join(p, "parent", "left").select("path", kind.alias("change_type")).where("change_type IS NOT NULL")


DAY = 86_400_000_000


def delete_batches(events: DataFrame) -> DataFrame:
    """Runs of consecutive deletes of the whole feed, in event order: any other event flushes the batch."""
    e = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("other", (F.col("change_type") != "Deleted").cast("int"))
    e = prefix_sum(e, F.floor(F.col("us") / DAY), ["us", "event_id"], "other", "run")
    return e.where("other = 0").groupBy("run").agg(F.min(F.struct("us", "event_id")).alias("first"), F.count("*").alias("files"), F.count_distinct("path").alias("paths")).select(F.col("first.event_id").alias("first_event"), "files", "paths")


def checkpoint_points(records: DataFrame, seconds: int = 30) -> DataFrame:
    """The last journal position of each span of so many seconds: what a restart would go on from."""
    return records.groupBy((F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))).cast("long").alias("span")).agg(F.max("event_id").alias("cursor"))


def gap_scans(requests: DataFrame, seconds: int) -> DataFrame:
    """Scan requests that lie close together coalesce into one scan; days are worked on apart and joined at their ends."""
    r = requests.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").withColumn("day", F.floor(F.col("us") / DAY))
    ends = r.groupBy("day").agg(F.max("us").alias("end"))
    ends = ends.select("day", F.lag("end").over(Window.orderBy("day")).alias("last"))
    r = r.join(ends, "day").withColumn("before", F.coalesce(F.lag("us").over(Window.partitionBy("day").orderBy("us", "event_id")), "last"))
    r = r.withColumn("new", F.coalesce((F.col("us") - F.col("before") > seconds * 1_000_000).cast("int"), F.lit(1)))
    r = prefix_sum(r, F.col("day"), ["us", "event_id"], "new", "scan")
    return r.groupBy("scan").agg(F.min("us").alias("start_us"), F.count("*").alias("requests")).drop("scan")


# streaming forms


def debounce_stream(events: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """The same sessions over a stream; a session comes out once the watermark has passed its end.

    Nothing is ever late for a feed that replays its journal, so the watermark should be generous.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = e.groupBy(F.col(key), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.max_by("change_type", F.struct("ts", "event_id")).alias("change_type"))
    return s.select(key, F.unix_micros("w.end").alias("due_us"), "events", "change_type")


def spike_stream(events: DataFrame, key: str, seconds: int, files: int) -> DataFrame:
    """Sliding count by key with a latch: once tripped a key is held (a row per event that comes while held)."""
    import pandas as pd

    span = seconds * 1_000_000

    def step(name, frames: Iterator[pd.DataFrame], state):
        recent, held = list(state.get[0]) if state.exists else [], state.get[1] if state.exists else False
        out = []
        frame = pd.concat(list(frames)).sort_values(["us", "event_id"])
        for us, event in zip(frame["us"], frame["event_id"], strict=True):
            recent = [x for x in recent if us - x <= span] + [int(us)]
            held = held or len(recent) >= files
            if held:
                out.append((str(name[0]), int(event)))
        state.update((recent, held))
        yield pd.DataFrame(out, columns=[key, "event_id"])

    e = events.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.groupBy(key).applyInPandasWithState(step, f"{key} string, event_id long", "recent array<long>, held boolean", "append", "NoTimeout")


def run_available(stream: DataFrame, folder: str, *, drain: bool = False) -> DataFrame:
    """A stream run over all that is there, appended to Parquet in a shared folder; sources written in Python are drained, as they have no such trigger."""
    w = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/log").option("path", f"{folder}/rows")
    if drain:
        q = w.start()
        q.processAllAvailable()
        q.stop()
    else:
        w.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")

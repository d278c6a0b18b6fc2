"""Decision rules over rows: capture policies, gates, exclusions, samples, prunes, and parsers of tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .present import prefix_sum

#: Attribute bits of files that are only placeholders (fixed values): offline, recall on open, recall on access.
PLACEHOLDER = 0x1000 | 0x40000 | 0x400000


def capture_policy(filesystem: Column, attributes: Column, name: Column) -> Column:
    """skip for placeholders, keep for the log that may never be excluded, full for ReFS, else incremental."""
    hidden = attributes.bitwiseAND(F.lit(PLACEHOLDER).cast("long")) != 0
    return F.when(F.lower(name) == "$logfile", "keep").when(hidden, "skip").when(F.lower(filesystem) == "refs", "full").otherwise("incremental")


def health(fault: Column, pending: Column, idle: Column, stall: int) -> Column:
    return F.when(fault, "fault").when((pending > 0) & (idle > stall), "stalled").otherwise("ok")


def sentinel(digest: Column) -> Column:
    """A live record's digest has 64 hex digits; anything else marks it dead or empty."""
    return F.when(F.length(digest) == 64, "live").when(digest == "", "empty").otherwise("dead")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merge_exclusions(config: DataFrame, extra: DataFrame, never: tuple[str, ...] = ("$logfile",)) -> DataFrame:
    """Names of both lists, the first spelling of each (ignoring case), without those that can't be excluded."""
    every = config.select("name", F.lit(0).alias("side"), "pos").unionByName(extra.select("name", F.lit(1).alias("side"), "pos"))
    return every.withColumn("key", F.lower("name")).where(~F.col("key").isin(*never)).groupBy("key").agg(F.min_by("name", F.struct("side", "pos")).alias("name")).select("name")


def exclusions_changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two name sets differ, whatever their order and case."""
    x, y = (d.select(F.lower("name").alias("k")).distinct() for d in (a, b))
    return x.withColumn("l", F.lit(1)).join(y.withColumn("r", F.lit(1)), "k", "full").agg(F.coalesce(F.bool_or(F.col("l").isNull() | F.col("r").isNull()), F.lit(False)).alias("changed"))


def select_partitions(known: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested partitions that exist, those a layout skips (taken along), and requests for unknown ones."""
    r = requested.select("number", F.lit(True).alias("asked")).distinct()
    k = known.select("number", "skipped", F.lit(True).alias("there"))
    kind = F.when(F.col("there").isNull(), "unknown").when(F.col("skipped"), "auto").when(F.col("asked"), "selected")
    return k.join(r, "number", "full").select("number", kind.alias("kind")).where("kind IS NOT NULL")


def record_gate(parent: DataFrame, current: DataFrame, masked: DataFrame) -> DataFrame:
    """Records (no, digest) that keep a capture from being skipped: live in both and different, or live beyond the parent's count; masked ones don't count."""
    last = parent.agg(F.coalesce(F.max("no"), F.lit(-1)).alias("last"))
    p = parent.select("no", F.col("digest").alias("was"))
    both = current.join(p, "no", "left").crossJoin(F.broadcast(last))
    live = F.length("digest") == 64
    changed = (live & (F.length("was") == 64) & (F.col("digest") != F.col("was"))) | (live & (F.col("no") > F.col("last")))
    return both.where(changed).join(masked.select("no"), "no", "left_anti").select("no")


def _le(n: Column, size: int) -> Column:
    """A number's bytes in hex, the smallest first."""
    big = F.lpad(F.hex(n), 2 * size, "0")
    return F.concat(*(F.substring(big, 2 * k - 1, 2) for k in range(size, 0, -1)))


def band_digests(records: DataFrame, size: int) -> DataFrame:
    """A digest for each band of ``size`` records (no, raw): of their bytes in order, each with its length in four bytes before it."""
    part = F.concat(_le(F.octet_length("raw"), 4), F.hex("raw"))
    b = records.groupBy(F.floor(F.col("no") / size).cast("long").alias("band")).agg(F.array_sort(F.collect_list(F.struct("no", part.alias("part")))).alias("r"))
    return b.select("band", F.sha2(F.unhex(F.array_join(F.col("r.part"), "")), 256).alias("digest"))


def layout_fingerprint(runs: DataFrame) -> DataFrame:
    """Of each volume's runs in order, start and count in eight bytes each."""
    part = F.concat(_le(F.col("start").cast("long"), 8), _le(F.col("count").cast("long"), 8))
    g = runs.groupBy("vol").agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))).alias("r"))
    return g.select("vol", F.sha2(F.unhex(F.array_join(F.col("r.part"), "")), 256).alias("fingerprint"))


def random_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash of their path."""
    return df.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(n)


def prune_oldest(entries: DataFrame, budget: int, span: int = 4096) -> DataFrame:
    """The shortest run of oldest generations whose removal brings the store within its budget, never the newest one.

    A generation frees the digests that no later one holds.  Sums run by spans of generations, so that
    no task sees all of them.
    """
    sizes = entries.where("NOT is_hole").groupBy("digest").agg(F.max("size").alias("size"), F.max("generation").alias("generation"))
    freed = sizes.groupBy("generation").agg(F.sum("size").alias("freed"))
    g = entries.select("generation").distinct().join(freed, "generation", "left").withColumn("freed", F.coalesce("freed", F.lit(0)).cast("long"))
    g = prefix_sum(g, F.floor(F.col("generation") / span), ["generation"], "freed", "before", inclusive=False)
    total = g.agg(F.sum("freed").alias("total"), F.max("generation").alias("newest"))
    return g.crossJoin(F.broadcast(total)).where((F.col("total") - F.col("before") > budget) & (F.col("generation") < F.col("newest"))).select("generation")


def vcn_to_lcn(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Clusters of a file (file, vcn) on the volume, by runs (file, seq, lcn, count); sparse runs (lcn < 0) give null.

    Runs and questions stand in one order, and the last run that starts at or before a cluster may hold it.
    """
    w = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    r = runs.withColumn("at", F.coalesce(F.sum("count").over(w), F.lit(0))).select("file", "at", F.struct(F.col("at").alias("first"), "count", "lcn").alias("run"))
    asked = wanted.select("file", F.col("vcn").alias("at"), F.lit(None).cast(r.schema["run"].dataType).alias("run"))
    order = Window.partitionBy("file").orderBy("at", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    hit = r.unionByName(asked).withColumn("held", F.last("run", True).over(order)).where(F.col("run").isNull() & (F.col("at") < F.col("held.first") + F.col("held.count")))
    return hit.select("file", F.col("at").alias("vcn"), F.when(F.col("held.lcn") >= 0, F.col("held.lcn") + F.col("at") - F.col("held.first")).alias("lcn"))


def crash_recovery(temps: DataFrame, source: DataFrame, dest: DataFrame) -> DataFrame:
    """recover a temporary copy if its destination is missing and it matches the source or the source is unknown; delete it otherwise."""
    s = source.select("rel", F.col("size").alias("s_size"), F.col("hash").alias("s_hash"))
    d = dest.select("rel", F.lit(True).alias("there"))
    ok = F.col("there").isNull() & (F.col("s_size").isNull() | ((F.col("size") == F.col("s_size")) & (F.col("hash") == F.col("s_hash"))))
    return temps.join(s, "rel", "left").join(d, "rel", "left").select("rel", F.when(ok, "recover").otherwise("delete").alias("action"))


def key_value_lines(df: DataFrame, text: str) -> DataFrame:
    """(id, line, key, value) of "key : value" lines of a tool's output."""
    lines = df.select("id", F.posexplode(F.split(text, "\r?\n")).alias("line", "l"))
    shape = r"^\s*([^:]+?)\s*:\s*(.*?)\s*$"
    return lines.where(F.col("l").rlike(shape)).select("id", F.col("line").cast("long").alias("line"), F.regexp_extract("l", shape, 1).alias("key"), F.regexp_extract("l", shape, 2).alias("value"))


def adopt_batches(rows: DataFrame) -> DataFrame:
    """Of each path in old batch files, the one with the smallest file name."""
    return rows.groupBy("path").agg(F.min_by("clock", "file").alias("clock"), F.min("file").alias("file"))


ROTATION = "SchemaVersion int, Drives array<struct<Id: string, Label: string, LastSeenUtc: string, LastBackupUtc: string>>"


def rotation_state(files: DataFrame, key: str, json: str, version: int = 1) -> DataFrame:
    """(key, id, label, last_backup) of the drives in each store's rotation file.

    No file is a state without drives; text that is no JSON, or of a newer schema, is an error.
    """
    state = F.from_json(json, ROTATION)
    s = files.where(F.col(json).isNotNull()).select(key, F.col(json).alias("raw"), state.alias("state"))
    bad = F.col("state").isNull() | (F.col("state.SchemaVersion").isNull() & F.col("state.Drives").isNull())
    newer = F.coalesce(F.col("state.SchemaVersion"), F.lit(1)) > version
    drives = F.when(bad, F.raise_error(F.concat(F.lit("rotation state is not valid JSON: "), F.col("raw")))).when(newer, F.raise_error(F.concat(F.lit("rotation state has schema version "), F.col("state.SchemaVersion").cast("string")))).otherwise(F.col("state.Drives"))
    d = s.select(key, F.explode(drives).alias("d"))
    return d.select(key, F.col("d.Id").alias("id"), F.col("d.Label").alias("label"), F.try_to_timestamp(F.regexp_replace(F.nullif("d.LastBackupUtc", F.lit("")), "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("last_backup"))

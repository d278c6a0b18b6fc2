"""Comparing inventories, deciding actions, and keeping the state table.

Every operator is a pure function of DataFrames; "now" and thresholds are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P


def snapshot_diff(current: DataFrame, previous: DataFrame | None) -> DataFrame:
    """Created, Modified and Deleted paths between two inventories; without a previous one, the first poll is a silent baseline."""
    if previous is None:
        return current.where("false").select("path", F.lit("").alias("change_type"))
    c = current.select("path", F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"))
    p = previous.select("path", F.col("size").alias("p_size"), F.col("mtime").alias("p_mtime"))
    kind = F.when(F.col("p_mtime").isNull(), "Created").when(F.col("c_mtime").isNull(), "Deleted").when((F.col("c_size") != F.col("p_size")) | (F.col("c_mtime") != F.col("p_mtime")), "Modified")
    return c.join(p, "path", "full").select("path", kind.alias("change_type")).where("change_type IS NOT NULL")


def rescan(inventory: DataFrame) -> DataFrame:
    return inventory.select("path", F.lit("Modified").alias("change_type"))


def equal(level: str, a: str = "a", b: str = "b") -> Column:
    """Whether two sides' (size, mtime, hash) agree at a level; hashes are compared last."""
    x = lambda side, c: F.col(f"{side}.{c}")
    size, mtime, digest = (x(a, c) == x(b, c) for c in ("size", "mtime", "hash"))
    return {"none": F.lit(True), "size": size, "date_and_size": size & mtime, "hash": size & digest, "full": size & mtime & digest}[level]


def skip_known(source: DataFrame, state: DataFrame) -> DataFrame:
    """Source files beside what the state knows: unchanged, changed or new."""
    s = state.select("path", F.col("size").alias("known_size"), F.col("mtime").alias("known_mtime"))
    kind = F.when(F.col("known_mtime").isNull(), "new").when((F.col("size") == F.col("known_size")) & (F.col("mtime") == F.col("known_mtime")), "unchanged").otherwise("changed")
    return source.join(s, "path", "left").select("path", "size", kind.alias("decision"))


def move_pairing(source: DataFrame, state: DataFrame) -> DataFrame:
    """Untracked files that carry a tracked identity, size and time, whose old path is gone; the smallest old path wins."""
    new = source.join(state, "path", "left_anti").select("path", "file_id", "size", "mtime")
    gone = state.where("file_id IS NOT NULL").join(source, "path", "left_anti").select(F.col("path").alias("old_path"), "file_id", "size", "mtime")
    best = new.join(gone, ["file_id", "size", "mtime"]).groupBy("path").agg(F.min("old_path").alias("old_path"))
    return best.where("path <> old_path")


def parity_stale(dest: DataFrame, source_rel: DataFrame) -> DataFrame:
    """Destination files without a source twin (ignoring case), control files apart."""
    twins = source_rel.select(F.lower("rel").alias("key")).distinct()
    return dest.where(~P.control_file(F.col("rel"))).withColumn("key", F.lower("rel")).join(twins, "key", "left_anti").select("path")


def stale_dirs(dest: DataFrame, source_rel: DataFrame) -> DataFrame:
    """Destination directories that no source file lies under, deepest first by length."""
    above = lambda df: df.select(F.explode(P.ancestors(F.col("rel"))).alias("dir")).distinct()
    live = above(source_rel).select(F.lower("dir").alias("key"))
    dirs = above(dest.where(~P.control_file(F.col("rel"))))
    return dirs.withColumn("key", F.lower("dir")).join(live, "key", "left_anti").select("dir", F.length("dir").cast("long").alias("depth_order"))


def scrub_compare(dest: DataFrame, source: DataFrame, state: DataFrame) -> DataFrame:
    """Destination against source by relative path; the state's hash stands for the source only if its size and time still do."""
    known = state.select("path", F.col("size").alias("k_size"), F.col("mtime").alias("k_mtime"), F.col("hash").alias("k_hash"))
    s = source.join(known, "path", "left")
    trusted = (F.col("size") == F.col("k_size")) & (F.col("mtime") == F.col("k_mtime")) & F.col("k_hash").isNotNull()
    s = s.select("rel", F.col("size").alias("s_size"), F.when(trusted, F.col("k_hash")).otherwise(F.col("hash")).alias("s_hash"), trusted.alias("from_state"))
    verdict = F.when(F.col("s_size").isNull(), "no-source").when(F.col("size") != F.col("s_size"), "size-differs").when(F.col("hash") != F.col("s_hash"), "corrupt").otherwise("ok")
    return dest.join(s, "rel", "left").select("path", verdict.alias("verdict"), F.coalesce("from_state", F.lit(False)).alias("from_state"))


def append_proof(pairs: DataFrame, prefix_equal: Column) -> DataFrame:
    """Why a copy differs: the source was truncated, appended to, or changed; equal sizes are a failure (null)."""
    kind = F.when(F.col("source_size") < F.col("dest_size"), "truncated").when((F.col("source_size") > F.col("dest_size")) & prefix_equal, "appended").when(F.col("source_size") > F.col("dest_size"), "changed")
    return pairs.withColumn("reason", kind)


def sync_plan(source: DataFrame, state: DataFrame, dest: DataFrame) -> DataFrame:
    """copy, move, skip or verify for every source file (columns path, rel, size, mtime, hash, file_id)."""
    moved = move_pairing(source, state).select("path", "old_path")
    known = skip_known(source, state).select("path", "decision")
    at = dest.select("rel", F.col("size").alias("d_size"), F.col("hash").alias("d_hash"))
    same = (F.col("size") == F.col("d_size")) & (F.col("hash") == F.col("d_hash"))
    action = F.when((F.col("decision") == "unchanged") & F.col("d_size").isNotNull(), "skip").when(F.col("old_path").isNotNull(), "move").when(same, "adopt").otherwise("copy")
    return source.join(known, "path").join(moved, "path", "left").join(at, "rel", "left").select("path", "size", "old_path", action.alias("action"))


def scan_summary(plan: DataFrame) -> DataFrame:
    """One row: files scanned and their actions, and the first five copies by path."""
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    counts = plan.agg(F.count("*").alias("scanned"), n("copy"), n("move"), n("adopt"), n("skip"))
    # five rows at most
    first = plan.where("action = 'copy'").orderBy("path").limit(5).agg(F.array_join(F.array_sort(F.collect_list("path")), ";").alias("first_copies"))
    return counts.crossJoin(first)


def sticky_upsert(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch win on size and mtime; a null file_id or hash, or a zero ctime, keeps the old value.  Of a path's batch rows the last (seq) counts."""
    last = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime", "file_id", "ctime", "hash"), "seq").alias("n")).select("path", *(F.col(f"n.{c}").alias(f"n_{c}") for c in ("size", "mtime", "file_id", "ctime", "hash")))
    pick = lambda c: F.coalesce(f"n_{c}", c).alias(c)
    ctime = F.when(F.coalesce("n_ctime", F.lit(0)) != 0, F.col("n_ctime")).otherwise(F.coalesce("ctime", "n_ctime")).alias("ctime")
    return state.join(last, "path", "full").select("path", pick("size"), pick("mtime"), pick("file_id"), ctime, pick("hash"))


def unconditional_update(state: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """``column`` set from (path, value) rows, whatever stood there; other paths stay."""
    new = changes.select("path", F.col("value").alias("new"), F.lit(True).alias("hit"))
    return state.join(new, "path", "left").withColumn(column, F.when(F.col("hit"), F.col("new")).otherwise(F.col(column))).drop("new", "hit")


def rename_prefix(state: DataFrame, old: str, new: str) -> DataFrame:
    """Rows below ``old`` move below ``new`` and replace rows that are there already."""
    moves = F.startswith("path", F.lit(old.rstrip("/") + "/"))
    moved = state.where(moves).withColumn("path", P.rebase(F.col("path"), old, new))
    return state.where(~moves).join(moved.select("path"), "path", "left_anti").unionByName(moved)


def delete_rows(state: DataFrame, gone: DataFrame) -> DataFrame:
    return state.join(gone.select("path"), "path", "left_anti")


def rename_events(state: DataFrame, renames: DataFrame) -> DataFrame:
    """Each (old_path, path) row's state goes to the new path, replacing what is there."""
    moved = state.join(renames.select(F.col("old_path").alias("path"), F.col("path").alias("to")), "path").drop("path").withColumnRenamed("to", "path")
    stays = state.join(renames.select(F.col("old_path").alias("path")), "path", "left_anti").join(moved.select("path"), "path", "left_anti")
    return stays.unionByName(moved)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn = 1").drop("rn")


def state_lookup(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The state rows of some paths, found or not; ignoring case, as lookups do."""
    s = state.select(F.lower("path").alias("key"), "size", "mtime")
    return keys.select("path", F.lower("path").alias("key")).join(s, "key", "left").select("path", "size", "mtime")


def move_replay(moves: DataFrame, dest: DataFrame, skip: int) -> DataFrame:
    """What becomes of each paired move: copied if the new destination exists, moved if the old one does, else copied and the stale row dropped."""
    d = dest.select("rel").distinct()
    rel = lambda c: F.expr(f"substr({c}, {skip})")
    m = moves.withColumn("new_rel", rel("path")).withColumn("old_rel", rel("old_path"))
    m = m.join(d.select(F.col("rel").alias("new_rel"), F.lit(True).alias("new_there")), "new_rel", "left").join(d.select(F.col("rel").alias("old_rel"), F.lit(True).alias("old_there")), "old_rel", "left")
    return m.select("path", "old_path", F.when(F.col("new_there"), "copy").when(F.col("old_there"), "move").otherwise("drop-and-copy").alias("action"))

"""Paths from parent links, chains, and subtrees: joins repeated until no pointer is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def full_paths(nodes: DataFrame) -> DataFrame:
    """(ref, path, depth) of each (ref, parent, name); a missing parent makes a child of the root, nodes below a cycle have no root and no path.

    Pointers are doubled: after k rounds each node has joined 2^k names, so the number of joins is
    logarithmic in the depth.
    """
    up = nodes.select("ref", F.col("parent").alias("up"), F.col("name").alias("path"), F.lit(1).cast("long").alias("depth"))
    rooted = chain_roots(nodes.select(F.col("ref").alias("id"), "parent")).select(F.col("id").alias("ref"))
    up = _written(up.join(rooted, "ref", "left_semi"))
    while up.where("up IS NOT NULL").limit(1).count():
        above = up.select(F.col("ref").alias("up"), F.col("up").alias("a_up"), F.col("path").alias("a_path"), F.col("depth").alias("a_depth"))
        up = up.join(above, "up", "left").select("ref", F.col("a_up").alias("up"), F.when(F.col("a_path").isNull(), F.col("path")).otherwise(F.concat("a_path", F.lit("/"), "path")).alias("path"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"))
        up = _written(up)
    return up.select("ref", "path", "depth")


def _written(df: DataFrame) -> DataFrame:
    """The table written in the shared folder and read back: its lineage ends there."""
    path = shared_folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def subtree(paths: DataFrame, matched: DataFrame) -> DataFrame:
    """Nodes that are a matched one or lie below it, by their paths' ancestors."""
    parts = F.split("path", "/")
    lines = paths.select("ref", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("above"))
    return lines.join(matched.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("ref").distinct()


def chain_roots(nodes: DataFrame) -> DataFrame:
    """(id, root, length, gap) by following parents to the end; a gap is a parent that isn't there. Chains that end in a cycle have no root and no row.

    Each round is written to the shared folder and doubles the reach, until no pointer is left.
    """
    have = nodes.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    n = nodes.select("id", F.col("parent").alias("up"))
    n = n.join(have, "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up"), (F.col("up").isNotNull() & F.col("there").isNull()).alias("gap"), F.col("id").alias("root"), F.lit(1).cast("long").alias("length"))
    reach, total = 1, None
    while True:
        n = _written(n)
        if not n.where("up IS NOT NULL").limit(1).count():
            return n.select("id", "root", "length", "gap")
        # a chain without a cycle has no more nodes than there are
        total = nodes.count() if total is None else total
        if reach > total:
            return n.where("up IS NULL").select("id", "root", "length", "gap")
        above = n.select(F.col("id").alias("up"), F.col("up").alias("a_up"), F.col("gap").alias("a_gap"), F.col("root").alias("a_root"), F.col("length").alias("a_length"))
        n = n.join(above, "up", "left").select("id", F.col("a_up").alias("up"), (F.col("gap") | F.coalesce("a_gap", F.lit(False))).alias("gap"), F.coalesce("a_root", "root").alias("root"), (F.col("length") + F.coalesce("a_length", F.lit(0))).alias("length"))
        reach *= 2


def exclusion_match(paths: DataFrame, rules: list[str]) -> DataFrame:
    """Nodes that a rule excludes: a pathed rule fits the whole path; "$name" fits at any depth; a bare name fits directories at any depth and files at the top; a directory takes its subtree."""
    name = F.substring_index("path", "/", -1)
    hit = F.lit(False)
    for r in rules:
        low = F.lit(r.lower().lstrip("/"))
        if "/" in r:
            hit = hit | (F.lower("path") == low)
        elif r.startswith("$"):
            hit = hit | (F.lower(name) == low)
        else:
            hit = hit | ((F.lower(name) == low) & (F.col("is_dir") | (F.col("depth") == 1)))
    direct = paths.where(hit)
    below = subtree(paths, direct.where("is_dir"))
    return direct.select("ref").union(below).distinct()


def walk(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, ref) of paths found segment by segment from the roots, ignoring case; a join a level, with paths that end dropping out.  A path asked for twice is one."""
    roots = nodes.join(nodes.select(F.col("ref").alias("parent")), "parent", "left_anti").select("ref", F.lower("name").alias("part"))
    below = nodes.select(F.col("parent").alias("at"), F.lower("name").alias("part"), "ref")
    todo = asked.select("asked").distinct().select("asked", F.split(F.lower("asked"), "/").alias("parts"))
    found = todo.withColumn("part", F.col("parts")[0]).join(roots, "part").select("asked", "parts", F.col("ref").alias("at"))
    out = found.where(F.size("parts") == 1)
    longest = todo.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(1, longest):
        found = found.where(F.size("parts") > level).withColumn("part", F.get("parts", F.lit(level))).join(below, ["at", "part"]).select("asked", "parts", F.col("ref").alias("at"))
        out = out.unionByName(found.where(F.size("parts") == level + 1))
    return out.select("asked", F.col("at").alias("ref"))


def guarded(nodes: DataFrame) -> DataFrame:
    """Nodes (ref, parent, sequence, parent_sequence) whose parent, where there is one, still has the sequence number that they name: no link to a slot since reused."""
    have = nodes.groupBy(F.col("ref").alias("parent")).agg(F.first("sequence").alias("now"))
    return nodes.join(have, "parent", "left").where("now IS NULL OR now = parent_sequence").drop("now")

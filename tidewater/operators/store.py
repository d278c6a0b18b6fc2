"""Chunks, manifests, packs: what is live, dead, missing, changed, and what it costs.

A base of a delta counts as live wherever its delta does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions at which two manifests differ: hole flag, size or digest, or one side is missing."""
    x = a.select("idx", *(F.col(c).alias(f"a_{c}") for c in ("is_hole", "size", "digest")))
    y = b.select("idx", *(F.col(c).alias(f"b_{c}") for c in ("is_hole", "size", "digest")))
    same = (F.col("a_is_hole") == F.col("b_is_hole")) & (F.col("a_size") == F.col("b_size")) & (F.col("a_is_hole") | (F.col("a_digest") == F.col("b_digest")))
    return x.join(y, "idx", "full").select("idx", (~F.coalesce(same, F.lit(False))).alias("changed"))


def churn(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Positions whose hole flag or digest differs, and the difference of the lengths, over the longer manifest's length; zero if both are empty.

    Alarm above the threshold in percent; a threshold of zero is off.
    """
    x = a.select("idx", F.col("is_hole").alias("a_hole"), F.col("digest").alias("a_digest"))
    y = b.select("idx", F.col("is_hole").alias("b_hole"), F.col("digest").alias("b_digest"))
    differ = (F.col("a_hole") != F.col("b_hole")) | (~F.col("a_hole") & (F.col("a_digest") != F.col("b_digest")))
    n = x.join(y, "idx", "full").agg(F.count("a_hole").alias("n_a"), F.count("b_hole").alias("n_b"), F.count_if(differ).alias("differ"))
    n = n.select((F.abs(F.col("n_a") - F.col("n_b")) + F.col("differ")).alias("changed"), F.greatest("n_a", "n_b").alias("n"))
    share = F.when(F.col("n") == 0, 0.0).otherwise(F.col("changed") / F.col("n"))
    return n.select("changed", share.alias("fraction"), (F.lit(threshold > 0) & (share * 100 > threshold)).alias("alarm"))


def hole_flips(parent: DataFrame, current: DataFrame) -> DataFrame:
    """Positions whose hole flag differs, of manifests on one grid."""
    return parent.select("idx", F.col("is_hole").alias("was")).join(current.select("idx", "is_hole"), "idx").where("was <> is_hole").select("idx")


def resolve(entries: DataFrame, index: DataFrame, landing: DataFrame) -> DataFrame:
    """Where each entry's bytes are: a hole, a pack, the landing area, or nowhere."""
    i = index.select("digest", "pack", "pack_offset")
    land = landing.select("digest", F.lit(True).alias("landed"))
    where = F.when(F.col("is_hole"), "hole").when(F.col("pack").isNotNull(), "pack").when(F.col("landed"), "landing").otherwise("missing")
    return entries.join(i, "digest", "left").join(land, "digest", "left").select("generation", "idx", "digest", "pack", "pack_offset", where.alias("place"))


def newest_parent(manifests: DataFrame, at: DataFrame) -> DataFrame:
    """For each (key, generation) asked about, the newest manifest of the key at or below it: manifests and questions in one order."""
    have = manifests.select("part_key", "generation", F.col("generation").alias("have"))
    asked = at.select("part_key", "generation", F.lit(None).cast("long").alias("have"))
    w = Window.partitionBy("part_key").orderBy("generation", F.col("have").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return have.unionByName(asked).withColumn("parent", F.last("have", True).over(w)).where("have IS NULL").select("part_key", "generation", "parent")


def delta_bases(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Each delta's base: present and whole (itself no delta), or why not."""
    deltas = entries.where("base IS NOT NULL").select("digest", "base").distinct()
    chained = deltas.select(F.col("digest").alias("base"), F.lit(True).alias("is_delta")).distinct()
    have = index.select(F.col("digest").alias("base"), F.lit(True).alias("stored"))
    reason = F.when(F.col("stored").isNull(), "missing").when(F.col("is_delta"), "chained").otherwise("ok")
    return deltas.join(have, "base", "left").join(chained, "base", "left").select("digest", "base", reason.alias("state"))


def live_digests(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct digests that root generations hold, with the bases of their deltas."""
    e = entries.where("NOT is_hole").join(roots.select("generation"), "generation", "left_semi")
    return e.select("digest").union(e.where("base IS NOT NULL").select(F.col("base").alias("digest"))).distinct()


def dead_chunks(index: DataFrame, live: DataFrame) -> DataFrame:
    return index.join(live, "digest", "left_anti")


def unmarked(index: DataFrame, live: DataFrame) -> DataFrame:
    return dead_chunks(index, live).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("stored"), F.lit(0)).cast("long").alias("bytes"))


def live_packs(index: DataFrame, live: DataFrame) -> DataFrame:
    return index.join(live, "digest", "left_semi").select("pack").distinct()


def dead_packs(index: DataFrame, live: DataFrame) -> DataFrame:
    return index.groupBy("pack").agg(F.count("*").alias("chunks")).join(live_packs(index, live), "pack", "left_anti")


def new_chunks(entries: DataFrame, index: DataFrame) -> DataFrame:
    """The first entry of each digest that the index lacks."""
    w = Window.partitionBy("digest").orderBy("generation", "idx")
    return entries.where("NOT is_hole").join(index, "digest", "left_anti").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("digest", "generation", "idx", "size")


def insert_or_replace(index: DataFrame, rows: DataFrame) -> DataFrame:
    """(digest, pack, stored): of each digest the row with the largest seq; old rows have none."""
    every = index.select("digest", "pack", "stored", F.lit(-1).cast("long").alias("seq")).unionByName(rows.select("digest", "pack", "stored", "seq"))
    return every.groupBy("digest").agg(F.max_by(F.struct("pack", "stored"), "seq").alias("r")).select("digest", "r.*")


def size_sum(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Generations whose chunk sizes don't add up to the volume's length."""
    return entries.groupBy("generation").agg(F.sum("size").alias("sum")).join(manifests.select("generation", "length"), "generation").where("sum <> length").select("generation", F.col("sum").cast("long").alias("sum"), "length")


def planned_bytes(entries: DataFrame, chunk: int, length: Column) -> DataFrame:
    """Bytes to read for each generation: no holes, and the tail clipped to the length."""
    left = length - F.col("idx") * chunk
    size = F.greatest(F.least(F.lit(chunk).cast("long"), left), F.lit(0).cast("long"))
    return entries.groupBy("generation").agg(F.sum(F.when(F.col("is_hole"), 0).otherwise(size)).cast("long").alias("planned"))


def pack_density(index: DataFrame) -> DataFrame:
    """Blobs of each pack, and its length with a 41-byte header before each."""
    return index.groupBy("pack").agg(F.count("*").alias("blobs"), F.sum(F.col("stored") + 41).cast("long").alias("bytes"))


def store_size(index: DataFrame, free: int) -> DataFrame:
    """Total bytes, the largest pack, and whether compaction has room to rewrite it."""
    d = pack_density(index)
    return d.agg(F.sum("bytes").cast("long").alias("bytes"), F.max(F.struct("bytes", "pack")).alias("top")).select("bytes", F.col("top.pack").alias("largest"), (F.col("top.bytes") <= free).alias("headroom"))


def compact_plan(index: DataFrame, live: DataFrame, threshold: float) -> DataFrame:
    """Packs to rewrite: those with some live chunk whose dead share of bytes is over the threshold."""
    marked = index.join(live.withColumn("alive", F.lit(True)), "digest", "left")
    d = marked.groupBy("pack").agg(F.sum("stored").alias("all"), F.sum(F.when(F.col("alive").isNull(), F.col("stored")).otherwise(0)).alias("dead"), F.count_if("alive").alias("n"))
    return d.where((F.col("n") > 0) & (F.col("dead") / F.col("all") > threshold)).select("pack", F.col("dead").cast("long").alias("dead"), F.col("all").cast("long").alias("all"))


def transfer(entries: DataFrame, generations: DataFrame, source: DataFrame, dest: DataFrame) -> DataFrame:
    """Chunks that the destination lacks for some generations, and the packs that hold them."""
    return live_digests(entries, generations).join(dest.select("digest"), "digest", "left_anti").join(source.select("digest", "pack"), "digest", "left").select("digest", "pack")


def transfer_conflicts(source: DataFrame, dest: DataFrame) -> DataFrame:
    """skip, send or conflict for each source manifest (generation, hmac), by the destination's hmac of the generation."""
    d = dest.select("generation", F.col("hmac").alias("there"))
    return source.join(d, "generation", "left").select("generation", F.when(F.col("there").isNull(), "send").when(F.col("there") == F.col("hmac"), "skip").otherwise("conflict").alias("action"))


def chain_linkage(manifests: DataFrame) -> DataFrame:
    """Whether each manifest's previous digest is that of the generation before it, where that is its parent."""
    before = manifests.select((F.col("generation") + 1).alias("generation"), F.col("hmac").alias("expected"))
    linked = F.col("parent") == F.col("generation") - 1
    state = F.when(~F.coalesce(linked, F.lit(False)), "root").when(F.col("expected").isNull(), "gap").when(F.col("prev_digest") == F.col("expected"), "ok").otherwise("broken")
    return manifests.join(before, "generation", "left").select("generation", state.alias("link"))


def layout_survives(layouts: DataFrame, manifests: DataFrame, dropped: DataFrame) -> DataFrame:
    """A layout (id, partitions) stays if some partition's generation is over zero, exists and isn't dropped."""
    p = layouts.select("id", F.explode("partitions").alias("generation"))
    m = manifests.select("generation", F.lit(True).alias("there"))
    d = dropped.select("generation", F.lit(True).alias("gone"))
    ok = (F.col("generation") > 0) & F.coalesce("there", F.lit(False)) & ~F.coalesce("gone", F.lit(False))
    return p.join(m, "generation", "left").join(d, "generation", "left").groupBy("id").agg(F.bool_or(ok).alias("survives"))


def deep_sample(entries: DataFrame, percent: int) -> DataFrame:
    """ceil(n * percent / 100) of each generation's non-hole entries, in the order of a hash."""
    w = Window.partitionBy("generation").orderBy(F.xxhash64("generation", "idx"), "idx")
    n = F.count("*").over(Window.partitionBy("generation"))
    return entries.where("NOT is_hole").withColumn("rn", F.row_number().over(w)).withColumn("n", n).where(F.col("rn") <= F.ceil(F.col("n") * percent / 100)).select("generation", "idx", "digest")


def incremental_plan(entries: DataFrame, dirty: DataFrame, index: DataFrame) -> DataFrame:
    """For each grid position of the new image: hole, reuse (clean), indexed, or store; the first of a new digest stores, the others are dups."""
    e = entries.join(dirty.select("idx", F.lit(True).alias("dirty")), "idx", "left").join(index.select("digest", F.lit(True).alias("known")), "digest", "left")
    kind = F.when(F.col("is_hole"), "hole").when(F.col("dirty").isNull(), "reuse").when(F.col("known"), "indexed").otherwise("store")
    e = e.select("generation", "idx", "digest", kind.alias("kind"))
    w = Window.partitionBy("kind", "digest").orderBy("generation", "idx")
    return e.withColumn("kind", F.when((F.col("kind") == "store") & (F.row_number().over(w) > 1), "dup").otherwise(F.col("kind")))


def missing_reasons(entries: DataFrame, index: DataFrame, manifests: DataFrame) -> DataFrame:
    """Why each generation can't be exported, reasons joined by '+'; generations without one are left out."""
    e = entries.join(index.select("digest", F.lit(True).alias("known")), "digest", "left")
    m = manifests.select("generation", F.col("parent").isNull().alias("orphan"))
    g = e.groupBy("generation").agg(F.bool_or(~F.col("is_hole") & F.col("known").isNull()).alias("gap")).join(m, "generation", "left")
    text = F.concat_ws("+", F.array_compact(F.array(F.when(F.col("gap"), F.lit("missing-chunk")), F.when(F.coalesce("orphan", F.lit(True)), F.lit("no-parent")))))
    return g.select("generation", text.alias("reasons")).where("reasons <> ''")


def prefix_offsets(entries: DataFrame) -> DataFrame:
    w = Window.partitionBy("generation").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return entries.select("generation", "idx", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long").alias("offset"))


def offset_lookup(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunk of its generation that covers each wanted offset: positions and starts in one order, the last start at or before wins."""
    starts = prefix_offsets(entries).select("generation", F.col("offset").alias("at"), "idx", F.lit(None).cast("long").alias("want"))
    asked = wanted.select("generation", F.col("offset").alias("at"), F.lit(None).cast("long").alias("idx"), F.col("offset").alias("want"))
    w = Window.partitionBy("generation").orderBy("at", F.col("idx").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return starts.unionByName(asked).withColumn("chunk", F.last("idx", True).over(w)).where("want IS NOT NULL").select("generation", F.col("want").alias("offset"), "chunk")


def interval_chunks(extents: DataFrame, unit: int, chunk: int) -> DataFrame:
    """Grid chunks that each extent (vol, lo, cnt units) touches, made an equality: one row a chunk."""
    first, last = F.floor(F.col("lo") * unit / chunk), F.floor(((F.col("lo") + F.col("cnt")) * unit - 1) / chunk)
    return extents.where("cnt > 0").select("vol", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("idx")).distinct()


def hole_map(extents: DataFrame, grid: int, unit: int, chunk: int) -> DataFrame:
    """Grid positions of each volume that no extent touches."""
    every = extents.select("vol").distinct().select("vol", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))).alias("idx"))
    return every.join(interval_chunks(extents, unit, chunk), ["vol", "idx"], "left_anti")


def clip(extents: DataFrame, unit: int, chunk: int) -> DataFrame:
    """Each extent cut at chunk borders: (vol, id, idx, from, to) in bytes inside the chunk."""
    first, last = F.floor(F.col("lo") * unit / chunk).cast("long"), F.floor(((F.col("lo") + F.col("cnt")) * unit - 1) / chunk).cast("long")
    e = extents.where("cnt > 0").select("vol", "id", (F.col("lo") * unit).alias("a"), ((F.col("lo") + F.col("cnt")) * unit).alias("b"), F.explode(F.sequence(first, last)).alias("idx"))
    lo, hi = F.greatest("a", F.col("idx") * chunk) - F.col("idx") * chunk, F.least("b", (F.col("idx") + 1) * chunk) - F.col("idx") * chunk
    return e.select("vol", "id", "idx", lo.alias("from"), hi.alias("to"))


def merged_runs(extents: DataFrame) -> DataFrame:
    """Extents of a volume united to maximal runs (touching ones join)."""
    w = Window.partitionBy("vol").orderBy("lo", "hi")
    e = extents.where("cnt > 0").select("vol", "lo", (F.col("lo") + F.col("cnt")).alias("hi"))
    e = e.withColumn("reach", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", (F.col("reach").isNull() | (F.col("lo") > F.col("reach"))).cast("int"))
    e = e.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("vol", "run").agg(F.min("lo").alias("start"), F.max("hi").alias("end")).select("vol", "start", (F.col("end") - F.col("start")).alias("count"))


def bitmap_runs(bits: DataFrame) -> DataFrame:
    """Islands of set positions (grp, pos) as (grp, start, count)."""
    d = bits.select("grp", "pos").distinct()
    d = d.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("grp").orderBy("pos")))
    return d.groupBy("grp", "island").agg(F.min("pos").alias("start"), F.count("*").alias("count")).drop("island")


def fixed_parts(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, idx, part): the text's bytes in fixed-size pieces."""
    raw = F.col("text").cast("binary")
    n = F.octet_length(raw)
    pieces = docs.where(n > 0).select("doc_id", raw.alias("raw"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("idx"))
    part = F.substring(F.col("raw"), F.col("idx") * size + 1, F.lit(size))
    return pieces.select("doc_id", F.col("idx").cast("long").alias("idx"), part.alias("part"))


def fixed_chunks(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, idx, length, digest, is_hole) of fixed-size pieces of the text's bytes; a hole is all one zero byte."""
    return fixed_parts(docs, size).select("doc_id", "idx", F.octet_length("part").cast("long").alias("length"), F.sha2("part", 256).alias("digest"), (F.col("part") == F.unhex(F.repeat(F.lit("00"), F.octet_length("part")))).alias("is_hole"))


def export_check(entries: DataFrame) -> DataFrame:
    """Each generation's digests in order, hashed: what an export would be compared by."""
    g = entries.groupBy("generation").agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "is_hole"))).alias("e"))
    return g.select("generation", F.sha2(F.array_join(F.transform("e", lambda x: F.when(x["is_hole"], F.lit("hole")).otherwise(x["digest"].cast("string"))), ","), 256).alias("fingerprint"))


def delta_pins(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """How many delta entries of root generations pin how many bases."""
    return entries.where("NOT is_hole AND base IS NOT NULL").join(roots.select("generation"), "generation", "left_semi").agg(F.count("*").alias("pins"), F.count_distinct("base").alias("bases"))


def blocking_reasons(manifests: DataFrame, pins: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """Why each generation stays, reasons joined by '+': the newest, pinned, within the window, or without a date where a window is set."""
    newest = manifests.agg(F.max("generation").alias("newest"))
    m = manifests.join(pins.select("generation", F.lit(True).alias("pinned")), "generation", "left").crossJoin(F.broadcast(newest))
    recent = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("created").cast("timestamp")) <= keep_days * 86400
    window = F.when(F.col("created").isNull(), "unparseable-date").when(recent, "within-window") if keep_days > 0 else F.lit(None).cast("string")
    text = F.concat_ws("+", F.when(F.col("generation") == F.col("newest"), "newest"), F.when(F.col("pinned"), "pinned"), window)
    return m.select("generation", F.when(text == "", "not prunable this run").otherwise(text).alias("reasons"))

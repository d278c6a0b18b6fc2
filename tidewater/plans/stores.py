"""Queries over manifests, chunk indexes, extents and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import store as S
from .catalog import query

ROOTS = "(SELECT generation FROM manifests WHERE generation % 512 = 1)"


def _roots(t):
    return t.manifests.where("generation % 512 = 1").select("generation")


def _two(t):
    """Two manifests on one grid: all entries folded to 500 positions."""
    e = t.entries.withColumn("pos", F.col("generation") % 500)
    a = e.where("generation % 2 = 0").groupBy(F.col("pos").alias("idx")).agg(F.min("digest").alias("digest"), F.min("size").alias("size"), F.bool_and("is_hole").alias("is_hole"))
    b = e.where("generation % 3 = 0").groupBy(F.col("pos").alias("idx")).agg(F.min("digest").alias("digest"), F.min("size").alias("size"), F.bool_and("is_hole").alias("is_hole"))
    return a, b


AB = "a AS (SELECT generation % 500 AS idx, min(digest) AS digest, min(size) AS size, bool_and(is_hole) AS is_hole FROM entries WHERE generation % 2 = 0 GROUP BY 1), b AS (SELECT generation % 500 AS idx, min(digest) AS digest, min(size) AS size, bool_and(is_hole) AS is_hole FROM entries WHERE generation % 3 = 0 GROUP BY 1)"
MDIFF = f"WITH {AB} SELECT coalesce(a.idx, b.idx) AS idx, NOT coalesce(a.is_hole = b.is_hole AND a.size = b.size AND (a.is_hole OR a.digest = b.digest), FALSE) AS changed FROM a FULL OUTER JOIN b ON a.idx = b.idx"


@query("manifest_diff", MDIFF)
def _(t):
    return S.manifest_diff(*_two(t))


@query("dirty_positions", f"SELECT idx FROM ({MDIFF}) WHERE changed")
def _(t):
    return S.manifest_diff(*_two(t)).where("changed").select("idx")


@query("churn_fraction", f"""WITH {AB} SELECT changed, changed / n AS fraction, 100.0 * changed / n > 20 AS alarm FROM (SELECT abs(count(a.idx) - count(b.idx)) + count(*) FILTER (a.is_hole <> b.is_hole OR NOT a.is_hole AND a.digest <> b.digest) AS changed, greatest(count(a.idx), count(b.idx)) AS n FROM a FULL OUTER JOIN b ON a.idx = b.idx)""")
def _(t):
    return S.churn(*_two(t), 20.0)


@query("hole_flips", f"WITH {AB} SELECT a.idx FROM a JOIN b ON a.idx = b.idx WHERE a.is_hole <> b.is_hole")
def _(t):
    return S.hole_flips(*_two(t))


@query("dirty_plan", f"WITH {AB} SELECT idx FROM (SELECT a.idx FROM a JOIN b ON a.idx = b.idx WHERE a.is_hole <> b.is_hole UNION SELECT DISTINCT lo // 8 FROM extents WHERE vol = 0 UNION SELECT DISTINCT lo // 8 FROM extents WHERE vol = 5) EXCEPT SELECT lo // 8 FROM extents WHERE vol = 10")
def _(t):
    chunk = F.floor(F.col("lo") / 8).cast("long").alias("idx")
    of = lambda v: t.extents.where(f"vol = {v}").select(chunk)
    return S.hole_flips(*_two(t)).union(of(0)).union(of(5)).distinct().join(of(10).distinct(), "idx", "left_anti")


RESOLVE = "SELECT e.generation, e.idx, e.digest, i.pack, i.pack_offset, CASE WHEN e.is_hole THEN 'hole' WHEN i.digest IS NOT NULL THEN 'pack' WHEN e.digest % 46 = 0 THEN 'landing' ELSE 'missing' END AS place FROM entries e LEFT JOIN chunk_index i ON e.digest = i.digest"


def _landing(t):
    return t.part.where("p_partkey % 46 = 0").select(F.col("p_partkey").alias("digest"))


@query("chunk_resolve", RESOLVE)
def _(t):
    return S.resolve(t.entries, t.chunk_index, _landing(t))


@query("store_verify", f"SELECT generation, count(*) FILTER (place = 'missing') AS missing, count(*) AS entries FROM ({RESOLVE}) GROUP BY generation HAVING count(*) FILTER (place = 'missing') > 0")
def _(t):
    return S.resolve(t.entries, t.chunk_index, _landing(t)).groupBy("generation").agg(F.count_if(F.col("place") == "missing").alias("missing"), F.count("*").alias("entries")).where("missing > 0")


@query("newest_parent", "SELECT q.part_key, q.generation, max(m.generation) AS parent FROM (SELECT part_key, max(generation) - 100 AS generation FROM manifests GROUP BY 1) q LEFT JOIN manifests m ON m.part_key = q.part_key AND m.generation <= q.generation GROUP BY ALL")
def _(t):
    return S.newest_parent(t.manifests, t.manifests.groupBy("part_key").agg((F.max("generation") - 100).alias("generation")))


@query("delta_base_resolve", "WITH d AS (SELECT DISTINCT digest, base FROM entries WHERE base IS NOT NULL) SELECT d.digest, d.base, CASE WHEN i.digest IS NULL THEN 'missing' WHEN d.base IN (SELECT digest FROM d) THEN 'chained' ELSE 'ok' END AS state FROM d LEFT JOIN chunk_index i ON i.digest = d.base")
def _(t):
    return S.delta_bases(t.entries, t.chunk_index)


LIVE = f"(SELECT digest FROM entries WHERE NOT is_hole AND generation IN {ROOTS} UNION SELECT base FROM entries WHERE base IS NOT NULL AND NOT is_hole AND generation IN {ROOTS})"


def _live(t):
    return S.live_digests(t.entries, _roots(t))


@query("live_digests", f"SELECT digest FROM {LIVE}")
def _(t):
    return _live(t)


@query("unmarked_stats", f"SELECT count(*) AS chunks, CAST(coalesce(sum(stored), 0) AS BIGINT) AS bytes FROM chunk_index WHERE digest NOT IN {LIVE}")
def _(t):
    return S.unmarked(t.chunk_index, _live(t))


@query("live_packs", f"SELECT DISTINCT pack FROM chunk_index WHERE digest IN {LIVE}")
def _(t):
    return S.live_packs(t.chunk_index, _live(t))


@query("mark_sweep", f"SELECT digest, pack FROM chunk_index WHERE digest NOT IN {LIVE}")
def _(t):
    return S.dead_chunks(t.chunk_index, _live(t)).select("digest", "pack")


@query("dead_packs", f"SELECT pack, count(*) AS chunks FROM chunk_index GROUP BY pack HAVING count(*) FILTER (digest IN {LIVE}) = 0")
def _(t):
    return S.dead_packs(t.chunk_index, _live(t))


@query("gc_plan", f"""SELECT 'manifest' AS what, CAST(generation AS VARCHAR) AS name FROM manifests WHERE generation NOT IN {ROOTS}
UNION ALL SELECT 'chunk', CAST(digest AS VARCHAR) FROM chunk_index WHERE digest NOT IN {LIVE} UNION ALL SELECT 'pack', pack FROM chunk_index GROUP BY pack HAVING count(*) FILTER (digest IN {LIVE}) = 0""")
def _(t):
    row = lambda df, what, c: df.select(F.lit(what).alias("what"), F.col(c).cast("string").alias("name"))
    drop = t.manifests.join(_roots(t), "generation", "left_anti")
    return row(drop, "manifest", "generation").unionByName(row(S.dead_chunks(t.chunk_index, _live(t)), "chunk", "digest")).unionByName(row(S.dead_packs(t.chunk_index, _live(t)), "pack", "pack"))


@query("worm_gate", f"SELECT count(*) > 0 AS refused FROM chunk_index WHERE digest NOT IN {LIVE}")
def _(t):
    return S.dead_chunks(t.chunk_index, _live(t)).agg((F.count("*") > 0).alias("refused"))


@query("prefilter_semi", "SELECT digest, pack FROM chunk_index WHERE pack IN (SELECT pack FROM chunk_index WHERE stored > 48)")
def _(t):
    return t.chunk_index.join(t.chunk_index.where("stored > 48").select("pack").distinct(), "pack", "left_semi").select("digest", "pack")


NEW = "SELECT digest, generation, idx, size FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY generation, idx) AS rn FROM entries WHERE NOT is_hole AND digest NOT IN (SELECT digest FROM chunk_index)) WHERE rn = 1"


@query("dedup_anti", NEW)
def _(t):
    return S.new_chunks(t.entries, t.chunk_index)


@query("first_per_key", "SELECT digest, generation, idx FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY generation, idx) AS rn FROM entries) WHERE rn = 1")
def _(t):
    from ..operators.sync import first_per_key

    return first_per_key(t.entries, ["digest"], [F.col("generation"), F.col("idx")]).select("digest", "generation", "idx")


@query("insert_or_replace", "SELECT digest, CASE WHEN p THEN 'moved' ELSE pack END AS pack, CASE WHEN p THEN stored + 1 ELSE stored END AS stored FROM (SELECT *, digest % 4 = 0 AS p FROM chunk_index)")
def _(t):
    m = t.chunk_index.where("digest % 4 = 0")
    rows = m.select("digest", F.lit("early").alias("pack"), F.lit(0).cast("long").alias("stored"), F.lit(1).cast("long").alias("seq")).unionByName(m.select("digest", F.lit("moved").alias("pack"), (F.col("stored") + 1).alias("stored"), F.lit(2).cast("long").alias("seq")))
    return S.insert_or_replace(t.chunk_index, rows)


@query("size_sum_check", "SELECT e.generation, CAST(sum(e.size) AS BIGINT) AS sum, m.length FROM entries e JOIN (SELECT generation, CASE WHEN generation % 2 = 0 THEN length ELSE 60 END AS length FROM manifests) m ON m.generation = e.generation GROUP BY e.generation, m.length HAVING sum(e.size) <> m.length")
def _(t):
    return S.size_sum(t.entries, t.manifests.select("generation", F.when(F.col("generation") % 2 == 0, F.col("length")).otherwise(60).alias("length")))


@query("planned_bytes", "SELECT generation, CAST(sum(CASE WHEN is_hole THEN 0 ELSE greatest(least(16, 100 - idx * 16), 0) END) AS BIGINT) AS planned FROM entries GROUP BY generation")
def _(t):
    return S.planned_bytes(t.entries, 16, F.lit(100).cast("long"))


DENSITY = "SELECT pack, count(*) AS blobs, CAST(sum(stored + 41) AS BIGINT) AS bytes FROM chunk_index GROUP BY pack"


@query("pack_density", DENSITY)
def _(t):
    return S.pack_density(t.chunk_index)


@query("store_size", f"SELECT CAST(sum(bytes) AS BIGINT) AS bytes, arg_max(pack, (bytes, pack)) AS largest, max(bytes) <= 8000 AS headroom FROM ({DENSITY})")
def _(t):
    return S.store_size(t.chunk_index, 8000)


@query("compact_plan", f"SELECT pack, CAST(dead AS BIGINT) AS dead, CAST(whole AS BIGINT) AS \"all\" FROM (SELECT pack, sum(stored) FILTER (digest NOT IN {LIVE}) AS dead, sum(stored) AS whole, count(*) FILTER (digest IN {LIVE}) AS n FROM chunk_index GROUP BY pack) WHERE n > 0 AND dead / whole > 0.5")
def _(t):
    return S.compact_plan(t.chunk_index, _live(t), 0.5)


@query("transfer_diff", f"SELECT l.digest, i.pack FROM {LIVE} l LEFT JOIN chunk_index i ON i.digest = l.digest WHERE l.digest NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)")
def _(t):
    return S.transfer(t.entries, _roots(t), t.chunk_index, t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("digest")))


@query("transfer_conflicts", "SELECT generation, CASE WHEN generation % 3 = 0 THEN 'send' WHEN generation % 3 = 1 THEN 'skip' ELSE 'conflict' END AS action FROM manifests")
def _(t):
    m = t.manifests.select("generation", F.md5(F.col("generation").cast("string")).alias("hmac"))
    return S.transfer_conflicts(m, m.where("generation % 3 <> 0").withColumn("hmac", F.when(F.col("generation") % 3 == 2, "x").otherwise(F.col("hmac"))))


@query("chain_linkage", "SELECT m.generation, CASE WHEN m.parent IS NULL THEN 'root' WHEN b.generation IS NULL THEN 'gap' WHEN m.generation % 10 = 3 THEN 'broken' ELSE 'ok' END AS link FROM manifests m LEFT JOIN manifests b ON b.generation = m.generation - 1")
def _(t):
    hm = lambda g: F.md5(g.cast("string"))
    return S.chain_linkage(t.manifests.select("generation", "parent", hm(F.col("generation")).alias("hmac"), F.when(F.col("generation") % 10 == 3, "bad").otherwise(hm(F.col("generation") - 1)).alias("prev_digest")))


@query("layout_survives", "SELECT part_key AS id, bool_or(generation % 5 <> 0 AND generation > 0) AS survives FROM manifests GROUP BY 1 UNION ALL SELECT -9, FALSE")
def _(t):
    lay = t.manifests.groupBy(F.col("part_key").alias("id")).agg(F.collect_list("generation").alias("partitions"))
    lay = lay.unionByName(t.spark.range(1).select(F.lit(-9).cast("long").alias("id"), F.array(F.lit(0).cast("long"), F.lit(-5).cast("long")).alias("partitions")))
    return S.layout_survives(lay, t.manifests, t.manifests.where("generation % 5 = 0"))


@query("deep_verify_sample", "SELECT generation, CAST(ceil(count(*) * 30 / 100.0) AS BIGINT) AS n FROM entries WHERE NOT is_hole GROUP BY generation")
def _(t):
    return S.deep_sample(t.entries, 30).groupBy("generation").agg(F.count("*").alias("n"))


@query("incremental_plan", """SELECT generation, idx, digest, CASE WHEN kind = 'store' AND rn > 1 THEN 'dup' ELSE kind END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY kind, digest ORDER BY generation, idx) AS rn FROM (
  SELECT e.generation, e.idx, e.digest, CASE WHEN e.is_hole THEN 'hole' WHEN e.idx NOT IN (1, 3, 4) THEN 'reuse' WHEN i.digest IS NOT NULL THEN 'indexed' ELSE 'store' END AS kind FROM entries e LEFT JOIN chunk_index i ON i.digest = e.digest))""")
def _(t):
    return S.incremental_plan(t.entries, t.spark.range(5).select(F.col("id").alias("idx")).where("idx IN (1, 3, 4)"), t.chunk_index)


@query("missing_reasons", """SELECT generation, reasons FROM (SELECT e.generation, concat_ws('+', CASE WHEN bool_or(NOT e.is_hole AND i.digest IS NULL) THEN 'missing-chunk' END, CASE WHEN coalesce(bool_or(m.parent IS NULL), TRUE) THEN 'no-parent' END) AS reasons
  FROM entries e LEFT JOIN chunk_index i ON i.digest = e.digest LEFT JOIN manifests m ON m.generation = e.generation GROUP BY e.generation) WHERE reasons <> ''""")
def _(t):
    return S.missing_reasons(t.entries, t.chunk_index, t.manifests)


OFFSETS = "SELECT generation, idx, CAST(coalesce(sum(size) OVER (PARTITION BY generation ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM entries"


@query("prefix_offsets", OFFSETS)
def _(t):
    return S.prefix_offsets(t.entries)


@query("offset_lookup", f"""WITH o AS ({OFFSETS}), w AS (SELECT DISTINCT generation, generation % 70 AS "offset" FROM manifests) SELECT w.generation, w."offset", max(o.idx) AS chunk FROM w LEFT JOIN o ON o.generation = w.generation AND o."offset" <= w."offset" GROUP BY ALL""")
def _(t):
    return S.offset_lookup(t.entries, t.manifests.select("generation", (F.col("generation") % 70).alias("offset")).distinct())


CHUNKS = "SELECT DISTINCT vol, unnest(range(lo * 4 // 64, ((lo + cnt) * 4 - 1) // 64 + 1)) AS idx FROM extents WHERE cnt > 0"


@query("interval_overlap", CHUNKS)
def _(t):
    return S.interval_chunks(t.extents, 4, 64)


@query("sparse_holes", f"SELECT vol, idx FROM (SELECT DISTINCT vol FROM extents), range(40) AS r(idx) WHERE (vol, idx) NOT IN ({CHUNKS})")
def _(t):
    return S.hole_map(t.extents, 40, 4, 64)


@query("clip_ranges", """SELECT vol, id, idx, greatest(lo * 4, idx * 64) - idx * 64 AS "from", least((lo + cnt) * 4, (idx + 1) * 64) - idx * 64 AS "to" FROM (SELECT *, unnest(range(lo * 4 // 64, ((lo + cnt) * 4 - 1) // 64 + 1)) AS idx FROM extents WHERE cnt > 0)""")
def _(t):
    return S.clip(t.extents, 4, 64)


@query("merged_runs", """WITH p AS (SELECT DISTINCT vol, unnest(range(lo, lo + cnt)) AS u FROM extents WHERE cnt > 0), i AS (SELECT vol, u, u - row_number() OVER (PARTITION BY vol ORDER BY u) AS g FROM p)
SELECT vol, min(u) AS start, count(*) AS count FROM i GROUP BY vol, g""")
def _(t):
    return S.merged_runs(t.extents)


ISLANDS = "SELECT grp, min(pos) AS start, count(*) AS count FROM (SELECT grp, pos, pos - row_number() OVER (PARTITION BY grp ORDER BY pos) AS g FROM (SELECT DISTINCT l_suppkey % 10 AS grp, l_orderkey AS pos FROM lineitem WHERE l_quantity < 10)) GROUP BY grp, g"


@query("bitmap_runs", ISLANDS)
def _(t):
    return S.bitmap_runs(t.lineitem.where("l_quantity < 10").select((F.col("l_suppkey") % 10).alias("grp"), F.col("l_orderkey").alias("pos")))


PIECES = "SELECT doc_id, idx, octet_length(raw) AS length, sha256(raw) AS digest, regexp_full_match(hex(raw), '(00)+') AS is_hole FROM (SELECT doc_id, idx, unhex(substr(h, CAST(idx AS BIGINT) * 1024 + 1, 1024)) AS raw FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE length(text) > 0), unnest(range((length(h) + 1023) // 1024)) AS r(idx))"


@query("fixed_chunk", PIECES)
def _(t):
    return S.fixed_chunks(t.documents, 512)


@query("image_dedup", f"SELECT digest, count(*) AS uses, min(doc_id) AS first_doc, min(length) AS length FROM ({PIECES}) GROUP BY digest")
def _(t):
    c = S.fixed_chunks(t.documents, 512)
    return c.groupBy("digest").agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_doc"), F.min("length").alias("length"))


@query("raw_export", "SELECT generation, sha256(string_agg(CASE WHEN is_hole THEN 'hole' ELSE CAST(digest AS VARCHAR) END, ',' ORDER BY idx)) AS fingerprint FROM entries GROUP BY generation")
def _(t):
    return S.export_check(t.entries)


@query("manifest_scan", "SELECT generation, idx, digest, size, is_hole, base FROM entries")
def _(t):
    """Signed manifests, written and read again."""
    from ..sources import manifests as M
    from ..sources.folders import shared_folder

    folder = shared_folder(t.spark, "manifests")
    M.save(M.nest(t.entries), folder, "store-key")
    return M.explode_chunks(M.load(t.spark, folder, "generation BIGINT, " + M.MANIFEST[M.MANIFEST.index("chunks ") :], "store-key")).select("generation", "idx", "digest", "size", "is_hole", "base")


@query("usable_parent", "SELECT c.generation, p.generation AS parent FROM manifests c JOIN manifests p ON p.generation = c.generation - 1 AND p.part_key % 7 = c.part_key % 7 AND p.grid % 2 = c.grid % 2")
def _(t):
    from ..operators.guards import usable_parent

    m = t.manifests.select("generation", (F.col("part_key") % 7).alias("length"), (F.col("grid") % 2).alias("grid"), F.lit(4).alias("chunk_mib"), F.lit("fixed").alias("chunker"))
    return usable_parent(m)


# trees


PATHS = """p AS (SELECT ref, name AS path, CAST(1 AS BIGINT) AS depth, is_dir FROM tree WHERE parent NOT IN (SELECT ref FROM tree) UNION ALL SELECT t.ref, p.path || '/' || t.name, p.depth + 1, t.is_dir FROM tree t JOIN p ON t.parent = p.ref)"""


@query("full_path", f"WITH RECURSIVE {PATHS} SELECT ref, path, depth FROM p")
def _(t):
    return G.full_paths(t.tree)


@query("subtree_closure", f"WITH RECURSIVE {PATHS} SELECT ref FROM p WHERE path LIKE '%ASIA/%' OR path LIKE '%ASIA'")
def _(t):
    paths = G.full_paths(t.tree)
    return G.subtree(paths, paths.where("path LIKE '%ASIA'"))


@query("exclusion_match", f"WITH RECURSIVE {PATHS} SELECT DISTINCT ref FROM p WHERE path LIKE 'EUROPE/%' OR path = 'EUROPE' OR path LIKE 'ASIA/CHINA%'")
def _(t):
    paths = G.full_paths(t.tree).join(t.tree.select("ref", "is_dir", "name"), "ref")
    return G.exclusion_match(paths, ["europe", "asia/china", "$recycle"])


CHAIN = "c AS (SELECT id, id AS root, CAST(1 AS BIGINT) AS length, parent IS NOT NULL AS gap FROM turns WHERE parent IS NULL OR parent NOT IN (SELECT id FROM turns) UNION ALL SELECT t.id, c.root, c.length + 1, c.gap FROM turns t JOIN c ON t.parent = c.id)"


@query("provenance_chain", f"WITH RECURSIVE {CHAIN} SELECT id, root, length, gap FROM c")
def _(t):
    return G.chain_roots(t.turns)

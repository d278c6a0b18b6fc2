"""Queries for verification and planning jobs, binary records, and what else composes other operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codecs as Z
from ..functions import records as R
from ..functions import scalars as X
from ..operators import graph as G
from ..operators import history as H
from ..operators import policy as P
from ..operators import store as S
from ..operators import sync
from ..sources.folders import shared_folder
from .catalog import query
from .files import _FNV, _source
from .history import _JOBS, DAILY, SPIKES, _jobs
from .stores import AB, MDIFF, PATHS, _two

SCRUB = """SELECT d.path, CASE WHEN i.path IS NULL THEN 'no-source' WHEN d.size <> i.size THEN 'size-differs' WHEN d.hash <> (CASE WHEN t.ok THEN t.hash ELSE i.hash END) THEN 'corrupt' ELSE 'ok' END AS verdict
FROM dest d LEFT JOIN inventory i ON d.rel = substr(i.path, 6)
LEFT JOIN (SELECT s.path, s.hash, s.hash IS NOT NULL AND s.size = i.size AND s.mtime = i.mtime AS ok FROM state s JOIN inventory i ON s.path = i.path) t ON t.path = i.path"""


@query("scrub", f"SELECT * FROM ({SCRUB}) WHERE {_FNV.format(x='path')} % 20 = 3")
def _(t):
    """One shard of the destination, of twenty that take turns."""
    shard = t.dest.where(X.fnv1a(F.col("path")) % 20 == 3)
    return sync.scrub_compare(shard, _source(t), t.state).select("path", "verdict")


@query("routine_restore_check", f"SELECT count(*) AS checked, count(*) FILTER (verdict <> 'ok') AS problems, count(*) FILTER (verdict <> 'ok') = 0 AS stamp FROM ({SCRUB}) WHERE {_FNV.format(x='path')} % 20 IN (1, 2)")
def _(t):
    some = t.dest.where((X.fnv1a(F.col("path")) % 20).isin(1, 2))
    r = sync.scrub_compare(some, _source(t), t.state)
    bad = F.count_if(F.col("verdict") != "ok")
    return r.agg(F.count("*").alias("checked"), bad.alias("problems"), (bad == 0).alias("stamp"))


BANDS = "SELECT doc_id // 32 AS band, sha256(unhex(string_agg('20000000' || h, '' ORDER BY doc_id))) AS d FROM ({}) GROUP BY 1"
NEW_RECORDS, OLD_RECORDS = "SELECT doc_id, sha256(text) AS h FROM documents", "SELECT doc_id, sha256(CASE WHEN doc_id % 29 = 0 THEN text || 'x' ELSE text END) AS h FROM documents"


@query("digest_diff_plan", f"""WITH changed AS (SELECT n.band FROM ({BANDS.format(NEW_RECORDS)}) n JOIN ({BANDS.format(OLD_RECORDS)}) o ON n.band = o.band WHERE n.d <> o.d)
SELECT DISTINCT n.doc_id * 3 // 8 AS chunk FROM ({NEW_RECORDS}) n JOIN ({OLD_RECORDS}) o ON n.doc_id = o.doc_id WHERE n.h <> o.h AND n.doc_id // 32 IN (SELECT band FROM changed)""")
def _(t):
    """Bands whose digests differ, their records that differ, and the chunks those lie in."""
    no = F.col("doc_id").alias("no")
    now = t.documents.select(no, F.sha2("text", 256).alias("digest"))
    was = t.documents.select(no, F.sha2(F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("digest"))
    raw = lambda df: P.band_digests(df.select("no", F.unhex("digest").alias("raw")), 32)
    bands = raw(now).join(raw(was).withColumnRenamed("digest", "old"), "band").where("digest <> old").select("band")
    of = lambda df: df.withColumn("band", F.floor(F.col("no") / 32).cast("long")).join(bands, "band", "left_semi")
    dirty = of(now).join(of(was).select("no", F.col("digest").alias("old")), "no").where("digest <> old")
    return dirty.select(F.floor(F.col("no") * 3 / 8).cast("long").alias("chunk")).distinct()


@query("dirty_confirmed", f"WITH {AB} SELECT a.idx FROM a JOIN b ON a.idx = b.idx JOIN ({MDIFF}) d ON d.idx = a.idx WHERE d.changed AND a.is_hole = b.is_hole")
def _(t):
    """Dirty positions that a second look confirms: they differ, and not in being a hole."""
    a, b = _two(t)
    return S.manifest_diff(a, b).where("changed").select("idx").join(a.join(b, "idx", "left_semi").select("idx"), "idx").join(S.hole_flips(a, b), "idx", "left_anti")


@query("restore_verify", f"WITH {AB} SELECT a.idx, CASE WHEN a.is_hole <> b.is_hole THEN 'warn' ELSE 'fatal' END AS severity FROM a JOIN b ON a.idx = b.idx WHERE a.is_hole <> b.is_hole OR NOT a.is_hole AND (a.size <> b.size OR a.digest <> b.digest)")
def _(t):
    from ..operators.verify import restore_problems

    return restore_problems(*_two(t))


@query("resume_ranges", """SELECT vol, id, greatest(lo * 4, 800) AS "from", (lo + cnt) * 4 AS "to" FROM extents WHERE cnt > 0 AND (lo + cnt) * 4 > 800""")
def _(t):
    from ..operators.verify import resume_ranges

    return resume_ranges(t.extents, 4, 800)


@query("forget_plan", "SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY stamp DESC NULLS FIRST, id DESC) AS rn FROM versions) WHERE rn > 3 AND NOT pinned AND stamp IS NOT NULL AND stamp < TIMESTAMP '1998-07-01' - INTERVAL 90 DAY AND contains(CAST(grp AS VARCHAR), '7')")
def _(t):
    """Of files whose name has a 7, the versions beyond the last three and the last 90 days."""
    from ..functions.paths import name_filter

    grp = F.col("grp").cast("string")
    return H.forget(t.versions, F.lit("1998-07-01").cast("timestamp_ntz"), name_filter(grp, grp, "7"), keep_last=3, keep_within_days=90)


@query("scheduler_loop", f"SELECT id, CASE WHEN NOT due THEN 'idle' WHEN id % 5 <> 0 THEN 'start' WHEN id % 2 = 0 THEN 'chain' ELSE 'skip' END AS decision FROM (SELECT id, {DAILY} AS due FROM {_JOBS})")
def _(t):
    jobs = _jobs(t).withColumn("due", H.due(F.col("now"), F.col("last"), "daily", hour=9))
    ran = H.overlap(F.col("id") % 5 == 0, F.when(F.col("id") % 2 == 0, "chain").otherwise("skip"))
    return jobs.select("id", F.when(~F.col("due"), "idle").otherwise(ran).alias("decision"))


@query("unique_batch_ids", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || CASE WHEN rn > 1 THEN '-' || CAST(rn AS VARCHAR) ELSE '' END AS batch FROM (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS rn FROM orders)")
def _(t):
    rn = F.row_number().over(Window.partitionBy("o_orderdate").orderBy("o_orderkey"))
    return t.orders.select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(rn > 1, F.concat(F.lit("-"), rn.cast("string"))).otherwise("")).alias("batch"))


LATCH = f"""WITH s AS ({SPIKES})
SELECT s.path, s.event_id FROM s JOIN (SELECT path, min((us, event_id)) AS since FROM s WHERE files >= 3 GROUP BY path) h ON h.path = s.path AND (s.us, s.event_id) >= h.since"""


@query("spike_latch", LATCH)
def _(t):
    """Events that come while their key is held: from its first trip on, until somebody clears it."""
    s = H.spike_guard(t.changes, "path", 3600, files=3)
    first = s.join(t.changes.select("event_id", "ts"), "event_id")
    held = Window.partitionBy("path").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("held", F.max(F.col("tripped").cast("int")).over(held)).where("held = 1").select("path", "event_id")


@query("spike_latch_stream", LATCH)
def _(t):
    """The stateful form over the events' files."""
    from ..streaming import events as E

    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir + "/")
    feed = raw.select(F.col("user_id").cast("string").alias("path"), "event_id", "ts")
    return E.run_available(E.spike_stream(feed, "path", 3600, 3), shared_folder(t.spark, "latch"))


# records


@query("mft_enum", "SELECT ref, parent, name, CAST(CASE WHEN is_dir THEN 16 ELSE 32 END AS BIGINT) AS attributes FROM tree")
def _(t):
    rows = t.tree.select("ref", "parent", "name", F.when(F.col("is_dir"), 16).otherwise(32).cast("long").alias("a"))
    buffers = R.per_batch(rows, ["ref", "parent", "name", "a"], lambda *r: [(R.build_journal([r]),)], ["raw"], [pa.binary()], "raw binary")
    return R.journal_rows(buffers, "raw")


@query("data_run_decode", "SELECT id, pos, first, count FROM (SELECT id, 0 AS pos, lo + 1 AS first, cnt AS count FROM extents WHERE cnt > 0 UNION ALL SELECT id, 1, -1, lo + 1 FROM extents WHERE cnt > 0 UNION ALL SELECT id, 2, lo // 2, 300 FROM extents WHERE cnt > 0)")
def _(t):
    rows = t.extents.where("cnt > 0").select("id", "lo", "cnt")
    lists = R.per_batch(rows, ["id", "lo", "cnt"], lambda i, lo, n: [(i, R.build_runs([(lo + 1, n), (-1, lo + 1), (lo // 2, 300)]))], ["id", "raw"], [pa.int64(), pa.binary()], "id long, raw binary")
    return R.run_rows(lists, "id", "raw")


@query("pack_reader", "SELECT doc_id, sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents UNION ALL SELECT doc_id, sha256(lang), octet_length(encode(lang)) FROM documents")
def _(t):
    packs = R.per_batch(t.documents, ["doc_id", "text", "lang"], lambda k, *b: [(k, Z.write_pack([(x or "").encode() for x in b]))], ["doc_id", "raw"], [pa.int64(), pa.binary()], "doc_id long, raw binary")
    return R.pack_rows(packs, "doc_id", "raw")


@query("delta_patch", "SELECT doc_id, TRUE AS ok FROM documents")
def _(t):
    """A text with a small edit, stored as a patch from itself and read back."""

    def rows(k, text):
        base = (text or "").encode()
        data = base[: len(base) // 2] + b"edited" + base[len(base) // 2 :]
        codec, stored = Z.encode_delta(data, base)
        return [(k, Z.decode(codec, stored, base) == data and len(stored) <= len(data))]

    return R.per_batch(t.documents, ["doc_id", "text"], rows, ["doc_id", "ok"], [pa.int64(), pa.bool_()], "doc_id long, ok boolean")


@query("parity_repair", "SELECT item_id, TRUE AS ok FROM benchmark")
def _(t):
    """Parity of a text, with bytes of it broken and put right."""

    def rows(k, text):
        data = (text or "").encode()
        bad = bytearray(data)
        for at in range(3, len(bad), 128):
            bad[at] ^= 0x21
        return [(k, Z.repair(bytes(bad), Z.parity(data, 4), 4) == data)]

    return R.per_batch(t.benchmark, ["item_id", "text"], rows, ["item_id", "ok"], [pa.int64(), pa.bool_()], "item_id long, ok boolean")


@query("zero_ranges", "SELECT doc_id, sha256(unhex(repeat('00', CAST(least(10, octet_length(encode(text))) AS BIGINT)) || substr(hex(encode(text)), 21))) AS digest FROM documents")
def _(t):
    """The first ten bytes cleared, or all of a shorter text."""
    raw = F.col("text").cast("binary")
    zeros = F.unhex(F.repeat(F.lit("00"), F.least(F.lit(10), F.octet_length(raw))))
    return t.documents.select("doc_id", F.sha2(F.concat(zeros, F.substring(raw, 11, 1 << 30)), 256).alias("digest"))


@query("gpt_parse", "SELECT CAST(1 AS BIGINT) AS number, n_nationkey * 100 AS first, n_nationkey * 100 + 99 AS last, n_name AS name FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation)")
def _(t):
    import struct

    def slot(k, name):
        return struct.pack("<16s16sQQQ72s", b"\1" * 16, bytes(16), k * 100, k * 100 + 99, 0, name.encode("utf-16-le"))

    rows = lambda k, name: [(p["number"], p["first"], p["last"], p["name"]) for p in Z.partition_slots(slot(k, name))]
    return R.per_batch(t.nation, ["n_nationkey", "n_name"], rows, ["number", "first", "last", "name"], [pa.int64()] * 3 + [pa.string()], "number long, first long, last long, name string")


@query("layout_scan", "SELECT n_regionkey AS disk, CAST(n_nationkey AS BIGINT) AS number, CAST(n_nationkey * 10 AS BIGINT) AS \"offset\" FROM nation")
def _(t):
    """Signed layouts of disks, written and read again."""
    from ..sources import manifests as M

    parts = F.struct(F.col("n_nationkey").cast("long").alias("number"), (F.col("n_nationkey") * 10).cast("long").alias("offset"))
    lay = t.nation.groupBy(F.col("n_regionkey").alias("disk")).agg(F.collect_list(parts).alias("partitions"))
    folder = shared_folder(t.spark, "layouts")
    M.save(lay.select(F.lit(1).alias("schema_version"), F.lit(7).cast("long").alias("generation"), F.col("disk").cast("long").alias("disk"), "partitions"), folder, "store-key")
    return M.load(t.spark, folder, M.LAYOUT, "store-key", M.LAYOUT_VERSION).select("disk", F.inline("partitions"))


# trees


@query("path_walk", f"WITH RECURSIVE {PATHS} SELECT ref, upper(path) AS asked FROM p")
def _(t):
    """Paths looked up a segment at a time, ignoring case."""
    asked = G.full_paths(t.tree).select(F.upper("path").alias("asked"))
    return G.walk(t.tree, asked).select("ref", "asked")


@query("collect_tree", f"WITH RECURSIVE {PATHS} SELECT DISTINCT ref FROM p WHERE path = 'ASIA' OR path LIKE 'ASIA/%' OR path LIKE 'AFRICA/KENYA%'")
def _(t):
    """Several roots collected at once; overlaps count once."""
    paths = G.full_paths(t.tree)
    return G.subtree(paths, paths.where("path IN ('ASIA', 'ASIA/CHINA', 'AFRICA/KENYA')"))

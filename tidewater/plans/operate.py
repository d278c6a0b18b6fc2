"""Queries over change feeds, journals, policies and content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs as Z
from ..operators import policy as P
from ..operators import store as S
from ..sources.folders import shared_folder
from ..streaming import events as E
from .catalog import query

SESSIONS = """SELECT path, max(epoch_us(ts)) + 3600000000 AS due_us, count(*) AS events, arg_max(change_type, (ts, event_id)) AS change_type FROM (
  SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY path ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS new FROM changes)) GROUP BY path, s"""


@query("debounce", SESSIONS)
def _(t):
    return E.debounce(t.changes, "path", "1 hour")


@query("debounce_stream", f"SELECT * FROM ({SESSIONS}) WHERE due_us <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000")
def _(t):
    """The streaming form over the events' files; sessions that the watermark hasn't closed are left out."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir + "/")
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type") == "purchase", "Renamed").when(F.col("event_type") == "error", "Deleted").otherwise("Modified")
    stream = E.debounce_stream(raw.select("event_id", "ts", F.col("user_id").cast("string").alias("path"), kind.alias("change_type")), "path", "1 hour", "1 day")
    return E.run_available(stream, shared_folder(t.spark, "debounce"))


@query("last_event_wins", "SELECT path, arg_max(change_type, (ts, event_id)) AS change_type FROM changes GROUP BY path")
def _(t):
    return E.last_event_wins(t.changes, "path")


# a journal over the events: the file is the user, reasons by type
RECORDS = """SELECT user_id AS file_ref, event_id AS usn, 'n' || CAST(event_id AS VARCHAR) AS name, CASE event_type WHEN 'signup' THEN 256 WHEN 'purchase' THEN 4096 WHEN 'error' THEN 512 WHEN 'view' THEN 8192 ELSE 1 END + 2147483648 AS reason, CASE WHEN event_id % 6 = 0 THEN 16 ELSE 32 END AS attributes FROM events"""
KIND = "CASE WHEN reason & 512 <> 0 THEN 'Deleted' WHEN reason & 4096 <> 0 THEN 'RenameOld' WHEN reason & 8192 <> 0 THEN 'RenameNew' WHEN reason & 256 <> 0 THEN 'Created' WHEN reason & 16777079 <> 0 AND attributes & 16 = 0 THEN 'Modified' END"


def _records(t):
    reason = F.when(F.col("event_type") == "signup", 256).when(F.col("event_type") == "purchase", 4096).when(F.col("event_type") == "error", 512).when(F.col("event_type") == "view", 8192).otherwise(1).cast("long") + 2147483648
    return t.events.select(F.col("user_id").alias("file_ref"), F.col("event_id").alias("usn"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("name"), reason.alias("reason"), F.when(F.col("event_id") % 6 == 0, 16).otherwise(32).cast("long").alias("attributes"), "ts")


@query("journal_source", f"SELECT usn, file_ref, name FROM ({RECORDS}) WHERE usn > 400 AND reason & 16777079 <> 0")
def _(t):
    return E.journal_read(_records(t), 400).select("usn", "file_ref", "name")


@query("journal_stream", f"SELECT usn, file_ref, name FROM ({RECORDS}) WHERE usn > 400 AND reason & 16777079 <> 0")
def _(t):
    """The journal written as segments, and read as a stream from a cursor on."""
    from ..streaming import journal

    folder = shared_folder(t.spark, "journal")
    rows = _records(t).select("usn", "file_ref", F.lit(5).cast("long").alias("parent_ref"), "reason", "attributes", "name")
    journal.write(rows, f"{folder}/log", "j")
    stream = E.journal_read(journal.read_journal(t.spark, f"{folder}/log", cursor=("j", 400)), 400).select("usn", "file_ref", "name")
    return E.run_available(stream, f"{folder}/run", drain=True)


@query("journal_reason_filter", f"SELECT usn, reason & 4352 <> 0 AS watched FROM ({RECORDS})")
def _(t):
    return _records(t).select("usn", (F.col("reason").bitwiseAND(F.lit(4352).cast("long")) != 0).alias("watched"))


@query("journal_translate", f"SELECT usn, {KIND} AS kind FROM ({RECORDS})")
def _(t):
    return _records(t).select("usn", E.reason_type(F.col("reason"), F.col("attributes")).alias("kind"))


# the file's state goes from record to record: the stashed old name and whether it was renamed
PAIRS = f"""WITH RECURSIVE k AS (SELECT *, row_number() OVER (PARTITION BY file_ref ORDER BY usn) AS n FROM (SELECT *, {KIND} AS kind FROM ({RECORDS})) WHERE kind IS NOT NULL),
s AS (SELECT file_ref, usn, name, kind, n, CASE WHEN kind = 'RenameOld' THEN name END AS stash, FALSE AS renamed, CAST(NULL AS VARCHAR) AS old_name, CASE kind WHEN 'RenameNew' THEN 'Created' WHEN 'RenameOld' THEN NULL ELSE kind END AS change_type FROM k WHERE n = 1
  UNION ALL SELECT k.file_ref, k.usn, k.name, k.kind, k.n, CASE WHEN k.kind = 'RenameOld' THEN k.name WHEN k.kind NOT IN ('RenameNew', 'Deleted') THEN s.stash END, k.kind <> 'Deleted' AND (s.renamed OR k.kind = 'RenameNew' AND s.stash IS NOT NULL), CASE WHEN k.kind = 'RenameNew' THEN s.stash END,
    CASE k.kind WHEN 'RenameNew' THEN CASE WHEN s.stash IS NOT NULL THEN 'Renamed' WHEN NOT s.renamed THEN 'Created' END WHEN 'RenameOld' THEN NULL WHEN 'Created' THEN CASE WHEN NOT s.renamed THEN 'Created' END ELSE k.kind END
  FROM s JOIN k ON k.file_ref = s.file_ref AND k.n = s.n + 1)
SELECT file_ref, usn, name, old_name, change_type FROM s WHERE change_type IS NOT NULL"""


@query("rename_pairing", PAIRS)
def _(t):
    return E.rename_pairs(_records(t))


@query("watched_parent_prefilter", f"SELECT usn FROM ({RECORDS}) WHERE file_ref IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def _(t):
    watched = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("file_ref"))
    return _records(t).join(watched, "file_ref", "left_semi").select("usn")


@query("sweep_debounced", "SELECT path, CASE WHEN path IN (SELECT path FROM inventory) THEN 'Modified' ELSE 'Deleted' END AS change_type FROM previous WHERE path IN (SELECT path FROM inventory) OR path NOT LIKE '/src/stale/%'")
def _(t):
    from ..functions.paths import parent_dir

    parents = t.inventory.select(parent_dir(F.col("path")).alias("parent")).distinct()
    return E.sweep(t.previous.select("path", parent_dir(F.col("path")).alias("parent")), t.inventory, parents)


@query("deletion_batching", """SELECT arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS files, count(DISTINCT path) AS paths FROM (SELECT *, sum(CASE WHEN change_type <> 'Deleted' THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM changes) WHERE change_type = 'Deleted' GROUP BY run""")
def _(t):
    return E.delete_batches(t.changes)


@query("checkpoint_points", "SELECT epoch_us(ts) // 30000000 AS span, max(event_id) AS cursor FROM events GROUP BY 1")
def _(t):
    return E.checkpoint_points(t.events)


@query("gap_covering_scan", """SELECT min(epoch_us(ts)) AS start_us, count(*) AS requests FROM (SELECT ts, sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) <= 600000000 THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'error')) GROUP BY s""")
def _(t):
    return E.gap_scans(t.events.where("event_type = 'error'"), 600)


@query("unresolved_delete_gap", "SELECT event_id FROM changes WHERE change_type = 'Deleted' AND CAST(path AS BIGINT) NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(t):
    known = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("path"))
    return t.changes.where("change_type = 'Deleted'").join(known, "path", "left_anti").select("event_id")


# policies


@query("type_policies", "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'keep' WHEN doc_id % 7 = 0 THEN 'skip' WHEN lang = 'de' THEN 'full' ELSE 'incremental' END AS policy FROM documents")
def _(t):
    n = F.col("doc_id")
    p = P.capture_policy(F.when(F.col("lang") == "de", "ReFS").otherwise("NTFS"), F.when(n % 7 == 0, 0x1000).otherwise(0x20).cast("long"), F.when(n % 50 == 0, "$LogFile").otherwise("a.txt"))
    return t.documents.select("doc_id", p.alias("policy"))


@query("health_predicate", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'fault' WHEN doc_id % 4 > 0 AND n_chars > 2000 THEN 'stalled' ELSE 'ok' END AS health FROM documents")
def _(t):
    return t.documents.select("doc_id", P.health(F.col("doc_id") % 9 == 0, F.col("doc_id") % 4, F.col("n_chars"), 2000).alias("health"))


@query("stamp_sentinel", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'empty' ELSE 'dead' END AS state FROM documents")
def _(t):
    d = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, "").otherwise("dead")
    return t.documents.select("doc_id", P.sentinel(d).alias("state"))


@query("duplicate_keys", "SELECT hash, count(*) AS n FROM inventory GROUP BY hash HAVING count(*) > 1")
def _(t):
    return P.duplicates(t.inventory, "hash")


@query("distinct_keys", "SELECT DISTINCT hash FROM inventory")
def _(t):
    return t.inventory.select("hash").distinct()


_CONFIG = "(SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS pos FROM region)"


@query("exclusion_merge", "SELECT arg_min(name, (side, pos)) AS name FROM (SELECT n_name AS name, 0 AS side, n_nationkey AS pos FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT lower(n_name), 1, n_nationkey FROM nation) GROUP BY lower(name)")
def _(t):
    a = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    b = t.nation.select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    log = t.spark.range(1).select(F.lit("$LogFile").alias("name"), F.lit(99).alias("pos"))
    return P.merge_exclusions(a, b.unionByName(log))


@query("exclusion_set_changed", "SELECT TRUE AS changed FROM nation WHERE n_nationkey = 1")
def _(t):
    n = t.nation.select(F.col("n_name").alias("name"))
    return P.exclusions_changed(n, t.nation.where("n_nationkey <> 1").select(F.lower("n_name").alias("name")))


@query("partition_subset", "SELECT number, kind FROM (SELECT n_nationkey AS number, CASE WHEN n_nationkey % 5 = 0 THEN 'auto' WHEN n_nationkey % 3 = 0 THEN 'selected' END AS kind FROM nation UNION ALL SELECT n_nationkey + 100, 'unknown' FROM nation WHERE n_nationkey % 3 = 1) WHERE kind IS NOT NULL")
def _(t):
    known = t.nation.select(F.col("n_nationkey").alias("number"), (F.col("n_nationkey") % 5 == 0).alias("skipped"))
    asked = t.nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("number")).union(t.nation.where("n_nationkey % 3 = 1").select(F.col("n_nationkey") + 100))
    return P.select_partitions(known, asked)


LAST = "(SELECT max(doc_id) // 2 FROM documents)"


@query("skip_record_gate", f"SELECT doc_id AS no FROM documents WHERE (doc_id % 7 = 0 AND doc_id <= {LAST} OR doc_id > {LAST}) AND doc_id % 3 <> 0 AND doc_id % 10 <> 4")
def _(t):
    """The parent has the first half of the records, a seventh of them with another digest."""
    last = t.documents.agg(F.floor(F.max("doc_id") / 2).alias("last"))
    digest = F.when(F.col("doc_id") % 10 == 4, F.lit("dead")).otherwise(F.sha2("text", 256))
    now = t.documents.select(F.col("doc_id").alias("no"), digest.alias("digest"))
    half = t.documents.join(F.broadcast(last), F.col("doc_id") <= F.col("last"))
    was = half.select(F.col("doc_id").alias("no"), F.when(F.col("doc_id") % 10 == 4, "dead").when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("digest"))
    return P.record_gate(was, now, t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("no")))


@query("random_sample")
def _(t):
    return P.random_sample(t.state.select("path", "size"), 25, 7)


@query("sorted_first_n", "SELECT path, size FROM inventory ORDER BY path LIMIT 100")
def _(t):
    return t.inventory.select("path", "size").orderBy("path").limit(100)


@query("pack_rows_by_offset", "SELECT digest, pack, pack_offset, row_number() OVER (PARTITION BY pack ORDER BY pack_offset) AS rn FROM chunk_index")
def _(t):
    from pyspark.sql import Window

    return t.chunk_index.select("digest", "pack", "pack_offset", F.row_number().over(Window.partitionBy("pack").orderBy("pack_offset")).cast("long").alias("rn"))


@query("budget_prune", """WITH f AS (SELECT generation, CAST(sum(size) AS BIGINT) AS freed FROM (SELECT digest, max(size) AS size, max(generation) AS generation FROM entries WHERE NOT is_hole GROUP BY digest) GROUP BY 1),
g AS (SELECT generation, coalesce(freed, 0) AS freed FROM (SELECT DISTINCT generation FROM entries) LEFT JOIN f USING (generation))
SELECT generation FROM (SELECT generation, (SELECT sum(freed) FROM g) - coalesce(sum(freed) OVER (ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM g) WHERE rest > 40000 AND generation < (SELECT max(generation) FROM g)""")
def _(t):
    return P.prune_oldest(t.entries, 40_000)


RUNS = "(SELECT vol AS file, id AS seq, CASE WHEN id % 4 = 0 THEN -1 ELSE lo END AS lcn, cnt AS count FROM extents WHERE cnt > 0)"


@query("vcn_to_lcn", f"""WITH r AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM {RUNS}), w AS (SELECT DISTINCT file, seq % 997 AS vcn FROM {RUNS})
SELECT w.file, w.vcn, CASE WHEN lcn >= 0 THEN CAST(lcn + vcn - first AS BIGINT) END AS lcn FROM w JOIN r ON w.file = r.file AND vcn >= first AND vcn < first + count""")
def _(t):
    r = t.extents.where("cnt > 0").select(F.col("vol").alias("file"), F.col("id").alias("seq"), F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("lo")).alias("lcn"), F.col("cnt").alias("count"))
    return P.vcn_to_lcn(r, r.select("file", (F.col("seq") % 997).alias("vcn")).distinct())


@query("crash_temp_recovery", """SELECT t.rel, CASE WHEN d.rel IS NULL AND (i.path IS NULL OR (i.size = t.size AND i.hash = t.hash)) THEN 'recover' ELSE 'delete' END AS action FROM (SELECT substr(path, 6) AS rel, size, hash FROM previous) t
LEFT JOIN inventory i ON substr(i.path, 6) = t.rel LEFT JOIN (SELECT rel FROM dest) d ON d.rel = t.rel""")
def _(t):
    rel = F.expr("substr(path, 6)").alias("rel")
    return P.crash_recovery(t.previous.select(rel, "size", "hash"), t.inventory.select(rel, "size", "hash"), t.dest)


@query("tool_output_parse", "SELECT doc_id AS id, CAST(1 AS BIGINT) AS line, 'State' AS key, lang AS value FROM documents UNION ALL SELECT doc_id, 2, 'Size', CAST(n_chars AS VARCHAR) FROM documents")
def _(t):
    text = F.concat(F.lit("Header line\r\n  State : "), F.col("lang"), F.lit("\r\nSize:"), F.col("n_chars").cast("string"), F.lit(" \n"))
    return P.key_value_lines(t.documents.select(F.col("doc_id").alias("id"), text.alias("t")), "t")


@query("legacy_batches", "SELECT path, arg_min(event_id, f) AS clock, min(f) AS file FROM (SELECT path, event_id, lpad(CAST(event_id AS VARCHAR), 8, '0') || '.json' AS f FROM changes) GROUP BY path")
def _(t):
    return P.adopt_batches(t.changes.select("path", F.col("event_id").alias("clock"), F.concat(F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".json")).alias("file")))


@query("rotation_state", """SELECT CAST(n_nationkey AS BIGINT) AS store, 'd' || CAST(c_custkey AS VARCHAR) AS id, c_name AS label, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2026-01-01' + to_days(CAST(c_custkey % 200 AS INT)) END AS last_backup FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def _(t):
    """A rotation file a store, written and read again."""
    at = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.date_format(F.lit("2026-01-01").cast("timestamp_ntz") + F.make_interval(days=(F.col("c_custkey") % 200).cast("int")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("")
    drive = F.struct(F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("Id"), F.col("c_name").alias("Label"), F.lit("").alias("LastSeenUtc"), at.alias("LastBackupUtc"))
    files = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("store")).agg(F.to_json(F.struct(F.lit(1).alias("SchemaVersion"), F.collect_list(drive).alias("Drives"))).alias("json"))
    return P.rotation_state(files, "store", "json")


# content


@query("buzhash_chunk")
def _(t):
    return Z.cdc_chunks(t.documents, 1024)


@query("zstd_roundtrip")
def _(t):
    return Z.compressed(t.documents)


@query("pack_assign", """WITH RECURSIVE b AS (SELECT digest % 4 AS writer, digest AS seq, stored, row_number() OVER (PARTITION BY digest % 4 ORDER BY digest) AS k FROM chunk_index),
r AS (SELECT writer, seq, k, CAST(0 AS BIGINT) AS pack, 41 + stored AS used FROM b WHERE k = 1
  UNION ALL SELECT b.writer, b.seq, b.k, CASE WHEN r.used + 41 + b.stored > 2000 THEN r.pack + 1 ELSE r.pack END, CASE WHEN r.used + 41 + b.stored > 2000 THEN 41 + b.stored ELSE r.used + 41 + b.stored END FROM r JOIN b ON b.writer = r.writer AND b.k = r.k + 1)
SELECT writer, seq, pack FROM r""")
def _(t):
    return Z.pack_assign(t.chunk_index.select((F.col("digest") % 4).alias("writer"), F.col("digest").alias("seq"), "stored"), 2000)


@query("cdc_dedup")
def _(t):
    c = Z.cdc_chunks(t.documents, 1024)
    return c.groupBy("digest").agg(F.count("*").alias("uses"), F.min("length").alias("length")).where("uses > 1")


@query("all_zero", "SELECT doc_id, doc_id % 4 = 0 AS zero FROM documents")
def _(t):
    part = F.when(F.col("doc_id") % 4 == 0, F.unhex(F.repeat(F.lit("00"), 16))).otherwise(F.unhex(F.concat(F.repeat(F.lit("00"), 15), F.lit("01"))))
    return t.documents.select("doc_id", (part == F.unhex(F.repeat(F.lit("00"), F.octet_length(part)))).alias("zero"))


@query("landing_fold", "SELECT DISTINCT digest FROM entries WHERE NOT is_hole AND digest % 46 = 0 AND digest NOT IN (SELECT digest FROM chunk_index)")
def _(t):
    landing = t.entries.where("NOT is_hole AND digest % 46 = 0").select("digest").distinct()
    return landing.join(t.chunk_index.select("digest"), "digest", "left_anti")


@query("landing_drop", "SELECT p_partkey AS digest FROM part WHERE p_partkey % 46 = 0 AND p_partkey NOT IN (SELECT digest FROM entries WHERE generation % 64 = 1 AND NOT is_hole)")
def _(t):
    live = S.live_digests(t.entries.withColumn("base", F.lit(None).cast("long")), t.manifests.where("generation % 64 = 1"))
    return t.part.where("p_partkey % 46 = 0").select(F.col("p_partkey").alias("digest")).join(live, "digest", "left_anti")

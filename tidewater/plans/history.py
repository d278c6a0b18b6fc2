"""Queries over versions, delete batches, churn, holds and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import history as H
from ..sources.domain import EPOCH_2026
from .catalog import query

NOW = "2001-08-01 00:00:00"
DAY_TICKS = 864_000_000_000


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


RANKED = "SELECT grp, id, stamp, pinned, row_number() OVER (PARTITION BY grp ORDER BY stamp DESC NULLS FIRST, id DESC) AS rn FROM versions"


def _gfs(fmt: str, n: int) -> str:
    return f"""SELECT grp, id FROM (SELECT grp, id, dense_rank() OVER (PARTITION BY grp ORDER BY b DESC) AS k FROM (
  SELECT grp, strftime(stamp, '{fmt}') AS b, arg_max(id, (stamp, id)) AS id FROM versions WHERE stamp IS NOT NULL AND NOT pinned GROUP BY ALL)) WHERE k <= {n}"""


def _one(condition: str) -> str:
    return f"SELECT grp, id, CASE WHEN pinned THEN 'pinned' WHEN stamp IS NULL THEN 'unparseable-name' WHEN {condition} ELSE 'beyond-retention' END AS reason, pinned OR stamp IS NULL OR {condition.split(' THEN ')[0]} AS keep FROM ({RANKED})"


@query("keep_last", _one("rn <= 3 THEN 'keep-last'"))
def _(t):
    return H.retention(t.versions, _now(), keep_last=3)


@query("keep_within", _one(f"stamp >= TIMESTAMP '{NOW}' - INTERVAL 300 DAY THEN 'keep-within'"))
def _(t):
    return H.retention(t.versions, _now(), keep_within_days=300)


for _name, _fmt in {"keep_daily": "%Y-%m-%d", "keep_weekly": "%G-W%V", "keep_monthly": "%Y-%m"}.items():

    @query(_name, f"WITH g AS ({_gfs(_fmt, 2)}) " + _one("(grp, id) IN (SELECT grp, id FROM g) THEN '" + _name.replace("_", "-") + "'"))
    def _(t, policy=_name):
        return H.retention(t.versions, _now(), **{policy: 2})


@query("retention_decide", f"""WITH d AS ({_gfs('%Y-%m-%d', 2)}), w AS ({_gfs('%G-W%V', 3)}), m AS ({_gfs('%Y-%m', 4)})
SELECT grp, id, reason, reason <> 'beyond-retention' AS keep FROM (SELECT grp, id, CASE WHEN pinned THEN 'pinned' WHEN stamp IS NULL THEN 'unparseable-name' WHEN rn <= 2 THEN 'keep-last'
  WHEN stamp >= TIMESTAMP '{NOW}' - INTERVAL 200 DAY THEN 'keep-within' WHEN (grp, id) IN (SELECT grp, id FROM d) THEN 'keep-daily' WHEN (grp, id) IN (SELECT grp, id FROM w) THEN 'keep-weekly'
  WHEN (grp, id) IN (SELECT grp, id FROM m) THEN 'keep-monthly' ELSE 'beyond-retention' END AS reason FROM ({RANKED}))""")
def _(t):
    return H.retention(t.versions, _now(), keep_last=2, keep_within_days=200, keep_daily=2, keep_weekly=3, keep_monthly=4)


@query("retention_exemption", "SELECT grp, id, pinned OR stamp IS NULL AS exempt FROM versions")
def _(t):
    return t.versions.select("grp", "id", (F.col("pinned") | F.col("stamp").isNull()).alias("exempt"))


@query("latest_n", "SELECT grp, id, rn FROM (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY stamp DESC NULLS LAST, id DESC) AS rn FROM versions) WHERE rn <= 5")
def _(t):
    return H.latest(t.versions, 5).select("grp", "id", "rn")


@query("version_row", "SELECT id, 'cust' || CAST(grp AS VARCHAR) || '/' || CAST(id AS VARCHAR) AS display, strftime(stamp, '%Y-%m-%d %H:%M:%S') AS stamp, 'cust' || CAST(grp AS VARCHAR) AS group_key FROM versions")
def _(t):
    key = F.concat(F.lit("cust"), F.col("grp").cast("string"))
    return t.versions.select("id", F.concat(key, F.lit("/"), F.col("id").cast("string")).alias("display"), F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"), key.alias("group_key"))


@query("digit_prefix_pin_match", "SELECT id, starts_with(strftime(stamp, '%Y%m%d%H%M%S') || '000', '199803') AS pinned FROM versions WHERE stamp IS NOT NULL")
def _(t):
    return t.versions.where("stamp IS NOT NULL").select("id", H.pin_match(F.col("stamp"), "1998-03").alias("pinned"))


@query("versions_json", """SELECT id, '{"source":"s' || CAST(grp AS VARCHAR) || '","file":"' || CAST(id AS VARCHAR) || '","timestamp":"' || strftime(stamp, '%Y-%m-%d') || '","size":' || CAST(id % 1000 AS VARCHAR) || ',"pinned":' || CAST(pinned AS VARCHAR) || '}' AS json FROM versions WHERE stamp IS NOT NULL""")
def _(t):
    from ..operators.present import versions_json

    v = t.versions.where("stamp IS NOT NULL").select("id", F.concat(F.lit("s"), F.col("grp").cast("string")).alias("source"), F.col("id").cast("string").alias("file"), F.date_format("stamp", "yyyy-MM-dd").alias("timestamp"), (F.col("id") % 1000).alias("size"), "pinned")
    return versions_json(v)


@query("version_archive", "SELECT id, '/dst/.versions/' || CAST(grp AS VARCHAR) || '/doc_' || strftime(stamp, '%Y%m%d_%H%M%S') || '_000_' || md5(CAST(id AS VARCHAR)) || '.txt' AS target, rn > 3 AND NOT pinned AS prune FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY stamp DESC NULLS FIRST, id DESC) AS rn FROM versions) WHERE stamp IS NOT NULL")
def _(t):
    kept = H.retention(t.versions, _now(), keep_last=3).select("id", (~F.col("keep")).alias("prune"))
    name = F.concat(F.lit("/dst/.versions/"), F.col("grp").cast("string"), F.lit("/doc_"), F.date_format("stamp", "yyyyMMdd_HHmmss_SSS"), F.lit("_"), F.md5(F.col("id").cast("string")), F.lit(".txt"))
    return t.versions.where("stamp IS NOT NULL").join(kept, "id").select("id", name.alias("target"), "prune")


@query("gc_roots", f"""SELECT generation FROM (SELECT *, row_number() OVER (ORDER BY generation DESC) AS rn FROM manifests) WHERE rn <= 50 OR created >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY OR generation IN (1, 2, 999999999)""")
def _(t):
    return H.gc_roots(t.manifests, _now(), keep_last=50, keep_days=30, pins=[1, 2, 999999999])


# delete guard

DELETES = "SELECT path AS batch, event_id, bytes, event_id % 7 AS dir_no FROM changes WHERE change_type = 'Deleted'"


def _deletes(t):
    d = t.changes.where("change_type = 'Deleted'")
    return d.select(F.col("path").alias("batch"), F.when(F.col("event_id") % 3 != 0, F.col("bytes")).otherwise(0).alias("size"), (F.col("event_id") * 11).alias("dest_size"), F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string")).alias("dir"))


PROBE = f"SELECT batch, count(*) AS files, CAST(sum(CASE WHEN event_id % 3 <> 0 AND bytes <> 0 THEN bytes ELSE event_id * 11 END) AS BIGINT) AS bytes FROM ({DELETES}) GROUP BY batch"


@query("batch_probe", PROBE)
def _(t):
    return H.batch_probe(_deletes(t))


BASELINE = "CASE WHEN CAST(batch AS BIGINT) % 4 <> 0 THEN 5 + CAST(batch AS BIGINT) END"


@query("delete_guard", f"""SELECT batch, files, bytes, CASE WHEN files >= 20 THEN 'count' WHEN bytes >= 1073741 THEN 'bytes' WHEN baseline IS NULL THEN 'unknown-baseline' WHEN baseline > 50 AND 100.0 * files / baseline >= 12 THEN CASE WHEN files > baseline THEN 'percent-dead-rows' ELSE 'percent' END END AS reason
FROM (SELECT *, {BASELINE} AS baseline FROM ({PROBE}))""")
def _(t):
    probe = H.batch_probe(_deletes(t)).withColumn("baseline", F.expr(BASELINE))
    return H.delete_guard(probe, count=20, gigabytes=0.001, percent=12)


LOCAL = f"SELECT batch, arg_min('d' || CAST(dir_no AS VARCHAR), (-n, dir_no)) AS dir, max(n) / sum(n) AS share, CAST(sum(n) AS BIGINT) AS total FROM (SELECT batch, dir_no, count(*) AS n FROM ({DELETES}) GROUP BY ALL) GROUP BY batch"


@query("locality_share", LOCAL)
def _(t):
    return H.locality(_deletes(t)).select("batch", "dir", "share", "total")


@query("bulk_cleanup", f"SELECT batch, coalesce(share * 100 >= 25 AND total <= baseline AND total >= 10, FALSE) AS cleanup FROM (SELECT *, {BASELINE} AS baseline FROM ({LOCAL}))")
def _(t):
    return H.bulk_cleanup(H.locality(_deletes(t)).withColumn("baseline", F.expr(BASELINE)), 25)


@query("mirror_delete", "SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'archive' END AS action, CASE WHEN doc_id % 3 <> 0 THEN '/dst/.archive/' || substr(path, 6) END AS target FROM previous WHERE path NOT IN (SELECT path FROM inventory)")
def _(t):
    from ..operators.deletion import delete_plan

    gone = t.previous.join(t.inventory, "path", "left_anti").select("path", F.when(F.col("doc_id") % 3 == 0, "mirror").when(F.col("doc_id") % 3 == 1, "archive").otherwise("odd").alias("mode"))
    return delete_plan(gone, "/src", "/dst")


# churn

SPIKES = """SELECT e.path, e.event_id, epoch_us(e.ts) AS us, count(*) AS files, CAST(sum(b.bytes) AS BIGINT) AS bytes, count(*) FILTER (b.change_type = 'Renamed') AS renames
  FROM changes e JOIN changes b ON b.path = e.path AND (b.ts, b.event_id) <= (e.ts, e.event_id) AND b.ts >= e.ts - INTERVAL 3600 SECOND GROUP BY e.path, e.event_id, e.ts"""


@query("spike_guard", f"SELECT path, event_id, files, bytes, renames, files >= 3 OR renames >= 2 AS tripped FROM ({SPIKES})")
def _(t):
    return H.spike_guard(t.changes, "path", 3600, files=3, renames=2)


@query("gap_storm", "SELECT path, event_id, n FROM (SELECT path, event_id, count(*) OVER (PARTITION BY path ORDER BY epoch_us(ts) RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW) AS n FROM changes) WHERE n >= 3")
def _(t):
    return H.gap_storm(t.changes, "path", count=3, seconds=36000)


@query("throttle", """WITH RECURSIVE e AS (SELECT path, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS k FROM changes),
r AS (SELECT path, event_id, us, k, us AS last, TRUE AS keep FROM e WHERE k = 1 UNION ALL SELECT e.path, e.event_id, e.us, e.k, CASE WHEN e.us - r.last >= 86400000000 THEN e.us ELSE r.last END, e.us - r.last >= 86400000000 FROM r JOIN e ON e.path = r.path AND e.k = r.k + 1)
SELECT event_id FROM r WHERE keep""")
def _(t):
    return H.throttle(t.changes, "path", 86400)


# holds


def _incoming(t):
    return t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("path_key"))


INC = "(SELECT o_orderkey AS path_key FROM orders WHERE o_orderkey % 5 = 0)"


@query("pending_classify", f"SELECT i.path_key, CASE WHEN p.path_key IS NULL THEN 'new' WHEN p.claimed THEN 'reblocked' ELSE 'held' END AS state FROM {INC} i LEFT JOIN pending p ON i.path_key = p.path_key")
def _(t):
    return H.classify_pending(_incoming(t), t.pending)


@query("insert_or_ignore", f"""SELECT path_key, batch_id, claimed FROM pending WHERE NOT (claimed AND path_key % 5 = 0)
UNION ALL SELECT path_key, 999999, FALSE FROM {INC} i WHERE path_key NOT IN (SELECT path_key FROM pending WHERE NOT claimed)""")
def _(t):
    return H.insert_or_ignore(t.pending, _incoming(t), 999999)


MID = EPOCH_2026 + 700 * 36_000_000_000


@query("claim_chunk", f"SELECT p.path_key, p.batch_id FROM pending p JOIN holds h ON p.batch_id = h.batch_id WHERE NOT claimed AND h.blocked_at <= {MID} ORDER BY h.blocked_at, p.batch_id, p.path_key LIMIT 500")
def _(t):
    return H.claim(t.pending, t.holds, MID)


@query("claim_confirm", f"SELECT path_key, batch_id, claimed FROM pending WHERE NOT (claimed AND path_key IN (SELECT path_key FROM {INC}))")
def _(t):
    return H.confirm(t.pending, _incoming(t)).select("path_key", "batch_id", "claimed")


@query("hold_summary", "SELECT h.batch_id, h.blocked_at, count(*) AS files, count(*) FILTER (claimed) AS claimed FROM holds h JOIN pending p ON h.batch_id = p.batch_id GROUP BY ALL")
def _(t):
    return H.hold_summary(t.holds, t.pending)


@query("next_due", f"""SELECT pipeline, greatest({MID}, min(CASE WHEN expiry <= {MID} THEN expiry ELSE least(expiry, CASE WHEN coalesce(last_warning_at, 0) = 0 THEN {MID} ELSE last_warning_at + {20 * DAY_TICKS} END) END)) AS next_due
FROM (SELECT *, batch_id % 400 AS pipeline, blocked_at + {30 * DAY_TICKS} AS expiry FROM holds) GROUP BY pipeline""")
def _(t):
    return H.next_due(t.holds.withColumn("pipeline", F.col("batch_id") % 400), 30 * DAY_TICKS, 20 * DAY_TICKS, MID, "pipeline")


@query("earliest_expiry", "SELECT batch_id, blocked_at FROM holds ORDER BY blocked_at, batch_id LIMIT 1")
def _(t):
    return t.holds.orderBy("blocked_at", "batch_id").limit(1).select("batch_id", "blocked_at")


@query("hold_clock", f"""SELECT p.path_key, CASE WHEN h.batch_id % 11 = 0 THEN 'wait' WHEN e.path_key IS NOT NULL THEN 'cancel' WHEN h.blocked_at + {DAY_TICKS} <= {MID} THEN 'delete' ELSE 'wait' END AS action FROM pending p JOIN holds h ON p.batch_id = h.batch_id LEFT JOIN {INC} e ON e.path_key = p.path_key""")
def _(t):
    return H.hold_clock(t.holds.withColumn("source_there", F.col("batch_id") % 11 != 0), t.pending, _incoming(t), MID, DAY_TICKS)


@query("hold_warnings", f"SELECT batch_id, blocked_at + {30 * DAY_TICKS} - {MID} AS \"left\" FROM holds WHERE blocked_at + {30 * DAY_TICKS} > {MID} AND last_warning_at + {DAY_TICKS} <= {MID}")
def _(t):
    return H.hold_warnings(t.holds, MID, 30 * DAY_TICKS, DAY_TICKS)


@query("cancel_on_restore", f"SELECT path_key, batch_id FROM pending WHERE path_key NOT IN (SELECT path_key FROM {INC})")
def _(t):
    return t.pending.join(_incoming(t), "path_key", "left_anti").select("path_key", "batch_id")


# schedules

_SLOT = "date_trunc('day', now) + INTERVAL 9 HOUR"
_JOBS = "(SELECT o_orderkey AS id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) AS now, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate - to_hours(CAST(o_orderkey % 240 AS INT)) END AS last, o_orderdate - to_days(CAST(o_orderkey % 3 AS INT)) AS run_date FROM orders)"


def _jobs(t):
    k = F.col("o_orderkey")
    now, last = F.col("o_orderdate") + F.make_interval(hours=(k % 24).cast("int")), F.when(k % 11 != 0, F.col("o_orderdate") - F.make_interval(hours=(k % 240).cast("int")))
    return t.orders.select(k.alias("id"), now.alias("now"), last.alias("last"), (F.col("o_orderdate") - F.make_interval(days=(k % 3).cast("int"))).alias("run_date"))


def _due(name: str, rule: str, **how):
    @query(name, f"SELECT id, {rule} AS due FROM {_JOBS}")
    def _(t):
        return _jobs(t).select("id", H.due(F.col("now"), F.col("last"), run_date=F.col("run_date"), **how).alias("due"))


_DAY, _TODAY = "date_trunc('day', {})", "(last IS NULL OR last < date_trunc('day', now))"
DAILY = f"{_TODAY} AND (now >= {_SLOT} OR coalesce(last < date_trunc('day', now) - INTERVAL 1 DAY, TRUE))"
_due("due_daily", DAILY, kind="daily", hour=9)
_due("due_daily_skip", f"{_TODAY} AND now >= {_SLOT}", kind="daily", hour=9, catch_up=False)
# the day of the last run against the day of the latest moment
_WEEK = f"({_SLOT} - to_days(CAST((dayofweek(now) + 1) % 7 AS INT)))"
_due("due_weekly", f"coalesce({_DAY.format('last')} < {_DAY.format(f'(CASE WHEN now >= {_WEEK} THEN {_WEEK} ELSE {_WEEK} - INTERVAL 7 DAY END)')}, TRUE)", kind="weekly", hour=9, weekday=6)
_due("due_weekly_skip", f"{_TODAY} AND dayofweek(now) = 6 AND now >= {_SLOT}", kind="weekly", hour=9, weekday=6, catch_up=False)
_due("due_weekday_mask", f"coalesce({_DAY.format('last')} < {_DAY.format(f'(SELECT max(m) FROM (SELECT {_SLOT} - to_days(CAST(n AS INT)) AS m FROM range(8) AS r(n)) WHERE m <= now AND dayofweek(m) BETWEEN 1 AND 5)')}, TRUE)", kind="weekdays", hour=9, mask=0b0111110)
_due("due_weekday_mask_skip", f"{_TODAY} AND dayofweek(now) BETWEEN 1 AND 5 AND now >= {_SLOT}", kind="weekdays", hour=9, mask=0b0111110, catch_up=False)
_MONTH = "least(date_trunc('month', {d}) + INTERVAL 30 DAY, date_trunc('day', last_day({d}))) + INTERVAL 9 HOUR"
_THIS, _BEFORE = _MONTH.format(d="now"), _MONTH.format(d="(date_trunc('month', now) - INTERVAL 1 DAY)")
_due("due_monthly", f"coalesce({_DAY.format('last')} < {_DAY.format(f'(CASE WHEN now >= {_THIS} THEN {_THIS} ELSE {_BEFORE} END)')}, TRUE)", kind="monthly", hour=9, day=31)
_due("due_monthly_skip", f"{_TODAY} AND {_DAY.format(_THIS)} = {_DAY.format('now')} AND now >= {_SLOT}", kind="monthly", hour=9, day=31, catch_up=False)
_due("due_once", "last IS NULL AND now >= run_date + INTERVAL 9 HOUR", kind="once", hour=9)
_due("due_once_skip", "last IS NULL AND now >= run_date + INTERVAL 9 HOUR AND date_trunc('day', now) = run_date", kind="once", hour=9, catch_up=False)


@query("due_interval", f"SELECT id, last IS NULL OR epoch(now) - epoch(last) >= 360000 AS due FROM {_JOBS}")
def _(t):
    return _jobs(t).select("id", H.due(F.col("now"), F.col("last"), "interval", seconds=360_000).alias("due"))


@query("overlap_decision", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'start' WHEN doc_id % 3 = 0 THEN 'chain' ELSE 'skip' END AS decision FROM documents")
def _(t):
    n = F.col("doc_id")
    return t.documents.select("doc_id", H.overlap(n % 2 == 1, F.when(n % 3 == 0, "chain").otherwise("skip")).alias("decision"))


@query("rotation_check", f"SELECT count(*) AS drives, bool_or(age <= 30) AS any_fresh, bool_or(age >= 90) AS any_deep, count(*) FILTER (coalesce(age > 30, TRUE)) AS overdue FROM (SELECT o_custkey, date_diff('day', max(o_orderdate), TIMESTAMP '{NOW}') AS age FROM orders GROUP BY o_custkey)")
def _(t):
    drives = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_backup"))
    return H.rotation(drives, _now(), 30)


@query("job_counters", "SELECT CAST(user_id AS VARCHAR) AS name, CAST(arg_max(event_id, (ts, event_id)) AS BIGINT) AS value FROM events GROUP BY user_id")
def _(t):
    from ..operators.stamps import keyed_replace

    new = t.changes.select(F.col("path").alias("name"), F.col("event_id").alias("value"), F.struct("ts", "event_id").alias("seq"))
    return keyed_replace(new.where("false").select("name", "value"), new)

"""Versions, retention, guards on deletes, churn, holds, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def retention(versions: DataFrame, now: Column, *, keep_last: int = 0, keep_within_days: int | None = None, keep_daily: int = 0, keep_weekly: int = 0, keep_monthly: int = 0) -> DataFrame:
    """(grp, id, keep, reason): the first policy that keeps each version.

    Pinned and unstamped versions are always kept, and use up the keep-last quota; unstamped ones sort
    as the newest.  Ties of a stamp go by the larger id.
    """
    newest = [F.col("stamp").desc_nulls_first(), F.col("id").desc()]
    df = versions.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy(*newest)))
    plain = F.col("stamp").isNotNull() & ~F.col("pinned")
    kept = [
        ("pinned", F.col("pinned")),
        ("unparseable-name", F.col("stamp").isNull()),
        ("keep-last", F.col("rn") <= keep_last),
        ("keep-within", F.lit(False) if keep_within_days is None else F.col("stamp") >= now - F.make_interval(days=F.lit(keep_within_days))),
    ]
    for name, n, key in (("keep-daily", keep_daily, X.day_key), ("keep-weekly", keep_weekly, X.iso_week), ("keep-monthly", keep_monthly, X.month_key)):
        if n <= 0:
            continue
        df = df.withColumn("b", F.when(plain, key(F.col("stamp"))))
        # the newest of each bucket, then the newest buckets
        df = df.withColumn("in_bucket", F.row_number().over(Window.partitionBy("grp", "b").orderBy(*newest)))
        df = df.withColumn("bucket", F.dense_rank().over(Window.partitionBy("grp").orderBy(F.col("b").desc_nulls_last())))
        flag = f"f_{name.replace('-', '_')}"
        df = df.withColumn(flag, plain & (F.col("in_bucket") == 1) & (F.col("bucket") <= n)).drop("b", "in_bucket", "bucket")
        kept.append((name, F.col(flag)))
    reason = F.lit("beyond-retention")
    for name, test in reversed(kept):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    return df.select("grp", "id", reason.alias("reason")).withColumn("keep", F.col("reason") != "beyond-retention")


def latest(versions: DataFrame, n: int) -> DataFrame:
    """The newest n versions of each group; unstamped ones come last in a listing."""
    w = Window.partitionBy("grp").orderBy(F.col("stamp").desc_nulls_last(), F.col("id").desc())
    return versions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).withColumn("rn", F.col("rn").cast("long"))


def pin_match(stamp: Column, spec: str) -> Column:
    """The spec's digits start the stamp's yyyyMMddHHmmssfff."""
    digits = "".join(c for c in spec if c.isdigit())
    return F.startswith(F.date_format(stamp, "yyyyMMddHHmmssSSS"), F.lit(digits)) if digits else F.lit(False)


def gc_roots(manifests: DataFrame, now: Column, *, keep_last: int, keep_days: int = 0, pins: list[int] = ()) -> DataFrame:
    """Generations that stay: the newest, those created in the window (all without a date), and pins."""
    # as many rows as the policy keeps, whatever the store holds
    top = manifests.orderBy(F.col("generation").desc()).limit(max(1, keep_last)).select("generation", F.lit(True).alias("newest"))
    recent = F.lit(False) if keep_days <= 0 else F.col("created").isNull() | (F.col("created") >= now - F.make_interval(days=F.lit(keep_days)))
    return manifests.join(F.broadcast(top), "generation", "left").where(F.col("newest") | recent | F.col("generation").isin(list(pins))).select("generation")


def batch_probe(deletes: DataFrame) -> DataFrame:
    """Files and bytes of each batch; a size of zero falls back to the destination's."""
    return deletes.groupBy("batch").agg(F.count("*").alias("files"), F.sum(F.when(F.col("size") == 0, F.col("dest_size")).otherwise(F.col("size"))).alias("bytes"))


def delete_guard(probe: DataFrame, *, count: int, gigabytes: float, percent: float) -> DataFrame:
    """Why a batch is held, in the guard's order: count, bytes, an unknown baseline, percent of a baseline over 50.

    A batch held by percent that exceeds its baseline is marked as one with dead rows.
    """
    size = F.lit(int(gigabytes * (1 << 30)))
    share = F.lit(100.0) * F.col("files") / F.col("baseline")
    reason = (
        F.when(F.lit(count > 0) & (F.col("files") >= count), "count")
        .when(F.lit(gigabytes > 0) & (F.col("bytes") >= size), "bytes")
        .when(F.lit(percent > 0) & F.col("baseline").isNull(), "unknown-baseline")
        .when(F.lit(percent > 0) & (F.col("baseline") > 50) & (share >= percent), F.when(F.col("files") > F.col("baseline"), "percent-dead-rows").otherwise("percent"))
    )
    return probe.select("batch", "files", "bytes", reason.alias("reason"))


def locality(deletes: DataFrame) -> DataFrame:
    """The directory with most of a batch's deletes, and its share; ties go to the smallest name."""
    per = deletes.groupBy("batch", "dir").agg(F.count("*").alias("n"))
    return per.groupBy("batch").agg(F.sum("n").alias("total"), F.max("n").alias("n"), F.min(F.struct((-F.col("n")).alias("m"), "dir")).alias("top")).select("batch", F.col("top.dir").alias("dir"), (F.col("n") / F.col("total")).alias("share"), "total")


def bulk_cleanup(located: DataFrame, percent: float, least: int = 10) -> DataFrame:
    """Whether a held batch is one folder's cleanup, which may proceed."""
    ok = (F.col("share") * 100 >= percent) & F.col("baseline").isNotNull() & (F.col("total") <= F.col("baseline")) & (F.col("total") >= least)
    return located.select("batch", F.coalesce(ok, F.lit(False)).alias("cleanup"))


def spike_guard(events: DataFrame, key: str, seconds: int, *, files: int = 0, size: int = 0, renames: int = 0) -> DataFrame:
    """Sums over the window that ends with each event (both ends count), and whether a wire trips.  A wire of zero or less is off.

    Events come in the order of time and id: those of the same time that come later don't count yet.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    later = Window.partitionBy(key, "us").orderBy(F.col("event_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: (F.sum(c).over(w) - F.coalesce(F.sum(c).over(later), F.lit(0)))
    df = events.withColumn("us", t).withColumn("one", F.lit(1).cast("long")).withColumn("rename", (F.col("change_type") == "Renamed").cast("long"))
    df = df.select(key, "event_id", so_far("one").alias("files"), so_far("bytes").alias("bytes"), so_far("rename").alias("renames"))
    trip = F.lit(False)
    for c, wire in (("files", files), ("bytes", size), ("renames", renames)):
        if wire > 0:
            trip = trip | (F.col(c) >= wire)
    return df.withColumn("tripped", trip)


def gap_storm(events: DataFrame, key: str, *, count: int = 3, seconds: int = 600) -> DataFrame:
    """Events that complete ``count`` within strictly less than the window."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("us", t).select(key, "event_id", F.count("*").over(w).alias("n")).where(F.col("n") >= count)


def throttle(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events let through at most once in ``seconds`` by key, greedily in order: state carried along each key, one at a time."""

    def keep(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["us", "event_id"])
        last, out = None, []
        for us, event in zip(pdf["us"], pdf["event_id"], strict=True):
            if last is None or us - last >= seconds * 1_000_000:
                last = us
                out.append(event)
        return pd.DataFrame({"event_id": out}, dtype="int64")

    return events.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).groupBy(key).applyInPandas(keep, "event_id long")


# holds


def classify_pending(incoming: DataFrame, pending: DataFrame) -> DataFrame:
    """new, held, or reblocked (held and claimed), for each incoming path key."""
    p = pending.select("path_key", F.col("claimed").alias("was"))
    return incoming.join(p, "path_key", "left").select("path_key", F.when(F.col("was").isNull(), "new").when(F.col("was"), "reblocked").otherwise("held").alias("state"))


def insert_or_ignore(pending: DataFrame, incoming: DataFrame, batch_id: int) -> DataFrame:
    """New keys and claimed ones go into the new batch, unclaimed; other held keys keep their batch."""
    kept = pending.join(incoming.select("path_key"), "path_key", "left_anti").unionByName(pending.where("NOT claimed").join(incoming.select("path_key"), "path_key", "left_semi"))
    new = incoming.join(pending.where("NOT claimed").select("path_key"), "path_key", "left_anti").select("path_key", F.lit(batch_id).cast("long").alias("batch_id"), F.lit(False).alias("claimed"))
    return kept.select("path_key", "batch_id", "claimed").unionByName(new)


def claim(pending: DataFrame, holds: DataFrame, due_before: int, most: int = 500) -> DataFrame:
    """The earliest unclaimed paths of batches blocked before a time, a bounded chunk of them."""
    due = holds.where(F.col("blocked_at") <= due_before).select("batch_id", "blocked_at")
    return pending.where("NOT claimed").join(due, "batch_id").orderBy("blocked_at", "batch_id", "path_key").limit(most).select("path_key", "batch_id")


def confirm(pending: DataFrame, done: DataFrame) -> DataFrame:
    """Pending rows after claimed paths that are done have gone."""
    gone = pending.where("claimed").join(done.select("path_key"), "path_key", "left_semi").select("path_key", "batch_id")
    return pending.join(gone, ["path_key", "batch_id"], "left_anti")


def hold_summary(holds: DataFrame, pending: DataFrame) -> DataFrame:
    return holds.join(pending.groupBy("batch_id").agg(F.count("*").alias("files"), F.count_if("claimed").alias("claimed")), "batch_id").select("batch_id", "blocked_at", "files", "claimed")


def next_due(holds: DataFrame, hold_ticks: int, warn_ticks: int, now: int, by: str) -> DataFrame:
    """For each pipeline, the earliest moment at which some batch expires or, before that, is due a warning; never before now.

    A batch that was never warned about (no time, or time 0) is due one now.
    """
    expiry = F.col("blocked_at") + hold_ticks
    never = F.coalesce(F.col("last_warning_at"), F.lit(0)) == 0
    warn = F.when(never, F.lit(now).cast("long")).otherwise(F.col("last_warning_at") + warn_ticks)
    due = F.when(expiry > now, F.least(expiry, warn)).otherwise(expiry)
    return holds.groupBy(by).agg(F.greatest(F.min(due), F.lit(now).cast("long")).alias("next_due"))


def hold_clock(holds: DataFrame, pending: DataFrame, existing: DataFrame, now: int, hold_ticks: int) -> DataFrame:
    """delete, cancel or wait for each held path, at a time.  Holds (batch_id, blocked_at, source_there) whose source root is missing keep waiting."""
    e = existing.select("path_key", F.lit(True).alias("back"))
    action = F.when(~F.col("source_there"), "wait").when(F.col("back"), "cancel").when(F.col("blocked_at") + hold_ticks <= now, "delete").otherwise("wait")
    return pending.join(holds.select("batch_id", "blocked_at", "source_there"), "batch_id").join(e, "path_key", "left").select("path_key", action.alias("action"))


def hold_warnings(holds: DataFrame, now: int, hold_ticks: int, every_ticks: int) -> DataFrame:
    """Batches that still wait and are due their next warning, with the time that is left."""
    expiry, last = F.col("blocked_at") + hold_ticks, F.coalesce(F.col("last_warning_at"), F.lit(0))
    return holds.where((expiry > now) & (last + every_ticks <= now)).select("batch_id", (expiry - now).alias("left"))


def forget(versions: DataFrame, now: Column, wanted: Column, **policies) -> DataFrame:
    """Versions among the wanted ones that no policy keeps, and that are neither pinned nor without a stamp."""
    beyond = retention(versions, now, **policies).where("NOT keep").select("grp", "id")
    return versions.where(wanted).join(beyond, ["grp", "id"], "left_semi").select("id")


# schedules


def due(now: Column, last: Column, kind: str, *, hour: int = 0, minute: int = 0, weekday: int = 0, day: int = 1, mask: int = 127, seconds: int = 0, run_date: Column | None = None, catch_up: bool = True) -> Column:
    """Whether a job is due; days are compared, so that a run earlier on a day satisfies that day's moment.

    A missed moment stays due, and a missed daily one from the second day on; without catch-up only a
    moment reached today counts.  An interval job is due once its span has passed.
    """
    midnight = lambda ts: F.date_trunc("day", ts)
    at = lambda ts: midnight(ts) + F.make_interval(hours=F.lit(hour), mins=F.lit(minute))
    back = lambda ts, n: ts - F.make_interval(days=n)
    never, today, reached = last.isNull(), midnight(now), now >= at(now)
    not_today = never | (last < today)
    if kind == "interval":
        return never | (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp")) >= seconds)
    if kind == "once":
        ok = never & (now >= at(run_date))
        return ok if catch_up else ok & (midnight(run_date) == today)
    if kind == "daily":
        return not_today & (reached | never | (last < back(today, F.lit(1)))) if catch_up else not_today & reached
    if kind == "weekly":
        since = F.pmod(F.dayofweek(now) - 1 - weekday, F.lit(7))
        slot, on_day = back(at(now), since), since == 0
        slot = F.when(now >= slot, slot).otherwise(back(slot, F.lit(7)))
    elif kind == "weekdays":
        on = lambda ts: F.element_at(F.array(*(F.lit(bool(mask >> k & 1)) for k in range(7))), F.dayofweek(ts))
        slot, on_day = F.lit(None).cast("timestamp_ntz"), on(now)
        for n in range(7, -1, -1):
            moment = back(at(now), F.lit(n))
            slot = F.when((now >= moment) & on(moment), moment).otherwise(slot)
    elif kind == "monthly":
        clamp = lambda d: F.make_date(F.year(d), F.month(d), F.least(F.lit(day), F.dayofmonth(F.last_day(d))))
        this = at(clamp(now).cast("timestamp_ntz"))
        before = at(clamp(F.add_months(now, -1)).cast("timestamp_ntz"))
        slot, on_day = F.when(now >= this, this).otherwise(before), midnight(this) == today
    else:
        raise ValueError(kind)
    if not catch_up:
        return on_day & not_today & reached
    return F.coalesce(never | (midnight(last) < midnight(slot)), F.lit(False)) & slot.isNotNull()


def overlap(running: Column, policy: Column) -> Column:
    """What happens to a job that is due while it still runs."""
    return F.when(~running, "start").when(policy == "chain", "chain").otherwise("skip")


def rotation(drives: DataFrame, now: Column, days: int, deep_days: int = 90) -> DataFrame:
    """Drives seen, whether any backup is fresh, whether any has rested deep, and how many are overdue."""
    age = F.datediff(now, F.col("last_backup"))
    return drives.agg(F.count("*").alias("drives"), F.bool_or(age <= days).alias("any_fresh"), F.bool_or(age >= deep_days).alias("any_deep"), F.count_if(F.coalesce(age > days, F.lit(True))).alias("overdue"))


def hold_listing(holds: DataFrame, pending: DataFrame, hold_ticks: int) -> DataFrame:
    """Of each batch: files that still wait, when it was blocked, and when it expires."""
    b = pending.where("NOT claimed").groupBy("batch_id").agg(F.count("*").alias("files"))
    return holds.join(b, "batch_id").select("batch_id", "files", F.col("blocked_at").alias("oldest"), (F.col("blocked_at") + hold_ticks).alias("next_due"))

"""Scalar expressions: stamps, durations, digests, formats and decision rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_1970 = 621_355_968_000_000_000
MIB = 1 << 20
MASK32 = 4294967295


def ticks_to_timestamp(ticks: Column) -> Column:
    return F.timestamp_micros(F.floor((ticks - TICKS_1970) / 10).cast("long"))


def parse_stamp(name: Column) -> tuple[Column, Column]:
    """(stamp, original name) of "name_yyyyMMdd_HHmmss_fff_<32 hex>.ext"; null where the name isn't one."""
    shape = r"^(.+)_(\d{8}_\d{6}_\d{3})_[0-9a-fA-F]{32}(\.[^.]*)?$"
    hit = name.rlike(shape)
    stamp = F.try_to_timestamp(F.regexp_extract(name, shape, 2), F.lit("yyyyMMdd_HHmmss_SSS"))
    return F.when(hit, stamp), F.when(hit & stamp.isNotNull(), F.concat(F.regexp_extract(name, shape, 1), F.regexp_extract(name, shape, 3)))


def iso_week(ts: Column) -> Column:
    return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


#: Seconds of each unit of a duration.
UNITS = {"d": 86400, "h": 3600, "m": 60, "s": 1}
LONGEST = 3660 * 86400


def parse_duration(text: Column, longest: int | None = LONGEST) -> Column:
    """Seconds of "1h30m"; a unit is a must, signs are refused, and so is more than the longest (3,660 days; None: no such guard)."""
    t = F.lower(F.trim(text))
    parts = F.regexp_extract_all(t, F.lit(r"(\d+[dhms])"), F.lit(1))

    def seconds(p: Column) -> Column:
        n = F.substring(p, 1, 18).substr(F.lit(1), F.length(p) - 1).try_cast("long")
        unit = F.substring(p, -1, 1)
        factor = F.lit(1)
        for k, v in UNITS.items():
            factor = F.when(unit == k, F.lit(v)).otherwise(factor)
        return n * factor

    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + seconds(p))
    return F.when(t.rlike(r"^(\d{1,9}[dhms])+$") & (F.lit(True) if longest is None else total <= longest), total)


def parse_size_limit(text: Column) -> Column:
    """Megabytes; "none", empty and null mean no limit (0); other text is null."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("", "none"), F.lit(0).cast("long")).otherwise(F.when(t.rlike(r"^\d{1,15}$"), t.try_cast("long")))


def parse_verification(text: Column) -> Column:
    """The comparison level's canonical name; unknown and empty are date_and_size."""
    t = F.translate(F.lower(F.trim(F.coalesce(text, F.lit("")))), "_-", "")
    return F.when(t == "size", "size").when(t == "hash", "hash").when(t == "full", "full").when(t == "none", "none").otherwise("date_and_size")


def format_size(n: Column) -> Column:
    kb = F.lit(1024.0)
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", F.round(n / kb, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.round(n / kb / kb, 1)))
        .otherwise(F.format_string("%.1f GB", F.round(n / kb / kb / kb, 1)))
    )


def format_age(seconds: Column) -> Column:
    seconds = F.greatest(seconds, F.lit(0))
    whole = lambda unit: F.floor(seconds / unit)
    return F.when(seconds >= 86400, F.format_string("%dd", whole(86400))).when(seconds >= 3600, F.format_string("%dh", whole(3600))).otherwise(F.format_string("%dm", whole(60)))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, of the upper-cased text's bytes (ASCII), as a number."""
    codes = F.transform(F.filter(F.split(F.upper(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(MASK32)))


def stable_hash(text: Column) -> Column:
    return F.lower(F.lpad(F.hex(fnv1a(text)), 8, "0"))


def chunk_id(payload: Column, key: Column) -> Column:
    """SHA-256 of the plain bytes followed by the store's key."""
    return F.sha2(F.concat(payload.cast("binary"), key.cast("binary")), 256)


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC by its two passes, for keys of at most 64 bytes."""
    padded = F.rpad(F.hex(key.cast("binary")), 128, "0")

    def pad(byte: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lpad(F.hex(F.conv(F.substr(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte))), 2, "0")), "")

    inner = F.sha2(F.concat(F.unhex(pad(0x36)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(pad(0x5C)), F.unhex(inner)), 256)


def buzhash_bounds(average: Column) -> tuple[Column, Column]:
    low = F.greatest(F.floor(average / 4), F.lit(64)).cast("long")
    return low, F.greatest(F.least(average * 4, F.lit(64 * MIB)), low).cast("long")


def mask_for(span: Column) -> Column:
    """2^floor(log2(span)) - 1, from the length of the binary digits."""
    return (F.pow(F.lit(2.0), F.length(F.bin(F.greatest(span, F.lit(1)))) - 1).cast("long") - 1).cast("long")


def parity_bytes(percent: Column) -> Column:
    """128 * percent / 100 rounded half to even, from 2 to 127; none for zero."""
    return F.when(percent <= 0, F.lit(0)).otherwise(F.least(F.greatest(F.bround(F.lit(128) * percent / 100), F.lit(2)), F.lit(127))).cast("long")


def grid_count(length: Column, chunk: int) -> Column:
    return F.floor((length + chunk - 1) / chunk).cast("long")


def tail_length(length: Column, chunk: int) -> Column:
    return F.when(length % chunk == 0, F.least(length, F.lit(chunk))).otherwise(length % chunk).cast("long")


def backoff(attempt: Column, initial_ms: int = 500, factor: float = 2.0, most_ms: int = 60_000) -> Column:
    return F.least(F.lit(initial_ms) * F.pow(F.lit(factor), attempt - 1), F.lit(most_ms)).cast("long")


def cursor_parse(text: Column) -> tuple[Column, Column]:
    """(journal id, position) of "usn:hex16:hex16" as decimal(20,0) and bigint; null for any other text."""
    ok = text.rlike("^usn:[0-9a-fA-F]{16}:[0-9a-fA-F]{16}$")
    parts = F.split(text, ":")
    return F.when(ok, F.conv(F.get(parts, F.lit(1)), 16, 10).cast("decimal(20,0)")), F.when(ok, F.conv(F.get(parts, F.lit(2)), 16, 10).try_cast("long"))


def cursor_format(journal: Column, position: Column) -> Column:
    return F.concat(F.lit("usn:"), F.lower(F.lpad(F.hex(journal), 16, "0")), F.lit(":"), F.lower(F.lpad(F.hex(position), 16, "0")))


def cursor_invalid(journal: Column, position: Column, live_journal: Column, first: Column, head: Column) -> Column:
    """Why a saved cursor can't be replayed; null if it can."""
    return F.when(journal != live_journal, "journal-changed").when(position < 0, "negative").when(position > head, "past-head").when(position < first, "evicted")


def disk_floor(total: Column, static: Column) -> Column:
    floor = F.when((total < 500 * MIB) | static, F.lit(32 * MIB)).otherwise(F.lit(320 * MIB))
    return F.least(F.greatest(F.floor(total / 10), floor), F.lit(1 << 30)).cast("long")


WEEKDAYS = {"sunday": 0, "monday": 1, "tuesday": 2, "wednesday": 3, "thursday": 4, "friday": 5, "saturday": 6}


def parse_weekday(text: Column) -> Column:
    """0 (Sunday) to 6, from a full name or its first three letters."""
    t, out = F.lower(F.trim(text)), F.lit(None).cast("int")
    for name, k in WEEKDAYS.items():
        out = F.when(t.isin(name, name[:3]), F.lit(k)).otherwise(out)
    return out


def aligned_capacity(length: Column, unit: int = MIB) -> Column:
    return (F.floor((length + unit - 1) / unit) * unit).cast("long")


def progress(done: Column, total: Column, seconds: Column) -> tuple[Column, Column, Column]:
    """(bytes a second, percent, seconds left); null where nothing can be said."""
    rate = F.when(seconds > 0, done / seconds)
    return rate, F.when(total > 0, F.lit(100.0) * done / total), F.when((rate > 0) & (done <= total), (total - done) / rate)


def effective_timeout(job: Column, shared: Column, built_in: int = 10) -> Column:
    """Minutes: the job's own, else the shared default, else the built-in one; zero and null are unset."""
    return F.when(job > 0, job).when(shared > 0, shared).otherwise(F.lit(built_in))


def boot_file(path: Column) -> Column:
    """Whether a volume-relative path belongs to the boot loader."""
    rel = F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""))
    name = F.substring_index(rel, "/", -1)
    loader = rel.startswith("windows/system32/") & (name.startswith("winload") | name.startswith("winresume"))
    return F.coalesce(rel.startswith("efi/") | rel.startswith("boot/") | (rel == "bootmgr") | loader, F.lit(False))


def target_token(display: Column, capacity: Column) -> Column:
    """What a user types to confirm a target: the drive's number and whole GB, or the file's name and bytes."""
    number = F.regexp_extract(display, r"(?i).*physicaldrive\s*(\d+)\s*$", 1)
    name = F.nullif(F.regexp_extract(display, r"[^/]*$", 0), F.lit(""))
    file = F.concat(F.lit("FILE-"), F.regexp_replace(F.coalesce(name, F.lit("target")), "[^A-Za-z0-9._-]", "_"), F.lit("-"), capacity.cast("string"))
    return F.when(number != "", F.concat(F.lit("DISK"), number.cast("int").cast("string"), F.lit("-"), F.floor(capacity / (1 << 30)).cast("string"), F.lit("GB"))).otherwise(file)


def clamp_delay(due: Column, now: Column, least: Column) -> Column:
    """How long to wait: never less than the floor, never negative."""
    return F.greatest(due - now, least, F.lit(0))


def missed_policy(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(t.isin("catch_up", "catch-up", "catchup"), "catch-up").when(t == "skip", "skip")


def overlap_policy(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(t.isin("skip", "queue"), t)


def auto_name(volume: Column, extension: str, now: Column) -> Column:
    """A file name for an image of a volume: its letter or path made flat, and the time."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(volume), r"^\\\\[?.]\\", ""), r"[:\\/]+$", "")
    flat = F.regexp_replace(bare, r'[:\\/\x00-\x1f"<>|*?]', "-")
    return F.concat(F.when(flat == "", "vol").otherwise(flat), F.lit("-"), F.date_format(now, "yyyyMMdd-HHmmss"), F.lit("." + extension))

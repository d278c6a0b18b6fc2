"""Literal cases: inputs and expected decisions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import paths as P
from tidewater.functions import scalars as X
from tidewater.operators import history as H
from tidewater.operators import policy as O
from tidewater.operators import store as S
from tidewater.operators import sync

GLOBS = [
    ("*.tmp", "file.tmp", False), ("", "anything.txt", True), ("?est.txt", "test.txt", False), ("?est.txt", "best.txt", False), ("?est.txt", "atest.txt", True),
    ("data.*", "data.csv", False), ("data.*", "dataset.txt", True), ("*backup*", "mybackupfile.txt", False), ("*backup*", "backup.zip", False), ("*backup*", "plainfile.txt", True),
    ("a?c", "abc", False), ("a?c", "ac", True), ("temp/*", r"C:\Users\x\Desktop\temp\file.txt", False), ("temp/*", r"C:\Users\x\temp\sub\file.txt", False),
    ("temp/*", r"C:\Users\x\other\file.txt", True), ("temp/*", r"C:\Users\x\tempish\file.txt", True), (r"build\*", r"C:\proj\build\out.dll", False),
    ("C:/proj/build/*", r"C:\proj\build\out.dll", False), ("D:/other/*", r"C:\proj\build\out.dll", True), ("*.txt", "REPORT.TXT", True),
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_globs(spark):
    row = spark.range(1).select(*[(~P.excluded(F.lit(path), [pattern])).alias(f"c{i}") for i, (pattern, path, _) in enumerate(GLOBS)]).first()
    assert [r for r in row] == [kept for _, _, kept in GLOBS]
    assert not one(spark, ~P.excluded(F.lit("REPORT.TXT"), ["*.txt"], ignore_case=True))


@pytest.mark.parametrize(("text", "seconds"), [("1h30m", 5400), ("2d", 172800), ("45", None), ("-1h", None), ("", None), ("3661d", None), ("3660d", 316224000), ("10s", 10)])
def test_durations(spark, text, seconds):
    assert one(spark, X.parse_duration(F.lit(text))) == seconds


def test_stamps(spark):
    hexes = "0123456789abcdef" * 2
    for name, want in {f"notes_20261001_142210_123_{hexes}.txt": "notes.txt", f"my_notes_20261001_142210_123_{hexes}.txt": "my_notes.txt", f"noext_20261001_142210_123_{hexes}": "noext", "notes.txt": None, "notes_20261001.txt": None, "notes_20261001_142210_123_short.txt": None}.items():
        assert one(spark, X.parse_stamp(F.lit(name))[1]) == want


def test_iso_week_and_floors(spark):
    assert one(spark, X.iso_week(F.lit("2021-01-01").cast("timestamp"))) == "2020-W53"
    assert one(spark, X.iso_week(F.lit("2021-01-04").cast("timestamp"))) == "2021-W01"
    for mib, static, want in [(100, False, 33554432), (735, True, 77070336), (735, False, 335544320), (20, False, 33554432), (500, False, 335544320)]:
        assert one(spark, X.disk_floor(F.lit(mib * X.MIB), F.lit(static))) == want


def _versions(spark, rows):
    return spark.createDataFrame([(1, i, s, p) for i, s, p in rows], "grp long, id long, stamp timestamp_ntz, pinned boolean")


def _kept(df):
    return {r.id: r.reason for r in df.collect() if r.keep}


def test_retention(spark):
    now = dt.datetime(2026, 10, 1, 12)
    ago = lambda d: now - dt.timedelta(days=d)
    at = lambda *d: dt.datetime(2026, *d, 12)
    lit = F.lit(now.isoformat(" ")).cast("timestamp_ntz")
    v = _versions(spark, [(k, ago(k), False) for k in range(1, 6)])
    assert set(_kept(H.retention(v, lit, keep_last=3))) == {1, 2, 3}
    v = _versions(spark, [(1, ago(1), False), (2, ago(10), False), (3, ago(40), False)])
    assert set(_kept(H.retention(v, lit, keep_within_days=30))) == {1, 2}
    v = _versions(spark, [(1, ago(100), False), (2, ago(100), True), (3, None, False)])
    assert _kept(H.retention(v, lit)) == {2: "pinned", 3: "unparseable-name"}
    v = _versions(spark, [(1, dt.datetime(2026, 9, 29, 8), False), (2, dt.datetime(2026, 9, 29, 9), False), (3, at(9, 30), False), (4, at(10, 1), False)])
    assert set(_kept(H.retention(v, lit, keep_daily=2))) == {3, 4}
    v = _versions(spark, [(1, at(9, 22), False), (2, at(9, 23), False), (3, at(9, 29), False), (4, at(10, 6), False)])
    assert set(_kept(H.retention(v, lit, keep_weekly=2))) == {3, 4}
    v = _versions(spark, [(1, at(8, 10), False), (2, at(8, 20), False), (3, at(9, 5), False), (4, at(10, 1), False)])
    assert set(_kept(H.retention(v, lit, keep_monthly=2))) == {3, 4}


def test_delete_guard(spark):
    def held(files, size, baseline, **limits):
        probe = spark.createDataFrame([(1, files, size, baseline)], "batch long, files long, bytes long, baseline long")
        return H.delete_guard(probe, **{"count": 0, "gigabytes": 0, "percent": 0} | limits).first().reason

    assert held(2, 0, 10, count=2) == "count"
    assert held(1, 2 << 30, 10, gigabytes=1) == "bytes"
    assert held(1, 0, 51, percent=1) == "percent" and held(1, 0, 50, percent=1) is None
    assert held(1, 0, 64, percent=1.5625) == "percent"
    assert held(70, 0, 60, percent=50) == "percent-dead-rows" and held(40, 0, 30, percent=50) is None


def test_due(spark):
    def due(now, last, **how):
        n, l_ = (F.lit(x).cast("timestamp_ntz") for x in (now, last))
        return one(spark, H.due(n, l_, **how))

    day = {"kind": "daily", "hour": 20}
    assert due("2026-08-29 15:00", None, **day) and due("2026-08-29 21:00", "2026-08-28 20:00", **day) and due("2026-08-29 15:00", "2026-08-27 20:00", **day)
    assert not due("2026-08-29 21:00", "2026-08-29 20:30", **day) and not due("2026-08-29 15:00", "2026-08-28 20:30", **day)
    assert not due("2026-08-29 15:00", "2026-08-27 20:00", **day, catch_up=False)
    week = {"kind": "weekly", "hour": 9, "weekday": 6}
    assert due("2026-08-29 10:00", "2026-08-22 09:30", **week) and not due("2026-08-29 10:00", "2026-08-29 09:30", **week)
    assert not due("2026-08-29 21:00", "2026-08-29 09:00", **day)
    once = {"kind": "once", "hour": 9, "run_date": F.lit("2026-08-28").cast("timestamp_ntz")}
    assert due("2026-08-29 01:00", None, **once) and not due("2026-08-28 08:00", None, **once) and not due("2026-08-29 01:00", None, **once, catch_up=False) and not due("2026-08-29 01:00", "2026-08-01", **once)
    month = {"kind": "monthly", "hour": 9, "day": 31}
    assert due("2026-02-28 10:00", "2026-01-31 09:30", **month) and not due("2026-02-27 10:00", "2026-01-31 09:30", **month)


def _manifest(spark, digests, holes=None):
    rows = [(i, bool(holes and holes[i]), 1, d) for i, d in enumerate(digests)]
    return spark.createDataFrame(rows, "idx long, is_hole boolean, size long, digest string")


@pytest.mark.parametrize(("a", "b", "want"), [(["aa", "bb"], ["aa", "bb"], 0.0), (["aa", "bb"], ["cc", "dd"], 1.0), (["aa", "bb"], ["aa"], 0.5), ([], [], 0.0)])
def test_churn(spark, a, b, want):
    assert S.churn(_manifest(spark, a), _manifest(spark, b), 50).first().fraction == want
    assert S.churn(_manifest(spark, a), _manifest(spark, b), 0).first().alarm is False


def test_gc_roots(spark):
    m = spark.createDataFrame([(g, dt.datetime(2026, 10, 1) - dt.timedelta(days=60 if g == 1 else g)) for g in (1, 2, 3)], "generation long, created timestamp_ntz")
    now = F.lit("2026-10-01").cast("timestamp_ntz")
    keep = lambda **k: {r.generation for r in H.gc_roots(m, now, **k).collect()}
    assert keep(keep_last=2) == {2, 3} and keep(keep_last=1, keep_days=30) == {2, 3} and keep(keep_last=1) == {3} and keep(keep_last=1, pins=[1, 99]) == {1, 3}


def test_state(spark):
    old = spark.createDataFrame([("a/x", 1, 1, "f", 5, "h"), ("a_/y", 2, 2, None, 0, None), ("b/x", 3, 3, None, 0, None)], "path string, size long, mtime long, file_id string, ctime long, hash string")
    new = spark.createDataFrame([("a/x", 9, 9, None, 0, None, 1), ("a/x", 10, 10, None, 0, None, 2), ("n", 1, 1, "g", 1, None, 1)], "path string, size long, mtime long, file_id string, ctime long, hash string, seq long")
    got = {r.path: tuple(r)[1:] for r in sync.sticky_upsert(old, new).collect()}
    assert got["a/x"] == (10, 10, "f", 5, "h") and got["n"][0] == 1 and len(got) == 4
    assert {r.path for r in sync.rename_prefix(old, "a", "b").collect()} == {"b/x", "a_/y"}
    assert {r.path: r.size for r in sync.rename_prefix(old, "a", "b").collect()}["b/x"] == 1


def test_exclusions(spark):
    names = lambda *x: spark.createDataFrame([(n, i) for i, n in enumerate(x)], "name string, pos int")
    assert {r.name for r in O.merge_exclusions(names("Temp", "x"), names("TEMP", "$LogFile", "y")).collect()} == {"Temp", "x", "y"}
    assert not O.exclusions_changed(names("a", "B"), names("b", "A")).first().changed
    assert O.exclusions_changed(names("a"), names("b", "A")).first().changed

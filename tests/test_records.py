"""Binary layouts, configuration, streaming against batch, and sources."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.functions import filerecord as M
from tidewater.functions import records as R
from tidewater.sources import config, manifests, polling
from tidewater.streaming import events as E
from tidewater.streaming import journal

SF = "/root/testdata/sf0.001"


def test_journal_buffers():
    rows = [(5, 1, "a.txt", 32), (6, 5, "日本 é", 16), (7, 5, "", 32)]
    raw = R.build_journal(rows)
    assert R.parse_journal(raw) == rows and R.parse_journal(b"") == []
    with pytest.raises(ValueError):
        R.parse_journal(raw[:-8])


def test_masked_digests_ignore_volatile_fields():
    a, b = b"FILE0001body", b"FILE9999body"
    assert R.masked_digest(a, [(4, 4)]) == R.masked_digest(b, [(4, 4)]) != R.masked_digest(a, [])


def test_config():
    good = [{"name": "a", "source": "/s", "destinations": [{"path": "/d"}], "verification": "hash"}]
    (job,) = config.load(json.dumps(good))
    assert job.destinations[0].mode == "archive" and job.hold_days == 7
    for bad in ([{**good[0], "odd": 1}], [{**good[0], "verification": "x"}], good + [{"name": "b", "source": "/t", "destinations": [{"path": "/D/"}]}], [{**good[0], "destinations": [{"path": "/s/sub"}]}], [{"name": "a"}], [{**good[0], "guard_percent": 101}]):
        with pytest.raises(ValueError):
            config.load(json.dumps(bad))
    with pytest.raises(ValueError):
        config.load('[{"name": "a", "name": "b", "source": "/s"}]')


def test_tree_scan_prunes_bytes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "sub" / "deep").mkdir()
    (tmp_path / "sub" / "b.bin").write_bytes(b"12")
    (tmp_path / "sub" / "deep" / "empty").write_bytes(b"")
    found = polling.scan(spark, f"file://{tmp_path}")
    rows = found.collect()
    assert {(r.path.rsplit("/", 1)[1], r["size"]) for r in rows} == {("a.txt", 3), ("b.bin", 2), ("empty", 0)}
    assert all(r.mtime > polling.EPOCH for r in rows)
    assert polling.poll(found, None).count() == 0


def test_manifests_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(1, 0, 11, 5, False, None), (1, 1, 12, 5, True, 11), (2, 0, 1, 1, False, None)], "generation long, idx long, digest long, size long, is_hole boolean, base long")
    short = "generation BIGINT, " + manifests.MANIFEST[manifests.MANIFEST.index("chunks ") :]
    path = f"file://{tmp_path}/m"
    manifests.save(manifests.nest(e), path, "k")
    assert sorted(map(str, manifests.explode_chunks(manifests.load(spark, path, short, "k")).collect())) == sorted(map(str, e.collect()))
    with pytest.raises(Exception, match="failed verification"):
        manifests.load(spark, path, short, "another").collect()
    for file in (tmp_path / "m").glob("part-*"):
        file.write_text(file.read_text().replace('"digest":12', '"digest":13'))
        (tmp_path / "m" / f".{file.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="failed verification"):
        manifests.load(spark, path, short, "k").collect()
    newer = spark.createDataFrame([(2, 1, 0, [(1, 2)])], manifests.LAYOUT)
    manifests.save(newer, f"file://{tmp_path}/l", "k")
    with pytest.raises(Exception, match="unsupported schema version 2"):
        manifests.load(spark, f"file://{tmp_path}/l", manifests.LAYOUT, "k", 1).collect()
    (tmp_path / "bad.json").write_text('{"generation": ')
    with pytest.raises(Exception):
        manifests.load(spark, f"file://{tmp_path}/bad.json", short, "k").collect()


def _feed(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("change_type"))


def _stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF + "/")
    return raw.select("event_id", "ts", F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("change_type"))


def test_debounce_stream_equals_batch_for_closed_sessions(spark, tmp_path):
    batch = {tuple(r) for r in E.debounce(_feed(spark), "path", "1 hour").collect()}
    got = {tuple(r) for r in E.run_available(E.debounce_stream(_stream(spark), "path", "1 hour", "10 minutes"), f"file://{tmp_path}").collect()}
    assert got <= batch and len(got) > 0.8 * len(batch)


def test_spike_stream_latches(spark, tmp_path):
    span, wire = 86400, 3
    got = {(r.path, r.event_id) for r in E.run_available(E.spike_stream(_stream(spark), "path", span, wire), f"file://{tmp_path}").collect()}
    want, state = set(), {}
    for r in _feed(spark).orderBy("ts", "event_id").collect():
        recent, held = state.get(r.path, ([], False))
        recent = [x for x in recent if (r.ts - x).total_seconds() <= span] + [r.ts]
        held = held or len(recent) >= wire
        if held:
            want.add((r.path, r.event_id))
        state[r.path] = recent, held
    assert got == want and got


def test_file_records():
    times = (5, 6, 7)
    raw = M.build(9, 3, [(5, 2, "LONGNA~1", M.ALIAS), (5, 2, "long name é", 1)], times=times, size=70, runs=R.build_runs([(4, 2), (-1, 3), (1, 1)]), log=1, stamp=4)
    assert M.parse(raw) == [(3, False, 5, 2, "long name é", 5, 6, 7, 70, False, [(0, 4, 2), (2, -1, 3), (5, 1, 1)])]
    assert M.parse(M.build(9, 3, [(5, 2, "ONLY~1", M.ALIAS)]))[0][4] == "ONLY~1"
    assert M.parse(M.build(9, 3, [(5, 2, "a", 1), (6, 2, "b", 1)], is_dir=True))[1][1:5] == (True, 6, 2, "b")
    assert M.parse(M.build(9, 3, [(5, 2, "gone", 1)], in_use=False)) == [] and M.parse(b"BAAD" + raw[4:]) == []
    for bad in (raw[:510] + b"zz" + raw[512:], raw[:600], b"", raw[:60] + b"\xff\xff\xff\x7f" + raw[64:]):
        with pytest.raises(ValueError):
            M.parse(bad)
    same = lambda **k: M.skip_digest(M.build(9, 3, [(5, 2, "x", 1)], **{"times": times} | k))
    assert same() == same(log=8, stamp=70) == same(times=(5, 6, 99)) != same(times=(5, 66, 7))
    assert M.skip_digest(b"short") and M.skip_digest(raw, root=True) != M.skip_digest(raw)


def test_runs_of_a_file_with_two_names_come_once(spark):
    build = lambda names, **k: M.build(9 + (3 << 32), 3, names, runs=R.build_runs([(4, 2), (-1, 3)]), **k)
    linked, gone = build([(5, 2, "a", 1), (6, 2, "b", 1)]), build([(5, 2, "c", 1)], in_use=False)
    torn = linked[:510] + bytes(255 - x for x in linked[510:512]) + linked[512:]
    got = M.record_runs(spark.createDataFrame([(1, linked), (2, gone), (3, torn)], "k long, raw binary"), "k", "raw")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 4, 2), (1, 2, -1, 3)]


def _drained(stream, folder):
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").option("path", f"{folder}/rows").start()
    q.processAllAvailable()
    q.stop()
    return sorted(r.usn for r in stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows").collect()), len(q.recentProgress)


def test_journal_stream(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    row = lambda n: (n, n % 7, 5, 0x100, 32, f"näme{n}")
    journal.append(path, "a", [row(n) for n in range(10, 30)])
    journal.append(path, "a", [row(n) for n in range(30, 45)])
    assert list(journal.unpack(journal.pack([row(3)]))) == [row(3)]
    with pytest.raises(ValueError):
        list(journal.unpack(journal.pack([row(3)])[:-1]))
    told = journal.describe(path)
    assert [journal.cursor_problem(c, told) for c in (None, ("b", 12), ("a", -1), ("a", 3), ("a", 99), ("a", 9), ("a", 44))] == ["none", "id-changed", "negative", "before-first", "beyond-head", None, None]
    got, _ = _drained(journal.read_journal(spark, path, cursor=("a", 12), replay=6), f"file://{tmp_path}/s")
    assert got == list(range(13, 45))
    # later records go on from the log, and a cursor that is no good starts at the head
    journal.append(path, "a", [row(n) for n in range(45, 50)])
    assert _drained(journal.read_journal(spark, path, cursor=("a", 12)), f"file://{tmp_path}/s")[0] == list(range(13, 50))
    assert _drained(journal.read_journal(spark, path, cursor=("old", 12)), f"file://{tmp_path}/t")[0] == []

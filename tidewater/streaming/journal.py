"""A change journal as a stream: segments of records in a folder, read by position.

The folder holds ``journal.json`` (id, first and head positions that are still there) and segments
named by the position of their first record, in the public binary layout of version 2 records.
Offsets are cursors (journal id and position); a trigger takes at most a bounded number of records.
A cursor of another journal, before what is still there or beyond the head can't be gone on from: the
stream then starts at the head, and ``cursor_problem`` tells why, so that a covering scan can follow.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.records import RECORD

FIELDS = [("usn", pa.int64()), ("file_ref", pa.int64()), ("parent_ref", pa.int64()), ("reason", pa.int64()), ("attributes", pa.int64()), ("name", pa.string())]
SCHEMA = "usn long, file_ref long, parent_ref long, reason long, attributes long, name string"
#: Records that one trigger takes at most.
REPLAY = 100_000


def pack(rows: list[tuple[int, int, int, int, int, str]]) -> bytes:
    """A segment of (usn, file, parent, reason, attributes, name)."""
    out = bytearray()
    for usn, file, parent, reason, attributes, name in rows:
        raw = name.encode("utf-16-le")
        size = (RECORD.size + len(raw) + 7) // 8 * 8
        out += (RECORD.pack(size, 2, 0, file, parent, usn, 0, reason, 0, 0, attributes, len(raw), RECORD.size) + raw).ljust(size, b"\0")
    return bytes(out)


def unpack(raw: bytes):
    """The records of a segment; one that overruns it is an error."""
    at = 0
    while at < len(raw):
        if at + RECORD.size > len(raw):
            raise ValueError(f"malformed record at {at}")
        size, major, _, file, parent, usn, _, reason, _, _, attributes, n, offset = RECORD.unpack_from(raw, at)
        if size < RECORD.size or at + size > len(raw) or offset + n > size or major != 2:
            raise ValueError(f"malformed record at {at}")
        yield usn, file, parent, reason, attributes, raw[at + offset : at + offset + n].decode("utf-16-le")
        at += size


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def describe(path: str) -> dict:
    store, top = _open(path)
    with store.open_input_stream(f"{top}/journal.json") as f:
        return json.loads(f.read())


def append(path: str, journal: str, rows: list[tuple], first: int | None = None) -> None:
    """Add a segment, and tell the new head; the segment is there before it is told of."""
    store, top = _open(path)
    store.create_dir(top, recursive=True)
    if rows:
        with store.open_output_stream(f"{top}/{rows[0][0]:020d}.segment") as f:
            f.write(pack(rows))
    try:
        was = describe(path)
    except FileNotFoundError:
        was = {"first": rows[0][0] if rows else 0, "head": 0}
    told = {"id": journal, "first": was["first"] if first is None else first, "head": max([was["head"], *(r[0] for r in rows)])}
    with store.open_output_stream(f"{top}/_journal.json") as f:
        f.write(json.dumps(told).encode())
    store.move(f"{top}/_journal.json", f"{top}/journal.json")


def write(records: DataFrame, path: str, journal: str, partitions: int = 16) -> None:
    """A journal of records (the fields above, usn unique), a segment a range of positions, written by the tasks; it is told of at the end."""
    store, top = _open(path)
    store.create_dir(top, recursive=True)

    def segments(batches):
        mine, _ = _open(path)
        rows = sorted(r for b in batches for r in zip(*(b.column(n).to_pylist() for n, _ in FIELDS), strict=True))
        if rows:
            with mine.open_output_stream(f"{top}/{rows[0][0]:020d}.segment") as f:
                f.write(pack(rows))
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([rows[-1][0]])], ["first", "last"])

    ends = records.select(*(n for n, _ in FIELDS)).repartitionByRange(partitions, "usn").mapInArrow(segments, "first long, last long").agg(F.min("first"), F.max("last")).first()
    with store.open_output_stream(f"{top}/journal.json") as f:
        f.write(json.dumps({"id": journal, "first": ends[0] or 0, "head": ends[1] or 0}).encode())


def cursor_problem(cursor: tuple[str, int] | None, journal: dict) -> str | None:
    """Why a cursor can't be gone on from."""
    if cursor is None:
        return "none"
    if cursor[0] != journal["id"]:
        return "id-changed"
    if cursor[1] < 0:
        return "negative"
    if cursor[1] < journal["first"] - 1:
        return "before-first"
    return "beyond-head" if cursor[1] > journal["head"] else None


class Segment(InputPartition):
    def __init__(self, file: str, after: int, upto: int):
        self.file, self.after, self.upto = file, after, upto


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, cursor: tuple[str, int] | None, replay: int):
        self.path, self.replay, journal = path, replay, describe(path)
        self.start = {"id": journal["id"], "usn": journal["head"] if cursor_problem(cursor, journal) else cursor[1]}
        self.at = self.start["usn"]

    def initialOffset(self):
        return self.start

    def latestOffset(self):
        journal = describe(self.path)
        return {"id": journal["id"], "usn": min(journal["head"], self.at + self.replay)}

    def partitions(self, start, end):
        self.at = max(self.at, end["usn"])
        if start["id"] != end["id"]:
            raise ValueError("the journal was made anew: start again, and scan what it covers")
        store, top = _open(self.path)
        files = sorted(i.path for i in store.get_file_info(fs.FileSelector(top)) if i.path.endswith(".segment"))
        first = [int(f.rsplit("/", 1)[1].split(".")[0]) for f in files]
        return [Segment(f, start["usn"], end["usn"]) for f, a, b in zip(files, first, [*first[1:], end["usn"] + 1], strict=True) if a <= end["usn"] and b > start["usn"] + 1]

    def read(self, partition):
        store, _ = _open(self.path)
        with store.open_input_stream(partition.file) as f:
            rows = [r for r in unpack(f.read()) if partition.after < r[0] <= partition.upto]
        columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True)], [n for n, _ in FIELDS])

    def commit(self, end):
        pass


class ChangeJournal(DataSource):
    """Options: path; journal and usn (the cursor to go on from); replay (records a trigger)."""

    @classmethod
    def name(cls):
        return "change_journal"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        o = self.options
        cursor = (o["journal"], int(o["usn"])) if "journal" in o and "usn" in o else None
        return Reader(o["path"], cursor, int(o.get("replay", REPLAY)))


def read_journal(spark: SparkSession, path: str, *, cursor: tuple[str, int] | None = None, replay: int = REPLAY) -> DataFrame:
    """The journal's records after the cursor, as a stream."""
    spark.dataSource.register(ChangeJournal)
    reader = spark.readStream.format("change_journal").option("path", path).option("replay", replay)
    if cursor is not None:
        reader = reader.option("journal", cursor[0]).option("usn", cursor[1])
    return reader.load()

"""File records of an NTFS volume's file table: fixups, names, times, data runs, and digests that ignore write counters.

The layout is the public one; builders serve tests and fixtures.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from .codecs import data_runs
from .records import per_batch

#: magic, fixup offset and words, log position, sequence, links, first attribute, flags, used, allocated, base record, next attribute id, number's high and low part
HEAD = struct.Struct("<4sHHQHHHHIIQHHI")
#: type, length, whether its value is elsewhere, name length and offset, flags, id
ATTRIBUTE = struct.Struct("<IIBBHHH")
RESIDENT = struct.Struct("<IHH")
ELSEWHERE = struct.Struct("<QQHHIQQQ")
TIMES, NAME, DATA, REPARSE, END = 0x10, 0x30, 0x80, 0xC0, 0xFFFFFFFF
IN_USE, DIRECTORY = 1, 2
#: Name space of 8.3 aliases.
ALIAS = 2
SECTOR = 512
SIZE = 1024


class Malformed(ValueError):
    pass


def without_fixup(raw: bytes) -> bytearray:
    """The record with its sectors' last words put back; a torn record is an error."""
    record = bytearray(raw)
    offset, words = struct.unpack_from("<HH", record, 4) if len(record) >= 8 else (0, 0)
    sectors = len(record) // SECTOR
    if not sectors or len(record) % SECTOR or words != sectors + 1 or offset < 8 or offset + 2 * words > len(record):
        raise Malformed("fixup words")
    saved = [bytes(record[offset + 2 * k : offset + 2 * k + 2]) for k in range(words)]
    ends = range(SECTOR - 2, len(record), SECTOR)
    if any(record[e : e + 2] != saved[0] for e in ends):
        raise Malformed("a torn sector")
    for e, word in zip(ends, saved[1:], strict=True):
        record[e : e + 2] = word
    return record


def attributes(record: bytes):
    """(type, offset, length) of each attribute."""
    first, used = struct.unpack_from("<H", record, 0x14)[0], struct.unpack_from("<I", record, 0x18)[0]
    at, end = first, min(used, len(record))
    while True:
        if at + 4 > end:
            raise Malformed("no end of attributes")
        kind = struct.unpack_from("<I", record, at)[0]
        if kind == END:
            return
        length = struct.unpack_from("<I", record, at + 4)[0] if at + 8 <= end else 0
        if length < 24 or at + length > end:
            raise Malformed("an attribute's length")
        yield kind, at, length
        at += length


def _value(record: bytes, at: int, length: int) -> tuple[int, int]:
    """Where a resident attribute's value lies."""
    size, offset, _ = RESIDENT.unpack_from(record, at + ATTRIBUTE.size)
    if record[at + 8] or offset + size > length:
        raise Malformed("a value")
    return at + offset, size


def _in_use(head: tuple) -> bool:
    """Neither dead nor the extension of another record."""
    return head[0] == b"FILE" and bool(head[7] & IN_USE) and not head[10]


def _runs(record: bytes, at: int, length: int) -> list[tuple[int, int, int]]:
    """(vcn, lcn or -1, clusters) of an attribute whose value is elsewhere."""
    vcn, _, offset, *_ = ELSEWHERE.unpack_from(record, at + ATTRIBUTE.size)
    out = []
    for lcn, count in data_runs(bytes(record[at + offset : at + length])):
        out.append((vcn, lcn, count))
        vcn += count
    return out


def parse(raw: bytes) -> list[tuple]:
    """(sequence, is_dir, parent, parent_sequence, name, created, written, accessed, size, reparse, runs) of each name; none of a dead record.

    Times are 100-nanosecond ticks since 1601, those of the name where there are no others.  Aliases
    count only in a record without another name.  Runs are (vcn, lcn or -1, clusters) of the unnamed data.
    """
    record = without_fixup(raw)
    head = HEAD.unpack_from(record)
    if not _in_use(head):
        return []
    times, of_name, names, aliases, size, runs, reparse = None, None, [], [], 0, [], False
    for kind, at, length in attributes(record):
        if kind == TIMES and times is None:
            start, n = _value(record, at, length)
            if n < 32:
                raise Malformed("times")
            created, written, _, accessed = struct.unpack_from("<qqqq", record, start)
            times = created, written, accessed
        elif kind == NAME:
            start, n = _value(record, at, length)
            letters = record[start + 64] if n >= 66 else 0
            if not letters or 66 + 2 * letters > n:
                raise Malformed("a name")
            parent, created, written, _, accessed = struct.unpack_from("<Qqqqq", record, start)
            text = bytes(record[start + 66 : start + 66 + 2 * letters]).decode("utf-16-le", errors="replace")
            (aliases if record[start + 65] == ALIAS else names).append((parent & 0xFFFFFFFFFFFF, parent >> 48, text))
            of_name = of_name or (created, written, accessed)
        elif kind == REPARSE:
            reparse = True
        elif kind == DATA and not record[at + 9]:
            if record[at + 8]:
                size = ELSEWHERE.unpack_from(record, at + ATTRIBUTE.size)[6]
                runs += _runs(record, at, length)
            else:
                size = _value(record, at, length)[1]
    return [(head[4], bool(head[7] & DIRECTORY), *name, *(times or of_name or (None,) * 3), size, reparse, runs) for name in names or aliases]


def streams(raw: bytes) -> list[tuple[int, int, int]]:
    """(vcn, lcn or -1, clusters) of a record's unnamed data, whatever its names; none of a dead record."""
    record = without_fixup(raw)
    if not _in_use(HEAD.unpack_from(record)):
        return []
    elsewhere = [(at, length) for kind, at, length in attributes(record) if kind == DATA and not record[at + 9] and record[at + 8]]
    return [run for at, length in elsewhere for run in _runs(record, at, length)]


def skip_digest(raw: bytes, *, root: bool = False) -> str:
    """SHA-256 of length and record, without what every write stirs: log position, fixup words, sector ends, the access time (all four times of the root).  Malformed parts count as they are."""
    record = bytearray(raw)
    if len(record) >= 16:
        record[8:16] = bytes(8)
        offset, words = struct.unpack_from("<HH", record, 4)
        if words and offset >= 16 and offset + 2 * words <= len(record):
            record[offset : offset + 2 * words] = bytes(2 * words)
            sectors = words - 1
            stride = len(record) // sectors if sectors and not len(record) % sectors else 0
            if stride >= SECTOR and not stride % SECTOR:
                for e in range(stride - 2, len(record), stride):
                    record[e : e + 2] = bytes(2)
    try:
        for kind, at, length in attributes(record):
            if kind == TIMES:
                start, n = _value(record, at, length)
                if n >= 32:
                    record[start + (0 if root else 24) : start + 32] = bytes(32 if root else 8)
                break
    except (Malformed, struct.error):
        pass
    return hashlib.sha256(struct.pack("<i", len(record)) + record).hexdigest()


def _attribute(kind: int, number: int, value: bytes) -> bytes:
    body = RESIDENT.pack(len(value), 24, 0) + value
    size = (ATTRIBUTE.size + len(body) + 7) // 8 * 8
    return (ATTRIBUTE.pack(kind, size, 0, 0, 24, 0, number) + body).ljust(size, b"\0")


def build(number: int, sequence: int, names: list[tuple[int, int, str, int]], *, is_dir: bool = False, in_use: bool = True, times: tuple[int, int, int] = (0, 0, 0), size: int = 0, runs: bytes = b"", log: int = 0, stamp: int = 1) -> bytes:
    """A record of names (parent, parent sequence, name, name space) and packed runs, with its fixups."""
    created, written, accessed = times
    parts = [_attribute(TIMES, 0, struct.pack("<qqqqI", created, written, written, accessed, 0x20))]
    for parent, parent_sequence, name, space in names:
        raw = name.encode("utf-16-le")
        parts.append(_attribute(NAME, 1, struct.pack("<QqqqqQQIIBB", parent | parent_sequence << 48, *times[:1] * 4, 0, 0, 0x20, 0, len(raw) // 2, space) + raw))
    if runs:
        body = ELSEWHERE.pack(0, 0, 64, 0, 0, size, size, size) + runs
        whole = (ATTRIBUTE.size + len(body) + 7) // 8 * 8
        parts.append((ATTRIBUTE.pack(DATA, whole, 1, 0, 64, 0, 2) + body).ljust(whole, b"\0"))
    body = b"".join(parts) + struct.pack("<I", END)
    record = bytearray((HEAD.pack(b"FILE", 48, SIZE // SECTOR + 1, log, sequence, len(names), 56, in_use * IN_USE | is_dir * DIRECTORY, 56 + len(body) + 4, SIZE, 0, 3, number >> 32, number & 0xFFFFFFFF) + bytes(8) + body).ljust(SIZE, b"\0"))
    if len(record) > SIZE:
        raise ValueError("too much for one record")
    word = struct.pack("<H", stamp)
    record[48:50] = word
    for k, e in enumerate(range(SECTOR - 2, SIZE, SECTOR)):
        record[50 + 2 * k : 52 + 2 * k] = record[e : e + 2]
        record[e : e + 2] = word
    return bytes(record)


RUN = pa.struct([("vcn", pa.int64()), ("lcn", pa.int64()), ("count", pa.int64())])
FIELDS = [("sequence", pa.int64()), ("is_dir", pa.bool_()), ("parent", pa.int64()), ("parent_sequence", pa.int64()), ("name", pa.string()), ("created", pa.int64()), ("written", pa.int64()), ("accessed", pa.int64()), ("size", pa.int64()), ("reparse", pa.bool_()), ("runs", pa.list_(RUN))]
SCHEMA = "sequence long, is_dir boolean, parent long, parent_sequence long, name string, created long, written long, accessed long, size long, reparse boolean, runs array<struct<vcn: long, lcn: long, count: long>>"


def record_rows(records: DataFrame, number: str, raw: str) -> DataFrame:
    """The names of records (number, raw); torn and malformed ones have a row with a null name, dead ones none."""

    def rows(k, data):
        try:
            return [(k, *r[:-1], [dict(zip(("vcn", "lcn", "count"), x, strict=True)) for x in r[-1]]) for r in parse(data)]
        except (ValueError, struct.error):
            return [(k, *(None,) * len(FIELDS))]

    return per_batch(records, [number, raw], rows, [number, *(n for n, _ in FIELDS)], [pa.int64(), *(t for _, t in FIELDS)], f"{number} long, {SCHEMA}")


def record_runs(records: DataFrame, number: str, raw: str) -> DataFrame:
    """The runs of records (number, raw), once however many names a record has; torn, malformed and dead ones have none."""

    def rows(k, data):
        try:
            return [(k, *run) for run in streams(data)]
        except (ValueError, struct.error):
            return []

    return per_batch(records, [number, raw], rows, [number, "vcn", "lcn", "count"], [pa.int64()] * 4, f"{number} long, vcn long, lcn long, count long")

"""Binary record layouts: journal buffers, partition tables, packed run lists.  Builders serve tests and fixtures."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from . import codecs as Z

#: length, major, minor, file, parent, usn, time, reason, source, security, attributes, name length, name offset (a public Windows layout, version 2)
RECORD = struct.Struct("<IHHQQqqIIIIHH")


def build_journal(rows: list[tuple[int, int, str, int]]) -> bytes:
    """A buffer of (file, parent, name, attributes) records behind the next reference."""
    out = bytearray(struct.pack("<Q", 0))
    for ref, parent, name, attributes in rows:
        raw = name.encode("utf-16-le")
        size = (RECORD.size + len(raw) + 7) // 8 * 8
        out += (RECORD.pack(size, 2, 0, ref, parent, 0, 0, 0, 0, 0, attributes, len(raw), RECORD.size) + raw).ljust(size, b"\0")
    return bytes(out)


def parse_journal(raw: bytes) -> list[tuple[int, int, str, int]]:
    """(file, parent, name, attributes) of each record; a record that overruns the buffer is an error."""
    out, at = [], 8
    while at + RECORD.size <= len(raw):
        size, major, _, ref, parent, _, _, _, _, _, attributes, n, offset = RECORD.unpack_from(raw, at)
        if size < RECORD.size or at + size > len(raw) or offset + n > size or major != 2:
            raise ValueError(f"malformed record at {at}")
        out.append((ref, parent, raw[at + offset : at + offset + n].decode("utf-16-le"), attributes))
        at += size
    if raw and at != len(raw):
        raise ValueError(f"{len(raw) - at} bytes are left over")
    return out


def build_runs(runs: list[tuple[int, int]]) -> bytes:
    """The packed form of (first, count) runs; first < 0 is sparse."""
    out, where = bytearray(), 0
    for first, count in runs:
        size = (count.bit_length() + 7) // 8 or 1
        if first < 0:
            out += bytes([size]) + count.to_bytes(size, "little")
            continue
        step, where = first - where, first
        width = (step.bit_length() + 8) // 8
        out += bytes([width << 4 | size]) + count.to_bytes(size, "little") + step.to_bytes(width, "little", signed=True)
    return bytes(out) + b"\0"


def masked_digest(raw: bytes, masks: list[tuple[int, int]]) -> str:
    """SHA-256 of a record with its volatile (start, length) fields cleared."""
    return hashlib.sha256(Z.zero_ranges(raw, masks)).hexdigest()


def per_batch(df: DataFrame, columns: list[str], rows_of, names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    """A function of a row's values to result rows, run over Arrow batches."""

    def run(batches):
        for batch in batches:
            out = [r for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True) for r in rows_of(*values)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(names), kinds, strict=True)], names)

    return df.select(*columns).mapInArrow(run, schema)


def journal_rows(buffers: DataFrame, column: str) -> DataFrame:
    """Buffers parsed to (ref, parent, name, attributes)."""
    return per_batch(buffers, [column], parse_journal, ["ref", "parent", "name", "attributes"], [pa.int64(), pa.int64(), pa.string(), pa.int64()], "ref long, parent long, name string, attributes long")


def run_rows(lists: DataFrame, key: str, column: str) -> DataFrame:
    """Packed run lists to (key, pos, first, count)."""
    rows = lambda k, raw: [(k, i, first, count) for i, (first, count) in enumerate(Z.data_runs(raw))]
    return per_batch(lists, [key, column], rows, [key, "pos", "first", "count"], [pa.int64()] * 4, f"{key} long, pos long, first long, count long")


def pack_rows(packs: DataFrame, key: str, column: str) -> DataFrame:
    """Pack files to (key, digest, length) of their blobs, each checked."""
    rows = lambda k, raw: [(k, digest, len(data)) for digest, data in Z.read_pack(raw)]
    return per_batch(packs, [key, column], rows, [key, "digest", "length"], [pa.int64(), pa.string(), pa.int64()], f"{key} long, digest string, length long")

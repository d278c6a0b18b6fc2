"""Media columns: payloads kept as lossless 8-bit images in archive files, behind a Spark data source.

Writing (``df.write.format("media_archive")``) takes (key, n_bytes, payload) rows; each task appends
members to archive files, ends every file with an index of member offsets, and renames it into place;
the driver's commit lists the files of successful tasks in a manifest of this write, so files of lost
tasks are never read, appends add up, and an overwrite replaces what was there.  Reading plans one partition per byte range of each listed file: a task reads the file's
index and takes the members that start in its range, a batch of a few megabytes at a time through
Arrow.  A member that cannot be read or fails its checksum is tried again from its own offset,
without touching the others; one that stays broken stops the read, as results must be whole.

A payload is a positive multiple of 576 bytes and is stored as an 8-bit grey PNG 576 samples wide.

Defined cases: a null text is the empty payload before padding; a null key is kept; repeated rows are
members of their own; a very long text is one member, whole in memory of one task; an empty table gives an archive directory without members; extra columns are
not stored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

WIDTH = 576
MANIFEST = "_manifest"
MAGIC = b"MDA1"
#: key present, key, unpadded bytes, stored bytes, checksum of the stored bytes
MEMBER = struct.Struct("<?qqqI")
TRAILER = struct.Struct("<q4s")
PNG = b"\x89PNG\r\n\x1a\n"
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_encode(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey PNG of ``payload``, unfiltered rows of 576 samples."""
    rows = len(payload) // WIDTH
    scan = np.zeros((rows, WIDTH + 1), np.uint8)
    scan[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(scan, level)) + _chunk(b"IEND", b"")


def png_decode(media: bytes) -> bytes:
    """The samples of such a PNG; anything else is an error."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, body, shape = 8, [], None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        at += 12 + size
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
    if shape is None or shape[0] != WIDTH or shape[2:4] != (8, 0):
        raise ValueError("not an 8-bit grey image of the set width")
    scan = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], WIDTH + 1)
    if scan[:, 0].any():
        raise ValueError("filtered rows")
    return scan[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Mean, standard deviation and entropy of the samples, and the share of equal neighbours."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256).astype(np.float64)
    p, v = n / len(x), np.arange(256.0)
    mean = float(p @ v)
    some = p[p > 0]
    return f"mean={mean:.4f};std={float(p @ (v - mean) ** 2) ** 0.5:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};flat={float((x[1:] == x[:-1]).mean()):.4f}"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    files: list


def _manifests(fs, top: str) -> list[str]:
    """The manifests of all committed writes."""
    return sorted(i.path for i in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if i.base_name.startswith(f"{MANIFEST}-") and i.base_name.endswith(".json"))


def _listed(fs, manifest: str) -> list:
    with fs.open_input_stream(manifest) as f:
        return json.loads(f.read())


def _index(fs, path: str, size: int) -> np.ndarray:
    with fs.open_input_file(path) as f:
        f.seek(size - TRAILER.size)
        count, magic = TRAILER.unpack(f.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path}: no index")
        f.seek(size - TRAILER.size - 8 * count)
        return np.frombuffer(f.read(8 * count), "<i8")


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, level: int, overwrite: bool = False):
        self.path, self.level, self.overwrite, self.job = path, level, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        fs, top = _store(self.path)
        done, out, name, offsets, at = [], None, "", [], 0

        def close():
            nonlocal out
            if out is not None:
                index = np.array(offsets, "<i8").tobytes()
                out.write(index + TRAILER.pack(len(offsets), MAGIC))
                out.close()
                fs.move(f"{top}/_tmp-{self.job}-{name}", f"{top}/{name}")
                done.append((name, at + len(index) + TRAILER.size, len(offsets)))
                out = None

        for batch in iterator:
            for key, n_bytes, payload in zip(*(batch.column(c) for c in ("key", "n_bytes", "payload")), strict=True):
                if out is None:
                    name, offsets, at = f"{uuid.uuid4().hex}.mda", [], 0
                    out = fs.open_output_stream(f"{top}/_tmp-{self.job}-{name}")
                media, k = png_encode(payload.as_py(), self.level), key.as_py()
                head = MEMBER.pack(k is not None, k or 0, n_bytes.as_py(), len(media), zlib.crc32(media))
                out.write(head + media)
                offsets.append(at)
                at += len(head) + len(media)
                if at >= ARCHIVE_BYTES:
                    close()
        close()
        return Written(done)

    def commit(self, messages):
        """One manifest a write, under a name of its own: appends add up, and an overwrite removes the earlier ones last."""
        fs, top = _store(self.path)
        old = _manifests(fs, top) if self.overwrite else []
        gone = [f"{top}/{file}" for m in old for name, _, _ in _listed(fs, m) for file in self._files(name)]
        name = f"{top}/{MANIFEST}-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{name}.tmp") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        fs.move(f"{name}.tmp", name)
        for path in [*old, *gone]:
            fs.delete_file(path)
        self._sweep(fs, top)

    def _sweep(self, fs, top):
        """What failed tasks of this write left unfinished."""
        for info in fs.get_file_info(pafs.FileSelector(top)):
            if info.base_name.startswith(f"_tmp-{self.job}-"):
                fs.delete_file(info.path)

    def abort(self, messages):
        fs, top = _store(self.path)
        for m in messages:
            for name, _, _ in m.files if m else ():
                for file in self._files(name):
                    fs.delete_file(f"{top}/{file}")
        self._sweep(fs, top)

    def _files(self, name: str) -> list[str]:
        """The files of an archive."""
        return [name]


@dataclass
class Range(InputPartition):
    name: str
    size: int
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, retries: int):
        self.path, self.range_bytes, self.retries = path, range_bytes, retries

    def partitions(self):
        fs, top = _store(self.path)
        if not (manifests := _manifests(fs, top)):
            raise FileNotFoundError(f"{self.path}: no manifest")
        files = [x for m in manifests for x in _listed(fs, m)]
        return [Range(name, size, a, min(a + self.range_bytes, size)) for name, size, _ in files for a in range(0, size, self.range_bytes)] or [Range("", 0, 0, 0)]

    def read(self, partition):
        if not partition.name:
            return
        fs, top = _store(self.path)
        path = f"{top}/{partition.name}"
        index = self._again(lambda: _index(fs, path, partition.size))
        mine = index[(index >= partition.start) & (index < partition.end)]
        rows, size, f = [], 0, None
        for offset in mine.tolist():
            row, f = self._member(fs, path, f, offset)
            rows.append(row)
            size += len(row[2])
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
        if f is not None:
            f.close()

    def _again(self, read):
        for attempt in range(self.retries + 1):
            try:
                return read()
            except (OSError, struct.error, ValueError):
                if attempt == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)

    def _member(self, fs, path, f, offset):
        """One member by its own offset; a fresh handle for each try after the first."""
        for attempt in range(self.retries + 1):
            try:
                if f is None:
                    f = fs.open_input_file(path)
                f.seek(offset)
                has_key, key, n_bytes, size, crc = MEMBER.unpack(f.read(MEMBER.size))
                media = f.read(size)
                if len(media) != size or zlib.crc32(media) != crc:
                    raise OSError(f"{path}: the member at {offset} is damaged")
                return (key if has_key else None, n_bytes, png_decode(media), len(media), hashlib.sha256(media).hexdigest()), f
            except (OSError, struct.error, ValueError, zlib.error):
                if f is not None:
                    f.close()
                f = None
                if attempt == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)


NAMES = ["key", "n_bytes", "payload", "media_bytes", "media_sha256"]
KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


class MediaArchive(DataSource):
    """Options: path; level (of deflate, when writing); range_bytes and retries (when reading)."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "key long, n_bytes long, payload binary, media_bytes long, media_sha256 string"

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("retries", RETRIES)))

    def writer(self, schema, overwrite):
        fs, top = _store(self.options["path"])
        fs.create_dir(top, recursive=True)
        return Writer(self.options["path"], int(self.options.get("level", 1)), overwrite)


def payloads(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload): whole texts in UTF-8, padded with bytes 255 to a positive multiple of 576."""
    body = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    n = F.octet_length("body")
    pad = F.when(n == 0, F.lit(WIDTH)).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return docs.select(F.col(key).cast("long").alias("key"), body.alias("body")).select("key", n.cast("long").alias("n_bytes"), F.concat("body", F.unhex(F.repeat(F.lit("FF"), pad))).alias("payload"))


def write_archive(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", level: int = 1) -> None:
    docs.sparkSession.dataSource.register(MediaArchive)
    payloads(docs, key=key, text=text).write.format("media_archive").option("level", level).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES, retries: int = RETRIES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("range_bytes", range_bytes).option("retries", retries).load(path)


def measure(media: DataFrame) -> DataFrame:
    """Digests and features of the payloads read back."""

    def run(batches):
        for batch in batches:
            rows = [(p := x.as_py(), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), features(p)) for x in batch.column("payload")]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_bytes"), pa.array(map(len, columns[0]), pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), batch.column("media_bytes"), batch.column("media_sha256"), pa.array(columns[3], pa.string())],
                ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.mapInArrow(run, "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""WARC archives with revisit resolution.

Every page becomes one WARC/1.1 record.  Headers alone (id, payload digest, length, URL) are shuffled
by digest: the smallest id of equal payloads is the response, the others are revisits that refer to
it.  That decision is joined back to the pages by id, and records with fresh headers are written
through a Spark data source: each task fills archives of a bounded size, one gzip member a record, and
renames them into place; the driver's commit lists the archives of successful tasks, so those of lost
tasks are never read.  An archive begins with a warcinfo record, and a file beside it holds the
offsets of its records, so that reading plans byte ranges and any record can be read alone.  Reading
checks every payload against its digest.

A response record is the HTTP response (a status line and fresh headers) with the payload as its
body; a revisit has the HTTP headers only, and names the response by record id, URL and page.  Record
ids are UUIDs of (page, digest).

Defined cases: a null payload is the empty one; a null URL is left out; line ends in a URL become
spaces; rows without an id are responses and are referred to by none; rows that repeat an id with an
equal payload get equal records; a very long payload is one record, whole in memory of one task; an
empty table gives an empty archive folder; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import media

#: Ways in which the rows of one digest are spread over tasks.
SALTS = 8
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The name space of record ids.
PAGES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(PAGES, f'{'' if page is None else page}/{digest}')}>"


def resolve_revisits(heads: DataFrame, *, min_bytes: int = 0, salts: int = SALTS) -> DataFrame:
    """(id, digest, refers_to, refers_url) of each revisit among headers (id, digest, bytes, url).

    Counting per digest is partial before the shuffle; the join back is spread by id, with the small
    side repeated for each salt.
    """
    some = heads.where((F.col("bytes") >= min_bytes) & F.col("id").isNotNull())
    firsts = some.groupBy("digest").agg(F.min(F.struct("id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", F.col("first.id").alias("refers_to"), F.col("first.url").alias("refers_url"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spread = some.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return spread.join(firsts, ["digest", "salt"]).where("id <> refers_to").select("id", "digest", "refers_to", "refers_url").distinct()


def resolved(pages: DataFrame, *, key: str, url: str, payload: str, min_bytes: int) -> DataFrame:
    """(id, url, body, digest, refers_to, refers_url) of each page; the digest in hex."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    clean = F.regexp_replace(F.col(url).cast("string"), "[\r\n]", " ")
    page = pages.select(F.col(key).cast("long").alias("id"), clean.alias("url"), body.alias("body")).withColumn("digest", F.sha1("body"))
    revisits = resolve_revisits(page.select("id", "digest", F.octet_length("body").alias("bytes"), "url"), min_bytes=min_bytes)
    return page.join(revisits, ["id", "digest"], "left").select("id", "url", "body", "digest", "refers_to", "refers_url")


def _member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """A record as a gzip member of its own."""
    head = "".join(["WARC/1.1\r\n", *(f"{name}: {value}\r\n" for name, value in fields), f"Content-Length: {len(block)}\r\n\r\n"])
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + END) + pack.flush()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(page: int | None, url: str | None, body: bytes, digest_hex: str, refers_to: int | None, refers_url: str | None, date: str, level: int) -> bytes:
    """The record of a page."""
    digest = base32(digest_hex)
    again = refers_to is not None
    block = _http(len(body)) + (b"" if again else body)
    fields = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())]
    if page is not None:
        fields.append(("Page-ID", str(page)))
    fields.append(("Payload-Length", str(len(body))))
    if again:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", str(refers_to))]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", refers_url))
    return _member([*fields, ("Content-Type", "application/http; msgtype=response")], block, level)


class Writer(media.Writer):
    """Archives of records; what is committed, swept and replaced is as for media archives."""

    def __init__(self, path: str, date: str, level: int, archive_bytes: int, overwrite: bool):
        super().__init__(path, level, overwrite)
        self.date, self.archive_bytes = date, archive_bytes

    def write(self, iterator):
        fs, top = media._store(self.path)
        done, out, name, offsets, at = [], None, "", [], 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                with fs.open_output_stream(f"{top}/{name}.offsets") as f:
                    f.write(np.array(offsets, "<i8").tobytes())
                fs.move(f"{top}/_tmp-{self.job}-{name}", f"{top}/{name}")
                done.append((name, at, len(offsets)))
                out = None

        for batch in iterator:
            for row in zip(*(batch.column(c) for c in ("id", "url", "body", "digest", "refers_to", "refers_url")), strict=True):
                if out is None:
                    name, offsets = f"{uuid.uuid4().hex}.warc.gz", []
                    out = fs.open_output_stream(f"{top}/_tmp-{self.job}-{name}", compression=None)
                    info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.level)
                    out.write(info)
                    at = len(info)
                raw = record(*(x.as_py() for x in row), self.date, self.level)
                out.write(raw)
                offsets.append(at)
                at += len(raw)
                if at >= self.archive_bytes:
                    close()
        close()
        return media.Written(done)

    def _files(self, name: str) -> list[str]:
        return [name, f"{name}.offsets"]


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record's gzip member, or of the first of several."""
    data = zlib.decompressobj(31).decompress(raw)
    cut = data.find(END)
    lines = data[:cut].decode().split("\r\n") if cut >= 0 else [""]
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {data[:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    end = cut + 4 + int(headers["Content-Length"])
    if data[end:] != END:
        raise ValueError(f"{headers.get('WARC-Record-ID')}: a record of another length")
    return headers, data[cut + 4 : end]


@dataclass
class Range(InputPartition):
    name: str
    size: int
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, with_payload: bool):
        self.path, self.range_bytes, self.with_payload = path, range_bytes, with_payload

    def partitions(self):
        fs, top = media._store(self.path)
        if not (manifests := media._manifests(fs, top)):
            raise FileNotFoundError(f"{self.path}: no manifest")
        files = [x for m in manifests for x in media._listed(fs, m)]
        return [Range(name, size, a, min(a + self.range_bytes, size)) for name, size, _ in files for a in range(0, size, self.range_bytes)] or [Range("", 0, 0, 0)]

    def read(self, partition):
        """The records that start in the range, one after another, a few megabytes a batch."""
        if not partition.name:
            return
        fs, top = media._store(self.path)
        with fs.open_input_file(f"{top}/{partition.name}.offsets") as f:
            index = np.append(np.frombuffer(f.read(), "<i8"), partition.size)
        mine = np.flatnonzero((index[:-1] >= partition.start) & (index[:-1] < partition.end))
        rows, size = [], 0
        if len(mine):
            first, last = int(index[mine[0]]), int(index[mine[-1] + 1])
            with fs.open_input_file(f"{top}/{partition.name}") as f:
                f.seek(first)
                raw = memoryview(f.read(last - first))
        for k in mine.tolist():
            rows.append(self._row(raw[index[k] - first : index[k + 1] - first]))
            size += 200 + len(rows[-1][-1] or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, raw: bytes) -> tuple:
        h, block = parse(raw)
        body = block[block.find(END) + 4 :]
        digest, again = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"] == "revisit"
        if not again and (base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != int(h["Payload-Length"])):
            raise ValueError(f"{h['WARC-Record-ID']}: its payload has another digest")
        number = lambda name: int(h[name]) if name in h else None
        return number("Page-ID"), h.get("WARC-Target-URI"), h["WARC-Type"], digest, int(h["Payload-Length"]), number("Refers-To-Page-ID"), body if self.with_payload else None

    @staticmethod
    def _batch(rows) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "url", "record_type", "digest", "bytes", "refers_to", "payload"])


class WarcArchive(DataSource):
    """Options: path; date, level (of deflate) and archive_bytes (when writing); range_bytes and payload (when reading)."""

    @classmethod
    def name(cls):
        return "warc_archive"

    def schema(self):
        return "id long, url string, record_type string, digest string, bytes long, refers_to long, payload binary"

    def reader(self, schema):
        return Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self.options.get("payload", "false") == "true")

    def writer(self, schema, overwrite):
        fs, top = media._store(self.options["path"])
        fs.create_dir(top, recursive=True)
        return Writer(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("level", 1)), int(self.options.get("archive_bytes", ARCHIVE_BYTES)), overwrite)


def write_archives(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Deduplicated archives under ``path``, in place of those already there."""
    pages.sparkSession.dataSource.register(WarcArchive)
    rows = resolved(pages, key=key, url=url, payload=payload, min_bytes=min_bytes)
    rows.write.format("warc_archive").option("date", date).option("archive_bytes", archive_bytes).mode("overwrite").save(path)


def read_archives(spark, path: str, *, with_payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives: id, url, type, digest, payload length, what it refers to, and if asked for the payload (empty for a revisit)."""
    spark.dataSource.register(WarcArchive)
    rows = spark.read.format("warc_archive").option("range_bytes", range_bytes).option("payload", str(with_payload).lower()).load(path)
    return rows if with_payload else rows.drop("payload")

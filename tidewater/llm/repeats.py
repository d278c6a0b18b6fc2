"""Removal of repeated byte strings by prefix-free parsing.

Every WIDTH-byte window of a text has a trigger: the leftmost smallest rolling hash among its first
REACH places, so windows with equal bytes have equal triggers at equal distances.  Triggers cut the
text into phrases.  The corpus is dealt into shards of a few megabytes and parsed three times:

1. Each shard sends the hashes of the BLOCK bytes at its triggers (the dictionary's entries) to
   buckets, which answer with those that several shards hold.  All else can't repeat elsewhere.
2. Around the triggers of repeated entries, the phrase's head (the bytes before the trigger) and the
   parse that follows are put in order: a suffix array of the heads, read backwards from the trigger,
   and one of the parse suffixes, each with its common-prefix lengths.  A window whose head part has
   d bytes is the pair (class of heads agreeing on d bytes, class of parse suffixes agreeing on
   WIDTH - d bytes), which combines both arrays into the corpus order; equal pairs are equal windows,
   byte by byte.  A shard settles its own repeats first and sends one copy of each open window on, so a
   passage in a third of all documents reaches a bucket once a shard at most.
3. Buckets settle windows of several shards; every shard then covers its marked windows.

Equal texts are reduced before the shuffle: only the first copy is parsed, and a later one of at
least WIDTH bytes goes entirely.

Defined cases: null is the empty text; texts under WIDTH bytes keep everything; a null id is smaller
than any other; rows that repeat an id with other texts are versions of one document, between which
only the start decides (an equal start is not earlier); identical rows get equal results; extra
columns are carried by ``remove_repeats`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb

WIDTH = 100
REACH = 51
BLOCK = WIDTH + 1 - REACH
#: Positions handled at a time.
STRIDE = 1 << 19
SHARD_BYTES = 2 << 20
#: Text bytes for each bucket, and how many buckets there are at least.
BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 256
#: Digests that a task remembers, so as to send a hot text on once.
SEEN = 500_000
NO_ID = -(1 << 63)


def triggers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, first window, last window): runs of consecutive windows that have one trigger; windows never cross documents."""
    n = len(data)
    last = offsets[1:] - WIDTH  # of each document
    out = []
    padded = np.concatenate([data, np.zeros(REACH + 16, np.uint8)])
    for a in range(0, n, STRIDE):
        b = min(a + STRIDE, n)
        part = padded[a : b + REACH + 7]
        v = np.ndarray((len(part) - 7,), "<u8", buffer=np.ascontiguousarray(part), strides=(1,)).copy()
        h = v * tb._C1
        h ^= h >> tb.U(29)
        h *= tb._C2
        h &= tb.U(0xFFFFFFFF00000000)
        h |= np.arange(len(h), dtype=tb.U)
        least, size = h, 1
        while size * 2 <= REACH:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < REACH:
            least = np.minimum(least[: len(h) - REACH + 1], least[REACH - size : len(h) - size + 1])
        owner = (least[: b - a] & tb.U(0xFFFFFFFF)).astype(np.int64) + a
        valid = np.zeros(b - a + 1, np.int32)
        lo, hi = np.clip(offsets[:-1], a, b) - a, np.clip(last + 1, a, b) - a
        some = hi > lo
        np.add.at(valid, lo[some], 1)
        np.add.at(valid, hi[some], -1)
        ok = np.cumsum(valid[:-1]) > 0
        edge = np.ones(b - a, bool)
        edge[1:] = owner[1:] != owner[:-1]
        # the first window of a document starts a run of its own
        edge[lo[some]] = True
        edge[1:] |= ok[1:] != ok[:-1]
        start = np.flatnonzero(edge)
        stop = np.append(start[1:], b - a) - 1
        keep = ok[start]
        out.append((owner[start[keep]], start[keep] + a, stop[keep] + a))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def entries(data: np.ndarray, q: np.ndarray) -> np.ndarray:
    return tb.span_hashes(data, q, q + BLOCK)


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """A shard's distinct texts in order of (id, digest): ids, bytes, offsets, digests."""
    table = table.select(["node", "same", "text"]).sort_by([("same", "ascending"), ("node", "ascending")])
    same = table["same"].to_pylist()
    first = [i for i in range(len(same)) if not i or same[i] != same[i - 1]]
    table = table.take(first).sort_by([("node", "ascending"), ("same", "ascending")])
    data, offsets = tb.utf8(table["text"].cast(pa.large_string()))
    return table["node"].to_numpy(), data, offsets, table["same"].to_pylist()


def _classes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the rows (fixed-width byte strings) and the common prefix of each with the one before."""
    n, width = matrix.shape
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{width}").ravel(), kind="stable")
    common = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 15):
        b = min(a + (1 << 15), n)
        same = matrix[order[a:b]] == matrix[order[a - 1 : b - 1]]
        common[a:b] = np.where(same.all(1), width, same.argmin(1))
    return order, common


def settle(node: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, heads: np.ndarray, parse: np.ndarray) -> np.ndarray:
    """Which windows (occurrence x distance from window start to trigger) also start earlier.

    heads: the REACH - 1 bytes before each trigger, read backwards; parse: the WIDTH bytes from it on.
    Windows of an occurrence are those at distances low to high.
    """
    n = len(q)
    marked = np.zeros((n, REACH), bool)
    if n < 2:
        return marked
    by = np.lexsort((q, node))
    rank = np.zeros(n, np.int64)
    new = np.ones(n, np.int64)
    new[1:] = (node[by][1:] != node[by][:-1]) | (q[by][1:] != q[by][:-1])
    rank[by] = np.cumsum(new)
    head_order, head_common = _classes(heads)
    parse_order, parse_common = _classes(parse)
    place = np.arange(n)
    for d in range(REACH):
        on = by[(low[by] <= d) & (d <= high[by])]
        if len(on) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[head_order] = np.maximum.accumulate(np.where(head_common < d, place, 0)) if d else 0
        b[parse_order] = np.maximum.accumulate(np.where(parse_common < WIDTH - d, place, 0))
        key = a[on] * n + b[on]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        marked[on, d] = rank[on] > rank[on[first[back]]]
    return marked


def _context(padded: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads and parse of triggers in text that has REACH bytes before and WIDTH after it."""
    at = q[:, None] + REACH
    return padded[at - np.arange(1, REACH)[None]], padded[at + np.arange(WIDTH)[None]]


def _bounded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(WIDTH, np.uint8)])


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], "<i8").tobytes()
    return zs.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zs.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", 2 * count, 8).reshape(count, 2).tolist()
    at, out = 8 + 16 * count, []
    for width, n in sizes:
        out.append(np.frombuffer(raw, {1: "u1", 4: "<i4", 8: "<i8"}[width], n, at))
        at += width * n
    return out


KIND = "bucket int, shard long, blob binary"
NAMES, TYPES = ["bucket", "shard", "blob"], [pa.int32(), pa.int64(), pa.binary()]


def _out(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def _shard(table: pa.Table) -> int:
    return table["shard"][0].as_py()


def _announce(table: pa.Table, buckets: int) -> pa.Table:
    """Pass 1, a shard: the distinct entries at its triggers, by bucket."""
    _, data, offsets, _ = _rows(table)
    q, _, _ = triggers(data, offsets)
    h = np.unique(entries(data, np.unique(q)))
    bucket = (h % tb.U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return _out([(k, _shard(table), h[order[a:b]].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])


def _common(table: pa.Table) -> pa.Table:
    """Pass 1, a bucket: to each shard the entries that another one holds too."""
    blobs, shards = [np.frombuffer(x.as_py(), "<u8") for x in table["blob"]], table["shard"].to_pylist()
    _, back, count = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    # all shards at once: a search for each takes time by the square of the corpus
    parts = np.split(count[back] > 1, np.cumsum([len(b) for b in blobs])[:-1])
    return _out([(0, s, b[again].tobytes()) for s, b, again in zip(shards, blobs, parts, strict=True) if again.any()])


def _marked(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, smallest, largest distance) of the runs of marked windows."""
    edge = np.zeros((len(marked), REACH + 1), np.int8)
    edge[:, :-1] += marked
    edge[:, 1:] -= marked
    i, near = np.nonzero(edge > 0)
    return i, near, np.nonzero(edge < 0)[1] - 1


def _runs(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked windows (document, first start, last start), those that touch as one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order], first[order], last[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] - last[:-1] > 1)
    at = np.flatnonzero(new)
    return doc[at].astype("<i4"), first[at].astype("<i4"), last[np.append(at[1:], len(last)) - 1].astype("<i4") if len(at) else np.empty(0, "<i4")


def _offer(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """Pass 2, a shard: its own repeats, and one copy of each window that other shards may hold."""
    if not left.num_rows:
        return _out([])
    shard = _shard(left)
    node, data, offsets, _ = _rows(left)
    q, lo, hi = triggers(data, offsets)
    h = entries(data, q)
    outside = np.unique(np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in right["blob"]])) if right.num_rows else np.empty(0, tb.U)
    value, count = np.unique(h, return_counts=True)
    shared = np.isin(h, outside)
    on = shared | np.isin(h, value[count > 1])
    q, lo, hi, h, shared = q[on], lo[on], hi[on], h[on], shared[on]
    if not len(q):
        return _out([])
    doc = np.searchsorted(offsets, q, side="right") - 1
    low, high = q - hi, q - lo
    padded = _bounded(data)
    rows, marks = [], []
    part = (h % tb.U(buckets)).astype(np.int64)
    # a slice of the hash space at a time keeps the context matrices small
    step = max(1, -(-len(q) // 40_000))
    for k in range(step):
        mine = np.flatnonzero((h >> tb.U(32)).astype(np.int64) % step == k)
        if not len(mine):
            continue
        marked = settle(node[doc[mine]], q[mine] - offsets[doc[mine]], low[mine], high[mine], *_context(padded, q[mine]))
        i, least, most = _marked(marked)
        at = q[mine[i]] - offsets[doc[mine[i]]]
        marks.append((doc[mine[i]], at - most, at - least))
        span = np.arange(REACH)[None]
        open_ = (span >= low[mine][:, None]) & (span <= high[mine][:, None]) & ~marked & shared[mine][:, None]
        some = open_.any(1)
        sent = mine[some]
        near, far = open_[some].argmax(1), REACH - 1 - open_[some][:, ::-1].argmax(1)
        order = np.argsort(part[sent], kind="stable")
        sent, near, far = sent[order], near[order], far[order]
        cut = np.searchsorted(part[sent], np.arange(buckets + 1))
        for bucket in np.unique(part[sent]):
            x = slice(cut[bucket], cut[bucket + 1])
            s, n_, f_ = sent[x], near[x], far[x]
            size = f_ + WIDTH - n_
            at = np.repeat(q[s] - f_, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            rows.append((int(bucket), shard, _pack(node[doc[s]], doc[s].astype("<i4"), (q[s] - offsets[doc[s]]).astype("<i4"), n_.astype("u1"), f_.astype("u1"), data[at])))
    found = _runs(*(np.concatenate(x) for x in zip(*marks, strict=True)))
    if len(found[0]):
        rows.append((buckets + shard % buckets, shard, _pack(*found)))
    return _out(rows)


def _settle_bucket(table: pa.Table, buckets: int) -> pa.Table:
    """Pass 2, a bucket: windows of several shards; a shard's own marks pass through."""
    if table["bucket"][0].as_py() >= buckets:
        return table.select(NAMES)
    shards = np.array(table["shard"].to_pylist())
    parts = [_unpack(x.as_py()) for x in table["blob"]]
    who = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    node, doc, q, near, far = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(5))
    data = np.concatenate([p[5] for p in parts])
    size = far + WIDTH - near
    start = np.cumsum(size) - size
    h = tb.span_hashes(data, start + far, start + far + BLOCK)
    found = []
    step = max(1, -(-len(q) // 60_000))
    padded = _bounded(data)
    for k in range(step):
        mine = np.flatnonzero((h >> tb.U(20)).astype(np.int64) % step == k)
        if not len(mine):
            continue
        # bytes before or after an occurrence's own belong to others, and lie outside all its windows
        marked = settle(node[mine], q[mine], near[mine], far[mine], *_context(padded, start[mine] + far[mine]))
        i, least, most = _marked(marked)
        i = mine[i]
        found.append((shards[who[i]], doc[i], q[i] - most, q[i] - least))
    # dealt out to the shards by one sort: a pass for each takes time by the square of the corpus
    shard, *runs = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(shard):
        return _out([])
    order = np.argsort(shard, kind="stable")
    whose, cut = np.unique(shard[order], return_index=True)
    return _out([(0, s, _pack(*_runs(*(x[mine] for x in runs)))) for s, mine in zip(whose.tolist(), np.split(order, cut[1:]), strict=True)])


RESULT = "same binary, node long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cover(left: pa.Table, right: pa.Table, with_text: bool) -> pa.Table:
    """Pass 3, a shard: what is left of each text."""
    names = ["same", "node", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
    rows = []
    if left.num_rows:
        node, data, offsets, same = _rows(left)
        edge = np.zeros(len(data) + 1, np.int32)
        for x in right["blob"]:
            doc, first, last = _unpack(x.as_py())
            np.add.at(edge, offsets[doc] + first, 1)
            np.add.at(edge, offsets[doc] + last + WIDTH, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            g = gone[a:b]
            kept = data[a:b][~g].tobytes()
            rows.append((same[k], int(node[k]), b - a, int(g.sum()), int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and g[0])), hashlib.sha256(kept).hexdigest(), *[kept.decode(errors="ignore")] * with_text))
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _first_copies(batches):
    """Of the rows of a task with one digest, the one with the smallest id, or few more: hot copies don't reach the shuffle."""
    least: dict[bytes, int] = {}
    for batch in batches:
        if len(least) > SEEN:
            least.clear()
        keep, at = [], {}
        for row, (same, node) in enumerate(zip(batch.column("same").to_pylist(), batch.column("node").to_pylist(), strict=True)):
            if same not in least or node < least[same]:
                least[same] = node
                if same in at:  # an earlier row of this batch has had its turn
                    keep[at[same]] = row
                else:
                    at[same] = len(keep)
                    keep.append(row)
        yield batch.take(pa.array(sorted(keep), pa.int64()))


def _parsed(docs: DataFrame, with_text: bool, shard_bytes: int) -> DataFrame:
    """Results of the first copy of each text, by its digest."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards, buckets = max(1, -(-size // shard_bytes)), int(max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    rows = docs.select("node", "same", "text").mapInArrow(_first_copies, "node long, same binary, text string")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("same"), F.lit(shards).cast("long")))
    dealt = rows.groupBy("shard")
    told = dealt.applyInArrow(lambda t: _announce(t, buckets), KIND).groupBy("bucket").applyInArrow(_common, KIND)
    offers = dealt.cogroup(told.groupBy("shard")).applyInArrow(lambda a, b: _offer(a, b, buckets), KIND)
    marks = offers.groupBy("bucket").applyInArrow(lambda t: _settle_bucket(t, buckets), KIND)
    return dealt.cogroup(marks.groupBy("shard")).applyInArrow(lambda a, b: _cover(a, b, with_text), RESULT + ", kept string" * with_text)


def _keyed(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("node"), F.unhex(F.md5(body)).alias("same"), *more, body.alias("text"))


def find_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: its bytes, removed bytes, removed runs, and the digest of what is kept."""
    rows = _keyed(docs, key, text, F.col(key).cast("long").alias("key"))
    found = _parsed(rows, False, shard_bytes).select("same", F.col("node").alias("first"), "n_removed", "n_spans", "kept_sha256")
    out = rows.select("key", "node", "same", F.octet_length("text").cast("long").alias("n_bytes")).join(found, "same")
    copy = (F.col("node") != F.col("first")) & (F.col("n_bytes") >= WIDTH)
    return out.select(
        F.col("key").alias(key), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents (all columns) with repeated bytes gone from the text; a character that loses part of its bytes goes too."""
    rows = _keyed(docs, key, text, F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("row"))
    found = _parsed(rows, True, shard_bytes).select("same", F.col("node").alias("first"), "kept")
    out = rows.select("row", "node", "same", F.octet_length("text").alias("n")).join(found, "same")
    kept = F.when((F.col("node") != F.col("first")) & (F.col("n") >= WIDTH), F.lit("")).otherwise(F.col("kept"))
    return out.withColumn("kept", kept).select(*(F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))

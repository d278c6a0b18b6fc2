"""Whole Arrow text columns as flat byte buffers, and words as 64-bit hashes.

Everything here works on many documents at once: a text column becomes one byte array with
document offsets, words are found by a byte class table, and hashes are computed with array
operations.  A word is a maximal run of ASCII digits, ASCII letters and bytes >= 0x80; A-Z are
lower-cased.  Nulls count as empty texts, and no word crosses a document's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
LONG_WORD = 256  # bytes from which a word is hashed on its own

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_lo:_hi] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * _C2
    x = x ^ (x >> U(27))
    x = x * _C3
    return x ^ (x >> U(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (with a last entry)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    w = IS_WORD[data]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = w[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = w[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def _load(padded: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit words at every byte position."""
    return np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, taken eight bytes a step."""
    n = (e - s).astype(np.int64)
    h = mix(n.astype(U) * _C1 + U(1))
    if not len(n):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = _load(padded)
    live, k = np.flatnonzero((n > 0) & (n <= LONG_WORD)), 0
    while len(live):
        left = n[live] - k
        v = at8[s[live] + k]
        part = left < 8
        if part.any():
            v[part] &= (U(1) << (U(8) * left[part].astype(U))) - U(1)
        h[live] = mix((h[live] ^ v) * _C1 + U(k + 1))
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(n > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[s[i] : e[i]].tobytes())
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words and each document's first word index (with a last entry)."""
    s, e, first = word_bounds(data, offsets)
    return span_hashes(LOWER[data], s, e), first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words inside a document and the number of shingles of each document.

    A document of fewer words, but not none, has one shingle of all its words.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    begin = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n[doc], k)
    out = mix(size.astype(U) * _C3)
    for j in range(k):
        on = size > j
        if on.all():
            out = mix((out ^ h[begin + j]) * _C1)
        else:
            out[on] = mix((out[on] ^ h[begin[on] + j]) * _C1)
    return out, count


def sharded(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut and joined so that each holds about ``limit`` text bytes (one longer row stands alone)."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            room = limit - size
            upto = int(np.searchsorted(off, off[at] + room, side="right")) - 1
            if upto <= at:
                if held:
                    yield _joined(held)
                    held, size = [], 0
                    continue
                upto = at + 1
            held.append(batch.slice(at, upto - at))
            size += int(off[upto] - off[at])
            at = upto
            if size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)

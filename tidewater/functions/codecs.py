"""Byte codecs: content-defined chunking, compression, deltas, parity, packs.  Pure functions of bytes, and their Arrow forms."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# content-defined chunks

WINDOW = 32
_M64 = (1 << 64) - 1


def rolling_table(seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """256 32-bit values: the high halves of a SplitMix64 sequence whose state steps before each output."""
    state, out = seed, []
    for _ in range(256):
        state = state + 0x9E3779B97F4A7C15 & _M64
        z = state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _M64
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _M64
        out.append((z ^ z >> 31) >> 32)
    return np.array(out, np.uint32)


_TABLE = rolling_table()


def cyclic_hashes(data: np.ndarray) -> np.ndarray:
    """The cyclic-polynomial hash after each byte, over the last WINDOW bytes: of windows twice as long from those of half the length."""
    out, size = _TABLE[data], 1
    while size < min(WINDOW, len(data)):
        x = out[:-size]
        turned = (x << np.uint32(size)) | (x >> np.uint32(32 - size))
        out = out.copy()
        out[size:] ^= turned
        size *= 2
    return out


def cdc_cuts(data: bytes, average: int) -> list[int]:
    """Ends of content-defined chunks: at least min bytes and the masked hash zero, or max bytes; the window runs on across cuts."""
    low = max(average // 4, 64)
    high = max(min(4 * average, 64 << 20), low)
    mask = (1 << max(average - low, 1).bit_length() - 1) - 1
    places = np.flatnonzero(cyclic_hashes(np.frombuffer(data, np.uint8)) & np.uint32(mask) == 0) + 1 if data else []
    cuts, at = [], 0
    while at < len(data):
        k = int(np.searchsorted(places, at + low))
        end = min(int(places[k]) if k < len(places) else len(data), at + high, len(data))
        cuts.append(end)
        at = end
    return cuts


def cdc_chunks(docs: DataFrame, average: int) -> DataFrame:
    """(doc_id, idx, offset, length, digest) of the content-defined chunks of each text."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw, at = (t or "").encode(), 0
                for i, end in enumerate(cdc_cuts(raw, average)):
                    rows.append((k, i, at, end - at, hashlib.sha256(raw[at:end]).hexdigest()))
                    at = end
            yield _batch(rows, ["doc_id", "idx", "offset", "length", "digest"], [pa.int64()] * 4 + [pa.string()])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, idx long, offset long, length long, digest string")


def _batch(rows, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names)


# compression

RAW, ZSTD, DELTA = 0, 1, 2


def encode(data: bytes, level: int = 3) -> tuple[int, bytes]:
    """(codec, stored): raw unless compression makes it smaller."""
    return encode_all([data], level)[0]


def encode_all(chunks: list[bytes], level: int = 3) -> list[tuple[int, bytes]]:
    """encode() of each chunk; one compressor serves all."""
    pack = zs.ZstdCompressor(level=level).compress
    return [(ZSTD, packed) if len(packed := pack(data)) < len(data) else (RAW, data) for data in chunks]


def delta(data: bytes, base: bytes, level: int = 3) -> bytes:
    """A patch from ``base``, which serves as a raw dictionary."""
    log = max(10, min(27, (len(base) + len(data)).bit_length()))
    settings = zs.ZstdCompressionParameters.from_level(level, window_log=log, enable_ldm=True)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(base, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=settings).compress(data)


def encode_delta(data: bytes, base: bytes, level: int = 3) -> tuple[int, bytes]:
    """The patch if it pays with its 32-byte base digest, else the plain encoding."""
    codec, whole = encode(data, level)
    patch = delta(data, base, level)
    return (DELTA, patch) if 32 + len(patch) < len(whole) else (codec, whole)


def decode(codec: int, stored: bytes, base: bytes | None = None, plain: zs.ZstdDecompressor | None = None) -> bytes:
    """The chunk's bytes; ``plain`` is a decompressor to use again for chunks without a base."""
    if codec == RAW:
        return stored
    if codec == ZSTD:
        return (plain or zs.ZstdDecompressor()).decompress(stored)
    if base is None:
        raise ValueError("a delta needs its base")
    return zs.ZstdDecompressor(dict_data=zs.ZstdCompressionDict(base, dict_type=zs.DICT_TYPE_RAWCONTENT)).decompress(stored)


def compressed(docs: DataFrame, level: int = 3) -> DataFrame:
    """(doc_id, codec, plain, stored, ok) of each text, decoded again for proof."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (t or "").encode()
                codec, stored = encode(raw, level)
                rows.append((k, codec, len(raw), len(stored), decode(codec, stored) == raw))
            yield _batch(rows, ["doc_id", "codec", "plain", "stored", "ok"], [pa.int64()] * 4 + [pa.bool_()])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, codec long, plain long, stored long, ok boolean")


# parity over GF(256), reduction 0x11B, generator 3

WIDTH = 128


def _field() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x ^= x << 1 ^ (0x11B if x << 1 & 0x100 else 0)
        x &= 0xFF
    return exp, log


_EXP, _LOG = _field()


def _mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = _EXP[_LOG[a] + _LOG[b]]
    return np.where((a == 0) | (b == 0), 0, out)


def _generator(parity: int) -> np.ndarray:
    g = np.array([1], np.int64)
    for i in range(parity):
        g = np.append(g, 0) ^ np.append(0, _mul(g, np.full(len(g), _EXP[i])))
    return g


#: Stripes that are worked on at a time.
STRIPES = 1 << 13


@functools.cache
def _remainders(count: int) -> np.ndarray:
    """Parity of a stripe that holds one byte alone, in words of 64 bits: [word, place, byte].  A stripe's parity is the sum over its bytes."""
    g, alone = _generator(count)[1:], np.zeros((WIDTH, count), np.int64)
    row = g
    for i in reversed(range(WIDTH)):
        alone[i] = row
        row = np.append(row[1:], 0) ^ _mul(np.full(count, row[0]), g)
    table = np.zeros((WIDTH, 256, -(-count // 8) * 8), np.uint8)
    table[:, :, :count] = _mul(np.arange(256)[None, :, None], alone[:, None])
    return np.ascontiguousarray(table.view("<u8").transpose(2, 0, 1))


def _parities(block: np.ndarray, count: int) -> np.ndarray:
    """Parity of stripes: (n, WIDTH) bytes to (n, count)."""
    tables = _remainders(count)
    out = np.zeros((len(block), len(tables)), "<u8")
    for at in range(0, len(block), STRIPES):
        places = np.ascontiguousarray(block[at : at + STRIPES].T)
        for word, table in enumerate(tables):
            total = np.zeros(places.shape[1], "<u8")
            for row, column in zip(table, places, strict=True):
                total ^= row.take(column)
            out[at : at + STRIPES, word] = total
    return out.view(np.uint8)[:, :count]


def _stripes(chunks: list[bytes], width: int, counts: list[int]) -> np.ndarray:
    """Chunks as whole stripes, cut to so many or padded with zeros."""
    return np.frombuffer(b"".join(c[: n * width].ljust(n * width, b"\0") for c, n in zip(chunks, counts, strict=True)), np.uint8).reshape(-1, width)


def parity(data: bytes, count: int) -> bytes:
    """``count`` parity bytes for each stripe of WIDTH data bytes (the last one padded with zeros)."""
    return parity_all([data], count)[0]


def parity_all(chunks: list[bytes], count: int) -> list[bytes]:
    """parity() of each chunk, all stripes at once."""
    n = [-(-len(c) // WIDTH) for c in chunks]
    rest, ends = _parities(_stripes(chunks, WIDTH, n), count).tobytes(), np.cumsum(n, dtype=np.int64) * count
    return [rest[end - k * count : end] for k, end in zip(n, ends.tolist(), strict=True)]


def _syndromes(word: np.ndarray, count: int) -> np.ndarray:
    s = np.zeros(count, np.int64)
    for c in word:
        s = _mul(s, _EXP[np.arange(count)]) ^ c
    return s


def repair(data: bytes, ecc: bytes, count: int) -> bytes | None:
    """The data with up to count // 2 wrong bytes a stripe put right; None if a stripe can't be."""
    return repair_all([data], [ecc], count)[0]


def repair_all(chunks: list[bytes], eccs: list[bytes], count: int) -> list[bytes | None]:
    """repair() of each chunk, all stripes at once; parity that is missing counts as zeros."""
    n = [-(-len(c) // WIDTH) for c in chunks]
    block, ecc = _stripes(chunks, WIDTH, n).copy(), _stripes(eccs, count, n)
    ends = np.cumsum(n, dtype=np.int64)
    size = np.full(len(block), WIDTH)
    size[ends[np.array(n, np.int64) > 0] - 1] = [(len(c) - 1) % WIDTH + 1 for c in chunks if c]
    rest = _parities(block, count) ^ ecc
    lost = np.zeros(len(block) + 1, np.int64)
    spoilt = np.flatnonzero(rest.any(1))
    for at in range(0, len(spoilt), STRIPES):
        rows = spoilt[at : at + STRIPES]
        # what is left of a word beyond the generator has the word's syndromes
        s = np.zeros((len(rows), count), np.int64)
        for c in rest[rows].T.astype(np.int64):
            s = _mul(s, _EXP[np.arange(count)]) ^ c[:, None]
        places, values, found = _located(s, count)
        for place, value in zip(places.T, values.T, strict=True):
            inside = found & (place < WIDTH) & (value > 0)
            lost[rows[inside & (place >= size[rows])]] = 1
            block[rows[inside], place[inside]] ^= value[inside].astype(np.uint8)
        for k, whole in zip(rows[~found], s[~found], strict=True):
            fixed = _fix(np.append(block[k], ecc[k]).astype(np.int64), whole, count) if count // 2 > 2 else None
            lost[k] = fixed is None or fixed[size[k] : WIDTH].any()
            if fixed is not None:
                block[k] = fixed[:WIDTH]
    raw, bad = block.tobytes(), np.append(0, np.cumsum(lost))
    return [None if bad[end] > bad[end - k] else raw[(end - k) * WIDTH : (end - k) * WIDTH + len(c)] for c, k, end in zip(chunks, n, ends.tolist(), strict=True)]


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b in the field; 0 where a or b is."""
    return np.where((a == 0) | (b == 0), 0, _EXP[_LOG[a] + 255 - _LOG[b]])


def _located(s: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One or two wrong bytes of each word by its syndromes: their places and values (n, 2), and which words they put right.  _fix() in closed form."""
    n = WIDTH + count
    power, value, found = np.zeros((len(s), 2), np.int64), np.zeros((len(s), 2), np.int64), np.zeros(len(s), bool)

    def proven(rows, powers, values):
        good = np.ones(len(rows), bool)
        for i in range(count):
            good &= np.bitwise_xor.reduce(_mul(values, _EXP[powers * i % 255]), 1) == s[rows, i]
        power[rows[good], : powers.shape[1]], value[rows[good], : values.shape[1]], found[rows[good]] = powers[good], values[good], True

    if count >= 2:
        x = _quotient(s[:, 1], s[:, 0])
        rows = np.flatnonzero((x > 0) & (_LOG[x] < n))
        proven(rows, _LOG[x[rows]][:, None], s[rows, :1])
    if count >= 4:
        a, b, c, d = s[:, :4].T
        det = _mul(a, c) ^ _mul(b, b)
        rows = np.flatnonzero(~found & (det > 0))
        low, high = _quotient(_mul(c, c) ^ _mul(b, d), det)[rows], _quotient(_mul(a, d) ^ _mul(b, c), det)[rows]
        x = _EXP[np.arange(n) % 255]
        zero = low[:, None] ^ _mul(high[:, None], x) ^ _mul(x, x) == 0
        two = zero.sum(1) == 2
        rows, powers = rows[two], np.flatnonzero(zero[two]).reshape(-1, 2) % n
        y, z = x[powers].T
        last = _quotient(b[rows] ^ _mul(a[rows], y), y ^ z)
        proven(rows, powers, np.stack([a[rows] ^ last, last], 1))
    return n - 1 - power, value, found


def _fix(word: np.ndarray, s: np.ndarray, count: int) -> np.ndarray | None:
    """Error positions by trying locator degrees, values by solving the syndrome equations (Gaussian elimination in the field)."""
    n = len(word)
    for errors in range(1, count // 2 + 1):
        # locator: sum_j L_j s_{i+j} = s_{i+errors}
        a = np.array([[s[i + j] for j in range(errors)] + [s[i + errors]] for i in range(errors)], np.int64)
        loc = _solve(a)
        if loc is None:
            continue
        x = _EXP[np.arange(n) % 255]
        value, power = np.zeros(n, np.int64), np.ones(n, np.int64)
        for c in [*loc, 1]:
            value ^= _mul(np.full(n, c), power)
            power = _mul(power, x)
        roots = np.flatnonzero(value == 0)
        if len(roots) != errors:
            continue
        m = np.array([[_EXP[r * i % 255] for r in roots] + [s[i]] for i in range(errors)], np.int64)
        got = _solve(m)
        if got is None:
            continue
        fixed = word.copy()
        fixed[n - 1 - roots] ^= got
        if not _syndromes(fixed, count).any():
            return fixed
    return None


def _solve(m: np.ndarray) -> np.ndarray | None:
    m, n = m.copy(), len(m)
    for c in range(n):
        p = next((r for r in range(c, n) if m[r, c]), None)
        if p is None:
            return None
        m[[c, p]] = m[[p, c]]
        m[c] = _mul(m[c], np.full(n + 1, _EXP[255 - _LOG[m[c, c]]]))
        for r in range(n):
            if r != c and m[r, c]:
                m[r] ^= _mul(m[c], np.full(n + 1, m[r, c]))
    return m[:, n]


# packs

PACK_BYTES = 16 << 20
HEADER = struct.Struct("<IIB32s")
TAIL = struct.Struct("<I4s")
MAGIC = b"CPK1"


def pack_assign(blobs: DataFrame, most: int) -> DataFrame:
    """(writer, seq, pack): greedy fill in order; a new pack once the next blob and its 41-byte header would pass the limit.

    Sequential by nature, so each writer's blobs are one group, as they are one file's writer.
    """

    def fill(pdf):
        pdf = pdf.sort_values("seq")
        pack, used, out = 0, 0, []
        for n in pdf["stored"]:
            if used and used + 41 + n > most:
                pack, used = pack + 1, 0
            used += 41 + n
            out.append(pack)
        return pdf.assign(pack=out)[["writer", "seq", "pack"]]

    return blobs.groupBy("writer").applyInPandas(fill, "writer long, seq long, pack long")


def write_pack(blobs: list[bytes]) -> bytes:
    """Blobs with headers (stored and plain length, codec, digest), an index of offsets and a trailer."""
    out, offsets = bytearray(), []
    for data in blobs:
        codec, stored = encode(data)
        offsets.append(len(out))
        out += HEADER.pack(len(stored), len(data), codec, hashlib.sha256(data).digest()) + stored
    return bytes(out) + struct.pack(f"<{len(offsets)}Q", *offsets) + TAIL.pack(len(offsets), MAGIC)


def read_pack(raw: bytes) -> list[tuple[str, bytes]]:
    """(digest, data) of each blob; a damaged pack is an error."""
    count, magic = TAIL.unpack(raw[-TAIL.size :])
    if magic != MAGIC:
        raise ValueError("no pack trailer")
    out = []
    for at in struct.unpack_from(f"<{count}Q", raw, len(raw) - TAIL.size - 8 * count):
        size, plain, codec, digest = HEADER.unpack_from(raw, at)
        data = decode(codec, raw[at + HEADER.size : at + HEADER.size + size])
        if len(data) != plain or hashlib.sha256(data).digest() != digest:
            raise ValueError(f"the blob at {at} is damaged")
        out.append((digest.hex(), data))
    return out


def zero_ranges(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The bytes with some (start, length) ranges cleared, as far as they lie inside."""
    out = bytearray(data)
    for a, n in ranges:
        a, b = max(a, 0), min(a + n, len(out))
        out[a:b] = bytes(max(0, b - a))
    return bytes(out)


def data_runs(raw: bytes) -> list[tuple[int, int]]:
    """(first cluster, clusters) of a packed run list with signed deltas; -1 marks a sparse run; malformed lists are errors."""
    out, at, where = [], 0, 0
    while at < len(raw) and raw[at]:
        size, step = raw[at] & 15, raw[at] >> 4
        if not size or size > 8 or step > 8 or at + 1 + size + step > len(raw):
            raise ValueError("malformed run list")
        count = int.from_bytes(raw[at + 1 : at + 1 + size], "little")
        if not count:
            raise ValueError("an empty run")
        if step:
            where += int.from_bytes(raw[at + 1 + size : at + 1 + size + step], "little", signed=True)
        out.append((where if step else -1, count))
        at += 1 + size + step
    return out


def partition_slots(raw: bytes) -> list[dict]:
    """Used 128-byte partition slots: number, first and last block, name."""
    out = []
    for k in range(len(raw) // 128):
        slot = raw[k * 128 : k * 128 + 128]
        if any(slot[:16]):
            first, last = struct.unpack_from("<QQ", slot, 32)
            out.append({"number": k + 1, "type": slot[:16].hex(), "first": first, "last": last, "name": slot[56:128].decode("utf-16-le").rstrip("\0")})
    return out


def table_crc(raw: bytes) -> int:
    return zlib.crc32(raw)

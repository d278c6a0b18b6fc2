"""Properties of the byte codecs."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.functions import codecs as Z


def _bytes(n, seed=42):
    return random.Random(seed).randbytes(n)


def test_chunks_survive_an_insert():
    data = _bytes(256 * 1024)
    average = 16 * 1024

    def pieces(raw):
        cuts = Z.cdc_cuts(raw, average)
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    one, two = pieces(data), pieces(data[:1000] + b"!" + data[1000:])
    assert b"".join(one) == data and len(set(one) & set(two)) >= len(one) - 3
    assert all(average // 4 <= len(p) <= 4 * average for p in one[:-1])
    assert average / 2 <= len(data) / len(one) <= average * 2 or len(one) < 8


@given(st.binary(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_encoding_never_grows(data):
    codec, stored = Z.encode(data)
    assert len(stored) <= len(data) and Z.decode(codec, stored) == data


def test_delta_pays_for_small_edits():
    base = _bytes(1 << 20)
    data = base[:5000] + b"x" + base[5001:]
    codec, stored = Z.encode_delta(data, base)
    assert codec == Z.DELTA and len(stored) < 4096 and Z.decode(codec, stored, base) == data
    assert Z.encode_delta(_bytes(1000, 1), _bytes(1000, 2))[0] == Z.RAW


@pytest.mark.parametrize("count", [4, 10])
def test_parity_repairs_half_its_bytes(count):
    data = _bytes(700)
    ecc = Z.parity(data, count)
    assert Z.repair(data, ecc, count) == data
    bad, rnd = bytearray(data), random.Random(3)
    for stripe in range(5):
        for p in rnd.sample(range(128), count // 2):
            bad[stripe * 128 + p] ^= rnd.randrange(1, 256)
    assert Z.repair(bytes(bad), ecc, count) == data
    for p in range(count // 2 + 1):
        bad[p] ^= 0x55 if bad[p] == data[p] else 0
    worse = bytearray(data)
    for p in range(count):
        worse[p * 3] ^= 0x5A
    assert Z.repair(bytes(worse), ecc, count) != data


def _plain_parity(data, count):
    """Parity by long division, a byte at a time."""
    g, out = [int(x) for x in Z._generator(count)[1:]], b""
    for k in range(0, len(data), Z.WIDTH):
        rest = [0] * count
        for c in data[k : k + Z.WIDTH].ljust(Z.WIDTH, b"\0"):
            lead = c ^ rest[0]
            rest = [a ^ int(Z._mul(np.array(lead), np.array(x))) for a, x in zip([*rest[1:], 0], g, strict=True)]
        out += bytes(rest)
    return out


def _plain_repair(data, ecc, count):
    """Stripe by stripe, errors sought by trying locator degrees."""
    out = b""
    for k in range(-(-len(data) // Z.WIDTH)):
        part = data[k * Z.WIDTH : (k + 1) * Z.WIDTH]
        word = np.array([*part.ljust(Z.WIDTH, b"\0"), *ecc[k * count : (k + 1) * count]], np.int64)
        s = Z._syndromes(word, count)
        fixed = Z._fix(word, s, count) if s.any() else word
        if fixed is None or fixed[len(part) : Z.WIDTH].any():
            return None
        out += bytes(fixed[: len(part)].astype(np.uint8))
    return out


@pytest.mark.parametrize("count", [1, 2, 4, 6])
def test_chunks_at_once_are_repaired_as_one_by_one(count):
    rnd = random.Random(count)
    whole = [rnd.randbytes(n) for n in (0, 1, 100, 127, 128, 129, 300, 512) for _ in range(12)]
    ecc = Z.parity_all(whole, count)
    assert ecc[::5] == [_plain_parity(d, count) for d in whole[::5]]
    bad, broken = [], []
    for d, e in zip(whole, ecc, strict=True):
        d, e = bytearray(d), bytearray(e)
        for stripe in range(-(-len(d) // Z.WIDTH)):
            for _ in range(rnd.choice([0, 1, 2, 2, 3, 4])):
                # in the data or in the parity, the same byte twice too
                if rnd.random() < 0.8:
                    d[rnd.randrange(stripe * Z.WIDTH, min(len(d), (stripe + 1) * Z.WIDTH))] ^= rnd.randrange(256)
                else:
                    e[stripe * count + rnd.randrange(count)] ^= rnd.randrange(256)
        bad.append(bytes(d))
        broken.append(bytes(e))
    got = Z.repair_all(bad, broken, count)
    assert got == [_plain_repair(d, e, count) for d, e in zip(bad, broken, strict=True)]
    assert sum(g == d for g, d in zip(got, whole, strict=True)) > 10 and (count < 2 or None in got)
    assert Z.repair_all([], [], count) == [] and Z.parity_all([], count) == []


def test_parity_and_repair_take_time_by_bytes():
    chunks = [_bytes(400, seed) for seed in range(10_000)]
    began = time.process_time()
    ecc = Z.parity_all(chunks, 4)
    fixed = Z.repair_all([b"?" * 400 if k % 8 else c[:-1] + bytes([c[-1] ^ 1]) for k, c in enumerate(chunks)], ecc, 4)
    # a stripe at a time took 3.7 ms a chunk for the parity and 5.2 for the repair
    assert time.process_time() - began < 8
    assert fixed[::8] == chunks[::8]


def test_packs():
    blobs = [b"a" * 1000, _bytes(500), b""]
    raw = Z.write_pack(blobs)
    assert [d for _, d in Z.read_pack(raw)] == blobs
    with pytest.raises(ValueError):
        Z.read_pack(raw[:60] + b"\xff" + raw[61:])
    with pytest.raises(ValueError):
        Z.read_pack(raw[:-1] + b"X")


def test_run_lists():
    # 2 clusters at 5, a sparse run of 3, 1 cluster 2 before
    assert Z.data_runs(bytes([0x11, 2, 5, 0x01, 3, 0x11, 1, 0xFE, 0])) == [(5, 2), (-1, 3), (3, 1)]
    with pytest.raises(ValueError):
        Z.data_runs(bytes([0x19, 1]))


def test_partition_slots():
    import struct

    slot = bytes(range(16)) + bytes(16) + struct.pack("<QQ", 34, 99) + bytes(8) + "EFI".encode("utf-16-le").ljust(72, b"\0")
    assert [(p["number"], p["first"], p["last"], p["name"]) for p in Z.partition_slots(bytes(128) + slot)] == [(2, 34, 99, "EFI")]


def test_zero_ranges():
    assert Z.zero_ranges(b"abcdef", [(1, 2), (5, 9)]) == b"a\0\0de\0"


def test_rolling_hash_against_each_window():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 31, 32, 33, 200):
        data = rng.integers(0, 256, n).astype(np.uint8)
        table = Z.rolling_table()
        want = []
        for i in range(n):
            h = 0
            for back in range(min(Z.WINDOW, i + 1)):
                x, r = int(table[data[i - back]]), back % 32
                h ^= (x << r | x >> (32 - r)) & 0xFFFFFFFF
            want.append(h)
        assert Z.cyclic_hashes(data).tolist() == want

"""The training-data operators against brute force, round trips and planted cases; nulls, empties, ties, clashing columns."""

import base64
import hashlib
import math
import random
import re
import sys
import time
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tidewater.llm import decontaminate, labelled, licenses, media, neardup, quality, queries, repeats, stages, toxicity, urls, warc  # noqa: E402
from tidewater.llm import sentencepiece_codec as sp  # noqa: E402
from tidewater.llm import sql as llm_sql  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, key string, shard int, n_words string, node long"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "x", 1, "y", 2) for k, t in rows], COLUMNS)


def texts(seed, n=40):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß日") for _ in range(rnd.randrange(1, 7))) for _ in range(60)]
    line = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    base = [line(60) for _ in range(5)]
    out = [(0, None), (1, ""), (2, "  \n"), (3, "one"), (4, "A b C"), (5, base[0]), (6, base[0]), (6, base[0])]
    for i in range(7, n):
        parts = base[rnd.randrange(5)].split()
        if i % 3 == 0:
            parts[rnd.randrange(len(parts))] = "changed"
        if i % 3 == 1:
            parts = line(20).split() + parts[rnd.randrange(30) :] + line(rnd.randrange(80)).split()
        if i % 3 == 2:
            parts = line(rnd.randrange(1, 120)).split()
        out.append((i, rnd.choice([" ", "\n", ", "]).join(parts)))
    out.append((n, "z" * 5000))
    return out


def test_contamination(spark):
    docs = texts(1)
    items = [(1, docs[5][1]), (1, "one"), (2, "a B c"), (3, None), (4, ""), (None, "zzz"), (10, " ".join(brute.words(docs[8][1])[:14])), (9, docs[20][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(docs, items), key=repr)
    for limits in ({}, {"shard_bytes": 300}, {"block_bytes": 80}):
        got = decontaminate.find_contamination(frame(spark, docs), bench, **limits).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == want
    kept = decontaminate.remove_contaminated(frame(spark, docs), bench)
    assert kept.columns == ["doc_id", "text", "key", "shard", "n_words", "node"]
    assert sorted((r.doc_id for r in kept.collect())) == sorted(w[0] for w in want if not w[4])
    whole = decontaminate.find_contamination(frame(spark, docs[5:6]), bench).first()
    assert (whole.longest_match, whole.longest_start, whole.longest_item) == (60, 0, "1")
    assert decontaminate.find_contamination(frame(spark, docs[:0]), bench).count() == 0
    assert not decontaminate.find_contamination(frame(spark, docs), bench.limit(0)).where("n_hit > 0").count()


@pytest.mark.parametrize("name", sorted(llm_sql.SQL))
def test_sql(spark, name):
    sys.path.insert(0, str(Path(__file__).parents[1]))
    import compare

    con = compare.duck(SF)
    assert compare.difference(spark, con, SF, queries.QUERIES[name], llm_sql.SQL[name]) is None


@pytest.mark.parametrize("shard", [600, 1 << 21])
def test_repeats(spark, shard):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh éñ") for _ in range(400)) for _ in range(4)]
    docs = [(None, base[2][:300]), (0, None), (1, "")]
    for i in range(2, 50):
        kind = i % 5
        if kind == 0:
            t = rnd.choice(base)
        elif kind == 1:
            t = base[rnd.randrange(4)][rnd.randrange(100) :][: rnd.randrange(90, 260)] + base[rnd.randrange(4)][: rnd.randrange(50, 200)]
        elif kind == 2:
            t = "a" * rnd.randrange(0, 400)
        elif kind == 3:
            t = "xy" * rnd.randrange(40, 200) + base[0][:120]
        else:
            t = base[1][:150] * 2 + "é" * rnd.randrange(30, 80)
        docs.append((i, t))
    want = sorted((k, n, r, s, hashlib.sha256(kept).hexdigest()) if k is not None else (-1, n, r, s, hashlib.sha256(kept).hexdigest()) for k, n, r, s, kept in brute.repeats(docs))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in repeats.find_repeats(frame(spark, docs), shard_bytes=shard).collect())
    assert got == want
    left = repeats.remove_repeats(frame(spark, docs), shard_bytes=shard)
    assert left.columns == ["doc_id", "text", "key", "shard", "n_words", "node"]
    assert {r.doc_id: r.text for r in left.collect()} == {k: kept.decode(errors="ignore") for k, _, _, _, kept in brute.repeats(docs)}
    assert repeats.find_repeats(frame(spark, docs[:0])).count() == 0


def test_repeats_with_versions_and_repeated_rows(spark):
    rnd = random.Random(1)
    a = "".join(rnd.choice("abcdef") for _ in range(150))
    docs = [(1, a), (1, a), (1, "pp" + a), (2, a)]
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in repeats.find_repeats(frame(spark, docs)).collect()}
    assert got == {(1, 150, 0), (1, 152, 150), (2, 150, 150)}


def test_buckets_of_many_shards():
    """Buckets take time by their rows, not by rows times shards: six seconds are far more than that, far less than the other."""
    import numpy as np
    import pyarrow as pa

    rnd, shards, many = np.random.default_rng(5), 4000, 15
    text = rnd.integers(97, 123, 1200, np.uint8)
    q = 100 + 51 * np.arange(many)
    data = np.concatenate([text[k - 50 : k + 100] for k in q])
    offer = lambda s: repeats._pack(np.full(many, s), np.zeros(many, "<i4"), q.astype("<i4"), np.zeros(many, "u1"), np.full(many, 50, "u1"), data)
    began = time.process_time()
    found = repeats._settle_bucket(repeats._out([(0, s, offer(s)) for s in range(shards)]), 4).to_pylist()
    assert time.process_time() - began < 6
    assert {r["shard"]: [x.tolist() for x in repeats._unpack(r["blob"])] for r in found} == {s: [[0], [50], [int(q[-1])]] for s in range(1, shards)}
    alone = repeats._settle_bucket(repeats._out([(0, 3, offer(3))]), 4)
    assert alone.num_rows == 0 and isinstance(alone, pa.Table)
    # each shard holds 250 entries of its own and 50 of its neighbour's
    held = [np.sort(np.concatenate([np.arange(300 * s, 300 * s + 250), np.arange(300 * (s ^ 1), 300 * (s ^ 1) + 50)]).astype("<u8") * np.uint64(repeats.tb._C1)) for s in range(shards)]
    began = time.process_time()
    told = repeats._common(repeats._out([(0, s, x.tobytes()) for s, x in enumerate(held)])).to_pylist()
    assert time.process_time() - began < 6
    for r in told[:20]:
        s = r["shard"]
        assert np.frombuffer(r["blob"], "<u8").tolist() == np.intersect1d(held[s], held[s ^ 1]).tolist() and len(r["blob"]) == 800
    assert len(told) == shards


def test_near_duplicates(spark):
    docs = texts(2, 60)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame(spark, docs)).collect()}
    want = brute.near_classes(docs)
    differ = {k for k in want if got[k] != want[k]}
    assert not differ
    kept = neardup.deduplicate(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "key", "shard", "n_words", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert neardup.near_duplicates(frame(spark, docs[:0])).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    rnd = random.Random(5)
    base = ["w" + str(rnd.randrange(500)) for _ in range(150)]
    docs = []
    for i in range(120):
        w = list(base)
        w[rnd.randrange(150)] = f"x{i}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join("y" + str(rnd.randrange(900)) for _ in range(80)) + " " + " ".join(base[:30])) for i in range(40)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame(spark, docs)).collect()}
    assert {got[i] for i in range(120)} == {0} and all(got[200 + i] == 200 + i for i in range(40))


def _one_bucket(monkeypatch):
    """Every text with words in one large bucket, so that nothing is left to other bands."""
    import numpy as np

    real = neardup.band_hashes
    monkeypatch.setattr(neardup, "band_hashes", lambda *a: [np.array([7] if len(b) else [], np.int64) for b in real(*a)])


def test_large_buckets_keep_links_away_from_their_ends(spark, monkeypatch):
    _one_bucket(monkeypatch)
    rnd = random.Random(9)
    line = lambda: ["v" + str(rnd.randrange(100_000)) for _ in range(200)]
    docs, w = [(i, " ".join(line())) for i in (0, 999)], line()
    for i in range(150):
        # a group that drifts: a copy is near the next ones, not the last
        w[i] = f"x{i}"
        docs.append((100 + i, " ".join(w)))
    pairs = [line() for _ in range(40)]
    docs += [(300 + 2 * k + j, " ".join([*p[:-1], f"z{j}"])) for k, p in enumerate(pairs) for j in (0, 1)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near_classes(docs)
    assert {got[100 + i] for i in range(150)} == {100} and got[0] == 0 and got[999] == 999


def test_texts_of_candidates_are_found_without_their_ids_at_the_driver(spark, monkeypatch):
    def refuse(df):
        raise AssertionError("ids grow with the corpus and may not be broadcast")

    monkeypatch.setattr(neardup.F, "broadcast", refuse)
    docs = spark.range(-5000, 15_000).selectExpr("id * 1000003 AS node", "concat('text ', id) AS text")
    ids = docs.where("node % 4 = 0").select("node")
    held = {r.node: r.text for r in neardup._texts_of(docs, ids.union(ids)).collect()}
    assert {k for k in held if k % 4 == 0} == {i * 1000003 for i in range(-5000, 15_000, 4)} and len(held) < 5100
    assert all(t == f"text {k // 1000003}" for k, t in held.items())
    assert neardup._texts_of(docs, ids.limit(0)).count() == 0


def test_similar_texts_of_unlike_length_share_bands():
    import numpy as np

    from tidewater.llm import textbuf as tb

    idf, shared = np.ones(neardup.TABLE), 0
    for seed in range(20):
        a = " ".join([f"w{seed}x{i}" for i in range(20)] * 200)
        b = a + " " + " ".join(f"new{seed}x{i}" for i in range(25))
        assert neardup._Weighed(a, idf).similarity(neardup._Weighed(b, idf)) >= 0.8
        data, off = np.frombuffer((a + b).encode(), np.uint8), np.array([0, len(a), len(a) + len(b)])
        x, y = neardup.band_hashes(data, off, idf)
        shared += len(np.intersect1d(x, y)) > 0
    assert shared >= 19
    assert tb.words(data, off)[0].size > 4000


def test_sampling_estimates_similarity():
    import numpy as np

    from tidewater.llm import textbuf as tb

    rnd = random.Random(8)
    base = [f"w{rnd.randrange(4000)}" for _ in range(900)]
    other = [w if rnd.random() > 0.02 else "q" + str(rnd.random())[2:] for w in base]
    idf = np.full(neardup.TABLE, 5.0)
    parts = [t.encode() for t in (" ".join(base), " ".join(other))]
    data, off = np.frombuffer(b"".join(parts), np.uint8), np.array([0, len(parts[0]), sum(map(len, parts))])
    doc, s, tf = neardup.weighed(data, off)
    true = neardup._Weighed(" ".join(base), idf).similarity(neardup._Weighed(" ".join(other), idf))
    for groups in neardup.GROUPS:
        a, b = neardup._samples(doc, s, np.log(neardup.weights(s, tf, idf)), 2, groups)
        assert abs(float((a == b).mean()) - true) < 0.12
    assert len(tb.words(data, off)[0]) == 1800


def test_sentencepiece(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    ref = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["  a  b ", " x", "▁▁ a ▁b", "\n\n\t a", "日本語 テキスト", "<s> </s> <unk> <0x41>", "a\u00a0b", "😀😀  😀", "..  ...", "a" * 3000, "▁", " ", "ﬁ ﬀ ｱ"]
    docs = texts(4) + [(100 + i, t) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in sp.encode(frame(spark, docs), path).collect()}
    for k, t in docs:
        r, raw = got[k], (t or "").encode()
        assert r.ids == ref.encode(t or "") and r.decoded == ref.decode(r.ids)
        assert r.starts[:1] == ([0] if raw else []) and r.starts[1:] == r.ends[:-1] and (not raw or r.ends[-1] == len(raw))
        for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            piece = ref.id_to_piece(i)
            if not piece.startswith("<0x") and a:
                assert raw[a:b].decode().replace(" ", "▁") == piece
    d = {r.doc_id: r for r in sp.digests(frame(spark, docs), path).collect()}
    for k, t in docs:
        ids = ref.encode(t or "")
        assert (d[k].n_tokens, d[k].ids_sha256, d[k].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(ref.decode(ids).encode()).hexdigest())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_maps(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    ref = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    m = pb.ModelProto()
    m.ParseFromString(ref.serialized_model_proto())
    mine = sp.Normaliser(m.normalizer_spec)
    for t in ["", " ", "ﬁ ﬀ ｱ", "Ⅳ ①  x ", "a\u0301 é  ", "ﾊﾟ", "\u3000ａｂｃ", *(t for _, t in texts(6) if t)]:
        got, source = mine(t)
        assert got.decode() == ref.normalize(t)
        assert len(source) == len(got) + 1 and list(source) == sorted(source) and source[-1] <= len(t.encode())


def test_media(spark, tmp_path):
    docs = [*texts(7), (None, "no id"), (500, "x" * 576), (501, "y" * 577), (502, "é" * 4000)]
    path = f"file://{tmp_path}/m"
    media.write_archive(frame(spark, docs), path)
    for limits in ({}, {"range_bytes": 1000}):
        got = media.measure(media.read_archive(spark, path, **limits)).collect()
        assert len(got) == len(docs)
        want = sorted(((k, (t or "").encode()) for k, t in docs), key=repr)
        for r, (k, raw) in zip(sorted(got, key=lambda r: repr((r.key, dict([w for w in want]).get(r.key)))), want, strict=True):
            full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
            assert (r.key, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (k, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
            assert r.media_sha256 == hashlib.sha256(media.png_encode(full)).hexdigest() and media.png_decode(media.png_encode(full)) == full
    media.write_archive(frame(spark, docs[:4]), path)
    assert media.read_archive(spark, path).count() == len(docs) + 4
    media.payloads(frame(spark, docs[:2])).write.format("media_archive").mode("overwrite").save(path)
    assert media.read_archive(spark, path).count() == 2 and not [p for p in (tmp_path / "m").iterdir() if p.name.startswith("_tmp-")]
    media.write_archive(frame(spark, docs[:0]), f"file://{tmp_path}/none")
    assert media.read_archive(spark, f"file://{tmp_path}/none").count() == 0


def test_media_retries_only_the_broken_member(tmp_path, monkeypatch):
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    w = media.Writer(f"file://{tmp_path}", 1)
    import pyarrow as pa

    payload = [bytes([i]) * 576 for i in range(3)]
    message = w.write(iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([576] * 3), pa.array(payload)], ["key", "n_bytes", "payload"])]))
    w.commit([message])
    r = media.Reader(f"file://{tmp_path}", 1 << 20, 2)
    (part,) = r.partitions()
    calls, real = [], media.png_decode

    def flaky(raw):
        calls.append(raw)
        if len(calls) == 2:
            raise ValueError("lost")
        return real(raw)

    monkeypatch.setattr(media, "png_decode", flaky)
    rows = [x for b in r.read(part) for x in b.to_pylist()]
    assert [x["payload"] for x in rows] == payload and len(calls) == 4
    file = tmp_path / part.name
    raw = bytearray(file.read_bytes())
    raw[media.MEMBER.size + 20] ^= 1
    file.write_bytes(raw)
    with pytest.raises(OSError, match="damaged"):
        list(r.read(part))


def test_warc(spark, tmp_path):
    rows = [(i, "http://a/\r\nx" if i % 3 else None, ["a\r\n\r\nWARC/1.1\r\n", None, "", "é" * i][i % 4]) for i in range(60)] + [(None, "u", ""), (7, "u", "é" * 7)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, id int")
    for least in (0, 20):
        path = f"file://{tmp_path}/w{least}"
        warc.write_archives(pages, path, min_bytes=least, archive_bytes=2000)
        got = warc.read_archives(spark, path, with_payload=True, range_bytes=700).collect()
        assert warc.read_archives(spark, path).count() == len(rows)
        assert len(got) == len(rows)
        first = {}
        for k, _, h in rows:
            if k is not None:
                first[h or ""] = min(k, first.get(h or "", k))
        for r in got:
            if r.id is None:
                assert r.record_type == "response"
                continue
            h = dict((k, x) for k, _, x in rows)[r.id] or ""
            again = len(h.encode()) >= least and first[h] != r.id
            assert (r.record_type, r.refers_to) == (("revisit", first[h]) if again else ("response", None))
            assert r.bytes == len(h.encode()) and r.digest == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
            assert r.payload == (b"" if again else h.encode())
        # gzip members one after another, a warcinfo record first, ids that revisits refer to
        ids, refers = set(), set()
        for file in (tmp_path / f"w{least}").glob("*.warc.gz"):
            raw, kinds = file.read_bytes(), []
            while raw:
                inflate = zlib.decompressobj(31)
                size = len(raw) - len((inflate.decompress(raw), inflate.unused_data)[1])
                h, block = warc.parse(raw[:size])
                kinds.append(h["WARC-Type"])
                assert kinds[0] == "warcinfo" and (len(kinds) == 1 or h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
                ids.add(h["WARC-Record-ID"])
                refers |= {h["WARC-Refers-To"]} if "WARC-Refers-To" in h else set()
                raw = raw[size:]
        assert refers <= ids and (least or refers)
    again = f"file://{tmp_path}/w0"
    warc.write_archives(pages.limit(3), again)
    assert warc.read_archives(spark, again).count() == 3 and len(list((tmp_path / "w0").glob("*.warc.gz"))) <= 3
    warc.write_archives(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_licenses(spark):
    docs = [(1, None), (2, ""), (None, "Mit LICENSE mit license"), (4, "mit license"), (4, "mit license"), (4, "x"), (5, "license"), (6, "general public"), (7, "a İ K 日本"),
            (8, "The Apache-License; GNU General Public License."), (9, "licensed under CC BY-NC 4.0"), (10, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (11, "word " * 3000 + "mit license")]
    got = {(r.doc_id, r.n_words): tuple(r) for r in licenses.scan(frame(spark, docs)).collect()}
    for k, t in docs:
        w = brute.words(t)
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[k, len(w)]
        assert r[2:6] == (len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert 0 <= r[7] <= 1 and set(r[5].split(",")) <= set(r[6].split(",")) | {""}
    assert "cc-by-nc" in got[9, 7][6] and "bsd" in got[10, 14][6]
    assert licenses.scan(frame(spark, docs[:0])).count() == 0


def _plain_licences(docs):
    """Every template tried at every offset of every text, by the rule of the docstring."""
    words = [brute.words(t) for _, t in docs]
    holds = lambda w, phrase: any(w[i : i + len(phrase)] == phrase for i in range(len(w) - len(phrase) + 1))
    df = lambda x: sum(x in w for w in words)
    weight = lambda x: max(licenses.FLOOR, math.log((len(docs) + 1) / (df(x) + 1)))
    out = []
    for (key, _), w in zip(docs, words):
        base = {label for p, label in licenses.BASE.items() if holds(w, p.split())}
        names, best = set(base), 1.0 if base else 0.0
        for label, text, phrases in licenses.TEMPLATES:
            t = text.split()
            ranked = sorted(set(t), key=lambda x: (-weight(x), x))
            top = [x for x in ranked if x in w][: licenses.RAREST]
            if not any(holds(w, p.split()) for p in phrases):
                continue
            for offset in range(-len(t), len(w)):
                on = [x for i, x in enumerate(t) if x in top and 0 <= i + offset < len(w) and w[i + offset] == x]
                score = min(1.0, sum(weight(x) / t.count(x) for x in on) / sum(weight(x) for x in ranked[: licenses.RAREST]))
                if len(on) >= min(licenses.AGREE, len(t)) and score >= licenses.MIN_SCORE:
                    names.add(label)
                    best = max(best, score)
        out.append((key, ",".join(sorted(names)), round(best, 9)))
    return out


def test_licences_against_every_offset(spark):
    rnd = random.Random(5)
    texts = [t for _, t, _ in licenses.TEMPLATES]
    docs = [(0, None), (1, ""), (2, "software mozilla public license x1"), (3, texts[8].upper())]
    for i in range(4, 60):
        parts = []
        for t in rnd.sample(texts, rnd.randrange(4)):
            w = [x for x in t.split() if rnd.random() < rnd.choice([1, 0.9, 0.6])]
            parts += w + ["filler"] * rnd.randrange(6)
        docs.append((i, " ".join(parts + [rnd.choice(["the", "license", "copy", "Ünrelated"]) for _ in range(rnd.randrange(30))])))
    docs += [docs[20], docs[21], (7, docs[22][1])]
    got = [(r.doc_id, r.labels, round(r.score, 9)) for r in licenses.scan(frame(spark, docs)).collect()]
    assert sorted(got) == sorted(_plain_licences(docs))
    assert next(r for r in got if r[0] == 2)[1] == "" and next(r for r in got if r[0] == 3)[1] == "mpl"
    for one in [(1, texts[0]), (1, None), (1, "mit license")]:
        assert [(r.doc_id, r.labels) for r in licenses.scan(frame(spark, [one])).collect()] == [_plain_licences([one])[0][:2]]


def test_licenses_in_a_third_of_the_rows(spark):
    docs = [(i, f"file {i} " + ("Licensed under CC BY-NC 4.0" if i % 3 == 0 else "plain text")) for i in range(60)]
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, docs)).collect()}
    assert got == {i: "cc-by-nc" if i % 3 == 0 else "" for i in range(60)}


def test_licenses_of_one_file_apart(spark):
    notices = {k: t for k, t, _ in licenses.TEMPLATES}
    docs = [(1, licenses.TEMPLATES[1][1] + " and more words then " + notices["cc-by-nc"]), (2, "; ".join(t for _, t, _ in licenses.TEMPLATES))]
    docs += [(10 + i, f"file {i} " + notices["cc-by-nc"]) for i in range(30)]
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, docs)).collect()}
    assert got[1] == "cc-by-nc,mit" and got[2] == ",".join(sorted(notices))


def test_urls(spark):
    queries.ensure_checkpoints(spark)
    rows = [(1, None), (2, ""), (3, "HTTP://A.COM/en/x?y"), (4, "x://com/en/"), (5, "a://sub.example.com/en/7#x"), (6, "h://?q"), (7, "h://xcom/en/"), (8, "a://net"), (9, "http://n.example.net/de/81"), (10, "http://N.net/de/81"), (10, "http://N.net/de/81"), (11, "http://k.org/es/"), (12, "http://k.org/es")]
    rows += [(100 + i, f"http://h{i}.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'de'}/{i}" + "?a=1&b=2" * (i % 2)) for i in range(80)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    want = {1: ("", "", None), 2: ("", "", None), 3: ("a.com", "/en/x", "com/en/"), 4: ("com", "/en/", "com/en/"), 5: ("sub.example.com", "/en/7", "example.com/en/7"), 6: ("", "", None), 7: ("xcom", "/en/", None), 8: ("net", "", None), 9: ("n.example.net", "/de/81", "example.net/de/8"), 10: ("n.net", "/de/81", "net/de/"), 11: ("k.org", "/es/", "org/es/"), 12: ("k.org", "/es", None)}
    assert {k: (got[k].host, got[k].path, got[k].rule) for k in want} == want
    assert [got[k].verdict for k in (3, 5, 9, 10, 11)] == ["block", "allow", "block", "allow", "block"]
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urls.judge(df.limit(0)).count() == 0
    model = urls.train(df.where("url LIKE 'http://h%'").selectExpr("url", "CAST(url LIKE '%?%' AS INT) AS label"))
    columns = urls.features(F.col("url"), *urls.host_and_path(F.col("url"))) | model.suffix_columns(urls.host_and_path(F.col("url"))[0])
    scored = df.where("page_id >= 100").select("page_id", model.score(columns).alias("s")).collect()
    assert all((r.s >= 0.5) == (r.page_id % 2 == 1) for r in scored)


def _url_features(url, model):
    """The features by plain string operations."""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group().translate(brute.LOW)
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    text = (host + path).lower()
    alone = [text.count(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789./-_=&?:%#"]
    shares = [c / max(1, len(text)) for c in [*alone, len(text) - sum(alone)] if c > 0]
    mean, weight = model.suffixes.get(host.rsplit(".", 1)[-1], model.unseen)
    extension = re.search(r"\.([A-Za-z0-9]{1,5})$", path)
    return {
        "url_length": len(url), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "labels": host.count("."), "hyphens": host.count("-"),
        "digit_ratio": sum(c in "0123456789" for c in url) / max(1, len(url)), "entropy": -sum(p * math.log2(p) for p in shares), "parameters": ("?" in url) + url.count("&"),
        "fragment": float("#" in url), "extension": len(extension.group(1)) if extension else 0, "suffix_mean": mean, "suffix_weight": weight,
    }


def _plain_tree(rows, cuts, depth, rate):
    """The best split of all features and cuts, tried one by one: rows of (features, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    for name in cuts if depth else ():
        for cut in cuts[name]:
            left = [r for r in rows if r[0][name] <= cut]
            gl, hl = sum(r[1] for r in left), sum(r[2] for r in left)
            if hl >= 1 and h - hl >= 1:
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                    best = gain, name, cut
    if best is None:
        return rate * g / (h + 1)
    _, name, cut = best
    return name, cut, _plain_tree([r for r in rows if r[0][name] <= cut], cuts, depth - 1, rate), _plain_tree([r for r in rows if r[0][name] > cut], cuts, depth - 1, rate)


def _walk(node, x):
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def test_url_trees_against_every_split(spark):
    rnd = random.Random(13)
    queries.ensure_checkpoints(spark)

    def url():
        bad = rnd.random() < 0.5
        name = "".join(rnd.choice("abcdefgh0123456789-" if bad else "abcdefgh") for _ in range(rnd.randrange(4, 14)))
        path = "/".join("".join(rnd.choice("abcXYZ09_é") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 6 if bad else 3)))
        return f"http://www.{name}.{rnd.choice(['biz', 'top', 'com'] if bad else ['com', 'org', 'net'])}/{path}" + ("?a=1&b=2" if bad and rnd.random() < 0.6 else "") + rnd.choice(["", ".html", "#x"]), int(bad != (rnd.random() < 0.05))

    rows = [url() for _ in range(160)]
    model = urls.train(spark.createDataFrame(rows, "url string, label int"), rounds=3, depth=2)
    x = [(_url_features(u, model), y) for u, y in rows]
    mean = sum(y for _, y in x) / len(x)
    assert math.isclose(model.base, math.log(mean / (1 - mean)))
    margins, trees = [model.base] * len(x), []
    for _ in range(3):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        trees.append(_plain_tree([(f, y - q, q * (1 - q)) for (f, y), q in zip(x, p)], model.cuts, 2, urls.RATE))
        margins = [m + _walk(trees[-1], f) for m, (f, _) in zip(margins, x)]

    def same(a, b):
        return (a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])) if isinstance(a, tuple) and isinstance(b, tuple) else isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=1e-9)

    assert all(same(a, b) for a, b in zip(model.trees, trees, strict=True))
    # URLs that weren't learnt from: scores by the plain walk, and what they are worth
    fresh = [url() for _ in range(200)]
    labelled_ = spark.createDataFrame(rows, "url string, label int")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(fresh)], "page_id long, url string")
    got = urls.judge(pages, rules=[], labelled=labelled_).collect()
    full = urls.train(labelled_)
    for r in got:
        margin = full.base + sum(_walk(t, _url_features(fresh[r.page_id][0], full)) for t in full.trees)
        assert r.rule is None and math.isclose(r.score, 1 / (1 + math.exp(-margin)), rel_tol=1e-9) and r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert sum((r.verdict == "block") == bool(fresh[r.page_id][1]) for r in got) > 0.85 * len(got)


def _labelled(spark, seed, n=160):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7))) for _ in range(200)]
    docs, labels = [(1000, None), (1001, ""), (1002, "x " * 40)], [(1000, 0, 0), (5, None, None), (None, 1, 1)]
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(120)]
        toxic, bad = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(12):
                w.insert(rnd.randrange(len(w)), rnd.choice(["wretchedfool", "stupidoaf", "vilecreature"]))
        docs.append((i, "!! ".join(w).upper() if bad else " ".join(w)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((k, (q, t)) for k, q, t in labels)


@pytest.mark.parametrize(("op", "which"), [(quality, 0), (toxicity, 1)])
def test_classifiers(spark, op, which):
    docs, labels, truth = _labelled(spark, 11, 300)
    got = op.classify(docs, labels).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.7 if which else 0.5)) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.predicted == truth[r.doc_id][which] for r in held) / len(held) > 0.9
    # held-out labels change nothing
    flipped = labels.select("doc_id", *(F.when(labelled.held_out(F.col("doc_id")), 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")))
    again = {r.doc_id: r.score for r in op.classify(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)
    none = op.classify(docs, labels.limit(0)).collect()
    assert len(none) == 303 and len({r.score for r in none}) == 1
    assert op.classify(docs.limit(0), labels).count() == 0


def test_toxicity_against_plain_windows(spark):
    import numpy as np
    import zstandard as zs

    docs, labels, _ = _labelled(spark, 12, 200)
    docs = docs.unionByName(frame(spark, [(2000, "é" * 5000), (2001, "a"), (2002, "The vilecreature " * 3000)]))
    model = toxicity.fit(docs, labels)
    settings = zs.ZstdCompressionParameters(**toxicity.Coder.SETTINGS)
    size = [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=settings) for d in (model.ordinary, model.toxic + model.ordinary)]

    def plain(text):
        data, at, total = (text or "").translate(brute.LOW).encode(), 0, 0
        while data:
            w = data[at : at + toxicity.WINDOW]
            saved = len(size[0].compress(w)) - len(size[1].compress(w))
            total += round(1024 * float(model.evidence[max(-toxicity.LEAST, min(toxicity.MOST, saved)) + toxicity.LEAST]))
            if at + toxicity.WINDOW >= len(data):
                break
            at += toxicity.STEP
        below = [c for level, c in zip(model.levels, model.chances) if level <= round(total / 256)]
        return below[-1] if below else model.chances[0]

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(texts) and all(r.score == plain(texts[r.doc_id]) for r in got)
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {r.doc_id for r in got if r.score < 0.7}
    # pooled adjacent violators: the highest, over starts up to x, of the lowest mean to an end from x on
    x, y = np.array([1, 1, 2, 3, 3, 4, 6, 6]), np.array([0, 1, 0, 1, 0, 0, 1, 1])
    weight = np.where(y == 1, 1.0, 2.0)
    mean = lambda a, b: (weight * y)[(x >= a) & (x <= b)].sum() / weight[(x >= a) & (x <= b)].sum()
    levels, chances = toxicity.isotonic(x, y, weight)
    for v in x:
        want = max(min(mean(a, b) for b in x if b >= v) for a in x if a <= v)
        assert abs(chances[np.searchsorted(levels, v, side="right") - 1] - want) < 1e-12
    # a string that two texts share is left out of training, one that a text repeats isn't
    shared, again = b"0123456789abcdefghijklmnopqrstuvwxyz", b"once upon a time there was a text that said so "
    assert toxicity.own_pieces([b"x" * 20 + shared, shared + b"y" * 20, again * 2, b""]) == [[b"x" * 20], [b"y" * 20], [again * 2], []]


def test_interactions_in_linear_time():
    import numpy as np

    rng = np.random.default_rng(0)
    kinds = len(quality.STATS) + 2
    n = kinds * quality.BINS + quality.BUCKETS
    m = quality.Machine(np.zeros((kinds, quality.BINS - 1)), 0.3, rng.normal(size=n), rng.normal(size=(n, 3)))
    rows = [sorted(rng.choice(n, k, replace=False)) for k in (6, 1, 40)]
    values = [rng.normal(size=len(r)) for r in rows]
    got, _ = m.raw(np.cumsum([0, *map(len, rows)]), np.concatenate(rows), np.concatenate(values))
    for on, x, z in zip(rows, values, got):
        plain = m.bias + x @ m.linear[on] + sum(m.factors[i] @ m.factors[j] * x[a] * x[b] for a, i in enumerate(on) for b, j in enumerate(on) if a < b)
        assert abs(float(z) - plain) < 1e-9


def test_quality_features_against_plain_counts():
    import numpy as np

    texts_ = [t or "" for _, t in texts(4)] + ["A b. c-D 12\n\nx x x É", "", "!!!", "z" * 3000]
    raw = [t.encode() for t in texts_]
    off = np.cumsum([0, *map(len, raw)])
    meta = np.array([[float(len(t)) if i % 3 else -1.0 for i, t in enumerate(texts_)]])
    d = quality.describe(np.frombuffer(b"".join(raw), np.uint8), off, meta)
    column = dict(zip([*quality.STATS, "declared", "off"], d.stats.T, strict=True))
    for i, t in enumerate(texts_):
        w = brute.words(t)
        counts = sorted(w.count(x) for x in set(w))
        v = d.value[d.start[i] : d.start[i + 1]]
        assert np.allclose(sorted(v), np.log1p(counts) / max(np.sqrt((np.log1p(counts) ** 2).sum()), 1e-6), atol=1e-6)
        assert np.isclose(column["words"][i], np.log1p(len(w))) and np.isclose(column["bytes"][i], np.log1p(len(raw[i]))) and np.isclose(column["largest"][i], max(counts, default=0) / max(1, len(w)))
        assert np.isclose(column["capitals"][i], sum("A" <= c <= "Z" for c in t) / max(1, len(raw[i]))) and np.isclose(column["neighbours"][i], sum(a == b for a, b in zip(w, w[1:])) / max(1, len(w)))
        assert column["off"][i] == (0 if i % 3 else -1)


def test_pipeline(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        docs = spark.createDataFrame(out, stage(spark, docs, SF).schema)
        if name != "sentencepiece":
            assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontaminate", "sentencepiece"]
    assert stages.chain(spark, SF, corpus_pipeline.STAGES).count() == before


def _corpus(spark, folder):
    """A small corpus with planted toxic documents, copies, shared passages, benchmark text, nulls, and columns with clashing names."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 8)))
    vocabulary = [word() for _ in range(400)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, item = line(60), line(40)
    docs, labels = [(0, None), (1, ""), (2, None), (3, " \n")], []
    for i in range(4, 200):
        t = line(rnd.randrange(100, 200))
        if i % 4 == 0:
            w = t.split()
            for _ in range(14):
                w.insert(rnd.randrange(len(w)), rnd.choice(["wretchedfool", "stupidoaf", "vilecreature"]))
            t = " ".join(w)
        elif i % 10 == 1:
            t = docs[rnd.randrange(5, len(docs))][1]
        elif i % 10 == 3:
            t = t + " " + passage
        elif i % 10 == 5:
            t = t[:300] + " " + item
        elif i % 10 == 7:
            w = (docs[rnd.randrange(5, len(docs))][1] or "x").split()
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        docs.append((i, t))
        # copies are as toxic as what they copy
        labels.append((i, 1, int("vilecreature" in t)))
    docs += [docs[50], docs[50]]
    frame_ = spark.createDataFrame([(k, t, "en", None, len(t or ""), "x", 7, 0.5) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long, same string, node long, label double")
    frame_.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, item


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    folder = f"file://{tmp_path}"
    docs, item = _corpus(spark, folder)
    steps = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    now = steps["toxicity"](spark, table, folder)
    assert now.columns == table.columns
    kept = rows(now)
    scores = {r.doc_id: r.score for r in toxicity.classify(table, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert kept == sorted(((k, t) for k, t in docs if scores[k] < 0.7), key=repr)
    planted = {k for k, t in docs if t and "vilecreature" in t}
    assert len(planted - {k for k, _ in kept}) > 0.9 * len(planted) and len({k for k, _ in kept}) > 0.95 * len({k for k, _ in docs} - planted)
    now = spark.createDataFrame(now.collect(), now.schema)
    after = steps["near_duplicates"](spark, now, folder)
    want = brute.near_classes(kept)
    assert after.columns == table.columns and rows(after) == sorted({(k, t) for k, t in kept if want[k] == k}, key=repr)
    now = spark.createDataFrame(after.collect(), after.schema)
    after = steps["repeated_passages"](spark, now, folder)
    plain = [(k, raw.decode(errors="ignore")) for k, _, _, _, raw in brute.repeats(rows(now))]
    assert rows(after) == sorted(plain, key=repr) and all(r.n_chars == len(r.text) for r in after.collect())
    now = spark.createDataFrame(after.collect(), after.schema)
    after = steps["decontaminate"](spark, now, folder)
    bad = {r[0] for r in brute.contamination(rows(now), [(1, item)]) if r[4]}
    assert bad and rows(after) == sorted(((k, t) for k, t in rows(now) if k not in bad), key=repr)
    ref = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {r.doc_id: r.ids for r in steps["sentencepiece"](spark, after, folder).collect()}
    assert ids == {k: ref.encode(t) for k, t in rows(after)}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()} == ids
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, table.limit(0), folder).count() == 0, name


def test_first_copies_of_a_task():
    import pyarrow as pa

    rows = [[(5, b"a"), (3, b"a"), (9, b"b")], [(4, b"a"), (2, b"a"), (9, b"b"), (7, b"c")], [(1, b"b")]]
    batches = [pa.RecordBatch.from_pylist([{"node": k, "same": s, "text": f"{k}{s}"} for k, s in r], schema=pa.schema([("node", pa.int64()), ("same", pa.binary()), ("text", pa.string())])) for r in rows]
    got = [(r["node"], r["same"]) for b in repeats._first_copies(iter(batches)) for r in b.to_pylist()]
    assert got == [(3, b"a"), (9, b"b"), (2, b"a"), (7, b"c"), (1, b"b")]


@pytest.mark.parametrize(("samples", "labels"), [([b"", b""], [0, 1]), ([b"a", b"b"], [0, 1]), ([b"x" * 200, b"", b"y z" * 100], [1, 0, 0]), ([b"same" * 60] * 6, [0, 1] * 3)])
def test_toxicity_of_odd_samples(samples, labels):
    import numpy as np

    y = np.array(labels)
    model = toxicity.train(list(samples), y, np.arange(len(y)) % 3, 3.0)
    off = np.cumsum([0, *map(len, samples)])
    got = model.scores(np.frombuffer(b"".join(samples), np.uint8), off, model.coders())
    assert len(got) == len(samples) and ((got >= 0) & (got <= 1)).all()
    assert toxicity.Model(chances=[0.3]).scores(np.empty(0, np.uint8), np.array([0, 0]), toxicity.Model().coders()).tolist() == [0.3]

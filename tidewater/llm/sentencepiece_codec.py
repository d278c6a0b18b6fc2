"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest-prefix lookups in the model's compiled character map (a double-array
trie of byte strings); each byte written records the source byte it stands for.  The library then
segments the normalised text, and every piece is projected through the alignment to a span of
original bytes; the spans of a text tile it.  Decoding is the library's own.

Segmentation runs on parts of the text between which the model cannot merge: where no piece holds a
space mark after another character, a merge never crosses from a word to the next space, so equal
parts always get equal ids and are kept in a bounded cache.

Defined cases: null and empty texts have no ids, no spans, and decode to the empty text; repeated
rows get equal rows; extra columns are never read.  Models with user-defined symbols, suffix
spaces or no byte fallback are refused, as their pieces cannot be aligned byte by byte.
"""

from __future__ import annotations

import hashlib
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from . import textbuf as tb

MARK = "▁"
#: Parts whose ids are kept in memory (about 300 bytes each), and text bytes worked on at a time.
CACHE = 40_000
SHARD_BYTES = 1 << 20


class CharacterMap:
    """The compiled character map: longest-prefix replacement of byte strings."""

    def __init__(self, blob: bytes):
        self.units, self.strings = np.empty(0, np.uint32), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4)
            self.strings = blob[4 + size :]
        self.table = self.units.tolist()

    def longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """(bytes matched, place of the replacement) of the longest key at this byte."""
        units, best = self.table, None
        node = self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        return best

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def replacement(self, place: int) -> bytes:
        return self.strings[place : self.strings.index(b"\0", place)]


class Normaliser:
    """Text to (normalised bytes, the source byte of each, with a last entry for the end)."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = MARK.encode() if spec.escape_whitespaces else b" "

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        data = text.encode()
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.table and not self.squeeze:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        lead = self.space if self.dummy else b""
        width = np.ones(len(data), np.int64)
        width[np.frombuffer(data, np.uint8) == 32] = len(self.space)
        source = np.repeat(np.arange(len(data)), width)
        return lead + data.replace(b" ", self.space), np.concatenate([np.zeros(len(lead), np.int64), source, [len(data)]])

    def _steps(self, data: bytes):
        """(source place, source length, replacement) along the text."""
        at = 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map.table else None
            if found:
                yield at, found[0], self.map.replacement(found[1])
                at += found[0]
            else:
                lead = data[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                yield at, n, data[at : at + n]
                at += n

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, source = bytearray(), []
        begun, after_space, end = False, self.squeeze, 0
        for at, n, new in self._steps(data):
            if not begun and self.squeeze and new == b" ":
                continue
            if not begun:
                begun = True
                if self.dummy:
                    out += self.space
                    source += [at] * len(self.space)
            kept = new.lstrip(b" ") if after_space else new
            same = new == data[at : at + n]
            for i, c in enumerate(kept, len(new) - len(kept)):
                piece = self.space if c == 32 else bytes([c])
                out += piece
                source += [at + i if same else at] * len(piece)
            if kept:
                after_space = self.squeeze and kept.endswith(b" ")
            elif not self.squeeze:
                after_space = False
            end = at + n
        if self.squeeze:
            while out.endswith(self.space):
                end = source[-len(self.space)]
                del out[-len(self.space) :], source[-len(self.space) :]
        return bytes(out), np.array([*source, end], np.int64)


class Codec:
    """Encoding with offsets, and decoding, by one model (its serialised bytes)."""

    def __init__(self, model: bytes):
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kinds = {p.type for p in proto.pieces}
        if 4 in kinds or proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError("the model has user-defined symbols, suffix spaces or no byte fallback")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalise = Normaliser(proto.normalizer_spec)
        self.lengths = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        spec = proto.normalizer_spec
        self.plain = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix and spec.escape_whitespaces
        self.parts_only = not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        # the same pieces on text that is normalised already
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.cache: dict[str, tuple[list[int], str]] = {}
        self.shared = list(range(len(proto.pieces)))  # one object for each id, whatever holds it
        self.split = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _parts(self, text: str) -> list[str]:
        """The normalised text, cut where nothing can merge."""
        if self.plain and self.parts_only and MARK not in text and "  " not in text and text[:1] != " ":
            return [MARK + x for x in text.split(" ")]
        whole = self.normalise(text)[0].decode()
        return self.split.findall(whole) if self.parts_only else [whole] if whole else []

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """(ids, their decimal digits joined by commas) of each text."""
        cut = [self._parts(t) if t else [] for t in texts]
        get = self.cache.get
        new = {p for parts in cut for p in parts if get(p) is None}
        extra: dict[str, tuple[list[int], str]] = {}
        if new:
            fresh = list(new)
            for p, ids in zip(fresh, self.pieces.encode(fresh, num_threads=1), strict=True):
                entry = [self.shared[i] for i in ids], ",".join(map(str, ids))
                (self.cache if len(self.cache) < CACHE and len(p) < 64 else extra)[p] = entry
        out = []
        for parts in cut:
            if extra:
                got = [get(p) or extra[p] for p in parts]
            else:
                got = [get(p) for p in parts]
            out.append((list(chain.from_iterable(e[0] for e in got)), ",".join([e[1] for e in got])))
        return out

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last original byte of each piece."""
        normal, source = self.normalise(text)
        end = np.cumsum(self.lengths[ids]) if ids else np.zeros(0, np.int64)
        if (int(end[-1]) if len(end) else 0) != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        bounds = source[np.concatenate([[0], end])]
        return bounds[:-1], bounds[1:]


def _model(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _codec(model) -> Codec:
    """One codec for a worker's whole life, so its cache serves later partitions."""
    key = hashlib.sha256(model.value).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model.value)
    return _CODECS[key]


_CODECS: dict[bytes, Codec] = {}


def encode(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, ids, starts and ends (original bytes of each piece), decoded text."""
    model = _model(docs.sparkSession, model_path)

    def run(batches):
        codec = _codec(model)
        for batch in tb.sharded(batches, "text", SHARD_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            got = codec.encode(texts)
            spans = [codec.spans(t, ids) for t, (ids, _) in zip(texts, got, strict=True)]
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(ids) for ids, _ in got])]), pa.int32())
            flat = [np.fromiter(chain.from_iterable(g[0] for g in got), np.int32), *(np.concatenate([s[k] for s in spans] or [[]]).astype(np.int32) for k in (0, 1))]
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *lists, pa.array(codec.whole.decode([g[0] for g in got], num_threads=1), pa.string())], ["key", "ids", "starts", "ends", "decoded"])

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "key long, ids array<int>, starts array<int>, ends array<int>, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` reduced to one short row per document while its lists are still in the worker."""
    model = _model(docs.sparkSession, model_path)

    def run(batches):
        codec = _codec(model)
        for batch in tb.sharded(batches, "text", SHARD_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for t, (ids, digits), back in zip(texts, got := codec.encode(texts), codec.whole.decode([g[0] for g in got], num_threads=1), strict=True):
                starts, ends = codec.spans(t, ids)
                rows.append((len(ids), hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), hashlib.sha256(np.stack([starts, ends], 1).astype("<i8").tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], ["key", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    narrow = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string").withColumnRenamed("key", key)

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features are hashed lower-case words (log counts, unit length) and one-hot quantile bins of statistics
of the text (its length, word and line lengths, shares of capitals, digits, symbols and non-ASCII
bytes, how repetitive its words are) and of numeric metadata columns, each also as its difference from
the text's own length.  Pairwise interactions have rank RANK and are scored in time linear in a
document's own features: sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
Training is AdaGrad on a bounded sample; scoring is one pass over whole texts without a shuffle.

Defined cases: null and empty texts have no words, and statistics of zero; null or missing metadata is
the value -1; without labelled rows of both kinds every document gets the sample's share of good ones;
repeated rows get equal rows; a text longer than a shard is scored alone; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .labelled import held_out, sample

BUCKETS = 1 << 16
RANK = 8
BINS = 8
#: Labelled documents that training reads at most: bad, good.
PER_CLASS = {0: 2000, 1: 2000}
SHARD_BYTES = 4 << 20
EPOCHS, RATE, DECAY = 12, 0.3, 1e-5
STATS = ["bytes", "words", "lines", "word_length", "line_length", "capitals", "digits", "symbols", "other_bytes", "distinct", "largest", "neighbours"]
#: Numeric columns beside the text; labels, languages, sources and ids may not be among them.
METADATA = ("n_chars",)
#: Value of a one-hot bin.
HOT = 0.3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True


def _per_doc(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


@dataclass
class Described:
    """Statistics of documents, and their words: those of document i lie between start[i] and start[i + 1]."""

    stats: np.ndarray
    start: np.ndarray
    bucket: np.ndarray
    value: np.ndarray


def describe(data: np.ndarray, offsets: np.ndarray, metadata: np.ndarray) -> Described:
    """Statistics (documents x STATS and two a metadata column) and unit-length hashed log counts of words."""
    docs = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    s, e, first = tb.word_bounds(data, offsets)
    h = tb.span_hashes(tb.LOWER[data], s, e)
    n = np.diff(first).astype(np.float64)
    lines = _per_doc(data == 10, offsets) + (size > 0)
    of_byte, of_word = np.maximum(size, 1), np.maximum(n, 1)
    doc = np.repeat(np.arange(docs), np.diff(first))
    used, count = np.unique(doc * BUCKETS + (h >> tb.U(20)).astype(np.int64) % BUCKETS, return_counts=True)
    start = np.searchsorted(used, np.arange(docs + 1) * BUCKETS)
    largest = np.zeros(docs)
    np.maximum.at(largest, used // BUCKETS, count)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    chars = _per_doc((data & 0xC0) != 0x80, offsets)
    stats = np.stack(
        [
            np.log1p(size), np.log1p(n), np.log1p(lines), size / of_word, size / np.maximum(lines, 1),
            _per_doc((data >= 65) & (data <= 90), offsets) / of_byte, _per_doc((data >= 48) & (data <= 57), offsets) / of_byte,
            _per_doc(_SYMBOL[data], offsets) / of_byte, _per_doc(data >= 128, offsets) / of_byte,
            np.diff(start) / np.minimum(of_word, BUCKETS), largest / of_word, _per_doc(same, first) / of_word,
            *(c for m in metadata for c in (np.log1p(np.maximum(m, -0.5)), np.where(m < 0, -1.0, np.abs(m - chars) / np.maximum(chars, 1)))),
        ],
        1,
    )
    value = np.log1p(count)
    length = np.sqrt(np.bincount(used // BUCKETS, weights=value**2, minlength=docs))
    return Described(stats, start, used % BUCKETS, (value / np.maximum(length, 1e-6)[used // BUCKETS]).astype(np.float32))


def _joined(stats: np.ndarray, cuts: np.ndarray, d: Described) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, index, value) of all features: the bins first, then the words."""
    docs, kinds = stats.shape
    bins = (stats[:, :, None] > cuts[None]).sum(2) + np.arange(kinds) * BINS
    words = np.diff(d.start)
    start = np.concatenate([[0], np.cumsum(words + kinds)])
    index, value = np.empty(start[-1], np.int64), np.empty(start[-1], np.float32)
    hot = (start[:-1, None] + np.arange(kinds)).ravel()
    index[hot], value[hot] = bins.ravel(), HOT
    word = np.arange(len(d.bucket)) + np.repeat((np.arange(docs) + 1) * kinds, words)
    index[word], value[word] = kinds * BINS + d.bucket, d.value
    return start, index, value


@dataclass
class Machine:
    cuts: np.ndarray  # statistics x (BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, start: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The machine's sums, and each document's mixed factors; every document has a feature."""
        at = start[:-1]
        v = self.factors[index] * value[:, None]
        mixed = np.add.reduceat(v, at, 0)
        own = np.add.reduceat((v**2).sum(1), at)
        return self.bias + np.add.reduceat(self.linear[index] * value, at) + 0.5 * ((mixed**2).sum(1) - own), mixed

    def score(self, data: np.ndarray, offsets: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Scores of documents, a bounded block at a time."""
        out = []
        for a in range(0, len(offsets) - 1, 256):
            cut = offsets[a : a + 257]
            d = describe(data[cut[0] : cut[-1]], cut - cut[0], metadata[:, a : a + 256])
            z, _ = self.raw(*_joined(d.stats, self.cuts, d))
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))
        return np.concatenate(out) if out else np.empty(0)


def train(d: Described, y: np.ndarray, seed: int = 11) -> Machine:
    """AdaGrad on logistic loss, classes weighted to equal halves of the loss; 16 rows a step, only their own features change."""
    cuts = np.quantile(d.stats, np.arange(1, BINS) / BINS, axis=0).T
    n = d.stats.shape[1] * BINS + BUCKETS
    rng = np.random.default_rng(seed)
    m = Machine(cuts, 0.0, np.zeros(n, np.float32), rng.normal(0, 0.05, (n, RANK)).astype(np.float32))
    start, index, value = _joined(d.stats, cuts, d)
    seen_b, seen_w, seen_v = 1e-6, np.full(n, 1e-6, np.float32), np.full((n, RANK), 1e-6, np.float32)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(order), 16):
            on = order[a : a + 16]
            size = start[on + 1] - start[on]
            first = np.concatenate([[0], np.cumsum(size)])
            at = np.repeat(start[on] - first[:-1], size) + np.arange(first[-1])
            i, x = index[at], value[at]
            z, mixed = m.raw(first, i, x)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[on]) * weight[on] / len(on)).astype(np.float32)
            gx = np.repeat(g, size) * x
            step = gx[:, None] * (np.repeat(mixed, size, 0) - m.factors[i] * x[:, None])
            by = np.argsort(i, kind="stable")
            used = np.flatnonzero(np.concatenate([[True], i[by][1:] != i[by][:-1]]))
            touched = i[by][used]
            gw = np.add.reduceat(gx[by], used) + DECAY * m.linear[touched]
            gv = np.add.reduceat(step[by], used, 0) + DECAY * m.factors[touched]
            gb = float(g.sum())
            seen_b += gb * gb
            seen_w[touched] += gw * gw
            seen_v[touched] += gv * gv
            m.bias -= RATE * gb / seen_b**0.5
            m.linear[touched] -= RATE * gw / np.sqrt(seen_w[touched])
            m.factors[touched] -= 0.3 * RATE * gv / np.sqrt(seen_v[touched])
    # words that training didn't see have no interactions
    unseen = np.ones(n, bool)
    unseen[index] = False
    m.factors[unseen] = 0
    # back from halves to the classes' own shares
    m.bias += float(np.log(y.mean() / (1 - y.mean())))
    return m


def _metadata(docs: DataFrame, metadata: tuple[str, ...]) -> list:
    have = {c.lower() for c in docs.columns}
    return [(F.coalesce(F.col(c).try_cast("double") if c.lower() in have else F.lit(None).cast("double"), F.lit(-1.0))).alias(f"meta{k}") for k, c in enumerate(metadata)]


def _numbers(batch: pa.RecordBatch, count: int) -> np.ndarray:
    return np.stack([batch.column(f"meta{k}").to_numpy() for k in range(count)]) if count else np.empty((0, batch.num_rows))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = METADATA, per_class: dict[int, int] | None = None) -> Machine:
    """A machine from a bounded sample; its features are worked out where the rows are, a bounded number of numbers each."""
    rows = sample(docs, labels, label, per_class=per_class or PER_CLASS, key=key, text=text, more=_metadata(docs, metadata))

    def run(batches):
        for batch in tb.sharded(batches, "text", SHARD_BYTES):
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                d = describe(*tb.utf8(part.column("text")), _numbers(part, len(metadata)))
                cut = d.start.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("label"), pa.array(list(d.stats), pa.list_(pa.float64())), pa.ListArray.from_arrays(cut, d.bucket.astype(np.int32)), pa.ListArray.from_arrays(cut, d.value)],
                    ["key", "label", "stats", "at", "value"],
                )

    got = rows.mapInArrow(run, "key long, label int, stats array<double>, at array<int>, value array<float>").toArrow().sort_by("key")
    y = got["label"].to_numpy().astype(np.float64)
    kinds = len(STATS) + 2 * len(metadata)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
        n = kinds * BINS + BUCKETS
        return Machine(np.zeros((kinds, BINS - 1)), float(np.log(p / (1 - p))), np.zeros(n, np.float32), np.zeros((n, RANK), np.float32))
    at, value = got["at"].combine_chunks(), got["value"].combine_chunks()
    start = at.offsets.to_numpy().astype(np.int64)
    return train(Described(np.stack(got["stats"].to_pylist()), start - start[0], at.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy()), y)


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = METADATA, threshold: float = 0.5) -> DataFrame:
    """(key, held_out, score, predicted) of each document's whole text."""
    machine = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key=key, text=text, metadata=metadata))

    def run(batches):
        for batch in tb.sharded(batches, "text", SHARD_BYTES):
            got = machine.value.score(*tb.utf8(batch.column("text")), _numbers(batch, len(metadata)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(got, pa.float64())], ["key", "score"])

    scored = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), *_metadata(docs, metadata)).mapInArrow(run, "key long, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

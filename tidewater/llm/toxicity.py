"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on windows of toxic
text.  Every window of a document is compressed twice, with the ordinary dictionary and with the toxic
one set before it, so that what both know costs the same; the bytes saved are the window's distance
between the classes.

A label says that a document is toxic, not where.  The toxic dictionary is therefore trained in
rounds: first on the windows of toxic documents that the ordinary dictionary compresses worst, then on
those that the toxic dictionary of the other folds compresses better than nearly all ordinary windows,
beside the hardest of the rest.  Strings that several documents share take no part, since a copied
passage says nothing about a class.

A third of the sample takes no part in the dictionaries.  On it each saving gets a log-likelihood
ratio; a document's statistic is the sum over its windows, turned to a probability by isotonic
regression under the labels' own shares, which calibrates the threshold.  The round that finds most
toxic documents there is kept.  Whole texts are scored, in overlapping windows; no shuffle.

Defined cases: null and empty texts have no windows and so the statistic 0; without toxic or ordinary
labelled rows every document gets the share of toxic ones in the sample; repeated rows get equal
rows; very long texts are compressed CHUNK windows at a time; ids are whole numbers or null; extra
columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .labelled import held_out, sample

WINDOW, STEP = 128, 64
ORDINARY_BYTES, TOXIC_BYTES = 65536, 4096
ROUNDS = 8
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Strings of so many bytes that two documents of the sample share aren't trained on; shorter pieces between them neither.
SHARED, PIECE = 32, 16
#: Share of the ordinary windows that a window must exceed to be hard, or toxic; others of a document that are taken all the same.
HARD, SURE, FORCED = 0.95, 0.999, 2
#: Savings are counted from -LEAST to MOST bytes a window; evidence of one window lies in [-1, CLIP].
LEAST, MOST, CLIP = 6, 14, 5.0
#: Labelled documents that training reads at most: ordinary, toxic; longer ones (in bytes) aren't learnt from.
PER_CLASS = {0: 4500, 1: 1500}
LONGEST = 1 << 16
#: Windows compressed in one call; parts in which strings are compared, to bound memory.
CHUNK, SLICES = 1 << 16, 16


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the windows of texts of such sizes; the last one ends with its text."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP)), 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return doc, start, np.minimum(WINDOW, sizes[doc] - start)


class Coder:
    """Compressed lengths of windows under a dictionary."""

    SETTINGS = {"window_log": 17, "hash_log": 16, "chain_log": 17, "search_log": 5, "min_match": 4, "target_length": 32, "strategy": zs.STRATEGY_LAZY2, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0, "format": zs.FORMAT_ZSTD1_MAGICLESS}

    def __init__(self, content: bytes):
        settings = zs.ZstdCompressionParameters(**self.SETTINGS)
        kept = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT) if content else None
        if kept:
            kept.precompute_compress(compression_params=settings)
        self.coder = zs.ZstdCompressor(compression_params=settings, **({"dict_data": kept} if kept else {}))

    def sizes(self, flat: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.int64)
        for a in range(0, len(start), CHUNK):
            part = slice(a, min(a + CHUNK, len(start)))
            low = int(start[part].min())
            data = flat[low : int((start[part] + length[part]).max())]
            got = self.coder.multi_compress_to_buffer(zs.BufferWithSegments(data, np.stack([start[part] - low, length[part]], 1).astype("<u8").tobytes()), threads=0)
            out[part] = np.fromiter((len(x) for x in got), np.int64, len(got))
        return out


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary's content; of too few samples for that, their last bytes."""
    samples = list(dict.fromkeys(samples))
    try:
        return zs.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def own_pieces(texts: list[bytes]) -> list[list[bytes]]:
    """Each text without the strings of SHARED bytes that another of them holds too."""
    count = np.array([max(0, len(x) - SHARED + 1) for x in texts], np.int64)
    h, ends, done = np.zeros(count.sum(), tb.U), np.cumsum(count), 0
    for x, n in zip(texts, count.tolist(), strict=True):
        if n:
            at8, mine = np.ndarray((len(x) - 7,), "<u8", buffer=np.frombuffer(x, np.uint8), strides=(1,)), h[done : done + n]
            for j in range(0, SHARED, 8):
                mine[:] = tb.mix((mine ^ at8[j : j + n]) * tb._C1)
            done += n
    shared = np.zeros(len(h), bool)
    for part in range(SLICES):
        on = np.flatnonzero(h % tb.U(SLICES) == tb.U(part))
        if len(on):
            on = on[np.argsort(h[on], kind="stable")]
            first = np.concatenate([[True], h[on][1:] != h[on][:-1]])
            at = np.flatnonzero(first)
            by = np.searchsorted(ends, on, side="right")
            several = np.maximum.reduceat(by, at) != np.minimum.reduceat(by, at)
            shared[on] = several[np.cumsum(first) - 1]
    out, done = [], 0
    for x, n in zip(texts, count.tolist(), strict=True):
        cover = np.zeros(len(x) + 1, np.int64)
        at = np.flatnonzero(shared[done : done + n])
        done += n
        np.add.at(cover, at, 1)
        np.add.at(cover, at + SHARED, -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) == 0).astype(np.int8), [0]]))
        out.append([x[a:b] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True) if b - a >= min(PIECE, len(x))])
    return out


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[int], list[float]]:
    """Pool adjacent violators on integer x, rows weighted: from each level on, a probability; a level lies midway between the values it parts."""
    blocks: list[list[float]] = []  # first value, weight of the ones, weight, last value
    for v in np.unique(x):
        on = x == v
        blocks.append([int(v), float((weight * y)[on].sum()), float(weight[on].sum()), int(v)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, s, w, last = blocks.pop()
            blocks[-1][1] += s
            blocks[-1][2] += w
            blocks[-1][3] = last
    levels = [b[0] if not k else -((-blocks[k - 1][3] - b[0]) // 2) for k, b in enumerate(blocks)]
    return levels, [b[1] / b[2] for b in blocks]


def evidence_of(saved: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each saving, by the windows of both classes."""
    counts = np.ones((2, LEAST + MOST + 1))
    np.add.at(counts, (label, np.clip(saved, -LEAST, MOST) + LEAST), 1)
    ratio = np.log(counts / counts.sum(1, keepdims=True))
    return np.clip(ratio[1] - ratio[0], -1, CLIP)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(LEAST + MOST + 1))
    levels: list[int] = field(default_factory=lambda: [0])
    chances: list[float] = field(default_factory=lambda: [0.0])

    def coders(self) -> tuple[Coder, Coder]:
        return Coder(self.ordinary), Coder(self.toxic + self.ordinary)

    def statistics(self, saved: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """The summed evidence of each document, in quarters."""
        per = np.rint(1024 * self.evidence).astype(np.int64)[np.clip(saved, -LEAST, MOST) + LEAST]
        total = np.zeros(docs, np.int64)
        np.add.at(total, doc, per)
        return np.rint(total / 256).astype(np.int64)

    def chance(self, statistic: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.levels, statistic, side="right") - 1
        return np.array(self.chances)[np.maximum(at, 0)]

    def scores(self, data: np.ndarray, offsets: np.ndarray, coders: tuple[Coder, Coder]) -> np.ndarray:
        """The probability of each text of a flat buffer."""
        doc, start, length = windows(np.diff(offsets))
        flat, start = tb.LOWER[data].tobytes(), start + offsets[:-1][doc]
        saved = coders[0].sizes(flat, start, length) - coders[1].sizes(flat, start, length)
        return self.chance(self.statistics(saved, doc, len(offsets) - 1))


class _Windows:
    """Windows of texts, each the list of its pieces."""

    def __init__(self, texts: list[list[bytes]]):
        pieces = [p for t in texts for p in t]
        sizes = np.array([len(p) for p in pieces], np.int64)
        piece, self.at, self.length = windows(sizes)
        self.flat, self.start = b"".join(pieces), self.at + (np.cumsum(sizes) - sizes)[piece]
        self.doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[piece] if len(pieces) else piece

    def bytes_at(self, on: np.ndarray) -> list[bytes]:
        return [self.flat[a : a + n] for a, n in zip(self.start[on].tolist(), self.length[on].tolist(), strict=True)]

    def sizes(self, content: bytes, on: np.ndarray) -> np.ndarray:
        return Coder(content).sizes(self.flat, self.start[on], self.length[on])


def _hardest(cost: np.ndarray, doc: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The FORCED windows of the highest cost of each document."""
    at = np.flatnonzero(on)
    at = at[np.lexsort((at, -cost[at], doc[at]))]
    rank = np.arange(len(at)) - np.searchsorted(doc[at], doc[at])
    return at[rank < FORCED]


def train(texts: list[bytes], label: np.ndarray, fold: np.ndarray, ordinary_weight: float = 1.0, threshold: float = THRESHOLD) -> Model:
    """A model: dictionaries from the texts of folds 0 and 1, evidence and probabilities from those of fold 2, which training never sees."""
    held = fold == 2
    if not all((label[held] == k).any() and (label[~held] == k).any() for k in (0, 1)):
        held = np.zeros(len(texts), bool)  # too few to keep some apart
    learnt = np.flatnonzero(~held)
    w = _Windows(own_pieces([texts[i] for i in learnt]))
    test = np.flatnonzero(held) if held.any() else learnt
    whole, y = _Windows([[texts[i]] if texts[i] else [] for i in test]), label[test]
    toxic, of, every = label[learnt][w.doc] == 1, fold[learnt][w.doc], np.arange(len(w.doc))
    # windows that don't overlap hold all of the text
    ordinary = _trained(ORDINARY_BYTES, w.bytes_at(every[~toxic & (w.at % WINDOW == 0)]))
    plain, plain_whole = w.sizes(ordinary, every), whole.sizes(ordinary, np.arange(len(whole.doc)))
    full = w.length == WINDOW
    limit = np.quantile(plain[~toxic & full], HARD) if (~toxic & full).any() else 0
    chosen = np.flatnonzero(toxic & full & (plain > limit))
    if not len(chosen):
        chosen = every[toxic]
    best: tuple[tuple[float, float], Model] | None = None
    for _ in range(ROUNDS):
        model = Model(ordinary, _trained(TOXIC_BYTES, w.bytes_at(chosen)))
        saved_whole = plain_whole - whole.sizes(model.toxic + ordinary, np.arange(len(whole.doc)))
        model.evidence = evidence_of(saved_whole, y[whole.doc])
        statistic = model.statistics(saved_whole, whole.doc, len(test))
        model.levels, model.chances = isotonic(statistic, y, np.where(y == 1, 1.0, ordinary_weight))
        # recall at the threshold, and where one ordinary text in a hundred is lost
        merit = float((model.chance(statistic)[y == 1] >= threshold).mean()), float((statistic[y == 1] > np.quantile(statistic[y == 0], 0.99)).mean())
        if best is None or merit > best[0]:
            best = merit, model
        # the next round's windows, by dictionaries of the other fold
        saved = plain.copy()
        for k in (0, 1):
            on = np.flatnonzero(of == k)
            saved[on] -= w.sizes(_trained(TOXIC_BYTES, w.bytes_at(chosen[of[chosen] != k])) + ordinary, on)
        sure = toxic & (saved > (np.quantile(saved[~toxic], SURE) if (~toxic).any() else 0))
        chosen = np.concatenate([np.flatnonzero(sure), _hardest(plain / np.maximum(w.length, 1), w.doc, toxic & full & ~sure)])
        if not len(chosen):
            break
    return best[1]


def _lower(text: str | None) -> bytes:
    return tb.LOWER[np.frombuffer((text or "").encode(), np.uint8)].tobytes()


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", key: str = "doc_id", text: str = "text", per_class: dict[int, int] | None = None) -> Model:
    """A model from a bounded sample of labelled documents, brought to the driver."""
    rows = sample(docs, labels, label, per_class=per_class or PER_CLASS, key=key, text=text).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).orderBy("key").collect()
    # equal texts of one label count once
    distinct = list({(r["text"], r["label"]): (r["label"], r["fold"]) for r in rows}.items())
    y, fold = np.array([v[0] for _, v in distinct], np.int64), np.array([v[1] for _, v in distinct], np.int64)
    if not len(y) or y.min() == y.max():
        return Model(chances=[float(y.mean()) if len(y) else 0.0])
    # the sample holds more toxic rows than the labels do
    have = {r["label"]: r["n"] for r in labels.where(F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    ordinary = max(1.0, have.get(0, 1) / have.get(1, 1) * y.sum() / (y == 0).sum())
    return train([_lower(k[0]) for k, _ in distinct], y, fold, ordinary)


def _scored(held, column: str):
    """A batch's probabilities, batch by batch."""

    def run(batches):
        coders = held.value.coders()
        for batch in batches:
            yield batch, held.value.scores(*tb.utf8(batch.column(column)), coders)

    return run


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each document's whole text."""
    scored = _scored(docs.sparkSession.sparkContext.broadcast(model), "text")

    def run(batches):
        for batch, got in scored(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(got, pa.float64())], ["key", "score"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, score double").withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all columns) that score below the threshold."""
    scored = _scored(docs.sparkSession.sparkContext.broadcast(model), text)

    def run(batches):
        for batch, got in scored(batches):
            yield batch.filter(pa.array(got < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    scored = score(docs, fit(docs, labels, key=key, text=text), key=key, text=text)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

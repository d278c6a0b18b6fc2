"""Benchmark decontamination with suffix arrays of the training text.

The documents are cut into shards of a few megabytes.  Each shard gets a word-level suffix array,
sorted as deep as the longest benchmark item (deeper order cannot matter to a search); words that
no item holds end a suffix, as a document's end does.  Every suffix of every item is then searched
for by binary search in the shard's array, four words a step, which yields its longest verbatim
match, the places of its windows, and so the hit words of each document.  A shard needs nothing
from other shards, so there is no shuffle.  The benchmark is read in blocks of a bounded size;
each block is matched against all documents and the blocks' findings are merged by document.
Items of equal words are searched for once, and occurrences are expanded EXPANDED at a time.

Defined cases: a null or empty text has no words, no hits and is kept; a null item text or item id
is ignored; items with equal ids count once; repeated document rows are judged each on its own; a
text longer than a shard is a shard of its own; of equally long matches the first in the document
counts; extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
#: Occurrences of windows that are expanded at a time (or those of one item).
EXPANDED = 1 << 22
#: Words packed into one 64-bit key (16 bits each; 0 ends a suffix).
PACK = 4


@dataclass
class Items:
    """The windows and suffixes of one block of benchmark items, as ranks in the block's vocabulary."""

    ids: list[list[str]]  # of each distinct sequence of words, in order
    vocabulary: np.ndarray  # sorted word hashes
    ranks: np.ndarray  # the items' words, 1 up
    item: np.ndarray  # item of each word
    left: np.ndarray  # words from here to the item's end
    window: int

    @classmethod
    def build(cls, rows: list[tuple[str, str | None]], window: int) -> Items:
        rows = [r for r in rows if r[0] is not None]
        data, off = tb.utf8(pa.array([r[1] for r in rows], pa.large_string()))
        h, first = tb.words(data, off)
        same: dict[bytes, list[int]] = {}
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            same.setdefault(h[a:b].tobytes(), []).append(k)
        h = np.concatenate([np.empty(0, tb.U), *(h[first[k[0]] : first[k[0] + 1]] for k in same.values())])
        n = np.array([first[k[0] + 1] - first[k[0]] for k in same.values()], np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        vocabulary = np.unique(h)
        item = np.repeat(np.arange(len(n)), n)
        return cls([sorted({rows[i][0] for i in k}) for k in same.values()], vocabulary, np.searchsorted(vocabulary, h) + 1, item, first[1:][item] - np.arange(len(h)), window)

    @property
    def depth(self) -> int:
        return int(self.left.max(initial=0))

    def size(self) -> np.ndarray:
        """Words of the window that starts at each suffix; 0 where none starts."""
        whole = np.bincount(self.item, minlength=len(self.ids))[self.item]
        start = self.left == whole
        return np.where(self.left >= self.window, self.window, np.where(start & (whole < self.window), whole, 0))


class SuffixArray:
    """Suffixes of a shard's words, in order to ``depth`` words; a zero ends each suffix."""

    def __init__(self, ranks: np.ndarray, depth: int, bits: int):
        self.bits, self.pack = bits, 64 // bits
        self.text = np.concatenate([ranks.astype(tb.U), np.zeros(depth + 2 * self.pack, tb.U)])
        at = np.flatnonzero(ranks)
        key = self._keys(at, 0)
        order = np.argsort(key, kind="stable")
        self.sa, self.key = at[order], key[order]
        tied = self.key[1:] == self.key[:-1]
        group = np.concatenate([[0], np.cumsum(~tied)]) if len(at) else np.empty(0, np.int64)
        last = tb.U((1 << bits) - 1)
        ended = (self.key & last) == 0  # such a suffix is equal to its like for good
        done = self.pack
        while done < depth and len(at):
            same = np.concatenate([tied, [False]]) | np.concatenate([[False], tied])
            open_ = np.flatnonzero(same & ~ended)
            if not len(open_):
                break
            nxt = self._keys(self.sa[open_], done)
            by = np.lexsort((nxt, group[open_]))
            self.sa[open_] = self.sa[open_][by]
            nxt = nxt[by]
            ended[open_] = (nxt & last) == 0
            split = np.ones(len(open_), bool)
            split[1:] = (group[open_][1:] != group[open_][:-1]) | (nxt[1:] != nxt[:-1])
            fresh = group.copy()
            fresh[open_] = len(group) + np.cumsum(split)
            tied = fresh[1:] == fresh[:-1]
            group = fresh
            done += self.pack

    def _keys(self, at: np.ndarray, skip: int) -> np.ndarray:
        """The next words of the suffixes after ``skip`` words, packed; nothing follows a zero."""
        out, live = np.zeros(len(at), tb.U), np.ones(len(at), bool)
        for j in range(self.pack):
            w = np.where(live, self.text[at + skip + j], tb.U(0))
            live &= w != 0
            out = (out << tb.U(self.bits)) | w if j else w.astype(tb.U)
        return out

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Binary search of every item suffix, a word a step: its longest match in words, the range of those matches, and the range of its window's occurrences."""
        n = len(items.ranks)
        size = items.size()
        longest, win = np.zeros(n, np.int64), np.zeros((2, n), np.int64)
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.sa), np.int64)
        pattern = items.ranks.astype(tb.U)
        live, depth, packed = np.arange(n), 0, np.zeros(n, tb.U)
        while len(live):
            word = pattern[live + depth]
            if depth < self.pack:
                rest = tb.U(self.bits * (self.pack - depth - 1))
                packed[live] |= word << rest
                x = np.searchsorted(self.key, packed[live], side="left")
                y = np.searchsorted(self.key, packed[live] | ((tb.U(1) << rest) - tb.U(1)), side="right")
            else:
                x, y = (self._bisect(lambda at, d=depth: self.text[at + d], word, lo[live], hi[live], right) for right in (False, True))
            live, x, y = live[y > x], x[y > x], y[y > x]
            depth += 1
            lo[live], hi[live], longest[live] = x, y, depth
            full = size[live] == depth
            win[0, live[full]], win[1, live[full]] = x[full], y[full]
            live = live[items.left[live] > depth]
        return longest, lo, win[0], win[1]

    def _bisect(self, value, key, lo, hi, right):
        lo, hi = lo.copy(), hi.copy()
        while True:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                return lo
            mid = (lo[on] + hi[on]) // 2
            v = value(self.sa[mid])
            below = v <= key[on] if right else v < key[on]
            lo[on[below]] = mid[below] + 1
            hi[on[~below]] = mid[~below]


def match_shard(data: np.ndarray, offsets: np.ndarray, items: Items) -> dict[str, list]:
    """What the block's items hit in each document of a shard."""
    h, first = tb.words(data, offsets)
    docs = len(offsets) - 1
    n_words = np.diff(first)
    out = {"n_words": n_words, "hits": [[] for _ in range(docs)], "items": [[] for _ in range(docs)], "longest": np.zeros(docs, np.int64), "longest_at": np.full(docs, -1, np.int64), "longest_item": [None] * docs}
    if not len(items.ranks) or not len(h):
        return out
    at = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
    ranks = np.where(items.vocabulary[at] == h, at + 1, 0)
    # a zero after each document keeps suffixes inside it
    doc = np.repeat(np.arange(docs), n_words)
    spaced = np.zeros(len(h) + docs, np.int64)
    spaced[np.arange(len(h)) + doc] = ranks
    bits = 16 if len(items.vocabulary) < 65535 else 32
    sa = SuffixArray(spaced, items.depth, bits)
    _, _, lo, hi = sa.search(items)
    size = items.size()
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return out
    base = first[:-1] + np.arange(docs)  # a document's first place in the spaced text
    # empty documents share no place with others, as each has its own zero
    cover = np.zeros(len(spaced) + 1, np.int64)
    parts, counts = [], hi[found] - lo[found]
    # an item's windows stay in one part
    of = items.item[found]
    upto = np.cumsum(counts)
    part = (upto[np.searchsorted(of, of, side="right") - 1] - 1) // EXPANDED
    for k in np.unique(part):
        on, count = found[part == k], counts[part == k]
        suffix = np.repeat(on, count)
        pos = sa.sa[np.repeat(lo[on], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + size[suffix], -1)
        where = np.searchsorted(base, pos, side="right") - 1
        parts.append(np.unique(where * len(items.ids) + items.item[suffix]))
        _longest(out, base, pos, suffix, size, items)
    hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    hit_doc = np.searchsorted(base, hit, side="right") - 1
    cut = np.searchsorted(hit_doc, np.arange(docs + 1))
    pairs = np.unique(np.concatenate(parts))
    pair_cut = np.searchsorted(pairs, np.arange(docs + 1) * len(items.ids))
    for d in np.unique(hit_doc):
        out["hits"][d] = hit[cut[d] : cut[d + 1]] - base[d]
        out["items"][d] = sorted({i for k in pairs[pair_cut[d] : pair_cut[d + 1]] % len(items.ids) for i in items.ids[k]})
    return out


def _longest(out: dict[str, list], base: np.ndarray, pos: np.ndarray, suffix: np.ndarray, size: np.ndarray, items: Items) -> None:
    """The longest verbatim matches of documents, from windows (place, item suffix), where they beat those already there."""
    # runs of windows on one diagonal are one verbatim match
    diagonal = np.lexsort((pos, pos - suffix))
    p, s = pos[diagonal], suffix[diagonal]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] - p[:-1] != 1) | (s[1:] - s[:-1] != 1) | (items.item[s[1:]] != items.item[s[:-1]])
    head = np.flatnonzero(new)
    run = np.diff(np.append(head, len(p))) - 1 + size[s[head]]
    run_doc = np.searchsorted(base, p[head], side="right") - 1
    best = np.lexsort((p[head], items.item[s[head]], -run, run_doc))
    lead = best[np.concatenate([[True], run_doc[best][1:] != run_doc[best][:-1]])]
    for r in lead:
        d = run_doc[r]
        if run[r] > out["longest"][d]:
            out["longest"][d], out["longest_at"][d], out["longest_item"][d] = run[r], p[head[r]] - base[d], items.ids[items.item[s[head[r]]]][0]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of at most ``limit`` bytes (or one item), streamed to the driver one partition at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null")
    for r in rows.toLocalIterator():
        n = len(r["t"] or "") * 4 + 64
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    if held:
        yield held


FOUND = "key long, n_words long, hits array<int>, items array<string>, longest long, longest_at long, longest_item string"


def _match(data, offsets, blocks) -> dict[str, list]:
    """All blocks against one shard; of several blocks, one is held in memory at a time."""
    found = None
    for block in blocks:
        new = match_shard(data, offsets, block.value)
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)
        if found is None:
            found = new
            continue
        for d in range(len(offsets) - 1):
            if len(new["hits"][d]):
                found["hits"][d] = np.union1d(found["hits"][d], new["hits"][d])
                found["items"][d] = sorted({*found["items"][d], *new["items"][d]})
            if new["longest"][d] > found["longest"][d]:
                for k in ("longest", "longest_at", "longest_item"):
                    found[k][d] = new[k][d]
    return found


def _matcher(blocks, shard_bytes):
    def run(batches):
        for batch in tb.sharded(batches, "text", shard_bytes):
            found = _match(*tb.utf8(batch.column("text")), blocks)
            kinds = {"n_words": pa.int64(), "hits": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "longest": pa.int64(), "longest_at": pa.int64(), "longest_item": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(found[k], kind) for k, kind in kinds.items())], ["key", *kinds])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, least_part: int = 20, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its key, n_words, n_hit, n_items, items, contaminated, and the longest verbatim match (words, first word, item).

    A document is contaminated if it has a hit and at least one in ``least_part`` of its words is hit.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(Items.build(rows, window)) for rows in _blocks(benchmark, block_bytes)] or [context.broadcast(Items.build([], window))]
    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_matcher(blocks, shard_bytes), FOUND)
    n_hit = F.size("hits").cast("long")
    return found.select(
        F.col("key").alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        ((n_hit > 0) & (least_part * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.col("longest").alias("longest_match"), F.col("longest_at").alias("longest_start"), "longest_item",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, least_part: int = 20, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents (all columns) that are not contaminated, in one pass over whole rows."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(Items.build(rows, window)) for rows in _blocks(benchmark, block_bytes)] or [context.broadcast(Items.build([], window))]

    def run(batches):
        for batch in tb.sharded(batches, text, shard_bytes):
            found = _match(*tb.utf8(batch.column(text)), blocks)
            n_hit = np.array([len(x) for x in found["hits"]])
            yield batch.filter(pa.array((n_hit == 0) | (least_part * n_hit < np.asarray(found["n_words"]))))

    return docs.mapInArrow(run, docs.schema)

"""Plain versions of the contracts, for small tables."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return WORD.findall((text or "").translate(LOW))


def contamination(docs, items):
    windows = {}
    for k, text in items:
        w = words(text)
        if k is not None and w:
            for i in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[i : i + 13]), set()).add(str(k))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((d, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def repeats(docs):
    """(id, bytes, removed, runs, kept) with every 100-byte string compared."""
    seen, out = {}, []
    raw = [(k, (t or "").encode()) for k, t in docs]
    order = lambda k: -(1 << 63) if k is None else k
    for k, b in raw:
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            seen[s] = min(seen.get(s, (order(k), p)), (order(k), p))
    for k, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if seen[b[p : p + 100]] < (order(k), p):
                gone[p : p + 100] = b"\1" * 100
        out.append((k, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def near_classes(docs, similarity=0.8, floor=0.5, rare=1000):
    """Class (smallest id) of each document by weighted Jaccard of five-word shingles, and equal texts.

    A shingle weighs 1 + ln(its count), times floor + (1 - floor) * ln((n + 1) / df) / ln(min(n + 1, rare)).
    """
    bags, df = {}, Counter()
    for k, t in docs:
        w = words(t)
        bags[k] = Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter([("text", t or "")])
        df.update(set(bags[k]))
    n = len(docs)
    idf = {x: floor + (1 - floor) * min(1, math.log((n + 1) / c) / math.log(min(n + 1, rare))) for x, c in df.items()}
    sets = {k: {x: (1 + math.log(c)) * idf[x] for x, c in b.items()} for k, b in bags.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = sum(min(v, sets[b][x]) for x, v in sets[a].items() if x in sets[b])
            if both and both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= similarity:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}

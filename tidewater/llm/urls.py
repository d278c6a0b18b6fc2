"""URL filters: domain and path rules first, then gradient-boosted trees on lexical features.

DataFrame functions only.  The trees are grown by histogram: every feature is cut into a few bins,
each level is one aggregation of gradients by (node, feature, bin), and only those bounded sums reach
the driver.  A finished model is a sum of CASE expressions, so scoring is one projection over the
URLs, without a shuffle.  Features are lengths, depth, digit ratio, entropy, parameter counts and
statistics of the host's suffix, from labelled URLs: by default those that a rule judges.

Defined cases: a null URL, or one without "://", has an empty host and path and is judged by the
method on those; repeated rows get equal rows; without labelled URLs of both kinds the method allows
everything; of equal gains the first feature and the lowest cut are taken; a suffix that is not among
the SUFFIXES most frequent of the sample has the sample's mean; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host and path, verdict)
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Labelled URLs that training reads at most, chosen by hash.
SAMPLE = 20_000
ROUNDS, DEPTH, BINS, RATE = 8, 3, 16, 0.4
#: A suffix counts towards its mean label as if so many URLs of the overall mean stood beside it.
PRIOR = 20.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and the path; both empty without "://"."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a domain above it and starts the path, and its verdict."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: -len(r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _entropy(text: Column) -> Column:
    """Bits a character, over letters, digits and URL punctuation; all others count as one."""
    n, rest, total = F.greatest(F.length(text), F.lit(1)), F.length(text), F.lit(0.0)
    term = lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(F.lit(0.0))
    for c in LOWER + "0123456789./-_=&?:%#":
        count = F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
        total, rest = total + term(count), rest - count
    return total + term(rest)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features; none looks at a whole host name."""
    url = F.coalesce(url, F.lit(""))
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": count(path, "/").cast("double"),
        "labels": count(host, ".").cast("double"),
        "hyphens": count(host, "-").cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(F.lower(F.concat(host, path))),
        "parameters": (F.when(F.contains(url, F.lit("?")), F.lit(1)).otherwise(F.lit(0)) + count(url, "&")).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)).cast("double"),
    }


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


@dataclass
class Model:
    """Trees as nested (feature, cut, left, right) or leaf values; suffix means; the score is a log-odds."""

    base: float
    trees: list
    suffixes: dict[str, tuple[float, float]]
    unseen: tuple[float, float]
    cuts: dict[str, list[float]] = field(default_factory=dict)

    def score(self, columns: dict[str, Column]) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, cut, left, right = node
            return F.when(columns[name] <= F.lit(float(cut)), value(left)).otherwise(value(right))

        total = reduce(lambda a, b: a + b, (value(t) for t in self.trees), F.lit(self.base))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def suffix_columns(self, host: Column) -> dict[str, Column]:
        def pick(i: int) -> Column:
            out = None
            for name, stats in self.suffixes.items():
                fits = suffix(host) == name
                out = F.when(fits, F.lit(stats[i])) if out is None else out.when(fits, F.lit(stats[i]))
            return F.lit(self.unseen[i]) if out is None else out.otherwise(F.lit(self.unseen[i]))

        return {"suffix_mean": pick(0), "suffix_weight": pick(1)}


#: Suffixes with statistics of their own, the most frequent ones; others share one entry.
SUFFIXES = 100


def train(labelled: DataFrame, *, sample: int = SAMPLE, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Model:
    """A model from (url, label 0/1) rows, of which at most ``sample`` are used, those of the smallest hashes.

    Brought to the driver: at most SUFFIXES rows, quantiles of each feature, and for each tree level at
    most 2^depth nodes x features x bins sums.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("label is not null").orderBy(F.xxhash64("url"), "url").limit(sample).select("url", F.col("label").cast("double").alias("label"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < total < n:
        return Model(-30.0, [], {}, (0.0, 0.0))
    mean = total / n
    counts = rows.groupBy(suffix(F.col("host")).alias("s")).agg(F.count("*").alias("n"), F.sum("label").alias("t")).orderBy(F.desc("n"), "s").limit(SUFFIXES).collect()
    stats = {r["s"]: ((r["t"] + PRIOR * mean) / (r["n"] + PRIOR), math.log1p(r["n"])) for r in counts}
    model = Model(math.log(mean / (1 - mean)), [], stats, (mean, 0.0))
    columns = features(F.col("url"), F.col("host"), F.col("path")) | model.suffix_columns(F.col("host"))
    names = list(columns)
    rows = rows.select("label", *(c.alias(k) for k, c in columns.items())).checkpoint()
    levels = [i / bins for i in range(1, bins)]
    cuts = [sorted(set(q)) for q in rows.agg(*(F.percentile_approx(k, levels, 1000).alias(k) for k in names)).first()]
    model.cuts = dict(zip(names, cuts, strict=True))
    binned = F.array(*(sum(((F.col(k) > F.lit(c)).cast("int") for c in cut), F.lit(0)) for k, cut in zip(names, cuts, strict=True)))
    rows = rows.select("label", *names, binned.alias("bins"))
    here = {k: F.col(k) for k in names}
    for _ in range(rounds):
        p = model.score(here)
        graded = rows.select("bins", (F.col("label") - p).alias("g"), (p * (1 - p)).alias("h"), *names)
        model.trees.append(_grow(graded, names, cuts, depth, rate))
    return model


def _grow(rows: DataFrame, names: list[str], cuts: list[list[float]], depth: int, rate: float):
    """One tree, a level at a time: node k has the children 2k and 2k + 1."""
    splits: dict[int, tuple[int, float] | None] = {}
    leaves: dict[int, float] = {}
    node, open_ = F.lit(1), [1]
    for level in range(depth + 1):
        at = rows.select(node.alias("node"), "bins", "g", "h").where(F.col("node").isin(open_))
        sums: dict = {}
        for r in at.select("node", "g", "h", F.posexplode("bins").alias("f", "bin")).groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = r["g"], r["h"]
        following = []
        for k in open_:
            found = sums.get(k)
            if not found:
                leaves[k] = 0.0
                continue
            g, h = (sum(x[i] for x in found[0].values()) for i in (0, 1))
            best = None
            if level < depth:
                for f in sorted(found):
                    gl = hl = 0.0
                    for b in range(len(cuts[f])):
                        dg, dh = found[f].get(b, (0.0, 0.0))
                        gl, hl = gl + dg, hl + dh
                        if hl < 1 or h - hl < 1:
                            continue
                        gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = gain, f, cuts[f][b]
            if best is None:
                leaves[k] = rate * g / (h + 1)
            else:
                splits[k] = best[1], best[2]
                following += [2 * k, 2 * k + 1]
        open_ = following
        if not open_:
            break
        step = None
        for k, s in splits.items():
            if 2 * k in open_:
                to = F.when(F.col(names[s[0]]) <= F.lit(s[1]), F.lit(2 * k)).otherwise(F.lit(2 * k + 1))
                step = F.when(node == k, to) if step is None else step.when(node == k, to)
        node = step.otherwise(F.lit(0))

    def build(k: int):
        if k in splits:
            f, cut = splits[k]
            return names[f], cut, build(2 * k), build(2 * k + 1)
        return leaves.get(k, 0.0)

    return build(1)


def judge(pages: DataFrame, *, key: str = "page_id", url: str = "url", rules=RULES, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per URL: key, host, path, rule, verdict, score."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", verdict)
    if labelled is None:
        labelled = rows.where("said is not null").select("url", (F.col("said") == "block").cast("int").alias("label"))
    model = train(labelled)
    columns = features(F.col("url"), F.col("host"), F.col("path")) | model.suffix_columns(F.col("host"))
    used = set()

    def seen(node):
        if isinstance(node, tuple):
            used.add(node[0])
            seen(node[2])
            seen(node[3])

    for t in model.trees:
        seen(t)
    # a feature is worked out once, in a projection below the trees that ask for it
    rows = rows.select("key", "host", "path", "rule", "said", *(c.alias(f"f_{k}") for k, c in columns.items() if k in used))
    score = model.score({k: F.col(f"f_{k}") for k in used})
    rows = rows.withColumn("score", score)
    return rows.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")

"""Licence scans by a positional index of rare licence words, in DataFrame functions only.

One pass over the texts splits them into words and writes, in the shared folder, a small row for each:
its number of words, the places of the base phrases, the licence words and the key phrases that it
holds, and all its words only where it holds a key phrase.  From that table each licence word gets an
inverse document frequency over the whole corpus, with a floor for words in nearly all documents.

Of each template with a key phrase in the file, the file's rarest words are looked up in the postings
(word -> template, position).  A template matches where at least AGREE of them agree on one relative
position and their weight is a share of at least MIN_SCORE of its own rarest words.  Equal texts are
aligned once, and (text, template, offset) groups are summed before any shuffle.

Defined cases: a null or empty text has no words and no labels; rows that repeat an id are judged by
their own texts; a null id is kept; of words of equal frequency the alphabetically smaller comes
first; very long texts are one row each, like any other; extra columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir

#: What stands between words, which are runs of ASCII digits and letters and of all other characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Places of these phrases are counted and labelled by contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed values: (label, opening words of the licence or its usual notice, mandatory key phrases).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["published by the free software foundation"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc 4 0", "creative commons attribution noncommercial"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose with or without fee"]),
]
RAREST = 8
#: Words that must agree on a position; all of a template with fewer.
AGREE = 3
#: Weight of a word that all documents have.
FLOOR = 0.01
MIN_SCORE = 0.6


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), BETWEEN), "")


def _literals(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _places(words: Column) -> Column:
    """(start, label) of every base phrase."""

    def label(i: Column) -> Column:
        out = None
        for phrase, name in BASE.items():
            same = F.lit(True)
            for k, part in enumerate(phrase.split()):
                same &= F.get(words, i + k).eqNullSafe(F.lit(part))
            out = F.when(same, F.lit(name)) if out is None else out.when(same, F.lit(name))
        return out

    every = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.cast("long").alias("at"), label(i).alias("label")))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(F.array_contains(words, F.lit("license")), F.filter(every, lambda x: x["label"].isNotNull())).otherwise(none)


def _keyed(words: Column, templates) -> Column:
    """The numbers of the templates of which a key phrase stands among the words."""
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    found = [F.when(F.greatest(*(F.contains(joined, F.lit(f" {p} ")) for p in phrases), F.lit(False)), F.lit(k)) for k, (_, _, phrases) in enumerate(templates)]
    # a word of each phrase is looked for before the phrases: the longest, as the frequencies aren't known yet
    marks = sorted({max(p.split(), key=lambda w: (len(w), w)) for _, _, phrases in templates for p in phrases})
    none = F.array().cast("array<int>")
    return F.when(F.arrays_overlap(words, _literals(marks)), F.array_compact(F.array(*found)) if found else none).otherwise(none)


def _digested(docs: DataFrame, key: str, text: str, templates, vocabulary: list[str]) -> DataFrame:
    """The one pass over the texts: (key, same, n_words, places, present, keyed, w), written in the shared folder."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    rows = rows.select("key", F.unhex(F.md5("body")).alias("same"), _words(F.col("body")).alias("w"))
    rows = rows.select("*", _keyed(F.col("w"), templates).alias("keyed"))
    rows = rows.select(
        "key", "same", F.size("w").cast("long").alias("n_words"), _places(F.col("w")).alias("places"),
        F.array_intersect("w", _literals(vocabulary)).alias("present"), "keyed", F.when(F.size("keyed") > 0, F.col("w")).alias("w"),
    )
    path = shared_dir(docs.sparkSession, "licences")
    rows.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def idf(present: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of the licence words over all documents; one bounded row per word."""
    rows = present.select(F.explode(F.concat(F.array(F.lit("")), "present")).alias("word")).groupBy("word").count().collect()
    n = {r["word"]: r["count"] for r in rows}
    total = n.pop("", 0)
    return {w: max(FLOOR, math.log((total + 1) / (n.get(w, 0) + 1))) for w in vocabulary}


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates=TEMPLATES, rarest: int = RAREST, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per document: key, n_words, places of the base phrases, labels and the best match's score."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    rows = _digested(docs, key, text, templates, vocabulary)
    base = rows.select("key", "same", "n_words", "places", "keyed")
    none = F.array().cast("array<string>")
    plain = base.where(F.size("keyed") == 0).select("key", "n_words", "places", none.alias("names"), F.lit(0.0).alias("score"))
    if templates:
        found = _aligned(rows.where(F.size("keyed") > 0), templates, idf(rows, vocabulary), rarest, min_score)
        held = base.where(F.size("keyed") > 0).join(found, "same", "left")
        plain = plain.unionByName(held.select("key", "n_words", "places", F.coalesce("names", none).alias("names"), F.coalesce("score", F.lit(0.0)).alias("score")))
    labels = F.array_distinct(F.col("places.label"))
    return plain.select(
        F.col("key").alias(key), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").alias("first_word"), F.array_max("places.at").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, "names")), ",").alias("labels"),
        F.greatest(F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), "score").alias("score"),
    )


def _aligned(held: DataFrame, templates, weight: dict[str, float], rarest: int, min_score: float) -> DataFrame:
    """(same, names, score) of the texts in which a template's rare words agree on a position and a key phrase stands."""
    spark = held.sparkSession
    # as many rows as the templates have words, whatever the corpus; a word's weight is shared by its places in a template
    entries = [F.struct(F.lit(w).alias("word"), F.lit(k).alias("template"), F.lit(i).alias("position"), F.lit(weight[w] / t.split().count(w)).alias("weight")) for k, (_, t, _) in enumerate(templates) for i, w in enumerate(t.split())]
    index = F.broadcast(spark.range(1).select(F.inline(F.array(*entries))))
    ranked = [sorted(set(t.split()), key=lambda w: (-weight[w], w)) for _, t, _ in templates]
    tops = F.array(*(F.slice(F.array_intersect(_literals(of), "present"), 1, rarest) for of in ranked))
    # worked out below the aggregation, so that it isn't again for every word
    held = held.select("same", "w", "keyed", tops.alias("tops"))
    texts = held.groupBy("same").agg(F.first("w").alias("w"), F.first("tops").alias("tops"), F.first("keyed").alias("keyed"))
    places = texts.select("same", "keyed", "tops", F.posexplode("w").alias("at", "word"))
    hits = places.join(index, "word").where(F.array_contains("keyed", F.col("template")) & F.array_contains(F.get("tops", F.col("template")), F.col("word")))
    sums = hits.groupBy("same", "template", (F.col("at") - F.col("position")).alias("offset")).agg(F.sum("weight").alias("sum"), F.count("*").alias("agree"))
    name, full, least = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("int")
    for k, (label, text, _) in enumerate(templates):
        on = F.col("template") == k
        name = F.when(on, F.lit(label)).otherwise(name)
        full = F.when(on, F.lit(float(sum(weight[w] for w in ranked[k][:rarest])))).otherwise(full)
        least = F.when(on, F.lit(min(AGREE, len(text.split())))).otherwise(least)
    scored = sums.where(F.col("agree") >= least).select("same", name.alias("name"), F.least(F.col("sum") / full, F.lit(1.0)).alias("score")).where(F.col("score") >= min_score)
    return scored.groupBy("same").agg(F.collect_set("name").alias("names"), F.max("score").alias("score"))

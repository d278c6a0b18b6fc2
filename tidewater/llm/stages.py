"""The stages of the corpus pipeline and how they are chained.

Each takes (spark, docs, sf_dir) with the columns of ``documents``, and others if there are any, and
returns the same columns, but for the last, which returns the encoded rows.  Where a text changes,
n_chars follows it.  Empty tables give empty tables; ids are whole numbers or null; other columns may be
null and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as op1
from . import neardup, repeats, sentencepiece_codec
from . import toxicity as op5
from .queries import table, tokenizer
from .shared import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 on toxicity.  Null and empty texts have no evidence and stay; repeated rows share their fate; without labels of both kinds all stay."""
    return op5.keep_clean(docs, op5.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id; of repeated rows one.  Empty texts are duplicates of each other, null counts as empty; rows without an id are grouped by their text."""
    return neardup.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 100 bytes that start earlier in the corpus too.  A null text becomes the empty one; repeated rows become equal rows; a document may be left with no text."""
    return repeats.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text.  Null and empty texts stay, null item texts are ignored; repeated rows share their fate."""
    return op1.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the original byte span of every piece, for every row; null and empty texts have none."""
    return sentencepiece_codec.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("sentencepiece", encode),
]


def chain(spark: SparkSession, sf_dir: str, stages) -> DataFrame:
    """Each stage on what its predecessor kept, written as Parquet in between; the last one's rows as they were written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

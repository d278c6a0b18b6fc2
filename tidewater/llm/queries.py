"""The registered queries of this subpackage: thin callers of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, media, neardup, quality, repeats, sentencepiece_codec, toxicity, urls, warc
from .shared import ensure_checkpoints, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; batches to Python stay small even where rows are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")



def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "media")
    media.write_archive(table(spark, sf_dir, "documents"), path)
    return media.measure(media.read_archive(spark, path)).withColumnRenamed("key", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoints(spark)
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path)
    return found.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), model or tokenizer("piece_bpe_32k.model"))


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_quality": op2_quality, "op3_near_duplicates": op3_near_duplicates, "op4_media_archive": op4_media_archive, "op5_toxicity": op5_toxicity, "op6_url_filter": op6_url_filter, "op7_warc_revisits": op7_warc_revisits, "op8_repeats": op8_repeats, "op9_license_scan": op9_license_scan, "op10_sentencepiece": op10_sentencepiece}

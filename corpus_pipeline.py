"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import stages

#: (name, function): each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = stages.STAGES
#: Trained models, sampling hashes and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    return stages.chain(spark, sf_dir, STAGES)

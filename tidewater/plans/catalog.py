"""The registered queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Domain tables by name, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return domain.load(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of the domain tables as a query, and its oracle."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = domain.with_tables(sql)
        return f

    return add


def load_all() -> None:
    from . import files, history, jobs, more, operate, stores  # noqa: F401  each registers its queries


load_all()

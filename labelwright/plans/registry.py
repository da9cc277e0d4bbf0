"""Registered queries: a name, a Spark plan over the given tables, and (where SQL can say it) a SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from labelwright.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables, read lazily, and the views derived from them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in views.TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def label_docs(self) -> DataFrame:
        return views.label_docs(self)

    @cached_property
    def text_docs(self) -> DataFrame:
        return views.text_docs(self)

    def view(self, name: str) -> DataFrame:
        return getattr(views, name)(self)


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(tables)``; ``uses`` names the derived views the SQL twin refers to."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = views.with_views(uses, sql)
        return fn
    return register

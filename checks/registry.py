"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linktide.plans.derived import Made, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Data:
    """Derived views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder, Made(spark, folder)

    def __getattr__(self, name: str) -> DataFrame:
        return self.made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None, views: str = "", recursive: bool = False):
    """Register ``fn(Data)``; ``sql`` may read the named views."""

    def add(fn: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            body = sql.strip()
            head = with_views(*views.split()) if views else ""
            word = "WITH RECURSIVE " if recursive else "WITH "
            if body.lower().startswith("with "):
                body = body[5:]
                ORACLES[name] = word + (f"{head}, " if head else "") + body
            else:
                ORACLES[name] = (f"{word}{head} " if head else "") + body
        return fn

    return add


def r(column: str | Column, digits: int = 9) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    name = column if isinstance(column, str) else None
    out = F.round(c, digits)
    return out.alias(name) if name else out

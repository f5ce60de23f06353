"""Registry of runnable queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import ship_package
from . import bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Plain column types for comparison: wide integers, rounded doubles, dates and times as text."""
    def plain(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


class Tables:
    """The parquet tables of a folder and the views bound to them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in bindings.TABLES:
            return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")
        if name in bindings.VIEWS:
            text = bindings.VIEWS[name]
            return self.spark.sql(text, **{t: getattr(self, t) for t in bindings.sources(text)})
        raise AttributeError(name)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the named views."""
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: present(fn(Tables(spark, folder)))
        if sql is not None:
            ORACLES[name] = bindings.with_views(sql, views)
        return fn

    return add

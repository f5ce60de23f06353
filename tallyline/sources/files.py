"""Reading landed files and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import columns as C
from ..operators.dedupe import first_k_per
from ..operators.mapping import valid_coordinates, within_box


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large inputs: inferring one reads the files twice."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_incidents(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   limit: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Incident rows; ``limit`` is taken on the raw rows, before any filter.

    Without ``order_by`` any ``limit`` rows may come back, as files are read in parallel.
    """
    df = read_csv(spark, path, schema)
    if limit is None:
        return df
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def points(df: DataFrame, limit: int | None = None, order_by: list[str] | None = None, box=None) -> DataFrame:
    """Rows with usable coordinates inside the map box; ``limit`` is taken after the filters."""
    df = C.require_columns(C.normalise_names(df), ["latitude", "longitude"])
    kept = within_box(valid_coordinates(df), *([box] if box else []))
    if limit is None:
        return kept
    return (kept.orderBy(*order_by) if order_by else kept).limit(limit)


def read_points(spark: SparkSession, path: str, schema: T.StructType | str | None = None, limit: int | None = None,
                order_by: list[str] | None = None) -> DataFrame:
    return points(read_csv(spark, path, schema), limit, order_by)


def read_landed(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = False,
                cap: int | None = None, dataset: str = "dataset_name", order_by: list[str] | None = None) -> DataFrame:
    """Landed JSON records with differing keys; a missing key reads as NULL.

    ``multiline`` reads one JSON array per file. ``cap`` keeps that many rows per
    dataset in the given order.
    """
    reader = spark.read.option("multiLine", multiline)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return df if cap is None else first_k_per(df, dataset, cap, order_by or df.columns)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row report of nested sections as one JSON document, missing values included."""
    report.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)


METADATA = ["name", "domain", "link", "id", "description"]


def write_metadata(datasets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    datasets.select(*METADATA).write.mode(mode).option("ignoreNullFields", False).json(path)


def read_metadata(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Catalog metadata; the column list is unknown until a dataset is read."""
    schema = ", ".join(f"{c} string" for c in METADATA)
    return spark.read.schema(schema).option("multiLine", multiline).json(path).select(
        "id", "name", "domain", "link", "description", F.array().cast("array<string>").alias("columns"))

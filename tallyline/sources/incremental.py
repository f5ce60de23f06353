"""A monthly cube that grows by landed batches.

Below one folder lie the landed rows (``rows``, by month and batch), the cube (``cube``, by month) and a ledger of the batches done. A batch writes its own
parts of ``rows``, then the months it touches are counted again from all their batches and replaced, then the ledger notes it. Every step
overwrites the same parts with the same content, so a batch that broke off can be repeated; one in the ledger does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates as D
from ..operators.series import monthly_cube

MONTH = "month"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows) of the batches done."""
    path = f"{folder}/ledger"
    return spark.read.schema("batch string, rows long").parquet(path) if _exists(spark, path) else spark.createDataFrame([], "batch string, rows long")


def cube(spark: SparkSession, folder: str) -> DataFrame:
    """The cube as ``monthly_cube`` of all batches gives it."""
    return spark.read.parquet(f"{folder}/cube").drop(MONTH)


def land(batch: DataFrame, name: str, folder: str, date: str = "combined_date") -> bool:
    """Add a batch of incidents under a name; false if the ledger already has it. Rows without a date form a month of their own.

    Reads and writes only the months that the batch touches.
    """
    spark = batch.sparkSession
    if not ledger(spark, folder).filter(F.col("batch") == name).isEmpty():
        return False
    month = F.coalesce(F.date_format(D.month_start(F.col(date)), "yyyy-MM"), F.lit("none"))
    rows = batch.withColumn("batch", F.lit(name)).withColumn(MONTH, month)

    def replace(df: DataFrame, part: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{folder}/{part}")

    replace(rows, "rows", MONTH, "batch")
    schema = rows.schema
    landed = spark.read.schema(schema).parquet(f"{folder}/rows")
    own = landed.filter(F.col("batch") == name)
    months = [r[0] for r in own.select(MONTH).distinct().collect()]      # the calendar months of a batch
    touched = landed.filter(F.col(MONTH).isin(months))
    counted = monthly_cube(touched.drop("batch"))
    counted = counted.withColumn(MONTH, F.coalesce(F.date_format("month_year", "yyyy-MM"), F.lit("none")))
    replace(counted, "cube", MONTH)
    spark.createDataFrame([(name, own.count())], "batch string, rows long").coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
    return True

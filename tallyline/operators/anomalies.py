"""Outlier days on the daily counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import one_row
from .distribution import percent


def z_outliers(daily: DataFrame, threshold: float = 3.0, date: str = "combined_date") -> DataFrame:
    """Days more than ``threshold`` population standard deviations from the mean."""
    s = one_row(daily.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd")))
    z = F.try_divide(F.col("n") - F.col("s.mean"), F.col("s.sd"))
    return daily.withColumn("s", s).select(date, "n", z.alias("z")).filter(F.abs(F.col("z")) > threshold)


def iqr_outliers(daily: DataFrame, factor: float = 1.5, date: str = "combined_date") -> DataFrame:
    """Days strictly outside the quartiles by ``factor`` interquartile ranges."""
    s = one_row(daily.agg(F.percentile("n", F.array(F.lit(0.25), F.lit(0.75))).alias("q")))
    q1, q3 = F.col("s.q")[0], F.col("s.q")[1]
    return daily.withColumn("s", s).select(date, "n", (q1 - factor * (q3 - q1)).alias("lower"), (q3 + factor * (q3 - q1)).alias("upper")) \
        .filter((F.col("n") < F.col("lower")) | (F.col("n") > F.col("upper")))


def outlier_summary(outliers: DataFrame, daily: DataFrame, first: int = 10, date: str = "combined_date") -> DataFrame:
    """Count, share of days and the first dates in date order."""
    days = one_row(daily.agg(F.count(F.lit(1)).alias("d")))["d"]
    dates = outliers.orderBy(date).limit(first).agg(
        F.array_join(F.array_sort(F.collect_list(F.date_format(date, "yyyy-MM-dd"))), ",").alias("s")).scalar()
    return outliers.agg(F.count(F.lit(1)).alias("count")).select(
        "count", percent(F.col("count"), days).alias("percentage"), dates.alias("dates"))


def extremes(daily: DataFrame, date: str = "combined_date") -> DataFrame:
    """Mean, sample standard deviation, busiest and quietest day (the earliest on ties)."""
    def day_at(sign: int) -> Column:
        return F.min_by(date, F.struct((F.col("n") * sign).alias("a"), F.col(date).alias("b")))

    return daily.agg(
        F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"),
        F.max("n").alias("max"), day_at(-1).alias("max_date"),
        F.min("n").alias("min"), day_at(1).alias("min_date"))

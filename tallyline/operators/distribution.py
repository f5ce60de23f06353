"""Descriptive, temporal and quality statistics on counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import dates as D
from ..functions.joins import one_row
from .incidents import EARLIEST_DAY, monthly_counts, tally, total_of, weight_if


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return ratio(a * F.lit(100.0), b)


def describe_counts(counts: DataFrame, n: str = "n") -> DataFrame:
    """Mean, quartiles, spread and population moments of a table of counts."""
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = counts.agg(
        F.avg(n).alias("mean"), q.alias("_q"), F.stddev_samp(n).alias("std"),
        F.min(n).alias("min"), F.max(n).alias("max"),
        F.skewness(n).alias("skewness"), F.kurtosis(n).alias("kurtosis"))
    return out.select(
        "mean", F.col("_q")[1].alias("median"), "std", "min", "max",
        F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"),
        (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
        F.when(F.col("mean") > 0, ratio(F.col("std"), F.col("mean"))).otherwise(0.0).alias("cv"),
        "skewness", "kurtosis")


def overview(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Totals, day span and number of distinct cities, types and locations."""
    return df.agg(
        total_of(weight).alias("total_records"),
        F.datediff(F.max("combined_date"), F.min("combined_date")).alias("date_range_days"),
        F.count_distinct("city").alias("unique_cities"),
        F.count_distinct("crime_type").alias("unique_crime_types"),
        F.count_distinct("location_type").alias("unique_location_types"))


def date_quality(df: DataFrame, as_of: str, date: str = "combined_date", earliest: str = EARLIEST_DAY,
                 weight: str | None = None, samples: int = 5) -> DataFrame:
    """Span in years, rows after ``as_of`` and before ``earliest``, with the first dates of each kind.

    Call it on parsed dates before they are filtered, else both counts are 0.
    """
    day, low, high = F.col(date), F.lit(earliest).cast("date"), F.lit(as_of).cast("date")
    daily = tally(df.filter(day.isNotNull()), [date], weight)

    def sample(condition: Column) -> Column:
        first = daily.filter(condition).orderBy(date).limit(samples)
        return first.agg(F.array_join(F.array_sort(F.collect_list(F.date_format(date, "yyyy-MM-dd"))), ",")
                         .alias("s")).scalar()

    return daily.agg(
        (F.datediff(F.max(date), F.min(date)) / F.lit(365.25)).alias("span_years"),
        weight_if(day > high, "n").alias("future_count"),
        weight_if(day < low, "n").alias("very_old_count"),
    ).select("*", sample(day > high).alias("future_sample"), sample(day < low).alias("very_old_sample"))


def hour_profile(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Clock coverage, first and busiest hour and the midnight share.

    ``first_hour`` is the smallest hour present (often
    reported as the peak by mistake); ``peak_hour`` is the busiest one.
    """
    hours = tally(df, ["hour"], weight)
    timed, n, h = F.col("hour").isNotNull(), F.col("n"), F.col("hour")
    agg = hours.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        weight_if(timed, "n").alias("records_with_time"),
        F.min(h).alias("first_hour"),
        F.min_by(n, h).alias("first_hour_count"),
        F.min_by(F.when(timed, h), F.when(timed, F.struct((-n).alias("a"), h.alias("b")))).alias("peak_hour"),
        F.max(F.when(timed, n)).alias("peak_hour_count"),
        F.avg(F.when(timed, n)).alias("mean"),
        weight_if(h == 0, "n").alias("midnight"))
    return agg.select(
        percent(F.col("total") - F.col("records_with_time"), F.col("total")).alias("missing_time_percentage"),
        "records_with_time",
        percent(F.col("records_with_time"), F.col("total")).alias("time_coverage_percentage"),
        "first_hour", "first_hour_count", ratio(F.col("first_hour_count"), F.col("mean")).alias("first_hour_ratio"),
        "peak_hour", "peak_hour_count", ratio(F.col("peak_hour_count"), F.col("mean")).alias("peak_hour_ratio"),
        F.coalesce(percent(F.col("midnight"), F.col("records_with_time")), F.lit(0.0)).alias("midnight_percentage"),
        F.coalesce(F.col("midnight") > F.col("mean") * 2, F.lit(False)).alias("midnight_spike"))


def volume_quality(daily: DataFrame, low: int = 10) -> DataFrame:
    """Quiet, extreme and empty days. Feed a dense calendar to count days without rows as empty."""
    limit = one_row(daily.agg(F.percentile("n", F.lit(0.99)).alias("p99")))
    return daily.agg(
        F.count_if(F.col("n") < low).alias("days_very_low"),
        F.count_if(F.col("n") > limit["p99"]).alias("days_very_high"),
        F.count_if(F.col("n") == 0).alias("zero_days"),
        F.max("n").alias("max_in_day"), F.min("n").alias("min_in_day"))


def coordinate_quality(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Missing and (0, 0) coordinates and the ranges of rows that have both."""
    y, x = F.col(lat), F.col(lon)
    both = y.isNotNull() & x.isNotNull()
    return df.agg(
        F.count_if(~both).alias("missing_count"),
        percent(F.count_if(~both), F.count(F.lit(1))).alias("missing_percentage"),
        F.count_if((y == 0) & (x == 0)).alias("zero_count"),
        F.min(F.when(both, y)).alias("lat_min"), F.max(F.when(both, y)).alias("lat_max"),
        F.min(F.when(both, x)).alias("lon_min"), F.max(F.when(both, x)).alias("lon_max"))


def most_common(df: DataFrame, dim: str, weight: str | None = None) -> DataFrame:
    """The most frequent value with count and share; the first by name on ties."""
    return tally(df, [dim], weight).agg(
        F.min_by(dim, F.struct((-F.col("n")).alias("a"), F.col(dim).alias("b"))).alias("value"),
        F.max("n").alias("count"),
        percent(F.max("n"), F.sum("n")).alias("percentage"))


def autocorrelation(daily: DataFrame, lags: tuple[int, ...] = (1, 7), date: str = "combined_date") -> DataFrame:
    """Pearson correlation of the daily counts with themselves ``k`` present days earlier.

    The window runs over one row per calendar day, which a date column bounds.
    """
    order = W.orderBy(date)
    shifted = daily.select("n", *[F.lag("n", k).over(order).alias(f"p{k}") for k in lags])

    def corr(k: int) -> Column:
        pair = F.col(f"p{k}").isNotNull()
        x, y = F.when(pair, F.col("n").cast("double")), F.col(f"p{k}").cast("double")
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"autocorr_lag{k}")

    return shifted.agg(*[corr(k) for k in lags])


def monthly_growth(monthly: DataFrame, month: str = "month_year") -> DataFrame:
    """Growth over the previous month present; NULL for the first."""
    before = F.lag("n").over(W.orderBy(month))
    return monthly.select(month, "n", (ratio(F.col("n"), before) - 1).alias("growth"))


def growth_summary(monthly: DataFrame) -> DataFrame:
    g = monthly_growth(monthly).filter("growth is not null")
    q = F.percentile("growth", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return g.agg(
        F.count("growth").alias("count"), F.avg("growth").alias("mean"), F.stddev_samp("growth").alias("std"),
        F.min("growth").alias("min"), q.alias("_q"), F.max("growth").alias("max"),
    ).select("count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"),
             F.col("_q")[2].alias("p75"), "max")


def monthly_cv(monthly: DataFrame) -> DataFrame:
    return monthly.agg(F.when(F.avg("n") > 0, ratio(F.stddev_samp("n"), F.avg("n"))).otherwise(0.0).alias("monthly_cv"))


def weekday_peak(df: DataFrame, weight: str | None = None, date: str = "combined_date") -> DataFrame:
    """The busiest weekday and its count relative to the mean weekday present."""
    days = tally(df.withColumn("day_of_week", D.weekday_name(F.col(date))), ["day_of_week"], weight)
    best = F.struct((-F.col("n")).alias("a"), F.col("day_of_week").alias("b"))
    return days.agg(F.min_by("day_of_week", best).alias("peak_day_of_week"),
                    ratio(F.max("n"), F.avg("n")).alias("peak_dow_ratio"))


def temporal(df: DataFrame, weight: str | None = None) -> tuple[DataFrame, ...]:
    """The one-row parts of the temporal section."""
    daily = tally(df, ["combined_date"], weight)
    monthly = monthly_counts(df, weight=weight)
    return autocorrelation(daily), growth_summary(monthly), monthly_cv(monthly), weekday_peak(df, weight), \
        hour_profile(df, weight)

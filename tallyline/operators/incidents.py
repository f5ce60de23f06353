"""Preparation of incident tables and the count cube every statistic is derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C, dates as D, text as X

EARLIEST_DAY = "1990-01-01"
CUBE_KEYS = ["combined_date", "hour", "crime_type", "location_type", "city"]


def tally(df: DataFrame, by: list[str], weight: str | None = None, name: str = "n") -> DataFrame:
    """Row counts per key, or sums of ``weight`` when the input is already counted."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*by).agg(n.cast("bigint").alias(name))


def total_of(weight: str | None) -> Column:
    """The number of rows a (possibly counted) input stands for; 0 on empty input."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return F.coalesce(n, F.lit(0)).cast("bigint")


def weight_if(condition: Column, weight: str | None) -> Column:
    w = F.lit(1) if weight is None else F.col(weight)
    return F.coalesce(F.sum(F.when(condition, w)), F.lit(0)).cast("bigint")


def parse_date(df: DataFrame, date: str = "combined_date", formats: list[str] | None = None) -> DataFrame:
    return df.withColumn(date, D.parse_timestamp(C.column(date), formats).cast("date"))


def keep_valid_dates(df: DataFrame, as_of: str, date: str = "combined_date",
                     earliest: str | None = EARLIEST_DAY) -> DataFrame:
    """Drop missing dates and those after ``as_of`` or before ``earliest``.

    With ``earliest=None`` only missing dates are dropped.
    """
    day = F.col(date)
    if earliest is None:
        return df.filter(day.isNotNull())
    return df.filter(day.between(F.lit(earliest).cast("date"), F.lit(as_of).cast("date")))


def date_validity(df: DataFrame, as_of: str, date: str = "combined_date", earliest: str = EARLIEST_DAY) -> DataFrame:
    """How many rows are kept, missing, too late and too early."""
    day, low, high = F.col(date), F.lit(earliest).cast("date"), F.lit(as_of).cast("date")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(day.isNull()).alias("missing"),
        F.count_if(day > high).alias("after_as_of"),
        F.count_if(day < low).alias("before_earliest"),
        F.count_if(day.between(low, high)).alias("kept"),
    ).withColumn("removed", F.col("after_as_of") + F.col("before_earliest"))


def add_date_parts(df: DataFrame, date: str = "combined_date", time: str | None = "combined_time") -> DataFrame:
    """Calendar columns of the day, hour and minute of a strict ``HH:MM:SS`` text."""
    day = F.col(date)
    clock = F.col(time) if time else F.lit(None).cast("string")
    return df.withColumns({
        "year": F.year(day),
        "month": F.month(day),
        "day_of_week": D.weekday_name(day),
        "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day),
        "month_year": D.month_start(day),
        "hour": D.hour_of(clock),
        "minute": D.minute_of(clock),
    })


def add_series_parts(df: DataFrame, date: str = "combined_date", time: str = "combined_time") -> DataFrame:
    return df.withColumns({
        "week": D.week_start(F.col(date)),
        "date_str": F.date_format(date, "yyyy-MM-dd"),
        "time_str": F.coalesce(F.col(time), F.lit("Unknown")),
    })


def add_labels(df: DataFrame, type_words: tuple[str, ...] = ("primary", "crime", "offense")) -> DataFrame:
    """``crime_type``, ``location_type`` and ``city`` with defaults for missing columns and values.

    The type comes from ``primary_type``, else from the first column whose name
    holds 'type' and one of ``type_words``. A null city stays null.
    """
    named = [c for c in df.columns if "type" in c.lower() and any(w in c.lower() for w in type_words)]
    source = "primary_type" if "primary_type" in df.columns else next(iter(named), None)
    unknown = F.lit("Unknown")

    def filled(name: str | None) -> Column:
        return unknown if name is None else F.coalesce(C.column(name).cast("string"), unknown)

    return df.withColumns({
        "crime_type": filled(source),
        "location_type": filled("location_description" if "location_description" in df.columns else None),
        "city": X.title_case(F.col("source_city")) if "source_city" in df.columns else unknown,
    })


def prepare(df: DataFrame, as_of: str, earliest: str | None = EARLIEST_DAY) -> DataFrame:
    """Parsed and checked dates, calendar columns and labels in one projection."""
    return add_labels(add_date_parts(keep_valid_dates(parse_date(df), as_of, earliest=earliest)))


def cube(df: DataFrame, keys: list[str] = CUBE_KEYS, weight: str | None = None) -> DataFrame:
    """Counts over date, hour, type, location and city.

    One pass over the rows; the hash aggregate combines before the shuffle, so
    a value held by a third of all rows costs one row per task.
    """
    return tally(df, keys, weight)


def daily_counts(df: DataFrame, date: str = "combined_date", weight: str | None = None) -> DataFrame:
    return tally(df, [date], weight)


def monthly_counts(df: DataFrame, date: str = "combined_date", weight: str | None = None) -> DataFrame:
    return tally(df.withColumn("month_year", D.month_start(F.col(date))), ["month_year"], weight)


def dense_daily_counts(daily: DataFrame, date: str = "combined_date") -> DataFrame:
    """Every calendar day between the first and the last, absent days as 0."""
    span = daily.agg(F.min(date).alias("lo"), F.max(date).alias("hi")).filter(F.col("lo").isNotNull())
    calendar = span.select(F.explode(F.sequence("lo", "hi")).alias(date))
    return calendar.join(daily, date, "left").select(date, F.coalesce("n", F.lit(0)).alias("n"))

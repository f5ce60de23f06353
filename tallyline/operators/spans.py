"""Intervals of days: who is there at a moment, and how many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import column

FAR = "9999-12-31"


def _day(x: Column) -> Column:
    return F.datediff(x, F.lit("1970-01-01").cast("date")).cast("bigint")


def active_at(moments: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every row of ``moments`` with every row of ``intervals`` of equal keys that holds its day: the columns of ``moments`` and ``interval`` (struct).

    Both ends count; a null end is open. An interval is filed on the level of its length (a power of two of days), where it lies in two buckets at
    most, so long and open intervals are few rows on a coarse level. A moment is looked up in one bucket of each level that occurs, so a pair
    meets once, by equality. Null keys, moments and starts match nothing, nor do reversed intervals.
    """
    first, last = _day(F.col(f"`{start}`")), _day(F.coalesce(F.col(f"`{end}`"), F.lit(FAR).cast("date")))
    filed = intervals.select(*[column(k) for k in keys], F.struct(*[column(c) for c in intervals.columns]).alias("interval"), first.alias("_a"), last.alias("_b")).filter("_a <= _b")
    filed = filed.withColumn("_level", F.ceil(F.log2(F.col("_b") - F.col("_a") + 1)).cast("int"))
    levels = [r[0] for r in filed.select("_level").distinct().orderBy("_level").collect()]      # 23 at most
    filed = filed.withColumn("_bucket", F.explode(F.expr("sequence(shiftright(_a, _level), shiftright(_b, _level))")))
    asked = moments.select(F.struct(*[column(c) for c in moments.columns]).alias("_row"), *[column(k) for k in keys], _day(F.col(f"`{at}`")).alias("_d"))
    asked = asked.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bucket", F.expr("shiftright(_d, _level)"))
    met = asked.join(filed, [*keys, "_level", "_bucket"]).filter("_d between _a and _b")
    return met.select("_row.*", "interval")


def headcount(df: DataFrame, keys: list[str], start: str, end: str, as_of: str | None = None) -> DataFrame:
    """(keys, day, arrivals, departures, headcount): the intervals open on each day on which their number changes.

    A sweep: one event for a start, one for the day after an end, added up by day before anything is ordered, so the running sum
    of a key sees at most one row per calendar day; no interval is expanded. Null ends stay open, reversed intervals and null starts are left out;
    days after ``as_of`` are not reported.
    """
    ok = df.select(*[column(k) for k in keys], F.col(f"`{start}`").cast("date").alias("_a"), F.col(f"`{end}`").cast("date").alias("_b")).filter("_a is not null and (_b is null or _a <= _b)")
    events = ok.select(*[column(k) for k in keys], F.explode(F.array(F.struct(F.col("_a").alias("day"), F.lit(1).alias("n")), F.struct(F.date_add("_b", 1).alias("day"), F.lit(-1).alias("n")))).alias("e"))
    days = events.filter("e.day is not null").groupBy(*keys, "e.day").agg(F.count_if(F.col("e.n") > 0).alias("arrivals"), F.count_if(F.col("e.n") < 0).alias("departures"))
    upto = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    out = days.withColumn("headcount", F.sum(F.col("arrivals") - F.col("departures")).over(upto))
    return out if as_of is None else out.filter(F.col("day") <= F.lit(as_of).cast("date"))


def daily_headcount(counts: DataFrame, keys: list[str], until: str) -> DataFrame:
    """(keys, day, headcount) of every day from a key's first change up to ``until``, from the rows of ``headcount``."""
    line = W.partitionBy(*keys).orderBy("day")
    last = F.coalesce(F.date_sub(F.lead("day").over(line), 1), F.lit(until).cast("date"))
    runs = counts.filter(F.col("day") <= F.lit(until).cast("date")).withColumn("_last", F.least(last, F.lit(until).cast("date")))
    return runs.select(*[column(k) for k in keys], F.explode(F.sequence("day", "_last")).alias("day"), "headcount")

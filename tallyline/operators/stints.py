"""Employment stints: coalescing and expansion to months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.joins import repeat_rows

KEYS = ["company", "person_id"]


def single_hire_date(df: DataFrame, keys: list[str] = KEYS, hire: str = "date_of_hire") -> DataFrame:
    """Keep the rows of persons with exactly one hire date; a missing date counts as a date of its own."""
    kept = df.groupBy(*keys).agg(
        F.min(hire).alias("lo"), F.max(hire).alias("hi"), F.count(hire).alias("known"), F.count(F.lit(1)).alias("rows"))
    one = F.when(F.col("known") == 0, F.lit(True)).otherwise(
        (F.col("known") == F.col("rows")) & (F.col("lo") == F.col("hi")))
    return df.join(kept.filter(one).select(*keys), keys, "left_semi")


def stints(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Start is the rehire date if present, else the hire date; no end means ongoing.

    Rows without any start cannot be placed and are left out
    (``missing_starts`` counts them).
    """
    start = F.coalesce("date_of_rehire", "date_of_hire")
    return df.filter(start.isNotNull()).select(*keys, start.alias("stint_start"), F.col("term_date").alias("stint_end"))


def missing_starts(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.coalesce("date_of_rehire", "date_of_hire").isNull()).alias("missing_starts"))


def combine_days(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One closed and one ongoing row per person and start day, with row count and hire dates seen.

    This is the only step that meets every row; it combines before the shuffle,
    so later steps hold at most two rows per calendar day of a person.
    """
    start = F.coalesce("date_of_rehire", "date_of_hire")
    return df.groupBy(*keys, start.alias("stint_start"), F.col("term_date").isNull().alias("ongoing")).agg(
        F.max("term_date").alias("stint_end"), F.count(F.lit(1)).alias("copies"),
        F.min("date_of_hire").alias("hire_lo"), F.max("date_of_hire").alias("hire_hi"),
        F.count("date_of_hire").alias("hire_known"))


def keep_single_hire(combined: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``single_hire_date`` on combined rows."""
    person = W.partitionBy(*keys)
    rows, known = F.sum("copies").over(person), F.sum("hire_known").over(person)
    same = F.min("hire_lo").over(person) == F.max("hire_hi").over(person)
    return combined.withColumn("_one", (known == 0) | ((known == rows) & same)).filter("_one").drop("_one")


def merge_days(combined: DataFrame, as_of: str, days: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """Merge stints that overlap or start at most ``days`` after the end so far.

    An ongoing stint ends at ``as_of`` for the comparison and keeps the merged
    stint ongoing. Stints with the same start are taken closed ones first. A
    start later than ``as_of + days`` can never reach an ongoing stint; every
    ongoing row therefore closes a segment for such late starts, and the running
    maximum of the ends is taken within the segment.
    """
    cutoff = F.lit(as_of).cast("date")
    combined = combined.filter("stint_start is not null").withColumn(
        "late", F.col("stint_start") > F.date_add(cutoff, max(days, 0)))
    order = ["stint_start", "ongoing"]
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    closed = F.coalesce(F.sum(F.col("ongoing").cast("int")).over(before), F.lit(0))
    placed = combined.withColumn("seg", F.when(F.col("late"), closed).otherwise(0))
    line = W.partitionBy(*keys, "seg").orderBy(*order)
    reach = F.max(F.coalesce("stint_end", cutoff)).over(line.rowsBetween(W.unboundedPreceding, -1))
    opens = reach.isNull() | ((F.col("stint_start") > reach) & (F.datediff("stint_start", reach) > days))
    islands = placed.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(line))
    # a late ongoing row ends its island; its further copies each stand alone
    alone = F.col("late") & F.col("ongoing")
    merged = islands.groupBy(*keys, "seg", "island").agg(
        F.min("stint_start").alias("first"),
        F.when(F.max(F.col("ongoing").cast("int")) == 0, F.max("stint_end")).alias("last"),
        F.max(F.when(alone, F.col("stint_start"))).alias("alone"),
        (1 + F.coalesce(F.max(F.when(alone, F.col("copies") - 1)), F.lit(0))).alias("n"))
    return repeat_rows(merged, "n", "i").select(
        *keys, F.when(F.col("i") == 1, F.col("first")).otherwise(F.col("alone")).alias("stint_start"),
        F.when(F.col("i") == 1, F.col("last")).alias("stint_end"))


def coalesce_stints(df: DataFrame, as_of: str, days: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """Coalesce rows of (keys, stint_start, stint_end)."""
    rows = df.select(*keys, F.col("stint_start").alias("date_of_hire"), F.lit(None).cast("date").alias("date_of_rehire"),
                     F.col("stint_end").alias("term_date"))
    return merge_days(combine_days(rows, keys), as_of, days, keys)


def expand_months(df: DataFrame, as_of: str, keys: list[str] = KEYS) -> DataFrame:
    """One row per stint and month up to ``as_of``; the month of a known end by then has ``churn_flag`` 1."""
    cutoff = F.lit(as_of).cast("date")
    last = F.trunc(F.least(F.coalesce("stint_end", cutoff), cutoff), "MM")
    first = F.trunc("stint_start", "MM")
    ended = F.col("stint_end").isNotNull() & (F.col("stint_end") <= cutoff)
    months = df.withColumns({"_first": first, "_last": last, "_ended": ended}).filter("_first <= _last").select(
        *keys, "_last", "_ended", F.explode(F.sequence("_first", "_last", F.expr("interval 1 month"))).alias("_m"))
    return months.select(
        *keys, F.year("_m").alias("year"), F.month("_m").alias("month"),
        (F.col("_ended") & (F.col("_m") == F.col("_last"))).cast("int").alias("churn_flag"))


def from_start(df: DataFrame, start: str) -> DataFrame:
    """Months whose first day is on or after ``start``; applied after merging and expansion."""
    return df.filter(F.make_date("year", "month", F.lit(1)) >= F.lit(start).cast("date"))


def employment_stints(df: DataFrame, as_of: str, days: int = 1, keys: list[str] = KEYS,
                      ordered: bool = False) -> DataFrame:
    out = merge_days(keep_single_hire(combine_days(df, keys), keys), as_of, days, keys)
    return out.orderBy(*keys, "stint_start") if ordered else out


def employment_months(df: DataFrame, as_of: str, days: int = 1, start: str | None = None, keys: list[str] = KEYS,
                      ordered: bool = False) -> DataFrame:
    out = expand_months(employment_stints(df, as_of, days, keys), as_of, keys)
    out = out if start is None else from_start(out, start)
    return out.orderBy(*keys, "year", "month") if ordered else out

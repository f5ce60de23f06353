"""Monthly series and weekday-by-hour matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates as D
from ..functions.rules import WEEKDAYS
from ..session import cut_lineage
from .incidents import tally, total_of

HOURS = 24


def monthly_cube(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Counts per month, type, city and location."""
    return tally(df.withColumn("month_year", D.month_start(F.col("combined_date"))),
                 ["month_year", "crime_type", "city", "location_type"], weight)


def pair_series(monthly: DataFrame) -> DataFrame:
    """One monthly series per (type, city), re-aggregated from the cube."""
    return tally(monthly, ["crime_type", "city", "month_year"], "n")


def select_series(series: DataFrame, dim: str, value: str | None) -> DataFrame:
    """The series of one type or city; ``None`` keeps every (type, city) series apart."""
    return series if value is None else series.filter(F.col(dim) == value)


def _cell_counts(weight: str) -> list:
    cell = F.struct(F.col("cell"), F.col(weight).alias("n"))
    return [F.collect_list(F.when(F.col("cell").isNotNull(), cell)).alias("cells")]


def _with_cell(df: DataFrame, date: str) -> DataFrame:
    """Cell number weekday * 24 + hour with Monday as 0; null without a clock time."""
    return df.withColumn("cell", F.weekday(F.col(date)) * HOURS + F.col("hour"))


def _fill(slices: DataFrame, keys: list[str]) -> DataFrame:
    """All 168 cells of every slice, absent ones as 0."""
    known = F.map_from_entries("cells")
    full = F.transform(F.sequence(F.lit(0), F.lit(7 * HOURS - 1)), lambda c: F.coalesce(F.try_element_at(known, c), F.lit(0)))
    names = F.array(*[F.lit(d[:3]) for d in WEEKDAYS])
    out = slices.select(*keys, F.posexplode(full).alias("cell", "n"))
    return out.select(*keys, names[F.floor(F.col("cell") / HOURS).cast("int")].alias("day"),
                      (F.col("cell") % HOURS).alias("hour"), F.col("n").cast("bigint").alias("n"))


def weekday_hour_matrix(df: DataFrame, weight: str | None = None, date: str = "combined_date") -> DataFrame:
    """7 x 24 zero-filled counts, all zeros when no row has a time."""
    cells = tally(_with_cell(df, date), ["cell"], weight)
    return _fill(cells.agg(*_cell_counts("n")), [])


def as_wide(matrix: DataFrame, keys: list[str] = []) -> DataFrame:
    """One row per weekday (and key) with a column per hour."""
    return matrix.groupBy(*keys, "day").pivot("hour", list(range(HOURS))).agg(F.first("n"))


def sliced_matrices(df: DataFrame, dims: list[str] = ["crime_type", "city"], weight: str | None = None,
                    date: str = "combined_date") -> DataFrame:
    """The matrix for all rows and for each value of each dimension, one filter at a time.

    Rows are counted once per combination; the grouping sets expand those
    counts. Each slice then carries at most 168 cells.
    """
    counts = tally(_with_cell(df, date), [*dims, "cell"], weight)
    sets = [[F.col("cell")]] + [[F.col(d), F.col("cell")] for d in dims]
    # the grouping bits are set for dimensions a grouping leaves out
    cells = counts.groupingSets(sets, *dims, "cell").agg(
        F.sum("n").alias("n"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    kind, value = F.lit("all"), F.lit("All")
    for d in dims:
        kind = F.when(F.col(f"g_{d}") == 0, F.lit(d)).otherwise(kind)
        value = F.when(F.col(f"g_{d}") == 0, F.col(d)).otherwise(value)
    slices = cells.select(kind.alias("dim"), value.alias("value"), "cell", "n").groupBy("dim", "value").agg(
        *_cell_counts("n"))
    return _fill(slices, ["dim", "value"])


def top_series(df: DataFrame, dim: str = "crime_type", k: int = 10, weight: str | None = None) -> DataFrame:
    """Monthly series of the k most frequent values of a dimension."""
    monthly = tally(df.withColumn("month_year", D.month_start(F.col("combined_date"))), [dim, "month_year"], weight)
    top = tally(monthly, [dim], "n").orderBy(F.col("n").desc(), F.col(dim).asc_nulls_last()).limit(k).select(dim)
    # k rows by construction
    return monthly.join(F.broadcast(top), dim, "left_semi").select(F.col(dim).alias("value"), "month_year", "n")


def dataset_summary(df: DataFrame, k: int = 10, weight: str | None = None) -> DataFrame:
    """Records and date range, all city counts, top types and top locations as one tagged table."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    base = cut_lineage(df.groupBy("city", "crime_type", "location_type").agg(
        n.alias("n"), F.min("combined_date").alias("lo"), F.max("combined_date").alias("hi")))      # one pass over the rows
    head = base.agg(total_of("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    span = F.concat_ws(" to ", F.date_format("lo", "yyyy-MM-dd"), F.date_format("hi", "yyyy-MM-dd"))

    def part(dim: str, limit: int | None) -> DataFrame:
        counts = tally(base, [dim], "n")
        if limit is not None:
            counts = counts.orderBy(F.col("n").desc(), F.col(dim).asc_nulls_last()).limit(limit)
        return counts.select(F.lit(dim).alias("section"), F.col(dim).alias("value"), "n")

    return (head.select(F.lit("records").alias("section"), span.alias("value"), "n")
            .union(part("city", None)).union(part("crime_type", k)).union(part("location_type", k)))

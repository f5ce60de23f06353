"""Diversity, inequality and concentration of a dimension.

Gini and top shares need the counts in order. They are computed on the
histogram (count value, how many categories have it): its row number is at most
the square root of twice the row total, whatever the number of categories, and
ties need no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.joins import one_row
from .distribution import percent, ratio
from .incidents import tally

ALL = (W.unboundedPreceding, W.unboundedFollowing)


def category_histogram(counts: DataFrame, n: str = "n") -> DataFrame:
    return counts.groupBy(F.col(n).alias("n")).agg(F.count(F.lit(1)).alias("m"))


def diversity(counts: DataFrame, n: str = "n") -> DataFrame:
    """Shannon index from one aggregate: log N - sum(n log n) / N."""
    total, c = F.sum(n), F.col(n).cast("double")
    return counts.agg((F.log(total.cast("double")) - ratio(F.sum(c * F.log(c)), total)).alias("diversity_index"))


def herfindahl(counts: DataFrame, n: str = "n") -> DataFrame:
    c, total = F.col(n).cast("double"), F.sum(n).cast("double")
    return counts.agg(F.try_divide(F.sum(c * c), total * total).alias("herfindahl_index"))


def gini(counts: DataFrame, n: str = "n") -> DataFrame:
    """(k + 1 - 2 * sum of running sums / total) / k over ascending counts."""
    h = category_histogram(counts, n)
    below = F.coalesce(F.sum("m").over(W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = h.select("n", "m", below.alias("below"), F.sum("m").over(W.orderBy("n").rowsBetween(*ALL)).alias("k"))
    # a block of m equal counts after `below` smaller ones: sum over its ranks of (k - rank + 1)
    ranks = F.col("m") * (F.col("k") - F.col("below") + 1) - F.col("m") * (F.col("m") + 1) / 2
    return blocks.agg(
        F.sum(F.col("n").cast("double") * ranks).alias("area"),
        F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("k"),
    ).select(ratio(F.col("k") + 1 - 2 * ratio(F.col("area"), F.col("total")), F.col("k")).alias("gini_coefficient"))


def top_shares(counts: DataFrame, shares: tuple[float, ...] = (0.1, 0.2), n: str = "n") -> DataFrame:
    """Percentage of rows in the top share of categories, at least one category."""
    h = category_histogram(counts, n)
    down = W.orderBy(F.col("n").desc())
    above = down.rowsBetween(W.unboundedPreceding, -1)
    run = h.select(
        "n", "m", F.sum("m").over(down.rowsBetween(*ALL)).alias("k"),
        F.coalesce(F.sum("m").over(above), F.lit(0)).alias("above"),
        F.coalesce(F.sum(F.col("n") * F.col("m")).over(above), F.lit(0)).alias("sum_above"))

    def share(s: float) -> Column:
        rank = F.greatest(F.floor(F.lit(s) * F.col("k")), F.lit(1))
        here = (rank > F.col("above")) & (rank <= F.col("above") + F.col("m"))
        upto = F.col("sum_above") + (rank - F.col("above")) * F.col("n")
        return percent(F.sum(F.when(here, upto)), F.sum(F.col("n") * F.col("m"))).alias(f"top_{round(s * 100)}_pct_share")

    return run.agg(*[share(s) for s in shares])


def top_and_other(df: DataFrame, dim: str, k: int = 10, weight: str | None = None) -> DataFrame:
    """The k most frequent values and, if anything remains, one row for the rest.

    ``is_other`` keeps that row apart from a real value called 'Other'.
    """
    counts = tally(df, [dim], weight)
    top = counts.orderBy(F.col("n").desc(), F.col(dim).asc_nulls_last()).limit(k)
    rest = counts.agg((F.sum("n") - top.agg(F.sum("n").alias("t")).scalar()).alias("n"))
    return top.select(F.col(dim).alias("value"), "n", F.lit(False).alias("is_other")).union(
        rest.filter("n > 0").select(F.lit("Other"), "n", F.lit(True)))


def ranked(df: DataFrame, dim: str, k: int = 10, weight: str | None = None) -> DataFrame:
    """Rank, value, count and percentage of the k most frequent values."""
    counts = tally(df, [dim], weight)
    total = one_row(counts.agg(F.sum("n").alias("t")))["t"]
    order = [F.col("n").desc(), F.col(dim).asc_nulls_last()]
    top = counts.orderBy(*order).limit(k)
    return top.select(F.row_number().over(W.orderBy(*order)).alias("rank"), F.col(dim).alias("value"), "n",
                      percent(F.col("n"), total).alias("percentage"))


def breakdown(df: DataFrame, dim: str, weight: str | None = None) -> DataFrame:
    """Count and percentage of every value."""
    counts = tally(df, [dim], weight)
    total = one_row(counts.agg(F.sum("n").alias("t")))["t"]
    return counts.select(F.col(dim).alias("value"), "n", percent(F.col("n"), total).alias("percentage"))


def further_groups(df: DataFrame, dim: str, k: int = 10, weight: str | None = None) -> DataFrame:
    """The k largest groups and the number of groups beyond them."""
    counts = tally(df, [dim], weight)
    groups = one_row(counts.agg(F.count(F.lit(1)).alias("g")))["g"]
    top = counts.orderBy(F.col("n").desc(), F.col(dim).asc_nulls_last()).limit(k)
    return top.select(F.col(dim).alias("value"), "n", F.greatest(groups - k, F.lit(0)).alias("further_groups"))

"""Association between dimensions, computed from counts in long form."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.joins import one_row
from ..session import cut_lineage
from .distribution import ratio
from .incidents import tally


def chi_square_tail(statistic: float, dof: float) -> float:
    """Upper tail of the chi-square distribution (regularised incomplete gamma)."""
    a, x = dof / 2.0, statistic / 2.0
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - scale * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


@F.pandas_udf(T.DoubleType())
def _tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) or pd.isna(d) else 1.0 if d == 0 else chi_square_tail(s, d)
                      for s, d in zip(statistic, dof)], dtype="float64")


def contingency(df: DataFrame, row: str, col: str, weight: str | None = None) -> DataFrame:
    """Non-zero cells (row, col, n)."""
    return tally(df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()), [row, col], weight)


def chi_square(df: DataFrame, row: str, col: str, weight: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Pearson test of independence with Cramer's V.

    The statistic needs only the non-zero cells: N * (sum n^2 / (r c) - 1). With
    one degree of freedom each deviation is reduced by at most 0.5. A single row
    or column gives statistic 0, p 1 and no V.
    """
    # every figure below derives from the cells, so the rows are read once
    cells = cut_lineage(contingency(df, row, col, weight))
    rows = tally(cells, [row], "n", "r")
    cols = tally(cells, [col], "n", "c")

    def margin(counts: DataFrame, n: str) -> Column:
        c = F.col(n).cast("double")
        return one_row(counts.agg(F.count(F.lit(1)).alias("k"), F.sum(c).alias("total"), F.sum(1 / c).alias("inverse")))

    n, r, c = (F.col(x).cast("double") for x in ("n", "r", "c"))
    sums = cells.withColumn("total", one_row(cells.agg(F.sum("n").cast("double").alias("t")))["t"]).join(rows, row).join(cols, col).agg(
        F.sum(n * n / (r * c)).alias("q"),
        F.max(F.abs(n - r * c / F.col("total"))).alias("dev"))      # the same in all four cells of a 2 x 2 table
    both = sums.withColumns({"a": margin(rows, "r"), "b": margin(cols, "c")}).select(
        "q", "dev", F.col("a.total"), F.col("a.k").alias("ka"), F.col("b.k").alias("kb"),
        (F.col("a.inverse") * F.col("b.inverse")).alias("inverse"))
    dof = (F.col("ka") - 1) * (F.col("kb") - 1)
    shrunk = F.greatest(F.col("dev") - 0.5, F.lit(0.0))
    # the sum over all cells of 1 / E is N * sum(1/r) * sum(1/c)
    yates = shrunk * shrunk * F.col("total") * F.col("inverse")
    stat = F.when(dof == 0, 0.0).when(dof == 1, yates).otherwise(F.greatest(F.col("total") * (F.col("q") - 1), F.lit(0.0)))
    out = both.select(stat.alias("chi_square"), dof.alias("dof"), F.least("ka", "kb").alias("_k"), F.col("total").alias("_n"))
    return out.select(
        "chi_square", "dof", _tail(F.col("chi_square"), F.col("dof").cast("double")).alias("p_value"),
        F.sqrt(F.try_divide(F.col("chi_square"), F.col("_n") * (F.col("_k") - 1))).alias("cramers_v"),
    ).withColumn("significant", F.col("p_value") < alpha)


def hour_type_correlation(df: DataFrame, dim: str = "crime_type", weight: str | None = None,
                          more_than: int | None = None) -> DataFrame:
    """Largest and mean absolute correlation between hour and type indicators.

    phi = (N n11 - h t) / sqrt(h (N - h) t (N - t)). A pair that never occurs has
    |phi| = a_h a_t with a = sqrt(x / (N - x)), so the zero cells are summed in
    closed form and no indicator column or full grid of pairs is built. Pairs
    with a constant indicator have no correlation and are left out. With ``more_than`` the result is null
    unless there are more timed rows than that.
    """
    cells = cut_lineage(tally(df.filter(F.col("hour").isNotNull() & F.col(dim).isNotNull()), ["hour", dim], weight))
    total = one_row(cells.agg(F.sum("n").cast("double").alias("total")))["total"]

    def strength(x: str) -> Column:
        v = F.col(x).cast("double")
        return F.when(v < F.col("total"), F.sqrt(F.try_divide(v, F.col("total") - v)))

    hours = tally(cells, ["hour"], "n", "h").withColumn("total", total).select("hour", "h", strength("h").alias("ah"))
    types = tally(cells, [dim], "n", "t").withColumn("total", total).select(dim, "t", "total", strength("t").alias("at"))
    hour_list = hours.filter("ah is not null").agg(
        F.collect_list(F.struct("ah", "hour")).alias("l")).scalar()   # at most 24 entries
    h, t, N = F.col("h").cast("double"), F.col("t").cast("double"), F.col("total")
    phi = (N * F.col("n") - h * t) / F.sqrt(h * (N - h) * t * (N - t))
    present = cells.join(hours, "hour").join(types, dim).filter("ah is not null and at is not null")
    per_type = present.groupBy(dim).agg(
        F.max(F.abs(phi)).alias("max_seen"), F.sum(F.abs(phi)).alias("sum_seen"), F.max("total").alias("total"),
        F.sum("ah").alias("ah_seen"), F.max("at").alias("at"), F.collect_set("hour").alias("seen"))
    per_type = per_type.withColumn("hours", hour_list)
    absent = F.filter("hours", lambda x: ~F.array_contains(F.col("seen"), x["hour"]))
    top_absent = F.coalesce(F.array_max(F.transform(absent, lambda x: x["ah"])), F.lit(0.0)) * F.col("at")
    all_ah = F.aggregate("hours", F.lit(0.0).cast("double"), lambda s, x: s + x["ah"])
    zero_sum = F.col("at") * (all_ah - F.col("ah_seen"))
    out = per_type.agg(
        F.max(F.greatest(F.col("max_seen"), top_absent)).alias("mx"),
        F.sum(F.col("sum_seen") + zero_sum).alias("sm"),
        F.sum(F.size("hours")).alias("cells"), F.max("total").alias("total"))
    enough = F.lit(True) if more_than is None else F.col("total") > more_than
    return out.select(F.when(enough, F.col("mx")).alias("max_correlation"),
                      F.when(enough, ratio(F.col("sm"), F.col("cells"))).alias("mean_correlation"))

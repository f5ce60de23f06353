"""Which date format the text columns of a source follow, from the shapes of their values.

A value's shape has a 9 for each digit and an A for each run of letters. One pass counts, for each column and shape, the values
and how many of their digit groups pass the limits of months, days, hours and minutes. These counts add up over tasks, batches and sources, and every format
is scored on them without reading a value again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import column

GROUPS = 7
#: Digit groups are counted when they pass one of these, or are zero.
LIMITS = [12, 23, 31, 59]
FIELD = {"M": 12, "d": 31, "H": 23, "h": 12, "m": 59, "s": 59}
COMMON = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss",
          "MM/dd/yyyy hh:mm:ss a", "dd.MM.yyyy", "MM-dd-yyyy", "dd MMM yyyy", "MMM d, yyyy", "yyyyMMdd"]


def value_shapes(df: DataFrame, columns: list[str], longest: int = 40) -> DataFrame:
    """(column, shape, n, over, zero) of the values that are not blank; values longer than ``longest`` have a null shape.

    ``over[i][j]`` counts the values whose i-th digit group is above ``LIMITS[j]``, ``zero[i]`` those where it is zero.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.trim(column(c).cast("string")).alias("v")) for c in columns])
    values = df.select(F.explode(cells).alias("c")).select("c.*").filter("v <> ''")
    short = F.length("v") <= longest
    shape = F.regexp_replace(F.regexp_replace("v", r"\p{Nd}", "9"), r"\p{L}+", "A")
    groups = F.transform(F.regexp_extract_all("v", F.lit(r"(\d+)"), F.lit(1)), lambda g: g.try_cast("bigint"))
    told = values.select("column", F.when(short, shape).alias("shape"), F.when(short, groups).alias("g"))
    over = F.array(*[F.array(*[F.count_if(F.get("g", i) > limit) for limit in LIMITS]) for i in range(GROUPS)])
    zero = F.array(*[F.count_if(F.get("g", i) == 0) for i in range(GROUPS)])
    return told.groupBy("column", "shape").agg(F.count(F.lit(1)).alias("n"), over.alias("over"), zero.alias("zero"))


def add_shapes(*tables: DataFrame) -> DataFrame:
    """The counts of several ``value_shapes`` together, as of one pass over all their rows."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    over = F.array(*[F.array(*[F.sum(F.col("over")[i][j]) for j in range(len(LIMITS))]) for i in range(GROUPS)])
    zero = F.array(*[F.sum(F.col("zero")[i]) for i in range(GROUPS)])
    return every.groupBy("column", "shape").agg(F.sum("n").alias("n"), over.alias("over"), zero.alias("zero"))


def _reading(fmt: str) -> tuple[str, list[tuple[int, str]]]:
    """The pattern of the shapes a format can read, and the digit groups with a limit as (group, field)."""
    pattern, fields, group, digits = "", [], 0, False
    for quoted, run, other in re.findall(r"'([^']*)'|(y+|M+|d+|H+|h+|m+|s+|S+|a+)|(.)", fmt):
        if run and (run[0] != "M" or len(run) < 3) and run[0] != "a":
            group += not digits
            if run[0] in FIELD and not digits:
                fields.append((group - 1, run[0]))
            pattern += "9{1,2}" if len(run) == 1 and run[0] != "y" else "9{%d}" % len(run)
            digits = True
        else:
            digits = False
            pattern += "A" if run or quoted.isalpha() else re.escape(quoted or other)
    adjacent = re.search(r"(y+M+d+|H+m+)", fmt)
    return f"^{pattern}$", [] if adjacent else fields


def score_formats(shapes: DataFrame, formats: list[str] = COMMON) -> DataFrame:
    """(column, format, position, fits, n, share): how many values of each column a format can read.

    Of a shape that a format can read, the values count whose worst field is within its limits. Formats without separators are judged by
    their shape alone.
    """
    def fits(fmt: str) -> Column:
        pattern, fields = _reading(fmt)
        bad = [F.col("over")[g][LIMITS.index(FIELD[f])] + (F.col("zero")[g] if f in "Mdh" else F.lit(0)) for g, f in fields]
        left = F.col("n") - (F.greatest(*bad) if len(bad) > 1 else bad[0] if bad else F.lit(0))
        return F.coalesce(F.sum(F.when(F.col("shape").rlike(pattern), left)), F.lit(0))

    totals = shapes.groupBy("column").agg(F.sum("n").alias("n"), *[fits(f).alias(f"f{k}") for k, f in enumerate(formats)])
    each = F.array(*[F.struct(F.lit(f).alias("format"), F.lit(k).alias("position"), F.col(f"f{k}").alias("fits")) for k, f in enumerate(formats)])
    return totals.select("column", "n", F.explode(each).alias("s")).select("column", "s.format", "s.position", "s.fits", "n", (F.col("s.fits") / F.col("n")).alias("share"))


def best_formats(df: DataFrame, columns: list[str], formats: list[str] = COMMON) -> DataFrame:
    """(column, format, fits, n, share): for each column with values the format that reads most of them, the earlier one among equals; no format where none reads any."""
    scored = score_formats(value_shapes(df, columns), formats)
    best = scored.withColumn("_rn", F.row_number().over(W.partitionBy("column").orderBy(F.col("fits").desc(), "position"))).filter("_rn = 1")
    return best.select("column", F.when(F.col("fits") > 0, F.col("format")).alias("format"), "fits", "n", "share")

"""From several source tables to one checked, filled and deduplicated incident table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import clean, dedupe, impute
from .distribution import percent, ratio


def unify(sources: list[tuple[DataFrame, str]], enhance: bool = True, formats: dict[str, list[str]] | None = None,
          order_by: dict[str, list[str]] | None = None, stable: tuple[str, ...] = (), ordered: bool = False,
          repair_swapped: bool = True) -> DataFrame:
    """Standardise, union, validate, impute and deduplicate; ``ordered`` also sorts all rows by datetime (missing last).

    The quality score is that of the standardised row, before validation.
    ``formats`` and ``order_by`` give date patterns and the row order per source;
    ``stable`` names sources that are plain file scans. Both matter only for
    sources without ids, whose rows are numbered.
    """
    parts = [clean.standardize(df, name, (formats or {}).get(name), (order_by or {}).get(name), stable=name in stable)
             for df, name in sources]
    table = reduce(DataFrame.unionByName, parts)
    if enhance:
        table = clean.validate_ranges(table, repair_swapped)
        table = impute.smart(table)
        table = dedupe.drop_near(table, ["source_name", "incident_id"])
    if not ordered:
        return table
    # the further columns let the range sort split rows of one datetime, or without any
    return table.orderBy(F.col("datetime").asc_nulls_last(), "source_name", "incident_id")


COMPLETENESS = ["latitude", "longitude", "address", "arrest_made"]


def unified_summary(df: DataFrame) -> DataFrame:
    """Total, date range, distinct cities and sources, mean quality and completeness in percent."""
    # combined per city and source first: two distinct counts on all rows would copy every row
    base = df.groupBy("city", "source_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first"), F.max("datetime").alias("last"),
        F.sum("data_quality_score").alias("score"), F.count("data_quality_score").alias("scored"),
        *[F.count(c).alias(c) for c in COMPLETENESS])
    n = F.sum("n")
    return base.agg(
        n.alias("total"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.count_distinct("city").alias("cities"), F.count_distinct("source_name").alias("sources"),
        ratio(F.sum("score"), F.sum("scored")).alias("mean_quality"),
        *[percent(F.sum(c), n).alias(f"{c}_complete") for c in COMPLETENESS])


def category_distribution(df: DataFrame) -> DataFrame:
    from .concentration import breakdown
    return breakdown(df, "crime_category")



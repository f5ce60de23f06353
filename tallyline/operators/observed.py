"""Data-quality figures taken while a table is written: no scan of their own.

The metrics are aggregates that Spark collects from the rows passing through a write; what reaches the driver is one row of some forty numbers.
Figures that need the rows grouped (counts per day, first dates of a kind) are not among them.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from ..functions.columns import column
from .incidents import EARLIEST_DAY

_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
FIGURES = T.StructType([T.StructField(name, kind) for name, kind in [
    ("rows", _LONG), ("span_years", _DOUBLE), ("future_count", _LONG), ("very_old_count", _LONG), ("missing_time_percentage", _DOUBLE), ("records_with_time", _LONG),
    ("first_hour", _INT), ("first_hour_count", _LONG), ("peak_hour", _INT), ("peak_hour_count", _LONG), ("midnight_percentage", _DOUBLE), ("midnight_spike", T.BooleanType()),
    ("missing_count", _LONG), ("missing_percentage", _DOUBLE), ("zero_count", _LONG), ("lat_min", _DOUBLE), ("lat_max", _DOUBLE), ("lon_min", _DOUBLE), ("lon_max", _DOUBLE)]])


def observe_quality(df: DataFrame, as_of: str, date: str = "combined_date", hour: str = "hour", lat: str = "latitude", lon: str = "longitude",
                    earliest: str = EARLIEST_DAY) -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and what ``quality_figures`` reads once the returned table has been written or run to its end."""
    seen = Observation()
    day, h, y, x = (column(c) for c in (date, hour, lat, lon))
    both = y.isNotNull() & x.isNotNull()
    ends = [f(F.when(both, c)).alias(name) for f, c, name in ((F.min, y, "lat_min"), (F.max, y, "lat_max"), (F.min, x, "lon_min"), (F.max, x, "lon_max"))]
    metrics = [F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_if(day > F.lit(as_of).cast("date")).alias("future_count"),
               F.count_if(day < F.lit(earliest).cast("date")).alias("very_old_count"), F.count_if(~both).alias("missing_count"), F.count_if((y == 0) & (x == 0)).alias("zero_count"),
               *ends, *[F.count_if(h == k).alias(f"h{k}") for k in range(24)]]
    return df.observe(seen, *metrics), seen


def quality_figures(df: DataFrame, seen: Observation) -> DataFrame:
    """One row with the figures of ``date_quality``, ``hour_profile`` and ``coordinate_quality`` that need no grouping; ``df`` gives the session."""
    m = seen.get
    hours = {k: m[f"h{k}"] for k in range(24) if m[f"h{k}"]}
    timed, rows = sum(hours.values()), m["rows"]
    first = min(hours, default=None)
    peak = min(hours, key=lambda k: (-hours[k], k), default=None)
    days = [d if d is None or isinstance(d, datetime.date) else datetime.date.fromisoformat(str(d)) for d in (m["first_day"], m["last_day"])]
    midnight = hours.get(0, 0)
    values = {"rows": rows, "span_years": None if days[0] is None else (days[1] - days[0]).days / 365.25, "future_count": m["future_count"], "very_old_count": m["very_old_count"],
              "missing_time_percentage": 100.0 * (rows - timed) / rows if rows else None, "records_with_time": timed, "first_hour": first, "first_hour_count": hours.get(first),
              "peak_hour": peak, "peak_hour_count": hours.get(peak), "midnight_percentage": 100.0 * midnight / timed if timed else 0.0,
              "midnight_spike": bool(hours) and midnight > 2 * timed / len(hours), "missing_count": m["missing_count"],
              "missing_percentage": 100.0 * m["missing_count"] / rows if rows else None, "zero_count": m["zero_count"], **{c: m[c] for c in ("lat_min", "lat_max", "lon_min", "lon_max")}}
    return df.sparkSession.createDataFrame([tuple(values[f.name] for f in FIGURES.fields)], FIGURES)

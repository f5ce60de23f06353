"""Date and time expressions that turn bad input into NULL instead of failing under ANSI."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

NTZ = "timestamp_ntz"


def parse_timestamp(value: Column, formats: list[str] | None = None) -> Column:
    """ISO text, dates and timestamps, else the first of ``formats`` that parses.

    The patterns are read in the session time zone, which must be one without
    clock changes (UTC) for the wall time to survive.
    """
    tries = [value.try_cast(NTZ)]
    tries += [F.try_to_timestamp(value.cast("string"), F.lit(f)).cast(NTZ) for f in formats or []]
    return F.coalesce(*tries) if len(tries) > 1 else tries[0]


def _clock(text: Column) -> tuple[Column, Column, Column, Column]:
    ok = text.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d$")
    part = [F.split(text, ":").getItem(i).try_cast("int") for i in range(3)]
    return ok, part[0], part[1], part[2]


def hour_of(text: Column) -> Column:
    ok, h, _, _ = _clock(text)
    return F.when(ok, h)


def minute_of(text: Column) -> Column:
    ok, _, m, _ = _clock(text)
    return F.when(ok, m)


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def with_clock(day: Column, text: Column) -> Column:
    """The day at the clock time in ``text``; NULL where either is missing or malformed."""
    ok, h, m, s = _clock(text)
    stamp = F.format_string("%s %02d:%02d:%02d", F.date_format(day, "yyyy-MM-dd"), h, m, s)
    return F.when(ok & day.isNotNull(), stamp.try_cast(NTZ))


def is_datelike(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def week_start(day: Column) -> Column:
    return F.trunc(day, "WEEK")


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def earliest(stamps: list[Column]) -> Column:
    """The least non-null value; works for a single column too."""
    return F.least(*stamps) if len(stamps) > 1 else stamps[0]

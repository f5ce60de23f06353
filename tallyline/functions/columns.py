"""Plan-time decisions on column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import rules


def find_column(columns: list[str], name: str) -> str | None:
    """Case-insensitive match; failing that, the first column where one name contains the other."""
    wanted = name.lower()
    exact = [c for c in columns if c.lower() == wanted]
    near = [c for c in columns if wanted in c.lower() or c.lower() in wanted]
    return next(iter(exact + near), None)


def find_first(columns: list[str], candidates: list[str]) -> str | None:
    """The column of the first candidate that resolves at all."""
    return next((hit for hit in (find_column(columns, c) for c in candidates) if hit), None)


def column(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def coordinate_columns(
    columns: list[str],
    lat_keys: list[str] = rules.LATITUDE_KEYS,
    lon_keys: list[str] = rules.LONGITUDE_KEYS,
    location_keys: list[str] = rules.LOCATION_KEYS,
) -> dict[str, str | None]:
    """Latitude, longitude and location columns: key order first, column order second."""

    def first(keys: list[str]) -> str | None:
        return next((c for k in keys for c in columns if k in c.lower()), None)

    lat, lon, loc = first(lat_keys), first(lon_keys), first(location_keys)
    kind = "separate_columns" if lat and lon else "combined_column" if loc else "none"
    return {"lat_col": lat, "long_col": lon, "location_col": loc, "coordinate_type": kind}


def normalise_names(df: DataFrame, trim: bool = True) -> DataFrame:
    """Lower-case (and trim) all names; two names that become one are an error."""
    names = [(c.strip() if trim else c).lower() for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after normalising: {clash}")
    return df.toDF(*names)


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def report_order(columns: list[str]) -> list[str]:
    """Source columns, coordinates, combined date and time, other date columns, the rest by name."""
    low = {c: c.lower() for c in columns}

    def source_rank(c: str) -> tuple:
        marks = ["source_city", "dataset_name", "source_url"]
        return tuple(m not in low[c] for m in marks) + (low[c],)

    source = sorted((c for c in columns if any(m in low[c] for m in ("source_city", "source_url", "dataset_name"))),
                    key=source_rank)
    fixed = [c for c in ("latitude", "longitude", "combined_date", "combined_time") if c in columns]
    lead = source + [c for c in fixed if c not in source]
    dated = sorted((c for c in columns if c not in lead and any(w in low[c] for w in rules.DATE_WORDS)),
                   key=lambda c: ("date" not in low[c], "time" not in low[c], low[c]))
    rest = sorted(c for c in columns if c not in lead and c not in dated)
    return lead + dated + rest


def reorder_columns(df: DataFrame) -> DataFrame:
    return df.select(*[column(c) for c in report_order(df.columns)])

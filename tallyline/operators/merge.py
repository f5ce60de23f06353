"""Bringing landed datasets to one combined table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import columns as C, dates as D, geo as G, rules


def combine_dates(df: DataFrame, formats: list[str] | None = None, numeric_as_epoch: bool = False) -> DataFrame:
    """The earliest of all date columns as ``combined_date`` and ``combined_time``; the originals are dropped.

    A column is a date column when its name holds date or time and at least one of its values can be read. Other
    columns stay as they are, and without any date column the table is unchanged. Exactly midnight gives no time.
    Numbers take part only with ``numeric_as_epoch``, read as nanoseconds since 1970. Which text columns can be
    read is found by one pass over them, which ends at the first readable row if there is but one.
    """
    named = [f for f in df.schema.fields
             if any(w in f.name.lower() for w in rules.DATE_WORDS) and f.name not in ("combined_date", "combined_time")]
    stamps = {f.name: D.parse_timestamp(C.column(f.name), formats) for f in named if D.is_datelike(f.dataType)}
    if numeric_as_epoch:
        stamps |= {f.name: F.timestamp_micros(F.floor(C.column(f.name).cast("double") / 1000).cast("bigint")).cast(D.NTZ)
                   for f in named if isinstance(f.dataType, T.NumericType)}
    readable = readable_columns(df, stamps)
    if not readable:
        return df
    first = D.earliest([stamps[c] for c in readable])
    midnight = first == first.cast("date").cast(D.NTZ)
    return df.withColumns({"combined_date": first.cast("date"),
                           "combined_time": F.when(~midnight, D.clock_text(first))}).drop(*readable)


def readable_columns(df: DataFrame, stamps: dict[str, Column]) -> list[str]:
    """The columns with at least one value that reads as a time."""
    if not stamps:
        return []
    if len(stamps) == 1:
        return [c for c, stamp in stamps.items() if not df.filter(stamp.isNotNull()).isEmpty()]
    seen = df.agg(*[F.coalesce(F.bool_or(stamp.isNotNull()), F.lit(False)) for stamp in stamps.values()]).first()
    return [c for c, yes in zip(stamps, seen, strict=True) if yes]


def _from_object(df: DataFrame, name: str, keys: list[str]) -> Column:
    """A number from a struct, map or JSON text column, by the first key that is present."""
    kind, c = df.schema[name].dataType, C.column(name)
    if isinstance(kind, T.StructType):
        parts = [c[k] for k in keys if k in kind.names]
    elif isinstance(kind, T.MapType):
        parts = [F.try_element_at(c, F.lit(k)) for k in keys]
    else:
        parts = [F.get_json_object(c, f"$.{k}") for k in keys]
    parts = [p.try_cast("double") for p in parts]
    return F.coalesce(*parts) if parts else F.lit(None).cast("double")


def extract_coordinates(df: DataFrame) -> DataFrame | None:
    """``latitude`` and ``longitude`` from two columns or one object column, valid rows only.

    None when the table has no coordinate columns. A malformed object loses its
    own row, not the table.
    """
    found = C.coordinate_columns(df.columns)
    if found["coordinate_type"] == "separate_columns":
        lat, lon = C.column(found["lat_col"]).try_cast("double"), C.column(found["long_col"]).try_cast("double")
    elif found["coordinate_type"] == "combined_column":
        lat = _from_object(df, found["location_col"], ["latitude", "lat"])
        lon = _from_object(df, found["location_col"], ["longitude", "lng", "long"])
    else:
        return None
    return df.withColumns({"latitude": lat, "longitude": lon}).filter(G.usable(F.col("latitude"), F.col("longitude")))


def clean_dataset(df: DataFrame, formats: list[str] | None = None) -> DataFrame | None:
    """Dates combined, names lower-cased, coordinates extracted, columns in report order."""
    out = extract_coordinates(C.normalise_names(combine_dates(df, formats), trim=False))
    return None if out is None else C.reorder_columns(out)


def common_type(kinds: list[T.DataType]) -> T.DataType:
    """The type itself if all agree, a wider number for mixed numbers, else text."""
    if all(k == kinds[0] for k in kinds):
        return kinds[0]
    if all(isinstance(k, T.IntegralType) for k in kinds):
        return T.LongType()
    if all(isinstance(k, T.NumericType) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def union_sources(frames: list[DataFrame], drop_empty: bool = True) -> DataFrame:
    """Union by name over the merged schema; clashing types are widened or become text.

    Empty tables, which would only add columns, are left out (a one-row probe each).
    """
    kept = [f for f in frames if not (drop_empty and f.isEmpty())]
    if not kept:
        raise ValueError("no source has rows")
    kinds: dict[str, list[T.DataType]] = {}
    for f in kept:
        for field in f.schema.fields:
            kinds.setdefault(field.name, []).append(field.dataType)
    target = {n: common_type(k) for n, k in kinds.items()}
    cast = [f.select(*[C.column(n).cast(target[n]).alias(n) for n in f.columns]) for f in kept]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def combine_datasets(frames: list[DataFrame], formats: list[str] | None = None) -> DataFrame:
    """Clean every landed dataset and merge those with coordinates to one table."""
    cleaned = [c for c in (clean_dataset(f, formats) for f in frames) if c is not None]
    return C.reorder_columns(union_sources(cleaned))


def combined_summary(df: DataFrame) -> DataFrame:
    """Records, number of source cities and the column list."""
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source_city").alias("cities")).withColumn(
        "columns", F.lit(", ".join(df.columns)))


def sample_rows(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by a key: a preview, not an input to anything."""
    return df.orderBy(*order_by).limit(n)

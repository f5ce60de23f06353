"""Standardising incident tables of differing schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import columns as C, dates as D, rules, text as X
from ..functions.joins import few_rows_join, lookup_join
from ..session import cut_lineage
from . import similar

INCIDENT_SCHEMA = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("time", T.StringType()),
    T.StructField("datetime", T.TimestampNTZType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day_of_week", T.StringType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    *[T.StructField(c, T.StringType()) for c in (
        "address", "city", "state", "zip_code", "crime_type", "crime_category", "crime_description", "ucr_code")],
    T.StructField("arrest_made", T.BooleanType()),
    T.StructField("domestic", T.BooleanType()),
    *[T.StructField(c, T.StringType()) for c in (
        "beat", "district", "ward", "community_area", "location_type", "source_name", "source_url")],
    T.StructField("data_quality_score", T.DoubleType()),
])


def extract_text(columns: list[str], candidates: list[str]) -> Column:
    """The first resolvable candidate as text, else NULL. Missing values stay NULL."""
    hit = C.find_first(columns, candidates)
    return F.lit(None).cast("string") if hit is None else C.column(hit).cast("string")


def extract_number(columns: list[str], candidates: list[str]) -> Column:
    hit = C.find_first(columns, candidates)
    return F.lit(None).cast("double") if hit is None else F.nullif(C.column(hit).try_cast("double"), F.lit(float("nan")))


def extract_flag(columns: list[str], candidates: list[str]) -> Column:
    """True for true/yes/y/1 in any case, False for everything else and for no column."""
    hit = C.find_first(columns, candidates)
    if hit is None:
        return F.lit(False)
    return F.coalesce(F.lower(C.column(hit).cast("string")).isin(rules.TRUE_WORDS), F.lit(False))


def id_column(columns: list[str], candidates: list[str] = rules.INCIDENT_ID) -> str | None:
    """An id candidate counts only when present as written, upper or lower case."""
    present = set(columns)
    named = [c for c in candidates if {c, c.upper(), c.lower()} & present]
    return C.find_first(columns, named)


def add_position(df: DataFrame, name: str = "position", order_by: list[str] | None = None,
                 stable: bool = False) -> DataFrame:
    """0-based row position without a window over all rows.

    Rows are numbered within their partition and shifted by the sizes of the
    partitions before it (one summary row per partition). With ``order_by`` the
    rows are range-partitioned and sorted first. The numbering reads the rows
    twice, so they are written once to the checkpoint folder, unless ``stable``
    says the input is a plain file scan, which always splits the same way.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    if order_by or not stable:
        tagged = cut_lineage(tagged)
    tagged = tagged.withColumn("_pid", F.shiftright("_mid", 33))
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_pid", before.alias("_start"))
    row = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return few_rows_join(tagged, starts, ["_pid"]).withColumn(name, F.col("_start") + row) \
        .drop("_mid", "_pid", "_start")


def with_incident_id(df: DataFrame, order_by: list[str] | None = None, stable: bool = False,
                     name: str = "incident_id_out", hashed: list[str] | None = None) -> DataFrame:
    """The id of the first usable id column, else ``GEN_`` and the 8-digit row position.

    Positions of a source that is not ``stable`` need it written once. ``hashed`` names columns that tell rows apart: the id is
    then ``GEN_`` and their 64-bit hash in hex, made in the row.
    """
    hit = id_column(df.columns)
    if hit is not None:
        return df.withColumn(name, C.column(hit).cast("string"))
    if hashed:
        return df.withColumn(name, F.concat(F.lit("GEN_"), F.lpad(F.lower(F.hex(F.xxhash64(*[C.column(c) for c in hashed]))), 16, "0")))
    return add_position(df, "_position", order_by, stable).withColumn(
        name, F.format_string("GEN_%08d", "_position")).drop("_position")


def incident_datetime(columns: list[str], formats: list[str] | None = None) -> Column:
    """The date column, joined with a separate clock column where there is one.

    With a clock column a row whose time is missing or malformed has no datetime.
    ``formats`` are tried in order after ISO text.
    """
    day = C.find_first(columns, rules.DATETIME)
    clock = C.find_first(columns, rules.TIME_OF_DAY)
    if day is None:
        return F.lit(None).cast(D.NTZ)
    stamp = D.parse_timestamp(C.column(day), formats)
    if clock is None or clock == day:
        return stamp
    return D.with_clock(stamp, C.column(clock).cast("string"))


def quality_score() -> Column:
    """0 to 100: points for every required and optional field that is present."""
    points = [(c, rules.QUALITY_REQUIRED_POINTS) for c in rules.QUALITY_REQUIRED]
    points += [(c, rules.QUALITY_OPTIONAL_POINTS) for c in rules.QUALITY_OPTIONAL]
    full = sum(p for _, p in points)
    got = sum((F.when(F.col(c).isNotNull(), p).otherwise(0) for c, p in points), F.lit(0))
    return got.cast("double") / full * 100


def standardize(df: DataFrame, source_name: str = "Unknown", formats: list[str] | None = None,
                order_by: list[str] | None = None, stable: bool = False, source_url: str | None = None) -> DataFrame:
    """A source table in the standard incident schema, as one projection."""
    names = df.columns
    rows = with_incident_id(df, order_by, stable, "_incident_id")
    stamp = F.col("_stamp")
    fields: dict[str, Column] = {
        "incident_id": F.col("_incident_id"), "datetime": stamp, "date": stamp.cast("date"),
        "time": D.clock_text(stamp), "year": F.year(stamp), "month": F.month(stamp),
        "day_of_week": D.weekday_name(stamp), "hour": F.hour(stamp),
        "source_name": F.lit(source_name), "source_url": F.lit(source_url).cast("string"),
    }
    fields |= {k: extract_number(names, c) for k, c in rules.NUMERIC_FIELDS.items()}
    for group in (rules.LOCATION_FIELDS, rules.TYPE_FIELDS, rules.DIVISION_FIELDS):
        fields |= {k: extract_text(names, c) for k, c in group.items()}
    fields |= {k: extract_flag(names, c) for k, c in rules.FLAG_FIELDS.items()}
    fields["crime_category"] = X.first_matching_category(fields["crime_type"], rules.INCIDENT_CATEGORIES)
    flat = rows.withColumn("_stamp", incident_datetime(names, formats)).select(
        *[c.alias(k) for k, c in fields.items()])
    return flat.withColumn("data_quality_score", quality_score()).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in INCIDENT_SCHEMA.fields])


def full_address() -> Column:
    """'address, city, state', or the address alone when city or state is missing."""
    return F.when(F.col("city").isNotNull() & F.col("state").isNotNull(), F.concat_ws(", ", "address", "city", "state")).otherwise(F.col("address"))


def fill_from_gazetteer(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates of rows that lack one but have an address, from a table (place, latitude, longitude).

    The place is 'address, city, state', or the address alone when city or state
    is missing. Both coordinates are replaced together, by the least pair of the place that
    has both.
    """
    need = (F.col("latitude").isNull() | F.col("longitude").isNull()) & F.col("address").isNotNull()
    places = gazetteer.filter("latitude is not null and longitude is not null").groupBy("place").agg(F.min(F.struct("latitude", "longitude")).alias("_at"))
    keyed = df.withColumn("place", F.when(need, full_address()))
    found = lookup_join(keyed, places, ["place"])
    return found.withColumns({c: F.when(F.col("_at").isNotNull(), F.col(f"_at.{c}")).otherwise(F.col(c))
                              for c in ("latitude", "longitude")}).select(*df.columns)


def fill_from_similar(df: DataFrame, gazetteer: DataFrame, least: float = 0.6, q: int = 3) -> DataFrame:
    """As ``fill_from_gazetteer``, but a place is found by the likeness of its text (see ``similar.best_matches``), and ``place`` and ``similarity`` are added.

    Both are null where nothing was looked up or nothing is as alike as ``least``. Of equal place texts the least pair of coordinates counts.
    """
    need = (F.col("latitude").isNull() | F.col("longitude").isNull()) & F.col("address").isNotNull()
    known = gazetteer.filter("latitude is not null and longitude is not null")
    keyed = df.withColumn("_plain", F.when(need, similar.plain_text(full_address())))
    places = known.groupBy(similar.plain_text(F.col("place")).alias("b")).agg(F.min("place").alias("_place"), F.min(F.struct("latitude", "longitude")).alias("_at"))
    best = similar.best_matches(keyed.select("_plain"), known, "_plain", "place", least, q).join(places, "b")
    found = lookup_join(keyed, best.select(F.col("a").alias("_plain"), "_place", "_at", F.col("similarity").alias("_similarity")), ["_plain"])
    return found.withColumns({c: F.when(F.col("_at").isNotNull(), F.col(f"_at.{c}")).otherwise(F.col(c)) for c in ("latitude", "longitude")}).select(
        *df.columns, F.col("_place").alias("place"), F.col("_similarity").alias("similarity"))


def validate_ranges(df: DataFrame, repair_swapped: bool = True, lat: str = "latitude",
                    lon: str = "longitude") -> DataFrame:
    """Coordinates out of range become NULL.

    ``repair_swapped`` first exchanges pairs whose latitude is out of range while
    the longitude would be a latitude. With ``False`` such pairs just lose the
    out-of-range value.
    """
    y, x = F.col(lat), F.col(lon)
    if repair_swapped:
        swap = (F.abs(y) > 90) & (F.abs(x) <= 90)
        df = df.withColumns({lat: F.when(swap, x).otherwise(y), lon: F.when(swap, y).otherwise(x)})
    return df.withColumns({lat: F.when(F.abs(y) <= 90, y), lon: F.when(F.abs(x) <= 180, x)})

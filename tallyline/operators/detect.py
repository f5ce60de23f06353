"""Which column of a dataset holds which standard field.

Four ways are tried per field, each only where the earlier ones found nothing:
exact name, contained word, similar name, plausible sample values. A fifth step
maps the time to a date column that carries a clock time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D, rules, text as X
from ..functions.joins import bound, once
from ..session import cut_lineage

CHECKED = ["latitude", "longitude", "date"]     # fields with a value check, in field order
# --- fixed values: how much of a dataset a quick look reads ---
QUICK_LOOK = {"rows": 10, "values": 3, "clock_values": 5}
#: Different lists of column names that are looked up in a broadcast table; where there are more, each row looks at its own.
MOST_LISTS = 10_000


def lowered(names: Column) -> Column:
    return F.transform(names, lambda c: F.lower(c))


def exact_match(names: Column, low: Column, patterns: list[str]) -> Column:
    """The column named like the first pattern that is present; the last such column if it differs in case only.

    ``low`` is ``lowered(names)``, computed once for all fields.
    """
    def named(p: str) -> Column:
        back = F.array_position(F.reverse(low), p)
        return F.when(back > 0, F.try_element_at(names, -back.cast("int")))

    return F.coalesce(*[named(p) for p in patterns])


def contains_match(names: Column, low: Column, words: list[str]) -> Column:
    """The first column that contains any of the words."""
    first = F.array_position(F.transform(low, lambda c: X.any_of([c.contains(w) for w in words])), True)
    return F.when(first > 0, F.try_element_at(names, first.cast("int")))


def similarity(name: Column, pattern: str) -> Column:
    """100 * 2 * (longest common subsequence) / (length sum), rounded half to even, for a text column and a short pattern.

    The subsequence is found bit by bit: one long holds a row of the length table, one step per character of the name
    updates all its columns at once. Patterns have at most 62 characters.
    """
    if len(pattern) > 62:
        raise ValueError("patterns have at most 62 characters")
    if not pattern:
        return F.lit(0)
    places: dict[str, int] = {}
    for i, x in enumerate(pattern):
        places[x] = places.get(x, 0) | 1 << i
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("bigint") for pair in places.items() for x in pair])

    def step(v: Column, x: Column) -> Column:
        u = v.bitwiseAND(F.coalesce(F.try_element_at(table, x), F.lit(0).cast("bigint")))
        return (v + u).bitwiseOR(v - u)

    last = F.aggregate(F.split(name, ""), F.lit(-1).cast("bigint"), step)
    common = len(pattern) - F.bit_count(last.bitwiseAND(F.lit((1 << len(pattern)) - 1)))
    return F.when(F.length(name) > 0, F.rint(200 * common / (F.length(name) + len(pattern))).cast("int")).otherwise(0)


def fuzzy_match(names: Column, low: Column, field: str) -> Column:
    """The most similar column for a field above its threshold, the first on ties, as (column, score); null if there is none."""
    patterns, _, threshold = rules.FIELD_PATTERNS[field]
    scored = F.transform(low, lambda c, i: F.struct(
        F.greatest(*[similarity(c, p) for p in patterns], F.lit(0)).alias("score"), (-i).alias("place")))

    def hit(best: Column) -> Column:
        return F.when(best["score"] > threshold, F.struct(F.try_element_at(names, 1 - best["place"]).alias("column"), best["score"].alias("score")))

    return bound(F.array_max(scored), hit)


def fuzzy_matches(df: DataFrame, key: str = "dataset_id") -> DataFrame:
    """(key, field, column, score) of every row: the most similar column per field above its threshold.

    Evaluated inside the row, so repeated and null keys stay rows of their own.
    """
    low = df.select(key, "columns", lowered(F.col("columns")).alias("_low"))
    found = F.array(*[F.struct(F.lit(f).alias("field"), fuzzy_match(F.col("columns"), F.col("_low"), f).alias("hit")) for f in rules.FIELD_PATTERNS])
    hits = low.select(key, F.explode(found).alias("m")).filter("m.hit is not null")
    return hits.select(key, "m.field", "m.hit.column", "m.hit.score")


def _samples(sample: Column, name: Column, rows: int | None) -> Column:
    """The non-empty values of a column in the sample rows, all or the first ``rows``."""
    values = F.transform(sample if rows is None else F.slice(sample, 1, rows), lambda r: F.try_element_at(r, name))
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def _plausible(field: str, v: Column) -> Column:
    if field == "date":
        return D.parse_timestamp(v).isNotNull()
    limit = 90.0 if field == "latitude" else 180.0
    return F.coalesce(F.abs(v.try_cast("double")) <= limit, F.lit(False))


def value_match(names: Column, sample: Column, field: str, rows: int | None = None, values: int | None = None) -> Column:
    """The first column whose landed values all look like the field.

    ``rows`` and ``values`` restrict the check to the first rows and the first values found in them; by default all count.
    """
    def fits(c: Column) -> Column:
        seen = _samples(sample, c, rows)
        checked = seen if values is None else F.slice(seen, 1, values)
        return (F.size(seen) > 0) & F.forall(checked, lambda v: _plausible(field, v))

    return F.try_element_at(F.filter(names, fits), F.lit(1))


def embedded_time(date_column: Column, sample: Column, rows: int | None = None, values: int | None = None) -> Column:
    """The date column itself when one of its landed values (or of the first, see ``value_match``) carries a clock time."""
    def timed(v: Column) -> Column:
        stamp = D.parse_timestamp(v)
        clock = stamp != stamp.cast("date").cast(D.NTZ)
        return stamp.isNotNull() & (clock | v.contains(" ") | v.contains("T") | (F.length(v) > 10))

    seen = _samples(sample, date_column, rows)
    seen = seen if values is None else F.slice(seen, 1, values)
    return F.when(F.exists(seen, timed), date_column)


def detect_columns(df: DataFrame, sample: str | None = None, fuzzy: bool = True, rows: int | None = None,
                   values: int | None = None, clock_values: int | None = None) -> DataFrame:
    """Add ``column_mapping``: MAP of standard field to column name, evaluated inside the row.

    ``sample`` names an ARRAY<MAP<STRING, STRING>> of landed rows; without it the
    value steps are skipped. ``rows``, ``values`` and ``clock_values`` restrict them to the first ones
    (``QUICK_LOOK`` gives usual numbers); by default every landed value counts.
    """
    names, low = F.col("columns"), F.col("_low")

    def found(f: str) -> Column:
        exact, words, _ = rules.FIELD_PATTERNS[f]
        ways = [exact_match(names, low, exact), contains_match(names, low, words)]
        return F.coalesce(*ways, *([fuzzy_match(names, low, f)["column"]] if fuzzy else []))

    fields = list(rules.FIELD_PATTERNS)
    by_name = {f"_{f}": found(f) for f in fields}
    # many datasets share a list of names: the similarity of names is found once for each list
    lists = df.select("columns").distinct().limit(MOST_LISTS + 1).filter("columns is not null")
    lists = cut_lineage(lists)
    if lists.count() < MOST_LISTS:
        known = cut_lineage(once(lists.withColumn("_low", lowered(names)), by_name).drop("_low"))
        out = df.join(F.broadcast(known), "columns", "left").select(*[F.col(f"`{c}`") for c in df.columns], *by_name)
    else:
        out = once(df.withColumn("_low", lowered(names)), by_name).drop("_low")
    if sample is not None:
        out = once(out, {f"_{f}": F.coalesce(F.col(f"_{f}"), value_match(names, F.col(sample), f, rows, values)) for f in CHECKED})
        out = once(out, {"_time": F.coalesce("_time", embedded_time(F.col("_date"), F.col(sample), rows, clock_values))})
    entries = F.array(*[F.struct(F.lit(f).alias("k"), F.col(f"_{f}").alias("v")) for f in fields])
    mapping = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return once(out, {"column_mapping": mapping}).drop(*by_name)

"""Filtering, matching and rating catalogs of datasets by their names and columns.

A catalog row is one dataset; ``columns`` is its array of column names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules, text as X
from ..functions.joins import lookup_join, one_row
from .dedupe import first_per_id
from .distribution import percent

NO_DATASETS, ERROR = "NO_DATASETS_FOUND", "ERROR"
FIELDS = list(rules.FIELD_PATTERNS)


def relevant(df: DataFrame, words: list[str], fields: list[str] = ["name", "description"],
             key: str | None = "dataset_id") -> DataFrame:
    """Datasets with any of the words in any of the text fields and, if ``key`` is given, a non-empty id."""
    hit = X.any_of([X.contains_any(F.col(f), words) for f in fields])
    return df.filter(hit if key is None else hit & has_id(F.col(key)))


def has_id(key: Column) -> Column:
    return key.isNotNull() & (key.cast("string") != "")


def has_geometry(df: DataFrame, reference: str = "spatial_reference", kind: str = "geometry_type") -> DataFrame:
    """Datasets with a spatial reference or a point geometry."""
    named = F.col(reference).isNotNull() & (F.col(reference).cast("string") != "")
    return df.filter(named | X.contains_any(F.col(kind), ["point"]))


def has_coordinates(df: DataFrame, terms: list[str] = rules.COORDINATE_TERMS) -> DataFrame:
    """Flag datasets with a column whose name holds any of the terms."""
    return df.withColumn("has_coordinates", X.any_element_contains(F.col("columns"), terms))


def unique_datasets(df: DataFrame, order_by: list[str], key: str = "dataset_id", dedupe: bool = True) -> DataFrame:
    """The first listing of every dataset; ``dedupe=False`` keeps repeats as a multi-term search returns them."""
    return first_per_id(df, key, order_by) if dedupe else df


def best_priority(df: DataFrame, by: str = "city", priority: str = "priority") -> DataFrame:
    """Rows of the lowest priority number found for their city: later discovery ways only fill gaps."""
    best = df.groupBy(by).agg(F.min(priority).alias("_best"))
    return lookup_join(df, best, [by]).filter(F.col(priority) == F.col("_best")).drop("_best")


def known_datasets(domains: DataFrame, known: DataFrame, terms: list[str] = rules.COORDINATE_TERMS_KNOWN) -> DataFrame:
    """The listed datasets of each domain that have a coordinate column."""
    return domains.join(has_coordinates(known, terms).filter("has_coordinates").drop("has_coordinates"), "domain")


def match_categories(df: DataFrame, categories: dict = rules.COLUMN_CATEGORIES) -> DataFrame:
    """One ``has_`` flag per category: enough of its keywords occur in some column name.

    Names are compared in lower case with blanks as underscores. Coordinates need
    one name with 'lat' and one with 'lon' or 'lng' instead.
    """
    names = F.transform("columns", lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_")))

    def some(part: str) -> Column:
        return F.exists("_names", lambda c: c.contains(part))

    flags: dict[str, Column] = {}
    for name, (words, needed) in categories.items():
        if name == "coordinates":
            flag = some("lat") & (some("lon") | some("lng"))
        else:
            parts = [w.lower().replace(" ", "_") for w in words]
            if needed == 1:
                flag = X.any_of([some(p) for p in parts])
            else:
                flag = sum((some(p).cast("int") for p in parts), F.lit(0)) >= needed
        flags[f"has_{name}"] = F.coalesce(flag, F.lit(False))
    return df.withColumn("_names", names).withColumns(flags).drop("_names")


def score_matches(df: DataFrame, categories: dict = rules.COLUMN_CATEGORIES) -> DataFrame:
    """Share of matching categories in percent, whether all match, column count and joined names."""
    flags = [F.col(f"has_{c}") for c in categories]
    matched = sum((f.cast("int") for f in flags), F.lit(0))
    n = F.coalesce(F.size("columns"), F.lit(0))
    return df.withColumns({
        "match_score": matched / F.lit(len(flags)) * 100,
        "all_columns_match": reduce(lambda a, b: a & b, flags),
        "total_columns": n,
        "columns_list": F.when(n > 0, F.array_join("columns", " | ")).otherwise(F.lit("No columns found")),
    })


def with_placeholders(cities: DataFrame, matches: DataFrame, errors: DataFrame | None = None,
                      categories: dict = rules.COLUMN_CATEGORIES) -> DataFrame:
    """All matches, plus one zero row per city without any and per failed city.

    ``cities`` and ``matches`` share their city columns; a city is its name and, where both have it, its state.
    ``errors`` holds (city, message) and may hold the state; of several messages of a city the first counts.
    """
    fill = {"total_columns": F.lit(0), "columns_list": F.lit(""), "dataset_url": F.lit(""), "match_score": F.lit(0.0),
            "all_columns_match": F.lit(False), **{f"has_{c}": F.lit(False) for c in categories}}
    place = [c for c in cities.columns if c in matches.columns and c in ("city", "state")]
    # null-safe, and on all that names a city: a match in one Aurora says nothing of another
    have = matches.select(*[F.col(c).alias(f"_{c}") for c in place]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place])
    rest = cities.join(have, same, "left_anti")
    kind = matches.schema["dataset_id"].dataType
    if errors is not None:
        on = [c for c in place if c in errors.columns]
        errors = errors.groupBy(*on).agg(F.min("message").alias("message"))
        failed = rest.join(errors, on).withColumns(
            {"dataset_id": F.lit(ERROR).cast(kind), "dataset_name": F.concat(F.lit("Error: "), "message"), **fill})
        rest = rest.join(errors, on, "left_anti")
    none = rest.withColumns({"dataset_id": F.lit(NO_DATASETS).cast(kind),
                             "dataset_name": F.lit("No crime datasets found"), **fill})
    parts = [matches, none] + ([failed.drop("message")] if errors is not None else [])
    keep = [c for c in matches.columns if c in none.columns]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*keep) for p in parts])


# --- fixed values: export names of the match table, in column order ---
EXPORT_NAMES = {
    "city": "City", "state": "State", "population": "Population", "domain": "Data_Portal_Domain",
    "dataset_name": "Dataset_Name", "dataset_id": "Dataset_ID", "dataset_url": "Dataset_URL",
    "match_score": "Chicago_Compatibility_Score_Percent", "all_columns_match": "Perfect_Match_All_Categories",
    "total_columns": "Total_Columns", "has_coordinates": "Has_Geographic_Coordinates",
    "has_date": "Has_Date_Information", "has_time": "Has_Time_Information",
    "has_location_description": "Has_Location_Description", "has_crime_type": "Has_Crime_Type_Classification",
    "has_crime_description": "Has_Crime_Description", "has_arrest": "Has_Arrest_Information",
    "columns_list": "All_Column_Names",
}
# --- fixed values: texts for missing export values ---
EXPORT_BLANKS = {"dataset_name": "No crime datasets found", "dataset_id": "N/A", "dataset_url": "",
                 "columns_list": "No columns available"}


def export_table(matches: DataFrame, ordered: bool = True) -> DataFrame:
    """The presentation form: renamed and ordered columns, formatted numbers, Yes and No, no blanks.

    Sorted by score, then population, both descending and numeric.
    """
    if ordered:
        matches = matches.orderBy(F.col("match_score").desc(), F.col("population").desc(), "dataset_id")
    kinds = dict(matches.dtypes)
    out: list[Column] = []
    for source, name in EXPORT_NAMES.items():
        if source not in kinds:
            c = F.lit(None).cast("string")
        elif source == "population":
            c = F.coalesce(X.thousands(F.col(source)), F.lit(""))
        elif source == "match_score":
            c = F.coalesce(X.percent_text(F.col(source)), F.lit("0.0%"))
        elif kinds[source] == "boolean":
            c = X.yes_no(F.col(source))
        else:
            c = F.col(source)
        if source in EXPORT_BLANKS:
            c = F.coalesce(c.cast("string"), F.lit(EXPORT_BLANKS[source]))
        out.append(c.alias(name))
    return matches.select(*out)


def real_datasets(matches: DataFrame) -> DataFrame:
    return matches.filter(~F.col("dataset_id").cast("string").isin(NO_DATASETS, ERROR))


def compatibility_summary(matches: DataFrame, include_placeholders: bool = False) -> DataFrame:
    """Cities, datasets, perfect matches, mean score and the three score bands.

    ``include_placeholders`` counts placeholder rows as datasets of score 0.
    """
    s = F.col("match_score")
    real = F.lit(True) if include_placeholders else ~F.col("dataset_id").cast("string").isin(NO_DATASETS, ERROR)
    return matches.agg(
        F.count_distinct("city").alias("cities"), F.count_if(real).alias("datasets"),
        F.count_if(real & F.col("all_columns_match")).alias("perfect"),
        F.avg(F.when(real, s)).alias("mean_score"),
        F.count_if(real & (s >= 80)).alias("high"),
        F.count_if(real & (s >= 50) & (s < 80)).alias("medium"),
        F.count_if(real & (s < 50)).alias("low"))


def top_matches(matches: DataFrame, k: int = 10, tie: list[str] = ["dataset_id"]) -> DataFrame:
    """The k best datasets by score, then population."""
    return real_datasets(matches).orderBy(F.col("match_score").desc(), F.col("population").desc(), *tie).limit(k)


def quality_rating(average: Column, datasets: Column) -> Column:
    return (F.when(datasets == 0, "No Data").when(average >= 90, "Excellent").when(average >= 70, "Good")
            .when(average >= 50, "Fair").otherwise("Poor"))


def city_rollup(matches: DataFrame, order_by: list[str] = ["dataset_id"], names: int = 3) -> DataFrame:
    """Per city: dataset count, mean, best and worst score, perfect matches, rating and the first names.

    The ranking filter keeps ``names`` rows per city and task before the
    shuffle; the scores are plain aggregates.
    """
    by = ["city", "state"]
    real = ~F.col("dataset_id").cast("string").isin(NO_DATASETS, ERROR)
    score = F.when(real, F.col("match_score"))

    def known(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    stats = matches.groupBy(*by).agg(
        F.max("population").alias("population"), F.count_if(real).alias("datasets_found"),
        known(F.avg(score)).alias("average_score"), known(F.max(score)).alias("best_score"),
        known(F.min(score)).alias("worst_score"),
        F.count_if(real & F.col("all_columns_match")).alias("perfect_matches"))
    at = W.partitionBy(*by).orderBy(*order_by)
    first = matches.filter(real).select(*by, "dataset_name", F.row_number().over(at).alias("rn")).filter(F.col("rn") <= names)
    listed = first.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "dataset_name"))),
                                                             lambda x: x["dataset_name"]), " | ").alias("_names"))
    more = F.when(F.col("datasets_found") > names, F.lit("...")).otherwise("")
    return stats.join(listed, by, "left").withColumns({
        "has_data": X.yes_no(F.col("datasets_found") > 0),
        "rating": quality_rating(F.col("average_score"), F.col("datasets_found")),
        "dataset_names": F.concat(F.coalesce("_names", F.lit("")), more)}).drop("_names")


def order_rollup(rollup: DataFrame) -> DataFrame:
    return rollup.orderBy(F.round("average_score", 1).desc(), F.col("population").desc())


def rating_distribution(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("rating").agg(F.count(F.lit(1)).alias("cities"))


def data_presence(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.count_if(F.col("datasets_found") > 0).alias("with_data"),
                      F.count_if(F.col("datasets_found") == 0).alias("without_data"))


def coordinate_columns(df: DataFrame) -> DataFrame:
    """Latitude, longitude and location column of every dataset: key order first, column order second."""
    def first(keys: list[str]) -> Column:
        def holding(k: str) -> Column:
            return F.try_element_at(F.filter("columns", lambda c: F.lower(c).contains(k)), F.lit(1))

        return F.coalesce(*[holding(k) for k in keys])

    out = df.withColumns({"lat_col": first(rules.LATITUDE_KEYS), "long_col": first(rules.LONGITUDE_KEYS),
                          "location_col": first(rules.LOCATION_KEYS)})
    kind = (F.when(F.col("lat_col").isNotNull() & F.col("long_col").isNotNull(), "separate_columns")
            .when(F.col("location_col").isNotNull(), "combined_column").otherwise("none"))
    return out.withColumn("coordinate_type", kind)


# --- catalogs with a column mapping (standard field -> column name) ---

def parse_mapping(text: Column) -> Column:
    """A stored mapping as MAP; single-quoted text is accepted, anything else is NULL."""
    return F.from_json(text, "map<string,string>")


def completeness(mapping: Column) -> Column:
    return F.coalesce(F.size(mapping), F.lit(0)) / F.lit(len(FIELDS)) * 100


def mapping_quality(df: DataFrame, mapping: str = "column_mapping", fixed: str | None = None) -> DataFrame:
    """Share of mapped fields in percent and what they cover.

    ``fixed`` names a flag column: flagged (already standardised) datasets score 100 whatever they map.
    """
    m = F.col(mapping)

    def has(field: str) -> Column:
        return F.coalesce(F.map_contains_key(m, field), F.lit(False))

    done = completeness(m)
    score = done if fixed is None else F.when(F.col(fixed), F.lit(100.0)).otherwise(done)
    return df.withColumns({
        "quality_score": score, "completeness_score": done,
        "has_coordinates": has("latitude") & has("longitude"),
        "has_temporal": has("date") | has("time"),
        "has_crime_info": has("crime_type") | has("description")})


def quality_export(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("quality_score").desc(), F.col("population").desc(), "dataset_id")


def quality_by_city(df: DataFrame) -> DataFrame:
    """Per city: datasets, mean and best quality, and how many have coordinates, times and types."""
    def n(flag: str) -> Column:
        return F.count_if(F.col(flag))

    return df.groupBy("city", "state").agg(
        F.count("dataset_id").alias("datasets_found"), F.round(F.avg("quality_score"), 1).alias("avg_quality"),
        F.round(F.max("quality_score"), 1).alias("best_quality"), n("has_coordinates").alias("with_coords"),
        n("has_temporal").alias("with_time"), n("has_crime_info").alias("with_crime_info"))


def top_cities(by_city: DataFrame, k: int = 10) -> DataFrame:
    return by_city.orderBy(F.col("avg_quality").desc(), "city", "state").limit(k)


def source_distribution(df: DataFrame, source: str = "source") -> DataFrame:
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    total = one_row(counts.agg(F.sum("n").alias("t")))["t"]
    return counts.select(F.col(source).alias("source"), "n", percent(F.col("n"), total).alias("percentage"))


def quality_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("city").alias("cities"), F.count(F.lit(1)).alias("datasets"),
                  F.count_if("has_coordinates").alias("with_coords"), F.avg("quality_score").alias("mean_quality"))


def best_per_city(df: DataFrame, score: str = "quality_score", tie: list[str] = ["dataset_id"]) -> DataFrame:
    """The dataset of highest quality per city; the first by ``tie`` among equals."""
    at = W.partitionBy("city").orderBy(F.col(score).desc(), *tie)
    return df.withColumn("_rn", F.row_number().over(at)).filter("_rn = 1").drop("_rn")


def _missing(mapping: Column, fields: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(f) for f in fields]), F.map_keys(mapping))


def missing_fields(df: DataFrame, mapping: str = "column_mapping", fields: list[str] = FIELDS,
                   max_score: float | None = None) -> DataFrame:
    """How often each standard field is not mapped, with the share of all datasets.

    Datasets whose mapping cannot be read count in the denominator only.
    ``max_score`` restricts the report to datasets below that quality.
    """
    if max_score is not None:
        df = df.filter(F.col("quality_score") < max_score)
    total = one_row(df.agg(F.count(F.lit(1)).alias("t")))["t"]
    missing = df.select(F.explode(_missing(F.col(mapping), fields)).alias("field"))
    return missing.groupBy("field").agg(F.count(F.lit(1)).alias("n")).withColumn("percentage", percent(F.col("n"), total))


def score_distribution(df: DataFrame, mapping: str = "column_mapping") -> DataFrame:
    """Datasets per quality score with a readable mapping, as a share of all datasets."""
    total = one_row(df.agg(F.count(F.lit(1)).alias("t")))["t"]
    counts = df.filter(F.col(mapping).isNotNull()).groupBy("quality_score").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percentage", percent(F.col("n"), total))


def missing_combinations(df: DataFrame, mapping: str = "column_mapping", fields: list[str] = FIELDS, k: int = 5,
                         bands: list[tuple[float, float]] = rules.SCORE_BANDS) -> DataFrame:
    """The k most frequent sets of missing fields per score band.

    Datasets missing nothing count in the band's total only. There are at most
    2^8 combinations, so everything after the first aggregate is small.
    """
    s = F.col("quality_score")
    band = F.coalesce(*[F.when(s.between(lo, hi), F.lit(f"{lo:g}-{hi:g}")) for lo, hi in bands])
    combos = df.filter(F.col(mapping).isNotNull()).select(
        band.alias("band"), F.array_join(F.array_sort(_missing(F.col(mapping), fields)), ",").alias("missing")) \
        .filter("band is not null").groupBy("band", "missing").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("band"))
    ranked = combos.withColumn("total", total).filter("missing <> ''").withColumn(
        "rank", F.row_number().over(W.partitionBy("band").orderBy(F.col("n").desc(), "missing")))
    return ranked.filter(F.col("rank") <= k).select("band", "rank", "missing", "n",
                                                    percent(F.col("n"), F.col("total")).alias("percentage"))

"""Filtering, matching, rating and column detection on the catalog view."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules
from ..operators import catalog as K, dedupe, detect
from .registry import query

CATALOG = ("v_catalog",)
CAT = """cat AS (SELECT *, 100000 + 1000 * CAST(substr(city, 4) AS BIGINT) AS population, 'data.' || city || '.gov' AS domain,
  replace(lower(columns_text), ' ', '_') AS ct FROM v_catalog)"""


def catalog(t) -> DataFrame:
    return t.v_catalog.select(
        "dataset_id", "city", "state", F.col("name"), F.col("name").alias("dataset_name"), "description", F.split("columns_text", r"\|").alias("columns"),
        (F.lit(100000) + 1000 * F.substring("city", 4, 10).cast("bigint")).alias("population"),
        F.concat(F.lit("data."), "city", F.lit(".gov")).alias("domain"),
        F.concat(F.lit("https://data."), "city", F.lit(".gov/d/"), "dataset_id").alias("dataset_url"))


def holds(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def text_query(words: list[str], fields: list[str], where: str = "") -> str:
    tests = " OR ".join(holds(f"lower({f})", words) for f in fields)
    return f"SELECT dataset_id, name FROM v_catalog WHERE ({tests}) {where}"


@query("b01_relevant_wide", text_query(["crime", "police", "incident", "offense", "arrest", "criminal"], ["name", "description"]), CATALOG)
def b01_wide(t):
    return K.relevant(catalog(t), rules.RELEVANCE_WIDE).select("dataset_id", "name")


@query("b01_relevant_listing", text_query(["crime", "police", "incident", "offense"], ["name", "description"]), CATALOG)
def b01_listing(t):
    return K.relevant(catalog(t), rules.RELEVANCE_LISTING, key=None).select("dataset_id", "name")


@query("b01_relevant_core", text_query(["crime", "police", "incident"], ["name", "description"]), CATALOG)
def b01_core(t):
    return K.relevant(catalog(t), rules.RELEVANCE_CORE).select("dataset_id", "name")


@query("b01_relevant_name_only", text_query(["crime", "incident", "police"], ["name"]), CATALOG)
def b01_name(t):
    return K.relevant(catalog(t), rules.RELEVANCE_NAME_ONLY, ["name"]).select("dataset_id", "name")


@query("b01b_geometry", """
SELECT dataset_id FROM v_catalog WHERE dataset_id % 4 = 0 OR dataset_id % 3 = 1""", CATALOG)
def b01b(t):
    df = catalog(t).withColumns({
        "spatial_reference": F.when(F.col("dataset_id") % 4 == 0, "4326"),
        "geometry_type": F.when(F.col("dataset_id") % 3 == 1, "esriGeometryPoint").otherwise("esriPolygon")})
    return K.has_geometry(df).select("dataset_id")


@query("b02_has_coordinates", """
SELECT dataset_id, contains(columns_text, 'latitude') AS broad, contains(columns_text, 'latitude') AS narrow,
 contains(columns_text, 'latitude') AS sample FROM v_catalog""", CATALOG)
def b02(t):
    df = catalog(t)
    for name, terms in (("broad", rules.COORDINATE_TERMS), ("narrow", rules.COORDINATE_TERMS_KNOWN),
                        ("sample", rules.COORDINATE_TERMS_SAMPLE)):
        df = K.has_coordinates(df, terms).withColumnRenamed("has_coordinates", name)
    return df.select("dataset_id", "broad", "narrow", "sample")


@query("b03_unique_datasets", """
WITH s AS (SELECT dataset_id, name, 1 AS term FROM v_catalog WHERE contains(lower(name), 'crime')
 UNION ALL SELECT dataset_id, name, 2 FROM v_catalog WHERE contains(lower(name), 'police') OR dataset_id % 2 = 0)
SELECT dataset_id, name, term FROM s QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY term) = 1""", CATALOG)
def b03(t):
    df = catalog(t)
    found = K.relevant(df, ["crime"], ["name"]).withColumn("term", F.lit(1)).union(
        df.filter(F.lower("name").contains("police") | (F.col("dataset_id") % 2 == 0)).withColumn("term", F.lit(2)))
    return K.unique_datasets(found, ["term"]).select("dataset_id", "name", "term")


PRIORITY = "CASE WHEN contains(name, 'Parks') THEN 3 WHEN dataset_id % 100 < 4 THEN 1 ELSE 2 END"


@query("b04_best_priority", f"""
WITH p AS (SELECT dataset_id, city, {PRIORITY} AS priority FROM v_catalog)
SELECT dataset_id, city, priority FROM p WHERE priority = (SELECT min(priority) FROM p q WHERE q.city = p.city)""", CATALOG)
def b04(t):
    rank = F.when(F.col("name").contains("Parks"), 3).when(F.col("dataset_id") % 100 < 4, 1).otherwise(2)
    return K.best_priority(catalog(t).withColumn("priority", rank)).select("dataset_id", "city", "priority")


@query("b04b_known_datasets", f"""
WITH {CAT} SELECT domain, dataset_id, name FROM cat WHERE population >= 110000 AND contains(columns_text, 'latitude')""", CATALOG)
def b04b(t):
    df = catalog(t)
    domains = df.filter("population >= 110000").select("domain").distinct()
    return K.known_datasets(domains, df.select("domain", "dataset_id", "name", "columns")).select("domain", "dataset_id", "name")


CATEGORY_SQL = {
    "coordinates": "(contains(ct, 'lat') AND (contains(ct, 'lon') OR contains(ct, 'lng')))",
    "date": holds("ct", ["date", "occurred", "incident", "reported", "datetime", "timestamp"]),
    "time": holds("ct", ["time", "hour", "minute", "datetime", "timestamp", "occurred", "date"]),
    "location_description": holds("ct", ["location_description", "location", "description", "premise", "place", "address", "block"]),
    "crime_type": holds("ct", ["primary_type", "crime_type", "offense", "incident_type", "classification", "category"]),
    "crime_description": holds("ct", ["description", "detail"]),
    "arrest": holds("ct", ["arrest", "custody", "apprehended", "cleared"]),
}
FLAGS_SQL = ", ".join(f"{v} AS has_{k}" for k, v in CATEGORY_SQL.items())
FLAG_NAMES = [f"has_{k}" for k in CATEGORY_SQL]
SCORED = f"""{CAT}, fl AS (SELECT *, {FLAGS_SQL} FROM cat),
 sc AS (SELECT *, ({' + '.join(f'CAST({f} AS INT)' for f in FLAG_NAMES)}) / 7.0 * 100 AS match_score, {' AND '.join(FLAG_NAMES)} AS all_columns_match,
  len(string_split(columns_text, '|')) AS total_columns, replace(columns_text, '|', ' | ') AS columns_list FROM fl)"""


def scored(t) -> DataFrame:
    return K.score_matches(K.match_categories(catalog(t)))


@query("b05_category_match", f"WITH {SCORED} SELECT dataset_id, {', '.join(FLAG_NAMES)} FROM sc", CATALOG)
def b05(t):
    return K.match_categories(catalog(t)).select("dataset_id", *FLAG_NAMES)


@query("b06_match_score", f"""
WITH {SCORED} SELECT dataset_id, round(match_score, 6) AS match_score, all_columns_match, total_columns, columns_list FROM sc""", CATALOG)
def b06(t):
    return scored(t).select("dataset_id", "match_score", "all_columns_match", "total_columns", "columns_list")


MATCH_COLUMNS = ["city", "state", "population", "domain", "dataset_id", "dataset_name", "dataset_url", "total_columns",
                 "columns_list", "match_score", "all_columns_match", *FLAG_NAMES]
# one row per city and state; those of 'src7' found nothing, those of 'src9' failed
WITH_GAPS = f"""{SCORED}, hit AS (SELECT * FROM sc WHERE city NOT IN ('src7', 'src9')),
 gaps AS (SELECT DISTINCT city, state, population, domain FROM cat WHERE city IN ('src7', 'src9')),
 full_t AS (SELECT city, state, population, domain, CAST(dataset_id AS VARCHAR) AS dataset_id, name AS dataset_name,
   'https://' || domain || '/d/' || dataset_id AS dataset_url, total_columns, columns_list, match_score, all_columns_match, {', '.join(FLAG_NAMES)} FROM hit
  UNION ALL SELECT city, state, population, domain, CASE WHEN city = 'src9' THEN 'ERROR' ELSE 'NO_DATASETS_FOUND' END,
   CASE WHEN city = 'src9' THEN 'Error: timeout' ELSE 'No crime datasets found' END, '', 0, '', 0.0, false, {', '.join('false' for _ in FLAG_NAMES)} FROM gaps)"""


def with_gaps(t) -> DataFrame:
    df = scored(t).withColumn("dataset_id", F.col("dataset_id").cast("string"))
    hits = df.filter(~F.col("city").isin("src7", "src9")).select(*MATCH_COLUMNS)
    cities = df.select("city", "state", "population", "domain").distinct()
    errors = df.filter("city = 'src9'").select("city", F.lit("timeout").alias("message")).distinct()
    return K.with_placeholders(cities, hits, errors)


@query("b07_placeholders", f"""
WITH {WITH_GAPS} SELECT city, state, population, domain, dataset_id, dataset_name, dataset_url, total_columns, columns_list,
 round(match_score, 6) AS match_score, all_columns_match, {', '.join(FLAG_NAMES)} FROM full_t""", CATALOG)
def b07(t):
    return with_gaps(t)


@query("b07_cities_of_one_name", f"""
WITH {SCORED}, hit AS (SELECT * FROM sc WHERE city <> 'src7' OR state <> 'en') SELECT city, state, CAST(dataset_id AS VARCHAR) AS dataset_id FROM hit
UNION ALL SELECT DISTINCT city, state, 'NO_DATASETS_FOUND' FROM cat WHERE city = 'src7' AND state = 'en'""", CATALOG)
def b07_names(t):
    """A city with matches in one state says nothing of its namesake in another."""
    df = scored(t).withColumn("dataset_id", F.col("dataset_id").cast("string"))
    hits = df.filter("city <> 'src7' or state <> 'en'").select(*MATCH_COLUMNS)
    return K.with_placeholders(df.select("city", "state", "population", "domain").distinct(), hits).select("city", "state", "dataset_id")


YES = {n: f"CASE WHEN {c} THEN 'Yes' ELSE 'No' END AS {n}" for c, n in K.EXPORT_NAMES.items() if c.startswith("has_") or c == "all_columns_match"}


@query("b08_export_table", f"""
WITH {WITH_GAPS} SELECT city AS City, state AS State, format('{{:,}}', population) AS Population, domain AS Data_Portal_Domain,
 dataset_name AS Dataset_Name, dataset_id AS Dataset_ID, dataset_url AS Dataset_URL, printf('%.1f%%', CAST(match_score AS DOUBLE)) AS Chicago_Compatibility_Score_Percent,
 {', '.join(YES.values())}, total_columns AS Total_Columns, columns_list AS All_Column_Names FROM full_t""", CATALOG)
def b08(t):
    return K.export_table(with_gaps(t))


SUMMARY = """SELECT count(DISTINCT city) AS cities, count(*) FILTER (ok) AS datasets, count(*) FILTER (ok AND all_columns_match) AS perfect,
 round(avg(match_score) FILTER (ok), 6) AS mean_score, count(*) FILTER (ok AND match_score >= 80) AS high,
 count(*) FILTER (ok AND match_score >= 50 AND match_score < 80) AS medium, count(*) FILTER (ok AND match_score < 50) AS low
 FROM (SELECT *, {ok} AS ok FROM full_t)"""
REAL = "dataset_id NOT IN ('NO_DATASETS_FOUND', 'ERROR')"


@query("b09_compatibility_summary", f"WITH {WITH_GAPS} {SUMMARY.format(ok=REAL)}", CATALOG)
def b09(t):
    return K.compatibility_summary(with_gaps(t))


@query("b09_summary_with_placeholders", f"WITH {WITH_GAPS} {SUMMARY.format(ok='true')}", CATALOG)
def b09_all(t):
    return K.compatibility_summary(with_gaps(t), include_placeholders=True)


@query("b09_top_matches", f"""
WITH {WITH_GAPS} SELECT city, dataset_name, dataset_id, round(match_score, 6) AS match_score, total_columns FROM full_t WHERE {REAL}
ORDER BY full_t.match_score DESC, population DESC, dataset_id LIMIT 10""", CATALOG)
def b09_top(t):
    return K.top_matches(with_gaps(t)).select("city", "dataset_name", "dataset_id", "match_score", "total_columns")


ROLLUP = f"""{WITH_GAPS}, ru AS (SELECT city, state, max(population) AS population, count(*) FILTER ({REAL}) AS datasets_found,
  coalesce(avg(match_score) FILTER ({REAL}), 0) AS average_score, coalesce(max(match_score) FILTER ({REAL}), 0) AS best_score,
  coalesce(min(match_score) FILTER ({REAL}), 0) AS worst_score, count(*) FILTER ({REAL} AND all_columns_match) AS perfect_matches,
  list_aggregate(list_slice(list(dataset_name ORDER BY dataset_id) FILTER ({REAL}), 1, 3), 'string_agg', ' | ') AS names FROM full_t GROUP BY 1, 2),
 rated AS (SELECT *, CASE WHEN datasets_found = 0 THEN 'No Data' WHEN average_score >= 90 THEN 'Excellent' WHEN average_score >= 70 THEN 'Good'
  WHEN average_score >= 50 THEN 'Fair' ELSE 'Poor' END AS rating FROM ru)"""


@query("b10_city_rollup", f"""
WITH {ROLLUP} SELECT city, state, population, datasets_found, round(average_score, 6) AS average_score, round(best_score, 6) AS best_score,
 round(worst_score, 6) AS worst_score, perfect_matches, CASE WHEN datasets_found > 0 THEN 'Yes' ELSE 'No' END AS has_data, rating,
 coalesce(names, '') || CASE WHEN datasets_found > 3 THEN '...' ELSE '' END AS dataset_names FROM rated""", CATALOG)
def b10(t):
    return K.order_rollup(K.city_rollup(with_gaps(t)))


@query("b11_rating_distribution", f"WITH {ROLLUP} SELECT rating, count(*) AS cities FROM rated GROUP BY 1", CATALOG)
def b11(t):
    return K.rating_distribution(K.city_rollup(with_gaps(t)))


@query("b11_data_presence", f"""
WITH {ROLLUP} SELECT count(*) FILTER (datasets_found > 0) AS with_data, count(*) FILTER (datasets_found = 0) AS without_data FROM rated""", CATALOG)
def b11_presence(t):
    return K.data_presence(K.city_rollup(with_gaps(t)))


@query("b12_coordinate_columns", """
WITH f AS (SELECT *, contains(columns_text, 'latitude') AS la, contains(columns_text, 'longitude') AS lo, contains(columns_text, 'primary_type') AS pt FROM v_catalog)
SELECT dataset_id, CASE WHEN la THEN 'latitude' WHEN pt THEN 'primary_type' END AS lat_col, CASE WHEN lo THEN 'longitude' END AS long_col,
 CAST(NULL AS VARCHAR) AS location_col, CASE WHEN (la OR pt) AND lo THEN 'separate_columns' ELSE 'none' END AS coordinate_type FROM f""", CATALOG)
def b12(t):
    # a lone 'y' as in primary_type passes for a latitude, as the key list says
    return K.coordinate_columns(catalog(t)).select("dataset_id", "lat_col", "long_col", "location_col", "coordinate_type")


def has(c: str) -> str:
    return f"list_contains(string_split(columns_text, '|'), '{c}')"


def odd_catalog(t) -> DataFrame:
    """The catalog with misspelt names, repeated ids (every 10th row twice, with other columns) and null ids."""
    c = catalog(t).select("dataset_id", "columns")
    third = c.withColumn("third", F.col("dataset_id") % 3 == 0)
    odd = F.transform("columns", lambda x: F.when(F.col("third"), F.translate(x, "ei", "3")).otherwise(F.concat(x, F.lit("s"))))
    rows = third.withColumn("columns", odd).select(F.when(F.col("dataset_id") % 7 != 0, F.col("dataset_id")).alias("dataset_id"), "columns")
    return rows.unionByName(c.filter("dataset_id % 10 = 0"))


ODD = """oc AS (SELECT CASE WHEN c.dataset_id % 7 <> 0 THEN c.dataset_id END AS dataset_id,
  list_transform(string_split(columns_text, '|'), lambda x: CASE WHEN c.dataset_id % 3 = 0 THEN translate(x, 'ei', '3') ELSE x || 's' END) AS cols, c.dataset_id * 2 AS row FROM v_catalog c
 UNION ALL SELECT dataset_id, string_split(columns_text, '|'), dataset_id * 2 + 1 FROM v_catalog WHERE dataset_id % 10 = 0)"""
PATTERNS = {f: p for f, (p, _, _) in rules.FIELD_PATTERNS.items()}


def exact_sql(field: str) -> str:
    """The column named like the first present pattern, in any case; the last such column."""
    return "coalesce(" + ", ".join(f"list_filter(cols, lambda x: lower(x) = '{p}')[-1]" for p in PATTERNS[field]) + ")"


def contains_sql(field: str) -> str:
    words = " OR ".join(f"contains(lower(x), '{w}')" for w in rules.FIELD_PATTERNS[field][1])
    return f"list_filter(cols, lambda x: {words})[1]"


@query("b13a_exact_names", f"""
WITH {ODD}, e AS (SELECT dataset_id, {', '.join(f"{exact_sql(f)} AS {f}" for f in PATTERNS)} FROM oc) SELECT * FROM e""", CATALOG)
def b13a(t):
    return odd_catalog(t).withColumn("low", detect.lowered(F.col("columns"))).select("dataset_id", *[
        detect.exact_match(F.col("columns"), F.col("low"), rules.FIELD_PATTERNS[f][0]).alias(f) for f in PATTERNS])


@query("b13b_contained_words", f"""
WITH {ODD} SELECT dataset_id, {', '.join(f"{contains_sql(f)} AS {f}" for f in PATTERNS)} FROM oc""", CATALOG)
def b13b(t):
    return odd_catalog(t).withColumn("low", detect.lowered(F.col("columns"))).select("dataset_id", *[
        detect.contains_match(F.col("columns"), F.col("low"), rules.FIELD_PATTERNS[f][1]).alias(f) for f in PATTERNS])


# the longest common subsequence by its table, one character of the name a step
LCS = f"""pat(field, p, threshold) AS (VALUES {', '.join(f"('{f}', '{p}', {rules.FIELD_PATTERNS[f][2]})" for f in PATTERNS for p in PATTERNS[f])}),
 nm AS (SELECT DISTINCT lower(unnest(cols)) AS name FROM oc),
 tbl AS (SELECT name, field, p, threshold, 0 AS i, list_transform(range(0, length(p) + 1), lambda z: 0) AS line FROM nm, pat
  UNION ALL SELECT name, field, p, threshold, i + 1, list_reduce(range(1, length(p) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(name, i + 1, 1) = substr(p, CAST(j AS INT), 1)
    THEN line[j] + 1 ELSE greatest(line[j + 1], acc[-1]) END), [CAST(0 AS BIGINT)]) FROM tbl WHERE i < length(name)),
 scored AS (SELECT name, field, threshold, max(CAST(round_even(200.0 * line[-1] / (length(name) + length(p)), 0) AS BIGINT)) AS score FROM tbl WHERE i = length(name) GROUP BY ALL),
 places AS (SELECT dataset_id, row, unnest(cols) AS "column", generate_subscripts(cols, 1) AS pos FROM oc),
 fuzzy AS (SELECT dataset_id, row, field, "column", score FROM places JOIN scored ON name = lower("column") WHERE score > threshold
  QUALIFY row_number() OVER (PARTITION BY row, field ORDER BY score DESC, pos) = 1)"""


@query("b13c_similar_names", f"""
WITH RECURSIVE {ODD}, {LCS} SELECT dataset_id, field, "column", score FROM fuzzy""", CATALOG)
def b13c(t):
    return detect.fuzzy_matches(odd_catalog(t))


def sampled(t) -> DataFrame:
    """Orders as datasets with all their line items as landed rows."""
    rows = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.create_map(
        F.lit("price"), F.floor(F.col("l_extendedprice") / 500).cast("string"),
        F.lit("qty"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.floor("l_quantity").cast("string")),
        F.lit("shipped"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.when(F.col("l_tax") > 0.06, " 00:00").otherwise("")),
    ).alias("r")).alias("s"))
    # a map cannot be sorted: rows are ordered by their keys and looked up afterwards
    keyed = rows.select("l_orderkey", F.struct("s.l_linenumber", "s.l_partkey", "s.l_suppkey", "s.l_quantity", F.to_json("s.r").alias("j")).alias("s"))
    return keyed.groupBy(F.col("l_orderkey").alias("dataset_id")).agg(F.array_sort(F.collect_list("s")).alias("s")).select(
        "dataset_id", F.array(F.lit("price"), F.lit("qty"), F.lit("shipped")).alias("columns"),
        F.transform("s", lambda x: F.from_json(x["j"], "map<string,string>")).alias("sample"))


SAMPLED = """li AS (SELECT l_orderkey AS dataset_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn,
  CAST(floor(l_extendedprice / 500) AS BIGINT) AS price, CASE WHEN l_linenumber <> 1 THEN floor(l_quantity) END AS qty, l_tax > 0.06 AS timed FROM lineitem),
 a AS (SELECT dataset_id, max(price) AS p, count(qty) AS nq, bool_or(timed) AS timed FROM li GROUP BY 1),
 f AS (SELECT dataset_id, max(price) FILTER (rn <= 3) AS p, count(qty) FILTER (rn <= 10) AS nq, bool_or(timed) FILTER (rn <= 5) AS timed FROM li GROUP BY 1)"""


@query("b13d_plausible_values", f"""
WITH {SAMPLED} SELECT dataset_id, CASE WHEN p <= 90 THEN 'price' WHEN nq > 0 THEN 'qty' END AS latitude,
 CASE WHEN p <= 180 THEN 'price' WHEN nq > 0 THEN 'qty' END AS longitude, 'shipped' AS date FROM a""")
def b13d(t):
    return sampled(t).select("dataset_id", *[
        detect.value_match(F.col("columns"), F.col("sample"), f).alias(f) for f in ("latitude", "longitude", "date")])


@query("b13e_embedded_time", f"WITH {SAMPLED} SELECT dataset_id, CASE WHEN timed THEN 'shipped' END AS time FROM a")
def b13e(t):
    return sampled(t).select("dataset_id", detect.embedded_time(F.lit("shipped"), F.col("sample")).alias("time"))


FOUND = {
    "latitude": f"CASE WHEN {has('latitude')} THEN 'latitude' END", "longitude": f"CASE WHEN {has('longitude')} THEN 'longitude' END",
    "date": f"CASE WHEN {has('Occurred Date')} THEN 'Occurred Date' WHEN {has('incident_time')} THEN 'incident_time' END",
    # 'Occurred Date' resembles 'occurred_time' by 77, above the threshold of 75
    "time": f"CASE WHEN {has('incident_time')} THEN 'incident_time' WHEN {has('Occurred Date')} THEN 'Occurred Date' END",
    "crime_type": f"CASE WHEN {has('primary_type')} THEN 'primary_type' END",
    "description": f"CASE WHEN {has('description')} THEN 'description' END", "location": f"CASE WHEN {has('description')} THEN 'description' END",
    "arrest": f"CASE WHEN {has('arrest')} THEN 'arrest' END",
}
MAPPED = f"""{CAT}, mp AS (SELECT *, {', '.join(f'{v} AS m_{k}' for k, v in FOUND.items())} FROM cat),
 ql AS (SELECT *, ({' + '.join(f'CAST(m_{k} IS NOT NULL AS INT)' for k in FOUND)}) / 8.0 * 100 AS quality_score,
  m_latitude IS NOT NULL AND m_longitude IS NOT NULL AS has_coordinates, m_date IS NOT NULL OR m_time IS NOT NULL AS has_temporal,
  m_crime_type IS NOT NULL OR m_description IS NOT NULL AS has_crime_info FROM mp)"""


def mapped(t) -> DataFrame:
    return K.mapping_quality(detect.detect_columns(catalog(t)))


@query("b13_detect_columns", f"""
WITH {MAPPED} SELECT dataset_id, concat_ws(',', {', '.join(f"'{k}=' || m_{k}" for k in FOUND)}) AS mapping FROM mp""", CATALOG)
def b13(t):
    pairs = F.transform(F.map_entries("column_mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return detect.detect_columns(catalog(t)).select("dataset_id", F.array_join(pairs, ",").alias("mapping"))


@query("b13_detect_with_samples", f"""
WITH {SAMPLED} SELECT dataset_id, concat_ws(',', CASE WHEN p <= 90 THEN 'latitude=price' WHEN nq > 0 THEN 'latitude=qty' END,
 CASE WHEN p <= 180 THEN 'longitude=price' WHEN nq > 0 THEN 'longitude=qty' END, 'date=shipped', CASE WHEN timed THEN 'time=shipped' END) AS mapping FROM a""")
def b13_samples(t):
    pairs = F.transform(F.map_entries("column_mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return detect.detect_columns(sampled(t), sample="sample").select("dataset_id", F.array_join(pairs, ",").alias("mapping"))


@query("b13_detect_with_quick_look", f"""
WITH {SAMPLED} SELECT dataset_id, concat_ws(',', CASE WHEN p <= 90 THEN 'latitude=price' WHEN nq > 0 THEN 'latitude=qty' END,
 CASE WHEN p <= 180 THEN 'longitude=price' WHEN nq > 0 THEN 'longitude=qty' END, 'date=shipped', CASE WHEN timed THEN 'time=shipped' END) AS mapping FROM f""")
def b13_quick(t):
    """The first ten rows, three values and five clock values only."""
    pairs = F.transform(F.map_entries("column_mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return detect.detect_columns(sampled(t), sample="sample", **detect.QUICK_LOOK).select("dataset_id", F.array_join(pairs, ",").alias("mapping"))


@query("b14_mapping_quality", f"""
WITH {MAPPED} SELECT dataset_id, round(quality_score, 6) AS quality_score, round(quality_score, 6) AS completeness_score, has_coordinates,
 has_temporal, has_crime_info FROM ql""", CATALOG)
def b14(t):
    return mapped(t).select("dataset_id", "quality_score", "completeness_score", "has_coordinates", "has_temporal", "has_crime_info")


@query("b14_fixed_quality", """
SELECT dataset_id, CASE WHEN dataset_id % 10 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS quality_score, 0.0::DOUBLE AS completeness_score FROM v_catalog""", CATALOG)
def b14_fixed(t):
    df = catalog(t).withColumns({"column_mapping": F.create_map().cast("map<string,string>"), "agency": F.col("dataset_id") % 10 == 0})
    return K.mapping_quality(df, fixed="agency").select("dataset_id", "quality_score", "completeness_score")


@query("b15_quality_export", f"WITH {MAPPED} SELECT dataset_id, city, population, round(quality_score, 6) AS quality_score FROM ql", CATALOG)
def b15_export(t):
    return K.quality_export(mapped(t)).select("dataset_id", "city", "population", "quality_score")


BY_CITY = """bc AS (SELECT city, state, count(dataset_id) AS datasets_found, round(avg(quality_score), 1) AS avg_quality, round(max(quality_score), 1) AS best_quality,
 count(*) FILTER (has_coordinates) AS with_coords, count(*) FILTER (has_temporal) AS with_time, count(*) FILTER (has_crime_info) AS with_crime_info
 FROM ql GROUP BY 1, 2)"""


@query("b15_quality_by_city", f"WITH {MAPPED}, {BY_CITY} SELECT * FROM bc", CATALOG)
def b15(t):
    return K.quality_by_city(mapped(t))


@query("b15_top_cities", f"WITH {MAPPED}, {BY_CITY} SELECT * FROM bc ORDER BY avg_quality DESC, city, state LIMIT 10", CATALOG)
def b15_top(t):
    return K.top_cities(K.quality_by_city(mapped(t)))


@query("b16_source_distribution", """
SELECT state AS source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM v_catalog), 6) AS percentage FROM v_catalog GROUP BY 1""", CATALOG)
def b16(t):
    return K.source_distribution(catalog(t), "state")


@query("b16_quality_totals", f"""
WITH {MAPPED} SELECT count(DISTINCT city) AS cities, count(*) AS datasets, count(*) FILTER (has_coordinates) AS with_coords,
 round(avg(quality_score), 6) AS mean_quality FROM ql""", CATALOG)
def b16_totals(t):
    return K.quality_totals(mapped(t))


@query("b17_best_per_city", f"""
WITH {MAPPED} SELECT city, dataset_id, round(quality_score, 6) AS quality_score FROM ql
QUALIFY row_number() OVER (PARTITION BY city ORDER BY ql.quality_score DESC, dataset_id) = 1""", CATALOG)
def b17(t):
    return K.best_per_city(mapped(t)).select("city", "dataset_id", "quality_score")


# mappings as stored text; every 17th cannot be read
STORED = f"""{MAPPED}, stq AS (SELECT * FROM ql WHERE dataset_id % 17 <> 0)"""


def stored(t) -> DataFrame:
    text = F.replace(F.to_json("column_mapping"), F.lit('"'), F.lit("'"))
    return mapped(t).withColumn("column_mapping", K.parse_mapping(
        F.when(F.col("dataset_id") % 17 != 0, text).otherwise("{'broken")))


MISSING = " UNION ALL ".join(f"SELECT '{k}' AS field, m_{k} AS m, quality_score FROM stq" for k in FOUND)


@query("b18_missing_fields", f"""
WITH {STORED}, u AS ({MISSING}) SELECT field, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ql), 6) AS percentage
FROM u WHERE m IS NULL GROUP BY 1""", CATALOG)
def b18(t):
    return K.missing_fields(stored(t))


@query("b18_missing_fields_below_75", f"""
WITH {STORED}, u AS ({MISSING}) SELECT field, count(*) AS n,
 round(100.0 * count(*) / (SELECT count(*) FROM ql WHERE quality_score < 75), 6) AS percentage FROM u WHERE m IS NULL AND quality_score < 75 GROUP BY 1""", CATALOG)
def b18_low(t):
    return K.missing_fields(stored(t), max_score=75.0)


@query("b19_score_distribution", f"""
WITH {STORED} SELECT round(quality_score, 6) AS quality_score, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ql), 6) AS percentage
FROM stq GROUP BY quality_score""", CATALOG)
def b19(t):
    return K.score_distribution(stored(t))


@query("b20_missing_combinations", f"""
WITH {STORED}, cb AS (SELECT CASE WHEN quality_score BETWEEN 87.5 AND 100 THEN '87.5-100' WHEN quality_score BETWEEN 62.5 AND 75 THEN '62.5-75'
  WHEN quality_score BETWEEN 37.5 AND 50 THEN '37.5-50' WHEN quality_score BETWEEN 12.5 AND 25 THEN '12.5-25' END AS band,
  concat_ws(',', {', '.join(f"CASE WHEN m_{k} IS NULL THEN '{k}' END" for k in sorted(FOUND))}) AS missing FROM stq),
 g AS (SELECT band, missing, count(*) AS n FROM cb WHERE band IS NOT NULL GROUP BY 1, 2),
 h AS (SELECT *, sum(n) OVER (PARTITION BY band) AS total FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY n DESC, missing) AS rank FROM h WHERE missing <> '')
SELECT band, rank, missing, n, round(100.0 * n / total, 6) AS percentage FROM r WHERE rank <= 5""", CATALOG)
def b20(t):
    return K.missing_combinations(stored(t))

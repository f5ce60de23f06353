"""Standardising, merging, checking, imputing and deduplicating on the source and incident views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C, rules, text as X
from ..operators import clean, dedupe, impute, incidents as I, keywords, merge, shapes, unify as U
from .registry import query

INC = ("v_incidents",)
DT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def located(t):
    """The incident view under source-like column names."""
    return t.v_incidents.select(
        F.col("incident_id").alias("case_number"), F.col("combined_date").alias("incident_date"),
        F.col("combined_time").alias("incident_time"), F.col("primary_type"), F.col("location_description"),
        F.col("source_city").alias("city"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


@query("c01_find_column", """
SELECT 'datetime' AS wanted, 'occurred_date' AS found, count(occurred_date) AS present FROM v_source_a
UNION ALL SELECT 'arrest', 'arrest_flag', count(arrest_flag) FROM v_source_a
UNION ALL SELECT 'offense_code', 'offense', count(offense) FROM v_source_a""", ("v_source_a",))
def c01(t):
    a = t.v_source_a
    wanted = {"datetime": rules.DATETIME, "arrest": ["arrest"], "offense_code": ["offense_code"]}
    parts = [a.agg(F.lit(w).alias("wanted"), F.lit(C.find_first(a.columns, c)).alias("found"),
                   F.count(C.find_first(a.columns, c)).alias("present")) for w, c in wanted.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("c02_extract_values", """
SELECT CAST(case_number AS VARCHAR) AS id_text, CAST(case_number AS DOUBLE) AS id_number, CAST(NULL AS DOUBLE) AS no_number,
 arrest_flag = 'Y' AS flag, false AS no_flag, CAST(NULL AS VARCHAR) AS no_text FROM v_source_a""", ("v_source_a",))
def c02(t):
    a = t.v_source_a
    n = a.columns
    return a.select(clean.extract_text(n, ["case_number"]).alias("id_text"),
                    clean.extract_number(n, ["case_number"]).alias("id_number"),
                    clean.extract_number(n, ["offense"]).alias("no_number"),
                    clean.extract_flag(n, ["arrest"]).alias("flag"), clean.extract_flag(n, ["domestic"]).alias("no_flag"),
                    clean.extract_text(n, ["zip"]).alias("no_text"))


@query("c03_generated_ids", """
SELECT o_orderkey, 'GEN_' || lpad(CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR), 8, '0') AS incident_id FROM orders""")
def c03(t):
    return clean.with_incident_id(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderkey"], name="incident_id").drop("o_orderdate")


@query("c04_date_and_clock", f"""
SELECT incident_id AS case_number, {DT.format("CAST(CAST(combined_date AS VARCHAR) || ' ' || combined_time AS TIMESTAMP)")} AS datetime
FROM v_incidents""", INC)
def c04(t):
    df = located(t).withColumn("incident_date", F.date_format("incident_date", "MM/dd/yyyy"))
    return df.select("case_number", clean.incident_datetime(df.columns, ["MM/dd/yyyy"]).alias("datetime"))


STD = """CAST(year(dt) AS BIGINT) AS year, month(dt) AS month, dayname(dt) AS day_of_week, hour(dt) AS hour"""


@query("c05_datetime_parts", f"""
WITH d AS (SELECT id, CAST(datetime AS TIMESTAMP) AS dt FROM v_source_b)
SELECT CAST(id AS VARCHAR) AS incident_id, CAST(CAST(dt AS DATE) AS VARCHAR) AS date, strftime(dt, '%H:%M:%S') AS time, {STD} FROM d""",
       ("v_source_b",))
def c05(t):
    return clean.standardize(t.v_source_b).select("incident_id", "date", "time", "year", "month", "day_of_week", "hour")


@query("c06_location_fields", """
SELECT CAST(incident_id AS VARCHAR) AS incident_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
 location_description AS address, source_city AS city, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS zip_code
FROM v_incidents""", INC)
def c06(t):
    return clean.standardize(located(t)).select("incident_id", *rules.NUMERIC_FIELDS, *rules.LOCATION_FIELDS)


@query("c07_type_fields", """
SELECT CAST(case_number AS VARCHAR) AS incident_id, offense AS crime_type, offense AS crime_description, offense AS ucr_code
FROM v_source_a""", ("v_source_a",))
def c07(t):
    return clean.standardize(t.v_source_a).select("incident_id", *rules.TYPE_FIELDS)


@query("c07b_division_fields", """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey AS incident_id, CAST(l_suppkey AS VARCHAR) AS beat,
 l_returnflag AS district, CAST(NULL AS VARCHAR) AS ward, l_linestatus AS community_area, CAST(NULL AS VARCHAR) AS location_type,
 l_returnflag = 'Y' AS arrest_made, l_tax > 0.05 AS domestic FROM lineitem""")
def c07b(t):
    df = t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("case_number"), F.col("l_suppkey").alias("Sector"),
        F.col("l_returnflag").alias("Precinct"), F.col("l_linestatus").alias("neighborhood_name"),
        F.col("l_returnflag").alias("arrested"), F.when(F.col("l_tax") > 0.05, "Yes").otherwise("No").alias("FAMILY"))
    return clean.standardize(df).select("incident_id", *rules.DIVISION_FIELDS, *rules.FLAG_FIELDS)


@query("c08_keyword_category", """
SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'widget') THEN 'ROUND'
 WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'gear') OR contains(lower(p_name), 'red') THEN 'METAL'
 ELSE 'OTHER' END AS category FROM part""")
def c08(t):
    kinds = {"ROUND": ["ring", "widget"], "METAL": ["bolt", "gear", "red"]}
    return t.part.select("p_partkey", X.first_matching_category(F.col("p_name"), kinds).alias("category"))


@query("c08_default_category_of_texts", """
SELECT doc_id, CASE
 WHEN regexp_matches(lower(text), 'murder|homicide|assault|battery|robbery|rape|kidnapping') THEN 'VIOLENT'
 WHEN regexp_matches(lower(text), 'burglary|theft|larceny|motor vehicle|arson|shoplifting') THEN 'PROPERTY'
 WHEN regexp_matches(lower(text), 'narcotics|drug|possession|trafficking|marijuana|cocaine') THEN 'DRUG'
 WHEN regexp_matches(lower(text), 'weapon|firearm|gun|concealed carry|armed') THEN 'WEAPON'
 WHEN regexp_matches(lower(text), 'fraud|forgery|counterfeiting|embezzlement|identity') THEN 'FRAUD'
 WHEN regexp_matches(lower(text), 'sex offense|prostitution|indecent|sexual') THEN 'SEX_OFFENSE'
 WHEN regexp_matches(lower(text), 'disorderly|vandalism|trespass|disturbing|loitering') THEN 'PUBLIC_ORDER'
 ELSE 'OTHER' END AS category FROM documents""")
def c08_default(t):
    return t.documents.select("doc_id", X.first_matching_category(F.col("text"), rules.INCIDENT_CATEGORIES).alias("category"))


def slashed_sql(first: int, second: int) -> str:
    """Values like 99/99/9999 less the more frequent of the two faults: a first or second group beyond its limit, or zero."""
    def wrong(group: int, limit: int) -> str:
        part = f"TRY_CAST(regexp_extract(v, '^([0-9][0-9])/([0-9][0-9])/', {group}) AS INT)"
        return f"count(*) FILTER (regexp_matches(v, '^[0-9][0-9]/[0-9][0-9]/[0-9]{{4}}$') AND ({part} > {limit} OR {part} = 0))"

    return f"count(*) FILTER (regexp_matches(v, '^[0-9][0-9]/[0-9][0-9]/[0-9]{{4}}$')) - greatest({wrong(1, first)}, {wrong(2, second)})"


@query("c04_format_of_a_source", f"""
WITH u AS (SELECT 'us' AS c, trim(us) AS v FROM v_dates UNION ALL SELECT 'mixed', trim(mixed) FROM v_dates UNION ALL SELECT 'words', trim(words) FROM v_dates),
s AS (SELECT c, count(*) AS n, count(*) FILTER (regexp_matches(v, '^[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]$')) AS iso, {slashed_sql(12, 31)} AS mdy, {slashed_sql(31, 12)} AS dmy FROM u WHERE v <> '' GROUP BY 1),
f AS (SELECT c, n, unnest(['yyyy-MM-dd', 'MM/dd/yyyy', 'dd/MM/yyyy']) AS fmt, unnest([0, 1, 2]) AS k, unnest([iso, mdy, dmy]) AS fits FROM s)
SELECT c AS "column", CASE WHEN fits > 0 THEN fmt END AS format, CAST(fits AS BIGINT) AS fits, n, round(fits / n, 6) AS share FROM f
QUALIFY row_number() OVER (PARTITION BY c ORDER BY fits DESC, k) = 1""", ("v_dates",))
def c04_formats(t):
    return shapes.best_formats(t.v_dates, ["us", "mixed", "words"], ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy"])


RULES_SQL = """k AS (SELECT lower(keyword) AS keyword, arg_min(category, position) AS category, min(position) AS position FROM v_keywords WHERE length(keyword) > 0 GROUP BY 1),
 m AS (SELECT page_id, k.category, k.position, k.keyword FROM pages JOIN k ON contains(lower(html), k.keyword))"""


@query("c08_categories_of_a_table", f"""
WITH {RULES_SQL}, f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY position, category, keyword) = 1)
SELECT page_id, CASE WHEN html IS NULL THEN 'UNKNOWN' ELSE coalesce(f.category, 'OTHER') END AS category FROM pages LEFT JOIN f USING (page_id)""", ("v_keywords",))
def c08_table(t):
    return keywords.first_category(t.pages, t.v_keywords, F.col("html")).select("page_id", "category")


@query("b05_keywords_of_a_table", f"""
WITH {RULES_SQL}, f AS (SELECT page_id, string_agg(keyword, ' ' ORDER BY position, category, keyword) AS keywords FROM m GROUP BY 1)
SELECT page_id, coalesce(keywords, '') AS keywords FROM pages LEFT JOIN f USING (page_id)""", ("v_keywords",))
def b05_table(t):
    found = keywords.keyword_hits(t.pages, t.v_keywords, F.col("html"))
    return found.select("page_id", F.array_join("keywords", " ").alias("keywords"))


SCORE_LOC = """CASE WHEN combined_time IS NULL THEN 0 ELSE 15 END + CASE WHEN latitude IS NULL THEN 0 ELSE 15 END
 + CASE WHEN longitude IS NULL THEN 0 ELSE 15 END + CASE WHEN primary_type IS NULL THEN 0 ELSE 15 END + 20"""


@query("c09_quality_score", f"""
SELECT CAST(incident_id AS VARCHAR) AS incident_id, CAST({SCORE_LOC} + CASE WHEN location_description IS NULL THEN 0 ELSE 10 END AS DOUBLE)
 AS data_quality_score FROM v_incidents""", INC)
def c09(t):
    # address and description both resolve to location_description, the arrest flag defaults to False
    return clean.standardize(located(t)).select("incident_id", "data_quality_score")


@query("c10_fill_from_gazetteer", """
WITH g AS (SELECT location_description || ', ' || source_city || ', IL' AS place, min(latitude) AS glat, min(longitude) AS glon
  FROM v_incidents WHERE latitude > 40 AND longitude < -80 GROUP BY 1)
SELECT incident_id, round(CASE WHEN latitude IS NULL OR longitude IS NULL THEN coalesce(glat, latitude) ELSE latitude END, 6) AS latitude,
 round(CASE WHEN latitude IS NULL OR longitude IS NULL THEN coalesce(glon, longitude) ELSE longitude END, 6) AS longitude
FROM v_incidents LEFT JOIN g ON place = location_description || ', ' || source_city || ', IL'""", INC)
def c10(t):
    df = t.v_incidents.select("incident_id", "latitude", "longitude", F.col("location_description").alias("address"),
                              F.col("source_city").alias("city"), F.lit("IL").alias("state"))
    places = df.filter("latitude > 40 and longitude < -80").groupBy(
        F.concat_ws(", ", "address", "city", "state").alias("place")).agg(
        F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))
    # every place once more with one coordinate or none: such entries fill nothing
    holes = places.select("place", F.lit(None).cast("double").alias("latitude"), F.lit(-200.0).alias("longitude"))
    places = places.unionByName(holes).unionByName(holes.withColumn("longitude", F.lit(None).cast("double")))
    return clean.fill_from_gazetteer(df, places).select("incident_id", "latitude", "longitude")


def jaccard_sql(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


PLAIN_SQL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
GRAMS_SQL = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substr('||' || {0} || '||', i, 3)))"


@query("c10_fill_from_similar", f"""
WITH d AS (SELECT *, {PLAIN_SQL.format('address')} AS a FROM v_addresses),
l AS (SELECT a, {GRAMS_SQL.format('a')} AS ga FROM (SELECT DISTINCT a FROM d WHERE latitude IS NULL AND a <> '')),
g AS (SELECT {PLAIN_SQL.format('place')} AS b, min(place) AS place, min(row(latitude, longitude)) AS pos FROM v_streets GROUP BY 1),
r AS (SELECT *, {GRAMS_SQL.format('b')} AS gb FROM g WHERE b <> ''),
s AS (SELECT a, b, place, pos, {jaccard_sql('ga', 'gb')} AS similarity FROM l, r WHERE {jaccard_sql('ga', 'gb')} >= 0.6),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) = 1)
SELECT address_id, round(CASE WHEN d.latitude IS NULL THEN pos[1] ELSE d.latitude END, 6) AS latitude, place, round(similarity, 6) AS similarity
FROM d LEFT JOIN m ON m.a = d.a AND d.latitude IS NULL""", ("v_addresses", "v_streets"))
def c10_similar(t):
    df = t.v_addresses.withColumns({"city": F.lit(None).cast("string"), "state": F.lit(None).cast("string")})
    return clean.fill_from_similar(df, t.v_streets).select("address_id", "latitude", "place", "similarity")


NONE = "CAST(NULL AS VARCHAR)"
STD_A = f"""sa AS (SELECT CAST(case_number AS VARCHAR) AS incident_id, CAST(occurred_date AS TIMESTAMP) AS dt, CAST(NULL AS VARCHAR) AS address,
  offense AS crime_type, CASE WHEN contains(lower(offense), 'armed') THEN 'WEAPON' ELSE 'OTHER' END AS crime_category,
  offense AS crime_description, offense AS ucr_code, arrest_flag = 'Y' AS arrest_made, CAST(NULL AS VARCHAR) AS location_type,
  'A' AS source_name, 15 + 15 + 10 + 10.0 AS score FROM v_source_a)"""
STD_B = f"""sb AS (SELECT CAST(id AS VARCHAR) AS incident_id, CAST(datetime AS TIMESTAMP) AS dt, location AS address, category AS crime_type,
  'OTHER' AS crime_category, description AS crime_description, CAST(NULL AS VARCHAR) AS ucr_code, false AS arrest_made,
  description AS location_type, 'B' AS source_name, 15 + 15 + 10 + 10 + 10.0 AS score FROM v_source_b)"""
STD_OUT = f"""incident_id, CAST(CAST(dt AS DATE) AS VARCHAR) AS date, strftime(dt, '%H:%M:%S') AS time, {DT.format('dt')} AS datetime, {STD},
 CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, address, {NONE} AS city, {NONE} AS state, {NONE} AS zip_code,
 crime_type, crime_category, crime_description, ucr_code, arrest_made, false AS domestic, {NONE} AS beat, {NONE} AS district, {NONE} AS ward,
 {NONE} AS community_area, location_type, source_name, {NONE} AS source_url, CAST(score AS DOUBLE) AS data_quality_score"""
AB = ("v_source_a", "v_source_b")


@query("c11_standardize_a", f"WITH {STD_A} SELECT {STD_OUT} FROM sa", AB[:1])
def c11_a(t):
    return clean.standardize(t.v_source_a, "A")


@query("c11_standardize_b", f"WITH {STD_B} SELECT {STD_OUT} FROM sb", AB[1:])
def c11_b(t):
    return clean.standardize(t.v_source_b, "B")


UNIFIED = f"""{STD_A}, {STD_B}, un AS (SELECT * FROM (SELECT * FROM sa UNION ALL SELECT * FROM sb)
  QUALIFY row_number() OVER (PARTITION BY dt, crime_type ORDER BY source_name, incident_id) = 1)"""


@query("c12_unify", f"WITH {UNIFIED} SELECT {STD_OUT} FROM un", AB)
def c12(t):
    return U.unify([(t.v_source_a, "A"), (t.v_source_b, "B")])


@query("c13_unified_summary", f"""
WITH {UNIFIED} SELECT count(*) AS total, {DT.format('min(dt)')} AS first, {DT.format('max(dt)')} AS last, CAST(0 AS BIGINT) AS cities,
 count(DISTINCT source_name) AS sources, round(avg(score), 6) AS mean_quality, CAST(0 AS DOUBLE) AS latitude_complete, CAST(0 AS DOUBLE) AS longitude_complete,
 round(100.0 * count(address) / count(*), 6) AS address_complete, CAST(100 AS DOUBLE) AS arrest_made_complete FROM un""", AB)
def c13(t):
    return U.unified_summary(U.unify([(t.v_source_a, "A"), (t.v_source_b, "B")], ordered=False))


@query("c13_category_distribution", f"""
WITH {UNIFIED} SELECT crime_category AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM un), 6) AS percentage
FROM un GROUP BY 1""", AB)
def c13_categories(t):
    return U.category_distribution(U.unify([(t.v_source_a, "A"), (t.v_source_b, "B")], ordered=False))


DATES = """d AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS a,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) + CAST(event_id % 3 AS INT) - 1 AS TIMESTAMP) END AS b FROM events),
 e AS (SELECT event_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a < b THEN a ELSE b END AS m FROM d)"""


def dated(t):
    moved = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 3).cast("int") - 1)
    return t.events.select(
        "event_id", F.concat(F.lit("mood "), F.col("event_id") % 5).alias("sentiment"), F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("event_timestamp"),
        F.when(F.col("event_id") % 7 == 0, "not known").otherwise(moved.cast("string")).alias("Report Date"),
        F.col("user_id").alias("update_count"))


@query("c14_earliest_date", f"""
WITH {DATES} SELECT e.event_id, CAST(CAST(m AS DATE) AS VARCHAR) AS combined_date, CASE WHEN m <> date_trunc('day', m) THEN strftime(m, '%H:%M:%S') END AS combined_time,
 'mood ' || e.event_id % 5 AS sentiment, 'mood ' || e.event_id % 5 AS runtime, user_id AS update_count FROM e JOIN events ON events.event_id = e.event_id""")
def c14(t):
    # update_count and runtime match by name, but numbers are no dates and no runtime can be read: both stay
    return merge.combine_dates(dated(t).withColumn("runtime", F.col("sentiment")))


@query("c15_separate_coordinates", """
SELECT incident_id AS case_number, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM v_incidents
WHERE latitude <> 0 AND longitude <> 0 AND incident_id % 29 <> 0""", INC)
def c15(t):
    # some coordinates are text that says NaN
    df = located(t).select("case_number", F.when(F.col("case_number") % 29 == 0, "NaN").otherwise(F.col("lat").cast("string")).alias("lat"), "lon")
    return merge.extract_coordinates(df).select("case_number", "latitude", "longitude")


JSON_XY = """xy AS (SELECT id, CAST(json_extract_string(location, '$.latitude') AS DOUBLE) AS latitude,
 CAST(coalesce(json_extract_string(location, '$.longitude'), json_extract_string(location, '$.lng')) AS DOUBLE) AS longitude,
 category, description, location, CAST(datetime AS TIMESTAMP) AS m FROM v_source_b)"""


@query("c16_object_coordinates", f"""
WITH {JSON_XY} SELECT id, latitude, longitude FROM xy WHERE latitude <> 0 AND longitude <> 0 AND id % 29 <> 0""", AB[1:])
def c16(t):
    df = t.v_source_b.withColumn("location", F.when(F.col("id") % 29 == 0, '{"latitude": "NaN", "longitude": "1"}').otherwise(F.col("location")))
    return merge.extract_coordinates(df).select("id", "latitude", "longitude")


@query("c18_report_order", """
SELECT source_city, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, CAST(combined_date AS VARCHAR) AS combined_date, combined_time,
 incident_id, location_description, primary_type, round(value, 6) AS value FROM v_incidents""", INC)
def c18(t):
    return C.reorder_columns(t.v_incidents)


COMBINED = f"""{JSON_XY}, cmb AS (
 SELECT 'alpha' AS source_city, latitude, longitude, incident_date AS combined_date, incident_time AS combined_time, case_number, NULL AS id,
  NULL AS category, NULL AS description, NULL AS location, primary_type FROM (
   SELECT latitude, longitude, CAST(combined_date AS VARCHAR) AS incident_date, CAST(NULL AS VARCHAR) AS incident_time, incident_id AS case_number,
    primary_type FROM v_incidents WHERE latitude <> 0 AND longitude <> 0)
 UNION ALL
 SELECT 'beta', latitude, longitude, CAST(CAST(m AS DATE) AS VARCHAR), CASE WHEN m <> date_trunc('day', m) THEN strftime(m, '%H:%M:%S') END,
  NULL, id, category, description, location, NULL FROM xy WHERE latitude <> 0 AND longitude <> 0)"""


def landed(t):
    a = located(t).select("case_number", "incident_date", "primary_type", F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"),
                          F.lit("alpha").alias("source_city"))
    return [a, t.v_source_b.withColumn("source_city", F.lit("beta")), t.v_source_a.withColumn("source_city", F.lit("gamma"))]


@query("c19_combine_datasets", f"""
WITH {COMBINED} SELECT source_city, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, combined_date, combined_time, case_number, id,
 category, description, location, primary_type FROM cmb""", ("v_incidents", "v_source_b"))
def c19(t):
    return merge.combine_datasets(landed(t))


@query("c19b_combined_summary", f"""
WITH {COMBINED} SELECT count(*) AS records, count(DISTINCT source_city) AS cities,
 'source_city, latitude, longitude, combined_date, combined_time, case_number, category, description, id, location, primary_type' AS columns FROM cmb""",
       ("v_incidents", "v_source_b"))
def c19b(t):
    return merge.combined_summary(merge.combine_datasets(landed(t)))


@query("c20_normalised_names", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def c20(t):
    return C.require_columns(C.normalise_names(t.customer.toDF(*[f" {c.upper()} " for c in t.customer.columns])), ["c_custkey"])


RANGES = """SELECT incident_id, round(CASE WHEN abs({y}) <= 90 THEN {y} END, 6) AS latitude,
 round(CASE WHEN abs({x}) <= 180 THEN {x} END, 6) AS longitude FROM {src}"""


@query("c22_range_check", RANGES.format(y="latitude", x="longitude", src="v_incidents"), INC)
def c22(t):
    return clean.validate_ranges(t.v_incidents, repair_swapped=False).select("incident_id", "latitude", "longitude")


@query("c23_swap_repair", "WITH s AS (SELECT incident_id, CASE WHEN abs(latitude) > 90 AND abs(longitude) <= 90 THEN longitude ELSE latitude END AS y, "
       "CASE WHEN abs(latitude) > 90 AND abs(longitude) <= 90 THEN latitude ELSE longitude END AS x FROM v_incidents) "
       + RANGES.format(y="y", x="x", src="s"), INC)
def c23(t):
    return clean.validate_ranges(t.v_incidents).select("incident_id", "latitude", "longitude")


DUP = ("v_incidents_dup",)
DUP_OUT = """incident_id, CAST(combined_date AS VARCHAR) AS combined_date, combined_time, primary_type, location_description, source_city,
 round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(value, 6) AS value"""


@query("c24_exact_duplicates", f"WITH d AS (SELECT DISTINCT * FROM v_incidents_dup) SELECT {DUP_OUT} FROM d", DUP)
def c24(t):
    return dedupe.drop_exact(t.v_incidents_dup)


@query("c25_near_duplicates", f"""
WITH d AS (SELECT * FROM v_incidents_dup QUALIFY row_number() OVER (PARTITION BY combined_date, combined_time, primary_type,
 round_even(latitude * 10000, 0), round_even(longitude * 10000, 0) ORDER BY incident_id) = 1) SELECT {DUP_OUT} FROM d""", DUP)
def c25(t):
    return dedupe.drop_near(t.v_incidents_dup, ["incident_id"], ["combined_date", "combined_time", "primary_type"])


CLOCK = "coalesce(combined_time, '12:00:00')"


def within_sql(km: float, seconds: int) -> str:
    """Ids of the first rows of groups joined by steps within a distance and a time; rows without a place stay."""
    dist = ("2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(a.latitude - b.latitude) / 2), 2)"
            " + cos(radians(a.latitude)) * cos(radians(b.latitude)) * power(sin(radians(a.longitude - b.longitude) / 2), 2))))")
    return f"""
WITH RECURSIVE p AS (SELECT *, epoch(CAST(combined_date AS TIMESTAMP)) + epoch(CAST({CLOCK} AS TIME)) AS s FROM v_incidents_dup),
e AS (SELECT a.incident_id AS u, b.incident_id AS v FROM p a JOIN p b ON a.primary_type IS NOT DISTINCT FROM b.primary_type AND abs(a.s - b.s) <= {seconds}
 AND abs(a.latitude - b.latitude) <= {km / 100} AND {dist} <= {km} WHERE abs(a.latitude) <= 90 AND abs(a.longitude) <= 180 AND abs(b.latitude) <= 90 AND abs(b.longitude) <= 180),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
g AS (SELECT u, min(v) AS first FROM r GROUP BY 1)
SELECT DISTINCT incident_id FROM p LEFT JOIN g ON g.u = incident_id WHERE first IS NULL OR first = incident_id"""


@query("c25_duplicates_within_distance", within_sql(2.0, 1800), DUP)
def c25_within(t):
    df = t.v_incidents_dup.withColumn("at", F.expr(f"to_timestamp(concat(cast(combined_date as string), ' ', {CLOCK}))"))
    return dedupe.drop_within(df, 2.0, 1800.0, ["incident_id"], ["primary_type"], "at").select("incident_id").distinct()


MODE = """p AS (SELECT incident_id, primary_type AS crime_type, CAST(substr(combined_time, 1, 2) AS BIGINT) AS hour,
  CASE WHEN incident_id % 13 <> 0 THEN dayname(combined_date) END AS day_of_week FROM v_incidents),
 mh AS (SELECT crime_type AS k, hour AS mode_h FROM (SELECT crime_type, hour, count(*) AS n FROM p WHERE hour IS NOT NULL AND crime_type IS NOT NULL
   GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY crime_type ORDER BY n DESC, hour) = 1),
 md AS (SELECT crime_type AS k, day_of_week AS mode_d FROM (SELECT crime_type, day_of_week, count(*) AS n FROM p
   WHERE day_of_week IS NOT NULL AND crime_type IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY crime_type ORDER BY n DESC, day_of_week) = 1)"""


def sparse(t):
    return I.add_date_parts(t.v_incidents).select(
        "incident_id", F.col("primary_type").alias("crime_type"), "hour",
        F.when(F.col("incident_id") % 13 != 0, F.col("day_of_week")).alias("day_of_week"))


@query("c26_impute_hour", f"""
WITH {MODE} SELECT incident_id, crime_type, coalesce(hour, mode_h) AS hour, day_of_week FROM p LEFT JOIN mh ON mh.k = crime_type""", INC)
def c26(t):
    return impute.impute_mode(sparse(t), ["hour"])


@query("c27_impute_weekday", f"""
WITH {MODE} SELECT incident_id, crime_type, hour, coalesce(day_of_week, mode_d) AS day_of_week FROM p LEFT JOIN md ON md.k = crime_type""", INC)
def c27(t):
    return impute.impute_mode(sparse(t), ["day_of_week"])


@query("c28_impute_rate", """
WITH p AS (SELECT incident_id, primary_type AS crime_category, CASE WHEN incident_id % 6 = 0 THEN NULL ELSE value > 20 END AS arrest_made FROM v_incidents),
 r AS (SELECT crime_category AS k, avg(CAST(arrest_made AS INT)) AS rate FROM p GROUP BY 1)
SELECT incident_id, crime_category,
 coalesce(arrest_made, CAST('0x' || substr(md5(incident_id || '|0'), 1, 8) AS BIGINT) / 4294967296.0 < rate) AS arrest_made
FROM p LEFT JOIN r ON k = crime_category""", INC)
def c28(t):
    df = t.v_incidents.select("incident_id", F.col("primary_type").alias("crime_category"),
                              F.when(F.col("incident_id") % 6 != 0, F.col("value") > 20).alias("arrest_made"))
    return impute.impute_rate(df)


FF = "last_value({c} IGNORE NULLS) OVER (PARTITION BY {p} ORDER BY incident_id ROWS UNBOUNDED PRECEDING)"


@query("c30_forward_fill", f"""
SELECT incident_id, {FF.format(c='primary_type', p='1')} AS primary_type, {FF.format(c='combined_time', p='1')} AS combined_time,
 round({FF.format(c='latitude', p='1')}, 6) AS latitude FROM v_incidents""", INC)
def c30(t):
    return impute.forward_fill(t.v_incidents.select("incident_id", "primary_type", "combined_time", "latitude"), ["incident_id"])


@query("c30_forward_fill_by_city", f"""
SELECT incident_id, source_city, {FF.format(c='primary_type', p='source_city')} AS primary_type,
 {FF.format(c='combined_time', p='source_city')} AS combined_time FROM v_incidents""", INC)
def c30_city(t):
    return impute.forward_fill(t.v_incidents.select("incident_id", "source_city", "primary_type", "combined_time"),
                               ["incident_id"], partition_by=["source_city"])


MEAN = """WITH m AS (SELECT avg(latitude) AS a, avg(longitude) AS b FROM v_incidents)
SELECT incident_id, round(coalesce(latitude, a), 6) AS latitude, round(coalesce(longitude, b), 6) AS longitude FROM v_incidents, m"""


@query("c31_impute_mean", MEAN, INC)
def c31(t):
    return impute.impute_mean(t.v_incidents.select("incident_id", "latitude", "longitude"), ["latitude", "longitude"])


@query("c32_impute_dispatch", MEAN, INC)
def c32(t):
    df = t.v_incidents.select("incident_id", "latitude", "longitude")
    return impute.impute(impute.impute(df, "no such method"), "mean", columns=["latitude", "longitude"])


KNN = """p AS (SELECT incident_id, latitude AS a, longitude AS b, CAST(substr(combined_time, 1, 2) AS DOUBLE) AS h FROM v_incidents),
 rec AS (SELECT * FROM p WHERE a IS NULL OR b IS NULL OR h IS NULL),
 d AS (SELECT r.incident_id, q.incident_id AS qid, q.a, q.b, q.h, CASE WHEN r.a IS NULL THEN 'ab' ELSE 'h' END AS part,
   (coalesce((r.a - q.a) * (r.a - q.a), 0) + coalesce((r.b - q.b) * (r.b - q.b), 0) + coalesce((r.h - q.h) * (r.h - q.h), 0))
   * (3.0::DOUBLE / (CAST(r.a + q.a IS NOT NULL AS INT) + CAST(r.b + q.b IS NOT NULL AS INT) + CAST(r.h + q.h IS NOT NULL AS INT))) AS dist
  FROM rec r JOIN p q ON ((r.a IS NULL AND r.h IS NOT NULL AND q.a IS NOT NULL AND q.h IS NOT NULL) OR (r.h IS NULL AND r.a IS NOT NULL AND q.h IS NOT NULL AND q.a IS NOT NULL))),
 near AS (SELECT incident_id, part, avg(a) AS a, avg(b) AS b, avg(h) AS h FROM (SELECT * FROM d
   QUALIFY row_number() OVER (PARTITION BY incident_id, part ORDER BY dist, qid) <= 5) GROUP BY 1, 2)"""


@query("c29_nearest_rows", f"""
WITH {KNN} SELECT p.incident_id, round(coalesce(p.a, n.a, (SELECT avg(a) FROM p)), 6) AS latitude,
 round(coalesce(p.b, n.b, (SELECT avg(b) FROM p)), 6) AS longitude, round(coalesce(p.h, n.h, (SELECT avg(h) FROM p)), 6) AS hour
FROM p LEFT JOIN near n ON n.incident_id = p.incident_id""", INC)
def c29(t):
    df = I.add_date_parts(t.v_incidents).select("incident_id", "latitude", "longitude", F.col("hour").cast("double").alias("hour"))
    return impute.impute(df, "knn", columns=["latitude", "longitude", "hour"])


WIDE = """p AS (SELECT event_id AS incident_id, CASE WHEN event_id % 3 = 0 THEN 41.88e0 WHEN event_id % 211 = 0 THEN 9000e0 ELSE 41.55e0 + ((event_id * 37) % 601) / 1000e0 END AS a,
  CASE WHEN event_id % 3 = 0 THEN -87.63e0 WHEN event_id % 17 = 0 THEN NULL ELSE -88.05e0 + ((event_id * 53) % 701) / 1000e0 END AS b,
  CASE WHEN event_id % 19 <> 0 THEN CAST((event_id * 29) % 12 AS DOUBLE) END AS m, CASE WHEN event_id % 5 <> 0 THEN CAST((event_id * 7) % 24 AS DOUBLE) END AS h,
  CASE WHEN event_id % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS w FROM events)"""
WIDE_COLUMNS = ["a", "b", "m", "h", "w"]
WIDE_DISTANCE = " + ".join(f"coalesce((r.{c} - q.{c}) * (r.{c} - q.{c}), 0)" for c in WIDE_COLUMNS)
WIDE_SHARED = " + ".join(f"CAST(r.{c} + q.{c} IS NOT NULL AS INT)" for c in WIDE_COLUMNS)


@query("c29_nearest_rows_wide", f"""
WITH {WIDE}, z AS (SELECT incident_id, a, b, m, h, CASE WHEN NOT isnan(w) THEN w END AS w FROM p),
 u AS (SELECT DISTINCT a, b, m, h, w FROM z WHERE b IS NULL OR m IS NULL OR h IS NULL OR w IS NULL),
 d AS (SELECT r.a AS ra, r.b AS rb, r.m AS rm, r.h AS rh, r.w AS rw, q.*, ({WIDE_DISTANCE}) * (5.0::DOUBLE / ({WIDE_SHARED})) AS dist FROM u r JOIN z q
   ON ({WIDE_SHARED}) > 0 AND ((r.b IS NULL AND q.b IS NOT NULL) OR (r.m IS NULL AND q.m IS NOT NULL) OR (r.h IS NULL AND q.h IS NOT NULL) OR (r.w IS NULL AND q.w IS NOT NULL))),
 {", ".join(f"n{c} AS (SELECT ra, rb, rm, rh, rw, avg({c}) AS {c} FROM (SELECT * FROM d WHERE r{c} IS NULL AND {c} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ra, rb, rm, rh, rw ORDER BY dist, incident_id) <= 5) GROUP BY ALL)" for c in WIDE_COLUMNS[1:])}
SELECT z.incident_id, round(z.a, 6) AS a, {", ".join(f"round(coalesce(z.{c}, n{c}.{c}, (SELECT avg({c}) FROM z)), 6) AS {c}" for c in WIDE_COLUMNS[1:])} FROM z
 {" ".join(f"LEFT JOIN n{c} ON " + " AND ".join(f"z.{x} IS NOT DISTINCT FROM n{c}.r{x}" for x in WIDE_COLUMNS) for c in WIDE_COLUMNS[1:])}""")
def c29_wide(t):
    """Five columns: a hot point with a third of the rows, far outliers, NaN, missing values in four of them."""
    e = F.col("event_id")
    df = t.events.select(
        e.alias("incident_id"),
        F.when(e % 3 == 0, 41.88).when(e % 211 == 0, 9000.0).otherwise(F.lit(41.55) + ((e * 37) % 601) / 1000.0).alias("a"),
        F.when(e % 3 == 0, -87.63).when(e % 17 == 0, None).otherwise(F.lit(-88.05) + ((e * 53) % 701) / 1000.0).alias("b"),
        F.when(e % 19 != 0, ((e * 29) % 12).cast("double")).alias("m"), F.when(e % 5 != 0, ((e * 7) % 24).cast("double")).alias("h"),
        F.when(e % 23 == 0, float("nan")).otherwise(F.col("value")).alias("w"))
    return impute.impute(df, "knn", columns=WIDE_COLUMNS)


COPIES = """ab AS (SELECT *, 'A' AS source_name FROM v_incidents UNION ALL SELECT *, 'B' FROM v_incidents_dup WHERE incident_id >= 1000000 OR incident_id % 40 = 3),
 st AS (SELECT CAST(incident_id AS VARCHAR) AS incident_id, CAST(CAST(combined_date AS VARCHAR) || ' ' || combined_time AS TIMESTAMP) AS dt, primary_type AS crime_type, source_city AS city,
  source_name, CASE WHEN abs(latitude) > 90 AND abs(longitude) <= 90 THEN longitude ELSE latitude END AS y, CASE WHEN abs(latitude) > 90 AND abs(longitude) <= 90 THEN latitude ELSE longitude END AS x,
  CAST(""" + SCORE_LOC + """ + CASE WHEN location_description IS NULL THEN 0 ELSE 10 END AS DOUBLE) AS score FROM ab),
 ok AS (SELECT incident_id, dt, crime_type, city, source_name, CASE WHEN abs(y) <= 90 THEN y END AS y, CASE WHEN abs(x) <= 180 THEN x END AS x, score, hour(dt) AS h, dayname(dt) AS d FROM st),
 hm AS (SELECT crime_type AS k, h AS mh FROM (SELECT crime_type, h, count(*) AS n FROM ok WHERE h IS NOT NULL AND crime_type IS NOT NULL GROUP BY 1, 2)
   QUALIFY row_number() OVER (PARTITION BY crime_type ORDER BY n DESC, h) = 1),
 dm AS (SELECT crime_type AS k, d AS md FROM (SELECT crime_type, d, count(*) AS n FROM ok WHERE d IS NOT NULL AND crime_type IS NOT NULL GROUP BY 1, 2)
   QUALIFY row_number() OVER (PARTITION BY crime_type ORDER BY n DESC, d) = 1),
 full_t AS (SELECT incident_id, source_name, dt, coalesce(h, mh) AS hour, coalesce(d, md) AS day_of_week, y, x, city, crime_type, score FROM ok LEFT JOIN hm ON hm.k = crime_type LEFT JOIN dm ON dm.k = crime_type
   QUALIFY row_number() OVER (PARTITION BY dt, crime_type, round_even(y * 10000, 0), round_even(x * 10000, 0) ORDER BY source_name, incident_id) = 1)"""


def copies(t):
    """Two sources with coordinates, swapped and out-of-range ones among them, missing times, exact and near copies."""
    b = t.v_incidents_dup.filter("incident_id >= 1000000 or (incident_id % 40 = 3)").dropDuplicates()
    named = [F.col("incident_id").alias("case_number"), F.col("combined_date").alias("incident_date"), F.col("combined_time").alias("incident_time"), F.col("primary_type"),
             F.col("location_description"), F.col("source_city").alias("city"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")]
    return U.unify([(located(t), "A"), (b.select(*named), "B")])


@query("c12_unify_located", f"""
WITH {COPIES.replace("FROM v_incidents_dup WHERE", "FROM (SELECT DISTINCT * FROM v_incidents_dup) WHERE")} SELECT incident_id, source_name, {DT.format('dt')} AS datetime, hour, day_of_week, round(y, 6) AS latitude, round(x, 6) AS longitude, city, crime_type,
 score AS data_quality_score FROM full_t""", ("v_incidents", "v_incidents_dup"))
def c12_located(t):
    return copies(t).select("incident_id", "source_name", "datetime", "hour", "day_of_week", "latitude", "longitude", "city", "crime_type", "data_quality_score")


@query("c13_summary_located", f"""
WITH {COPIES.replace("FROM v_incidents_dup WHERE", "FROM (SELECT DISTINCT * FROM v_incidents_dup) WHERE")} SELECT count(*) AS total, {DT.format('min(dt)')} AS first, {DT.format('max(dt)')} AS last, count(DISTINCT city) AS cities,
 count(DISTINCT source_name) AS sources, round(avg(score), 6) AS mean_quality, round(100.0 * count(y) / count(*), 6) AS latitude_complete, round(100.0 * count(x) / count(*), 6) AS longitude_complete,
 CAST(100 AS DOUBLE) AS address_complete, CAST(100 AS DOUBLE) AS arrest_made_complete FROM full_t""", ("v_incidents", "v_incidents_dup"))
def c13_located(t):
    return U.unified_summary(copies(t))


@query("c19b_sample_rows", f"""
WITH {COMBINED} SELECT source_city, case_number, id, combined_date FROM cmb ORDER BY source_city, case_number, id LIMIT 5""", ("v_incidents", "v_source_b"))
def c19b_sample(t):
    return merge.sample_rows(merge.combine_datasets(landed(t)), ["source_city", "case_number", "id"], 5).select("source_city", "case_number", "id", "combined_date")


@query("c32_dispatch_smart", f"""
WITH {MODE} SELECT incident_id, crime_type, coalesce(hour, mode_h) AS hour, coalesce(day_of_week, mode_d) AS day_of_week
FROM p LEFT JOIN mh ON mh.k = crime_type LEFT JOIN md ON md.k = crime_type""", INC)
def c32_smart(t):
    return impute.impute(sparse(t))


@query("c32_dispatch_forward_fill", f"""
SELECT incident_id, {FF.format(c='primary_type', p='1')} AS primary_type, {FF.format(c='combined_time', p='1')} AS combined_time FROM v_incidents""", INC)
def c32_forward(t):
    return impute.impute(t.v_incidents.select("incident_id", "primary_type", "combined_time"), "forward_fill", order_by=["incident_id"])

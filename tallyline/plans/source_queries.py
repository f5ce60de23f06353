"""Readers, payload shapes, caps and sinks, fed with files and payloads written from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import incidents as I
from ..session import scratch_path
from ..sources import arrays, files, incremental, payloads as P
from .catalog_queries import CAT, catalog
from .incident_queries import AS_OF, DAILY, DESCRIBE_SQL, DLY, MCUBE, PREP, prep
from .registry import query
from .report import statistics_report

INC, CATALOG = ("v_incidents",), ("v_catalog",)
INC_OUT = """incident_id, CAST(combined_date AS VARCHAR) AS combined_date, combined_time, primary_type, location_description, source_city,
 round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(value, 6) AS value"""


def csv_of(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "csv")
    files.write_csv(df, path)
    return path


@query("a01_read_incidents", f"SELECT {INC_OUT} FROM v_incidents", INC)
def a01(t):
    return files.read_incidents(t.spark, csv_of(t.v_incidents), t.v_incidents.schema)


@query("a01b_read_points", """
SELECT incident_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM v_incidents
WHERE latitude BETWEEN 41.6 AND 42.1 AND longitude BETWEEN -88.0 AND -87.4""", INC)
def a01b(t):
    df = t.v_incidents
    return files.read_points(t.spark, csv_of(df), df.schema).select("incident_id", "latitude", "longitude")


@query("a02_read_landed", """
SELECT 'orders' AS dataset_name, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS offense, CAST(NULL AS VARCHAR) AS category FROM orders
UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), NULL, event_type FROM events""")
def a02(t):
    a = t.orders.select(F.lit("orders").alias("dataset_name"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("offense"))
    b = t.events.select(F.lit("events").alias("dataset_name"), F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("category"))
    path = scratch_path(t.spark, "landed")
    files.write_json(a, f"{path}/orders")
    files.write_json(b, f"{path}/events")
    return files.read_landed(t.spark, f"{path}/*").select("dataset_name", "key", "offense", "category")


@query("a02_read_large_array", """
SELECT CAST(event_id AS BIGINT) AS id, concat(event_type, '"]},{[', props, chr(92)) AS note, [event_id, user_id] AS pair FROM events""")
def a02_array(t):
    """Arrays of 5,000 records, with brackets, quotes and backslashes in their texts, read in ranges of 20,000 bytes."""
    made = t.events.select(F.struct(F.col("event_id").alias("id"), F.concat("event_type", F.lit('"]},{['), "props", F.lit("\\")).alias("note"), F.array("event_id", "user_id").alias("pair")).alias("r"))
    text = made.select(F.to_json("r").alias("r"), F.floor(F.col("r.id") / 5000).alias("part")).groupBy("part").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value")).select("value")
    path = scratch_path(t.spark, "array")
    text.write.text(path)
    return arrays.read_json_array(t.spark, f"{path}/*.txt", "id long, note string, pair array<long>", 20_000)


@query("a11_incremental_cube", f"""
WITH {MCUBE} SELECT CAST(month_year AS VARCHAR) AS month_year, crime_type, city, location_type, n FROM mc""", DLY)
def a11_cube(t):
    """The daily incidents landed in three batches, one of them twice."""
    folder, rows = scratch_path(t.spark, "incremental"), t.v_daily
    for name, part in (("first", "incident_id % 3 = 0"), ("second", "incident_id % 3 = 1"), ("first", "incident_id % 3 = 0"), ("third", "incident_id % 3 = 2")):
        incremental.land(rows.filter(part), name, folder)
    return incremental.cube(t.spark, folder)


def listings(t) -> DataFrame:
    """Catalog rows as portal payloads of four shapes, every 19th without id, and payloads that hold no dataset."""
    c = catalog(t)
    ident = F.when(F.col("dataset_id") % 19 == 0, "").otherwise(F.col("dataset_id").cast("string"))
    flat = F.struct(ident.alias("identifier"), F.col("name").alias("title"), "description")
    nested = F.struct(F.struct(ident.alias("id"), "name", "description").alias("resource"))
    plain = F.struct(ident.alias("id"), "name", "description")
    k = F.col("dataset_id") % 4
    payload = (F.when(k == 0, F.to_json(F.struct(F.array(nested).alias("results"))))
               .when(k == 1, F.to_json(F.struct(F.array(flat).alias("dataset"))))
               .when(k == 2, F.to_json(plain)).otherwise(F.to_json(F.array(flat))))
    good = c.select("domain", payload.alias("payload"))
    broken = [good.select("domain", F.lit(x).alias("payload")).distinct() for x in ("<html>", '{"error": "no such page", "code": 7}', '[{"error": 1}, {}]', "", None)]
    return reduce(DataFrame.unionByName, [good, *[b.select("domain", F.col("payload").cast("string").alias("payload")) for b in broken]])


@query("a03_normalise_catalog", f"""
WITH {CAT}, i AS (SELECT *, CASE WHEN dataset_id % 19 = 0 THEN '' ELSE CAST(dataset_id AS VARCHAR) END AS ident FROM cat)
SELECT domain, ident AS dataset_id, name, description, 'https://' || domain || CASE WHEN ident = '' THEN '' ELSE '/d/' || ident END AS url FROM i""", CATALOG)
def a03(t):
    return P.normalise_catalog(listings(t))


@query("a04_catalog_metadata", f"""
WITH {CAT} SELECT CAST(dataset_id AS VARCHAR) AS id, name, domain, 'https://' || domain || '/d/' || dataset_id AS link, description, CAST(0 AS BIGINT) AS n_columns FROM cat""", CATALOG)
def a04(t):
    path = scratch_path(t.spark, "metadata")
    files.write_metadata(catalog(t).select(F.col("dataset_id").cast("string").alias("id"), "name", "domain", F.col("dataset_url").alias("link"), "description"), path)
    return files.read_metadata(t.spark, path).withColumn("n_columns", F.size("columns")).drop("columns")


@query("a04b_enriched_record", """
WITH f AS (SELECT *, contains(columns_text, 'latitude') AS la, contains(columns_text, 'longitude') AS lo FROM v_catalog)
SELECT dataset_id, columns_text AS original_columns, columns_text || '|source_city|source_url|dataset_name' AS all_columns, la AS has_coordinates,
 CASE WHEN la THEN 'latitude' WHEN contains(columns_text, 'primary_type') THEN 'primary_type' ELSE 'source_city' END AS lat_col,
 CASE WHEN lo THEN 'longitude' END AS long_col, CASE WHEN lo THEN 'separate_columns' ELSE 'none' END AS coordinate_type FROM f""", CATALOG)
def a04b(t):
    # 'source_city' holds a 'y', which the key list takes for a latitude
    return P.enrich_record(catalog(t)).select(
        "dataset_id", F.array_join("original_columns", "|").alias("original_columns"), F.array_join("all_columns", "|").alias("all_columns"),
        "has_coordinates", "lat_col", "long_col", "coordinate_type")


def point_payloads(t) -> DataFrame:
    entry = F.struct(F.col("combined_date").cast("string").alias("date"), F.col("primary_type").alias("type"), F.col("location_description").alias("address"),
                     F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("incident_id").cast("string").alias("cdid"))
    two = F.when(F.col("incident_id") % 2 == 0, F.array(entry, entry)).otherwise(F.array(entry))
    return t.v_incidents.select("source_city", F.to_json(F.struct(two.alias("crimes"))).alias("payload"))


POINTS = """pts AS (SELECT source_city, CAST(combined_date AS VARCHAR) AS date, primary_type AS type, location_description AS address, latitude, longitude,
  CAST(incident_id AS VARCHAR) AS description FROM v_incidents UNION ALL
 SELECT source_city, CAST(combined_date AS VARCHAR), primary_type, location_description, latitude, longitude, CAST(incident_id AS VARCHAR)
 FROM v_incidents WHERE incident_id % 2 = 0)"""


@query("a05_flatten_points", f"""
WITH {POINTS} SELECT source_city, 'SpotCrime' AS source, date, type, address, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, description,
 CAST(NULL AS VARCHAR) AS link FROM pts""", INC)
def a05(t):
    return P.flatten_points(point_payloads(t))


def order_payloads(t) -> DataFrame:
    rec = F.array(F.struct("o_orderkey", "o_orderstatus"), F.struct((F.col("o_orderkey") + 1000000).alias("o_orderkey"), F.lit("X").alias("o_orderstatus")))
    none = F.col("o_orderkey") % 10 == 0
    return t.orders.select((F.col("o_custkey") % 5).alias("city"), F.when(none, "[]").otherwise(F.to_json(rec)).alias("payload"))


@query("a05b_nested_records", """
SELECT o_custkey % 5 AS city, 'Police Data Initiative' AS source, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey END AS k,
 CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus END AS s FROM orders
UNION ALL SELECT o_custkey % 5, 'Police Data Initiative', o_orderkey + 1000000, 'X' FROM orders WHERE o_orderkey % 10 <> 0""")
def a05b(t):
    nested = P.with_records(order_payloads(t), "struct<o_orderkey:bigint,o_orderstatus:string>")
    return P.explode_records(nested).select("city", "source", F.col("record.o_orderkey").alias("k"), F.col("record.o_orderstatus").alias("s"))


def endpoint_payloads(t) -> DataFrame:
    c = F.col("c_custkey").cast("string")
    kind = F.when(F.col("c_custkey") % 2 == 0, "offenses").otherwise("victims")
    return t.customer.select(c.alias("ori"), F.concat(F.lit("/nibrs/agencies/"), c, F.lit("/"), kind, F.lit("/count")).alias("endpoint"),
                             F.when(F.col("c_custkey") % 7 == 0, "[1]").otherwise(F.to_json(F.struct("c_mktsegment"))).alias("payload"))


@query("a05c_endpoint_rows", """
SELECT 'FBI NIBRS' AS source, CAST(c_custkey AS VARCHAR) AS ori, CASE WHEN c_custkey % 2 = 0 THEN 'offenses' ELSE 'victims' END AS kind,
 CASE WHEN c_custkey % 7 = 0 THEN '[1]' ELSE '{"c_mktsegment":"' || c_mktsegment || '"}' END AS data FROM customer""")
def a05c(t):
    return P.endpoint_rows(endpoint_payloads(t)).select("source", "ori", "kind", F.to_json("data").alias("data"))


def collected(t) -> DataFrame:
    points = P.tag_place(P.flatten_points(point_payloads(t)).drop("source_city"), F.lit("Chicago"), F.lit("IL"))
    agency = P.endpoint_rows(endpoint_payloads(t)).drop("data")
    nested = P.explode_records(P.with_records(order_payloads(t), "struct<o_orderkey:bigint,o_orderstatus:string>")).select(
        "source", F.col("city").cast("string").alias("city"), F.col("record.o_orderkey").cast("string").alias("description"))
    general = t.supplier.select(F.lit("Academic").alias("source"), F.col("s_name").alias("description"))
    return P.collect_sources([points, agency, nested, general])


@query("a06_collect_sources", f"""
WITH {POINTS} SELECT 'SpotCrime' AS source, 'Chicago' AS city, 'IL' AS state, description, CAST(NULL AS VARCHAR) AS ori FROM pts
UNION ALL SELECT 'FBI NIBRS', NULL, NULL, NULL, CAST(c_custkey AS VARCHAR) FROM customer
UNION ALL SELECT 'Police Data Initiative', CAST(o_custkey % 5 AS VARCHAR), NULL, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey AS VARCHAR) END, NULL FROM orders
UNION ALL SELECT 'Police Data Initiative', CAST(o_custkey % 5 AS VARCHAR), NULL, CAST(o_orderkey + 1000000 AS VARCHAR), NULL FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT 'Academic', NULL, NULL, s_name, NULL FROM supplier""", INC)
def a06(t):
    return collected(t).select("source", "city", "state", "description", "ori")


@query("a06_count_by_source", f"""
WITH {POINTS} SELECT 'SpotCrime' AS source, count(*) AS n FROM pts UNION ALL SELECT 'FBI NIBRS', count(*) FROM customer
UNION ALL SELECT 'Police Data Initiative', (SELECT count(*) FROM orders) + count(*) FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT 'Academic', count(*) FROM supplier""", INC)
def a06_counts(t):
    return P.count_by_source(collected(t))


@query("a07_result_sinks", """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def a07(t):
    df = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    path = scratch_path(t.spark, "parquet")
    files.write_parquet(files.read_csv(t.spark, csv_of(df), df.schema), path, partition_by=["o_orderstatus"])
    return t.spark.read.parquet(path)


REPORT_SQL = f"""
WITH {DAILY}, h AS (SELECT crime_type, count(*) AS n FROM v_daily GROUP BY 1), d AS ({DESCRIBE_SQL})
SELECT (SELECT count(*) FROM v_daily) AS total_records, mean, std, skewness,
 (SELECT round(sum(power(n / (SELECT sum(n) FROM h), 2)), 6) FROM h) AS type_herfindahl,
 (SELECT round(corr(n, p), 6) FROM (SELECT n, lag(n) OVER (ORDER BY combined_date) AS p FROM daily)) AS autocorr_lag1,
 (SELECT max(n) FROM daily) AS max_in_day,
 (SELECT count(*) FROM daily, (SELECT avg(n) AS m, stddev_pop(n) AS s FROM daily) WHERE abs((n - m) / s) > 3) AS z_outliers FROM d"""


def report(t) -> DataFrame:
    df = t.v_daily.withColumn("hour", F.lit(None).cast("int"))
    return statistics_report(df, "2001-12-31")


REPORT_FIELDS = ["basic.overview.total_records", "basic.daily.mean", "basic.daily.std", "basic.daily.skewness",
                 "concentration.crime_type_herfindahl.herfindahl_index AS type_herfindahl", "temporal.autocorrelation.autocorr_lag1",
                 "anomalies.extremes.max AS max_in_day", "anomalies.z_score.count AS z_outliers"]


@query("d25_statistics_report", REPORT_SQL, ("v_daily",))
def d25(t):
    return report(t).selectExpr(*REPORT_FIELDS)


@query("d25_incident_report", f"""
WITH {PREP} SELECT (SELECT count(*) FROM prep) AS total_records, (SELECT count(hour) FROM prep) AS records_with_time,
 (SELECT count(*) FILTER (latitude IS NULL OR longitude IS NULL) FROM prep) AS missing_coordinates,
 (SELECT count(DISTINCT location_type) FROM prep) AS locations, (SELECT count(*) FROM v_incidents WHERE combined_date > DATE '{AS_OF}') AS future_count""", INC)
def d25_incidents(t):
    return statistics_report(prep(t), AS_OF, I.parse_date(t.v_incidents)).selectExpr(
        "basic.overview.total_records", "diagnostics.times.records_with_time", "diagnostics.coordinates.missing_count AS missing_coordinates",
        "basic.overview.unique_location_types AS locations", "diagnostics.dates.future_count")


@query("a08_report_sink", REPORT_SQL, ("v_daily",))
def a08(t):
    path = scratch_path(t.spark, "report")
    files.write_report(report(t), path)
    return t.spark.read.json(path).selectExpr(*REPORT_FIELDS)


@query("a09_provenance", """
SELECT page_id, list_extract(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.'), 2) AS source_city, url AS source_url,
 'page ' || page_id AS dataset_name FROM pages""")
def a09(t):
    return P.add_provenance(t.pages, F.try_parse_url("url", F.lit("HOST")), F.col("url"), F.concat(F.lit("page "), "page_id")).select(
        "page_id", "source_city", "source_url", "dataset_name")


@query("a10_balanced_cap", f"""
WITH {CAT} SELECT domain, dataset_id FROM cat QUALIFY row_number() OVER (PARTITION BY domain ORDER BY dataset_id) <= 10""", CATALOG)
def a10(t):
    return P.balanced(catalog(t), 10).select("domain", "dataset_id")


@query("a10_records_per_dataset", """
SELECT o_custkey AS dataset_id, o_orderkey AS position FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5""")
def a10_records(t):
    return P.cap_records(t.orders.select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("position")), 5)


@query("a10_large_cap", """
SELECT l_linestatus AS dataset_id, l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= 2500""")
def a10_large(t):
    df = t.lineitem.select(F.col("l_linestatus").alias("dataset_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return P.cap_records(df, 2500, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("dataset_id", "l_orderkey", "l_linenumber", "l_partkey")


@query("a11_not_landed", "SELECT doc_id AS dataset_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a11(t):
    return P.not_landed(catalog(t), t.labels.withColumnRenamed("doc_id", "dataset_id")).select("dataset_id")


CITIES = "cities AS (SELECT n_name AS city, 'S' || n_regionkey AS state, n_nationkey * 1000 AS population, n_nationkey AS position FROM nation)"


def cities(t) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("city"), F.concat(F.lit("S"), "n_regionkey").alias("state"),
                           (F.col("n_nationkey") * 1000).alias("population"), F.col("n_nationkey").alias("position"))


@query("a12_city_subset", f"""
WITH {CITIES} SELECT 'first' AS how, city FROM cities WHERE position < 5 UNION ALL SELECT 'list', city FROM cities WHERE city IN ('NATION_3', 'NATION_17')
UNION ALL SELECT 'all', city FROM cities""")
def a12(t):
    c = cities(t)
    parts = {"first": P.city_subset(c, first=5), "list": P.city_subset(c, ["NATION_3", "NATION_17"]), "all": P.city_subset(c)}
    first, *rest = [d.select(F.lit(k).alias("how"), "city") for k, d in parts.items()]
    return first.union(rest[0]).union(rest[1])


@query("a12b_attach_city", f"""
WITH {CITIES} SELECT c_custkey, city, state, population FROM customer LEFT JOIN cities ON c_nationkey = position""")
def a12b(t):
    # every city has a smaller namesake elsewhere
    namesakes = cities(t).withColumns({"state": F.lit("S9"), "population": F.col("population") - 1})
    return P.attach_city(t.customer.select("c_custkey", F.concat(F.lit("NATION_"), "c_nationkey").alias("city")), cities(t).unionByName(namesakes))


@query("a12b_attach_city_of_state", f"""
WITH {CITIES} SELECT c_custkey, city, CASE WHEN c_custkey % 2 = 0 THEN state ELSE 'S9' END AS state, population - c_custkey % 2 AS population FROM customer LEFT JOIN cities ON c_nationkey = position""")
def a12b_state(t):
    namesakes = cities(t).withColumns({"state": F.lit("S9"), "population": F.col("population") - 1})
    own = t.customer.join(cities(t), F.col("c_nationkey") == F.col("position")).select(
        "c_custkey", "city", F.when(F.col("c_custkey") % 2 == 0, F.col("state")).otherwise("S9").alias("state"))
    return P.attach_city(own, cities(t).unionByName(namesakes))


@query("a13_safe_name", """
SELECT doc_id, substr(replace(replace(replace(replace(text, ' ', '_'), '/', '_'), '(', ''), ')', ''), 1, 50) AS safe FROM documents""")
def a13(t):
    return t.documents.select("doc_id", X.safe_name(F.col("text")).alias("safe"))

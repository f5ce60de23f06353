"""Views that give the test tables the shape of incident, catalog and interval tables.

The text runs unchanged in Spark SQL and ANSI SQL; ``{name}`` stands for a
table or another view.
"""

from __future__ import annotations

import re

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "v_incidents": """
SELECT event_id AS incident_id, CAST(ts AS DATE) AS combined_date,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE substr(CAST(ts AS STRING), 12, 8) END AS combined_time,
 CASE WHEN event_id % 53 = 0 THEN NULL ELSE event_type END AS primary_type,
 concat('LOC ', CAST(user_id % 25 AS STRING)) AS location_description,
 concat('city ', CAST(user_id % 5 AS STRING)) AS source_city,
 CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 0e0 WHEN event_id % 41 = 0 THEN -122.4e0
      ELSE 41.55e0 + ((event_id * 37) % 600) / 1000e0 END AS latitude,
 CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 0e0 WHEN event_id % 41 = 0 THEN 37.7e0
      WHEN event_id % 43 = 0 THEN 200e0 ELSE -88.05e0 + ((event_id * 53) % 700) / 1000e0 END AS longitude,
 value
FROM {events}""",
    "v_places": """
SELECT s_suppkey AS place_id, 41.5e0 + ((s_suppkey * 37) % 700) / 1000e0 AS latitude, -88.1e0 + ((s_suppkey * 53) % 800) / 1000e0 AS longitude,
 CASE WHEN s_suppkey % 19 = 0 THEN NULL ELSE 1e0 + s_suppkey % 7 END AS radius_km FROM {supplier}""",
    "v_streets": """
SELECT concat(CAST(100 + p_partkey % 37 AS STRING), ' ', p_name, ' Street, ', p_brand, ', IL') AS place, 40e0 + p_partkey / 1000e0 AS latitude, -88e0 AS longitude FROM {part}""",
    "v_addresses": """
SELECT c_custkey AS address_id, CASE c_custkey % 6 WHEN 0 THEN concat(CAST(100 + p_partkey % 37 AS STRING), ' ', p_name, ' Street, ', p_brand, ', IL')
  WHEN 1 THEN concat(CAST(100 + p_partkey % 37 AS STRING), '  ', upper(p_name), ' St., ', p_brand, ' il') WHEN 2 THEN concat(CAST(100 + p_partkey % 37 AS STRING), ' ', substr(p_name, 2), ' streeet, ', p_brand)
  WHEN 3 THEN concat('corner of ', p_name, ' and ', p_brand) WHEN 4 THEN NULL ELSE ' ?! ' END AS address,
 CASE WHEN c_custkey % 5 = 1 THEN 41e0 END AS latitude, -87e0 AS longitude FROM {customer} JOIN {part} ON p_partkey = c_custkey""",
    "v_keywords": """
SELECT c_custkey AS position, concat('K', CAST(c_nationkey AS STRING)) AS category,
 CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN '' WHEN c_custkey % 50 = 2 THEN 'Th' WHEN c_custkey % 50 = 3 THEN 'X'
      WHEN c_custkey % 3 = 0 THEN concat('/', CAST(c_custkey AS STRING)) WHEN c_custkey % 3 = 1 THEN concat(lower(substr(c_mktsegment, 1, 3)), CAST(c_custkey % 7 AS STRING))
      ELSE substr('onthereinghattionedblerandesourlyst', c_custkey % 29 + 1, 3 + c_custkey % 4) END AS keyword
FROM {customer}""",
    "v_dates": """
SELECT o_orderkey AS id, concat(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2), '/', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2), '/', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)) AS us,
 CASE WHEN o_orderkey % 10 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN o_orderkey % 10 = 1 THEN 'unknown' WHEN o_orderkey % 10 = 2 THEN '  ' WHEN o_orderkey % 10 = 3 THEN NULL
      ELSE concat(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2), '/', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2), '/', substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)) END AS mixed,
 o_orderpriority AS words FROM {orders}""",
    "v_globe": """
SELECT event_id AS point_id, ((event_id * 7919) % 18001) / 100e0 - 90e0 AS latitude, ((event_id * 10007) % 36001) / 100e0 - 180e0 AS longitude FROM {events}""",
    "v_posts": """
SELECT n_nationkey AS post_id, CASE n_nationkey WHEN 0 THEN -90e0 WHEN 24 THEN 90e0 ELSE n_nationkey * 7.4e0 - 88.8e0 END AS latitude,
 CASE WHEN n_nationkey % 3 = 0 THEN 180e0 WHEN n_nationkey % 3 = 1 THEN -179.9e0 ELSE n_nationkey * 13e0 - 160e0 END AS longitude FROM {nation}""",
    "v_incidents_dup": """
SELECT incident_id, combined_date, combined_time, primary_type, location_description, source_city,
 latitude, longitude, value FROM {v_incidents}
UNION ALL
SELECT CASE WHEN incident_id % 40 = 3 THEN incident_id ELSE incident_id + 1000000 END AS incident_id,
 combined_date, combined_time, primary_type, location_description, source_city,
 latitude + CASE WHEN incident_id % 40 = 3 THEN 0e0 ELSE 0.000001e0 END AS latitude, longitude, value
FROM {v_incidents} WHERE incident_id % 20 = 3""",
    "v_daily": """
SELECT o_orderkey AS incident_id, CAST(o_orderdate AS DATE) AS combined_date,
 o_orderpriority AS crime_type, o_orderstatus AS location_type,
 concat('city ', CAST(o_custkey % 5 AS STRING)) AS city FROM {orders}""",
    "v_employment": """
SELECT CASE WHEN o.o_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS company, o.o_custkey AS person_id,
 CASE WHEN o.o_custkey % 100 = 7 THEN CAST(o.o_orderdate AS DATE) ELSE CAST(f.first_date AS DATE) END AS date_of_hire,
 CASE WHEN o.o_orderdate > f.first_date THEN CAST(o.o_orderdate AS DATE) END AS date_of_rehire,
 CASE WHEN o.o_orderkey % 37 = 0 THEN NULL
      ELSE CAST(o.o_orderdate + INTERVAL 1 DAY * CAST(o.o_orderkey % 200 AS INT) AS DATE) END AS term_date
FROM {orders} o JOIN (SELECT o_custkey AS ck, min(o_orderdate) AS first_date FROM {orders} GROUP BY o_custkey) f
  ON o.o_custkey = f.ck""",
    "v_staff": """
SELECT l_returnflag AS company, concat('STR', CAST(l_suppkey AS STRING)) AS unit_id, l_partkey % 300 AS person_id,
 CAST(l_shipdate AS DATE) AS eff_date,
 CAST(l_shipdate + INTERVAL 1 DAY * CAST(l_quantity * 6 AS INT) AS DATE) AS end_date,
 CASE l_linenumber WHEN 1 THEN 'General Manager' WHEN 2 THEN 'STORE MANAGER' WHEN 3 THEN 'Assistant Store Manager'
      WHEN 4 THEN 'General Manager In Training' WHEN 5 THEN 'Cashier' WHEN 6 THEN 'store general manager'
      ELSE NULL END AS job_title_cd
FROM {lineitem}""",
    "v_catalog": """
SELECT doc_id AS dataset_id, source AS city, lang AS state,
 concat(CASE WHEN doc_id % 3 = 0 THEN 'Crime ' WHEN doc_id % 3 = 1 THEN 'Police ' ELSE 'Parks ' END, source) AS name,
 text AS description,
 concat(CASE WHEN doc_id % 2 = 0 THEN 'latitude|' ELSE '' END,
        CASE WHEN doc_id % 2 = 0 AND doc_id % 5 <> 0 THEN 'longitude|' ELSE '' END,
        CASE WHEN doc_id % 3 <> 0 THEN 'Occurred Date|' ELSE '' END,
        CASE WHEN doc_id % 7 < 4 THEN 'incident_time|' ELSE '' END,
        CASE WHEN doc_id % 4 <> 1 THEN 'primary_type|' ELSE '' END,
        CASE WHEN doc_id % 11 < 8 THEN 'description|' ELSE '' END,
        CASE WHEN doc_id % 13 < 5 THEN 'arrest|' ELSE '' END, 'id') AS columns_text
FROM {documents}""",
    "v_source_a": """
SELECT o_orderkey AS case_number, CAST(o_orderdate AS STRING) AS occurred_date, o_orderpriority AS offense,
 CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS arrest_flag FROM {orders}""",
    "v_source_b": """
SELECT event_id AS id, CAST(ts AS STRING) AS datetime, event_type AS category, props AS description,
 concat('{{"latitude": ', CAST(event_id % 90 AS STRING),
        CASE WHEN event_id % 3 = 0 THEN ', "lng": ' ELSE ', "longitude": ' END,
        CAST(event_id % 180 AS STRING), '}}') AS location FROM {events}""",
}


def sources(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))]


def _plain(text: str) -> str:
    return text.format(**{n: n for n in sources(text)})


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """The SQL with the named views, and the views they need, as leading CTEs."""
    needed: list[str] = []

    def add(name: str) -> None:
        for n in sources(VIEWS[name]):
            if n in VIEWS:
                add(n)
        if name not in needed:
            needed.append(name)

    for v in views:
        add(v)
    parts = [f"{v} AS ({_plain(VIEWS[v])})" for v in needed]
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = "RECURSIVE ", body[len("WITH RECURSIVE"):].strip()
        return f"WITH RECURSIVE {', '.join(parts + [body])}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts + [body[5:].strip()])}"
    return f"WITH {', '.join(parts)} {body}" if parts else body

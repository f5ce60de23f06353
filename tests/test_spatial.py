"""Joins and duplicates within a distance against all pairs, with poles, the date line and one crowded cell."""

import datetime
import math
import random

from pyspark.sql import functions as F

from tallyline.functions import cells
from tallyline.operators import dedupe, groups, mapping
from tallyline.operators.detect import detect_columns


def km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((p - q) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b - d) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


def test_around_centres(spark):
    rng = random.Random(5)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    spots += [(rng.choice([89.99, -89.95, 90.0, -90.0]), rng.uniform(-180, 180)) for _ in range(40)]
    spots += [(rng.uniform(-60, 60), rng.choice([180.0, -180.0, 179.99, -179.98])) for _ in range(40)]
    spots += [(10.0, 10.0)] * 190 + [(10.001, 10.002)] * 60  # more than a third in one cell
    rows = [(k, y, x, "own") for k, (y, x) in enumerate(spots)] + [(9000, None, 1.0, ""), (9001, float("nan"), 1.0, ""), (9002, 95.0, 1.0, ""), (9003, 1.0, None, "")]
    points = spark.createDataFrame(rows, "id long, latitude double, longitude double, `a.b c` string").repartition(4)
    posts = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([0.0, 50.0, 700.0, 3000.0])) for k in range(25)]
    posts += [(100, 90.0, 0.0, 30.0), (101, -90.0, 77.0, 900.0), (102, 0.0, 180.0, 500.0), (103, 5.0, -179.9, 2500.0), (104, 10.0, 10.0, 5.0), (104, 10.0, 10.0, 5.0), (105, 89.0, 0.0, 400.0)]
    posts += [(200, None, 0.0, 5.0), (201, 0.0, 0.0, None), (202, 0.0, 0.0, -1.0)]
    centres = spark.createDataFrame(posts, "post long, latitude double, longitude double, reach double")
    for cell in (None, 400.0):
        near = mapping.around_centres(points, centres, "reach", cell_km=cell or 90.0, hot_rows=20)
        got = sorted((r.id, r.centre.post) for r in near.collect())
        want = sorted((k, c) for k, (y, x) in enumerate(spots) for c, yc, xc, r in posts if None not in (yc, r) and km(y, x, yc, xc) <= r)
        assert got == want
    assert "CartesianProduct" not in near._jdf.queryExecution().toString() and "NestedLoop" not in near._jdf.queryExecution().toString()
    assert mapping.around_centres(points.limit(0), centres, 10.0).count() == 0 and mapping.around_centres(points, centres.limit(0), 10.0).count() == 0


def brute_groups(rows, most_km, seconds):
    root = {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[1] == b[1] and None not in (a[2], b[2], a[4], b[4]) and abs((a[4] - b[4]).total_seconds()) <= seconds and km(a[2], a[3], b[2], b[3]) <= most_km:
                u, v = sorted((top(a[0]), top(b[0])))
                root[v] = u
    return sorted({top(r[0]) for r in rows})


def near_rows():
    rng, day = random.Random(7), datetime.datetime(2024, 3, 1)
    rows = []
    for _ in range(260):  # chains and neighbours over cell edges
        rows.append((rng.choice(["A", "B", None]), rng.uniform(0, 0.2), rng.uniform(-0.1, 0.1), day + datetime.timedelta(seconds=rng.randint(0, 9000))))
    for _ in range(60):
        rows.append(("A", rng.uniform(60, 60.05), rng.choice([180.0, -180.0, 179.995, -179.993]), day + datetime.timedelta(seconds=rng.randint(0, 3000))))
    for _ in range(120):  # two crowds in cells side by side, just out of reach of each other
        rows.append(("C", 20 + rng.uniform(0, 0.001), 20 + rng.choice([0, 0.0120]) + rng.uniform(0, 0.0009), day))
    for _ in range(80):  # and two that one pair joins
        rows.append(("D", 30 + rng.uniform(0, 0.001), 20 + rng.choice([0, 0.0125]) + rng.uniform(0, 0.0002), day))
    rows += [("D", 30.0, 20.0071, day)] * 3 + [("A", None, 1.0, day), ("A", 1.0, 1.0, None), ("A", 1.0, 1.0, None)]
    rows += [("A", 0.1, 0.0, day)] * 150
    return [(k, *r) for k, r in enumerate(rows)]


def test_drop_within(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "id long, crime_type string, latitude double, longitude double, datetime timestamp").repartition(4).withColumn("group", F.lit("own")).withColumn("a b", F.lit(1))
    for most_km, seconds, small in ((1.0, 600, 1024), (1.0, 600, 1), (3.0, 60, 4)):
        points = dedupe.near_groups(df, most_km, seconds, small=small)
        assert points.count() == points.select("key", "y", "x", "s").distinct().count()
        if small == 1024:
            got = sorted(r.id for r in dedupe.drop_within(df, most_km, seconds, ["id"]).collect())
            assert got == brute_groups(rows, most_km, seconds)
        placed = [r for r in rows if None not in (r[2], r[4])]
        assert points.select("group").distinct().count() == len(brute_groups(placed, most_km, seconds))
    assert dedupe.drop_within(df.limit(0), 1.0, 60, ["id"]).count() == 0


def test_blocks_give_links_of_cells_not_of_pairs(spark, monkeypatch):
    """A full lattice over several blocks of cells, across the equator and the date line, cut in two by a gap."""
    day, seen = datetime.datetime(1970, 1, 1), []
    rows = [(key, (a - 9) * 0.006, (b * 0.006 + 179.95 + 180) % 360 - 180 + (0.05 if b > 11 else 0), day + datetime.timedelta(seconds=500 * (c - 10)))
            for key in ("A", None) for a in range(18) for b in range(18) for c in range(20)]
    df = spark.createDataFrame(rows, "crime_type string, latitude double, longitude double, datetime timestamp").repartition(4)
    plain = dedupe.components
    monkeypatch.setattr(dedupe, "components", lambda links: seen.append(links.count()) or plain(links))
    points = dedupe.near_groups(df, 1.0, 600).cache()
    assert points.groupBy("key").agg(F.countDistinct("group").alias("n")).select("n").distinct().collect() == [(2,)]
    assert points.count() == len(rows) and max(seen) <= len(rows)  # at most one link a point; several to a point before
    assert sorted(r["count"] for r in points.groupBy("group").count().collect()) == [6 * 18 * 20] * 2 + [12 * 18 * 20] * 2


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)] + [(500, k) for k in range(501, 560)]
    root = {}
    for u, v in links:
        root.setdefault(u, u), root.setdefault(v, v)
    for _ in range(100):
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {u: r for u, r in root.items() if u != r}


def test_cover_holds_own_cell(spark):
    rows = [(y, x) for y in (-90.0, -45.5, 0.0, 0.01, 89.9, 90.0) for x in (-180.0, -0.001, 0.0, 180.0)]
    y, x = F.col("y"), F.col("x")
    for h in (0.01, 1.7, 60.0):
        out = spark.createDataFrame(rows, "y double, x double").select(cells.cell_of(y, x, h).alias("c"), cells.cover(y, y, x, x, F.lit(1.0), h).alias("all"))
        assert out.filter(~F.array_contains("all", F.col("c"))).count() == 0
        assert out.filter(F.size("all") != F.size(F.array_distinct("all"))).count() == 0


def test_columns_are_detected_once(spark):
    df = spark.createDataFrame([(1, ["Lat", "lng", "occured_dt"])], "dataset_id long, columns array<string>")
    found = detect_columns(df).filter("column_mapping is not null").groupBy(F.map_keys("column_mapping"), F.size("column_mapping")).count()
    once = detect_columns(df)._jdf.queryExecution().optimizedPlan().toString().count("bit_count")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("bit_count") == once

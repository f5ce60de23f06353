"""Standardising, merging, imputing and deduplicating on small hand-made tables."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tallyline.functions import columns as C, joins, rules, text as X
from tallyline.operators import clean, dedupe, impute, merge, neighbours, unify as U

TS = dt.datetime.fromisoformat
SCORE = "round(data_quality_score, 6)"


def one(df, *columns):
    return [tuple(r) for r in df.select(*[F.expr(c) if isinstance(c, str) else c for c in columns]).collect()]


@pytest.fixture(scope="module")
def golden(spark):
    a = spark.createDataFrame(
        [("2023-01-01 12:30:00", "THEFT", "Over $500", 41.8, -87.6, True), ("2023-01-02 14:45:00", "BATTERY", "Simple", 41.9, -87.7, False)],
        "Date string, `Primary Type` string, Description string, Latitude double, Longitude double, Arrest boolean")
    b = spark.createDataFrame(
        [("01/01/2023", "GRAND LARCENY", 40.7, -74.0, "Y"), ("01/02/2023", "ASSAULT", 40.8, -73.9, "N")],
        "OCCUR_DATE string, OFNS_DESC string, Latitude double, Longitude double, ARREST_FLAG string")
    return a, b


def test_golden_sources(golden):
    a, b = golden
    got = clean.standardize(a, "A", stable=True).orderBy("incident_id")
    assert one(got, "incident_id", "datetime", "crime_type", "crime_category", "crime_description", "location_type", "arrest_made", SCORE) == [
        ("GEN_00000000", TS("2023-01-01 12:30:00"), None, "UNKNOWN", "Over $500", "Over $500", True, 65.0),
        ("GEN_00000001", TS("2023-01-02 14:45:00"), None, "UNKNOWN", "Simple", "Simple", False, 65.0)]
    got = clean.standardize(b, "B", ["MM/dd/yyyy"], stable=True).orderBy("incident_id")
    assert one(got, "incident_id", "datetime", "crime_description", "location_type", "arrest_made", SCORE, "source_name") == [
        ("GEN_00000000", TS("2023-01-01 00:00:00"), None, None, True, 55.0, "B"),
        ("GEN_00000001", TS("2023-01-02 00:00:00"), None, None, False, 55.0, "B")]
    assert got.columns == clean.INCIDENT_SCHEMA.names


def test_golden_unify(golden):
    a, b = golden
    out = U.unify([(a, "A"), (b, "B")], formats={"B": ["MM/dd/yyyy"]})
    assert out.count() == 4
    assert one(U.unified_summary(out), "total", "sources", "latitude_complete") == [(4, 2, 100.0)]


def test_find_column_contains_both_ways():
    assert C.find_column(["Date", "x"], "datetime") == "Date"
    assert C.find_column(["OCCUR_DATE"], "date") == "OCCUR_DATE"
    assert C.find_column(["city"], "y") == "city"
    assert C.find_column(["a"], "zip") is None


def test_missing_text_stays_missing(spark):
    df = spark.createDataFrame([(None, "x"), ("THEFT", "y")], "offense string, id string")
    assert one(clean.standardize(df).orderBy("incident_id"), "crime_type", "crime_category") == [(None, "UNKNOWN"), ("THEFT", "PROPERTY")]


def test_categories(spark):
    df = spark.createDataFrame([("sexual assault",), ("Identity Theft",), (None,), ("parking",)], "t string")
    got = one(df, X.first_matching_category(F.col("t"), rules.INCIDENT_CATEGORIES))
    assert [g[0] for g in got] == ["VIOLENT", "PROPERTY", "UNKNOWN", "OTHER"]


def test_title_case_and_safe_name(spark):
    df = spark.createDataFrame([("o'hare st-louis", "a b/c (d)")], "a string, b string")
    assert one(df, X.title_case(F.col("a")), X.safe_name(F.col("b"))) == [("O'Hare St-Louis", "a_b_c_d")]


def test_clock_column_rules(spark):
    df = spark.createDataFrame([("2024-01-01", "10:20:30"), ("2024-01-01", "25:00:00"), ("2024-01-01", None), (None, "10:20:30")], "date string, time string")
    assert [r[0] for r in one(df, clean.incident_datetime(df.columns))] == [TS("2024-01-01 10:20:30"), None, None, None]


def test_positions_follow_the_order(spark):
    df = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("x")).repartition(7)
    got = clean.add_position(df, order_by=["x"])
    assert got.filter("position <> x").count() == 0 and got.select("position").distinct().count() == 5000
    path_stable = clean.add_position(spark.range(0, 1000, 1, 5).toDF("x"), stable=True)
    assert path_stable.filter("position <> x").count() == 0


def test_earliest_date(spark):
    df = spark.createDataFrame([("2024-01-02 00:00:00", "2024-01-03", 5), ("bad", "2024-01-01 08:09:10", 6), (None, None, 7)],
                               "Reported_Date string, `event time` string, update_no long")
    got = merge.combine_dates(df)
    assert got.columns == ["update_no", "combined_date", "combined_time"]
    assert one(got, "combined_date", "combined_time") == [(dt.date(2024, 1, 2), None), (dt.date(2024, 1, 1), "08:09:10"), (None, None)]
    unread = spark.createDataFrame([(1, "good", 3), (2, None, 4)], "id int, sentiment string, update_count int")
    assert sorted(merge.combine_dates(unread).collect()) == sorted(unread.collect())
    same = spark.createDataFrame([(1,)], "a int")
    assert merge.combine_dates(same).columns == ["a"]
    epoch = spark.createDataFrame([(1_700_000_000_000_000_000,)], "time_ns long")
    assert one(merge.combine_dates(epoch, numeric_as_epoch=True), "*") == [(dt.date(2023, 11, 14), "22:13:20")]


def test_object_coordinates_row_level(spark):
    df = spark.createDataFrame([('{"latitude": 1.5, "lng": 2}',), ("{broken",), ('{"lat": "3", "long": 4}',), ('{"lat": 0, "long": 4}',)], "location string")
    assert one(merge.extract_coordinates(df), "latitude", "longitude") == [(1.5, 2.0), (3.0, 4.0)]
    nested = spark.createDataFrame([((1.0, 2.0),)], "location struct<lat: double, lng: double>")
    assert one(merge.extract_coordinates(nested), "latitude", "longitude") == [(1.0, 2.0)]
    assert merge.extract_coordinates(spark.createDataFrame([(1,)], "a int")) is None


def test_union_types_and_empty(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([(2.5, 7)], "n double, s int")
    c = spark.createDataFrame([], "only_here string")
    got = merge.union_sources([a, b, c])
    assert dict(got.dtypes) == {"n": "double", "s": "string"} and got.count() == 2


def test_report_order():
    cols = ["zeta", "timestamp", "longitude", "report_date", "source_url", "alpha", "latitude", "source_city", "combined_time", "combined_date", "dataset_name"]
    assert C.report_order(cols) == ["source_city", "dataset_name", "source_url", "latitude", "longitude", "combined_date", "combined_time",
                                    "report_date", "timestamp", "alpha", "zeta"]


def test_name_clash_and_required(spark):
    with pytest.raises(ValueError):
        C.normalise_names(spark.range(1).toDF("A").withColumn(" a", F.lit(1)))
    with pytest.raises(ValueError):
        C.require_columns(spark.range(1), ["latitude"])


def test_swap_repair(spark):
    df = spark.createDataFrame([(-122.4, 37.7), (95.0, 200.0), (10.0, 181.0), (None, 5.0)], "latitude double, longitude double")
    assert one(clean.validate_ranges(df), "*") == [(37.7, -122.4), (None, None), (10.0, None), (None, 5.0)]
    assert one(clean.validate_ranges(df, repair_swapped=False), "*") == [(None, 37.7), (None, None), (10.0, None), (None, 5.0)]


def test_hot_duplicate_group(spark):
    """A third of all rows are copies: they are pruned before the shuffle and one stays."""
    df = spark.range(9000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("crime_type"),
        F.lit(None).cast("timestamp_ntz").alias("datetime"), F.lit(1.00001).alias("latitude"), F.lit(None).cast("double").alias("longitude"))
    out = dedupe.drop_near(df, ["id"])
    assert out.count() == 6001 and out.filter("crime_type = 0").select("id").first()[0] == 0
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_large_caps_are_exact(spark):
    df = spark.range(20_000).select((F.col("id") % 7 == 0).alias("k"), F.col("id"))
    got = dedupe.first_k_per(df, "k", 1500, ["id"])
    assert got.groupBy("k").agg(F.count("*"), F.max("id")).orderBy("k").collect()[1][1:] == (1500, 1499 * 7)


@pytest.mark.parametrize("broadcast_bytes", ["-1", "10485760"])
def test_lookup_join_small_and_large(spark, broadcast_bytes):
    """Null keys, one hot key, long text keys; MAP, ARRAY and VARIANT columns travel through both kinds of join."""
    keys = ["a" * 5000, "b", "c"]
    df = spark.createDataFrame([(i, "hot" if i % 2 else keys[i % 3] if i % 4 else None) for i in range(400)], "id int, k string").select(
        "*", F.create_map(F.lit("m"), "id").alias("m"), F.array("id").alias("a"), F.try_parse_json(F.col("id").cast("string")).alias("j"))
    table = spark.createDataFrame([("a" * 5000, "x"), ("b", "y"), ("hot", "z")], "k string, v string").groupBy("k").agg(F.max("v").alias("v"))
    known = {"a" * 5000: "x", "b": "y", "hot": "z"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_bytes)
    try:
        rows = joins.lookup_join(df, table, ["k"]).select("id", "k", "v", F.col("m")["m"].alias("m"), F.col("a")[0].alias("a"), F.col("j").cast("int").alias("j")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.id for r in rows) == list(range(400))
    assert all(r.v == known.get(r.k) and r.m == r.a == r.j == r.id for r in rows)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_forward_fill_across_partitions(spark, groups):
    rnd = random.Random(3)
    data = [(i, "hot" if i % 3 else f"g{i % 5}", None if rnd.random() < 0.97 else i, None if i < 700 else "x") for i in range(2000)]
    df = spark.createDataFrame(data, "t int, g string, a int, b string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.t: (r.a, r.b) for r in impute.forward_fill(df, ["t"], ["a", "b"], groups).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    seen = {}
    for t, g, a, b in data:
        last = seen.setdefault(g if groups else None, [None, None])
        last[:] = [a if a is not None else last[0], b if b is not None else last[1]]
        assert got[t] == tuple(last), t


def test_forward_fill_moves_rows_once(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("a"))
    plan = impute.forward_fill(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan      # the one exchange lies before the checkpoint


def test_nearest_rows_with_many_columns(spark):
    """Twelve columns, a pattern of holes for each row, a hot point and an outlier, against all pairs."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 12)), 2)
    x[::3] = x[0]
    x[7] = 1e6
    x[rng.random((300, 12)) < 0.02] = np.nan
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([(int(i), *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "incident_id long, " + ", ".join(f"{c} double" for c in names))
    got = {r.incident_id: r for r in impute.impute(df, "knn").collect()}
    for i, r in enumerate(x):
        for j in np.flatnonzero(np.isnan(r)):
            d = []
            for q, o in enumerate(x):
                both = ~np.isnan(r) & ~np.isnan(o)
                if not np.isnan(o[j]) and both.any():
                    total = 0.0
                    for c in np.flatnonzero(both):
                        total += (r[c] - o[c]) * (r[c] - o[c])
                    d.append((total * (12.0 / both.sum()), q))
            assert abs(got[i][names[j]] - np.mean([x[q][j] for _, q in sorted(d)[:5]])) < 1e-9, (i, j)


def test_nearest_rows_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)        # dozens of cells; patterns of fewer than 10 donors have no boxes
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(0, [1, 12, 24, 100], (1500, 4)), 1)
    x[::4] = x[0]
    x[::4, 3] = np.round(rng.uniform(0, 100, 375), 1)
    x[:, :3][rng.random((1500, 3)) < 0.15] = np.nan
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "incident_id long, a double, b double, c double, d double")
    got = {r.incident_id: r for r in neighbours.impute_knn(df, names).collect()}
    has = ~np.isnan(x)
    for i in np.flatnonzero(~has.all(axis=1)):
        both = has[i] & has
        total = np.zeros(len(x))
        for c in range(4):
            total += np.where(both[:, c], (x[i, c] - x[:, c]) * (x[i, c] - x[:, c]), 0.0)
        d = total * (4.0 / np.maximum(both.sum(axis=1), 1))
        for j in np.flatnonzero(~has[i]):
            at = np.flatnonzero(has[:, j] & both.any(axis=1))
            assert abs(got[i][names[j]] - x[at[np.lexsort((at, d[at]))[:5]], j].mean()) < 1e-9, (i, j)


def test_nearest_rows_visit_few_cells():
    """What the first cells hold bounds the search: of about 1,000 cells few are asked, those of the nearest rows among them."""
    rng = np.random.default_rng(6)
    donors = rng.uniform(0, 1, (50_000, 4))
    tree = neighbours.Tree(donors[:20_000], 1000)
    cell = tree.cell(donors)
    order = np.argsort(cell, kind="stable")
    cells, head, count = np.unique(cell[order], return_index=True, return_counts=True)
    low, high = (f.reduceat(donors[order], head, axis=0) for f in (np.minimum, np.maximum))
    boxes = neighbours.Boxes(cells, np.ones(low.shape, bool), low, high, count)
    points, own = rng.uniform(0, 1, (40, 4)), np.array([True, True, True, False])
    points[:, 3] = np.nan
    who, where = boxes.likely(own, points, 5)
    limits = np.full(points.shape, -1.0)
    for i in range(40):
        near = donors[np.isin(cell, where[who == i])]
        limits[i, 3] = np.sort(((near - points[i])[:, :3] ** 2).sum(axis=1))[4] * 4 / 3
    who, where, most = boxes.within(own, points, limits)
    for i in range(40):
        d = ((donors - points[i])[:, :3] ** 2).sum(axis=1)
        assert set(cell[np.argsort(d)[:5]]) <= set(where[who == i])
    assert len(who) < 40 * 40 and (most == limits[who, 3]).all()


def test_mean_of_integers_is_a_double(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert one(impute.impute_mean(df), "n") == [(1.0,), (2.0,), (1.5,)]


def test_rate_draws_are_stable(spark):
    df = spark.range(4000).select(F.col("id").alias("incident_id"), F.lit("c").alias("crime_category"),
                                  F.when(F.col("id") % 2 == 0, F.col("id") % 8 == 0).alias("arrest_made"))
    a = impute.impute_rate(df)
    b = impute.impute_rate(df.repartition(5))
    assert sorted(one(a, "*")) == sorted(one(b, "*"))
    assert 400 < a.filter("incident_id % 2 = 1 and arrest_made").count() < 600      # rate 1/4 of 2000


def test_nearest_rows_equal_brute_force(spark):
    rnd = random.Random(9)
    data = []
    for i in range(400):
        row = [rnd.choice([rnd.gauss(0, 1), rnd.uniform(-9, 9)]), rnd.gauss(5, 2), float(rnd.randint(0, 5))]
        data.append((i, *[v if rnd.random() > 0.15 else None for v in row]))
    data += [(400 + i, 1.0, 1.0, None if i % 5 else 3.0) for i in range(200)]       # a hot group of copies
    data += [(600, None, None, None)]
    df = spark.createDataFrame(data, "incident_id long, a double, b double, c double")
    got = {r[0]: r[1:] for r in one(neighbours.impute_knn(df, ["a", "b", "c"]), "*")}
    means = [sum(r[j] for r in data if r[j] is not None) / sum(r[j] is not None for r in data) for j in (1, 2, 3)]
    for r in data:
        for j in (1, 2, 3):
            if r[j] is not None:
                assert got[r[0]][j - 1] == r[j]
                continue
            near = []
            for d in data:
                shared = [x for x in (1, 2, 3) if r[x] is not None and d[x] is not None]
                if d[j] is not None and shared:
                    dist = 0.0
                    for x in (1, 2, 3):
                        dist += (r[x] - d[x]) * (r[x] - d[x]) if x in shared else 0.0
                    near.append((dist * (3.0 / len(shared)), d[0], d[j]))
            near = sorted(near)[:5]
            want = sum(x[2] for x in near) / len(near) if near else means[j - 1]
            assert got[r[0]][j - 1] == pytest.approx(want, abs=1e-9), (r, near)

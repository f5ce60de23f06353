"""Statistics on small hand-made counts, and properties of cubes and matrices."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyline.operators import anomalies as A, association as S, concentration as K, distribution as D, incidents as I, mapping as M, series as R
from tallyline.plans.report import statistics_report
from tallyline.plans.registry import Tables
from tallyline.sources import files
from conftest import FOLDER


def counts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, n long")


def daily(spark, values, start="2024-01-01"):
    day = dt.date.fromisoformat(start)
    return spark.createDataFrame([(day + dt.timedelta(days=i), v) for i, v in enumerate(values)], "combined_date date, n long")


@pytest.mark.parametrize("values, want", [((1, 1, 1, 1), 0.0), ((1, 2, 3, 7, 7), 0.34), ((7, 3, 7, 1, 2), 0.34), ((5,), 0.0)])
def test_gini(spark, values, want):
    assert K.gini(counts(spark, values)).first()[0] == pytest.approx(want)


def test_top_shares_take_at_least_one(spark):
    assert K.top_shares(counts(spark, (5, 3, 2))).first()[:] == (50.0, 50.0)
    r = K.top_shares(counts(spark, [1] * 18 + [10, 10])).first()
    assert r[:] == pytest.approx((20 / 38 * 100, 22 / 38 * 100))


def test_moments(spark):
    r = D.describe_counts(counts(spark, (1, 2, 2, 9))).first()
    assert (r["skewness"], r["kurtosis"], r["std"], r["q25"]) == pytest.approx((1.0970254, -0.7055324, 3.6968455, 1.75), abs=1e-6)


def test_first_and_peak_hour(spark):
    df = spark.createDataFrame([(h,) for h in (5, 5, 5, 1, 2, 2, None)], "hour int")
    r = D.hour_profile(df).first()
    assert (r["first_hour"], r["peak_hour"], r["records_with_time"], r["first_hour_count"], r["peak_hour_count"]) == (1, 5, 6, 1, 3)
    none = D.hour_profile(df.filter("hour is null")).first()
    assert none["peak_hour"] is None and none["midnight_percentage"] == 0.0 and none["midnight_spike"] is False


def test_constant_counts_have_no_correlation(spark):
    r = D.autocorrelation(daily(spark, [4] * 20)).first()
    assert r[:] == (None, None)
    assert A.z_outliers(daily(spark, [4] * 20)).count() == 0


def test_ties_take_the_earliest_day(spark):
    r = A.extremes(daily(spark, [3, 9, 9, 1, 1])).first()
    assert (r["max_date"], r["min_date"]) == (dt.date(2024, 1, 2), dt.date(2024, 1, 4))


def test_dense_calendar(spark):
    d = daily(spark, [1, 1, 1, 1]).filter("combined_date <> date '2024-01-02'")
    assert D.volume_quality(I.dense_daily_counts(d)).first()["zero_days"] == 1
    assert D.volume_quality(d).first()["zero_days"] == 0


@pytest.mark.parametrize("x, dof, want", [(3.841458820694124, 1, 0.05), (0.0, 3, 1.0), (18.307038053275146, 10, 0.05), (1e4, 2, 0.0)])
def test_chi_square_tail(x, dof, want):
    assert S.chi_square_tail(x, dof) == pytest.approx(want, rel=2e-3, abs=1e-12)


@pytest.mark.parametrize("x, dof", [(200.0, 120), (90.0, 120), (1.5, 4), (60.0, 8)])
def test_chi_square_tail_of_even_dof(x, dof):
    """For even degrees of freedom the tail is a Poisson sum."""
    want = sum(math.exp(i * math.log(x / 2) - x / 2 - math.lgamma(i + 1)) for i in range(dof // 2))
    assert S.chi_square_tail(x, dof) == pytest.approx(want, rel=1e-9)


def test_single_row_table(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y")], "crime_type string, location_type string")
    r = S.chi_square(df, "crime_type", "location_type").first()
    assert (r["chi_square"], r["dof"], r["p_value"], r["cramers_v"]) == (0.0, 0, 1.0, None)


def test_too_few_timed_rows(spark):
    df = spark.createDataFrame([(i % 3, f"t{i % 2}") for i in range(100)], "hour int, crime_type string")
    assert S.hour_type_correlation(df, more_than=100).first()[:] == (None, None)
    assert S.hour_type_correlation(df.union(df), more_than=100).first()["max_correlation"] is not None
    assert S.hour_type_correlation(df).first()["max_correlation"] is not None


def test_real_other_stays_apart(spark):
    df = spark.createDataFrame([("Other",)] * 30 + [(f"v{i}",) for i in range(12) for _ in range(2)], "t string")
    got = {(r.value, r.is_other): r.n for r in K.top_and_other(df, "t").collect()}
    assert got[("Other", False)] == 30 and got[("Other", True)] == 6 and sum(got.values()) == 54
    few = K.top_and_other(df.filter("t in ('v0', 'v1')"), "t")
    assert few.count() == 2


def test_matrix_and_cube_totals(spark):
    p = I.prepare(Tables(spark, FOLDER).v_incidents, "2024-12-31")
    timed = p.filter("hour is not null").count()
    m = R.weekday_hour_matrix(p)
    assert m.count() == 168 and m.agg(F.sum("n")).first()[0] == timed
    s = R.sliced_matrices(p).groupBy("dim").agg(F.sum("n")).collect()
    assert {r[0]: r[1] for r in s} == {"all": timed, "crime_type": timed, "city": timed}
    assert R.weekday_hour_matrix(p.filter("hour is null")).agg(F.sum("n"), F.count("n")).first()[:] == (0, 168)
    assert R.as_wide(m).count() == 7
    for parts in (1, 7):
        assert I.cube(p.repartition(parts)).agg(F.sum("n")).first()[0] == p.count()


def test_label_rules(spark):
    df = spark.createDataFrame([("x", None)], "offense_type string, source_city string")
    r = I.add_labels(df).first()
    assert (r["crime_type"], r["location_type"], r["city"]) == ("x", "Unknown", None)
    assert I.add_labels(df, ("primary",)).first()["crime_type"] == "Unknown"


def test_radius_box_never_loses_points(spark):
    df = spark.range(20000).select((F.floor(F.col("id") / 200) * 1.8 - 90).alias("latitude"), (F.col("id") % 200 * 1.8 - 180).alias("longitude"),
                                   F.lit("2024-01-01").cast("date").alias("combined_date"))
    from tallyline.functions.geo import haversine_km
    for lat, lon, km in ((41.9, -87.6, 300.0), (89.0, 10.0, 500.0), (0.0, 179.9, 400.0), (-60.0, -179.0, 900.0)):
        want = df.filter(haversine_km(F.col("latitude"), F.col("longitude"), lat, lon) <= km).count()
        assert M.around(df, lat, lon, km, "2024-01-02").count() == want > 0


def test_report_has_all_sections_and_survives_json(spark, tmp_path):
    p = I.prepare(Tables(spark, FOLDER).v_incidents, "2024-12-31")
    report = statistics_report(p, "2024-12-31")
    assert report.columns == ["diagnostics", "basic", "temporal", "correlation", "concentration", "anomalies"]
    files.write_report(report, str(tmp_path / "r"))
    back = spark.read.json(str(tmp_path / "r"))
    assert back.select("basic.overview.total_records").first()[0] == p.count()


def test_plans_have_no_cross_joins(spark):
    import __spark_entry__ as entry
    for name in ("d17_type_location_chi_square", "d18_hour_type_correlation", "d30_sliced_matrices", "e15_management_changes", "c29_nearest_rows"):
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

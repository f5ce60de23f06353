"""Stints and tenures against hand cases and row-by-row loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import stints as E, tenures as T

D = dt.date.fromisoformat
DAY = dt.timedelta(days=1)
EMP = "company string, person_id long, date_of_hire date, date_of_rehire date, term_date date"
STINT = "company string, person_id long, stint_start date, stint_end date"
STAFF = "company string, unit_id string, person_id long, eff_date date, end_date date, job_title_cd string"


def stint_frame(spark, spans):
    return spark.createDataFrame([("A", p, D(s), D(e) if e else None) for p, s, e in spans], STINT)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_merge_hand_case(spark):
    df = stint_frame(spark, [(1, "2020-01-01", "2020-02-01"), (1, "2020-02-20", "2020-03-01"), (1, "2021-01-01", None), (1, "2021-05-01", "2021-06-01")])
    assert rows(E.coalesce_stints(df, "2024-12-31", 30), "stint_start", "stint_end") == [
        (D("2020-01-01"), D("2020-03-01")), (D("2021-01-01"), None)]


@pytest.mark.parametrize("span, cutoff, want", [
    (("2020-01-15", "2020-03-10"), "2024-12-31", [(2020, 1, 0), (2020, 2, 0), (2020, 3, 1)]),
    (("2020-01-15", "2025-03-10"), "2020-02-29", [(2020, 1, 0), (2020, 2, 0)]),
    (("2020-06-01", "2020-07-01"), "2020-05-31", []),
])
def test_months(spark, span, cutoff, want):
    df = stint_frame(spark, [(1, *span)])
    assert rows(E.expand_months(df, cutoff), "year", "month", "churn_flag") == want


def test_mixed_missing_hire_date_excludes_person(spark):
    df = spark.createDataFrame([
        ("A", 1, None, D("2020-01-01"), None), ("A", 1, D("2020-01-01"), None, None),
        ("A", 2, None, D("2020-01-01"), None), ("A", 3, D("2020-01-01"), None, None)], EMP)
    assert rows(E.single_hire_date(df).select("person_id").distinct(), "person_id") == [(2,), (3,)]
    assert rows(E.employment_stints(df, "2024-01-01"), "person_id") == [(2,), (3,)]


def loop_merge(spans, cutoff, days):
    out = []
    for s, e in sorted(spans, key=lambda x: (x[0], x[1] is None, x[1] or dt.date.max)):
        if out:
            last = out[-1][1] or cutoff
            if s <= last or (s - last).days <= days:
                if e is None:
                    out[-1][1] = None
                elif out[-1][1] is not None:
                    out[-1][1] = max(out[-1][1], e)
                continue
        out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("days", [0, 5, 30])
def test_merge_equals_loop(spark, days):
    rnd = random.Random(days)
    base, cutoff = D("2020-01-01"), D("2020-07-01")
    spans = {}
    for p in range(300):
        spans[p] = []
        for _ in range(rnd.randint(1, 9)):
            s = base + DAY * rnd.randint(0, 400)
            spans[p].append((s, None if rnd.random() < 0.25 else s + DAY * rnd.randint(0, 60)))
        spans[p] += [rnd.choice(spans[p]) for _ in range(rnd.randint(0, 3))]
    df = spark.createDataFrame([("A", p, s, e) for p, l in spans.items() for s, e in l], STINT)
    want = sorted(((p, *x) for p, l in spans.items() for x in loop_merge(l, cutoff, days)), key=repr)
    for parts in (1, 7):
        got = E.coalesce_stints(df.repartition(parts), "2020-07-01", days)
        assert rows(got, "person_id", "stint_start", "stint_end") == want


def test_merged_stints_are_disjoint_and_stable(spark):
    rnd = random.Random(1)
    spans = [(p, str(D("2020-01-01") + DAY * rnd.randint(0, 900)), None) for p in range(50) for _ in range(6)]
    spans = [(p, s, str(D(s) + DAY * rnd.randint(0, 90))) for p, s, _ in spans]
    once = E.coalesce_stints(stint_frame(spark, spans), "2025-01-01", 14)
    twice = E.coalesce_stints(once, "2025-01-01", 14)
    assert rows(once, "person_id", "stint_start", "stint_end") == rows(twice, "person_id", "stint_start", "stint_end")


def test_one_person_with_most_rows(spark):
    """Many copies on few days: the windows must see one row per day."""
    df = spark.range(30_000).select(
        F.lit("A").alias("company"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("person_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("stint_start"),
        F.date_add(F.lit("2020-01-05").cast("date"), (F.col("id") % 10).cast("int")).alias("stint_end"))
    combined = E.combine_days(df.withColumnsRenamed({"stint_start": "date_of_hire", "stint_end": "term_date"}).withColumn(
        "date_of_rehire", F.lit(None).cast("date")))
    assert combined.filter("person_id = 7").count() == 10
    assert rows(E.coalesce_stints(df, "2024-01-01", 30).filter("person_id = 7"), "stint_start", "stint_end") == [
        (D("2020-01-01"), D("2020-01-14"))]


def staff(spark, spans, title="Store Manager"):
    return spark.createDataFrame([(c, u, p, D(s), D(e) if e else None, title) for c, u, p, s, e in spans], STAFF)


def test_previous_row_counts_not_running_end(spark):
    df = staff(spark, [("A", "S", 1, "2020-01-01", "2020-12-31"), ("A", "S", 1, "2020-02-01", "2020-02-10"), ("A", "S", 1, "2020-04-01", "2020-05-01")])
    assert rows(T.gap_tenures(df), "eff_date", "end_date") == [(D("2020-01-01"), D("2020-12-31")), (D("2020-04-01"), D("2020-05-01"))]


def test_titles(spark):
    names = ["General Manager", "STORE MANAGER", "Assistant Store Manager", "General Manager In Training", "Cashier", None, "store general manager"]
    df = spark.createDataFrame([("A", "S", i, D("2020-01-01"), D("2020-02-01"), n) for i, n in enumerate(names)], STAFF)
    assert rows(T.manager_titles(df), "person_id") == [(0,), (1,), (6,)]


def test_previous_manager_inclusive_and_previous_unit_strict(spark):
    a = T.add_length(T.gap_tenures(staff(spark, [("A", "S", 1, "2020-01-01", "2020-06-30"), ("A", "S", 2, "2020-06-30", "2021-01-01")])), "2024-01-01")
    assert rows(T.management_changes(a), "new_manager_id", "previous_manager_id", "previous_manager_tenure") == [(1, None, None), (2, 1, 181)]
    b = T.add_length(T.gap_tenures(staff(spark, [("A", "S", 1, "2020-01-01", "2020-06-30"), ("A", "T", 1, "2020-06-30", "2021-01-01")])), "2024-01-01")
    assert rows(T.management_changes(b), "current_store", "new_manager_previous_store") == [("S", None), ("T", None)]


def loop_tenures(spans, gap):
    """(eff, end, title) of one key, row by row."""
    out, prev = [], None
    for eff, end, title in sorted(spans, key=lambda x: (x[0], x[1] is None, x[1] or dt.date.max, x[2])):
        new = not out or (prev is not None and (eff - prev).days > gap)
        if new:
            out.append([eff, [end], [title]])
        else:
            out[-1][1].append(end)
            out[-1][2] += [] if title in out[-1][2] else [title]
        prev = end
    return [(e, None if None in ends else max(ends), "; ".join(t)) for e, ends, t in out]


def test_tenures_and_changes_equal_loops(spark):
    rnd = random.Random(5)
    base, data = D("2020-01-01"), []
    for _ in range(900):
        eff = base + DAY * rnd.randint(0, 200)
        kind = rnd.random()
        end = None if kind < 0.08 else eff - DAY * rnd.randint(31, 60) if kind < 0.2 else eff + DAY * rnd.randint(0, 25)
        data.append(("A", f"S{rnd.randint(0, 3)}", rnd.randint(0, 9), eff, end, rnd.choice(["GM", "SM", "XM"])))
    data += data[:150]
    df = spark.createDataFrame(data, STAFF)
    keys = {}
    for c, u, p, *x in data:
        keys.setdefault((c, u, p), []).append(tuple(x))
    want = [(*k, *t) for k, l in keys.items() for t in loop_tenures(l, 30)]
    got = T.gap_tenures(df.repartition(5))
    assert rows(got, *T.KEYS, "eff_date", "end_date", "job_title_cd") == sorted(want, key=repr)

    ten = T.add_length(got, "2020-05-01")
    table = [r.asDict() for r in ten.collect()]
    changes = T.management_changes(ten)

    def last(cands, order):
        return min(cands, key=lambda r: (-r["end_date"].toordinal(), *order(r)), default=None)

    expect = []
    for t in table:
        ended = [r for r in table if r["end_date"] is not None]
        pm = last([r for r in ended if r["unit_id"] == t["unit_id"] and r["end_date"] <= t["eff_date"] and r["person_id"] != t["person_id"]],
                  lambda r: (r["eff_date"], r["person_id"], r["tenure_length"]))
        pu = last([r for r in ended if r["person_id"] == t["person_id"] and r["end_date"] < t["eff_date"]],
                  lambda r: (r["unit_id"], r["eff_date"], r["tenure_length"]))
        expect.append(("A", t["person_id"], t["unit_id"], t["eff_date"], pm and pm["person_id"], pm and pm["tenure_length"],
                       pu and pu["unit_id"], pu and pu["tenure_length"]))
    assert rows(changes, *changes.columns) == sorted(expect, key=repr)

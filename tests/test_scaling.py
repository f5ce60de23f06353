"""What a task holds or a row evaluates must not grow with the table."""

from pyspark.sql import functions as F

from tallyline.functions import cells, joins
from tallyline.operators import detect, mapping, tenures


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_compared_once_for_each_list(spark):
    lists = [["latitude", "Occurred Date", "incident_time"], ["price", "qty"], ["lattitude", None], [], None, ["price", "qty"]]
    df = spark.createDataFrame([(i, lists[i % 6]) for i in range(60)], "dataset_id long, columns array<string>")
    out = detect.detect_columns(df)
    assert "bit_count" not in plan(out)
    got = {r.dataset_id: r.column_mapping for r in out.collect()}
    old, detect.MOST_LISTS = detect.MOST_LISTS, 0  # each row looks at its own list
    try:
        alone = detect.detect_columns(df)
        assert "bit_count" in plan(alone)
        assert got == {r.dataset_id: r.column_mapping for r in alone.collect()}
    finally:
        detect.MOST_LISTS = old
    assert got[0]["latitude"] == "latitude" and len(got) == 60


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    rows = [("A", f"S{i}", i, "2020-01-01", "2020-06-30", "General Manager") for i in range(200)]
    staff = spark.createDataFrame(rows, "company string, unit_id string, person_id long, eff_date string, end_date string, job_title_cd string").withColumns(
        {c: F.col(c).cast("date") for c in ("eff_date", "end_date")})
    found = tenures.gap_tenures(staff)
    assert found.count() == 200
    assert found.rdd.getNumPartitions() == 20


def test_chord_never_excludes_what_is_within_reach(spark):
    far = spark.range(20_000).select(((F.rand(1) - 0.5) * 180).alias("y"), ((F.rand(2) - 0.5) * 360).alias("x"), ((F.rand(3) - 0.5) * 180).alias("y0"), ((F.rand(4) - 0.5) * 360).alias("x0"))
    near = spark.range(20_000).select(((F.rand(5) - 0.5) * 180).alias("y"), ((F.rand(6) - 0.5) * 360).alias("x")).selectExpr("*", "greatest(-90d, least(90d, y + 1e-4 * rand(7))) as y0", "x + 1e-4 * rand(8) as x0")
    same = near.withColumns({"y0": F.col("y"), "x0": F.col("x")})
    pairs = far.unionByName(near).unionByName(same).withColumn("km", cells.distance_km(F.col("y"), F.col("x"), F.col("y0"), F.col("x0")))
    pairs = pairs.select("*", *cells.on_sphere(F.col("y"), F.col("x"), "p"), *cells.on_sphere(F.col("y0"), F.col("x0"), "c"))
    chord = sum(((F.col(f"p{i}") - F.col(f"c{i}")) ** 2 for i in range(3)), F.lit(0.0))
    assert pairs.filter(chord > cells.most_chord(F.col("km"))).count() == 0


def test_pairs_of_few_rows_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(mapping, "TASK_PAIRS", 1_000)
    points = spark.range(300).select("id", F.lit(41.0).alias("latitude"), (F.col("id") / 1000).alias("longitude"))
    found = mapping.around_centres(points, spark.range(40).selectExpr("id as place", "41d as latitude", "id / 1000d as longitude"), 50.0)
    assert found.rdd.getNumPartitions() >= 12
    assert found.count() == 12_000 and found.select("id", "centre.place").distinct().count() == 12_000


def test_copies_are_bounded_by_the_rows_of_a_cell(spark, monkeypatch):
    """Points and centres of one place: the rows dealt out for so many pairs stay a few times the rows there are."""
    monkeypatch.setattr(mapping, "TASK_PAIRS", 10)
    kind, seen = type(spark.range(1)), []
    plain = kind.repartition

    def counted(df, *by):
        if "cell" in by:
            seen.append((by[0], df.count()))
        return plain(df, *by)

    monkeypatch.setattr(kind, "repartition", counted)
    for points, centres, hot_rows in ((300, 30, 1_000_000), (300, 30, 5), (30, 300, 1_000_000)):
        spots = spark.range(points).select("id", F.lit(10.1).alias("latitude"), (10.1 + F.col("id") / 1e6).alias("longitude"))
        posts = spark.range(centres).select(F.col("id").alias("post"), F.lit(10.1).alias("latitude"), F.lit(10.1).alias("longitude"))
        seen.clear()
        near = mapping.around_centres(spots, posts, 0.5, cell_km=50.0, hot_rows=hot_rows).select("id", "centre.post").collect()
        assert len(seen) == 2 and all(tasks >= 16 for tasks, _ in seen) and sum(rows for _, rows in seen) <= 6 * (points + centres)
        assert len(near) == len(set(near)) == points * centres


def test_no_task_compares_more_pairs_than_most(spark, monkeypatch):
    """Beyond ``MOST_PAIRS`` both sides are cut further, whatever the copies; equal rows and equal centres count each."""
    monkeypatch.setattr(mapping, "TASK_PAIRS", 10)
    monkeypatch.setattr(mapping, "MOST_PAIRS", 100)
    n, m = F.col("n"), F.col("m")
    cells_of = spark.createDataFrame([(n, m) for n in (1, 7, 100, 5_000, 10**9) for m in (1, 7, 100, 5_000, 10**6)], "n long, m long")
    blocks, of_points, of_centres = mapping.shares(n, m, 10**12)
    for r in cells_of.select(n, m, blocks.alias("k"), of_points.alias("a"), of_centres.alias("b")).collect():
        assert r.a * r.b >= r.k and r.n / r.a * r.m / r.b <= 100 and r.m / r.b <= joins.TASK_ROWS
    spots = spark.createDataFrame([(i % 50, 10.0, 10.0) for i in range(100)], "id long, latitude double, longitude double")
    posts = spark.createDataFrame([(i % 30, 10.0, 10.0) for i in range(90)], "post long, latitude double, longitude double")
    near = mapping.around_centres(spots, posts, 5.0)
    assert sorted(r["count"] for r in near.groupBy("id", "centre.post").count().collect()) == [6] * 1500

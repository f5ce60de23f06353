"""Catalog rules, column detection, readers and payload shapes."""

import json

import pytest
from pyspark.sql import functions as F

from tallyline.functions import columns as C, rules
from tallyline.operators import catalog as K, detect
from tallyline.sources import files, payloads as P


def names(spark, *lists):
    return spark.createDataFrame([(i, list(c)) for i, c in enumerate(lists)], "dataset_id long, columns array<string>")


@pytest.mark.parametrize("a, b, want", [("date", "date", 100), ("description", "location_description", 71), ("occurred_time", "occurred date", 77), ("ab", "", 0)])
def test_similarity(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(detect.similarity(F.col("a"), b), detect.similarity(F.col("b"), a)).first()
    assert got[:] == (want, want)


def test_similarity_is_the_longest_common_subsequence(spark):
    import random
    rng = random.Random(1)

    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                above = row[j]
                row[j] = before + 1 if x == y else max(above, row[j - 1])
                before = above
        return round(200 * row[-1] / (len(a) + len(b))) if a or b else 0

    names_ = ["".join(rng.choice("abcd_é") for _ in range(rng.randint(0, 70))) for _ in range(80)]
    patterns = ["a", "abca_d", "d" * 62, "".join(rng.choice("abcd_é") for _ in range(62))]
    rows = spark.createDataFrame([(x,) for x in names_], "x string").select("x", *[detect.similarity(F.col("x"), p) for p in patterns]).collect()
    assert [list(r[1:]) for r in rows] == [[slow(r[0], p) for p in patterns] for r in rows]


def test_repeated_and_null_ids_keep_their_own_columns(spark):
    df = spark.createDataFrame([(1, ["locaton1", "zz"]), (1, ["detials", "arest"]), (None, ["descripton"])], "dataset_id long, columns array<string>")
    got = {tuple(r.columns): r.column_mapping for r in detect.detect_columns(df).collect()}
    assert all(set(m.values()) <= set(c) for c, m in got.items())
    assert got["descripton",]["description"] == "descripton" and got["detials", "arest"]["description"] == "detials"


def mapping(df, **kw):
    return {r[0]: r[1] for r in detect.detect_columns(df, **kw).select("dataset_id", "column_mapping").collect()}


def test_detection_order(spark):
    got = mapping(names(spark, ["y", "LAT", "Longitude"], ["my_lat", "x"], ["descripton", "arested"], []))
    assert got[0]["latitude"] == "LAT" and got[0]["longitude"] == "Longitude"
    assert got[1]["latitude"] == "my_lat" and got[1]["longitude"] == "x"
    assert got[2]["description"] == "descripton" and got[2]["arrest"] == "arested"
    assert got[3] == {}


def test_value_checks(spark):
    df = names(spark, ["a", "b", "c"]).withColumn("sample", F.from_json(F.lit(json.dumps(
        [{"a": "", "b": "120.5", "c": "2024-01-01T00:00:00"}, {"a": "x", "b": "99", "c": "2024-01-02"}, {"a": None, "b": "98"}, {"b": "97"}, {"b": "bad"}])),
        "array<map<string,string>>"))
    assert mapping(df, sample="sample", **detect.QUICK_LOOK)[0] == {"longitude": "b", "date": "c", "time": "c"}
    assert mapping(df, sample="sample")[0] == {"date": "c", "time": "c"}      # one later value of b is no number
    dates = names(spark, ["when"]).withColumn("sample", F.from_json(F.lit('[{"when": "2024-01-01"}]'), "array<map<string,string>>"))
    assert mapping(dates, sample="sample")[0] == {"date": "when"}


def test_coordinate_columns_agree(spark):
    lists = [["Latitude", "lon", "geom"], ["city", "location"], ["point"], ["id"], ["y_coord", "long", "lat"]]
    got = K.coordinate_columns(names(spark, *lists)).orderBy("dataset_id").collect()
    for r, cols in zip(got, lists):
        want = C.coordinate_columns(cols)
        assert {k: r[k] for k in want} == want


def test_category_match_needs_both_coordinates(spark):
    got = K.score_matches(K.match_categories(names(spark, ["lat", "Primary Type"], ["Lat", "LNG", "Occurred"], [])))
    rows = {r["dataset_id"]: r for r in got.collect()}
    assert not rows[0]["has_coordinates"] and rows[0]["has_crime_type"]
    assert rows[1]["has_coordinates"] and rows[1]["has_date"] and rows[1]["has_time"]
    assert rows[2]["match_score"] == 0 and rows[2]["columns_list"] == "No columns found"


def test_single_quoted_mapping(spark):
    df = spark.createDataFrame([("{'latitude': 'lat'}",), ("{'broken",), (None,)], "t string")
    got = [r[0] for r in df.select(K.parse_mapping(F.col("t"))).collect()]
    assert got[0] == {"latitude": "lat"} and not got[1] and got[2] is None


def test_search_repeats_are_optional(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 1)], "dataset_id long, term int")
    assert K.unique_datasets(df, ["term"]).count() == 2
    assert K.unique_datasets(df, ["term"], dedupe=False).count() == 3


def test_listing_shapes(spark):
    item = {"resource": {"id": "a", "name": "N", "description": "D"}}
    flat = {"identifier": "b", "title": "T", "name": "ignored", "description": "E"}
    data = [{"results": [item, item]}, {"dataset": [flat]}, flat, [flat, item], {"name": "only"}, {"results": []}]
    df = spark.createDataFrame([("d.x.org", json.dumps(p)) for p in data], "domain string, payload string")
    got = sorted(tuple(r) for r in P.normalise_catalog(df).select("dataset_id", "name", "description", "url").collect())
    a, b = ("a", "N", "D", "https://d.x.org/d/a"), ("b", "T", "E", "https://d.x.org/d/b")
    assert got == sorted([a] * 3 + [b] * 3 + [("", "only", "", "https://d.x.org")])


def test_landed_arrays_and_caps(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"dataset_name": "x", "n": i} for i in range(20)] + [{"dataset_name": "y", "extra": "e", "n": 1}]))
    df = files.read_landed(spark, str(tmp_path), multiline=True)
    assert df.count() == 21 and df.filter("extra is null").count() == 20
    capped = files.read_landed(spark, str(tmp_path), multiline=True, cap=5, order_by=["n"])
    assert sorted(r.n for r in capped.filter("dataset_name = 'x'").collect()) == [0, 1, 2, 3, 4]


def test_limits_before_and_after_filters(spark, tmp_path):
    df = spark.createDataFrame([(i, 41.8 if i % 2 else 0.0, -87.6) for i in range(40)], "id int, latitude double, longitude double")
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_incidents(spark, str(tmp_path / "c"), limit=10, order_by=["id"]).agg(F.max("id")).first()[0] == 9
    pts = files.read_points(spark, str(tmp_path / "c"), df.schema, limit=10, order_by=["id"])
    assert sorted(r.id for r in pts.collect()) == list(range(1, 20, 2))


def test_reuse_and_force(spark):
    catalog, landed = names(spark, ["a"], ["b"]), names(spark, ["a"])
    assert [r.dataset_id for r in P.not_landed(catalog, landed).collect()] == [1]
    assert P.not_landed(catalog, landed, force=True).count() == 2


def test_provenance_and_endpoints(spark):
    df = spark.createDataFrame([("data.cityofx.org", "/nibrs/agencies/A1/offenses/count")], "domain string, path string")
    out = P.add_provenance(df, F.col("domain"), F.lit("u"), F.lit("n")).first()
    assert out["source_city"] == "cityofx"
    rows = df.select(F.lit("A1").alias("ori"), F.col("path").alias("endpoint"), F.lit("{broken").alias("payload"))
    r = P.endpoint_rows(rows).select("kind", F.to_json("data")).first()
    assert r[:] == ("offenses", None)


def test_export_texts(spark):
    df = spark.createDataFrame([("c", "s", 1234567, "d", None, None, None, 3, None, 200 / 3, True, *[False] * 7)],
                               "city string, state string, population long, domain string, dataset_name string, dataset_id string, dataset_url string, "
                               "total_columns int, columns_list string, match_score double, all_columns_match boolean, " +
                               ", ".join(f"has_{c} boolean" for c in rules.COLUMN_CATEGORIES))
    r = K.export_table(df).first().asDict()
    assert (r["Population"], r["Chicago_Compatibility_Score_Percent"], r["Perfect_Match_All_Categories"], r["Dataset_ID"], r["Has_Date_Information"]) == (
        "1,234,567", "66.7%", "Yes", "N/A", "No")

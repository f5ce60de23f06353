"""Rules as tables, large arrays, incremental cubes, intervals, likeness of texts and kernels against plain versions."""

import datetime
import json
import os
import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tallyline.functions import text as X
from tallyline.operators import clean, keywords, mapping, neighbours, series, shapes, similar, spans
from tallyline.sources import arrays, incremental

DAY = datetime.date(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rules_of_a_table(spark):
    rng = random.Random(2)
    letters = "abcdeé日"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(400)] + [None, "", "AB", "ab"]
    rules = [(k, w, rng.choice("PQR")) for k, w in enumerate(words)]
    texts = ["".join(rng.choice(letters + " XÉ") for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "ab"] + ["same text ab"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    table = spark.createDataFrame(rules, "position long, keyword string, category string")
    got = {r.id: (r.category, list(r.keywords)) for r in keywords.keyword_hits(keywords.first_category(df, table, F.col("text")), table, F.col("text")).collect()}
    kept = {}
    for k, w, c in rules:
        if w:
            kept.setdefault(w.lower(), (k, c))
    for k, t in enumerate(texts):
        hits = sorted((p, c, w) for w, (p, c) in kept.items() if t is not None and w in t.lower())
        assert got[k] == ("UNKNOWN" if t is None else hits[0][1] if hits else "OTHER", [w for _, _, w in hits])
    literal = {"P": ["ab", "é"], "Q": ["c"]}
    few = spark.createDataFrame([(1, "ab", "P"), (2, "é", "P"), (3, "c", "Q")], "position long, keyword string, category string")
    both = keywords.first_category(df, few, F.col("text")).select(F.col("category").alias("a"), X.first_matching_category(F.col("text"), literal).alias("b"))
    assert both.filter("a <> b").count() == 0


def test_many_keywords(spark):
    """100,000 keywords: an equality join on q-grams, no nested loop."""
    table = spark.range(100_000).select(F.col("id").alias("position"), F.concat(F.lit("word"), F.col("id")).alias("keyword"), (F.col("id") % 7).cast("string").alias("category"))
    df = spark.range(200).select(F.col("id"), F.concat(F.lit("a Word"), F.col("id") * 7 + 10_000, F.lit(" b")).alias("text"))
    out = keywords.first_category(df, table, F.col("text"))
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    want = {k: min(int(s[:n]) for s in [str(k * 7 + 10_000)] for n in range(1, len(s) + 1) if s[:n] == str(int(s[:n]))) % 7 for k in range(200)}
    assert {r.id: int(r.category) for r in out.collect()} == want


def array_rows():
    rng = random.Random(4)
    odd = ['"', "\\", "\\\\", '\\"', "[", "]", "{", "}", '"]},{[', "\n", "é", "日", "", "x" * 50, "\\\\\\"]
    return [{"id": k, "note": "".join(rng.choice(odd) for _ in range(rng.randint(0, 6))), "inner": {"list": [{"a": rng.choice(odd)}, [], [[{}]]]}} for k in range(60)]


def test_large_arrays(spark):
    rows, folder = array_rows(), tempfile.mkdtemp(prefix="arrays-")
    with open(f"{folder}/a.json", "w", encoding="utf-8") as f:
        f.write(" " + json.dumps(rows[:40], ensure_ascii=False, indent=1) + "\n")
    with open(f"{folder}/b.json", "w", encoding="utf-8") as f:
        f.write(json.dumps([7, "text {", *rows[40:50], None, [{"id": 99}]]) + "\n" + json.dumps(rows[50:]))
    open(f"{folder}/c.json", "w").close()
    for size in (1 << 20, 333, 37):
        got = arrays.read_array_texts(spark, folder, size)
        found = sorted((json.loads(r.record) for r in got.collect()), key=lambda r: r["id"])
        assert found == rows
    parsed = arrays.read_json_array(spark, folder, "id long, note string, other int", 100)
    assert sorted((r.id, r.note, r.other) for r in parsed.collect()) == [(r["id"], r["note"], None) for r in rows]
    with open(f"{folder}/d.json", "w") as f:
        f.write('[{"id": 1000}, {"id": 1001, "note": "br')  # breaks off
    assert sorted((r.id is None, r.id or 0) for r in arrays.read_json_array(spark, f"{folder}/d.json", "id long", 10).collect()) in ([(False, 1000), (False, 1001)], [(False, 1000), (True, 0)])
    assert arrays.read_array_texts(spark, f"{folder}/c.json").count() == 0


def test_every_cut():
    """Whatever byte a range starts at, its state composes to that of the whole."""
    data = np.frombuffer(json.dumps(array_rows()[:12], ensure_ascii=False).encode(), np.uint8)
    whole = np.cumsum(arrays.structure(data, False, False)[0])
    for cut in range(len(data) + 1):
        step, *state = arrays.structure(data[:cut], False, False)
        rest = arrays.structure(data[cut:], *state)[0]
        assert (np.cumsum(np.concatenate([step, rest])) == whole).all()


def test_incremental_cube(spark):
    rng = random.Random(9)
    rows = [(k, DAY + datetime.timedelta(days=rng.randint(0, 200)) if k % 40 else None, rng.choice("AB"), rng.choice(["x", None]), rng.choice("uv")) for k in range(900)]
    df = spark.createDataFrame(rows, "incident_id long, combined_date date, crime_type string, location_type string, city string")
    folder = tempfile.mkdtemp(prefix="cube-")
    assert incremental.land(df.filter("incident_id < 300"), "a", folder)
    assert incremental.land(df.filter("incident_id between 300 and 500"), "b", folder)
    assert not incremental.land(df.filter("incident_id < 300"), "a", folder)
    # a batch that broke off before the ledger noted it: the same call again gives the same cube
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    incremental.land(df.filter("incident_id > 500"), "c", folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    assert incremental.land(df.filter("incident_id > 500"), "c", folder)
    assert sorted(map(repr, incremental.cube(spark, folder).collect())) == sorted(map(repr, series.monthly_cube(df).select(*incremental.cube(spark, folder).columns).collect()))
    assert [tuple(r) for r in incremental.ledger(spark, folder).collect()] == [("c", 399)]


def test_active_and_headcount(spark):
    rng = random.Random(5)
    rows = []
    for k in range(250):
        start = DAY + datetime.timedelta(days=rng.randint(-4000, 4000))
        end = rng.choice([None, start + datetime.timedelta(days=rng.choice([0, 1, 30, 400, 9000, -3]))])
        rows.append((rng.choice(["u", "u", "v", None]), k, start if k % 50 else None, end))
    df = spark.createDataFrame(rows, "unit string, id long, start date, end date")
    days = [(rng.choice(["u", "v", "w", None]), DAY + datetime.timedelta(days=rng.randint(-5000, 9000))) for _ in range(80)] + [("u", None)]
    moments = spark.createDataFrame(days, "unit string, day date")
    out = spans.active_at(moments, df, ["unit"], "day", "start", "end")
    assert "NestedLoop" not in plan(out)
    got = sorted((r.unit, r.day, r.interval.id) for r in out.collect())
    assert got == sorted((u, d, i) for u, d in days for w, i, a, b in rows if None not in (u, d, a) and u == w and a <= d and (b is None or d <= b))
    counts = spans.headcount(df, ["unit"], "start", "end")
    per_day = {(r.unit, r.day): r.headcount for r in spans.daily_headcount(counts, ["unit"], "2030-01-01").collect()}
    ok = [(w, a, b) for w, _, a, b in rows if a is not None and (b is None or a <= b)]
    for unit in ("u", "v", None):
        first = min(a for w, a, _ in ok if w == unit)
        for d in (first + datetime.timedelta(days=7 * k) for k in range((datetime.date(2030, 1, 1) - first).days // 7)):
            assert per_day[unit, d] == sum(w == unit and a <= d and (b is None or d <= b) for w, a, b in ok)
    assert spans.active_at(moments, df.limit(0), ["unit"], "day", "start", "end").count() == spans.headcount(df.limit(0), ["unit"], "start", "end").count() == 0


def test_similar_texts(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 25))) for _ in range(120)]
    left = [(t,) for t in base] + [(t[1:] + "X!",) for t in base] + [(None,), ("?!",), ("",), ("日本",)] + [(base[0],)] * 40
    right = [(t.upper(),) for t in base[:90]] + [(None,), ("日本 ",), ("--",)]
    a, b = spark.createDataFrame(left, "x string"), spark.createDataFrame(right, "y string")

    def plain(t):
        return " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())

    def grams(t):
        w = f"||{t}||"
        return {w[i:i + 3] for i in range(len(w) - 2)}

    ls, rs = ({p for (t,) in rows if (p := plain(t))} for rows in (left, right))
    for least in (0.4, 0.8, 1.0):
        out = similar.alike(a, b, "x", "y", least)
        assert "Cartesian" not in plan(out)
        want = {(p, q): len(grams(p) & grams(q)) / len(grams(p) | grams(q)) for p in ls for q in rs}
        assert {(r.a, r.b): r.similarity for r in out.collect()} == {k: v for k, v in want.items() if v >= least}
        best = {p: max((v, q) for q in [min((q for (o, q), v2 in want.items() if o == p and v2 == v), default=None)])[1] for p in ls if (v := max(want[p, q] for q in rs)) >= least}
        assert {r.a: r.b for r in similar.best_matches(a, b, "x", "y", least).collect()} == best
    rows = spark.createDataFrame([(1, None, None, "1 Main Str", None, None), (2, 5.0, 6.0, "1 Main Str", None, None), (3, None, 1.0, None, None, None), (4, None, None, "nowhere", "a", "b")],
                                 "id long, latitude double, longitude double, address string, city string, state string")
    places = spark.createDataFrame([("1 Main St.", 40.0, -80.0), ("1 main st", 39.0, -81.0), ("1 Main Street", None, 1.0)], "place string, latitude double, longitude double")
    got = {r.id: (r.latitude, r.longitude, r.place) for r in clean.fill_from_similar(rows, places).collect()}
    assert got == {1: (39.0, -81.0, "1 Main St."), 2: (5.0, 6.0, None), 3: (None, 1.0, None), 4: (None, None, None)}


def test_kernel(spark):
    rng = random.Random(7)
    cells = {(rng.randint(0, 9), rng.randint(0, 9)): float(rng.randint(1, 5)) for _ in range(25)}
    weights = mapping.gaussian(1.0, 2)
    grid = spark.createDataFrame([(y, x, n) for (y, x), n in cells.items()], "cell_lat long, cell_lon long, density double")
    got = {(r.cell_lat, r.cell_lon): r.density for r in mapping.kernel_density(grid, weights).collect()}
    want = {}
    for (y, x), n in cells.items():
        for i in range(-2, 3):
            for j in range(-2, 3):
                want[y + i, x + j] = want.get((y + i, x + j), 0) + n * weights[i + 2] * weights[j + 2]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and abs(sum(got.values()) - sum(cells.values())) < 1e-9


def test_many_patterns_of_missing_values(spark, monkeypatch):
    """Patterns, cells and tasks beyond their bounds give the rows of a comparison of all pairs."""
    rng = np.random.Generator(np.random.PCG64(4))
    values = rng.integers(0, 6, (300, 6)).astype(float)
    values[rng.random(values.shape) < 0.35] = np.nan
    values[:40] = values[0]
    rows = [(int(i), *[None if np.isnan(x) else float(x) for x in v]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "incident_id long, " + ", ".join(f"c{j} double" for j in range(6))).repartition(3)
    want = {}
    for i, v in enumerate(values):
        filled = v.copy()
        for c in np.flatnonzero(np.isnan(v)):
            near = []
            for j, o in enumerate(values):
                both = ~np.isnan(v) & ~np.isnan(o)
                if not np.isnan(o[c]) and both.any():
                    s = 0.0
                    for d in (v[both] - o[both]).tolist():
                        s += d * d
                    near.append((s * (6.0 / both.sum()), j))
            near = [values[j][c] for _, j in sorted(near)[:5]]
            filled[c] = np.mean(near) if near else np.nanmean(values[:, c])
        want[i] = filled
    for bounds in ({}, {"MOST_PATTERNS": 5, "CELL_ROWS": 4, "TASK_DONORS": 20, "TASK_RECEIVERS": 7}):
        for name, value in bounds.items():
            monkeypatch.setattr(neighbours, name, value)
        for r in neighbours.impute_knn(df).collect():
            assert np.allclose(np.array(list(r)[1:], float), want[r.incident_id])


def test_formats_of_sources(spark):
    days = [datetime.date(2023, 1 + k % 12, 1 + k * 7 % 28) for k in range(60)]
    rows = [(d.strftime("%m/%d/%Y"), d.strftime("%d.%m.%Y"), d.strftime("%Y-%m-%dT10:61:00") if k % 4 else d.strftime("%Y-%m-%dT10:09:00"), d.strftime("%b %-d, %Y"), d.strftime("%Y%m%d"),
             d.strftime("%m/%d/%Y 11:20:30 PM"), None if k % 2 else " ") for k, d in enumerate(days)]
    rows += [("junk", "31.12.2020", "x" * 99, None, "1", "?", None)]
    names = ["us", "de", "iso t", "named", "packed", "half.day", "none"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)).repartition(3)
    best = {r["column"]: (r["format"], r.fits, r.n) for r in shapes.best_formats(df, names).collect()}
    assert best == {"us": ("MM/dd/yyyy", 60, 61), "de": ("dd.MM.yyyy", 61, 61), "iso t": ("yyyy-MM-dd'T'HH:mm:ss", 15, 61), "named": ("MMM d, yyyy", 60, 60),
                    "packed": ("yyyyMMdd", 60, 61), "half.day": ("MM/dd/yyyy hh:mm:ss a", 60, 61)}
    halves = shapes.add_shapes(shapes.value_shapes(df.limit(20), names), shapes.value_shapes(df.exceptAll(df.limit(20)), names))
    assert sorted(map(repr, shapes.score_formats(halves).collect())) == sorted(map(repr, shapes.score_formats(shapes.value_shapes(df, names)).collect()))
    both = spark.createDataFrame([("01/13/2020",), ("13/01/2020",), ("13/02/2020",)], "d string")
    assert [(r["format"], r.fits) for r in shapes.best_formats(both, ["d"]).collect()] == [("dd/MM/yyyy", 2)]


def test_small_ranges_of_large_arrays_share_tasks(spark, tmp_path):
    folder = str(tmp_path / "many")
    os.makedirs(folder)
    texts = {}
    for name, n in (("a", 4000), ("b", 3000)):
        records = [json.dumps({"id": i, "note": '"]},{[\\' * (i % 7)}) for i in range(n)]
        texts[name] = records
        with open(f"{folder}/{name}.json", "w") as f:
            f.write("[\n" + ",\n".join(records) + "]")
    found = arrays.read_array_texts(spark, folder, 200)
    size = sum(os.path.getsize(f"{folder}/{x}.json") for x in texts)
    assert found.rdd.getNumPartitions() < size // 200 // 4
    got = sorted((r.path.rsplit("/", 1)[1][0], r.record) for r in found.collect())
    assert got == sorted((name, r) for name, records in texts.items() for r in records)

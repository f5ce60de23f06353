"""Keyword tables with many alike keywords."""

from pyspark.sql import functions as F

from tallyline.operators import keywords


def test_alike_keywords_do_not_crowd_one_part(spark):
    rules = spark.range(20_000).select(F.concat(F.lit("/"), F.col("id") + 100_000).alias("keyword"), F.lit("n").alias("category"), F.col("id").alias("position"))
    index = keywords.keyword_index(rules)
    assert index.count() == 20_000
    assert index.groupBy(index.columns[0]).count().agg(F.max("count")).first()[0] <= 20


def test_parts_of_all_sizes_and_scripts(spark):
    words = ["a", "Bc", "é", "straße", "日本", "ab日", "x" * 40 + "y", "longer than sixteen", "sixteen", "/12", "/123", "/1234567", "", None]
    rules = spark.createDataFrame([(i, f"c{i}", w) for i, w in enumerate(words)], "position long, category string, keyword string")
    texts = ["", None, "日本語 ab日", "Straße /123", "x" * 41 + "y", "x" * 40, "is longer than sixteen words", "/12345678", "É", "bbc" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: list(r.keywords) for r in keywords.keyword_hits(df, rules, F.col("text")).collect()}
    want = {i: [w.lower() for w in words if w and t is not None and w.lower() in t.lower()] for i, t in enumerate(texts)}
    assert got == want
    first = {r.id: r.category for r in keywords.first_category(df, rules, F.col("text")).collect()}
    assert first == {i: "UNKNOWN" if t is None else next((f"c{k}" for k, w in enumerate(words) if w and w.lower() in t.lower()), "OTHER") for i, t in enumerate(texts)}

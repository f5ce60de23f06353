"""Many alike texts: what meets by a gram is thinned out before it is compared."""

from pyspark.sql import functions as F

from tallyline.operators import similar


def test_bits_never_understate_what_is_common(spark):
    texts = spark.range(120).select(F.concat((F.col("id") % 40 + 100).cast("string"), F.lit(" blue ring street brand "), F.col("id") * 7, F.repeat(F.lit(" abcdefgh ijklmnop"), (F.col("id") % 9).cast("int"))).alias("plain"))
    rows = similar._entries(texts, 3).collect()
    count = [sum((x & ((1 << 64) - 1)).bit_count() for x in r.bits) for r in rows]
    for a, pop in zip(rows, count, strict=True):
        for b in rows:
            most = sum((x & y & ((1 << 64) - 1)).bit_count() for x, y in zip(a.bits, b.bits, strict=True)) + a.n - pop
            assert most >= len(set(a.grams) & set(b.grams))


def test_best_of_many_alike_texts(spark, monkeypatch):
    monkeypatch.setattr(similar, "TASK_PAIRS", 50)  # hot grams are spread over many tasks
    right = [f"{k % 37 + 100} blue ring street, brand {k % 25}" for k in range(200)]
    left = [t.replace("street", "st") for t in right[:60]] + right[60:90] + [t[4:] + " zz" for t in right[90:110]] + ["nothing like it"]
    a, b = (spark.createDataFrame([(t,) for t in x], "t string") for x in (left, right))

    def grams(t):
        w = "||" + " ".join(t.replace(",", " ").split()) + "||"
        return {w[i:i + 3] for i in range(len(w) - 2)}

    plain = {" ".join(t.replace(",", " ").split()) for t in right}
    want = {}
    for t in {" ".join(t.replace(",", " ").split()) for t in left}:
        best = min((-len(grams(t) & grams(p)) / len(grams(t) | grams(p)), p) for p in plain)
        if -best[0] >= 0.6:
            want[t] = (best[1], round(-best[0], 9))
    assert {r.a: (r.b, round(r.similarity, 9)) for r in similar.best_matches(a, b, "t", "t", 0.6).collect()} == want

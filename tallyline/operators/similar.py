"""Lookup of texts that are alike but not equal: a set-similarity join on q-grams.

Texts are put into one form, equal ones become one entry, and an entry is the set of its q-grams. Two sets of Jaccard similarity of
at least t share a gram among the first ``n - ceil(t n) + 1`` of each, whatever order is the same for both; rare grams
come first here, so few entries meet. Sizes differ by the factor t at most, and the size is part of the join key, so it is an equality
join on (gram, size). Of what meets a pair goes on if the bits of its grams allow the similarity, and is then compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import lookup_join
from ..session import cut_lineage

#: Longs that hold the bits of the grams of a text.
WORDS = 4
#: Pairs a task should compare.
TASK_PAIRS = 10_000_000
#: Likenesses at which best matches are looked for before the least one.
LEVELS = (0.8,)


def plain_text(text: Column) -> Column:
    """Lower case, with one blank for each run of other characters than letters and digits; an empty result is null."""
    out = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(out != "", out)


def grams(text: Column, q: int) -> Column:
    """The different substrings of ``q`` characters of the text with ``q - 1`` bars on both sides."""
    edge = F.lit("|" * (q - 1))
    whole = F.concat(edge, text, edge)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(whole) - (q - 1)), lambda i: F.substring(whole, i, q)))


def _entries(plain: DataFrame, q: int) -> DataFrame:
    """(id, plain, grams, n, bits) of different texts: each gram sets one bit."""
    out = plain.withColumn("grams", grams(F.col("plain"), q)).withColumn("n", F.size("grams"))
    bit = f"pmod(xxhash64(g), {64 * WORDS})"
    bits = [F.expr(f"aggregate(grams, 0L, (x, g) -> x | if({bit} div 64 = {w}, shiftleft(1L, cast({bit} % 64 as int)), 0L))") for w in range(WORDS)]
    return cut_lineage(out.withColumns({"bits": F.array(*bits), "id": F.monotonically_increasing_id()}))


def _plains(df: DataFrame, text: str) -> DataFrame:
    """(plain) of the different texts."""
    return df.select(plain_text(F.col(f"`{text}`").cast("string")).alias("plain")).filter("plain is not null").distinct()


def _prefixes(entries: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(id, n, bits, gram): the grams of each entry that have to be looked up, rare ones first."""
    counted = lookup_join(entries.select("id", "n", "bits", F.explode("grams").alias("gram")), counts, ["gram"])
    order = counted.groupBy("id", "n", "bits").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram"))).alias("order"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1
    return order.select("id", "n", "bits", F.explode(F.slice("order", F.lit(1), length.cast("int"))["gram"]).alias("gram"))


def alike(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: float = 0.6, q: int = 3) -> DataFrame:
    """(a, b, similarity): different plain texts of both sides whose q-gram sets have a Jaccard similarity of at least ``least``.

    Texts without a letter or digit, and nulls, match nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    return _pairs(_entries(_plains(left, left_text), q), _entries(_plains(right, right_text), q), least)


def _pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    counts = b.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    low, high = F.ceil(F.col("n") * F.lit(least) - 1e-9), F.floor(F.col("n") / F.lit(least) + 1e-9)
    asked = _prefixes(a, counts, least).select(F.col("id").alias("ia"), "gram", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    filed = cut_lineage(_prefixes(b, counts, least).select(F.col("id").alias("ib"), "gram", F.col("n").alias("size"), F.col("bits").alias("bb")))
    asked = cut_lineage(asked.join(filed.select("gram", "size").distinct(), ["gram", "size"], "left_semi"))
    # what meets is many times what is filed: each task gets a share of the pairs, not of the rows
    meets = asked.groupBy("gram", "size").count().join(filed.groupBy("gram", "size").agg(F.count(F.lit(1)).alias("filed")), ["gram", "size"])
    total = meets.agg(F.sum(F.col("count") * F.col("filed"))).first()[0] or 0
    salts = meets.select("gram", "size", F.ceil(F.col("count") * F.col("filed") / F.lit(TASK_PAIRS)).alias("salts"))
    tasks = max(1, -(-int(total) // TASK_PAIRS))
    asked = lookup_join(asked, salts, ["gram", "size"]).withColumn("salt", F.pmod(F.xxhash64("ia"), F.col("salts"))).drop("salts")
    filed = filed.join(salts, ["gram", "size"]).withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))).drop("salts")
    met = asked.repartition(tasks, "gram", "size", "salt").join(filed.repartition(tasks, "gram", "size", "salt").hint("merge"), ["gram", "size", "salt"])
    # grams that fall on one bit count once in it: at most so many grams are common
    most = sum((F.bit_count(F.col("ba")[i].bitwiseAND(F.col("bb")[i])) for i in range(WORDS)), F.lit(0)) + F.col("na") - sum((F.bit_count(F.col("ba")[i]) for i in range(WORDS)), F.lit(0))
    pairs = met.filter(most >= F.lit(least / (1 + least)) * (F.col("na") + F.col("size")) - 1e-9).select("ia", "ib").distinct()
    both = pairs.join(a.select(F.col("id").alias("ia"), F.col("plain").alias("a"), F.col("grams").alias("ga")), "ia").join(b.select(F.col("id").alias("ib"), F.col("plain").alias("b"), F.col("grams").alias("gb")), "ib")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("similarity")).filter(F.col("similarity") >= least - 1e-12)


def best_matches(left: DataFrame, right: DataFrame, left_text: str, right_text: str, least: float = 0.6, q: int = 3) -> DataFrame:
    """(a, b, similarity): for each plain text of ``left`` the most similar one of ``right``, the smaller text among equals; see ``alike``.

    Equal texts need no search. The others are searched for at falling likeness, and leave as soon as something is found.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    a, b = cut_lineage(_plains(left, left_text)), _entries(_plains(right, right_text), q)
    out = a.join(b.select("plain"), "plain").select(F.col("plain").alias("a"), F.col("plain").alias("b"), F.lit(1.0).alias("similarity"))
    rest = _entries(a.join(b.select("plain"), "plain", "left_anti"), q)
    for level in [*(x for x in LEVELS if x > least), least]:
        best = _pairs(rest, b, level).groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "b")).alias("m"))
        best = cut_lineage(best.select("a", "m.b", (-F.col("m.s")).alias("similarity")))
        out, rest = out.unionByName(best), rest.join(best.select(F.col("a").alias("plain")), "plain", "left_anti")
    return out

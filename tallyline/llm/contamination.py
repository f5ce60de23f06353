"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item inside a long document has a tiny Jaccard similarity with it, so the search is for containment: the share of the
item's shingles that the document holds. Items are partitioned by size; the partition's largest size ``n`` sets the length
of its sketches, the ``n - ceil(t n) + 1`` least hashes of an item's shingles. A document that holds at least the share ``t``
lacks fewer shingles than that, so it holds one of the sketch: no contained item is lost. Documents' shingles are
probed against the sketches, candidates are verified by exact shingle containment.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, WORD_GAP, packed, stored, with_row_key

#: Sketch entries (16 bytes each) and item text bytes up to which they are broadcast.
MOST_ENTRIES = 1_000_000
MOST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null. Only A-Z change case."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.coalesce(lower, F.lit("")), WORD_GAP), lambda w: w != "")


def windows(words: str, size: int, of: str) -> str:
    """SQL of the array of a text's runs of ``size`` words, as text joined by a space ('text') or as hashes ('hash'); empty where there are fewer words."""
    each = ", ".join(f"{words}[i + {k}]" for k in range(size))
    one = f"concat_ws(' ', {each})" if of == "text" else f"xxhash64({each})"
    return f"if(size({words}) >= {size}, transform(sequence(0, size({words}) - {size}), i -> {one}), array())"


def item_shingles(items: DataFrame, item_column: str, text: str, size: int) -> DataFrame:
    """(item, length, shingles, hashes, n): the distinct shingles of each item that has words, and their hashes; ``length`` is the words of a shingle.

    An item of fewer words than a shingle has its whole word sequence as its only one.
    """
    words = items.select(F.col(f"`{item_column}`").alias("item"), words_of(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)

    def by_length(of: str) -> str:
        return "array_distinct(CASE " + " ".join(f"WHEN size(w) {'=' if k < size else '>='} {k} THEN {windows('w', k, of)}" for k in range(1, size + 1)) + " END)"

    return words.select("item", F.least(F.size("w"), F.lit(size)).alias("length"), F.expr(by_length("text")).alias("shingles"), F.expr(by_length("hash")).alias("hashes")).withColumn("n", F.size("shingles"))


def sketches(shingled: DataFrame, threshold: float) -> DataFrame:
    """(item, hash): MinHash sketches whose length is that of the item's size partition (sizes up to 8, 16, 32, ...)."""
    top = F.expr("cast(greatest(8, pow(2, ceil(log2(n)))) as int)")
    length = (top - F.ceil(top * F.lit(threshold) - 1e-9) + 1).cast("int")
    return shingled.select("item", F.explode(F.slice(F.sort_array("hashes"), F.lit(1), length)).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text",
              shingle: int = 5, threshold: float = 0.8, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(row key, item, n, common, containment): every document and item with containment of at least ``threshold``.

    Containment is the number of the item's distinct shingles that the document holds, over their number ``n``. Words are lower-cased (A-Z)
    and split at white space. The only shingle of a shorter item is its whole word sequence; items without words and null texts are never found.
    Items of equal or null id count each for itself and show as such rows. Equal documents are found each for itself.
    An empty table on either side gives no rows. A document's shingles are made once for the search and once more if it is a candidate,
    whatever number of items it may hold.
    """
    key = "_item"
    keyed_items = stored(with_row_key(items.select(F.col(f"`{item_column}`").alias("item_id"), F.col(f"`{item_text}`").alias("t")), key), "items")
    shingled = item_shingles(keyed_items, key, "t", shingle)
    sketch = stored(sketches(shingled, threshold), "sketches")
    whole = stored(shingled.select("item", "length", F.explode("shingles").alias("shingle"), "n"), "shingles")
    size, lengths = whole.agg(F.coalesce(F.sum(F.octet_length("shingle") + 24), F.lit(0)), F.sort_array(F.collect_set("length"))).first()  # lengths: 1 to ``shingle``
    if not lengths:
        lengths = [shingle]
    words = with_row_key(docs.select(F.col(f"`{text}`").alias("t"))).select(ROW, words_of(F.col("t")).alias("w"))

    def in_documents(of: str, name: str, source: DataFrame) -> DataFrame:
        return source.select(ROW, F.explode(F.expr("array_distinct(concat(" + ", ".join(windows("w", k, of) for k in lengths) + "))")).alias(name))

    few = sketch.count() <= most_entries and size <= most_bytes
    probes = in_documents("hash", "hash", words)
    candidates = stored(probes.join(F.broadcast(sketch) if few else sketch, "hash").select(ROW).distinct(), "candidates")
    chosen = words.join(F.broadcast(candidates) if candidates.count() <= most_entries else candidates, ROW, "left_semi")
    held = in_documents("text", "shingle", chosen).join(F.broadcast(whole) if few else whole, "shingle")
    checked = held.groupBy(ROW, "item", "n").agg(F.count("*").alias("common")).withColumn("containment", F.col("common") / F.col("n"))
    pairs = checked.where(F.col("common") >= F.ceil(F.col("n") * F.lit(threshold) - 1e-9))
    names = keyed_items.select(F.col(key).alias("item"), "item_id")
    return pairs.join(names, "item").select(ROW, "item_id", F.col("n").cast("long").alias("n"), "common", "containment")


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no item; see ``contained``."""
    found = stored(contained(docs, items, **how).select(F.col(ROW).alias("row")).distinct(), "leaks")
    return packed(docs).join(found, "row", "left_anti").select("doc.*")

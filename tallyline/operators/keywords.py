"""Keyword rules held in a table: which rule of many a text meets first.

A text meets a rule if its lower-cased form contains the rule's keyword. With a handful of keywords this is an expression
(``functions.text``); here the keywords are rows, as many as there may be. Each keyword is filed under one of its parts: of the parts of the greatest
size in ``SIZES`` that fits into it, the one fewest keywords share. All parts of the different texts are looked up there by equality of their
64-bit hashes, and only what meets is tested for containment. A bitmap of fixed size tells a text which of its parts are worth looking up.

Parts are strings of bytes: UTF-8 texts contain each other just where their bytes do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.joins import lookup_join
from ..session import cut_lineage, ship_package

#: Bytes of a part, each one the sum of two before it (see ``part_hashes``).
SIZES = (1, 2, 3, 4, 6, 8, 12, 16)
#: The bitmap has 2^27 bits (16 MB) in blocks of 2^20, however many keywords there are.
BITS, BLOCK_BITS = 27, 20
U64 = np.uint64
BASE = np.array([0x9E3779B97F4A7C15], U64)


def part_hashes(data: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size the 64-bit hashes of the parts that start at each byte, as far as they fit."""
    known, power = {1: data.astype(U64) + U64(1)}, {1: BASE}
    for s in SIZES[1:]:
        if s > max(sizes, default=0) or s > len(data):
            break
        a, b = s - s // 2, s // 2
        power[s] = power[a] * power[b]
        known[s] = known[a][:len(data) - s + 1] * power[b] + known[b][a:a + len(data) - s + 1]
    out = {}
    for s in sizes:
        h = known[s] + U64(s) if s in known and s <= len(data) else np.zeros(0, U64)
        h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
        out[s] = h ^ (h >> U64(32))
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row, and where each one starts and the last one ends."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), at


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each part behind the columns of the row."""
    for batch in batches:
        hashes = [int(part_hashes(np.frombuffer(x, np.uint8), [len(x)])[len(x)][0].view(np.int64)) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), *batch.columns[1:]], ["hash", *batch.schema.names[1:]])


def keyword_index(rules: DataFrame, keyword: str = "keyword", category: str = "category", order: str = "position") -> DataFrame:
    """(part, keyword, category, position): each keyword under its rarest part (bytes) of the greatest size that fits, the smaller one on ties.

    Keywords are lower-cased; null and empty ones are left out, of equal ones the first rule counts.
    """
    low = F.lower(F.col(f"`{keyword}`"))
    words = rules.filter(F.length(low) > 0).groupBy(low.alias("keyword")).agg(F.min(F.struct(F.col(f"`{order}`").alias("position"), F.col(f"`{category}`").alias("category"))).alias("r"))
    words = words.select("keyword", "r.category", "r.position")
    raw, n = F.encode("keyword", "UTF-8"), F.octet_length("keyword")
    size = F.array_max(F.filter(F.array(*[F.lit(s) for s in SIZES]), lambda s: s <= n))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(raw, i, size)))
    each = words.select("keyword", F.explode(parts).alias("part"))
    counted = lookup_join(each, each.groupBy("part").count(), ["part"])
    rarest = counted.groupBy("keyword").agg(F.min(F.struct("count", "part")).alias("g"))
    return words.join(rarest, "keyword").select("g.part", "keyword", "category", "position")


def _bitmap(index: DataFrame) -> np.ndarray:
    """The bits of all filed hashes, put together block by block in tasks."""
    def block(rows: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK_BITS, bool)
        bits[rows.column("bit").to_numpy()] = True
        return pa.table({"block": rows.column("block").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    top = F.shiftrightunsigned("hash", 64 - BITS)
    bits = index.select(F.shiftright(top, BLOCK_BITS).alias("block"), top.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("bit")).distinct()
    out = np.zeros((1 << BITS - BLOCK_BITS, 1 << BLOCK_BITS - 3), np.uint8)
    for r in bits.groupBy("block").applyInArrow(block, "block long, bits binary").toLocalIterator():      # 128 blocks of 128 kB
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _asked(sizes: list[int], bitmap):
    """Arrow function from (_text, low) to (_text, hash): the different parts of each text that may be filed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            data, at = _bytes(batch.column(1))
            for first in range(0, batch.num_rows, 256):
                who, what = [], []
                for i in range(first, min(first + 256, batch.num_rows)):
                    h = np.concatenate([*part_hashes(data[at[i]:at[i + 1]], sizes).values()])
                    top = h >> U64(64 - BITS)
                    h = np.unique(h[(bits[(top >> U64(3)).astype(np.int64)] >> (top & U64(7)).astype(np.uint8)) & 1 == 1])
                    who.append(np.full(len(h), i))
                    what.append(h)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(who))), pa.array(np.concatenate(what).view(np.int64))], ["_text", "hash"])

    return run


def _met(df: DataFrame, rules: DataFrame, text: Column, **names: str) -> DataFrame:
    """(_text, met): the different texts by their digest with the rules they meet, in order."""
    spark = df.sparkSession
    ship_package(spark)
    index = keyword_index(rules, **names)
    kinds = {f.name: f.dataType.simpleString() for f in index.schema.fields}
    filed = cut_lineage(index.mapInArrow(_filed, f"hash long, keyword string, category {kinds['category']}, position {kinds['position']}"))
    lengths = filed.select(F.array_max(F.filter(F.array(*[F.lit(s) for s in SIZES]), lambda s: s <= F.octet_length("keyword"))).alias("size")).distinct()
    sizes = sorted(r["size"] for r in lengths.collect())      # at most one for each of SIZES
    low = df.select(F.lower(text).alias("low")).filter("low is not null").withColumn("_text", F.sha2("low", 256)).dropDuplicates(["_text"]).select("_text", "low")
    asked = low.mapInArrow(_asked(sizes, spark.sparkContext.broadcast(_bitmap(filed))), "_text string, hash long")
    near = asked.join(filed, "hash").groupBy("_text").agg(F.collect_list(F.struct("position", "category", "keyword")).alias("near"))
    met = F.array_sort(F.filter("near", lambda r: F.contains(F.col("low"), r["keyword"])))
    return low.join(near, "_text").select("_text", met.alias("met")).filter(F.size("met") > 0)


def first_category(df: DataFrame, rules: DataFrame, text: Column, out: str = "category", missing: str | None = "UNKNOWN", other: str | None = "OTHER", **names: str) -> DataFrame:
    """Add ``out``: the category of the first rule (least position) whose keyword the text contains, ``other`` if there is none, ``missing`` for a null text."""
    found = _met(df, rules, text, **names).select("_text", F.get("met", 0)["category"].alias("_category"))
    keyed = df.withColumn("_text", F.sha2(F.lower(text), 256))
    joined = lookup_join(keyed, found, ["_text"])
    return joined.withColumn(out, F.when(F.col("_text").isNull(), F.lit(missing)).otherwise(F.coalesce("_category", F.lit(other)))).drop("_text", "_category")


def keyword_hits(df: DataFrame, rules: DataFrame, text: Column, out: str = "keywords", **names: str) -> DataFrame:
    """Add ``out``: all keywords that the text contains, in the order of the rules; empty without any."""
    found = _met(df, rules, text, **names).select("_text", F.transform("met", lambda r: r["keyword"]).alias("_met"))
    keyed = df.withColumn("_text", F.sha2(F.lower(text), 256))
    return lookup_join(keyed, found, ["_text"]).withColumn(out, F.coalesce("_met", F.array().cast("array<string>"))).drop("_text", "_met")

"""Sharding by global byte-size prefix sums.

Rows are put in order of a key by a range partitioning. Each partition's total is one row; their running sum gives every
partition the bytes and rows before it, and a running sum inside the partition gives them for each row. Shards are
cut where the prefix sum passes equal shares of the total, so they are contiguous in the order and balanced
to within one document. Copies have no say in it: equal texts may fall in different shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ROW, map_arrow, packed, stored, with_row_key
from .tokenfiles import current_partition


def text_bytes(text: str):
    """UTF-8 bytes of a text column, none for null, and one for its end."""
    return F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the partition's number and the bytes and rows before each row inside it."""
    size = rows = 0
    part = current_partition()
    for batch in batches:
        n = batch.num_rows
        own = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
        before = size + np.cumsum(own) - own
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(before), pa.array(np.arange(rows, rows + n))],
                                         [*batch.schema.names, "part", "bytes_before", "rows_before"])
        size, rows = size + int(own.sum()), rows + n


def shard_rows(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """``rows`` (with a ``size`` column, long and positive) with ``shard`` and ``slot``.

    Ties of the order are settled by the size and the row key, so any one value may hold any share of the rows.
    The place of a row is fixed by what is written: a lost executor re-reads it.
    """
    spark = rows.sparkSession
    keys = [*[F.col(f"`{c}`").asc_nulls_first() for c in order], F.col(ROW)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    added = T.StructType.fromDDL("part long, bytes_before long, rows_before long")
    placed = stored(map_arrow(dealt, numbered, T.StructType([*rows.schema.fields, *added.fields])), "placed")
    totals = placed.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("r")).orderBy("part").collect()  # one row per partition
    part_at, size, count = {}, 0, 0
    for t in totals:
        part_at[t.part] = (size, count)
        size, count = size + t.b, count + t.r
    if not part_at:
        return placed.select(*rows.columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    table = F.create_map(*[x for p, (b, r) in part_at.items() for x in (F.lit(p), F.array(F.lit(b), F.lit(r)))])
    at = table[F.col("part")]
    start = F.col("bytes_before") + at[0]
    # the shard holding the middle byte of the row: 2 * start + size of 2 * total
    shard = F.least(F.lit(shards - 1), F.expr(f"({shards} * (2 * _start + size)) div {2 * size}")).cast("int")
    cut = placed.withColumn("_start", start).withColumn("_place", F.col("rows_before") + at[1]).withColumn("shard", shard)
    firsts = cut.groupBy("shard").agg(F.min("_place").alias("first")).collect()  # one row per shard
    first = F.create_map(*[x for f in firsts for x in (F.lit(f.shard), F.lit(f.first))])
    return cut.withColumn("slot", (F.col("_place") - first[F.col("shard")]).cast("long")).select(*rows.columns, "shard", "slot")


def assign(docs: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(row key, id, size, text_crc32, shard, slot) of every row; texts themselves are not shuffled.

    Shards are contiguous ranges of ids (nulls first) with near equal bytes; slots are gapless from 0 in each shard, in
    that order. A null text has size 1 and the checksum of the empty text. Rows of equal id keep the table's order.
    Fewer rows than shards leave shards empty; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    crc = F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    slim = with_row_key(docs).select(ROW, F.col(f"`{id_column}`").alias("id"), text_bytes(text).alias("size"), crc.alias("text_crc32"))
    return shard_rows(slim, ["id"], shards)


def write_shards(docs: DataFrame, shards: int, path: str, id_column: str = "doc_id", text: str = "text", files: int = 1) -> None:
    """Write the rows of ``docs`` into ``path/shard=k``, ``files`` files a shard by ranges of slots, in slot order."""
    places = assign(docs, shards, id_column, text).select(F.col(ROW).alias("row"), "shard", "slot")
    others = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    full = packed(docs.select(*[F.col(f"`{c}`") for c in others])).join(places, "row").select("doc.*", "shard", "slot")
    full.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Best-fit packing of token sequences by hierarchical residual packing.

Partitions pack their pieces best-fit decreasing and emit the bins that are nearly full. Underfull bins become
items themselves: a round deals them to fewer tasks, which pack them best-fit again, and so on up a tree. A task never gets
more than ``most_items`` items: a round over more bins than that stays spread. Bins that not even the emptiest one fits into leave
as they are, and the tree ends when a round neither saves a bin nor lets one leave, so no task ever gathers the whole corpus.
A bin has at most ``capacity`` pieces, so a row is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ROW, map_arrow, packed, stored, with_row_key
from .tokens import crc, encoder

PIECE = "row long, piece int, start long, length int, ids_crc32 long"
BIN = f"round int, fill int, pieces array<struct<{PIECE.replace(' ', ':').replace(',:', ',')}>>"


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item: items by falling length, each into the fullest bin that holds it."""
    bins = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, count = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            stack = free[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            b, room = count, capacity
            count += 1
        bins[i] = b
        room -= size
        if room:
            if not free[room]:
                mask |= 1 << room
            free[room].append(b)
    return bins


def token_pieces(docs: DataFrame, text: str, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(row, piece, start, length, ids_crc32) of each piece; documents are keyed by their row key."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(value.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out.append((row, k, at // 4, len(part) // 4, crc(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds],
                                             ["row", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(ROW, F.col(f"`{text}`")), run, PIECE)


def pack_task(capacity: int, spare: int, round_: int):
    """Arrow function from bins (fill, pieces) to bins; the whole task is packed at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        fill = table.column("fill").to_numpy()
        bins = best_fit(fill, capacity)
        order = np.argsort(bins, kind="stable")
        pieces = table.column("pieces").combine_chunks().take(pa.array(order))
        counts = pieces.value_lengths().to_numpy(zero_copy_only=False)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(bins[order]) > 0]))
        fills = np.add.reduceat(fill[order].astype(np.int64), heads)
        ends = np.append(np.cumsum(np.add.reduceat(counts, heads)), 0)
        offsets = np.concatenate([[0], ends[:-1]])
        flat = pieces.flatten()
        step = 2000
        for a in range(0, len(heads), step):
            b = min(a + step, len(heads))
            lo, hi = offsets[a], offsets[b]
            lists = pa.ListArray.from_arrays(pa.array((offsets[a:b + 1] - lo).astype(np.int32)), flat.slice(lo, hi - lo))
            level = np.where(capacity - fills[a:b] <= spare, round_, -1)
            yield pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), pa.array(fills[a:b].astype(np.int32)), lists], ["round", "fill", "pieces"])

    return run


def packed_bins(pieces: DataFrame, capacity: int, spare: int = 2, most_items: int = 50_000) -> DataFrame:
    """(sequence_id, pieces): bins of at most ``capacity`` tokens.

    A bin with at most ``spare`` free places is nearly full and leaves the tree.
    """
    spark = pieces.sparkSession
    items = pieces.select(F.lit(-1).alias("round"), F.col("length").alias("fill"), F.array(F.struct("row", "piece", "start", "length", "ids_crc32")).alias("pieces"))
    count, parts, level = pieces.count(), [], 0
    while True:
        tasks = max(1, -(-count // most_items))
        first = F.col("pieces")[0]
        dealt = items.repartition(tasks, F.xxhash64(first["row"], first["piece"], F.lit(level))).sortWithinPartitions(F.desc("fill"), first["row"], first["piece"])
        done = stored(map_arrow(dealt, pack_task(capacity, spare, level), BIN), f"bins-{level}")
        parts.append(done.where("round >= 0"))
        items = done.where("round < 0")
        least = items.agg(F.min("fill")).first()[0] or 0
        parts.append(items.where(F.col("fill") > capacity - least))  # not even the emptiest bin fits in
        items = items.where(F.col("fill") <= capacity - least)
        left = items.count()
        if left == 0 or tasks == 1 or left >= count:
            parts.append(items)
            break
        count, level = left, level + 1
    bins = parts[0]
    for p in parts[1:]:
        bins = bins.unionByName(p)
    return bins.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")


def pack(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int = 0, capacity: int = 2048, spare: int = 2, most_items: int = 50_000) -> DataFrame:
    """Columns of ``docs`` but the text, with piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut into pieces of that length, the last may be
    shorter; others stay whole. A null text is empty and still has its end id. Offsets are gapless from 0 in each sequence.
    Equal rows are packed each for itself. Columns of ``docs`` named like the new ones are replaced. An empty table gives no rows.
    """
    keyed = with_row_key(docs.select(F.col(f"`{text}`").alias("text")))
    pieces = stored(token_pieces(keyed, "text", tokenizer, end_id, capacity), "pieces")
    bins = stored(packed_bins(pieces, capacity, spare, most_items), "sequences")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            length = flat.field("length").to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(length) - length
            head = np.cumsum(n) - n
            at = before - np.repeat(before[head], n) if len(length) else before
            seq = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([flat.field("row"), flat.field("piece"), flat.field("start"), pa.array(length), flat.field("ids_crc32"), pa.array(seq), pa.array(at)],
                                             [ROW, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = map_arrow(bins, offsets, f"{ROW} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    new = [c for c in placed.columns if c != ROW]
    others = [c for c in docs.columns if c != text and c.lower() not in new]
    if not others:
        return placed.select(*new)
    return placed.join(packed(docs.select(*[F.col(f"`{c}`") for c in others])).withColumnRenamed("row", ROW), ROW).select("doc.*", *new)

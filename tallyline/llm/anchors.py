"""Windows of a text that also start elsewhere: the routing that suffix and phrase deduplication share.

A window is ``window`` consecutive symbols (bytes or words) of one document. Each window is assigned to one
anchor, the k-gram of least hash inside it. Equal windows have equal anchors at equal distances, so
windows need comparing only within the group of an anchor:

1. every document emits its anchors with the range of windows they stand for (a few rows per thousand bytes);
2. anchors seen once are dropped, the others' windows are cut out of their documents as segments;
3. equal segments are counted, then the different segments of an anchor are compared by a ``finder``
   (suffix sort or automata), which tells what part of a segment is covered by windows that start elsewhere;
4. the covered parts go back to their documents by equality joins.

Hash collisions only bring unrelated segments together in a group; the finders compare contents. A group whose number
of different segments passes ``most_segments`` is not gathered in a task: its windows are counted by 128-bit
hashes in an aggregation with partial sums, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import (BYTE_CODES, ROW, U64, discard, map_arrow, mixed, packed, pieces, powers, prefix_hash, raw_bytes, stored, with_row_key,
                     word_bounds, word_hashes)

PIECE = 1 << 20
PLACE = U64((1 << 24) - 1)


@dataclass(frozen=True)
class Windows:
    """``unit`` is 'bytes' or 'words'; an anchor is a run of ``gram`` symbols of the window."""

    unit: str
    window: int
    gram: int
    most_segments: int = 5_000


def least_grams(codes: np.ndarray, bounds: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows inside each document: anchor hash, anchor place, first window, number of windows.

    ``codes`` holds the symbols of all documents, ``bounds`` their offsets.
    """
    n, width = len(codes), w.window - w.gram + 1
    none = np.zeros(0, np.int64)
    if n < w.window:
        return np.zeros(0, np.uint64), none, none, none
    h = prefix_hash(codes)
    _, down = powers(n)
    grams = mixed((h[w.gram:] - h[:-w.gram]) * down[:n - w.gram + 1])
    key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    rest = -len(key) % width
    blocks = np.concatenate([key, np.full(rest, ~U64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - w.window + 1
    place = (np.minimum(behind[:count], ahead[width - 1:width - 1 + count]) & PLACE).astype(np.int64)
    valid = np.ones(count, bool)
    for b in bounds[1:-1]:
        valid[max(0, b - w.window + 1):b] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(0, np.uint64), none, none, none
    p = place[at]
    begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (p[1:] != p[:-1])]))
    sizes = np.diff(np.append(begins, len(at)))
    return grams[p[begins]], p[begins], at[begins], sizes


def anchor_rows(w: Windows) -> Callable:
    """Arrow function from (row, text) to (anchor, row, first, n)."""
    def symbols(data, offsets):
        if w.unit == "bytes":
            return BYTE_CODES[data], offsets
        starts, ends, of_row = word_bounds(data, offsets)
        return word_hashes(data, starts, ends), of_row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_bytes(batch.column(1))
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            out = []
            for i, j in pieces(offsets, PIECE):
                codes, bounds = symbols(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                step, base = 8 * PIECE, 0
                while base == 0 or base + w.window <= len(codes):  # a longer document comes in overlapping parts
                    part = codes[base:base + step + w.window - 1]
                    inner = bounds if base == 0 and len(part) == len(codes) else np.array([0, len(part)])
                    anchor, _, first, n = least_grams(part, inner, w)
                    of = np.searchsorted(bounds, first + base, "right") - 1
                    out.append((anchor.view(np.int64), rows[i + of], first + base - bounds[of], n))
                    base += step
            if out:
                a, r, f, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(r), pa.array(f), pa.array(n.astype(np.int32))], ["anchor", "row", "first", "n"])

    return run


def cut_segments(w: Windows) -> Callable:
    """Arrow function from (row, text, [(anchor, first, n)]) to one row per segment with its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            hits = batch.column(2)
            flat = hits.flatten()
            anchor, first, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            ends = np.cumsum(hits.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            begin, out, where, size = 0, [], [], 0
            texts = batch.column(1)
            for k, end in enumerate(ends):
                text = texts[k].as_py() or ""
                raw = text.encode() if isinstance(text, str) else text
                words = raw.split() if w.unit == "words" else None
                for a, b in zip(first[begin:end].tolist(), n[begin:end].tolist(), strict=True):
                    part = raw[a:a + b + w.window - 1] if words is None else b" ".join(words[a:a + b + w.window - 1])
                    out.append(part)
                    size += len(part)
                where.append(np.arange(begin, end))
                begin = end
                if size > 8 << 20 or k == len(ends) - 1:
                    pick = np.concatenate(where)
                    of = np.repeat(rows[k + 1 - len(where):k + 1], [len(x) for x in where])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[pick]), pa.array(of), pa.array(first[pick]), pa.array(n[pick]), pa.array(out, pa.binary())],
                                                     ["anchor", "row", "first", "n", "segment"])
                    out, where, size = [], [], 0

    return run


def merged_runs(flags: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Covered symbol ranges of a segment whose repeated windows are flagged; touching ranges are joined."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    gap = np.flatnonzero(at[1:] - at[:-1] > window)
    return at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + window


def group_rows(finder: Callable, most_bytes: int = 1 << 20) -> Callable:
    """Arrow function that hands runs of whole anchor groups to ``finder(anchors, copies, segments)``.

    The input is sorted by anchor: (anchor, mark, n, copies, segment). The finder yields (index, lo, hi).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def work(rows):
            found = list(finder([r[0] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[2] for r in rows]))
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i, _, _ in found], pa.int64()), pa.array([rows[i][1] for i, _, _ in found], pa.int64()),
                 pa.array([lo for _, lo, _ in found], pa.int64()), pa.array([hi for _, _, hi in found], pa.int64())],
                ["anchor", "mark", "lo", "hi"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= most_bytes and r[0] != held[-1][0]:
                    yield work(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield work(held)

    return run


def window_hashes(w: Windows) -> Callable:
    """Arrow function from (anchor, mark, n, copies, segment) to a row for each window with a 128-bit hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, mark, n, copies, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(segment, np.uint8)
                codes = BYTE_CODES[data]
                if w.unit == "words":
                    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
                    codes = word_hashes(data, starts, ends)
                both = []
                for c in (codes, mixed(codes ^ U64(0x9E3779B97F4A7C15))):
                    h = prefix_hash(c)
                    both.append(mixed((h[w.window:] - h[:-w.window]) * powers(len(c))[1][:n]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(np.full(n, mark)), pa.array(np.arange(n)), pa.array(np.full(n, copies)), *map(pa.array, both)],
                                                 ["anchor", "mark", "place", "copies", "h1", "h2"])

    return run


def hot_covered(hot: DataFrame, w: Windows) -> DataFrame:
    """Covered parts of the segments of groups too large for one task, by counting window hashes."""
    each = map_arrow(hot, window_hashes(w), "anchor long, mark long, place long, copies long, h1 long, h2 long")
    again = each.groupBy("h1", "h2").agg(F.sum("copies").alias("c")).where("c >= 2").select("h1", "h2")
    return each.join(again, ["h1", "h2"]).select("anchor", "mark", F.col("place").alias("lo"), (F.col("place") + w.window).alias("hi"))


def repeated_spans(docs: DataFrame, text: str, w: Windows, finder: Callable) -> DataFrame:
    """Per row key the sorted, disjoint symbol ranges covered by windows that also start elsewhere.

    Rows without such ranges are absent. Null texts are empty; rows with equal ids count as different documents,
    so each of two equal rows is repeated. The input must read alike each time (see ``with_row_key``).
    """
    base = with_row_key(docs.select(F.col(f"`{text}`").alias("text"))).select(F.col(ROW).alias("row"), "text")
    seen = stored(map_arrow(base, anchor_rows(w), "anchor long, row long, first long, n int"), "anchors")
    again = stored(seen.groupBy("anchor").count().where("count >= 2").select("anchor"), "again")
    hits = seen.join(again, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("hits"))
    cut = map_arrow(base.join(hits, "row").select("row", "text", "hits"), cut_segments(w), "anchor long, row long, first long, n int, segment binary")
    segments = stored(cut.withColumn("mark", F.xxhash64("segment")), "segments")
    discard(seen, again)
    different = segments.groupBy("anchor", "mark", "n", "segment").agg(F.count("*").alias("copies")).select("anchor", "mark", "n", "copies", "segment")
    different = stored(different, "different")
    crowded = different.groupBy("anchor").count().where(F.col("count") > w.most_segments).select("anchor")
    crowded = stored(crowded, "crowded")  # at most rows / most_segments anchors
    small = different
    covered = None
    if not crowded.isEmpty():
        small = different.join(crowded, "anchor", "left_anti")
        covered = hot_covered(different.join(crowded, "anchor", "left_semi").select(*different.columns), w)
    grouped = small.select(*different.columns).repartition("anchor").sortWithinPartitions("anchor")
    found = map_arrow(grouped, group_rows(finder), "anchor long, mark long, lo long, hi long")
    covered = stored(found if covered is None else found.unionByName(covered), "covered")
    discard(different, crowded)
    places = segments.select("anchor", "mark", "row", "first").join(covered, ["anchor", "mark"])
    return places.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi")).alias("end")))).alias("parts"))


def union_spans(parts: list[dict]) -> list[tuple[int, int]]:
    """Maximal ranges of sorted (start, end) parts; touching parts become one."""
    out: list[list[int]] = []
    for p in parts:
        a, b = p["start"], p["end"]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_spans(docs: DataFrame, text: str, spans: DataFrame, cut: Callable[[bytes, list[tuple[int, int]]], bytes], kept_type: str) -> DataFrame:
    """``docs`` with the columns ``kept`` (what is left of the text) and ``spans`` added; clashing names are replaced.

    ``cut(text, spans)`` gives the bytes left of one document.
    """
    others = [f for f in docs.schema.fields if f.name.lower() not in ("kept", "spans")]
    source = packed(docs).join(spans, "row", "left").select("doc", F.col("doc").getField(text).alias("text"), "parts")
    kind = pa.string() if kept_type == "string" else pa.binary()
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            kept, spans_of = [], []
            for value, parts in zip(batch.column(1), batch.column(2), strict=True):
                raw = value.as_py()
                raw = b"" if raw is None else raw.encode() if isinstance(raw, str) else raw
                found = union_spans(parts.as_py() or [])
                left = cut(raw, found)
                kept.append(left.decode() if kept_type == "string" else left)
                spans_of.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([*[doc.field(c) for c in names], pa.array(kept, kind), pa.array(spans_of, kinds)], [*names, "kept", "spans"])

    return map_arrow(source, run, T.StructType([*others, *T.StructType.fromDDL(f"kept {kept_type}, spans array<struct<start:long,end:long>>").fields]))

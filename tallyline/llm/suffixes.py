"""Substring deduplication on bytes by a hash-compared suffix sort.

Prefix polynomial hashes of the buffer give the hash of any substring in constant time; a binary search over the
length then finds how far two suffixes agree, so one comparison takes logarithmically many steps whatever the
length of the common part. A bottom-up mergesort with these comparisons orders the suffixes of each bucket,
neighbours that agree over a whole window are repeated, and their bytes are compared before they count.

Buckets are the windows at equal distance from an equal anchor (see ``anchors``): windows in different buckets
differ, so the order between buckets is never needed, and buckets are spread over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .anchors import Windows, merged_runs, repeated_spans, without_spans
from .common import BYTE_CODES, U64, mixed, powers, prefix_hash


class Suffixes:
    """Suffixes of a byte buffer, compared up to ``depth`` bytes."""

    def __init__(self, data: np.ndarray, depth: int, round_: int = 0):
        self.data, self.depth = data, depth
        codes = BYTE_CODES if round_ == 0 else mixed(BYTE_CODES + U64(round_)) | U64(1)
        self.h = prefix_hash(codes[data])
        self.down = powers(len(data))[1]

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return (self.h[start + length] - self.h[start]) * self.down[start]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at ``a`` and ``b`` share, at most ``depth``, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.depth)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.hash(a, mid) == self.hash(b, mid)
            lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at ``a`` stands before, with or after the one at ``b``."""
        out = np.zeros(len(a), np.int8)
        differ = np.flatnonzero(self.hash(a, self.depth) != self.hash(b, self.depth))
        if len(differ):
            a, b = a[differ], b[differ]
            n = np.minimum(self.common(a, b), self.depth - 1)
            x, y = self.data[a + n], self.data[b + n]
            out[differ] = np.where(x < y, -1, (x > y).astype(np.int8))
        return out

    def sorted(self, starts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """``starts`` in suffix order inside each bucket; ``bucket`` is ascending. All buckets are merged side by side."""
        order = starts.copy()
        n = len(starts)
        if not n:
            return order
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(heads, n))
        width = 1
        while width < sizes.max():
            big = sizes > width
            index = np.concatenate([np.arange(h, h + s) for h, s in zip(heads[big], sizes[big], strict=True)]) if big.sum() < 1000 else np.flatnonzero(np.repeat(big, sizes))
            head = np.repeat(heads[big], sizes[big])
            size = np.repeat(sizes[big], sizes[big])
            place = index - head
            run = place // width
            other = (run ^ 1) * width
            length = np.clip(size - other, 0, width)
            left = (run & 1) == 0
            lo, hi = np.zeros(len(index), np.int64), length.copy()
            while True:
                act = np.flatnonzero(lo < hi)
                if not len(act):
                    break
                mid = (lo[act] + hi[act]) >> 1
                c = self.compare(order[head[act] + other[act] + mid], order[index[act]])
                before = (c < 0) | ((c == 0) & ~left[act])
                lo[act] = np.where(before, mid + 1, lo[act])
                hi[act] = np.where(before, hi[act], mid)
            to = head + (run >> 1) * 2 * width + place % width + lo
            merged = order.copy()
            merged[to] = order[index]
            order = merged
            width *= 2
        return order

    def verified(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the first ``depth`` bytes at ``a`` and ``b`` are equal, read once for runs of shifted pairs."""
        if not len(a):
            return True
        s = np.argsort(a, kind="stable")
        a, b = a[s], b[s]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] - a[:-1] != 1) | (b[1:] - b[:-1] != 1)]))
        lasts = np.append(cut[1:], len(a)) - 1
        return all(np.array_equal(self.data[a[i]:a[j] + self.depth], self.data[b[i]:b[j] + self.depth]) for i, j in zip(cut, lasts, strict=True))


def find_repeats(window: int):
    """Finder for ``repeated_spans``: covered parts of segments by suffix sort."""
    def finder(anchors: list[int], copies: list[int], segments: list[bytes], counts: list[int]) -> Iterator[tuple[int, int, int]]:
        data = np.frombuffer(b"".join(segments), np.uint8)
        base = np.concatenate([[0], np.cumsum([len(s) for s in segments])])
        n = np.array(counts)
        group = np.array(anchors)
        changes = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        alone = np.zeros(len(group), bool)
        sizes = np.diff(np.append(changes, len(group)))
        alone[changes[sizes == 1]] = True
        whole = np.array(copies) > 1  # an equal segment starts elsewhere, so do all its windows
        flags = [np.full(k, w) for k, w in zip(counts, whole, strict=True)]
        work = np.flatnonzero(~alone)
        if len(work):
            # distance of a window to its anchor: windows of a group meet in buckets of equal distance
            number = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)]))
            lead = anchor_places(data, base, n, anchors, window)
            seg = np.repeat(work, n[work])
            j = np.arange(len(seg)) - np.repeat(np.cumsum(n[work]) - n[work], n[work])
            key = number[seg] * (window + 1) + lead[seg] - j
            s = np.argsort(key, kind="stable")
            seg, j, key = seg[s], j[s], key[s]
            starts = base[seg] + j
            for round_ in range(8):
                suffixes = Suffixes(data, window, round_)
                order = suffixes.sorted(starts, key)
                same = np.flatnonzero((key[1:] == key[:-1]) & (suffixes.compare(order[:-1], order[1:]) == 0)) if len(order) > 1 else np.zeros(0, np.int64)
                if suffixes.verified(order[same], order[same + 1]):
                    break
            else:
                raise RuntimeError("prefix hashes collided in eight rounds")
            hit = np.unique(np.concatenate([order[same], order[same + 1]]))
            of = np.searchsorted(base, hit, "right") - 1
            for k, part in zip(*split_by(of, hit - base[of]), strict=True):
                flags[k] = flags[k] | np.isin(np.arange(counts[k]), part)
        for k, f in enumerate(flags):
            for lo, hi in zip(*merged_runs(f, window), strict=True):
                yield k, int(lo), int(hi)

    return finder


def split_by(group: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Values of each group, for ascending ``group``."""
    if not len(group):
        return [], []
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return group[cut].tolist(), np.split(values, cut[1:])


GRAM = 100


def anchor_places(data: np.ndarray, base: np.ndarray, n: np.ndarray, anchors: list[int], window: int) -> np.ndarray:
    """Where each segment's anchor stands: the first gram with the anchor's hash that all its windows hold."""
    h = prefix_hash(BYTE_CODES[data])
    down = powers(len(data))[1]
    grams = mixed((h[GRAM:] - h[:-GRAM]) * down[:len(data) - GRAM + 1])
    out = np.zeros(len(n), np.int64)
    want = np.array(anchors, np.int64).view(np.uint64)
    for k in range(len(n)):
        lo = base[k] + n[k] - 1  # the last window's start
        found = np.flatnonzero(grams[lo:base[k] + window - GRAM + 1] == want[k])
        out[k] = n[k] - 1 + found[0]
    return out


def repeated_substrings(docs: DataFrame, text: str = "text", window: int = 400, most_segments: int = 5_000) -> DataFrame:
    """(row, parts): byte ranges of each document covered by ``window``-byte strings that also start elsewhere."""
    if window < GRAM + 1:
        raise ValueError(f"windows have more than {GRAM} bytes")
    return repeated_spans(docs, text, Windows("bytes", window, GRAM, most_segments), find_repeats(window))


def remove_substrings(docs: DataFrame, text: str = "text", window: int = 400, most_segments: int = 5_000) -> DataFrame:
    """``docs`` with ``kept`` (binary: the text's UTF-8 bytes without repeated substrings) and ``spans`` (byte ranges removed).

    Every byte covered by a ``window``-byte string that also starts anywhere else, in this document or another,
    is removed; strings are judged on the input, and never reach over a document's end. A null text is empty;
    texts shorter than the window are kept whole; equal rows count as different documents and lose
    all they share. Columns named ``kept`` or ``spans`` are replaced, others stay. An empty table gives no rows.
    """
    def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
        out, at = [], 0
        for a, b in spans:
            out.append(raw[at:a])
            at = b
        return b"".join([*out, raw[at:]])

    return without_spans(docs, text, repeated_substrings(docs, text, window, most_segments), cut, "binary")

"""Byte-level BPE encoding and decoding in padded numpy matrices.

A rank file gives each token's bytes and its rank, which is its id. Texts are cut by the pattern; a piece that is a token itself has that
id, any other starts as its bytes and merges, round by round, its leftmost pair of neighbours of least rank until no pair is a token.

Different pieces are merged together: they are bucketed by length into matrices padded to the bucket's width, every row merges one pair a
round, columns are compacted by the one that went, rows without a pair leave. Ranks of pairs come from a hash table over
(left id, right id) with open addressing, probed for whole matrices. A piece of more than ``WIDE`` bytes is a matrix by itself: its
ranks are folded into rows whose minima are kept, so a round costs the root of its length and not its length.

Each Spark task encodes the texts of its Arrow batches; what it keeps between them is the tables and a bounded cache of pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import U64, map_arrow, mixed, pieces, raw_bytes

NONE = np.int32(2**31 - 1)
WIDE = 2048
SIDE = 512
CELLS = 1 << 20
MOST_CACHED = 400_000
TEXT_BYTES = 1 << 20


class PairTable:
    """Hash table from pairs of ids to the id of both together."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        key = self.keys_of(left, right)
        bits = max(4, int(2 * max(1, len(key)) - 1).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, ~U64(0))
        self.value = np.full(1 << bits, NONE, np.int32)
        slot = (mixed(key) >> self.shift).astype(np.int64)
        while len(key):  # the first of those that want a free slot gets it, the others go on to the next one
            free = np.flatnonzero(self.key[slot] == ~U64(0))
            at, who = np.unique(slot[free], return_index=True)
            taken = free[who]
            self.key[at], self.value[at] = key[taken], value[taken]
            left_over = np.ones(len(key), bool)
            left_over[taken] = False
            key, value, slot = key[left_over], value[left_over], (slot[left_over] + 1) & self.mask

    @staticmethod
    def keys_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << U64(32)) | right.astype(np.uint64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pairs (``NONE``: no token); an id below zero is padding and pairs with nothing."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.nonzero((left >= 0) & (right >= 0))
        key = self.keys_of(left[at], right[at])
        found = np.full(len(key), NONE, np.int32)
        open_, slot = np.arange(len(key)), (mixed(key) >> self.shift).astype(np.int64)
        while len(open_):
            stored = self.key[slot]
            hit = stored == key[open_]
            found[open_[hit]] = self.value[slot[hit]]
            on = ~hit & (stored != ~U64(0))
            open_, slot = open_[on], (slot[on] + 1) & self.mask
        out[at] = found
        return out


class Vocabulary:
    """The tokens of a rank file (lines of base64 bytes and rank), their pairs and the cutting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        rank = self.rank
        halves = [(rank[t[:k]], rank[t[k:]], i) for t, i in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank]
        self.pairs = PairTable(*np.array(halves, np.int64).reshape(-1, 3).T.astype(np.int32))
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max(rank.values()) + 1)
        for t, i in rank.items():
            tokens[i] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def merge(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge the rows of a matrix padded with -1 to the end: (row numbers, their ids padded with -1) as rows get done."""
        row, rank = np.arange(len(ids)), self.pairs.find(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1 and len(ids):
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(ids)), j]
            done = best == NONE
            if done.any():
                yield row[done], ids[done]
                on = ~done
                row, ids, rank, j, best = row[on], ids[on], rank[on], j[on], best[on]
                if not len(ids):
                    return
            r, width = np.arange(len(ids)), ids.shape[1]
            ids[r, j] = best
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > j[:, None]), axis=1)
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column >= j[:, None]), axis=1)
            for at in (j - 1, j):  # the two pairs the new token is in
                on = (at >= 0) & (at < width - 2)
                rank[r[on], at[on]] = self.pairs.find(ids[r[on], at[on]], ids[r[on], at[on] + 1])
        if len(ids):
            yield row, ids

    def merge_wide(self, ids: np.ndarray) -> np.ndarray:
        """Merge one long row; its ranks stand in a grid with the least of each line kept."""
        n = len(ids)
        rank = np.full(-(-n // SIDE) * SIDE, NONE, np.int32)
        rank[:n - 1] = self.pairs.find(ids[:-1], ids[1:])
        after, before, stays = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        grid = rank.reshape(-1, SIDE)
        low = grid.min(axis=1)
        while True:
            line = int(low.argmin())
            if low[line] == NONE:
                return ids[stays]
            i = line * SIDE + int(grid[line].argmin())
            gone = int(after[i])
            ids[i], stays[gone], rank[gone] = rank[i], False, NONE
            nxt, prev = int(after[gone]), int(before[i])
            after[i] = nxt
            if nxt < n:
                before[nxt] = i
            new = self.pairs.find(ids[[prev, i]] if prev >= 0 else np.array([-1, ids[i]], np.int32), np.array([ids[i], ids[nxt] if nxt < n else -1], np.int32))
            rank[i] = new[1]
            if prev >= 0:
                rank[prev] = new[0]
            for k in {i // SIDE, gone // SIDE, max(prev, 0) // SIDE}:
                low[k] = grid[k].min()

    def learn(self, new: list[str]) -> None:
        """Encode pieces not yet known: whole tokens at once, the others by merging in buckets of like length."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > WIDE:
                self.known[piece] = self.merge_wide(self.of_byte[np.frombuffer(raw, np.uint8)]).astype("<i4").tobytes()
            else:
                buckets.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for part in (members[k:k + step] for k in range(0, len(members), step)):
                ids = np.full((len(part), width), -1, np.int32)
                for k, (_, raw) in enumerate(part):
                    ids[k, :len(raw)] = self.of_byte[np.frombuffer(raw, np.uint8)]
                for rows, merged in self.merge(ids):
                    count = (merged >= 0).sum(axis=1)
                    for k, line, n in zip(rows.tolist(), merged, count.tolist(), strict=True):
                        self.known[part[k][0]] = line[:n].astype("<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.known) > MOST_CACHED:  # the pieces met first are mostly the frequent ones
            for piece in list(self.known)[MOST_CACHED // 2:]:
                del self.known[piece]
        cut = [self.cut(t) for t in texts]
        self.learn(list(set().union(*cut).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens in a row."""
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(end) else 0)
        return self.bytes[at + np.repeat(self.place[ids] - (end - size), size)]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One vocabulary per worker and file."""
    return Vocabulary(path, pattern)


def kept_fields(df: DataFrame, keep: tuple[str, ...], new: str) -> list[T.StructField]:
    if new in keep:
        raise ValueError(f"the new column {new} is among the kept ones; give it another name")
    return [df.schema[c] for c in keep]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The ``keep`` columns and the token ids (array of ints) of each row's whole text, without special tokens.

    A null or empty text has no ids. Rows stay as they are, equal ones too; an empty table gives no rows; columns not kept, whatever
    their names, are not read. ``ids`` may not be one of the kept columns. ``path`` has to be there on every executor.
    """
    fields = kept_fields(docs, keep, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path, pattern)
        for batch in batches:
            column = batch.column(len(keep))
            _, at = raw_bytes(column)
            for i, j in pieces(at, TEXT_BYTES):
                raw = book.encode([t or "" for t in column[i:j].to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([*[batch.column(k)[i:j] for k in range(len(keep))], listed], [*keep, ids])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text"))
    return map_arrow(chosen, run, T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """The ``keep`` columns and the bytes (binary) that the ids of each row stand for; null ids give no bytes. ``out`` may not be among the kept."""
    fields = kept_fields(encoded, keep, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path, pattern)
        for batch in batches:
            listed = batch.column(len(keep)).fill_null([])
            flat = listed.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            for i, j in pieces(4 * at, TEXT_BYTES):
                part = flat[at[i]:at[j]]
                end = np.concatenate([[0], np.cumsum(book.size[part])])
                offsets = end[at[i:j + 1] - at[i]].astype(np.int32)
                data = book.decode(part).tobytes()
                done = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*[batch.column(k)[i:j] for k in range(len(keep))], done], [*keep, out])

    chosen = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").cast("array<int>").alias("_ids"))
    return map_arrow(chosen, run, T.StructType([*fields, T.StructField(out, T.BinaryType())]))

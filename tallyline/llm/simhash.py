"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. It is cut into three segments; two fingerprints with at most four differing bits differ
in at most one bit of the first or of the second segment, or in none of the third (else they differ in 2 + 2 + 1). So the table
of each of the first two segments is probed with the segment and with its Hamming ball of radius one, the third only with the segment
itself, and complete distances are verified. As distance is symmetric, a ball holds only the
neighbours with one more bit set: the pair meets from the side that has the bit clear.

Equal fingerprints are one entry. In a bucket only a spanning forest of the links is given, found by
growing groups over the entries not yet reached, so a bucket of many near copies gives as many links as entries, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ROW, U64, map_arrow, packed, raw_bytes, stored, with_row_key
from .components import components

#: Low bit and width of the segments; the last one is matched exactly.
SEGMENTS = ((0, 22), (22, 22), (44, 20))
MOST_BITS = 4


def spans_of(text: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text, lower-cased A-Z and joined by a space, with the start and end of each run of ``shingle`` words (or of all, if fewer)."""
    words = text.lower().split()
    if not words:
        return b"", [], []
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    return b" ".join(words), (end - size)[:len(words) - k + 1].tolist(), end[k - 1:].tolist()


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included."""
    line, start, end = spans_of(text, shingle)
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    return np.array([digest(view[a:b], seed) for a, b in zip(start, end, strict=True)], np.uint64)


def simhash_of(hashes: np.ndarray) -> int:
    bits = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(bits * 2 > len(hashes)).tolist())


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """SimHash of one text: lower-cased A-Z, ``shingle`` words joined by a space, repeats included."""
    return simhash_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, ``fp`` (long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw_bytes(batch.column(len(keep)))
            raw = data.tobytes()
            fps = [fingerprint(raw[a:b], shingle, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(np.array(fps, np.uint64).view(np.int64))], [*keep, "fp"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fp", T.LongType())])
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")), run, schema)


def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, entry): the table entries of each fingerprint and the probes of its Hamming balls."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, fps, entry = [], [], []
        for s, (low, width) in enumerate(SEGMENTS):
            value = (fp >> U64(low)) & U64((1 << width) - 1)
            tag = U64(s << 32)
            keys.append(value | tag)
            fps.append(fp)
            entry.append(np.ones(len(fp), bool))
            for bit in range(width if s < 2 else 0):
                clear = np.flatnonzero((value >> U64(bit)) & U64(1) == 0)
                keys.append(value[clear] | U64(1 << bit) | tag)
                fps.append(fp[clear])
                entry.append(np.zeros(len(clear), bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(entry))],
                                         ["key", "fp", "entry"])


def close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def forest(table: np.ndarray, probing: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of one bucket: entries among themselves and probes to entries.

    Groups grow from one entry over those not yet reached, so each entry is compared with the unreached ones only.
    """
    u, v = [], []
    rest = table
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = close(rest, x, most)
            if near.any():
                found = rest[near]
                u += found.tolist()
                v += [int(x)] * len(found)
                queue += list(found)
                rest = rest[~near]
    left = probing  # a probe is tied to each group of entries once at least: to every near entry not yet tied through another
    group = group_of(table, u, v)
    for g in np.unique(group):
        open_ = left
        for x in table[group == g]:
            if not len(open_):
                break
            near = close(open_, x, most)
            found = open_[near]
            u += found.tolist()
            v += [int(x)] * len(found)
            open_ = open_[~near]
    return u, v


def group_of(table: np.ndarray, u: list[int], v: list[int]) -> np.ndarray:
    """Group number of each entry under the links just found (a forest whose links come parent first)."""
    number = {int(x): i for i, x in enumerate(table.tolist())}
    group = {x: i for x, i in number.items()}
    for child, parent in zip(u, v, strict=True):
        group[child] = group[parent]
    return np.array([group[int(x)] for x in table.tolist()])


def bucket_links(most: int):
    """Arrow function over rows sorted by key: links between fingerprints of at most ``most`` differing bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            entry = batch.column(2).to_numpy(zero_copy_only=False)
            now = [key, fp, entry] if rest is None else [np.concatenate(x) for x in zip(rest, (key, fp, entry), strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            if last:
                yield links_of(*[x[:last] for x in now], most)
                now = [x[last:] for x in now]
            rest = now
        if rest is not None and len(rest[0]):
            yield links_of(*rest, most)

    return run


SMALL = 64


def links_of(key: np.ndarray, fp: np.ndarray, entry: np.ndarray, most: int) -> pa.RecordBatch:
    """Links of whole buckets: small buckets in one vectorised pass over all pairs, larger ones by ``forest``."""
    order = np.lexsort((~entry, key))  # entries first
    key, fp, entry = key[order], fp[order], entry[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(head, len(key)))
    tables = np.add.reduceat(entry.astype(np.int64), head)
    us, vs = [], []
    small = (tables > 0) & (size > 1) & (tables <= SMALL) & (size <= SMALL)
    for k in range(int(tables[small].max(initial=0))):  # the k-th entry of each bucket against all rows after it
        on = small & (tables > k)
        h, n = head[on], size[on] - k - 1
        at = np.repeat(h + k, n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at + 1
        near = close(fp[at], fp[other], most)
        us.append(fp[other[near]])
        vs.append(fp[at[near]])
    for h, n, t in zip(head[~small], size[~small], tables[~small], strict=True):
        if t and n > 1:
            u, v = forest(fp[h:h + t], fp[h + t:h + n], most)
            us.append(np.array(u, np.uint64))
            vs.append(np.array(v, np.uint64))
    u, v = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (us, vs))
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def similar(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints ``fp`` (distinct longs) joined by steps of at most ``most`` bits."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError("the segments serve distances up to four bits")
    rows = map_arrow(fps.select("fp"), probes, "key long, fp long, entry boolean")
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return map_arrow(dealt, bucket_links(most), "u long, v long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, most: int = MOST_BITS) -> DataFrame:
    """(row key, id, fp, component): every row with its fingerprint and the least id it reaches by links.

    Texts are lower-cased in A-Z and split at white space; a text of fewer words than a shingle is one shingle, an empty or null
    text has fingerprint zero and links like any other. Null ids do not count for the least id; a component
    of null ids only has a null component. Equal rows stay separate rows. An empty table gives no rows.
    """
    keyed = with_row_key(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")))
    each = stored(fingerprints(keyed, "text", shingle, seed, keep=(ROW, "id")), "fingerprints")
    entries = stored(each.groupBy("fp").agg(F.min("id").alias("least")), "entries")
    roots = components(similar(entries, most))
    rooted = entries.join(roots, entries["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "root", "component")
    return each.join(stored(named, "named"), "fp").select(ROW, "id", "fp", "root", "component")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each component: the one of least id (nulls last), then of least place in the table."""
    found = near_duplicates(docs, id_column, text, **how)
    first = found.groupBy("root").agg(F.min_by(ROW, F.struct(F.col("id").isNull(), "id", ROW)).alias(ROW)).select(ROW)
    return packed(docs).join(stored(first.withColumnRenamed(ROW, "row"), "first"), "row", "left_semi").select("doc.*")

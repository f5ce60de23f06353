"""Near copies by exact shingle similarity: SimHash tables and, for what they cannot reach, MinHash bands give candidates; size, SimHash and sketch drop the far ones, words decide.

Texts of equal shingle sets are one entry. Entries whose SimHash fingerprints differ in at most four bits meet first, by multi-index hashing
(``simhash.similar``). Entries that these links leave apart may still be of similarity 0.8: an entry is also filed under ``BANDS`` keys, each made of ``WIDTH`` least hashes; two entries of
similarity 0.8 share none with probability (1 - 0.8^4)^25, two in a million. Of the candidates those are dropped

* whose numbers of shingles differ by more than the similarity allows (exact);
* whose SimHash fingerprints differ in more than ``FAR_BITS`` bits (at 0.8 they differ in about 10, with a deviation of 3);
* whose least hashes agree in fewer than ``AGREE`` of 100 places (at 0.8 they agree in 80, with a deviation of 4: fewer than 60 once in a million);
* in the last step, whose shingles of equal 16-bit hashes are too few (exact: different shingles of one hash only add to the count).

All others are compared by their words. Multi-index tables cannot give all candidates: at 0.8 fingerprints of 64 bits differ in more bits than
Hamming balls of small segments reach.

A large group of near copies does not give all its pairs. First every entry of a bucket is compared with its hub, the entry closest to
the bucket's most frequent hashes, in ``ROUNDS`` rounds with another hub each; only pairs that all links found so far leave in different
components come after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ROW, U64, discard, map_arrow, mixed, packed, raw_bytes, stored, with_row_key
from .components import components
from .simhash import shingle_hashes, similar, simhash_of

BANDS, WIDTH = 25, 4
FAR_BITS, AGREE, ROUNDS = 26, 60, 3
_rng = np.random.Generator(np.random.PCG64(20240901))
MASKS = _rng.integers(0, 2**63, BANDS * WIDTH, dtype=np.uint64) * U64(2) + U64(1)
TIMES = _rng.integers(0, 2**63, BANDS * WIDTH, dtype=np.uint64) * U64(2) + U64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The bucket keys of one set of shingle hashes."""
    return keys_of(least_hashes(hashes))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * WIDTH, ~U64(0))
    for at in range(0, len(hashes), 1024):
        x = (hashes[at:at + 1024, None] ^ MASKS) * TIMES
        x ^= x >> U64(31)
        least = np.minimum(least, (x * U64(0x9E3779B97F4A7C15)).min(axis=0))
    return least


def keys_of(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDTH).T:
        key = mixed(key * U64(0xC2B2AE3D27D4EB4F) + column)
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """(row, id, same, fp, n, sketch, keys) of (row, id, text): ``same`` names the shingle set by 128 bits, ``sketch`` has a byte of each least hash; texts without words have no keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw_bytes(batch.column(2))
            raw = data.tobytes()
            same, fps, sizes, sketch, keys = [], [], [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                hashes = shingle_hashes(raw[a:b], shingle, seed)
                different = np.unique(hashes)
                least = least_hashes(different)
                same.append(xxhash.xxh128_digest(different.tobytes()))
                fps.append(simhash_of(hashes))
                sizes.append(len(different))
                sketch.append((mixed(least) & U64(255)).astype(np.uint8).tobytes())
                keys.append(keys_of(least) if len(different) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)),
                                              pa.array(sizes, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                             ["row", "id", "same", "fp", "n", "sketch", "keys"])

    kinds = "same binary, fp long, n long, sketch binary, keys array<long>"
    return map_arrow(docs, run, T.StructType([docs.schema["row"], docs.schema["id"], *T.StructType.fromDDL(kinds).fields]))


class Bucket:
    """The entries of one band key: rows, fingerprints, sizes, sketches and the roots that the links so far give them."""

    def __init__(self, row: np.ndarray, fp: np.ndarray, n: np.ndarray, root: np.ndarray, sketch: np.ndarray, codes: np.ndarray | None = None):
        self.row, self.fp, self.n, self.root, self.sketch = row, fp, n, root, sketch
        if codes is not None:
            self.codes, self.marks = codes, np.zeros(1 << 19, bool)

    def near(self, k: int, others: np.ndarray, tenths: int) -> np.ndarray:
        """Those of the other entries that may be near copies of entry ``k`` and are not yet linked to it."""
        others = others[self.root[others] != self.root[k]]
        size = np.minimum(self.n[others], self.n[k]) * 10 >= np.maximum(self.n[others], self.n[k]) * tenths
        bits = np.bitwise_count((self.fp[others] ^ self.fp[k]).view(np.uint64)) <= FAR_BITS
        others = others[size & bits]
        return others[(self.sketch[others] == self.sketch[k]).sum(axis=1) >= AGREE]

    def hub_pairs(self, turn: int, tenths: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The hub with every other entry; in later turns the hub of what the largest component of the bucket leaves."""
        at = np.arange(len(self.row))
        if turn:
            roots, place, size = np.unique(self.root, return_inverse=True, return_counts=True)
            at = np.flatnonzero(place != size.argmax())
        if not len(at):
            return
        sketch = self.sketch[at]
        often = np.bincount((sketch + np.arange(sketch.shape[1]) * 256).ravel(), minlength=256 * sketch.shape[1]).reshape(-1, 256).argmax(axis=1)
        hub = int(at[(sketch == often).sum(axis=1).argmax()])
        found = self.near(hub, np.arange(len(self.row)), tenths)
        yield np.full(len(found), self.row[hub]), self.row[found]

    def shared(self, k: int, others: np.ndarray) -> np.ndarray:
        """At least the number of shingles that entry ``k`` has in common with each of the others."""
        self.marks[self.codes[k]] = True
        size = [len(self.codes[x]) for x in others]
        hits = self.marks[np.concatenate([self.codes[x] for x in others])]
        self.marks[self.codes[k]] = False
        return np.add.reduceat(hits.astype(np.int64), np.cumsum(size) - size)

    def all_pairs(self, tenths: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(len(self.row) - 1):
            found = self.near(k, np.arange(k + 1, len(self.row)), tenths)
            if len(found):
                both = self.shared(k, found)
                found = found[10 * both >= tenths * (self.n[k] + self.n[found] - both)]
            yield np.full(len(found), self.row[k]), self.row[found]


def bucket_pairs(tenths: int, turn: int | None):
    """Arrow function over (key, row, fp, n, root, sketch) sorted by key and row: candidate pairs (u, v), u < v, of entries with different roots.

    Of each bucket the pairs with the hub of a turn, or all (None), which a further column ``codes`` (see ``codes_of``) decides.
    """
    def whole(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], part[0][1:] != part[0][:-1], [True]]))
        held, size = [], 0
        for k in np.flatnonzero(np.diff(cut) > 1):
            bucket = Bucket(*(c[cut[k]:cut[k + 1]] for c in part[1:]))
            if (bucket.root == bucket.root[0]).all():
                continue
            for u, v in bucket.all_pairs(tenths) if turn is None else bucket.hub_pairs(turn, tenths):
                if len(u):
                    held.append(np.stack([np.minimum(u, v), np.maximum(u, v)]))
                    size += len(u)
                if size > 1 << 18:
                    yield different(held)
                    held, size = [], 0
        if held:
            yield different(held)

    def different(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(held, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]
            now.append(raw_bytes(batch.column(5))[0].reshape(batch.num_rows, -1))
            if turn is None:
                data, at = raw_bytes(batch.column(6))
                codes = np.empty(batch.num_rows, object)
                codes[:] = [data[a:b].view("<u4") for a, b in zip(at[:-1], at[1:], strict=True)]
                now.append(codes)
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1], "left"))
            yield from whole([x[:last] for x in now]) if last else ()
            rest = [x[last:] for x in now]
        if rest is not None:
            yield from whole(rest)

    return run


def codes_of(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each of the different shingle hashes, equal ones numbered up to 7: sets of shingles have at most as many in common as their codes."""
    short = np.sort(hashes >> U64(48)).astype(np.int64)
    place = np.arange(len(short))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], short[1:] != short[:-1]]), place, 0)) if len(short) else place
    return (short * 8 + np.minimum(place - first, 7)).astype("<u4")


def shingle_codes(shingle: int, seed: int):
    """Arrow function from (row, text) to (row, codes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [codes_of(np.unique(shingle_hashes((t.as_py() or "").encode(), shingle, seed))).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], ["row", "codes"])

    return run


#: Row numbers (8 bytes each) that are broadcast.
MOST_ROWS = 1_000_000
#: Shingles of texts that a task remembers for the pairs to come.
MOST_SHINGLES = 4_000_000


def alike(shingle: int, tenths: int, seed: int):
    """Arrow function over (u, v, text of u, text of v): the pairs whose sets of 64-bit shingle hashes have a Jaccard similarity of ``tenths`` / 10 at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            keep = []
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), batch.column(3), strict=True):
                for row, text in ((u, a), (v, b)):
                    if row not in known:
                        known[row] = np.unique(shingle_hashes((text.as_py() or "").encode(), shingle, seed))
                        size += len(known[row])
                x, y = known[u], known[v]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(10 * both >= tenths * (len(x) + len(y) - both))
                if size > MOST_SHINGLES:
                    known, size = {}, 0
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["u", "v"])

    return run


def fingerprint_pairs(entries: DataFrame) -> DataFrame:
    """Candidate pairs (u, v), u < v, of entries (row, fp): equal fingerprints, each with the first one, and the links of ``simhash.similar`` between first ones."""
    first = stored(entries.groupBy("fp").agg(F.min("row").alias("first")), "fingerprint-firsts")
    equal = entries.join(first, "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(to)) for c, to in (("u", "a"), ("v", "b")))
    near = similar(first.select("fp")).join(a, "u").join(b, "v").select("a", "b")
    return equal.unionByName(near).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5, tenths: int = 8, seed: int = 42) -> DataFrame:
    """One row of each group of near copies, the one of least id (nulls last), then of least place in the table.

    Two rows are near copies if their sets of ``shingle``-word shingles have a Jaccard similarity of at least ``tenths`` / 10; groups are
    chained. Words are lower-cased in A-Z and split at white space; a text of fewer words is one shingle; empty and null texts
    are alike. An empty table gives no rows.
    """
    keyed = with_row_key(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")))
    each = stored(sketches(keyed.select(F.col(ROW).alias("row"), "id", "text"), shingle, seed), "shingle-sketches")
    entries = stored(each.groupBy("same").agg(F.min("row").alias("entry")), "shingle-sets")
    filed = stored(each.join(entries, each["row"] == entries["entry"]).select(F.explode("keys").alias("key"), "row"), "bands")
    shared = stored(filed.groupBy("key").count().where("count > 1").select("key"), "shared-bands")
    twice = filed.join(shared, "key").select("key", "row")
    candidates = stored(twice.join(each.select("row", "fp", "n", "sketch"), "row").select("key", "row", "fp", "n", "sketch"), "candidates")
    discard(filed, shared)
    texts = keyed.select(F.col(ROW).alias("row"), "text")

    def texts_of(rows: DataFrame, name: str) -> DataFrame:
        """(row, text) of some rows: few enough go to where the texts are read, so that the other texts are not shuffled."""
        rows = stored(rows.select("row").distinct(), f"{name}-rows")
        return texts.join(F.broadcast(rows) if rows.count() <= MOST_ROWS else rows, "row").select("row", "text")

    def verified(rows: DataFrame, turn: int | None) -> DataFrame:
        name, columns = "rest" if turn is None else f"hub-{turn}", ["key", "row", "fp", "n", "root", "sketch"]
        rows = rows.select(*columns)
        if turn is None:
            mixed_keys = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
            rows = stored(rows.join(mixed_keys, "key", "left_semi"), "mixed-buckets")
            codes = stored(map_arrow(texts_of(rows, "mixed"), shingle_codes(shingle, seed), "row long, codes binary"), "codes")
            rows, columns = rows.join(codes, "row"), [*columns, "codes"]
        dealt = rows.select(*columns).repartition("key").sortWithinPartitions("key", "row")
        return checked(map_arrow(dealt, bucket_pairs(tenths, turn), "u long, v long"), name)

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the candidate pairs whose words are alike."""
        pairs = stored(pairs.distinct(), f"{name}-pairs")
        wanted = stored(texts_of(pairs.select(F.explode(F.array("u", "v")).alias("row")), name), f"{name}-texts")
        left, right = (wanted.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}")) for c in ("u", "v"))
        both = pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v")
        links = stored(map_arrow(both, alike(shingle, tenths, seed), "u long, v long"), f"{name}-links")
        discard(pairs, wanted)
        return links

    links = checked(fingerprint_pairs(each.join(entries, each["row"] == entries["entry"]).select("row", "fp")), "fingerprint")
    roots = components(links)
    for turn in [*range(ROUNDS), None]:
        rooted = candidates.join(roots, candidates["row"] == roots["node"], "left").withColumn("root", F.coalesce("root", "row"))
        links = links.unionByName(verified(rooted, turn))
        roots = components(links)
    named = entries.join(roots, entries["entry"] == roots["node"], "left").select("same", F.coalesce("root", "entry").alias("root"))
    least = each.select("row", "id", "same").join(named, "same").groupBy("root").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("row"))
    first = stored(least.select("row"), "first")
    discard(each, entries, candidates)
    return packed(docs).join(first, "row", "left_semi").select("doc.*")

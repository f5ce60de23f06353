"""Phrase collocations by vertical partitioning of the word suffixes of each language.

Counting phrases of up to five words is building the suffix tree of the corpus cut off at depth five. The tree is built in parts:

* **Prefix frequencies.** Words are counted exactly. Pairs of frequent neighbours are counted by 40-bit hashes, sent sorted and packed; equal
  hashes of different pairs only add up, so a pair that is frequent is never missed. A phrase that is frequent enough consists of frequent pairs,
  so a suffix ends where a pair is too rare; tasks know the frequent pairs by a bit table of fixed size. A false hit costs a row, never a count.
* **Vertical partitioning.** Suffixes are dealt by their first two words. Where a prefix occurs more often than the memory budget, its continuations are counted
  and the prefix is divided by the next word, and so on. Prefixes are dealt to as many groups as the budget asks for, so no
  group outgrows it whatever share of the corpus a word holds. Suffixes are counted within tasks and go to their group in packed blocks.
* **Subtrees.** Each group adds up its leaves and reads the count of each node from the totals of the leaves below it.
  Nodes above a divided prefix have leaves in several groups; their counts are added up at the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import U64, discard, map_arrow, mixed, pieces, raw_bytes, stored, word_hashes

UNKNOWN = "und"
#: Bits of a prefix hash, and of the table of frequent pairs (4 MB).
HASH_BITS, BITS = 40, 25
#: Suffixes or words a task holds before it hands them on, prefix hashes it holds, bytes of text taken at once.
MOST_HELD, MOST_HASHES, TEXT_BYTES = 300_000, 2_000_000, 1 << 20
#: Occurrences of prefixes that a group of the tree may have.
BUDGET = 1_000_000

#: A-Z to lower case, tab to space, ends of pieces to a line feed.
AS_PIECES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, texts) of (lang, text) batches, about 1 MB at a time: one piece a line, words between spaces. A piece is never divided."""
    for batch in batches:
        langs = np.array(batch.column(0).fill_null(UNKNOWN).to_pylist(), object)
        data, at = raw_bytes(batch.column(1))
        raw = data.tobytes().translate(AS_PIECES)
        for i, j in pieces(at, TEXT_BYTES):
            for lang in sorted(set(langs[i:j])):
                whole = b"\n".join(raw[at[k]:at[k + 1]] for k in range(i, j) if langs[k] == lang)
                start = 0
                while start < len(whole):  # a very long text goes on piece by piece
                    end = whole.find(b"\n", start + TEXT_BYTES)
                    end = len(whole) if end < 0 else end
                    yield lang, whole[start:end]
                    start = end


class Held:
    """Counts of phrases by language that are handed on as they get many."""

    def __init__(self):
        self.counts, self.size = {}, 0

    def add(self, lang: str, phrases: list[bytes]) -> Iterator[pa.RecordBatch]:
        own = self.counts.setdefault(lang, Counter())
        before = len(own)
        own.update(phrases)
        self.size += len(own) - before
        if self.size >= MOST_HELD:
            yield from self.take()

    def take(self) -> Iterator[pa.RecordBatch]:
        for lang, own in self.counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64())],
                                             ["lang", "phrase", "count"])
        self.counts, self.size = {}, 0


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, byte place by byte place and compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<u8")[:, 0]


COUNTS = "lang string, phrase string, count long"


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, w1, count) of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for lang, text in lines(batches):
            yield from held.add(lang, text.split())
        yield from held.take()

    return map_arrow(docs, run, COUNTS).groupBy("lang", F.col("phrase").alias("w1")).agg(F.sum("count").alias("count"))


class Tokens:
    """The words of some text of one language: places, hashes, and which neighbours belong to one piece."""

    def __init__(self, lang: str, text: bytes):
        data = np.frombuffer(text, np.uint8)
        solid = (data != 32) & (data != 10)
        edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
        self.text, self.start, self.end = text, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hashes = mixed(word_hashes(data, self.start, self.end) + U64(xxhash.xxh64_intdigest(lang.encode())))
        line = np.cumsum(data == 10)[self.start]
        self.ties = line[1:] == line[:-1]

    def reach(self, ties: np.ndarray, longest: int) -> np.ndarray:
        """How many ties follow each word without a gap, up to the depth of the tree."""
        out = np.zeros(len(self.start), np.int64)
        for _ in range(longest - 1):
            out[:-1] = np.where(ties, np.minimum(out[1:] + 1, longest - 1), 0)
        return out

    def prefixes(self, first: np.ndarray, reach: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        """Hashes of the first 2, 3, ... ``depth`` words from each of the ``first`` words on, of all its words where there are fewer."""
        hashed = self.hashes[first]
        for d in range(1, depth):
            on = reach[first] >= d
            hashed = hashed.copy()
            hashed[on] = mixed(hashed[on] * U64(0x9E3779B97F4A7C15) + self.hashes[first[on] + d])
            yield hashed >> U64(64 - HASH_BITS)


def is_set(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


class Known:
    """What the passes so far know: bits of frequent words, bits of frequent pairs, and the hashes of the prefixes to divide by their number of words."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray | None = None, divided: list[np.ndarray] | None = None):
        self.words, self.pairs, self.divided = words, pairs, divided or []

    def suffixes(self, tokens: Tokens, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that a suffix of two words or more begins at, and the reach of every word."""
        if self.pairs is None:
            frequent = is_set(self.words, (tokens.hashes >> U64(64 - BITS)).astype(np.int64))
            ties = tokens.ties & frequent[1:] & frequent[:-1]
        else:
            at = np.flatnonzero(tokens.ties)
            (pair,) = tokens.prefixes(at, np.ones(len(tokens.start), np.int64), 2)
            ties = tokens.ties.copy()
            ties[at] = is_set(self.pairs, (pair >> U64(HASH_BITS - BITS)).astype(np.int64))
        reach = tokens.reach(ties, longest)
        return np.flatnonzero(reach), reach

    def dealt(self, tokens: Tokens, first: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how many words each suffix is dealt, and the hash of these."""
        depth, key = np.full(len(first), 2), None
        for d, hashed in enumerate(tokens.prefixes(first, reach, len(self.divided) + 2), 2):
            key = hashed if key is None else np.where(depth == d, hashed, key)
            if d - 2 < len(self.divided):
                depth[(depth == d) & np.isin(hashed, self.divided[d - 2])] = d + 1
        return depth, key


def word_bits(frequent: DataFrame) -> np.ndarray:
    """Frequent words as bits of a table of fixed size; each of at most eight tasks sends one table to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            data, at = raw_bytes(batch.column(1))
            for lang in set(langs):
                hashed = mixed(word_hashes(data, at[:-1], at[1:])[langs == lang] + U64(xxhash.xxh64_intdigest(lang.encode())))
                bits[(hashed >> U64(64 - BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    table = np.zeros((1 << BITS) // 8, np.uint8)
    for row in map_arrow(frequent.select("lang", "w1").coalesce(8), run, "bits binary").collect():
        table |= np.frombuffer(row.bits, np.uint8)
    return table


def prefix_counts(docs: DataFrame, known: Known, depth: int, least: int, budget: int, longest: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts of the prefixes of ``depth`` words: bits of those that occur ``least`` times, hashes of those beyond the budget, and how many occurrences there are.

    At depth two all pairs of frequent words count, deeper only what follows a prefix to be divided. Hashes beyond the budget are occurrences / budget at most.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(16, max(4, (parts - 1).bit_length()))
    shared = spark.sparkContext.broadcast(known)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        slice_of = (hashes >> U64(HASH_BITS - bits)).astype(np.int64)
        head = np.searchsorted(slice_of, np.arange((1 << bits) + 1))
        full = np.flatnonzero(np.diff(head))
        rows = [(packed(np.diff(hashes[head[k]:head[k + 1]], prepend=U64(0))), packed(counts[head[k]:head[k + 1]].astype(np.uint64))) for k in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = shared.value, [], 0
        for lang, text in lines(batches):
            tokens = Tokens(lang, text)
            first, reach = own.suffixes(tokens, longest if depth > 2 else 2)
            if depth > 2:
                deep, key = own.dealt(tokens, first, reach)
                key = key[(deep == depth) & (reach[first] >= depth - 1)]
            else:
                (key,) = tokens.prefixes(first, reach, 2)
            held.append(key)
            size += len(key)
            if size >= MOST_HASHES:
                yield sent(held)
                held, size = [], 0
        yield sent(held)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by slice."""
        at, hashes, counts = None, [], []

        def result() -> pa.RecordBatch:
            every, place = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts).astype(np.float64)).astype(np.int64)  # exact up to 2^53
            slots = np.zeros(1 << (BITS - bits), bool)
            slots[(every[total >= least] >> U64(HASH_BITS - BITS)).astype(np.int64) - (at << (BITS - bits))] = True
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(slots).tobytes()], pa.binary()),
                                               pa.array([every[total > budget].tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["slice", "bits", "heavy", "total"])

        for batch in batches:
            for k, h, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at is not None and k != at:
                    yield result()
                    hashes, counts = [], []
                at = k
                hashes.append(np.cumsum(unpacked(h), dtype=np.uint64))
                counts.append(unpacked(c))
        if at is not None:
            yield result()

    blocks = map_arrow(docs, run, "slice long, hashes binary, counts binary").repartition("slice").sortWithinPartitions("slice")
    table, heavy, total = np.zeros((1 << BITS) // 8, np.uint8), [], 0
    for row in map_arrow(blocks, added, "slice long, bits binary, heavy binary, total long").collect():
        width = len(row.bits)
        table[row.slice * width:(row.slice + 1) * width] = np.frombuffer(row.bits, np.uint8)
        heavy.append(np.frombuffer(row.heavy, np.uint64))
        total += row.total
    shared.unpersist()
    return table, np.sort(np.concatenate(heavy)) if heavy else np.zeros(0, np.uint64), total


def tree_counts(docs: DataFrame, known: Known, groups: int, longest: int, least: int) -> DataFrame:
    """(lang, phrase, count) of the phrases of two words at least that occur ``least`` times."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def sent(held: dict) -> pa.RecordBatch:
        rows = []
        for lang, (counts, places) in held.items():
            dealt: dict[tuple[int, int], list[bytes]] = {}
            for phrase, place in places.items():
                dealt.setdefault(place, []).append(phrase)
            for place, phrases in dealt.items():
                phrases.sort()
                group, depth = divmod(place, 8)
                rows.append((group, lang, depth, zstandard.compress(b"\n".join(phrases), 3), packed(np.array([counts[p] for p in phrases], np.uint64))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slice", "lang", "depth", "phrases", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size = shared.value, {}, 0
        for lang, text in lines(batches):
            tokens = Tokens(lang, text)
            first, reach = own.suffixes(tokens, longest)
            depth, key = own.dealt(tokens, first, reach)
            place = (mixed(key) % U64(groups)).astype(np.int64) * 8 + depth
            last = first + reach[first]
            wide = np.concatenate([[0], np.cumsum(tokens.start[1:] - tokens.end[:-1] > 1)])  # more than one space between two words
            plain = wide[last] == wide[first]
            phrases = [text[a:b] if p else b" ".join(text[a:b].split()) for a, b, p in zip(tokens.start[first].tolist(), tokens.end[last].tolist(), plain.tolist(), strict=True)]
            counts, places = held.setdefault(lang, (Counter(), {}))
            before = len(counts)
            counts.update(phrases)
            places.update(zip(phrases, place.tolist(), strict=True))
            size += len(counts) - before
            if size >= MOST_HELD:
                yield sent(held)
                held, size = {}, 0
        yield sent(held)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group and language."""
        at, nodes, above = None, Counter(), set()

        def result() -> pa.RecordBatch:
            found = [(p, c) for p, c in nodes.items() if c >= least or p in above]
            return pa.RecordBatch.from_arrays([pa.array([at[1]] * len(found), pa.string()), pa.array([p for p, _ in found], pa.binary()).cast(pa.string()), pa.array([c for _, c in found], pa.int64())],
                                              ["lang", "phrase", "count"])

        for batch in batches:
            for group, lang, depth, phrases, counts in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if at is not None and at != (group, lang):
                    yield result()
                    nodes, above = Counter(), set()
                at = group, lang
                for phrase, count in zip(zstandard.decompress(phrases).split(b"\n"), unpacked(counts).tolist(), strict=True):
                    d, cut = 1, phrase.find(b" ")
                    while cut >= 0:  # the nodes on the way down to this leaf
                        d, cut = d + 1, phrase.find(b" ", cut + 1)
                        node = phrase if cut < 0 else phrase[:cut]
                        nodes[node] += count
                        if d < depth:
                            above.add(node)
        if at is not None:
            yield result()

    blocks = map_arrow(docs, run, "slice long, lang string, depth long, phrases binary, counts binary")
    dealt = blocks.repartition("slice").sortWithinPartitions("slice", "lang")
    found = map_arrow(dealt, subtrees, COUNTS)
    return found.groupBy("lang", "phrase").agg(F.sum("count").alias("count")).where(F.col("count") >= least)


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, most: int = 2000, percent: int = 100, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of 2 to ``longest`` words of each language (null: ``und``).

    Texts (null: empty) are lower-cased in A-Z, cut at ``.,;:!?`` and line ends into pieces and at spaces and tabs into words. A phrase occurs
    a times, at least ``least``, overlaps included; its first k words l and the others r times, for the k of the lowest
    score = floor(1000 a n / (l r)) (ties: smallest k), n words in all. Phrases contained in a longer one with at least ``percent`` % of their count
    are dropped. Order: score, a, phrase (by its UTF-8 bytes). Equal rows count each; other columns are not read. An empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    words = stored(word_counts(slim), "words")
    total = words.groupBy("lang").agg(F.sum("count").alias("n"))
    frequent = stored(words.where(F.col("count") >= least), "frequent-words")
    known, total_pairs = Known(word_bits(frequent)), 0
    for depth in range(2, longest + 1):  # deeper levels only where a prefix is beyond the budget
        bits, heavy, size = prefix_counts(slim, known, depth, least, budget, longest)
        if depth == 2:
            known, total_pairs = Known(known.words, bits), size
        if not len(heavy) or depth == longest:
            break
        known = Known(known.words, known.pairs, [*known.divided, heavy])
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_pairs // budget))
    phrases = stored(tree_counts(slim, known, groups, longest, least), "phrases")
    sums = stored(total, "totals")
    discard(words)
    known = phrases.unionByName(frequent.select("lang", F.col("w1").alias("phrase"), "count"))
    inside = F.expr("flatten(transform(sequence(2, k - 1), s -> transform(sequence(0, k - s), i -> array_join(slice(w, i + 1, s), ' '))))")
    split = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w"))
    longer = split.where("k > 2").select("lang", F.explode(inside).alias("phrase"), "count").groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    cuts = split.select("lang", "phrase", "w", "k", F.col("count").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("head"), F.expr("array_join(slice(w, cut + 1, k - cut), ' ')").alias("rest"))
    left, right = (known.select("lang", F.col("phrase").alias(c), F.col("count").alias(v)) for c, v in (("head", "l"), ("rest", "r")))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"]).join(sums, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("best"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

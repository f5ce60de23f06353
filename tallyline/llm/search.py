"""Ranked lexical search: posting lists cut into geometric blocks whose exact summaries decide what is skipped.

Documents stay in the shards they are scanned in. A pass counts, in each document, the terms that the block of queries asks for, and stores
them with the document's length; collection figures (documents, terms, document frequencies) are Spark aggregates of that table. A second
pass takes each shard in parts of some thousand documents, as matrices of impacts (the integer that a term adds for each unit of its weight):

* the posting list of a term is clustered by the likeness of its documents (nearest of some of them in a random projection); a cluster is a block;
* a block's summary is the coordinatewise maximum of its documents' impacts, over the terms that occur beside the list's term in a query;
* a query orders the blocks of its terms by weights times summary, a bound no document of the block can pass, and scores documents until the
  bound of the next block is below its lowest kept score. Scores and bounds are exact integers, so nothing else is skipped.

Each task gives its best documents of each query; they meet in two steps, first within groups of tasks. A term that is in every document has one
list per part, so no list is ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import ROW, discard, map_arrow, stored, with_row_key

#: Documents aimed at in a block, cells of a part's matrix, coordinates of the projection, documents scored between two looks at the bounds.
BLOCK, CELLS, COORDINATES, STEP = 64, 16_000_000, 16, 512
#: Queries and different terms that go through the documents together; more queries take several passes.
MOST_QUERIES, MOST_TERMS = 4_096, 8_192
SALTS = 64

_keep = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
AS_TERMS = bytes(b if b in _keep else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode().translate(AS_TERMS).split()


def query_blocks(items: DataFrame, most_queries: int, most_terms: int) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Blocks of (query number, id, terms), and the different terms of a block; a block is what one pass keeps in memory."""
    block, terms = [], set()
    for row in items.toLocalIterator():
        own = set(terms_of(row["text"]))
        if block and (len(block) == most_queries or len(terms | own) > most_terms):
            yield block, sorted(terms)
            block, terms = [], set()
        block.append((row[ROW], row["id"], own))
        terms |= own
    if block:
        yield block, sorted(terms)


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(row, id, n, terms, tfs): the number of all terms of each document, and its terms of the vocabulary (by number, ascending) with their occurrences."""
    number = {t: k for k, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found, counts, ends = [], [], [], [0]
            for value in batch.column(2):
                own = terms_of(value.as_py())
                hits = np.array([x for x in map(number.get, own) if x is not None], np.int32)
                term, tf = np.unique(hits, return_counts=True)
                sizes.append(len(own))
                found.append(term)
                counts.append(tf)
                ends.append(ends[-1] + len(term))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32))) for x in (found, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *lists], ["row", "id", "n", "terms", "tfs"])

    return map_arrow(docs, run, "row long, id long, n long, terms array<int>, tfs array<int>")


class Part:
    """Some documents of a shard as a matrix of impacts, with the blocks of every term's posting list."""

    def __init__(self, impacts: np.ndarray, beside: list[np.ndarray], projection: np.ndarray):
        self.impacts, self.lists = impacts, {}
        near = impacts.astype(np.float32) @ projection
        near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
        for term in np.flatnonzero(impacts.any(axis=0)).tolist():
            rows = np.flatnonzero(impacts[:, term])
            centres = rows[::BLOCK]
            cluster = (near[rows] @ near[centres].T).argmax(axis=1)
            order = np.argsort(cluster, kind="stable")
            rows, cluster = rows[order], cluster[order]
            head = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
            summary = np.maximum.reduceat(impacts[rows[:, None], beside[term]], head, axis=0)
            self.lists[term] = rows, np.append(head, len(rows)), summary

    def best(self, terms: np.ndarray, weights: np.ndarray, places: list[np.ndarray], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a query, among them all of its ``k`` best that reach ``least``; places: where each list's summary has the query's terms."""
        bounds, blocks = [], []
        for term, place in zip(terms.tolist(), places, strict=True):
            if term in self.lists:
                rows, head, summary = self.lists[term]
                bounds.append(summary[:, place].astype(np.int64) @ weights)
                blocks += [rows[a:b] for a, b in zip(head[:-1], head[1:], strict=True)]
        none = np.zeros(0, np.int64)
        if not blocks:
            return none, none
        bound = np.concatenate(bounds)
        order = np.argsort(-bound, kind="stable")
        order = order[:np.searchsorted(-bound[order], -least, "right")]  # below the lowest kept score nothing can enter
        seen, docs, scores, at = np.zeros(len(self.impacts), bool), none, none, 0
        while at < len(order) and bound[order[at]] >= least:
            take, size = [], 0
            while at < len(order) and size < STEP and bound[order[at]] >= least:
                take.append(blocks[order[at]])
                size += len(take[-1])
                at += 1
            new = np.unique(np.concatenate(take))
            new = new[~seen[new]]
            seen[new] = True
            value = self.impacts[new[:, None], terms].astype(np.int64) @ weights
            on = value >= least
            docs, scores = np.concatenate([docs, new[on]]), np.concatenate([scores, value[on]])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
                on = scores >= least
                docs, scores = docs[on], scores[on]
        return docs, scores


def searched(counts: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], terms: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, row, id, score, part): the best ``k`` documents of each query in each task, by score, then id (nulls last), then row."""
    used = np.unique(np.concatenate([t for _, t, _ in queries]))
    number = np.full(terms, -1)
    number[used] = np.arange(len(used))
    own = [(q, number[t], w) for q, t, w in queries]
    asking: list[list[np.ndarray]] = [[] for _ in used]
    for _, t, _ in own:
        for x in t.tolist():
            asking[x].append(t)
    beside = [np.unique(np.concatenate(x)) for x in asking]
    most = max(64, min(8_192, CELLS // max(1, len(used))))
    signs = np.random.Generator(np.random.PCG64(12)).choice(np.array([-1, 1], np.float32), (len(used), COORDINATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = [tuple(np.zeros(0, np.int64) for _ in range(4)) for _ in own]  # -score, id is null, id, row

        def through(row: np.ndarray, doc: np.ndarray, null: np.ndarray, impacts: np.ndarray) -> None:
            part = Part(impacts, beside, signs)
            for at, (_, t, w) in enumerate(own):
                least = 1 if len(kept[at][0]) < k else -int(kept[at][0][-1])
                found, score = part.best(t, w, [np.searchsorted(beside[x], t) for x in t.tolist()], k, least)
                if len(found):
                    all_ = [np.concatenate(x) for x in zip(kept[at], (-score, null[found], doc[found], row[found]), strict=True)]
                    order = np.lexsort(all_[::-1])[:k]
                    kept[at] = tuple(x[order] for x in all_)

        for batch in batches:
            row, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4))
            size = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(size)])
            m = 50 + (50 * n * n_docs) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, size))
            for i in range(0, len(row), most):
                j = min(len(row), i + most)
                matrix = np.zeros((j - i, len(used)), np.int32)
                place = number[term[at[i]:at[j]]]
                line = np.repeat(np.arange(j - i), size[i:j])
                on = place >= 0
                matrix[line[on], place[on]] = impact[at[i]:at[j]][on]
                through(row[i:j], doc[i:j], null[i:j], matrix)
        q = np.repeat([x[0] for x in own], [len(x[0]) for x in kept])
        score, null, doc, row = (np.concatenate([x[c] for x in kept]) for c in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(row), pa.array(doc, mask=null == 1), pa.array(-score),
                                          pa.array(np.full(len(q), TaskContext.get().partitionId()), pa.int64())], ["query", "row", "id", "score", "part"])

    return map_arrow(counts, run, "query long, row long, id long, score long, part long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text",
           most_queries: int = MOST_QUERIES, most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, item, rank, row, doc_id, score): the ``k`` best documents of every item with a score above 0, all of them if fewer.

    With N documents that have a term, L terms in all of them and n in one, df documents with a term and tf occurrences of it in a document,
    a term weighs floor(1000 ln((2N + 2) / (2df + 1))) and adds that times (10^9 tf) div (1000 tf + 20 m), m = 50 + (50 n N) div L; each
    term of an item counts once. Equal scores go by id (a long; nulls last), then by place in the table. Null and empty texts have no terms;
    items of equal or null id are ranked each for itself (``item`` is their place). Empty tables give no rows.
    """
    keyed = with_row_key(docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))).select(ROW, "id", "text")
    asked = stored(with_row_key(items.select(F.col(f"`{item_column}`").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))), "queries")
    out = None
    for block, vocabulary in query_blocks(asked, most_queries, most_terms):
        counts = stored(counted(keyed, vocabulary), "term-counts")
        n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row for each term of the block at most
        weight = np.zeros(len(vocabulary), np.int64)
        for term, df in holding:
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        number = {t: x for x, t in enumerate(vocabulary)}
        queries = []
        for row, _, own in block:
            t = np.array(sorted(x for x in map(number.get, own) if weight[x] > 0), np.int64)
            if len(t):
                queries.append((row, t, weight[t]))
        if queries:
            found = stored(searched(counts, queries, len(vocabulary), n_docs, n_terms, k), "found")
            out = found if out is None else out.unionByName(found)
        discard(counts)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "query long, row long, id long, score long, part long")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    for by in (["query", F.col("part") % SALTS], ["query"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    names = asked.select(F.col(ROW).alias("query"), F.col("id").alias("item_id"))
    return out.join(names, "query").select("item_id", F.col("query").alias("item"), "rank", "row", F.col("id").alias("doc_id"), "score")

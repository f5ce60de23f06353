"""Quality rules: fixed base rules, and gradient-boosted trees over document statistics.

The trees are trained on a bounded sample of labelled documents with histogram splits, logistic loss and monotonic
constraints: a feature marked -1 may only lower the score as it grows, one marked 1 only raise it. A
split that breaks the order is refused, and the bound between its children is handed down, so the
whole tree keeps it. For scoring, all trees are flattened into numpy node arrays and every document of a batch walks them
at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ROW, hash_below, map_arrow, pieces, raw_bytes, with_row_key, word_bounds, word_hashes, mixed, U64

#: Fixed base rules: least words, and most repeated words in percent.
LEAST_WORDS = 50
MOST_REPEATED = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_exclaims", "n_bars", "n_distinct", "n_stops")

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
LEADS = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point

FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "mean_word", "upper_share", "digit_share", "exclaim_share", "bar_share", "distinct_share", "words_per_line",
            "stop_share", "log_words")
#: The score may only fall as these grow; the others are free.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "exclaim_share": -1, "bar_share": -1}


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of COUNTS and EXTRA for each text; ``at`` are the texts' offsets into ``data``."""
    n = len(at) - 1
    out = np.zeros((n, len(COUNTS) + len(EXTRA)), np.int64)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[at[1:]] - total[at[:-1]]

    starts, ends, first = word_bounds(data, at)
    hashes = word_hashes(data, starts, ends)
    words = np.diff(first)
    solid = np.zeros(len(data) + 1, np.int8)
    solid[starts] += 1
    solid[ends] -= 1
    inside = np.cumsum(solid[:-1]) > 0
    out[:, 0] = words
    out[:, 1] = per_text(inside & LEADS[data])
    out[:, 2] = per_text(IS_SYMBOL[data])
    out[:, 6] = per_text((data >= 65) & (data <= 90))
    out[:, 7] = per_text((data >= 48) & (data <= 57))
    out[:, 8] = per_text(data == 33)
    out[:, 9] = per_text(data == 124)
    length = ends - starts
    total = np.concatenate([[0], np.cumsum(length <= 3)])
    out[:, 11] = total[first[1:]] - total[first[:-1]]
    triple = mixed(hashes[:-2] * U64(3) + mixed(hashes[1:-1] * U64(5) + mixed(hashes[2:]))) if len(hashes) > 2 else np.zeros(0, np.uint64)
    raw = data.tobytes()
    for k in range(n):
        a, b = int(first[k]), int(first[k + 1])
        lines = [x for x in raw[at[k]:at[k + 1]].split(b"\n") if x.strip()]
        out[k, 3] = len(lines) - len(set(lines))
        out[k, 5] = len(lines)
        if b > a:
            out[k, 10] = len(np.unique(hashes[a:b]))
        if b - a > 3:
            window = triple[a:b - 2]
            order = np.argsort(window, kind="stable")
            same = window[order][1:] == window[order][:-1]
            if same.any():
                twice = np.zeros(b - a, np.int8)
                hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
                for shift in range(3):
                    twice[hit + shift] = 1
                out[k, 4] = int(twice.sum())
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """The trees' features from statistics: shares that do not grow with the text, and its length."""
    c = counts.astype(np.float64)
    words, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1)
    lines = np.maximum(c[:, 5], 1)
    return np.column_stack([c[:, 2] / chars, c[:, 3] / lines, c[:, 4] / words, c[:, 1] / words, c[:, 6] / chars, c[:, 7] / chars, c[:, 8] / words, c[:, 9] / words,
                            c[:, 10] / words, c[:, 0] / lines, c[:, 11] / words, np.log1p(c[:, 0])])


@dataclass
class Forest:
    """Flattened trees: ``feature`` is -1 at a leaf; children of node i are ``left[i]`` and ``left[i] + 1``."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row: all rows walk all trees a level at a time."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            go = self.left[node] + (x[row, np.maximum(f, 0)] > self.threshold[node])
            node = np.where(f >= 0, go, node)
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: int = 20) -> Forest:
    """Boosted trees for labels ``y`` in 0/1, with sums of gradients in histograms of ``bins`` quantile bins."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)] if n else [np.zeros(0)] * d
    code = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)]) if n else np.zeros((0, d), np.int64)
    p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    margin = np.full(n, bias)
    feature, threshold, left, value, roots = [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees if 0 < y.sum() < n else 0):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        roots.append(node())
        todo = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            at, rows, low, high, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = None
            if level < depth and len(rows) >= 2 * least:
                for j in range(d):
                    m = len(edges[j])
                    if not m:
                        continue
                    gl = np.cumsum(np.bincount(code[rows, j], g[rows], m + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], h[rows], m + 1))[:-1]
                    nl = np.cumsum(np.bincount(code[rows, j], minlength=m + 1))[:-1]
                    vl = np.clip(-gl / (hl + l2), low, high)
                    vr = np.clip(-(gs - gl) / (hs - hl + l2), low, high)
                    gain = -(gl * vl + (hl + l2) * vl * vl / 2) - ((gs - gl) * vr + (hs - hl + l2) * vr * vr / 2)
                    bad = (nl < least) | (len(rows) - nl < least) | ((vr - vl) * monotone[j] < 0)
                    gain[bad] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > -np.inf and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k, vl[k], vr[k])
            own = float(np.clip(-gs / (hs + l2), low, high))
            if best is None or best[0] <= -(gs * own + (hs + l2) * own * own / 2) + 1e-9:
                value[at] = rate * own
                margin[rows] += value[at]
                continue
            _, j, k, vl, vr = best
            feature[at], threshold[at] = j, float(edges[j][k])
            left[at] = node()
            node()
            goes = code[rows, j] > k
            mid = (vl + vr) / 2
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[j])]
            todo += [(left[at], rows[~goes], *bounds[0], level + 1), (left[at] + 1, rows[goes], *bounds[1], level + 1)]
    return Forest(np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold), np.array(left, np.int64), np.array(value), bias, depth)


def document_counts(docs: DataFrame, text: str, keep: list[str], model: Forest | None = None) -> DataFrame:
    """``keep`` columns, COUNTS and EXTRA of each text, and with a model its ``score``."""
    names = [*COUNTS, *EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw_bytes(batch.column(len(keep)))
            parts = [statistics(data[at[i]:at[j]], at[i:j + 1] - at[i]) for i, j in pieces(at, 1 << 20)]
            counts = np.concatenate(parts) if parts else np.zeros((0, len(names)), np.int64)
            out = [*[batch.column(k) for k in range(len(keep))], *[pa.array(counts[:, k]) for k in range(len(names))]]
            if model is not None:
                out.append(pa.array(model.score(features(counts))))
            yield pa.RecordBatch.from_arrays(out, [*keep, *names, *(["score"] if model is not None else [])])

    added = [*[T.StructField(c, T.LongType()) for c in names], *([T.StructField("score", T.DoubleType())] if model is not None else [])]
    schema = T.StructType([*[docs.schema[c] for c in keep], *added])
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")), run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 20_000, **how) -> Forest:
    """Train on at most ``sample_rows`` labelled documents, those of least id hash; labels of 0 or 1, others and nulls are left out.

    Only the sample's statistics (a dozen numbers a row) come to the driver. Of several labels of an id the least counts.
    """
    known = labels.where(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{id_column}`").isNotNull()).groupBy(F.col(f"`{id_column}`").alias("id")).agg(F.min(f"`{label}`").alias("y"))
    share = 1.2 * sample_rows / max(1, known.count())  # few more than wanted leave the tasks, however many tasks there are
    sample = known.where(hash_below("id", share)).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    chosen = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(sample), "id")
    rows = document_counts(chosen, "text", ["id", "y"]).orderBy("id").limit(sample_rows).toArrow()
    counts = np.column_stack([rows.column(c).to_numpy().astype(np.int64) for c in (*COUNTS, *EXTRA)]) if rows.num_rows else np.zeros((0, len(COUNTS) + len(EXTRA)), np.int64)
    y = rows.column("y").to_numpy().astype(np.float64)
    learn = counts[:, 0] >= LEAST_WORDS  # the base rules settle the others
    return train(features(counts[learn]), y[learn], np.array([MONOTONE.get(f, 0) for f in FEATURES]), **how)


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5, model: Forest | None = None, **how) -> DataFrame:
    """(row key, id, statistics, score, base_failed, kept) of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. ``base_failed``: fewer than 50 words, or more than half of the words in
    three-word windows that occur twice in the text. ``kept``: not failed, and a score of at least ``threshold``. Equal rows are judged
    alike. Without usable labels (none, or of one kind) the score is the labels' share of good ones (a half if there are none).
    """
    model = model or fit(docs, labels, id_column, text, **how)
    keyed = with_row_key(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")))
    scored = document_counts(keyed, "text", [ROW, "id"], model)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5, model: Forest | None = None, **how) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, decided row by row without a join."""
    model = model or fit(docs, labels, id_column, text, **how)
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw_bytes(batch.column(batch.schema.get_field_index(text)))
            parts = [statistics(data[at[i]:at[j]], at[i:j + 1] - at[i]) for i, j in pieces(at, 1 << 20)]
            if parts:
                c = np.concatenate(parts)
                failed = (c[:, 0] < LEAST_WORDS) | (100 * c[:, 4] > MOST_REPEATED * c[:, 0])
                yield batch.filter(pa.array(~failed & (model.score(features(c)) >= threshold)))

    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in names]), run, docs.schema)

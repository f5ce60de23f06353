"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of one to ``most`` characters of the lower-cased text are hashed to ``buckets``; a term's weight is its share of
the text's n-grams times its inverse document frequency, which is counted over all learning documents. Weights are trained by
follow-the-regularised-leader with elastic-net penalties (most stay exactly zero) on a bounded sample, then one temperature is fitted on
sampled documents set aside, so that scores are calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import U64, below, discard, hash_below, map_arrow, stored

UNKNOWN = "und"
PIECE = 1 << 18


@dataclass(frozen=True)
class Terms:
    buckets: int = 1 << 16
    most: int = 3


def term_ids(texts: list[str], t: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text, and the offsets of the texts. n-grams do not reach over a text's end."""
    line = np.frombuffer("".join(texts).lower().encode("utf-32-le"), np.uint32).astype(np.uint64) if texts else np.zeros(0, np.uint64)
    size = np.array([len(x.lower()) for x in texts], np.int64)
    ends = np.cumsum(size)
    space = (line == 32) | ((line >= 9) & (line <= 13))
    line = np.where(space, U64(32), line)
    line = np.where((line >= 48) & (line <= 57), U64(48), line)
    which = np.repeat(np.arange(len(texts)), size)
    out, of = [], []
    h = np.zeros(len(line), np.uint64)
    for n in range(1, t.most + 1):
        m = len(line) - n + 1
        if m <= 0:
            break
        h = h[:m] * U64(0x9E3779B97F4A7C15) + (line[n - 1:] + U64(n)) * U64(0xC2B2AE3D27D4EB4F)
        whole = which[:m] == which[n - 1:]
        x = h ^ (h >> U64(29))
        x = (x * U64(0xBF58476D1CE4E5B9)) >> U64(64 - t.buckets.bit_length() + 1)
        out.append(x[whole].astype(np.int32))
        of.append(which[:m][whole])
    if not out:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    counts = sum(np.bincount(o, minlength=len(texts)) for o in of)
    ids = np.concatenate(out)
    if len(texts) > 1:
        ids = ids[np.argsort(np.concatenate(of), kind="stable")]
    return ids, np.concatenate([[0], np.cumsum(counts)])


def batches_of(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of texts of about ``most`` characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= most):
            size += len(texts[j] or "")
            j += 1
        yield i, j, [x or "" for x in texts[i:j]]
        i = j


def document_frequency(docs: DataFrame, text: str, t: Terms) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts: one vector a task, summed by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(t.buckets, np.int64), 0
        for batch in batches:
            for _, _, texts in batches_of(batch.column(0).to_pylist()):
                ids, at = term_ids(texts, t)
                for k in range(len(texts)):
                    seen = np.zeros(t.buckets, bool)
                    seen[ids[at[k]:at[k + 1]]] = True
                    total += seen
                n += len(texts)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1)), pa.array(np.append(total[on], n))], ["bucket", "n"])

    rows = map_arrow(docs.select(F.col(f"`{text}`")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most buckets + 1 rows
    bucket, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("bucket", "n"))
    total = np.zeros(t.buckets, np.int64)
    total[bucket[bucket >= 0]] = n[bucket >= 0]
    return total, int(n[bucket < 0].sum())


@dataclass
class Model:
    terms: Terms
    languages: list[str]
    weights: np.ndarray  # buckets x languages, inverse document frequency included
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        ids, at = term_ids(texts, self.terms)
        out = np.tile(self.bias, (len(texts), 1))
        n = np.diff(at)
        some = np.flatnonzero(n)
        for k in some:
            out[k] += np.bincount(ids[at[k]:at[k + 1]], minlength=self.terms.buckets) @ self.weights / n[k] if n[k] > self.terms.buckets else self.weights[ids[at[k]:at[k + 1]]].sum(axis=0) / n[k]
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(texts)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, buckets: int, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a multinomial logistic regression by FTRL-proximal steps, one sparse row at a time; the last bucket is the bias, without penalty."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    pen = np.append(np.full(buckets, l1), 0.0)

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        p = pen[at][:, None]
        return np.where(np.abs(zz) <= p, 0.0, -(zz - np.sign(zz) * p) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, value = rows[k]
            at, value = np.append(at, buckets), np.append(value, 1.0)
            w = weights(at)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[k]] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(buckets + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def shares(known: DataFrame, per_language: int) -> dict[str, float]:
    """The share of all text hashes that holds ``per_language`` different texts of each language, or all of its texts where it has fewer.

    Different texts are counted by their hashes, so copies weigh nothing; a draw that comes back short is made again with twice the share.
    """
    hashes = stored(known.select("lang", F.xxhash64("text").alias("h")).distinct(), "text-hashes")
    sizes = {r["lang"]: r["count"] for r in hashes.groupBy("lang").count().collect()}  # one row per language
    out, short = {}, {name: min(1.0, 1.5 * per_language / n) for name, n in sizes.items()}
    while short:
        out |= short
        low = F.lit(False)
        for name, share in short.items():
            low = low | ((F.col("lang") == name) & below(F.col("h"), share))
        drawn = {r["lang"]: r["count"] for r in hashes.where(low).groupBy("lang").count().collect()}
        short = {name: min(1.0, 2 * share) for name, share in short.items() if drawn.get(name, 0) < min(per_language, sizes[name])}
    discard(hashes)
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 600, terms: Terms = Terms(), epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
        l1: float = 0.02, l2: float = 0.001, scale: float = 40.0, seed: int = 7) -> Model:
    """Learn from ``docs`` (null texts and languages are left out).

    Document frequencies come from all of them. Weights are trained on at most ``per_language`` different texts of each language, those of
    least text hash, so the sample is bounded by the number of languages; every fifth of them is set aside for the temperature.
    """
    known = docs.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    frequency, total = document_frequency(known, "text", terms)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    picked = F.lit(False)
    for name, share in shares(known, per_language).items():  # few more than wanted leave the tasks, however many tasks there are
        picked = picked | ((F.col("lang") == name) & hash_below("text", share))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    sample = known.where(picked).distinct().withColumn("k", rank).where(F.col("k") <= per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, texts in batches_of(batch.column(0).to_pylist()):
                ids, at = term_ids(texts, terms)
                for i in range(len(texts)):
                    u, c = np.unique(ids[at[i]:at[i + 1]], return_counts=True)
                    out.append((u, c.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([u for u, _ in out], pa.list_(pa.int32())), pa.array([c for _, c in out], pa.list_(pa.int32()))], ["lang", "k", "at", "n"])

    rows = map_arrow(sample.select("text", "lang", "k"), run, "lang string, k int, at array<int>, n array<int>").orderBy("lang", "k").collect()
    languages = sorted({r.lang for r in rows}) or [UNKNOWN]
    number = {x: i for i, x in enumerate(languages)}
    x = [(np.array(r["at"], np.int64), scale * idf[np.array(r["at"], np.int64)] * np.array(r["n"]) / max(1, sum(r["n"]))) for r in rows]
    y = np.array([number[r.lang] for r in rows], np.int64)
    aside = np.array([r.k % 5 == 0 for r in rows], bool)
    learn = np.flatnonzero(~aside)
    w, bias = ftrl([x[i] for i in learn], y[learn], terms.buckets, len(languages), epochs, alpha, beta, l1, l2, seed)
    held = np.array([v @ w[at] + bias for at, v in (x[i] for i in np.flatnonzero(aside))]).reshape(-1, len(languages))
    return Model(terms, languages, scale * idf[:, None] * w, bias, fit_temperature(held, y[aside]))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default all but the text), ``lang_pred`` and ``score`` (calibrated probability, 0 to 1) of every row.

    ``und`` with score 0 if the text is null or has no letter. Whole texts are read; equal texts get equal answers;
    columns named like the new ones are replaced. An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score") and (keep is not None or c != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            lettered = np.array(batch.column(len(keep) + 1).to_pylist(), bool)
            names, scores = [], []
            for _, _, part in batches_of(texts):
                best, p = model.predict(part)
                names += [model.languages[b] for b in best]
                scores.append(p)
            p = np.where(lettered, np.concatenate(scores), 0.0) if scores else np.zeros(0)
            lang = [n if ok else UNKNOWN for n, ok in zip(names, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(lang, pa.string()), pa.array(p)], [*keep, "lang_pred", "score"])

    schema = T.StructType([*[docs.schema[c] for c in keep], *T.StructType.fromDDL("lang_pred string, score double").fields])
    lettered = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    return map_arrow(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"), lettered.alias("_lettered")), run, schema)


def held_out(id_column: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))

"""Collocations, ranked search and byte-level BPE against brute force, on nulls, empty tables, long texts, ties and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyline.llm import bytepairs, collocations, queries, search

RULES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, ids string, `_row` long, row string, `query` string, `odd name` struct<`a b`:int,`x-y`:string>"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, g, "own", 7, "r", "q", (1, "z")) for i, t, g in rows], SCHEMA).repartition(parts)


# --- collocations ---------------------------------------------------------------------------------------------


def brute_collocations(rows, least, longest, most, percent):
    out = []
    for lang in sorted({g or "und" for _, _, g in rows}):
        pieces = []
        for _, t, g in rows:
            if (g or "und") == lang:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
                pieces += [[w for w in re.split(r"[\x20\x09]", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]
        f = collections.Counter(tuple(p[i:i + k]) for p in pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)]
    return out


def phrase_rows():
    rng = random.Random(4)
    words = ["a", "b", "ab", "É", "é", "c\x01", "c", "日本", "New", "york", "|"]
    rows = []
    for k in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ", " a b c "]) for _ in range(rng.randint(0, 120)))
        rows.append((k, text, rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += [(99, None, "en"), (100, "", "fr"), (101, " \t\n", None), (102, "a a a a a a " * 700, "en"), (None, "new york " * 30, None), (None, "new york " * 30, None)]
    return rows


@pytest.mark.parametrize(("least", "longest", "most", "percent", "budget"), [(5, 5, 2000, 100, 1_000_000), (5, 5, 7, 100, 20), (3, 4, 2000, 60, 5), (2, 2, 50, 100, 1)])
def test_collocations(spark, least, longest, most, percent, budget):
    rows = phrase_rows()
    got = collocations.mine(table(spark, rows), least=least, longest=longest, most=most, percent=percent, budget=budget)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_collocations(rows, least, longest, most, percent))


def test_small_tables_at_once(spark, monkeypatch):
    """Counts handed on many times, hashes too, and text taken piece by piece give the same phrases."""
    rows = phrase_rows()
    lines = list(collocations.lines(iter([])))
    assert lines == []
    for name in ("MOST_HELD", "MOST_HASHES", "TEXT_BYTES"):
        monkeypatch.setattr(collocations, name, 40)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([g for _, _, g in rows]), pa.array([t for _, t, _ in rows])], ["lang", "text"])
    whole = collections.Counter(w for _, text in collocations.lines(iter([batch])) for w in text.split())
    assert whole == collections.Counter(w for _, t, _ in rows for w in (t or "").encode().translate(collocations.AS_PIECES).split())


def test_no_texts(spark):
    assert collocations.mine(table(spark, []), least=1).count() == 0
    assert collocations.mine(table(spark, [(1, None, None), (2, "", "en"), (3, "one", "en")]), least=1).count() == 0


def test_hash_packing():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 1000):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert (collocations.unpacked(collocations.packed(x)) == x).all()


# --- ranked search ----------------------------------------------------------------------------------------------


def brute_search(rows, items, k):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    docs = [(i, collections.Counter(terms(t))) for i, t, _ in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search_rows():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = [(k, rng.choice([" ", "-", "_\n"]).join(rng.choice(words).upper() if rng.random() < .1 else rng.choice(words) for _ in range(rng.randint(0, 60))), "en") for k in range(400)]
    rows += [(1000 + k, rows[5][1], "en") for k in range(150)] + [(None, rows[5][1], "en"), (None, None, None), (3, None, "x"), (4, "?!", "x"), (5000, " ".join(words * 300), "x"), (7, rows[7][1], "en")]
    items = [(k, " ".join(rng.sample(words, rng.randint(1, 12)))) for k in range(30)] + [(90, rows[5][1]), (91, None), (92, ""), (93, "unseen"), (None, words[0]), (94, words[0] + " " + words[0].upper()), (94, words[1])]
    return rows, items


@pytest.mark.parametrize(("k", "most_queries", "most_terms"), [(50, 4096, 8192), (3, 5, 8192), (10, 4096, 10)])
def test_search(spark, k, most_queries, most_terms):
    rows, items = search_rows()
    wanted = spark.createDataFrame([(i, t, "own") for i, t in items], "item_id long, text string, row string")
    found = search.search(table(spark, rows), wanted, k, most_queries=most_queries, most_terms=most_terms)
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()]
    assert sorted(got, key=repr) == brute_search(rows, items, k)


def test_bounds_skip_and_hold():
    """Blocks are skipped, and what is scored holds every document at or above the lowest kept score."""
    rng = np.random.Generator(np.random.PCG64(2))
    impacts = np.where(rng.random((3000, 40)) < .1, rng.integers(1, 10**6, (3000, 40)), 0).astype(np.int32)
    impacts[:, 7] = rng.integers(1, 1000, 3000)  # a term of every document
    beside = [np.arange(40)] * 40
    part = search.Part(impacts, beside, rng.choice(np.array([-1, 1], np.float32), (40, 16)))
    terms, weights = np.array([1, 7, 9, 22]), np.array([4000, 1, 5000, 3000])
    docs, scores = part.best(terms, weights, [terms] * 4, 10, 1)
    exact = impacts[:, terms].astype(np.int64) @ weights
    assert (exact[docs] == scores).all() and set(np.flatnonzero(exact >= np.sort(exact)[-10])) <= set(docs.tolist())
    least = int(np.sort(exact)[-10])
    rows, head, summary = part.lists[7]
    assert (summary.astype(np.int64)[:, terms] @ weights < least).any()  # blocks that are never scored


def test_search_in_nothing(spark):
    rows, items = search_rows()
    none = spark.createDataFrame([], "item_id long, text string")
    assert search.search(table(spark, rows), none).count() == 0
    assert search.search(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# --- byte-level BPE -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    with open(RULES[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=RULES[1], mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs(spark, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aabcdeé \n\t19.,<|'sß漢😀") for _ in range(rng.choice([1, 9, 80, 600]))) for _ in range(120)]
    texts += [None, "", "x" * 5000, " " * 4000 + "y", "".join(rng.choice("ehtao") for _ in range(7000)), "<|endoftext|>", "I'll've\x00\x1c", texts[0], texts[0]]
    docs = table(spark, [(k, t, None) for k, t in enumerate(texts)] + [(None, "null id", "x")])
    coded = bytepairs.encode(docs, *RULES, keep=("doc_id", "row", "odd name"), ids="tokens")
    back = bytepairs.decode(coded, *RULES, ids="tokens", keep=("doc_id", "tokens", "odd name"), out="row")
    got = {r.doc_id: (list(r.tokens), bytes(r.row)) for r in back.collect()}
    assert len(got) == len(texts) + 1 and back.count() == len(texts) + 1
    for k, t in [*enumerate(texts), (None, "null id")]:
        assert got[k] == (library.encode_ordinary(t or ""), (t or "").encode())
    with pytest.raises(ValueError):
        bytepairs.encode(docs, *RULES, keep=("doc_id", "ids"))
    assert bytepairs.decode(bytepairs.encode(docs.limit(0), *RULES), *RULES).count() == 0


def test_pair_table():
    rng = np.random.Generator(np.random.PCG64(3))
    pairs = np.unique(rng.integers(0, 60_000, (5000, 2)), axis=0).astype(np.int32)
    book = bytepairs.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    assert (book.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (book.find(pairs[:, 0], pairs[:, 1] + 60_000) == bytepairs.NONE).all() and book.find(np.array([-1], np.int32), np.array([3], np.int32))[0] == bytepairs.NONE


def test_byte_bpe_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.QUERIES["op13_byte_level_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

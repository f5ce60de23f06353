"""The text operators against brute force, and on nulls, empty tables, repeated rows, long texts and clashing columns."""

import collections
import hashlib
import random
import re
import tempfile
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyline.llm import common, components, contamination, language, nearcopies, packing, phrases, quality, queries, sharding, simhash, suffixes, tokenfiles, tokens, urls

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, kept string, _row long, row string, score string, shard string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed=1):
    """Texts with shared passages, exact and near copies, periods, nulls, blanks and one long text."""
    rng = random.Random(seed)
    shared = [sentence(rng, 120) for _ in range(3)]
    texts = [sentence(rng, rng.randint(1, 300)) for _ in range(20)]
    texts += [f"{sentence(rng, 20)} {shared[k % 3]} {sentence(rng, 15)}" for k in range(9)]
    texts += [shared[0] + "\n" + shared[0], "aba " * 400, "x" * 3000, texts[3], texts[3], texts[4] + " more", None, None, "", " \n\t", "É " * 300]
    texts.append(" ".join(sentence(rng, 50) for _ in range(200)) + " " + shared[1])
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, texts[3]), (None, texts[5]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "own", 7, "r", "s", "h") for i, t in corpus()]
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/docs"
    spark.createDataFrame(rows, SCHEMA).repartition(3, F.xxhash64("doc_id", "text")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/none"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def brute_spans(parts, window):
    """Removed unit ranges of each sequence."""
    seen = collections.Counter(p[j:j + window] for p in parts for j in range(len(p) - window + 1))
    out = []
    for p in parts:
        mark = [False] * (len(p) + 1)
        for j in range(len(p) - window + 1):
            if seen[p[j:j + window]] > 1:
                mark[j:j + window] = [True] * window
        runs, at = [], None
        for k, m in enumerate(mark):
            if m and at is None:
                at = k
            if not m and at is not None:
                runs.append((at, k))
                at = None
        out.append(runs)
    return out


@pytest.mark.parametrize("most_segments", [5_000, 1])
def test_suffix_dedup(docs, most_segments):
    done = suffixes.remove_substrings(docs, window=400, most_segments=most_segments)
    rows = corpus()
    raws = [(t or "").encode() for _, t in rows]
    want = collections.Counter()
    for (i, t), raw, runs in zip(rows, raws, brute_spans(raws, 400), strict=True):
        left = b"".join(raw[a:b] for a, b in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(raw)], strict=True))
        want[(i, t, left, tuple(runs))] += 1
    assert done.columns == ["doc_id", "text", "_row", "row", "score", "shard", "kept", "spans"]
    assert collections.Counter((r.doc_id, r.text, bytes(r.kept), tuple(map(tuple, r.spans))) for r in done.collect()) == want


@pytest.mark.parametrize("most_segments", [5_000, 1])
def test_phrase_dedup(docs, most_segments):
    done = phrases.remove_phrases(docs, window=35, most_segments=most_segments)
    rows = corpus()
    parts = [tuple(WORD.findall(t or "")) for _, t in rows]
    want = collections.Counter()
    for (i, t), p, runs in zip(rows, parts, brute_spans(parts, 35), strict=True):
        gone = {k for a, b in runs for k in range(a, b)}
        want[(i, t, " ".join(w for k, w in enumerate(p) if k not in gone), tuple(runs))] += 1
    assert collections.Counter((r.doc_id, r.text, r.kept, tuple(map(tuple, r.spans))) for r in done.collect()) == want


def test_suffix_sort_orders_and_verifies():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1300] = data[100:400]
    starts = np.arange(2800)
    bucket = np.sort(rng.integers(0, 5, 2800))
    s = suffixes.Suffixes(data, 120)
    got = s.sorted(starts, bucket)
    for b in range(5):
        own = got[bucket == b]
        keys = [data[k:k + 120].tobytes() for k in own]
        assert keys == sorted(keys) and sorted(own) == sorted(starts[bucket == b])
    a, c = np.array([100]), np.array([1000])
    assert s.common(a, c)[0] == 120 and s.verified(a, c) and not s.verified(a, c + 1)


def test_empty_tables(spark, none):
    assert suffixes.remove_substrings(none).count() == phrases.remove_phrases(none).count() == 0
    assert sharding.assign(none, 4).count() == packing.pack(none, WORDS).count() == 0
    assert simhash.near_duplicates(none).count() == simhash.keep_first(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(none, labels).count() == quality.keep_good(none, labels).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contained(none, items).count() == contamination.clean(none, items).count() == 0
    assert urls.judge(none.select(F.col("text").alias("url")), none.select(F.col("text").alias("url"), F.lit(True).alias("bad")), queries.RULES).count() == 0
    model = language.fit(none.select("text", F.lit("en").alias("lang")))
    assert language.identify(none, model).count() == 0
    folder = tempfile.mkdtemp(prefix="llm-tests-")
    tokenfiles.write_tokens(none, folder, BYTES)
    assert tokenfiles.read_tokens(spark, folder).count() == 0


# --- sharding -----------------------------------------------------------------------------------------------

def test_shards(docs):
    rows = sharding.assign(docs, 5).collect()
    assert len(rows) == len(corpus())
    assert collections.Counter((r.id, r.size, r.text_crc32) for r in rows) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus())
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.slot):
        by[r.shard].append(r)
    order = [r for s in sorted(by) for r in by[s]]
    assert [(-1 if r.id is None else r.id) for r in order] == sorted(-1 if r.id is None else r.id for r in order)
    assert all([r.slot for r in v] == list(range(len(v))) for v in by.values())
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    assert all(abs(sum(r.size for r in by[s]) - total / 5) <= largest for s in range(5))


def test_one_id_for_all_rows(spark):
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/same"
    spark.range(1000, numPartitions=4).select(F.lit(9).cast("long").alias("doc_id"), F.lit("ab").alias("text")).write.parquet(path)
    got = sharding.assign(spark.read.parquet(path), 8).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sorted((r.n, r.m) for r in got) == [(125, 124)] * 8


def test_written_shards(spark, docs):
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/shards"
    sharding.write_shards(docs, 3, path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and back.where("row = 'r' and _row = 7").count() == docs.count()
    with pytest.raises(ValueError):
        sharding.assign(docs, 0)


# --- tokens, packing, files -----------------------------------------------------------------------------------

ALPHABET = st.text(alphabet=st.one_of(st.characters(), st.sampled_from(" \n\t aAéß's1.<|>,-Àÿ×÷\u00a0\u3000\x1c\u0301")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_encoder_equals_library(text):
    text = text.encode("utf-8", "ignore").decode()
    for path in (WORDS, BYTES):
        enc = tokens.encoder(path)
        assert enc.encode(text) == enc.whole(text)


def test_encoder_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_CACHED", 5)
    enc = tokens.Encoder(BYTES)
    for text in ("one two three", "four five six seven", "one two eight nine", "one two three four"):
        assert enc.encode(text) == enc.whole(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=60))
def test_best_fit(lengths):
    bins = packing.best_fit(np.array(lengths), 16)
    fill = np.bincount(bins, lengths)
    assert fill.max() <= 16 and len(fill) <= max(-(-sum(lengths) * 11 // (9 * 16)) + 4, 1)


@pytest.mark.parametrize("most_items", [50_000, 10])
def test_packing(docs, most_items):
    library = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    total = 0
    for i, t in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, s in enumerate(range(0, len(ids), 256)):
            want[(i, k, s, len(ids[s:s + 256]), zlib.crc32(np.array(ids[s:s + 256], "<u4").tobytes()))] += 1
    rows = packing.pack(docs, WORDS, capacity=256, most_items=most_items).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert {(r.row, r._row, r.kept) for r in rows} == {("r", 7, "own")}
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-total // 256) + 2


def test_pieces_that_never_fit_end_the_tree(spark):
    rows = spark.range(300, numPartitions=3).select(F.col("id").alias("row"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(150).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    assert packing.packed_bins(rows, 256, most_items=20).count() == 300


def test_token_files(spark, docs):
    library = Tokenizer.from_file(BYTES)
    folder = tempfile.mkdtemp(prefix="llm-tests-")
    manifest = tokenfiles.write_tokens(docs, folder, BYTES, file_ids=2000, dictionary_bytes=1024, tasks=3)
    assert len(manifest["files"]) > 3 and manifest["dictionary"] != hashlib.sha256(b"").hexdigest()
    ordered = sorted(corpus(), key=lambda r: -1 if r[0] is None else r[0])
    rows = sorted(tokenfiles.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == [i for i, _ in ordered]
    at, seen = 0, collections.Counter()
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        seen[(r.id, r.n_tokens, r.ids_crc32)] += 1
    encoded = {t: library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in ordered}
    assert seen == collections.Counter((i, len(encoded[t]), zlib.crc32(np.array(encoded[t], "<u4").tobytes())) for i, t in ordered)
    assert sorted(x.tolist() for x in tokenfiles.read_document(spark, folder, 3)) == sorted(encoded[t] for i, t in ordered if i == 3)
    assert tokenfiles.read_document(spark, folder, 99) == []


# --- SimHash --------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[j:j + 4]) for j in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, most=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) for k in range(len(fps))]


def test_near_duplicates(docs):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = collections.defaultdict(list)
    for k, r in enumerate(brute_components(fps)):
        groups[r].append(k)
    want = collections.Counter()
    for own in groups.values():
        least = min((rows[k][0] for k in own if rows[k][0] is not None), default=None)
        want.update((rows[k][0], fps[k], least) for k in own)
    got = simhash.near_duplicates(docs).collect()
    assert collections.Counter((r.id, r.fp % 2**64, r.component) for r in got) == want
    left = simhash.keep_first(docs)
    assert left.columns == docs.columns and left.count() == len(groups)


@pytest.mark.parametrize("small", [64, 0])
def test_links_of_fingerprints(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1, 2**63]
    fps = set(base)
    for b in base:
        for _ in range(12):
            for k in rng.sample(range(64), rng.randint(1, 6)):
                b ^= 1 << k
            fps.add(b)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    rows = simhash.probes(iter([__import__("pyarrow").RecordBatch.from_pydict({"fp": signed})]))
    batch = next(rows)
    order = np.argsort(batch.column(0).to_numpy(), kind="stable")
    links = [b for b in simhash.bucket_links(4)(iter([batch.take(__import__("pyarrow").array(order))]))]
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in links:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            assert ((u ^ v) % 2**64).bit_count() <= 4
            root[find(u)] = find(v)
    want, got = brute_components(fps), [find(x) for x in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5000, 5000), (7, 7)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    assert got == {x: find(x) for x in root if find(x) != x}


# --- quality, decontamination, URLs, language ------------------------------------------------------------------

def test_quality_statistics_and_base_rules(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(None, 1, 0), (3, None, 0), (2, 5, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    want = collections.Counter()
    for i, t in corpus():
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {j + s for j in range(len(w) - 2) if c[tuple(w[j:j + 3])] > 1 for s in range(3)}
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), failed)] += 1
    assert collections.Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(not (r.base_failed and r.kept) for r in rows)
    model = quality.fit(docs, labels)
    assert sorted(map(str, quality.keep_good(docs, labels, model=model).collect())) == sorted(
        str(r) for r in docs.collect() if any(x.kept and x.id == r.doc_id and x.n_words == len(WORD.findall(r.text or "")) for x in rows))


def test_trees_learn_and_keep_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] - np.sin(3 * x[:, 1]) + rng.normal(size=3000) * 0.3) > 0).astype(float)
    model = quality.train(x, y, np.array([1, 0, -1]), trees=40)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    grid = np.repeat(rng.normal(size=(50, 3)), 30, axis=0)
    for j, sign in ((0, 1), (2, -1)):
        moved = grid.copy()
        moved[:, j] = np.tile(np.linspace(-3, 3, 30), 50)
        steps = np.diff(model.score(moved).reshape(50, 30), axis=1) * sign
        assert steps.min() >= -1e-12


def test_quality_held_out_accuracy(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    labels = read("labels")
    rows = quality.judge(read("documents"), labels.where("doc_id % 3 > 0")).where("not base_failed and id % 3 = 0").join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    assert len(rows) > 50 and sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.95


@pytest.mark.parametrize("most_entries", [1_000_000, 0])
def test_containment(spark, docs, most_entries):
    rng = random.Random(11)
    texts = [t for _, t in corpus() if t and len(t.split()) > 40]
    items = []
    for k, t in enumerate(texts):
        w = t.split()
        a = rng.randrange(len(w) - 30)
        part = w[a:a + rng.randint(5, 30)]
        if k % 3 == 1:
            part[len(part) // 2] = "CHANGED"
        items.append((k, " ".join(part).upper() if k % 2 else "\n".join(part)))
    items += [(100, "a b c"), (102, " ".join(texts[0].split()[:3])), (103, texts[1].split()[7]), (104, "no such words"), (105, " ".join(texts[2].split()[-4:])), (None, None), (101, ""), (7, items[0][1]), (None, items[2][1])]
    table = tempfile.mkdtemp(prefix="llm-tests-") + "/items"
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(table)

    def words(t):
        return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def shingles(t, k):
        w = words(t)
        return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if k else set()

    want = collections.Counter()
    own = [(i, min(5, len(words(t))), shingles(t, min(5, len(words(t))))) for i, t in items]
    for _, t in corpus():
        for i, k, x in own:
            s = shingles(t, k)
            if x and len(x & s) >= 0.8 * len(x):
                want[(i, len(x), len(x & s))] += 1
    found = contamination.contained(docs, spark.read.parquet(table), most_entries=most_entries)
    assert collections.Counter((r.item_id, r.n, r.common) for r in found.collect()) == want and want
    left = contamination.clean(docs, spark.read.parquet(table))
    assert left.columns == docs.columns
    assert left.count() == sum(not any(x and len(x & shingles(t, k)) >= 0.8 * len(x) for _, k, x in own) for _, t in corpus())


def test_long_text_full_of_items(spark):
    """50,000 words that are nothing but benchmark items: each document's shingles are made twice, not once for each hit."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole = " ".join(r.text for r in items.collect())
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/full"
    spark.createDataFrame([(1, " ".join([whole] * (50_000 // len(whole.split()) + 1))), (2, "clean")], "doc_id long, text string").coalesce(1).write.parquet(path)
    started = time.time()
    found = contamination.contained(spark.read.parquet(path), items).count()
    assert found == items.count() and time.time() - started < 60


def test_url_parts_and_rules(spark):
    cases = [("HTTP://A.Example.ORG/es/x?q=1#f", "a.example.org", "/es/x"), ("https://x.com", "x.com", ""), ("http://b.com?x=/y", "b.com", ""), ("no scheme", "", ""), (None, "", ""),
             ("a://h#p/q", "h", ""), ("x://y://z/w", "y:", "//z/w"), ("http://É.com/Ä", "É.com", "/Ä")]
    df = spark.createDataFrame([(c[0],) for c in cases], "url string").coalesce(1)
    rows = urls.judge(df, df.select("url", F.lit(None).cast("boolean").alias("bad")), queries.RULES).orderBy("_row").collect()
    assert [(r.host, r.path) for r in rows] == [c[1:] for c in cases]

    def brute(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    assert [(r.rule, r.verdict) for r in rows] == [brute(r.host, r.path) for r in rows]
    assert rows[0].rule == "example.org/es/" and rows[0].verdict == "block"


def test_mined_url_rules(spark):
    rng = random.Random(4)
    rows = []
    for k in range(600):
        host = rng.choice(["win-big", "news", "blog", "cheap-win"])
        rows.append((f"http://{host}{k % 7}.example.net/{rng.choice(['en', 'fr'])}/{k}.html?ref=x", None))
    rows = [(u, ("win" in u and "/en/" in u) if k % 2 else None) for k, (u, _) in enumerate(rows)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    got = urls.judge(df.coalesce(1), df, []).orderBy("_row").collect()
    # brute force: combinations of up to all tokens, counted over the labelled URLs
    token = lambda u: {r for r in spark_tokens[u]}
    parts = df.select("url", urls.url_tokens(F.col("url"), *urls.split_url(F.col("url"))).alias("t")).collect()
    spark_tokens = {r.url: frozenset(r.t) for r in parts}
    import itertools
    labelled = [(token(u), b) for u, b in rows if b is not None]
    need, both, alone = max(0.005 * len(labelled), 20), collections.Counter(), collections.Counter()
    for t, b in labelled:
        for n in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), n):
                alone[c] += 1
                both[c] += b
    rules = [set(c) for c, n in both.items() if n >= need and n / alone[c] >= 0.8]
    assert rules and [r.verdict for r in got] == ["block" if any(c <= token(u) for c in rules) else "allow" for u, _ in rows]


def test_url_labels_are_of_the_document_in_the_path(spark):
    pages = spark.createDataFrame([(0, "http://a.net/en/7.html?page=1"), (1, "http://a.net/fr/8/"), (7, "http://a.net/en/0#x"), (8, "http://a.net/en/x"), (9, None), (10, "http://b.net/12"), (11, "http://b.net/99999999999999999999")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 1), (12, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.url: r.bad for r in queries.url_labels(pages, labels).collect()}
    assert got == {"http://a.net/en/7.html?page=1": True, "http://a.net/fr/8/": True, "http://a.net/en/0#x": None, "http://a.net/en/x": None, None: None, "http://b.net/12": False,
                   "http://b.net/99999999999999999999": None}


def test_decided_urls_are_no_examples(spark):
    decided = [(f"http://x.org/ok/{k}", k % 2 == 0) for k in range(5000)]  # as many good ones as bad ones under an explicit rule
    own = [(f"http://spam-{k}.net/ok/{k}", True) for k in range(20)]
    df = spark.createDataFrame([*decided, *own], "url string, bad boolean").coalesce(1)
    got = urls.judge(df, df, [("allow", "x.org", "/")]).groupBy("host", "verdict").count().collect()
    assert {(r.host, r.verdict) for r in got} == {("x.org", "allow"), *((f"spam-{k}.net", "block") for k in range(20))}


def test_language(spark):
    read = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(read.where("not held_out"), per_language=100)
    got = language.identify(read, model, keep=["doc_id", "lang", "held_out"]).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert (model.weights == 0).mean() > 0.5 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !! --", "x"), (4, "the and of é", "x")], "doc_id long, text string, score string")
    rows = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and rows[4].lang_pred in model.languages and 0 < rows[4].score <= 1


def test_language_sample_ignores_copies(spark):
    rng = random.Random(8)
    rows = [(sentence(rng, 12), "a") for _ in range(300)] + [(sentence(rng, 12), "b") for _ in range(300)]
    few = spark.createDataFrame(rows, "text string, lang string")
    copies = spark.range(200_000).select(F.lit("the same text each time").alias("text"), F.lit("a").alias("lang"))
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/copies"
    few.unionByName(copies).write.parquet(path)
    docs = spark.read.parquet(path)
    assert language.fit(docs, per_language=10, epochs=1).languages == ["a", "b"]
    for per_language in (1, 100, 1000):
        share = language.shares(docs, per_language)
        for name, different in (("a", 301), ("b", 300)):
            drawn = docs.where(F.col("lang") == name).where(language.hash_below("text", share[name])).distinct().count()
            assert drawn >= min(per_language, different)


def test_temperature():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(20000, 3))
    p = language.softmax(z)
    y = (p.cumsum(axis=1) > rng.random((20000, 1))).argmax(axis=1)
    assert abs(language.fit_temperature(5 * z, y) - 5) < 0.3


def test_packing_ends_with_no_mergeable_bins(spark):
    sizes = [60] * 6000 + [41] * 10  # only the last ones fit together; a round over many tasks saves few bins
    pieces = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECE)
    bins = packing.packed_bins(pieces, 100, 2, most_items=300)
    assert bins.count() == 6005
    assert sorted(r.row for r in bins.selectExpr("explode(pieces.row) AS row").collect()) == list(range(6010))


def test_row_keys_outlast_a_change_of_cores(spark):
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/splits"
    spark.range(800).repartition(8).write.parquet(path)
    cores, before = "spark.sql.leafNodeDefaultParallelism", spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.unset("spark.sql.files.minPartitionNum")
    try:
        keys = []
        for n in (2, 16):  # the default that counts registered cores, as Spark takes it at each plan
            spark.conf.set(cores, n)
            keys.append(sorted(tuple(r) for r in common.with_row_key(spark.read.parquet(path)).collect()))
        assert keys[0] == keys[1]
    finally:
        spark.conf.unset(cores)
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)


def five(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def brute_first(rows):
    """Ids left of (id, text): the least of each chain of rows with a five-word Jaccard similarity of 0.8 or more."""
    sets = [five(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return collections.Counter(None if none else i for none, i in least.values())


def test_near_copies_of_the_pipeline(spark, docs, none):
    rng = random.Random(12)
    rows = corpus()
    for k in range(25):  # similarity 0.7 to 0.95
        w = sentence(rng, rng.randint(60, 400)).split()
        n = len(w)
        changed = list(w)
        for at in rng.sample(range(n), max(1, int(n * rng.uniform(0.006, 0.04)))):
            changed[at] = "changed"
        rows += [(1000 + 2 * k, " ".join(w)), (1001 + 2 * k, " ".join(changed))]
    base = sentence(rng, 200).split()
    rows += [(2000 + k, " ".join(base[:k] + [f"n{k}"] + base[k + 1:])) for k in range(90)]  # a large group, whose members are one word apart
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/near"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text").write.parquet(path)
    left = corpus_pipeline.simhash_near_dedup(spark, spark.read.parquet(path), FOLDER)
    assert left.columns == ["doc_id", "text"]
    assert collections.Counter(r.doc_id for r in left.collect()) == brute_first(rows)
    assert corpus_pipeline.simhash_near_dedup(spark, none, FOLDER).count() == 0


def test_fingerprints_give_candidates_first(spark, monkeypatch):
    far = 0x0F0F0F0F0F0F0F0F
    entries = spark.createDataFrame([(7, 5), (2, 5), (3, 5 ^ 0b1111 << 20), (4, 5 ^ 0b11111 << 40), (5, far), (6, -far)], "row long, fp long")
    pairs = sorted(tuple(r) for r in nearcopies.fingerprint_pairs(entries).distinct().collect())
    assert pairs == [(2, 3), (2, 7)]
    rng, seen, plain = random.Random(3), [], nearcopies.fingerprint_pairs
    w = [sentence(rng, 300).split() for _ in range(4)]
    rows = [(10 * k + n, " ".join(x[n:])) for k, x in enumerate(w) for n in range(2)]
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/first"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    monkeypatch.setattr(nearcopies, "fingerprint_pairs", lambda entries: seen.append(plain(entries).distinct().count()) or plain(entries))
    left = corpus_pipeline.simhash_near_dedup(spark, spark.read.parquet(path), FOLDER)
    assert sorted(r.doc_id for r in left.collect()) == [0, 10, 20, 30] and seen[0] > 0


def test_pipeline(spark):
    """Every stage's rows against a plain version on the stage's own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    steps, before = [docs], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = corpus_pipeline.stored(stage(spark, before, FOLDER), "step")
        assert k == 4 or before.columns == docs.columns
        steps.append(before)
    rows = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in steps[:5]]
    sizes = list(map(len, rows))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0

    kept = {r.id for r in quality.judge(docs, labels).where("kept").collect()}
    assert sorted(i for i, _ in rows[1]) == sorted(i for i, _ in rows[0] if i in kept)
    for i, t in rows[0]:  # the base rules in plain Python
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
        again = {p for j in range(len(w) - 2) if seen[tuple(w[j:j + 3])] > 1 for p in range(j, j + 3)}
        assert i not in kept or (len(w) >= 50 and 100 * len(again) <= 50 * len(w))

    assert collections.Counter(i for i, _ in rows[2]) == brute_first(rows[1])

    words = [tuple(WORD.findall(t or "")) for _, t in rows[2]]
    want = {}
    for (i, t), w, spans in zip(rows[2], words, brute_spans(words, 35), strict=True):
        gone = {p for a, b in spans for p in range(a, b)}
        want[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if spans else t
    assert dict(rows[3]) == want and want != dict(rows[2])

    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[j:j + 5]) for j in range(len(w) - 4)}

    own = [x for t in items if (x := shingles(t))]
    assert sorted(i for i, _ in rows[4]) == sorted(i for i, t in rows[3] if not any(5 * len(x & s) >= 4 * len(x) for s in [shingles(t)] for x in own))

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    length = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows[4]}
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in steps[5].collect():
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    assert {i: sorted(p) for i, p in pieces.items()} == {i: [(k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))] for i, n in length.items()}
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) <= 1.1 * sum(length.values()) / 2048 + 1


def test_language_scores_in_plain_python(spark):
    """Scores from n-grams and weights, one at a time."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 60").collect()} | {-1: None, -2: "", -3: "12 ?!", -4: "É", -5: "a\tb\n1 23"}
    odd = spark.createDataFrame([(k, t, None) for k, t in texts.items() if k < 0], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs.where("doc_id < 60").unionByName(odd), model, keep=["doc_id"]).collect()}
    full, shift = (1 << 64) - 1, 64 - (model.terms.buckets.bit_length() - 1)
    for k, t in texts.items():
        if t is None or not any(c.isalpha() for c in t):
            assert got[k] == ("und", 0.0)
            continue
        line = [32 if c in " \t\n\x0b\x0c\r" else 48 if "0" <= c <= "9" else ord(c) for c in t.lower()]
        total, n = model.bias.copy(), 0
        sums = np.zeros_like(total)
        for size in range(1, model.terms.most + 1):
            for j in range(len(line) - size + 1):
                h = 0
                for m, c in enumerate(line[j:j + size], 1):
                    h = (h * 0x9E3779B97F4A7C15 + (c + m) * 0xC2B2AE3D27D4EB4F) & full
                h ^= h >> 29
                sums += model.weights[((h * 0xBF58476D1CE4E5B9) & full) >> shift]
                n += 1
        z = (total + sums / n) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[k][0] == model.languages[int(p.argmax())] and abs(got[k][1] - p.max()) < 1e-6


ODD = "doc_id long, text string, `odd name` struct<`a b`:int,`x-y`:array<struct<`c d`:string>>>, `dot.ted` map<string,struct<`e f`:int>>"


def test_odd_nested_names(spark):
    """Tables with fields of names that no type text can hold go through every operator that keeps the columns."""
    rng = random.Random(3)
    rows = [(k, sentence(rng, 80), (k, [("z",)]), {"m": (k,)}) for k in range(30)]
    rows += [(100 + k, rows[k][1], None, None) for k in range(5)]
    path = tempfile.mkdtemp(prefix="llm-tests-") + "/odd"
    spark.createDataFrame(rows, ODD).coalesce(2).write.parquet(path)
    docs = spark.read.parquet(path)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    outs = [quality.keep_good(docs, labels), phrases.remove_phrases(docs), suffixes.remove_substrings(docs), contamination.clean(docs, items), simhash.keep_first(docs), corpus_pipeline.simhash_near_dedup(spark, docs, FOLDER)]
    for out in outs:
        assert {"odd name", "dot.ted"} <= set(out.columns)
        for r in out.collect():
            assert r["odd name"] is None or (r["odd name"]["a b"], r["dot.ted"]["m"]["e f"]) == (r.doc_id, r.doc_id)
    assert outs[1].count() == len(rows) and outs[4].count() == outs[5].count() == 30


def test_ids_beyond_16_bits(spark):
    """A vocabulary of 70,000 words is written in 32 bits."""
    from tokenizers import models, pre_tokenizers

    made = Tokenizer(models.WordLevel({f"w{k}": k for k in range(70_000)} | {"?": 70_000}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    folder = tempfile.mkdtemp(prefix="llm-tests-")
    made.save(f"{folder}/own.json")
    docs = spark.createDataFrame([(1, "w69999 w3 w65536"), (2, "w65535 none")], "doc_id long, text string")
    manifest = tokenfiles.write_tokens(docs, f"{folder}/files", f"{folder}/own.json", end_id=2)
    assert manifest["bytes_per_id"] == 4
    assert tokenfiles.read_document(spark, f"{folder}/files", 1)[0].tolist() == [69999, 3, 65536, 2]
    assert tokenfiles.read_document(spark, f"{folder}/files", 2)[0].tolist() == [65535, 70_000, 2]
    with pytest.raises(OverflowError):
        tokens.as_bytes([65_536], 2)


def test_automata_decide(monkeypatch):
    """With hashes of four bits nearly every window is proposed; the automaton alone tells which passages recur."""
    rng = random.Random(2)
    words = [sentence(rng, 90).encode() for _ in range(6)]
    segments = [*words, b" ".join(words[0].split(b" ")[:60] + words[1].split(b" ")[20:80]), b" ".join(words[1].split(b" ")[30:70] + words[2].split(b" ")[:40]), words[3] + b" " + words[3]]
    counts = [len(s.split(b" ")) - 34 for s in segments]
    copies = [1, 1, 1, 1, 3, 1, 1, 1, 1]
    want = sorted((i, lo, hi) for i, lo, hi in phrases.find_phrases(35)([7] * 9, copies, segments, counts))
    spans = brute_spans([tuple(s.split(b" ")) for s in segments] + [tuple(segments[4].split(b" "))] * 2, 35)
    assert want == sorted((i, lo, hi) for i in range(9) for lo, hi in spans[i]) and want
    exact = phrases.run_hashes
    monkeypatch.setattr(phrases, "run_hashes", lambda codes, at, length: exact(codes, at, length) >> np.uint64(60))
    assert sorted(phrases.find_phrases(35)([7] * 9, copies, segments, counts)) == want

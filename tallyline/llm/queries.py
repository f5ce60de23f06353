"""The registered queries of the text operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import bytepairs, collocations, contamination, language, packing, phrases, quality, search, sharding, simhash, suffixes, tokenfiles, urls
from .common import ROW, with_row_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def removed():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


@query("op5_suffix_array_dedup", r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, md5(b[i:i + 399]) AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM b)),
r AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
e AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS opens FROM r),
g AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
p AS (SELECT doc_id, run, min(i) AS first, max(i) + 399 AS last FROM g GROUP BY 1, 2),
q AS (SELECT doc_id, run, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY run), 0) AS before FROM p),
k AS (SELECT doc_id, sum(last - first + 1) AS n_removed, count(*) AS n_spans, max(last) AS tail, string_agg(hex(b[before + 1:first - 1]), '' ORDER BY run) AS head FROM q JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, n_spans IS NOT NULL AS repeats,
 sha256(CASE WHEN tail IS NULL THEN b ELSE unhex(head || hex(b[tail + 1:octet_length(b)])) END) AS kept_sha256 FROM b LEFT JOIN k USING (doc_id)""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    done = suffixes.remove_substrings(read(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed().alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("repeats"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_substring_dedup", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT x.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (c.p IS NULL) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    done = phrases.remove_phrases(read(spark, folder, "documents").select("doc_id", "text"))
    left = F.when(F.length("kept") == 0, 0).otherwise(F.length("kept") - F.length(F.translate("kept", " ", "")) + 1)
    return done.select("doc_id", (left + removed()).cast("long").alias("n_words"), removed().alias("n_removed"),
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op1_sharding")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(read(spark, folder, "documents"), 8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def url_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of each page: the label of the document whose number its path ends in, null without one."""
    bad = labels.groupBy(F.col("doc_id").alias("number")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    _, path = urls.split_url(F.col("url"))
    return pages.select("url", urls.document_number(path).alias("number")).join(bad, "number", "left").select("url", "bad")


@query("op3_url_filters")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Examples are the pages whose document has a label (bad: toxic or of low quality) and that no explicit rule decides."""
    pages, labels = read(spark, folder, "pages").select("page_id", "url"), read(spark, folder, "labels")
    examples = url_labels(pages, labels)
    judged = urls.judge(pages, examples, RULES)
    ids = with_row_key(pages.select("page_id", "url")).select(ROW, "page_id")
    return judged.join(ids, ROW).select("page_id", "host", "path", "rule", "verdict")


@query("op4_quality_rules")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return judged.select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", "score")


@query("op6_benchmark_decontamination", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
l AS (SELECT DISTINCT least(len(w), 5) AS k FROM b WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, l)),
t AS (SELECT DISTINCT item_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n FROM t GROUP BY 1),
c AS (SELECT doc_id, item_id, count(*) AS common FROM d JOIN t USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, common AS n_common, common / n AS containment FROM c JOIN n USING (item_id) WHERE 5 * common >= 4 * n""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = contamination.contained(docs, read(spark, folder, "benchmark"))
    ids = with_row_key(docs).select(ROW, "doc_id")
    return found.join(ids, ROW).select("doc_id", "item_id", F.col("n").alias("n_shingles"), F.col("common").alias("n_common"), "containment")


@query("op7_token_id_output")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "token-files")
    tokenfiles.write_tokens(read(spark, folder, "documents").select("doc_id", "text"), target, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfiles.read_tokens(spark, target).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(docs.where("not held_out"))
    return language.identify(docs, model, keep=["doc_id", "held_out"])


@query("op13_byte_level_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rules = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bytepairs.encode(read(spark, folder, "documents"), *rules)
    done = bytepairs.decode(encoded, *rules, keep=("doc_id", "ids"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


TERMS = "list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


@query("op12_ranked_lexical_search", f"""
WITH d AS (SELECT doc_id, {TERMS} AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts)) AS n_terms FROM d),
q AS (SELECT item_id, unnest(list_distinct({TERMS})) AS term FROM benchmark),
p AS (SELECT doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY 1),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + CAST((50 * n * n_docs) // n_terms AS BIGINT))) AS impact FROM p, c),
s AS (SELECT item_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


@query("op11_phrase_collocations", r"""
WITH s AS (SELECT coalesce(lang, 'und') AS lang, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(ps) AS piece FROM s)),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, w[i:i + k - 1] AS ph, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, ph, k, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
x AS (SELECT c.lang, c.ph, c.a, c.cut, l.f AS l, r.f AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM c JOIN t ON t.lang = c.lang
 JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:c.cut] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[c.cut + 1:c.k]),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
u AS (SELECT lang, k, f, ph, unnest(range(2, k)) AS m FROM f WHERE k > 2),
v AS (SELECT lang, ph[i:i + m - 1] AS ph, max(f) AS f FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM u) GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN v ON v.lang = b.lang AND v.ph = b.ph WHERE v.f IS NULL OR 100 * v.f < 100 * b.a),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM o)
SELECT * FROM z WHERE rank <= 2000""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(read(spark, folder, "documents"))

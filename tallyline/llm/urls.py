"""URL filters: explicit host and path rules, and association rules mined from labelled URLs.

Labelled URLs become transactions of tokens and, if bad, the item of the verdict. Spark's FP-growth finds
the frequent token combinations; rules that lead to the verdict are kept if support and confidence are
high enough and no rule with fewer of their tokens is as sure. A rule is indexed under one of its tokens, the one
fewest labelled URLs have; a URL looks up its tokens in that index and the rest of the rule is tested on the row.

Everything is DataFrame expressions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, stored, with_row_key

#: The item that marks a bad URL; tokens have a prefix before a colon, so none equals it.
BAD = "verdict"
#: Mined rules up to which their index is broadcast; each has a few tokens.
MOST_RULES = 50_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #`` (A-Z lower-cased), and from there up to ``? #``; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest explicit rule (verdict, host, path) that fits, as text, and its verdict; null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's. Longest is by the length of host and
    path together, then of the host, then the order given.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    name = verdict = F.lit(None).cast("string")
    for say, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, say).otherwise(verdict)
    return name, verdict


def document_number(path: Column) -> Column:
    """The number of the document a page is made from: its path's last segment, without an extension or a closing slash; null if that is no number."""
    return F.regexp_extract(path, r"/([0-9]{1,19})(?:\.[A-Za-z0-9]+)?/*$", 1).try_cast("long")


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, its parts between dashes, segments of the path (digits as 0, extension apart), keys of the query."""
    labels = F.split(host, r"\.")
    dashed = F.flatten(F.transform(labels, lambda x: F.when(F.contains(x, F.lit("-")), F.split(x, "-")).otherwise(F.array().cast("array<string>"))))
    segments = F.split(F.regexp_replace(F.lower(path), r"[0-9]+", "0"), r"[/.]")
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([A-Za-z0-9_]+)="), F.lit(1))
    def named(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    return F.array_distinct(F.concat(named("host", labels), named("part", dashed), named("path", segments), named("key", keys)))


def mine_rules(labelled: DataFrame, min_support: float, min_count: int, min_confidence: float) -> DataFrame:
    """(rule, tokens, anchor, confidence): pruned association rules from ``labelled`` (tokens array, bad boolean).

    ``min_support`` is the share, ``min_count`` the number of labelled URLs that hold the tokens and are bad, at least. No labelled rows give no rules.
    """
    items = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0)
    total = items.count()
    if total < min_count or not total:
        return labelled.sparkSession.createDataFrame([], "rule long, tokens array<string>, anchor string, confidence double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / total), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0] == BAD).select(F.sort_array("antecedent").alias("tokens"), "confidence")
    rules = stored(rules.select(F.xxhash64("tokens").alias("rule"), "tokens", "confidence"), "rules")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("anchor"), "freq")
    # a rule is needless if one with fewer of its tokens is at least as sure; the pairs meet under their tokens
    token = rules.select("rule", "tokens", "confidence", F.explode("tokens").alias("token"))
    part = rules.select(F.col("rule").alias("r"), F.col("tokens").alias("t"), F.col("confidence").alias("c"), F.col("tokens")[0].alias("token"))
    needless = token.join(part, "token").where((F.size("t") < F.size("tokens")) & (F.size(F.array_except("t", "tokens")) == 0) & (F.col("c") >= F.col("confidence")))
    kept = rules.join(needless.select("rule").distinct(), "rule", "left_anti")
    rarest = kept.select("rule", F.explode("tokens").alias("anchor")).join(counts, "anchor").groupBy("rule").agg(F.min_by("anchor", F.struct("freq", "anchor")).alias("anchor"))
    return kept.join(rarest, "rule").select("rule", "tokens", "anchor", "confidence")


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", min_support: float = 0.005,
          min_count: int = 20, min_confidence: float = 0.8, most_rules: int = MOST_RULES) -> DataFrame:
    """(row key, host, path, rule, verdict) of every row of ``pages``.

    ``labelled`` has ``url`` and ``bad`` (boolean; rows with null ``bad`` and those an explicit rule
    decides are left out, of the support's base too: mined rules only judge what no rule decides). Explicit ``rules`` decide first; else a URL is
    blocked if it holds all tokens of a mined rule. A null URL or one without ``://`` has empty host and path,
    no tokens, and is allowed unless a rule says otherwise. Equal URLs are judged alike; an empty table gives no rows.
    """
    lab_host, lab_path = split_url(F.col("url"))
    _, decided = matched_rule(lab_host, lab_path, rules)
    examples = labelled.where(F.col("bad").isNotNull() & decided.isNull()).select(url_tokens(F.col("url"), lab_host, lab_path).alias("tokens"), F.col("bad").cast("boolean").alias("bad"))
    mined = stored(mine_rules(examples, min_support, min_count, min_confidence), "url-rules")
    host, path = split_url(F.col("url"))
    rows = with_row_key(pages.select(F.col(f"`{url}`").alias("url"))).select(ROW, host.alias("host"), path.alias("path"), url_tokens(F.col("url"), host, path).alias("tokens"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(ROW, "host", "path", "tokens", name.alias("rule"), verdict.alias("said"))
    index = mined.select("anchor", F.col("tokens").alias("needed"))
    if mined.count() <= most_rules:
        index = F.broadcast(index)
    looked = rows.where("said is null").select(ROW, "tokens", F.explode("tokens").alias("anchor")).join(index, "anchor")
    hit = looked.where(F.size(F.array_except("needed", "tokens")) == 0).select(ROW).distinct().withColumn("bad", F.lit(True))
    final = rows.join(hit, ROW, "left")
    return final.select(ROW, "host", "path", "rule", F.coalesce("said", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))

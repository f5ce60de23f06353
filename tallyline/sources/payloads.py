"""Turning landed portal payloads into tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules, text as X
from ..functions.joins import lookup_join
from ..operators import catalog as K
from ..operators.dedupe import first_k_per
from ..operators.incidents import tally

ITEM = "resource struct<id:string,name:string,description:string>, title string, name string, description string, identifier string, id string"


def normalise_catalog(df: DataFrame, payload: str = "payload", domain: str = "domain") -> DataFrame:
    """Catalog rows (dataset_id, name, description, url) from listing payloads of any known shape.

    A payload is ``{results: [...]}``, ``{dataset: [...]}``, one item, or a bare
    list; an item is flat or nested under ``resource``. Items with neither id nor name
    (error objects, unreadable text) are no datasets.
    """
    text = F.col(payload)
    item = f"struct<{', '.join(p.replace(' ', ':', 1) for p in ITEM.split(', '))}>"
    # a list is wrapped as results, so that every payload is parsed once, by one schema
    whole = F.when(F.ltrim(text).startswith("["), F.concat(F.lit('{"results":'), text, F.lit("}"))).otherwise(text)
    parsed = df.select(*[c for c in df.columns if c != payload], F.from_json(whole, f"results array<{item}>, dataset array<{item}>, {ITEM}").alias("_p"))
    single = F.array(F.struct(*[F.col(f"_p.{x.split(' ', 1)[0]}") for x in re.split(r", (?=\w+ )", ITEM)]))
    items = F.coalesce("_p.results", "_p.dataset", single)
    rows = parsed.select(*[c for c in parsed.columns if c != "_p"], F.explode(items).alias("i"))
    nested = F.col("i.resource").isNotNull()

    def pick(inside: str, first: str, second: str) -> Column:
        return F.coalesce(F.when(nested, F.col(f"i.resource.{inside}")).otherwise(F.coalesce(f"i.{first}", f"i.{second}")), F.lit(""))

    ident = pick("id", "identifier", "id")
    site = F.concat(F.lit("https://"), domain)
    named = pick("name", "title", "name")
    return rows.filter((ident != "") | (named != "")).select(
        *[c for c in rows.columns if c != "i"], ident.alias("dataset_id"), named.alias("name"),
        pick("description", "description", "description").alias("description"),
        F.when(ident == "", site).otherwise(F.concat(site, F.lit("/d/"), ident)).alias("url"))


def enrich_record(df: DataFrame, terms: list[str] = rules.COORDINATE_TERMS_SAMPLE) -> DataFrame:
    """Per dataset: original and all columns, whether it has coordinates and which columns hold them."""
    own = F.col("columns")
    everything = F.concat(own, F.array(F.lit("source_city"), F.lit("source_url"), F.lit("dataset_name")))
    out = df.withColumns({"original_columns": own, "columns": everything})
    return K.coordinate_columns(K.has_coordinates(out, terms)).withColumnRenamed("columns", "all_columns")


def flatten_points(df: DataFrame, payload: str = "payload", source: str = "SpotCrime") -> DataFrame:
    """One row per entry of ``crimes``, under the collected names; keeps the other columns as tags."""
    entry = "struct<date:string,type:string,address:string,lat:double,lon:double,cdid:string,link:string>"
    rows = df.select(*[c for c in df.columns if c != payload],
                     F.explode(F.from_json(F.col(payload), f"crimes array<{entry}>")["crimes"]).alias("c"))
    return rows.select(*[c for c in rows.columns if c != "c"], F.lit(source).alias("source"), "c.date", "c.type", "c.address",
                       F.col("c.lat").alias("latitude"), F.col("c.lon").alias("longitude"), F.col("c.cdid").alias("description"), "c.link")


def with_records(df: DataFrame, record: str, payload: str = "payload", source: str = "Police Data Initiative") -> DataFrame:
    """Payload lists kept nested, as ``records`` beside their provenance; ``record`` is the entry's DDL type."""
    return df.select(*[c for c in df.columns if c != payload], F.lit(source).alias("source"),
                     F.from_json(F.col(payload), f"array<{record}>").alias("records"))


def explode_records(nested: DataFrame) -> DataFrame:
    """One row per record with its provenance; a source without records keeps one row."""
    return nested.select(*[c for c in nested.columns if c != "records"], F.explode_outer("records").alias("record"))


def endpoint_rows(df: DataFrame, source: str = "FBI NIBRS") -> DataFrame:
    """(source, ori, endpoint, kind, data) from landed (ori, endpoint, payload); payloads of any shape."""
    return df.select(F.lit(source).alias("source"), "ori", "endpoint", X.last_but(F.col("endpoint"), 2).alias("kind"),
                     F.try_parse_json("payload").alias("data"))


def collect_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources in one table over the merged columns; every row appears once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tag_place(df: DataFrame, city: Column, state: Column) -> DataFrame:
    return df.withColumns({"city": city, "state": state})


def count_by_source(df: DataFrame) -> DataFrame:
    return tally(df, ["source"])


def add_provenance(df: DataFrame, domain: Column, link: Column, name: Column) -> DataFrame:
    """``source_city`` is the second dot-separated part of the domain."""
    return df.withColumns({"source_city": F.try_element_at(F.split(domain, r"\."), F.lit(2)), "source_url": link, "dataset_name": name})


def balanced(df: DataFrame, max_per: int, order_by: list[str] = ["dataset_id"], domain: str = "domain") -> DataFrame:
    """At most ``max_per`` datasets per domain, in catalog order."""
    return first_k_per(df, domain, max_per, order_by)


def cap_records(df: DataFrame, per_dataset: int, order_by: list[str] = ["position"], dataset: str = "dataset_id") -> DataFrame:
    """At most ``per_dataset`` rows of each dataset."""
    return first_k_per(df, dataset, per_dataset, order_by)


def not_landed(catalog: DataFrame, landed: DataFrame, force: bool = False, key: str = "dataset_id") -> DataFrame:
    """Datasets still to be fetched; ``force`` asks for all."""
    return catalog if force else catalog.join(landed.select(key).distinct(), key, "left_anti")


def city_subset(cities: DataFrame, names: list[str] | None = None, first: int | None = None,
                order_by: list[str] = ["position"]) -> DataFrame:
    """The listed cities, else the first few in order, else all."""
    if names is not None:
        return cities.filter(F.col("city").isin(names))
    return cities.orderBy(*order_by).limit(first) if first is not None else cities


def attach_city(df: DataFrame, cities: DataFrame) -> DataFrame:
    """State and population of the city.

    Cities of one name are told apart by the state where ``df`` has one; else the most populous (then the first by state) counts,
    so that no row is multiplied.
    """
    on = ["city", "state"] if "state" in df.columns else ["city"]
    known = cities.select("city", "state", "population")
    best = known.groupBy(*on).agg(F.max_by(F.struct("state", "population"), F.struct(F.coalesce("population", F.lit(-1)), F.col("state").isNull())).alias("_at")) \
        if len(on) == 2 else known.groupBy("city").agg(F.min(F.struct((-F.coalesce(F.col("population").cast("double"), F.lit(-1.0))).alias("p"), "state", "population")).alias("_at"))
    joined = lookup_join(df, best, on)
    found = {"population": F.col("_at.population")} | ({} if len(on) == 2 else {"state": F.col("_at.state")})
    return joined.withColumns(found).drop("_at")

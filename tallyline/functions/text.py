"""String expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def contains_any(text: Column, words: list[str]) -> Column:
    """True when a word is a substring of the lower-cased text; a null text contains nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return any_of([low.contains(w.lower()) for w in words])


def any_element_contains(names: Column, words: list[str]) -> Column:
    """True when any element of a string array contains any of the words (case-insensitive)."""
    return F.coalesce(F.exists(names, lambda c: contains_any(c, words)), F.lit(False))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters and lower-case the others."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def safe_name(name: Column, length: int = 50) -> Column:
    """A file-safe dataset name: blanks and slashes to underscores, no parentheses, cut to ``length``."""
    return F.substring(F.translate(name, " /()", "__"), 1, length)


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def percent_text(value: Column) -> Column:
    """One decimal and a percent sign, ties to even."""
    return F.format_string("%.1f%%", F.bround(value.cast("double"), 1))


def yes_no(flag: Column) -> Column:
    return F.when(flag, F.lit("Yes")).otherwise(F.lit("No"))


def first_matching_category(text: Column, categories: dict[str, list[str]],
                            missing: str = "UNKNOWN", other: str = "OTHER") -> Column:
    """The first category (in dict order) one of whose keywords occurs in the text."""
    low = F.lower(text)
    out = F.when(text.isNull(), F.lit(missing))
    for name, words in categories.items():
        out = out.when(any_of([low.contains(w) for w in words]), F.lit(name))
    return out.otherwise(F.lit(other))


def last_but(path: Column, back: int, separator: str = "/") -> Column:
    """The path segment ``back`` places from the end (1 = last)."""
    return F.try_element_at(F.split(path, separator), F.lit(-back))

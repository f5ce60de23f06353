"""Joins against looked-up tables, and other small pieces of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 1024


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join ``table`` (unique on ``on``) to ``df``.

    Spark chooses the join: it broadcasts the table where its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and else shuffles, splitting hot keys. Rows whose key is null match
    nothing; in a left join they are spread over salts instead of meeting in one task. Other columns may have any type.
    """
    if how != "left":
        return df.join(table, on, how)
    null_key = F.col(on[0]).isNull()
    for name in on[1:]:
        null_key = null_key | F.col(name).isNull()
    salt = F.when(null_key, F.floor(F.rand(0) * SALTS) + 1).otherwise(F.lit(0))
    left = df.withColumn("_salt", salt.cast("int"))
    return left.join(table.withColumn("_salt", F.lit(0)), [*on, "_salt"], "left").drop("_salt")


def few_rows_join(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a table that has at most one row per partition of ``df``, which bounds what is broadcast."""
    return df.join(F.broadcast(table), on, "left")


def one_row(df: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery, for use inside expressions."""
    return df.select(F.struct(*df.columns).alias("v")).scalar()


def repeat_rows(df: DataFrame, n: str, number: str, chunk: int = 10_000) -> DataFrame:
    """Every row ``n`` times, numbered from 1; long repeats are made chunk by chunk."""
    chunks = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / chunk).cast("bigint"))))
    low = F.col("_c") * chunk + 1
    return chunks.withColumn(number, F.explode(F.sequence(low, F.least(F.col(n).cast("bigint"), low + chunk - 1)))).drop("_c")


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once for each row, however many later steps read them.

    Filters are not pushed below a generator and its output is not inlined, so a costly expression stands in the plan once.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, as a lambda variable."""
    return F.get(F.transform(F.array(value), use), 0)


#: Rows that meet in a task of ``spread_by``.
TASK_ROWS = 250_000


def spread_by(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Shuffle by ``keys`` into as many tasks as ``rows`` need, so that what a task sorts does not grow with the table."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)

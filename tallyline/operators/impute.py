"""Filling missing values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.joins import lookup_join, one_row
from ..session import cut_lineage, ship_package


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def impute_mode(df: DataFrame, columns: list[str] = ["hour", "day_of_week"], by: str = "crime_type") -> DataFrame:
    """The most frequent value of the row's group; the smallest on ties.

    Meant for columns of few values (hours, weekdays). Rows without a group, and
    groups without a value, stay missing.
    """
    modes = df.filter(F.col(by).isNotNull()).groupBy(by).agg(*[F.mode(c, True).alias(f"_mode_{c}") for c in columns])
    joined = lookup_join(df, modes, [by])
    return joined.withColumns({c: F.coalesce(c, f"_mode_{c}") for c in columns}).select(*df.columns)


def impute_rate(df: DataFrame, column: str = "arrest_made", by: str = "crime_category", row_key: list[str] = ["incident_id"],
                seed: int = 0) -> DataFrame:
    """Missing flags drawn with the group's rate of true.

    The draw is a digest of the row key, so a retried or repartitioned task draws the same.
    """
    rates = df.groupBy(by).agg(F.avg(F.col(column).cast("int")).alias("_rate"))
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in row_key], F.lit(str(seed))).cast("binary"))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    joined = lookup_join(df, rates, [by])
    return joined.withColumn(column, F.coalesce(F.col(column), draw < F.col("_rate"))).select(*df.columns)


def impute_mean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Column means for all numeric columns, as doubles; NaN counts as missing."""
    columns = numeric_columns(df) if columns is None else columns
    number = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns}
    means = one_row(df.agg(*[F.avg(x).alias(c) for c, x in number.items()]))
    return df.withColumns({c: F.coalesce(x, means[c]) for c, x in number.items()})


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether a row's group differs from that of the row before it; true for the first row."""
    out = np.zeros(batch.num_rows, bool)
    out[:1] = True
    for name in names:
        c = batch.column(batch.schema.get_field_index(name))
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        one_null = pc.not_equal(pc.is_null(a), pc.is_null(b))
        out[1:] |= pc.or_(differ, one_null).to_numpy(zero_copy_only=False)
    return out


def _filled(batch: pa.RecordBatch, groups: list[str], columns: list[str]) -> pa.RecordBatch:
    """Each missing value replaced by the last one before it in its group."""
    place = np.arange(batch.num_rows)
    head = np.maximum.accumulate(np.where(_changes(batch, groups), place, 0))
    out = []
    for name, c in zip(batch.schema.names, batch.columns, strict=True):
        if name in columns:
            last = np.maximum.accumulate(np.where(c.is_valid().to_numpy(zero_copy_only=False), place, -1))
            c = c.take(pa.array(last, mask=last < head))
        out.append(c)
    return pa.RecordBatch.from_arrays(out, schema=batch.schema)


def _joined(a: pa.RecordBatch | None, b: pa.RecordBatch) -> pa.RecordBatch:
    return b if a is None else pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]


def forward_fill(df: DataFrame, order_by: list[str], columns: list[str] | None = None,
                 partition_by: list[str] = []) -> DataFrame:
    """The last value before a missing one, in order, within ``partition_by``.

    Rows are range-partitioned over (partition_by, order_by) and written to the
    checkpoint folder, so even one single group is spread over many tasks. They stay where they are:
    each partition is filled in Arrow batches, the last row being carried from batch to batch. What a partition lacks at its
    head comes from the last rows of the partitions before it, one row each.
    """
    columns = [c for c in df.columns if c not in (*order_by, *partition_by)] if columns is None else columns
    place = [*partition_by, *order_by]
    rows = cut_lineage(df.repartitionByRange(*place).sortWithinPartitions(*place))
    kept = [*partition_by, *columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row and the filled last row of the partition."""
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = batch.slice(0, 1) if first is None else first
                done = _filled(_joined(last, batch), partition_by, columns)
                last = done.slice(done.num_rows - 1)
        if last is not None:
            two = _joined(first, last)
            pid = pa.array([TaskContext.get().partitionId()] * 2)
            yield pa.RecordBatch.from_arrays([pid, pa.array([False, True]), *two.columns], ["_pid", "_end", *two.schema.names])

    summary = rows.select(*kept).mapInArrow(ends, f"_pid long, _end boolean, {kinds}").orderBy("_pid", "_end").toArrow().combine_chunks()
    carry: dict[int, pa.RecordBatch] = {}      # two rows per partition, so as bounded as the partitions
    before = None
    for i in range(0, summary.num_rows, 2):
        first, last = (summary.slice(j, 1).drop_columns(["_pid", "_end"]).to_batches()[0] for j in (i, i + 1))
        if before is not None:
            carry[summary.column("_pid")[i].as_py()] = before
        joined = last if before is None or _changes(_joined(before, first), partition_by)[1] or _changes(_joined(first, last), partition_by)[1] else _joined(before, last)
        done = _filled(joined, partition_by, columns)
        before = done.slice(done.num_rows - 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = carry.get(TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                done = batch.select(kept)
                done = _filled(_joined(None if last is None else last.cast(done.schema), done), partition_by, columns)
                done = done.slice(done.num_rows - batch.num_rows)
                last = done.slice(done.num_rows - 1)
                yield pa.RecordBatch.from_arrays([done.column(kept.index(n)) if n in columns else c for n, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    ship_package(df.sparkSession)
    return rows.mapInArrow(fill, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))


def impute(df: DataFrame, method: str = "smart", **options) -> DataFrame:
    """smart, knn, forward_fill or mean; any other method leaves the table unchanged."""
    if method == "smart":
        return smart(df, **options)
    if method == "knn":
        from .neighbours import impute_knn
        return impute_knn(df, **options)
    if method == "forward_fill":
        return forward_fill(df, **options)
    if method == "mean":
        return impute_mean(df, **options)
    return df


def smart(df: DataFrame, row_key: list[str] = ["incident_id"], seed: int = 0) -> DataFrame:
    """Hour and weekday by the mode of the type, arrest flag by the rate of the category, where present."""
    present = [c for c in ("hour", "day_of_week") if c in df.columns]
    if present:
        df = impute_mode(df, present)
    if "arrest_made" in df.columns and "crime_category" in df.columns:
        df = impute_rate(df, row_key=row_key, seed=seed)
    return df

"""Helpers shared by the text operators: row keys, stored steps, and byte-level views of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import scratch_path, ship_package

ROW = "_row"

#: The white space of the word definition ``[^\x20\x09-\x0D]+``; ``bytes.split()`` uses the same set.
SPACES = b" \t\n\r\x0b\x0c"
WORD_GAP = "[\\x20\\x09-\\x0D]+"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

U64 = np.uint64


SPLITS = "spark.sql.files.minPartitionNum"


def fix_splits(spark: SparkSession) -> None:
    """Fix the number that file splits are sized by, once per session, so that executors that leave or join do not change a later scan's splits.

    Without a value Spark takes the cores registered when each plan starts.
    """
    if spark.conf.get(SPLITS, None) is None:
        spark.conf.set(SPLITS, str(int(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)))


def with_row_key(df: DataFrame, name: str = ROW) -> DataFrame:
    """Give each row its own long key.

    The key is the place in the scan, so the input has to be one that Spark reads alike each time: a table,
    a stored step or a checkpoint, under the same split sizes (``fix_splits``). Rows with equal or null ids stay apart.
    """
    fix_splits(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


def packed(df: DataFrame) -> DataFrame:
    """(row, doc): the row key (see ``with_row_key``) and all columns in one struct, so that no name can clash."""
    fix_splits(df.sparkSession)
    return df.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and go on from the files.

    Lost executors then re-read the files. The collector is called so that the context cleaner
    can drop the shuffle files of the job just done.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete the files of stored steps once all that reads them is stored itself."""
    for step in steps:
        system, path = file_system(step.sparkSession, step._stored_at)
        system.delete(path, True)


BATCH_BYTES, DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def below(hashed, share: float):
    """Whether a 64-bit hash lies in the lowest ``share`` of all hashes."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(hashed, 1) < F.lit(int(share * 2.0**63))


def hash_below(column, share: float):
    """Whether the 64-bit hash of a column lies in the lowest ``share`` of all hashes: a sample that depends on the values only."""
    return below(F.xxhash64(column), share)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` after sending the package to the executors.

    Batches of whole texts are held by the JVM and the worker at once, so a session without an own limit gets one of 8 MB.
    """
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == DEFAULT_BYTES:
        conf.set(BATCH_BYTES, "8388608b")
    if any("." in c for c in df.columns):  # mapInArrow takes a dot for a step into a field
        names, plain = df.columns, df.toDF(*[f"c{k}" for k in range(len(df.columns))])
        return plain.mapInArrow(lambda batches: fn(pa.RecordBatch.from_arrays(b.columns, names) for b in batches), schema)
    return df.mapInArrow(fn, schema)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(wide) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row its first word's number (one more entry at the end)."""
    solid = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a row begins or ends here
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:len(data)]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:len(data)]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


# --- polynomial hashes modulo 2^64 -------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = int(_rng.integers(2**62, 2**63)) | 5
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of the base and of its inverse, modulo 2^64."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """``H`` with ``H[i]`` the polynomial of the first ``i`` codes."""
    up, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:len(codes)], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that any bits of the result can serve as an order."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    h = prefix_hash(BYTE_CODES[data])
    _, down = powers(len(data))
    return mixed((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def file_system(spark: SparkSession, path: str):
    """Spark's file system of a path and the path as it names it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

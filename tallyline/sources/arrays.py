"""Large files that hold one JSON array, read by many tasks.

A file is cut into byte ranges of equal size. Whether a cut lies in a string and how deep it is nested depends on all bytes before it, so a first pass
gives, for each range, what it does to every state it may start in; these few numbers are put together in order. A second pass then
reads each range from a known state: a record belongs to the range its opening brace lies in, and is read on into the next ranges to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import ship_package

RANGE_BYTES, READ_BYTES = 64 << 20, 1 << 20
#: Bytes that a task reads at least where ranges are smaller, and the first read beyond the end of a range.
TASK_BYTES, TAIL_BYTES = 16 << 20, 4 << 10
QUOTE, ESCAPE, OPEN, CLOSE = 34, 92, (91, 123), (93, 125)
STEPS = np.zeros(256, np.int8)
STEPS[list(OPEN)], STEPS[list(CLOSE)] = 1, -1


def _open(path: str):
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def structure(data: np.ndarray, in_string: bool, escaped: bool) -> tuple[np.ndarray, bool, bool]:
    """The step of depth at each byte (1, -1 or 0), and the state after the last byte: in a string, and whether the next byte is escaped."""
    slash, quote = np.flatnonzero(data == ESCAPE), np.flatnonzero(data == QUOTE)
    after = False if len(data) else escaped
    free = np.ones(len(quote), bool)
    if len(slash):
        head = np.concatenate([[True], np.diff(slash) > 1])
        first = slash[np.maximum.accumulate(np.where(head, np.arange(len(slash)), 0))]
        run = slash - first + 1  # backslashes up to and with this one
        if escaped:
            run[first == 0] -= 1  # the first one is escaped itself
        at = np.minimum(np.searchsorted(slash, quote - 1), len(slash) - 1)
        free = (slash[at] != quote - 1) | (run[at] % 2 == 0)
        after = bool(slash[-1] == len(data) - 1 and run[-1] % 2 == 1)
    if escaped and len(quote) and quote[0] == 0:
        free[0] = False
    turns = np.zeros(len(data), np.uint8)
    turns[quote[free]] = 1
    inside = (np.cumsum(turns, dtype=np.uint8) + np.uint8(in_string)) % 2 == 1  # only the last bit of the count matters
    step = STEPS[data]
    step[inside] = 0
    return step, bool(inside[-1]) if len(data) else in_string, after


STATES = [(False, False), (True, False), (True, True)]


class Opened:
    """The file of the last range, kept open for the next range of the same task."""

    def __init__(self):
        self.path, self.file = None, None

    def of(self, path: str):
        if path != self.path:
            self.close()
            self.path, self.file = path, _open(path)
        return self.file

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.path, self.file = None, None


def _blocks(f, start: int, end: int) -> Iterator[np.ndarray]:
    for at in range(start, end, READ_BYTES):
        yield np.frombuffer(f.read_at(min(READ_BYTES, end - at), at), np.uint8)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, state, depth, after): what a range does from each of the three states it may start in."""
    opened = Opened()
    for batch in batches:
        out = []
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = [(s, 0) for s in STATES]
            for data in _blocks(opened.of(path), start, end):
                done = [(structure(data, *s), d) for s, d in now]
                now = [((inside, escaped), d + int(step.sum())) for (step, inside, escaped), d in done]
            out += [(path, start, k, d, STATES.index(s if s[0] else (False, False))) for k, (s, d) in enumerate(now)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.string(), *[pa.int64()] * 4)],
                                         ["path", "start", "state", "depth", "after"])
    opened.close()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, record): the texts of the objects that open at depth one in a range whose first state is known."""
    opened, found, held_bytes = Opened(), [], 0
    for batch in batches:
        for path, start, end, state, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found and (path != found[0][0] or held_bytes > 8 * READ_BYTES):
                yield _texts(found)
                found, held_bytes = [], 0
            f = opened.of(path)
            size, at, held, tail = f.size(), start, None, TAIL_BYTES
            now = STATES[state]
            while at < size and (at < end or held is not None):
                if at < end:
                    data = np.frombuffer(f.read_at(min(READ_BYTES, end - at), at), np.uint8)
                else:  # only the rest of one record is wanted: little by little
                    data = np.frombuffer(f.read_at(min(tail, READ_BYTES, size - at), at), np.uint8)
                    tail *= 2
                step, *now = structure(data, *now)
                level = depth + np.cumsum(step)
                begins = np.flatnonzero((step == 1) & (level == 2) & (data == OPEN[1])) if at < end else np.zeros(0, np.int64)
                ends = np.flatnonzero((step == -1) & (level == 1) & (data == CLOSE[1]))
                raw, cut = data.tobytes(), 0
                if held is not None:
                    if len(ends):
                        held.append(raw[:ends[0] + 1])
                        found.append((path, b"".join(held)))
                        held, ends = None, ends[1:]
                    else:
                        held.append(raw)
                elif len(ends) and (not len(begins) or ends[0] < begins[0]):
                    ends = ends[1:]  # the end of a record of the range before
                for cut, begin in enumerate(begins.tolist()):
                    if cut < len(ends):
                        found.append((path, raw[begin:ends[cut] + 1]))
                    else:
                        held = [raw[begin:]]
                depth = int(level[-1]) if len(level) else depth
                at += len(data)
                held_bytes += len(data)
                if held_bytes > 8 * READ_BYTES:
                    yield _texts(found)
                    found, held_bytes = [], 0
            if held is not None:
                found.append((path, b"".join(held)))  # a file that breaks off: the text cannot be read and gives nulls
    opened.close()
    yield _texts(found)


def _texts(found: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([x.decode("utf-8", "replace") for _, x in found], pa.string())], ["path", "record"])


def _dealt(spark: SparkSession, ranges: list[tuple], range_bytes: int, schema: str) -> DataFrame:
    """The ranges over tasks: one for each where ranges are large, else consecutive ones together, up to ``TASK_BYTES`` and at least four tasks a core."""
    together = max(1, min(TASK_BYTES // range_bytes, len(ranges) // (4 * spark.sparkContext.defaultParallelism)))
    return spark.createDataFrame(spark.sparkContext.parallelize(ranges, -(-len(ranges) // together)), schema)


def read_array_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, record): the JSON text of every object of the arrays in the files under ``path``, in any order.

    Elements that are no objects are left out. Executors open the files through Arrow (local, HDFS, S3 or GS addresses).
    """
    ship_package(spark)
    listed = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]      # names and sizes only
    ranges = [(p, a, min(a + range_bytes, n)) for p, n in listed for a in range(0, n, range_bytes)]
    if not ranges:
        return spark.createDataFrame([], "path string, record string")
    table = _dealt(spark, ranges, range_bytes, "path string, start long, end long")
    known = {(r.path, r.start, r.state): (r.depth, r.after) for r in table.mapInArrow(_effects, "path string, start long, state long, depth long, after long").collect()}
    started, last, state, depth = [], None, 0, 0
    for p, a, b in ranges:      # three numbers for each range
        if p != last:
            last, state, depth = p, 0, 0
        started.append((p, a, b, state, depth))
        d, state = known[p, a, state]
        depth += d
    return _dealt(spark, started, range_bytes, "path string, start long, end long, state long, depth long").mapInArrow(_records, "path string, record string")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The objects of large JSON arrays as rows of ``schema``; a missing key or an unreadable record gives nulls."""
    return read_array_texts(spark, path, range_bytes).select(F.from_json("record", schema).alias("r")).select("r.*")

"""Token-id files: one zstandard frame per document, compressed with a dictionary all files share.

A file holds documents in ascending id order::

    magic "TLTK0001" | frames of the documents, back to back | index | footer
    index:  per document int64 id, uint8 id-is-null, int64 byte place of its frame, int64 number of ids
    footer: int64 place of the index, int64 documents, uint8 bytes per id (2 or 4), 32 bytes SHA-256 of the dictionary, magic

A frame is the little-endian ids of one document (16-bit where the vocabulary allows). The dictionary is trained on
serialized id arrays and kept once beside the files under its SHA-256, so a reader finds the right one and reads
a short document by one ranged read. Files get the name of the task attempt that wrote them; the manifest names those that
count, so what a lost or repeated attempt leaves is never read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import file_system, hash_below, map_arrow
from .tokens import encoder, largest_id

MAGIC = b"TLTK0001"
FOOTER = struct.Struct("<qqB32s8s")
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("place", "<i8"), ("count", "<i8")])


@lru_cache(maxsize=8)
def _system(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The Arrow file system of a folder (local, HDFS, S3 or GS by its URI) and the folder's path there."""
    if folder.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" in folder:
        return arrow_fs.FileSystem.from_uri(folder)
    return arrow_fs.LocalFileSystem(), folder


def write_bytes(folder: str, name: str, data: bytes) -> None:
    system, path = _system(folder)
    with system.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def read_bytes(folder: str, name: str) -> bytes:
    system, path = _system(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return f.read()


class Writer:
    """Writes one file; documents come in ascending id order."""

    def __init__(self, folder: str, name: str, dictionary: bytes, width: int, level: int = 3):
        system, path = _system(folder)
        self.name, self.width = name, width
        self.digest = hashlib.sha256(dictionary).digest()
        self.out = system.open_output_stream(f"{path}/{name}")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True)
        self.out.write(MAGIC)
        self.at, self.index, self.ids = len(MAGIC), [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids`` are little-endian numbers of the file's width."""
        frame, count = self.compressor.compress(ids), len(ids) // self.width
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is None, self.at, count))
        self.at += len(frame)
        self.ids += count

    def close(self) -> None:
        self.out.write(np.array(self.index, INDEX).tobytes())
        self.out.write(FOOTER.pack(self.at, len(self.index), self.width, self.digest, MAGIC))
        self.out.close()


class Reader:
    """Reads a file: the whole in order, or single documents by ranged reads."""

    def __init__(self, folder: str, name: str):
        system, path = _system(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        self.index_at, count, self.width, digest, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        self.index = np.frombuffer(self.file.read_at(INDEX.itemsize * count, self.index_at), INDEX)
        dictionary = read_bytes(folder, f"{digest.hex()}.dict")
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError("the dictionary is not the one the file was written with")
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=shared)

    def _ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's ``k``-th document, by one ranged read."""
        end = self.index["place"][k + 1] if k + 1 < len(self.index) else self.index_at
        place = int(self.index["place"][k])
        return self._ids(self.file.read_at(int(end) - place, place))

    def find(self, doc_id: int) -> list[int]:
        """Places of an id in the file."""
        ids = self.index["id"]
        known = int(self.index["null"].sum())  # null ids come first
        lo, hi = (known + int(np.searchsorted(ids[known:], doc_id, side)) for side in ("left", "right"))
        return list(range(lo, hi))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, reading some MB at a time."""
        places = np.append(self.index["place"], self.index_at)
        k, n = 0, len(self.index)
        while k < n:
            j = max(k + 1, int(np.searchsorted(places, places[k] + (4 << 20), "right")) - 1)
            block = self.file.read_at(int(places[j] - places[k]), int(places[k]))
            for i in range(k, j):
                a = int(places[i] - places[k])
                doc = None if self.index["null"][i] else int(self.index["id"][i])
                yield doc, self._ids(block[a:a + int(places[i + 1] - places[i])])
            k = j

    def close(self) -> None:
        self.file.close()


def train_dictionary(docs: DataFrame, text: str, tokenizer: str, end_id: int, width: int, size: int, sample_rows: int, sample_chars: int) -> bytes:
    """A zstandard dictionary from at most ``sample_rows`` different texts of at most ``sample_chars`` characters, least text hash first.

    The bound is what makes one shared dictionary possible; it bears on the compression ratio only, never on what is stored.
    Where too little text is there to train on, the dictionary is empty and frames stand alone.
    """
    small = docs.select(F.col(f"`{text}`").alias("t")).where(F.length("t").between(1, sample_chars))
    share = 1.5 * sample_rows / max(1, small.count())  # few more than wanted leave the tasks, however many tasks there are
    rows = small.where(hash_below("t", share)).distinct().orderBy(F.xxhash64("t"), "t").limit(sample_rows).collect()
    enc, end = encoder(tokenizer, width), end_id.to_bytes(width, "little")
    samples = [enc.encode(r.t) + end for r in rows]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_column: str = "doc_id", text: str = "text", end_id: int = 2,
                 file_ids: int = 64_000_000, dictionary_bytes: int = 65_536, sample_rows: int = 2_000, sample_chars: int = 20_000, tasks: int | None = None) -> dict:
    """Write the ids of all texts to ``folder`` in ascending id order and return the manifest.

    A document is its ids and ``end_id``; a null text is empty, a null id comes first, rows of equal id stay apart next to each other (ordered by text).
    Ids have 16 bits where the tokenizer's largest and the end id fit, else 32.
    Files end at ``file_ids`` ids at the latest, between documents. The manifest lists, in order, each file with its
    documents, ids and bytes; it grows with the number of files only.
    """
    spark = docs.sparkSession
    system, path = file_system(spark, folder)
    system.mkdirs(path)
    folder = str(path.toString())
    width = 2 if max(largest_id(tokenizer), end_id) < 1 << 16 else 4
    dictionary = train_dictionary(docs, text, tokenizer, end_id, width, dictionary_bytes, sample_rows, sample_chars)
    digest = hashlib.sha256(dictionary).hexdigest()
    write_bytes(folder, f"{digest}.dict", dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, done, first = encoder(tokenizer, width), None, [], 0
        end = end_id.to_bytes(width, "little")
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(value.as_py()) + end
                if out is not None and out.ids + len(ids) // width > file_ids:
                    out.close()
                    done.append((out, first))
                    out = None
                if out is None:
                    out, first = Writer(folder, f"ids-{uuid.uuid4().hex}.tok", dictionary, width), doc
                out.add(doc, ids)
        if out is not None:
            out.close()
            done.append((out, first))
        part = current_partition()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(done), pa.int64()), pa.array(list(range(len(done))), pa.int64()), pa.array([w.name for w, _ in done], pa.string()),
             pa.array([len(w.index) for w, _ in done], pa.int64()), pa.array([w.ids for w, _ in done], pa.int64()), pa.array([w.at for w, _ in done], pa.int64())],
            ["part", "k", "name", "documents", "ids", "bytes"])

    slim = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    n = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = slim.repartitionByRange(n, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    files = map_arrow(dealt, run, "part long, k long, name string, documents long, ids long, bytes long").collect()
    files.sort(key=lambda r: (r.part, r.k))
    manifest = {"dictionary": digest, "end_id": end_id, "bytes_per_id": width, "files": [{k: r[k] for k in ("name", "documents", "ids", "bytes")} for r in files]}
    write_bytes(folder, "manifest.json", json.dumps(manifest).encode())
    return manifest


def current_partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of the manifest's files; start counts the ids of all documents before it."""
    _, path = file_system(spark, folder)
    folder = str(path.toString())
    manifest = json.loads(read_bytes(folder, "manifest.json"))
    before, rows = 0, []
    for f in manifest["files"]:
        rows.append((f["name"], before))
        before += f["ids"]
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("before", T.LongType())])
    files = spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(folder, name)
                out = []
                for doc, ids in reader.documents():
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 50_000:
                        yield digest_rows(out)
                        out = []
                reader.close()
                if out:
                    yield digest_rows(out)

    return map_arrow(files, run, "id long, start long, n_tokens long, ids_crc32 long")


def digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["id", "start", "n_tokens", "ids_crc32"])


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each, if several have the id), by the indexes of the files and ranged reads."""
    _, path = file_system(spark, folder)
    folder = str(path.toString())
    names = [f["name"] for f in json.loads(read_bytes(folder, "manifest.json"))["files"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                reader = Reader(folder, name)
                found = [reader.document(k).astype("<u4").tobytes() for k in reader.find(doc_id)]
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["ids"])

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return [np.frombuffer(r.ids, "<u4") for r in map_arrow(files, run, "ids binary").collect()]

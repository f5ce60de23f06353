"""Connected components of a link table by alternating star contractions, each round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, stored


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task reduced to (node, least node) stars, batch by batch, so links inside a task need no rounds."""
    for batch in batches:
        u, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[:len(u)], at[len(u):]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            nxt = root.copy()
            np.minimum.at(nxt, root[a], low)
            np.minimum.at(nxt, root[b], low)
            nxt = nxt[nxt]
            if np.array_equal(nxt, root):
                break
            root = nxt
        away = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[root[away]])], ["u", "v"])


def star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (u > v): every neighbour (larger ones, or smaller ones) is tied to the least neighbour."""
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = near.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots; ``links`` has long columns u and v, root is the least node.

    Links of a node to itself and repeated links change nothing. Works in O(log^2) rounds; a round shuffles the links,
    which never grow, and stops when a round leaves them as they were (their number and two independent 64-bit sums, which agree by chance once in 2^128).
    """
    ordered = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, state = stored(map_arrow(ordered, local_stars, "u long, v long").distinct(), "links"), None
    while True:
        hashed = [F.sum(F.xxhash64(*by).cast("decimal(38,0)")) for by in (("u", "v"), (F.lit(1), "v", "u"))]
        row = now.agg(F.count("*"), *hashed).first()
        if state == tuple(row) or row[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(row)
        now = stored(star(star(now, True), False), "links")

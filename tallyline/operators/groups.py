"""Connected components of a link table, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One contraction of links (u > v): the larger, or the smaller, neighbours of a node are tied to the least one."""
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    near = near.join(near.groupBy("u").agg(F.min("v").alias("least")), "u").withColumn("least", F.least("u", "least"))
    if large:
        tied = near.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        tied = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("l")).select("l.*")
    return tied.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots; ``links`` has columns u and v of one ordered type, the root is the least node of a component.

    Links to itself and repeated links change nothing. A round never adds links; the last one leaves stars,
    which is tested by their form: one root for each node, and no root below another.
    """
    ordered = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    while True:
        ordered = cut_lineage(_stars(_stars(ordered, True), False))
        twice = ordered.groupBy("u").count().filter("count > 1").select("u")
        below = ordered.select(F.col("v").alias("u")).distinct().join(ordered.select("u"), "u", "left_semi")
        if twice.unionByName(below).isEmpty():
            return ordered.select(F.col("u").alias("node"), F.col("v").alias("root"))

"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import workspace


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its greater neighbours to the least node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node links itself and its lesser neighbours to the least of them. Edges point down."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the undirected edges ``a, b``; comp is the least node of the component.

    Each round is written to the shared folder and read back. Only a count and a checksum come to the driver.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = workspace.materialise(now, "edges")
    mark = _mark(now)
    while mark[0]:
        now = workspace.materialise(_small(_large(now)), "edges")
        mark, before = _mark(now), mark
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)

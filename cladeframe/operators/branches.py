"""From a feature table and a tree to branch weights.

Totals come before the join with the tree: relative abundance divides by the total over all rows of a sample, taxa
that the tree lacks included. Branches of no length are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def totals(long: DataFrame) -> DataFrame:
    """``sample_id, total`` over all rows."""
    return long.groupBy("sample_id").agg(F.sum("value").alias("total"))


def relative(long: DataFrame) -> DataFrame:
    """Values divided by their sample's total; samples without a positive total go.

    Totals are combined on the map side and joined back, so a sample with many rows is not gathered in one task (as it
    would be by a window), and Spark broadcasts or splits the join by what it finds.
    """
    return long.join(totals(long).filter("total > 0"), "sample_id").select("sample_id", "feature_id", (F.col("value") / F.col("total")).alias("value"))


def presence(long: DataFrame) -> DataFrame:
    return long.filter("value > 0").select("sample_id", "feature_id", F.lit(1.0).alias("value")).distinct()


def equal_shares(long: DataFrame) -> DataFrame:
    """Presences that share a sample's mass evenly."""
    return relative(presence(long))


def observed_paths(paths: DataFrame, long: DataFrame) -> DataFrame:
    """Paths of the leaves that the table names."""
    return paths.join(long.select("feature_id").distinct(), "feature_id", "left_semi")


def unmatched(long: DataFrame, paths: DataFrame) -> DataFrame:
    """Taxa of the table that the tree lacks."""
    return long.select("feature_id").distinct().join(paths.select("feature_id").distinct(), "feature_id", "left_anti")


def require_match(long: DataFrame, paths: DataFrame) -> int:
    """The number of taxa that the tree lacks; an error if it has none of them."""
    taxa = long.select("feature_id").distinct()
    missing, every = unmatched(long, paths).count(), taxa.count()
    if missing == every:
        raise ValueError("no taxon of the table is a leaf of the tree")
    return missing


def branch_masses(long: DataFrame, paths: DataFrame, presence_only: bool = False) -> DataFrame:
    """``sample_id, edge_id, length, mass``: what lies below each branch (1 if anything does, for presence).

    The sum is combined on the map side before it is shuffled by sample and branch.
    """
    steps = long.filter("value > 0").join(paths.filter("length > 0"), "feature_id")
    mass = F.lit(1.0) if presence_only else F.sum("value")
    return steps.groupBy("sample_id", "edge_id").agg(F.max("length").alias("length"), F.max(mass).alias("mass") if presence_only else mass.alias("mass"))


def branch_weights(masses: DataFrame) -> DataFrame:
    """Adds ``weight``, length times mass."""
    return masses.withColumn("weight", F.col("length") * F.col("mass"))


def non_empty(samples: DataFrame, masses: DataFrame, least: int = 2) -> DataFrame:
    """Samples that have any branch; an error below ``least``."""
    kept = samples.join(masses.select("sample_id").distinct(), "sample_id", "left_semi")
    if (n := kept.limit(least).count()) < least:
        raise ValueError(f"{n} samples are left; at least {least} are needed")
    return kept


def baselines(weights: DataFrame) -> DataFrame:
    """``sample_id, total_weight``."""
    return weights.groupBy("sample_id").agg(F.sum("weight").alias("total_weight"))


def relevant_counts(weights: DataFrame, active: int) -> DataFrame:
    """Branches with weight in each sample, and their share of all active ones."""
    return weights.groupBy("sample_id").agg(F.count(F.lit(1)).alias("branches")).withColumn("share", F.col("branches") / F.lit(float(active)))


def caps(weights: DataFrame) -> DataFrame:
    """``edge_id, cap``: the greatest weight of each branch over samples."""
    return weights.groupBy("edge_id").agg(F.max("weight").alias("cap"))


def dense_ids(edges: DataFrame) -> DataFrame:
    """``edge_id, dense_id``: positions in ascending order of edge id, from 0. The edges fit a tree, not the data."""
    return edges.select("edge_id").distinct().select("edge_id", (F.row_number().over(Window.orderBy("edge_id")) - 1).alias("dense_id"))


def normalization_factors(relative_table: DataFrame, leaf_depth: DataFrame) -> DataFrame:
    """``sample_id, normalization_factor``: depth of each leaf times its share, summed. ``leaf_depth(feature_id, depth)``."""
    return relative_table.join(leaf_depth, "feature_id").groupBy("sample_id").agg(F.sum(F.col("depth") * F.col("value")).alias("normalization_factor"))


def total_length(edges: DataFrame) -> float:
    """Of all branches of positive length."""
    return edges.filter("length > 0").agg(F.sum("length")).first()[0] or 0.0

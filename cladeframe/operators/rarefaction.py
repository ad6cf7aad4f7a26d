"""Rarefaction without replacement, and the jackknife over it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators import clustering, trees
from cladeframe.operators.ordination import square_array
from cladeframe.operators.statistics import mean_distances
from cladeframe.session import materialise
from cladeframe.sources import newick


#: Of a sample's counts about WIDER * depth + SPARE pass the bound on the hash.
WIDER, SPARE = 2, 64


def minimum_depth(long: DataFrame) -> int:
    """The least sample total, rounded down; an error if that is 0."""
    depth = long.groupBy("sample_id").agg(F.sum("value").alias("t")).agg(F.min("t")).first()[0]
    if not depth or depth < 1:
        raise ValueError("a sample has no counts")
    return int(depth)


def rarefied(long: DataFrame, depth: int, seed: int = 42, replicates: int = 1) -> DataFrame:
    """``replicate, sample_id, feature_id, value``: ``depth`` counts of each sample drawn without replacement.

    Every count is a row with a hash; the first ``depth`` by hash are kept, which is an exact draw and the same in any
    engine. Samples below the depth go. A sample with many more counts is first cut by a bound on the hash, where the rows
    are made, that lets about ``2 * depth + 64`` through; a draw that the bound leaves too few is made again without it.
    For counts so large that rows of them cost too much, see :func:`drawn`.
    """
    enough = long.groupBy("sample_id").agg(F.sum(F.floor("value")).alias("t")).filter(F.col("t") >= depth)
    whole = materialise(long.filter("value >= 1").join(enough, "sample_id").select("sample_id", "feature_id", F.floor("value").cast("int").alias("n"), "t"), "counts")
    bound = F.least(F.lit(1.0), F.lit(float(WIDER * depth + SPARE)) / F.col("t")) * F.lit(2.0**32)

    def lots(rows: DataFrame) -> DataFrame:
        each = rows.select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"), "sample_id", "feature_id", "n", "t")
        each = each.select("replicate", "sample_id", "feature_id", "t", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
        return each.withColumn("lot", F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", "sample_id", "feature_id", "k")))

    early = F.conv(F.substring("lot", 1, 8), 16, 10).cast("double") < bound
    kept = materialise(lots(whole).filter(early).drop("t"), "lots")
    draws = kept.groupBy("replicate", "sample_id").count().filter(F.col("count") >= depth)
    every = enough.select("sample_id").crossJoin(long.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")))
    short = materialise(every.join(draws, ["replicate", "sample_id"], "left_anti"), "short")
    if not short.isEmpty():
        again = lots(whole.join(short.select("sample_id").distinct(), "sample_id", "left_semi")).join(short, ["replicate", "sample_id"], "left_semi")
        kept = kept.join(short, ["replicate", "sample_id"], "left_anti").unionByName(again.select(*kept.columns))
    first = F.row_number().over(Window.partitionBy("replicate", "sample_id").orderBy("lot", "feature_id", "k"))
    return kept.withColumn("r", first).filter(F.col("r") <= depth).groupBy("replicate", "sample_id", "feature_id").agg(F.count(F.lit(1)).cast("double").alias("value"))


def drawn(long: DataFrame, depth: int, seed: int = 42, replicates: int = 1) -> DataFrame:
    """The same distribution by one hypergeometric draw for each sample and replicate; counts stay counts."""
    whole = long.filter("value >= 1").select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"), F.col("sample_id").cast("string").alias("sample_id"), F.col("feature_id").cast("string").alias("feature_id"), F.floor("value").cast("long").alias("n"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature_id")
        n = pdf["n"].to_numpy()
        if n.sum() < depth:
            return pdf.head(0)[["replicate", "sample_id", "feature_id"]].assign(value=0.0)
        mark = [seed, int(key[0]), *key[1].encode()]
        took = np.random.default_rng(mark).multivariate_hypergeometric(n, depth, method="marginals")
        out = pdf[["replicate", "sample_id", "feature_id"]].assign(value=took.astype(float))
        return out[out["value"] > 0]

    return whole.groupBy("replicate", "sample_id").applyInPandas(one, "replicate int, sample_id string, feature_id string, value double")


#: The mean of all replicates, among them.
MEAN = -1


def jackknife(
    long: DataFrame, samples: DataFrame, distance: Callable[[DataFrame, DataFrame], DataFrame], depth: int | None = None,
    iterations: int = 50, seed: int = 42, tree: str = "upgma",
) -> tuple[DataFrame, str, DataFrame]:
    """Mean distances, the consensus tree with support (Newick), and the support of all splits.

    ``distance(table, samples)`` gets the tables of all replicates at once, told apart by a column ``replicate``, and gives
    ``replicate, sample_i, sample_j, distance`` (as :func:`engines.exact` does). Replicates are drawn, compared and
    clustered side by side, and the mean is clustered with them; a split is ``split, size, support`` by its name. Only the
    consensus tree, a row for each sample, comes to the driver. Neighbour joining (``tree="nj"``) is sequential and runs in
    one kernel for each replicate; its splits are arrays of leaves.
    """
    depth = depth or minimum_depth(long)
    tables = materialise(rarefied(long, depth, seed, iterations), "rarefied")
    every = materialise(distance(tables, samples), "replicates")
    mean = materialise(mean_distances(every), "mean")
    ids = [r[0] for r in samples.orderBy("sample_ordinal").select("sample_id").collect()]
    if tree == "nj":
        consensus = clustering.neighbour_joining(square_array(mean, ids), ids)
        supports = clustering.support(clustering.replicate_splits(every, "replicate", ids, tree=tree), "replicate")
        known = {tuple(r["split"]): r["support"] for r in supports.collect()}  # at most n splits for each replicate
        return mean, newick.write(consensus, clustering.annotate(consensus, known)), supports
    both = every.select("replicate", "sample_i", "sample_j", "distance").unionByName(mean.withColumn("replicate", F.lit(MEAN)))
    merges = trees.linkage(both, samples, ["replicate"])
    splits = trees.unrooted_splits(merges, len(ids), ["replicate"])
    supports = materialise(trees.support(splits.filter(F.col("replicate") != MEAN), iterations), "support")
    mine = merges.filter(F.col("replicate") == MEAN)
    return mean, annotated(mine, splits.filter(F.col("replicate") == MEAN), supports, ids), supports


def annotated(merges: DataFrame, splits: DataFrame, supports: DataFrame, ids: list[str]) -> str:
    """Newick text of one tree with its inner nodes' support: that of the split each makes, which has one of two names."""
    tree, names = trees.as_tree(merges.collect(), ids)  # a row for each sample
    known = {tuple(r["split"]): r["support"] for r in splits.join(supports, "split", "left").select("split", F.coalesce("support", F.lit(0.0)).alias("support")).collect()}
    a, b = names.get(0, (0, 0))
    found = {node: known.get(name, known.get((name[0] ^ a, name[1] ^ b))) for node, name in names.items()}
    return newick.write(tree, {node: f"{s:.3f}" for node, s in found.items() if s is not None})

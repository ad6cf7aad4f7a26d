"""The three engines' entry points: exact, sketched and earth mover's, over a feature table and a tree's paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators import branches as B
from cladeframe.operators import distances as D
from cladeframe.operators import sketches as H
from cladeframe.session import materialise


#: The column that tells the tables of replicates apart.
REPLICATE = "replicate"


@dataclass(frozen=True)
class Community:
    """A feature table, its sample order and the tree's paths.

    ``table(sample_id, feature_id, value)``; ``samples(sample_id, sample_ordinal)``; ``paths(feature_id, edge_id,
    length)`` with an edge for every branch above a leaf.
    """

    table: DataFrame
    samples: DataFrame
    paths: DataFrame


def masses(c: Community, weighted: bool, raw_counts: bool = False) -> DataFrame:
    """Branch masses: presence, shares of the sample's total (over all rows), or raw counts."""
    if not weighted:
        return B.branch_masses(B.presence(c.table), c.paths, presence_only=True)
    return B.branch_masses(c.table if raw_counts else B.relative(c.table), c.paths)


def exact(c: Community, metric: str = "unweighted", alpha: float = 0.5, raw_counts: bool = False, method: str = "blocked", tree_length: float | None = None) -> DataFrame:
    """``sample_i, sample_j, distance``. Samples without any branch stay, at distance 0 from each other and 1 from others (emd: the other's total).

    A table with a column ``replicate`` is compared replicate by replicate, in one job; the result has that column first.
    """
    by = [REPLICATE] if REPLICATE in c.table.columns else []
    if by:  # a replicate's sample is a sample of its own until the pairs are formed
        c = Community(c.table.withColumn("sample_id", F.struct(REPLICATE, "sample_id")).drop(REPLICATE), c.samples, c.paths)
    apart = lambda rows: rows.select("sample_id.*", *(x for x in rows.columns if x != "sample_id")) if by else rows
    m = apart(masses(c, metric != "unweighted", raw_counts))
    if method == "joined":
        if by:
            raise ValueError("the join form knows no replicates")
        if metric not in ("unweighted", "weighted"):
            raise ValueError("the join form knows unweighted and weighted")
        return D.joined(materialise(B.branch_weights(m), "weights"), c.samples, metric)
    totals = apart(B.totals(c.table)) if metric == "variance_adjusted" else None
    if metric == "generalized" and abs(alpha) < 1e-12 and tree_length is None:
        tree_length = B.total_length(c.paths.select("edge_id", "length").distinct())
    return D.blocked(m, c.samples, metric, alpha, totals, tree_length or 0.0, by=by)


def nearest(c: Community, split: DataFrame, k: int = 10, metric: str = "unweighted", alpha: float = 0.5, digits: int | None = None) -> DataFrame:
    """``query, neighbour, rank, distance`` by exact distances, of which no table of all pairs is made."""
    totals = B.totals(c.table) if metric == "variance_adjusted" else None
    length = B.total_length(c.paths.select("edge_id", "length").distinct()) if metric == "generalized" and abs(alpha) < 1e-12 else 0.0
    return D.nearest(masses(c, metric != "unweighted"), c.samples, split, k, metric, alpha, totals, length, digits=digits)


def emd(c: Community, weighted: bool = False, method: str = "blocked") -> DataFrame:
    """Un-normalised earth mover's distances on the observed subtree; unweighted shares a sample's mass evenly."""
    B.require_match(c.table, c.paths)
    shares = B.relative(c.table) if weighted else B.equal_shares(c.table)
    m = B.branch_masses(shares, B.observed_paths(c.paths, c.table))
    return D.joined(materialise(B.branch_weights(m), "weights"), c.samples, "emd") if method == "joined" else D.blocked(m, c.samples, "emd")


def emd_contributions(c: Community, leaf_edges: DataFrame, weighted: bool = False) -> DataFrame:
    return D.contributions(B.relative(c.table) if weighted else B.equal_shares(c.table), leaf_edges, c.samples)


def emd_factors(c: Community, leaf_depth: DataFrame, weighted: bool = False) -> DataFrame:
    """One row for every sample; those without matched taxa have factor 0."""
    f = B.normalization_factors(B.relative(c.table) if weighted else B.equal_shares(c.table), leaf_depth)
    return c.samples.select("sample_id").join(f, "sample_id", "left").select("sample_id", F.coalesce("normalization_factor", F.lit(0.0)).alias("normalization_factor"))


def sketch(
    c: Community, weighted: bool = False, raw_counts: bool = False, sketch: int = 2048, method: str = "dmh", bits: int = 16,
    portable: bool = False, length: int = 2048, seed: int = 1337, least: int = 2,
) -> DataFrame:
    """Signatures of all samples that have any branch; fewer than ``least`` are an error (1 for samples that come singly)."""
    H.validate(method, portable, raw_counts, weighted, length)
    w = materialise(B.branch_weights(masses(c, weighted, raw_counts)), "weights")
    kept = B.non_empty(c.samples, w, least)
    return H.sketches(w, kept, sketch, method, seed, bits, length, None if method == "ers" else portable)


def approximate(c: Community, weighted: bool = False, **how) -> DataFrame:
    """``sample_i, sample_j, distance`` from sketches (``how`` as for :func:`sketch`)."""
    return H.mismatch_distances(sketch(c, weighted, **how), weighted)

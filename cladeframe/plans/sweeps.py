"""Sweeps over sketch sizes and seeds, compared with a truth and summarised."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators import statistics as S
from cladeframe.plans import engines as E
from cladeframe.session import materialise

#: The usual grid.
SIZES = tuple(range(1024, 6657, 512))
SEEDS = tuple(range(10))


def sweep(
    c: E.Community, truth: DataFrame, weighted: bool = False, sizes: Iterable[int] = SIZES, seeds: Iterable[int] = SEEDS,
    measure: Callable[[DataFrame], DataFrame] = S.compare, **how,
) -> DataFrame:
    """``sketch_size, seed`` and what ``measure`` makes of each run's pairs (``x`` true, ``y`` estimated)."""
    truth = materialise(truth, "truth")
    seeds, runs = list(seeds), []
    for k in sizes:
        for seed in seeds:
            pairs = materialise(S.aligned(truth, E.approximate(c, weighted, sketch=k, seed=seed, **how)), "run")
            runs.append(measure(pairs).select(F.lit(k).alias("sketch_size"), F.lit(seed).alias("seed"), "*"))
    if not runs:
        raise ValueError("no sizes or no seeds")
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def summarise(runs: DataFrame, value: str = "rmse") -> DataFrame:
    """Replicates of each sketch size."""
    return S.summary(materialise(runs, "runs"), ["sketch_size"], value, "seed")

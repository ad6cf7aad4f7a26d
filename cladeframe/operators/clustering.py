"""Trees from distances and the comparison of trees.

Clustering one matrix is sequential work on n^2 numbers, done by a kernel; replicates are clustered side by side.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.sources.newick import Tree


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Rows of (left, right, height, size) in order of height, by nearest-neighbour chains; average, single or complete."""
    n = len(d)
    if n < 2:
        return np.zeros((0, 4))
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, chain, steps = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        a = chain.pop()
        chain.pop()
        height = d[a, b]
        keep, gone = min(a, b), max(a, b)
        steps.append((keep, gone, height, size[a] + size[b]))
        merged = {"average": (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b]), "single": np.minimum(d[a], d[b]), "complete": np.maximum(d[a], d[b])}[method]
        d[keep], d[:, keep] = merged, merged
        d[keep, keep] = np.inf
        d[gone], d[:, gone] = np.inf, np.inf
        size[keep] += size[gone]
        alive[gone] = False
    steps = [steps[i] for i in np.argsort([s[2] for s in steps], kind="stable")]
    up, name, out = list(range(n)), list(range(n)), np.zeros((n - 1, 4))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (a, b, height, _) in enumerate(steps):
        a, b = root(a), root(b)
        left, right = sorted((name[a], name[b]))
        members = sum(1 if x < n else out[x - n, 3] for x in (left, right))
        out[k] = left, right, height, members
        up[b] = a
        name[a] = n + k
    return out


def clades(z: np.ndarray) -> list[frozenset[int]]:
    """Leaves below each merge."""
    n = len(z) + 1
    below = [frozenset([i]) for i in range(n)]
    for left, right, *_ in z:
        below.append(below[int(left)] | below[int(right)])
    return below[n:]


def cophenetic(z: np.ndarray) -> np.ndarray:
    """The height of each pair's first common merge."""
    n = len(z) + 1
    out, below = np.zeros((n, n)), [[i] for i in range(n)]
    for left, right, height, _ in z:
        a, b = below[int(left)], below[int(right)]
        out[np.ix_(a, b)] = height
        out[np.ix_(b, a)] = height
        below.append(a + b)
    return out


def leaf_order(z: np.ndarray) -> list[int]:
    """Leaves of the dendrogram from left to right."""
    n = len(z) + 1
    below: list[list[int]] = [[i] for i in range(n)]
    for left, right, *_ in z:
        below.append(below[int(left)] + below[int(right)])
    return below[-1]


def rooted(z: np.ndarray, ids: list[str]) -> set[tuple[str, ...]]:
    """Clades of more than one leaf and not all."""
    return {tuple(sorted(ids[i] for i in c)) for c in clades(z) if 1 < len(c) < len(ids)}


def canonical(side: Iterable[str], ids: list[str]) -> tuple[str, ...]:
    """The smaller side of a split; of sides of one size the first in order."""
    one = sorted(side)
    other = sorted(set(ids) - set(one))
    return tuple(min((len(one), one), (len(other), other))[1])


def unrooted(z: np.ndarray, ids: list[str]) -> set[tuple[str, ...]]:
    n = len(ids)
    return {s for c in clades(z) if 1 < len(s := canonical((ids[i] for i in c), ids)) < n - 1}


def tree_splits(tree: Tree) -> dict[int, tuple[str, ...]]:
    """Canonical split of each inner node of a tree, by node; trivial ones left out."""
    ids = [n for n, leaf in zip(tree.name, tree.leaf, strict=True) if leaf]
    below: list[list[str]] = [[] for _ in tree.parent]
    for node in range(len(tree.parent) - 1, -1, -1):
        if tree.leaf[node]:
            below[node].append(tree.name[node])
        if tree.parent[node] >= 0:
            below[tree.parent[node]] += below[node]
    return {i: s for i, names in enumerate(below) if not tree.leaf[i] and 1 < len(s := canonical(names, ids)) < len(ids) - 1}


def robinson_foulds(a: set, b: set) -> dict[str, float]:
    """Splits in one set only, their share of all splits (NaN if there are none), and one less that share."""
    apart, every = len(a ^ b), len(a) + len(b)
    share = apart / every if every else float("nan")
    return {"rf": apart, "normalized_rf": share, "similarity": 1 - share, "shared": len(a & b)}


def robinson_foulds_frame(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """The same for tables of ``*by, split``: one row for each key of both."""
    a, b = first.select(*by, "split").distinct().withColumn("x", F.lit(1)), second.select(*by, "split").distinct().withColumn("y", F.lit(1))
    both = a.join(b, [*by, "split"], "full_outer")
    grouped = both.groupBy(*by) if by else both.groupBy()
    apart = F.count_if(F.col("x").isNull() | F.col("y").isNull())
    every = F.count("x") + F.count("y")
    return grouped.agg(apart.alias("rf"), F.when(every > 0, apart / every).alias("normalized_rf"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"))


def upgma(d: np.ndarray, ids: list[str]) -> Tree:
    """The tree of average linkage; lengths are differences of half the heights."""
    z = linkage(d)
    n = len(ids)
    height = [0.0] * n + [h / 2 for h in z[:, 2]]
    kids = {n + k: (int(z[k, 0]), int(z[k, 1])) for k in range(len(z))}
    return _arena(n + len(z) - 1, kids, ids, lambda up, node: height[up] - height[node])


def neighbour_joining(d: np.ndarray, ids: list[str]) -> Tree:
    """Neighbour joining; negative limbs become 0. The last three nodes hang from the root."""
    n = len(ids)
    d = d.astype(float).copy()
    names, kids, limb, new = list(range(n)), {}, {}, n
    while len(names) > 3:
        m = len(names)
        r = d.sum(axis=1)
        q = (m - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(np.argmin(q), q.shape))
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (m - 2))
        limb[names[i]], limb[names[j]] = max(li, 0.0), max(d[i, j] - li, 0.0)
        kids[new] = names[i], names[j]
        u = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(m) if k not in (i, j)]
        d = np.vstack([np.hstack([d[np.ix_(keep, keep)], u[keep][:, None]]), np.append(u[keep], 0.0)])
        names = [names[k] for k in keep] + [new]
        new += 1
    if len(names) == 3:
        for a, b, c in ((0, 1, 2), (1, 0, 2), (2, 0, 1)):
            limb[names[a]] = max((d[a, b] + d[a, c] - d[b, c]) / 2, 0.0)
    elif len(names) == 2:
        limb[names[0]] = limb[names[1]] = d[0, 1] / 2
    if len(names) == 1:
        return _arena(names[0], kids, ids, lambda up, node: 0.0)
    kids[new] = tuple(names)
    return _arena(new, kids, ids, lambda up, node: limb[node])


def _arena(root: int, kids: dict[int, tuple[int, ...]], ids: list[str], length) -> Tree:
    parent, name, long, leaf = [], [], [], []
    stack = [(root, -1, -1)]
    while stack:
        node, up, upper = stack.pop()
        parent.append(up), name.append(ids[node] if node < len(ids) else ""), leaf.append(node < len(ids))
        long.append(float(length(upper, node)) if up >= 0 else 0.0)
        stack += [(k, len(parent) - 1, node) for k in reversed(kids.get(node, ()))]
    return Tree(parent, name, long, leaf)


def replicate_splits(distances: DataFrame, by: str, ids: list[str], kind: str = "unrooted", tree: str = "upgma") -> DataFrame:
    """``by, split`` of a tree of each replicate of ``by, sample_i, sample_j, distance``; replicates run side by side."""
    at = {s: i for i, s in enumerate(ids)}
    field = distances.schema[by].dataType.simpleString()

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.zeros((len(ids), len(ids)))
        i, j = pdf["sample_i"].map(at).to_numpy(), pdf["sample_j"].map(at).to_numpy()
        d[i, j] = d[j, i] = pdf["distance"].to_numpy()
        if tree == "nj":
            found = set(tree_splits(neighbour_joining(d, ids)).values())
        else:
            found = (rooted if kind == "rooted" else unrooted)(linkage(d), ids)
        return pd.DataFrame({by: [key[0]] * len(found), "split": [list(s) for s in found]})

    return distances.groupBy(by).applyInPandas(one, f"{by} {field}, split array<string>")


def support(splits: DataFrame, by: str) -> DataFrame:
    """``split, support``: the share of replicates that have each split."""
    n = splits.select(by).distinct().count()
    return splits.select(by, "split").distinct().groupBy("split").agg((F.count(F.lit(1)) / F.lit(float(max(n, 1)))).alias("support"))


def annotate(tree: Tree, supports: dict[tuple[str, ...], float]) -> dict[int, str]:
    """Labels for the tree's inner nodes: their splits' support with three decimals."""
    return {node: f"{supports.get(split, 0.0):.3f}" for node, split in tree_splits(tree).items()}

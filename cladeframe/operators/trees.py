"""Trees from distances as tables, for one matrix or for many replicates side by side.

Clusters are merged in rounds: all pairs of reciprocal nearest neighbours merge at once, and their distances to others
are added up by a join. For average, single and complete linkage a merge never comes nearer to a third cluster than both
of its parts were, so the rounds give the tree of the one-by-one rule. Distances are added as whole numbers (of 1 /
``SCALE``), so that ties stay ties; of equal distances the pair of the least leaves, by sample order, is the nearer one.
When few clusters are left, each tree is finished by the same rule in a task of its own.

A clade is named by the exclusive or of its leaves' labels, two 60-bit numbers of the sample's id, whichever tree it is
in. So splits are compared, and support is counted, by joins of names; no set of leaves is ever built for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.session import materialise
from cladeframe.sources import newick

#: Distances are whole numbers of this part.
SCALE = 10**10
_EXACT = "decimal(38,0)"
#: How two distances to one cluster become one.
LINKAGES = {"average": F.sum, "single": F.min, "complete": F.max}
#: Clusters that are left of a tree when one task takes it over: it holds a matrix of their distances, 2 MB.
ONE_TASK = 512
#: Positions on a side of the blocks in which cophenetic distances are written.
BLOCK = 256


def labels(samples: DataFrame) -> DataFrame:
    """``leaf, sample_id, a, b``: sample order and the two numbers that name a leaf."""
    part = lambda at: F.conv(F.substring(F.md5("sample_id"), at, 15), 16, 10).cast("long")
    return samples.select(F.col("sample_ordinal").cast("long").alias("leaf"), "sample_id", part(1).alias("a"), part(16).alias("b"))


def _pairs(distances: DataFrame, samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """``*by, x, y, s``: clusters ``(id, n)`` by their least leaf, the lesser first, and their distance in whole numbers."""
    number = samples.select("sample_id", F.struct(F.col("sample_ordinal").cast("long").alias("id"), F.lit(1).cast("long").alias("n")).alias("c"))
    i = number.select(F.col("sample_id").alias("sample_i"), F.col("c").alias("p"))
    j = number.select(F.col("sample_id").alias("sample_j"), F.col("c").alias("q"))
    s = F.round(F.col("distance") * SCALE).cast(_EXACT)
    return distances.join(i, "sample_i").join(j, "sample_j").select(*by, F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), s.alias("s"))


def _nearest(pairs: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """``*by, i, j, n, d``: pairs of which each is the other's nearest."""
    parts = F.col("x.n") * F.col("y.n") if how == "average" else F.lit(1)
    d = (F.col("s").cast("double") / parts.cast("double")).alias("d")
    one = pairs.select(*by, F.struct(d, F.col("x.id").alias("i"), F.col("y.id").alias("j"), (F.col("x.n") + F.col("y.n")).alias("n")).alias("p"))
    best = one.select(*by, "p", F.explode(F.array("p.i", "p.j")).alias("c")).groupBy(*by, "c").agg(F.min("p").alias("p"))
    return best.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("sides")).filter("sides = 2").select(*by, "p.i", "p.j", "p.n", "p.d")


def _merged(pairs: DataFrame, merges: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """The pairs that are left, with merged clusters under their least leaf."""
    moved = merges.select(*by, F.explode(F.array("i", "j")).alias("old"), F.struct(F.col("i").alias("id"), "n").alias("new"))

    def renamed(rows: DataFrame, side: str) -> DataFrame:
        mine = moved.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("old").alias("__old"), F.col("new").alias("__new"))
        on = [F.col(b) == F.col(f"__{b}") for b in by] + [F.col(f"{side}.id") == F.col("__old")]
        joined = rows.join(mine, on, "left")
        return joined.select(*by, *(F.coalesce("__new", c).alias(c) if c == side else F.col(c) for c in ("x", "y", "s")))

    now = renamed(renamed(pairs, "x"), "y").filter("x.id <> y.id")
    return now.groupBy(*by, F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(LINKAGES[how]("s").alias("s"))


_PAIR, _CLUSTER, _MERGE = range(3)


def _written(by: Sequence[str], pairs: DataFrame, clusters: DataFrame, merges: DataFrame | None) -> DataFrame:
    """What a round leaves, in one table and one job: pairs, clusters with their names, and the round's merges."""
    known = {"x": None, "y": "struct<id: bigint, n: bigint>", "s": _EXACT, "d": "double", "a": "bigint", "b": "bigint"}

    def tagged(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select(*by, F.lit(kind).alias("kind"), *(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in known.items()))

    parts = [tagged(pairs, _PAIR), tagged(clusters, _CLUSTER), *([tagged(merges, _MERGE)] if merges is not None else [])]
    return materialise(reduce(DataFrame.unionByName, parts), "round")


def _finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The merges of one tree's last clusters: the nearest pair, one after the other."""
    known = rows[rows["kind"] == _CLUSTER].sort_values("xi")
    ids, n, a, b = (np.array([int(v) for v in known[c]], np.int64) for c in ("xi", "xn", "a", "b"))
    pairs = rows[rows["kind"] == _PAIR]
    sums = [int(s) for s in pairs["s"]]
    s = np.zeros((len(ids),) * 2, np.int64 if sum(sums) < 1 << 62 else object)
    i, j = np.searchsorted(ids, pairs["xi"].to_numpy()), np.searchsorted(ids, pairs["yi"].to_numpy())
    s[i, j] = s[j, i] = sums
    how = str(rows["how"].iloc[0])

    def apart(k: int) -> np.ndarray:
        return (s[k] / (n[k] * n) if how == "average" else s[k]).astype(float)

    d = np.full(s.shape, np.inf)
    for k in range(len(ids)):
        d[k, k + 1 :] = apart(k)[k + 1 :]
    alive, out = np.ones(len(ids), bool), []
    for _ in range(len(ids) - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)  # of equal ones the first by row and column: by least leaves
        height, alive[j] = d[i, j], False
        s[i] = {"average": np.add, "single": np.minimum, "complete": np.maximum}[how](s[i], s[j])
        s[:, i] = s[i]
        n[i], a[i], b[i] = n[i] + n[j], a[i] ^ a[j], b[i] ^ b[j]
        out.append((ids[i], ids[j], n[i], height, a[i], b[i]))
        d[j], d[:, j] = np.inf, np.inf
        now = np.where(alive, apart(i), np.inf)
        d[i, i + 1 :], d[:i, i] = now[i + 1 :], np.where(alive[:i], now[:i], np.inf)
    frame = pd.DataFrame(out, columns=["i", "j", "n", "d", "a", "b"])
    for at, value in enumerate(key):
        frame.insert(at, f"k{at}", value)
    return frame


def linkage(distances: DataFrame, samples: DataFrame, by: Sequence[str] = (), how: str = "average", one_task: int = ONE_TASK) -> DataFrame:
    """``*by, step, left, right, height, size, i, j, a, b``: the merges of each tree in order of height.

    ``distances(*by, sample_i, sample_j, distance)`` has all pairs of ``samples(sample_id, sample_ordinal)``. Leaves are
    nodes 0 to n - 1 by sample order, step k makes node n + k; ``i < j`` are the least leaves of both parts, ``a, b`` name
    the merge's clade. Rounds go on until no tree has more than ``one_task`` clusters; they are as many as the longest chain
    of merges that wait for each other, about the logarithm of the samples unless one cluster swallows sample after sample.
    Among equal distances single linkage may take merges in another order than one by one, with the same heights.
    """
    if how not in LINKAGES:
        raise ValueError(f"unknown linkage {how!r}")
    n = samples.count()
    leaves = labels(samples).select(F.struct(F.col("leaf").alias("id"), F.lit(1).cast("long").alias("n")).alias("x"), "a", "b")
    if by:
        leaves = distances.select(*by).distinct().crossJoin(leaves)  # a row for each leaf of each tree
    rounds = [_written(by, _pairs(distances, samples, by), leaves, None)]
    while n > one_task and not rounds[-1].filter(F.col("kind") == _CLUSTER).groupBy(*by).count().filter(F.col("count") > max(one_task, 1)).isEmpty():
        pairs = rounds[-1].filter(F.col("kind") == _PAIR)
        clusters = rounds[-1].filter(F.col("kind") == _CLUSTER).select(*by, "x", "a", "b")
        near = _nearest(pairs, by, how)
        part = lambda c: clusters.select(*by, F.col("x.id").alias(c), F.struct("a", "b").alias(f"of_{c}"))  # noqa: B023,E731
        xor = lambda k: F.col(f"of_i.{k}").bitwiseXOR(F.col(f"of_j.{k}")).alias(k)
        merges = near.join(part("i"), [*by, "i"]).join(part("j"), [*by, "j"]).select(
            *by, F.struct(F.col("i").alias("id"), "n").alias("x"), F.struct(F.col("j").alias("id"), F.lit(0).cast("long").alias("n")).alias("y"), "d", xor("a"), xor("b")
        )
        gone = near.select(*by, F.explode(F.array("i", "j")).alias("__id"))
        stay = clusters.withColumn("__id", F.col("x.id")).join(gone, [*by, "__id"], "left_anti").select(*by, "x", "a", "b")
        rounds.append(_written(by, _merged(pairs, near, by, how), stay.unionByName(merges.select(*by, "x", "a", "b")), merges))
    keys = {f"k{at}": F.col(k) for at, k in enumerate(by)} or {"k0": F.lit(0)}
    left = rounds[-1].filter(F.col("kind") != _MERGE).select(
        *(c.alias(k) for k, c in keys.items()), "kind", F.col("x.id").alias("xi"), F.col("x.n").alias("xn"), F.col("y.id").alias("yi"),
        *(F.col(c).cast("string").alias(c) for c in ("s", "a", "b")), F.lit(how).alias("how"),  # whole numbers that pandas would make floats beside nulls
    )
    schema = "".join(f"{k} {left.schema[k].dataType.simpleString()}, " for k in keys) + "i long, j long, n long, d double, a long, b long"
    last = left.groupBy(*keys).applyInPandas(_finish, schema)
    last = last.select(*(F.col(f"k{at}").alias(k) for at, k in enumerate(by)), "i", "j", "n", "d", "a", "b")
    each = [r.filter(F.col("kind") == _MERGE).select(*by, F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.col("x.n").alias("n"), "d", "a", "b") for r in rounds[1:]]
    every = reduce(DataFrame.unionByName, [*each, last])
    step = F.row_number().over(Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("d", "i", "j")) - 1  # a row for each sample
    steps = materialise(every.withColumn("step", step.cast("long")), "steps")
    before = F.lag("step").over(Window.partitionBy(*by, "i").orderBy("step"))
    last = steps.groupBy(*by, "i").agg(F.max("step").alias("last")).withColumnRenamed("i", "j")
    node = lambda s, leaf: F.coalesce(F.lit(n) + F.col(s), F.col(leaf))
    both = steps.withColumn("before", before).join(last, [*by, "j"], "left").withColumn("p", node("before", "i")).withColumn("q", node("last", "j"))
    return materialise(both.select(*by, "step", F.least("p", "q").alias("left"), F.greatest("p", "q").alias("right"), (F.col("d") / SCALE).alias("height"), F.col("n").alias("size"), "i", "j", "a", "b"), "linkage")


def rooted_clades(merges: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """``*by, split, size`` of clades with more than one leaf and not all; ``split`` is the name."""
    return merges.filter((F.col("size") > 1) & (F.col("size") < n)).select(*by, F.struct("a", "b").alias("split"), "size")


def unrooted_splits(merges: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """``*by, split, size``: each split once, under the name of its smaller side (of equal sides the lesser name)."""
    whole = merges.filter(F.col("size") == n).select(*by, F.col("a").alias("ta"), F.col("b").alias("tb"))  # the root of each tree
    rows = merges.join(whole, list(by)) if by else merges.crossJoin(whole)
    own = F.struct("a", "b")
    other = F.struct(F.col("a").bitwiseXOR(F.col("ta")).alias("a"), F.col("b").bitwiseXOR(F.col("tb")).alias("b"))
    split = F.when(F.col("size") * 2 < n, own).when(F.col("size") * 2 > n, other).otherwise(F.least(own, other))
    small = F.least(F.col("size"), F.lit(n) - F.col("size"))
    return rows.select(*by, split.alias("split"), small.alias("size")).filter("size > 1").distinct()


def node_splits(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """``node_id, split, size`` of a tree's inner nodes (:func:`newick.tree_nodes`): labels are combined up the leaves' paths.

    Leaves that ``samples`` lacks do not count. Trivial splits are left out; two nodes may have one split (at the root).
    """
    tips = nodes.filter("is_leaf").join(labels(samples), nodes["name"] == F.col("sample_id"))
    one = tips.select("node_id", F.explode("path").alias("edge"), "a", "b").groupBy("edge").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("size"))
    n = one.agg(F.max("size")).first()[0] or 0
    root = one.filter(F.col("size") == n).limit(1).select(F.col("edge").alias("node"), "a", "b", "size")
    inner = one.filter(F.col("size") < n).select(F.col("edge").alias("node"), "a", "b", "size")
    total = root.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
    both = inner.crossJoin(total)  # one row
    own, other = F.struct("a", "b"), F.struct(F.col("a").bitwiseXOR(F.col("ta")).alias("a"), F.col("b").bitwiseXOR(F.col("tb")).alias("b"))
    split = F.when(F.col("size") * 2 < n, own).when(F.col("size") * 2 > n, other).otherwise(F.least(own, other))
    return both.select(F.col("node").alias("node_id"), split.alias("split"), F.least(F.col("size"), F.lit(n) - F.col("size")).alias("size")).filter("size > 1")


def robinson_foulds(first: DataFrame, second: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``*by, rf, normalized_rf, shared`` of two tables of splits: those in one only, their share (null without any), those in both."""
    sides = lambda f, name: f.select(*by, "split").distinct().withColumn(name, F.lit(1))
    both = sides(first, "x").join(sides(second, "y"), [*by, "split"], "full_outer")
    apart = F.count_if(F.col("x").isNull() | F.col("y").isNull())
    every = F.count("x") + F.count("y")
    return both.groupBy(*by).agg(apart.alias("rf"), F.when(every > 0, apart / every).alias("normalized_rf"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"))


def support(splits: DataFrame, replicates: int) -> DataFrame:
    """``split, size, support`` of ``replicate, split, size``: the share of replicates that have each split."""
    return splits.select("replicate", "split", "size").distinct().groupBy("split", "size").agg((F.count(F.lit(1)) / F.lit(float(max(replicates, 1)))).alias("support"))


def as_tree(merges: list, ids: list[str]) -> tuple[newick.Tree, dict[int, tuple[int, int]]]:
    """One tree from its collected merges, a row for each sample, and the clade names of its inner nodes."""
    n = len(ids)
    below = {n + r["step"]: (r["left"], r["right"]) for r in merges}
    half = {n + r["step"]: r["height"] / 2 for r in merges}
    name = {n + r["step"]: (r["a"], r["b"]) for r in merges}
    tree, names, stack = newick.Tree([], [], [], []), {}, [(n + len(merges) - 1 if merges else 0, -1, 0.0)] if n else []
    while stack:
        node, up, above = stack.pop()
        at = len(tree.parent)
        tree.parent.append(up), tree.name.append(ids[node] if node < n else ""), tree.leaf.append(node < n)
        tree.length.append(above - half.get(node, 0.0) if up >= 0 else 0.0)
        if node >= n:
            names[at] = name[node]
        stack += [(k, at, half[node]) for k in reversed(below.get(node, ()))]
    return tree, names


def leaf_places(merges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """``leaf, place`` from left to right, and ``place, height`` of the merge between a place and the next.

    A leaf stands behind the left parts of all merges that have it on their right; a merge joins the last leaf of its left
    part and the first of its right.
    """
    children = merges.select((F.col("step") + n).alias("node"), F.explode(F.array("left", "right")).alias("child"))
    nodes = children.select(F.col("child").alias("node_id"), F.col("node").alias("parent_id"))
    root = merges.filter(F.col("size") == n).select((F.col("step") + n).alias("node_id"), F.lit(None).cast("long").alias("parent_id"))
    reach = newick.closure(merges.sparkSession, nodes.unionByName(root)).filter(F.col("node_id") < n)  # leaf and each node above it, itself too
    reach = materialise(reach.select(F.col("node_id").alias("leaf"), F.col("edge_id").alias("node")), "reach")
    sizes = merges.select((F.col("step") + n).alias("left"), F.col("size").alias("in_left"))
    parts = merges.join(sizes, "left", "left").select("step", "right", "height", F.coalesce("in_left", F.lit(1)).alias("in_left"))
    behind = reach.join(parts.select(F.col("right").alias("node"), "in_left"), "node")
    places = reach.select("leaf").distinct().join(behind.groupBy("leaf").agg(F.sum("in_left").alias("place")), "leaf", "left").select("leaf", F.coalesce("place", F.lit(0)).alias("place"))
    places = materialise(places, "places")
    begin = reach.join(places, "leaf").groupBy("node").agg(F.min("place").alias("begin"))
    gaps = parts.withColumn("node", F.col("step") + n).join(begin, "node").select((F.col("begin") + F.col("in_left") - 1).alias("place"), "height")
    return places, gaps


def cophenetic(merges: DataFrame, samples: DataFrame) -> DataFrame:
    """``sample_i, sample_j, distance``: for every pair, in sample order, the height of its first common merge.

    With the leaves from left to right it is the greatest height between the two places. Pairs are written block by block;
    a task needs the heights between neighbours and the ids, a number and a name for each sample.
    """
    n = samples.count()
    schema = "sample_i string, sample_j string, distance double"
    if n < 2:
        return samples.sparkSession.createDataFrame([], schema)
    places, gaps = leaf_places(merges, n)
    order = places.join(samples.select(F.col("sample_ordinal").cast("long").alias("leaf"), "sample_id"), "leaf").orderBy("place").select("leaf", "sample_id").toArrow()
    number, names = order["leaf"].to_numpy(), order["sample_id"].combine_chunks()
    height = gaps.orderBy("place").select("height").toArrow()["height"].to_numpy()
    blocks = -(-n // BLOCK)

    def run(batches):
        for batch in batches:
            for code in batch.column(0).to_pylist():
                bi, bj = divmod(code, blocks)
                if bi > bj:
                    continue
                p, q = (np.arange(b * BLOCK, min((b + 1) * BLOCK, n)) for b in (bi, bj))
                if bi == bj:
                    far = np.zeros((len(p), len(p)))
                    for k in range(len(p) - 1):
                        far[k, k + 1 :] = np.maximum.accumulate(height[p[k] : p[-1]])
                    x, y = np.nonzero(np.triu(np.ones(far.shape, bool), 1))
                else:
                    end = np.append(height, 0.0)  # the last place has no next one
                    left = np.maximum.accumulate(end[p][::-1])[::-1]
                    between = height[p[-1] + 1 : q[0]].max(initial=0.0)
                    right = np.maximum.accumulate(np.append(0.0, height[q[0] : q[-1]]))
                    far = np.maximum(np.maximum.outer(left, right), between)
                    x, y = (k.ravel() for k in np.indices(far.shape))
                a, b = p[x], q[y]
                swap = number[a] > number[b]
                i, j = np.where(swap, b, a), np.where(swap, a, b)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(far[x, y])], ["sample_i", "sample_j", "distance"])

    spark = samples.sparkSession
    return spark.range(blocks * blocks).repartition(min(blocks * blocks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def clade_members(merges: DataFrame, samples: DataFrame) -> DataFrame:
    """``step, members``: the sorted leaves of each clade, for trees small enough to be read."""
    n = samples.count()
    children = merges.select((F.col("step") + n).alias("parent_id"), F.explode(F.array("left", "right")).alias("node_id")).select("node_id", "parent_id")
    reach = newick.closure(merges.sparkSession, children).filter((F.col("node_id") < n) & (F.col("edge_id") != F.col("node_id")))
    named = reach.join(labels(samples).select(F.col("leaf").alias("node_id"), "sample_id"), "node_id")
    return named.groupBy((F.col("edge_id") - n).alias("step")).agg(F.sort_array(F.collect_list("sample_id")).alias("members"))

"""Distributed clustering, clade names, splits and cophenetic distances against the kernels of one matrix."""

import collections
import itertools

import numpy as np
import pytest

from cladeframe.operators import clustering as C
from cladeframe.operators import distances as D
from cladeframe.operators import rarefaction as R
from cladeframe.operators import trees as T
from cladeframe.plans import engines as E
from cladeframe.sources import newick


def euclid(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def table(spark, d, ids, **by):
    rows = [(*by.values(), ids[i], ids[j], float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d))]
    return spark.createDataFrame(rows, "".join(f"{k} long, " for k in by) + "sample_i string, sample_j string, distance double")


def order(spark, ids):
    return spark.createDataFrame([(s, i) for i, s in enumerate(ids)], "sample_id string, sample_ordinal int")


def one_by_one(d, how="average"):
    """Merges (i, j, height, leaves) of the nearest pair, one after the other; of equal distances that of the least leaves."""
    groups, out = {i: [i] for i in range(len(d))}, []
    far = {"average": np.mean, "single": np.min, "complete": np.max}[how]
    while len(groups) > 1:
        h, i, j = min((round(float(far(d[np.ix_(groups[i], groups[j])])), 9), i, j) for i, j in itertools.combinations(sorted(groups), 2))
        groups[i] += groups.pop(j)
        out.append((i, j, h, frozenset(groups[i])))
    return out


@pytest.mark.parametrize("how,one_task", [("average", 512), ("average", 7), ("average", 1), ("complete", 512), ("complete", 4), ("single", 512)])
def test_linkage_is_that_of_one_matrix(spark, how, one_task):
    d = euclid(np.random.default_rng(1).normal(size=(20, 3)))
    ids = [f"s{i:02d}" for i in range(20)]
    got = T.linkage(table(spark, d, ids), order(spark, ids), how=how, one_task=one_task).orderBy("step").collect()
    want = C.linkage(d, how)
    assert [(r["left"], r["right"], r["size"]) for r in got] == [(int(a), int(b), int(s)) for a, b, _, s in want]
    assert np.allclose([r["height"] for r in got], want[:, 2], atol=1e-9)
    assert [(r["i"], r["j"]) for r in got] == [x[:2] for x in one_by_one(d, how)]
    label = {r["leaf"]: (r["a"], r["b"]) for r in T.labels(order(spark, ids)).collect()}
    assert [(r["a"], r["b"]) for r in got] == [tuple(np.bitwise_xor.reduce([label[k] for k in x[3]])) for x in one_by_one(d, how)]


@pytest.mark.parametrize("how,one_task", [("average", 512), ("average", 1), ("complete", 512), ("single", 3)])
def test_ties_and_chains(spark, how, one_task):
    """Distances of few values, whose ties go to the least leaves; and points of growing gaps, where one cluster takes all."""
    rng = np.random.default_rng(2)
    tied = rng.integers(1, 4, size=(9, 9)).astype(float)
    tied = np.maximum(tied, tied.T)
    np.fill_diagonal(tied, 0)
    chain = np.abs(np.subtract.outer(2.0 ** np.arange(9), 2.0 ** np.arange(9)))
    equal = np.ones((9, 9)) - np.eye(9)
    ids = [f"s{i:02d}" for i in range(9)]
    rows = [table(spark, d, ids, replicate=k) for k, d in enumerate((tied, chain, equal))]
    got = T.linkage(rows[0].unionByName(rows[1]).unionByName(rows[2]), order(spark, ids), ["replicate"], how, one_task).collect()
    for k, d in enumerate((tied, chain, equal)):
        mine = sorted((r["step"], r["i"], r["j"], round(r["height"], 8), r["size"]) for r in got if r["replicate"] == k)
        want = [(n, i, j, round(h, 8), len(s)) for n, (i, j, h, s) in enumerate(one_by_one(d, how))]
        if how == "single":  # merges of one height may come in any order
            assert [x[3] for x in mine] == [x[3] for x in want]
        else:
            assert mine == want


def test_few_samples(spark):
    for n in (0, 2):
        ids = ["a", "b"][:n]
        rows = T.linkage(table(spark, np.ones((n, n)), ids), order(spark, ids))
        assert rows.count() == max(n - 1, 0)
        assert T.cophenetic(rows, order(spark, ids)).count() == max(n - 1, 0)
    with pytest.raises(ValueError):
        T.linkage(table(spark, np.ones((2, 2)), ids), order(spark, ids), how="ward")


def test_splits_and_robinson_foulds(spark):
    rng = np.random.default_rng(3)
    ids = [f"s{i:02d}" for i in range(9)]
    samples, mats = order(spark, ids), [euclid(rng.normal(size=(9, 2))) for _ in range(2)]
    sets, merges = [C.linkage(d) for d in mats], [T.linkage(table(spark, d, ids), samples) for d in mats]
    for mine, theirs in ((T.rooted_clades, C.rooted), (T.unrooted_splits, C.unrooted)):
        want = C.robinson_foulds(theirs(sets[0], ids), theirs(sets[1], ids))
        got = T.robinson_foulds(mine(merges[0], 9), mine(merges[1], 9)).first()
        assert (got["rf"], got["shared"]) == (want["rf"], want["shared"]) and got["normalized_rf"] == pytest.approx(want["normalized_rf"])
        assert collections.Counter(r["size"] for r in mine(merges[0], 9).collect()) == collections.Counter(map(len, theirs(sets[0], ids)))
    members = {tuple(r["members"]) for r in T.clade_members(merges[0], samples).collect()}
    assert members - {tuple(ids)} == C.rooted(sets[0], ids)
    assert T.robinson_foulds(T.rooted_clades(merges[0].limit(0), 9), T.rooted_clades(merges[0].limit(0), 9)).first()["normalized_rf"] is None


def test_split_names_of_a_newick_tree(spark):
    text = "(((a,b),c),((d,e),(f,g)));"
    tree = newick.parse(text)
    samples = order(spark, list("abcdefg"))
    got = T.node_splits(newick.tree_nodes(spark, text), samples).collect()
    known = {r["sample_id"]: (r["a"], r["b"]) for r in T.labels(samples).collect()}
    name = lambda leaves: tuple(np.bitwise_xor.reduce([known[x][k] for x in leaves]) for k in (0, 1))
    assert {r["node_id"]: tuple(r["split"]) for r in got} == {node: name(s) for node, s in C.tree_splits(tree).items()}


@pytest.mark.parametrize("n", [3, 22])
def test_cophenetic(spark, n, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 7)
    d = euclid(np.random.default_rng(n).normal(size=(n, 2)))
    ids = [f"s{i:02d}" for i in range(n)]
    got = {(r["sample_i"], r["sample_j"]): r["distance"] for r in T.cophenetic(T.linkage(table(spark, d, ids), order(spark, ids)), order(spark, ids)).collect()}
    want = C.cophenetic(C.linkage(d))
    assert len(got) == n * (n - 1) // 2
    assert all(got[ids[i], ids[j]] == pytest.approx(want[i, j], abs=1e-9) for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("metric", D.METRICS[:4])
def test_replicates_in_one_job(spark, metric):
    """Each replicate's distances are those of its own table; a sample that a replicate lacks stays, without branches."""
    rng = np.random.default_rng(4)
    rows = [(r, f"s{i}", f"f{j}", float(rng.integers(1, 9))) for r in range(3) for i in range(7) for j in range(9) if rng.random() < 0.5 and (r, i) != (1, 2)]
    every = spark.createDataFrame(rows, "replicate int, sample_id string, feature_id string, value double")
    samples = order(spark, [f"s{i}" for i in range(7)])
    star = spark.createDataFrame([(f"f{j}", j, 0.5 + j) for j in range(9)], "feature_id string, edge_id long, length double")
    got = {(r["replicate"], r["sample_i"], r["sample_j"]): r["distance"] for r in E.exact(E.Community(every, samples, star), metric).collect()}
    assert len(got) == 3 * 21
    for k in range(3):
        for r in E.exact(E.Community(every.filter(f"replicate = {k}").drop("replicate"), samples, star), metric).collect():
            assert got[k, r["sample_i"], r["sample_j"]] == pytest.approx(r["distance"])
    with pytest.raises(ValueError):
        E.exact(E.Community(every, samples, star), "weighted", method="joined")


def test_jackknife_support_of_the_consensus(spark):
    rng = np.random.default_rng(6)
    names = [f"s{i}" for i in range(8)]
    rows = [(s, f"f{j}", float(rng.integers(1, 20) * (1 + 30 * (i < 4) * (j < 4)))) for i, s in enumerate(names) for j in range(8)]
    long, samples = spark.createDataFrame(rows, "sample_id string, feature_id string, value double"), order(spark, names)
    star = spark.createDataFrame([(f"f{j}", j, 1.0) for j in range(8)], "feature_id string, edge_id long, length double")
    held = []

    def distance(t, s):
        held.append(E.exact(E.Community(t, s, star), "weighted"))
        return held[0]

    mean, text, supports = R.jackknife(long, samples, distance, iterations=7)
    assert len(held) == 1  # one call for all replicates
    at, count = {s: i for i, s in enumerate(names)}, collections.Counter()
    square = collections.defaultdict(lambda: np.zeros((8, 8)))
    for r in held[0].collect():
        i, j = at[r["sample_i"]], at[r["sample_j"]]
        square[r["replicate"]][i, j] = square[r["replicate"]][j, i] = r["distance"]
    for d in square.values():
        count.update({C.canonical((names[k] for k in s), names) for *_, s in one_by_one(d) if 1 < len(s) < 7})
    assert sorted(round(r["support"] * 7) for r in supports.collect()) == sorted(count.values())
    tree = newick.parse(text)
    labels = {float(x) for x in __import__("re").findall(r"\)([0-9.]+):", text)}
    splits = set(C.tree_splits(tree).values())
    assert labels == {round(count[s] / 7, 3) for s in splits} and mean.count() == 28

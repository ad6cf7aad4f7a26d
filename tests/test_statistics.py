"""Ordination, clustering, statistics, rarefaction and streams."""

import itertools

import numpy as np
import pytest

from cladeframe.operators import clustering as C
from cladeframe.operators import ordination as O
from cladeframe.operators import rarefaction as R
from cladeframe.operators import statistics as S
from cladeframe.sources import newick
from cladeframe.streaming import incremental


def frame(spark, d, ids=None):
    ids = ids or [f"s{i:02d}" for i in range(len(d))]
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(ids)], "sample_id string, sample_ordinal int")
    rows = [(ids[i], ids[j], float(d[i, j])) for i, j in itertools.combinations(range(len(ids)), 2)]
    return spark.createDataFrame(rows, "sample_i string, sample_j string, distance double"), samples, ids


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(1).standard_normal((24, 3)) * [3, 2, 1]


def euclid(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def test_pcoa_recovers_distances(spark, points):
    d, samples, ids = frame(spark, euclid(points))
    o = O.pcoa(d, samples, 3)
    assert np.allclose(euclid(o.coordinates), euclid(points)) and o.proportion.sum() == pytest.approx(1)
    assert O.explained_total(d, len(ids)) == pytest.approx(o.eigenvalues.sum())
    r = O.pcoa(d, samples, 3, method="randomized")
    assert np.allclose(r.eigenvalues, o.eigenvalues) and np.allclose(np.abs(r.coordinates), np.abs(o.coordinates), atol=1e-6)


def test_procrustes(spark, points):
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((3, 3)))
    fit = O.procrustes_test(spark, points, points @ q * 5 + 7, 49)
    assert fit.disparity == pytest.approx(0, abs=1e-10) and fit.p_value == pytest.approx(1 / 50)
    noise = O.procrustes_test(spark, points, np.random.default_rng(3).standard_normal(points.shape), 49)
    assert noise.disparity > 0.5 and noise.p_value > 0.02
    assert (points - fit.mean_x) == pytest.approx(((points @ q * 5 + 7) - fit.mean_y) @ fit.rotation * fit.scale)


def test_mantel_and_permanova(spark, points):
    d, samples, ids = frame(spark, euclid(points))
    rows = S.aligned(d, d)
    r, p = S.mantel(rows, 49)
    assert r == pytest.approx(1) and p == pytest.approx(1 / 50)
    x = points.copy()
    x[12:] += 10
    apart, _, ids = frame(spark, euclid(x))
    meta = spark.createDataFrame([(s, "a" if i < 12 else "b") for i, s in enumerate(ids)], "sample_id string, group string")
    got = S.permanova(apart, meta).first()
    n, centre = len(x), lambda y: ((y - y.mean(0)) ** 2).sum()
    within = centre(x[:12]) + centre(x[12:])
    assert got["ss_total"] == pytest.approx(centre(x)) and got["ss_within"] == pytest.approx(within)
    assert got["pseudo_f"] == pytest.approx((centre(x) - within) / (within / (n - 2)))
    f, p = S.permanova_p(apart, meta, 49)
    assert f == pytest.approx(got["pseudo_f"]) and p == pytest.approx(1 / 50)
    with pytest.raises(ValueError):
        S.permanova(apart, meta.limit(5))


@pytest.mark.parametrize("strip", [None, 1, 7, 24])
def test_mantel_by_strips(spark, points, strip):
    """The p-value of permuting whole matrices, whatever the strips; a missing pair counts as 0."""
    near = points + np.random.default_rng(8).standard_normal(points.shape) * 4
    a, samples, ids = frame(spark, euclid(points))
    b, _, _ = frame(spark, euclid(near))
    rows = S.aligned(a, b).filter("sample_i <> 's03' or sample_j <> 's09'")
    x, y = euclid(points), euclid(near)
    for m in (x, y):
        m[3, 9] = m[9, 3] = 0
    up = np.triu_indices(24, 1)
    r = np.corrcoef(x[up], y[up])[0, 1]
    hits = 0
    for k in range(30):
        p = np.random.default_rng([7, k]).permutation(24)
        hits += abs(np.corrcoef(x[up], y[np.ix_(p, p)][up])[0, 1]) >= abs(r) - 1e-10
    got = S.mantel(rows, 30, seed=7, strip=strip)
    assert got[0] == pytest.approx(r) and got[1] == pytest.approx((hits + 1) / 31)


def test_mantel_without_variance(spark):
    same, _, _ = frame(spark, np.ones((4, 4)))
    assert all(np.isnan(v) for v in S.mantel(S.aligned(same, same), 5))


def test_linkage_against_brute_force(points):
    d = euclid(points)
    z = C.linkage(d)
    groups = {i: [i] for i in range(len(d))}
    for k, (a, b, h, size) in enumerate(z):
        best = min(d[np.ix_(groups[p], groups[q])].mean() for p, q in itertools.combinations(groups, 2))
        assert h == pytest.approx(best)
        groups[len(d) + k] = groups.pop(int(a)) + groups.pop(int(b))
        assert len(groups[len(d) + k]) == size
    m = C.cophenetic(z)
    assert m.max() == pytest.approx(z[-1, 2]) and np.allclose(m, m.T)
    assert sorted(C.leaf_order(z)) == list(range(len(d)))


def test_neighbour_joining_recovers_an_additive_tree():
    tree = newick.parse("((A:1,B:2):1,(C:3,(D:1,E:4):2):1);")
    paths = {r[2]: set(newick.above(np.array(tree.parent), [r[0]])[0].tolist()) for r in newick.rows(tree) if r[4]}
    ids = sorted(paths)
    d = np.array([[sum(tree.length[e] for e in paths[a] ^ paths[b]) for b in ids] for a in ids])
    joined = C.neighbour_joining(d, ids)
    assert set(C.tree_splits(joined).values()) == set(C.tree_splits(tree).values())
    again = {r[2]: set(newick.above(np.array(joined.parent), [r[0]])[0].tolist()) for r in newick.rows(joined) if r[4]}
    got = np.array([[sum(joined.length[e] for e in again[a] ^ again[b]) for b in ids] for a in ids])
    assert np.allclose(got, d)


def test_robinson_foulds(spark):
    a, b = {("x", "y"), ("z", "w")}, {("x", "y"), ("z", "v")}
    assert C.robinson_foulds(a, b) == {"rf": 2, "normalized_rf": 0.5, "similarity": 0.5, "shared": 1}
    assert np.isnan(C.robinson_foulds(set(), set())["normalized_rf"])
    to = lambda s: spark.createDataFrame([(list(x),) for x in s], "split array<string>")
    assert tuple(C.robinson_foulds_frame(to(a), to(b), []).first()) == (2, 0.5, 1)


def test_canonical_splits_take_the_smaller_side():
    ids = list("abcdef")
    assert C.canonical("cdef", ids) == ("a", "b")
    assert C.canonical("def", ids) == ("a", "b", "c")


def test_neighbours_and_recall(spark):
    d = np.array([[0, 1, 1, 3], [1, 0, 2, 1], [1, 2, 0, 1], [3, 1, 1, 0]], float)
    table, samples, ids = frame(spark, d)
    split = spark.createDataFrame([(s, i == 0) for i, s in enumerate(ids)], "sample_id string, is_query boolean")
    near = S.neighbours(table, samples, split, 2)
    assert [r["neighbour"] for r in near.orderBy("rank").collect()] == ["s01", "s02"]
    assert S.recall(near, near.filter("rank = 2"), 2).first()["recall"] == 0.5
    assert S.query_split(samples, 0.01).filter("is_query").count() == 1
    assert S.query_split(samples, 1.0).filter("is_query").count() == 3


@pytest.mark.parametrize("metric,block", [("unweighted", 4), ("weighted", 256), ("variance_adjusted", 5)])
def test_nearest_without_a_pair_table(spark, metric, block, monkeypatch):
    """The same neighbours as from the table of all pairs, ties included; a task lets out k rows a query at most."""
    from cladeframe.operators import branches, distances
    from cladeframe.plans import engines as E

    rng = np.random.default_rng(9)
    rows = [(f"s{i:02d}", f"f{j}", float(rng.integers(1, 4))) for i in range(17) for j in range(5) if rng.random() < 0.6]
    samples = spark.createDataFrame([(f"s{i:02d}", i) for i in range(17)], "sample_id string, sample_ordinal int")
    star = spark.createDataFrame([(f"f{j}", j, 1.0) for j in range(5)], "feature_id string, edge_id long, length double")
    c = E.Community(spark.createDataFrame(rows, "sample_id string, feature_id string, value double"), samples, star)
    split = S.query_split(samples, 0.4)
    table = E.exact(c, metric)
    want = S.neighbours(table.selectExpr("sample_i", "sample_j", "round(distance, 9) AS distance"), samples, split, 4)
    totals = branches.totals(c.table) if metric == "variance_adjusted" else None
    got = distances.nearest(E.masses(c, metric != "unweighted"), samples, split, 4, metric, totals=totals, block=block, digits=9)
    assert sorted(map(tuple, got.select("query", "neighbour", "rank").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("fault,rmse,bias", [(None, True, True), ("shift", True, False), ("scale", True, False), ("narrow", False, True), ("wide", False, True)])
def test_a_wrong_sketch_is_told(spark, fault, rmse, bias):
    """Shares of 512 equal slots pass; ones that lie a standard error too high, or vary too little or too much, do not."""
    rng = np.random.default_rng(11)
    x = rng.uniform(0.2, 0.8, 60)
    y = rng.binomial(512, x, (8, 60)) / 512
    sd = np.sqrt(x * (1 - x) / 512)
    y = {None: y, "shift": y + 0.4 * sd, "scale": y * 1.012, "narrow": x + (y - x) / 2, "wide": x + (y - x) * 1.6}[fault]
    rows = spark.createDataFrame([(s, float(x[p]), float(y[s, p])) for s in range(8) for p in range(60)], "seed int, x double, y double")
    got = S.estimator_errors(rows, 512).first()
    assert (got["rmse_in_bound"], got["bias_in_bound"], got["seeds"], got["pairs"]) == (rmse, bias, 8, 60)


def test_density_and_depths(spark):
    v = np.random.default_rng(10).gamma(2, 3, 500)
    rows = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    got = S.density(rows, "v", 9).orderBy("point").collect()
    h, x = v.std(ddof=1) * 500**-0.2, np.linspace(v.min(), v.max(), 9)
    want = np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(1) / (500 * h * np.sqrt(2 * np.pi))
    assert np.allclose([r["x"] for r in got], x) and np.allclose([r["density"] for r in got], want, rtol=1e-6)
    assert S.density(rows.filter("v is null"), "v").count() == 0 and S.density(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").count() == 0
    depths = spark.createDataFrame([(f"s{k % 7}", float(k % 3)) for k in range(7)], "sample_id string, total double")
    assert [tuple(r) for r in S.by_depth(depths).orderBy("place").collect()] == [(k, *r) for k, r in enumerate(sorted(((f"s{k % 7}", float(k % 3)) for k in range(7)), key=lambda r: r[::-1]), 1)]


def test_summary_of_one_replicate(spark):
    r = S.summary(spark.createDataFrame([("k", 1, 2.0)], "k string, seed int, v double"), ["k"], "v", "seed").first()
    assert (r["n"], r["mean"], r["sd"], r["se"], r["cv"], r["first"]) == (1, 2.0, 0.0, 0.0, 0.0, 2.0)


@pytest.mark.parametrize("draw", [R.rarefied, R.drawn])
def test_rarefaction(spark, draw):
    rows = [("a", "x", 30.0), ("a", "y", 70.0), ("b", "x", 3.0), ("c", "z", 10.0)]
    table = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    got = draw(table, 10, replicates=40).collect()
    assert {r["sample_id"] for r in got} == {"a", "c"}
    total = {}
    for r in got:
        total[r["replicate"], r["sample_id"]] = total.get((r["replicate"], r["sample_id"]), 0) + r["value"]
    assert set(total.values()) == {10.0} and len(total) == 80
    assert np.mean([r["value"] for r in got if r["feature_id"] == "x"]) == pytest.approx(3, abs=0.9)
    assert R.minimum_depth(table) == 3
    with pytest.raises(ValueError):
        R.minimum_depth(table.limit(0))


def test_jackknife(spark):
    from cladeframe.plans import engines as E

    rng = np.random.default_rng(5)
    names = [f"s{i}" for i in range(6)]
    rows = [(s, f"f{j}", float(rng.integers(1, 20) * (1 + 30 * (i < 3) * (j < 4)))) for i, s in enumerate(names) for j in range(8)]
    table = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "sample_id string, sample_ordinal int")
    star = spark.createDataFrame([(f"f{j}", j, 1.0) for j in range(8)], "feature_id string, edge_id long, length double")
    mean, text, supports = R.jackknife(table, samples, lambda t, s: E.exact(E.Community(t, s, star), "weighted"), iterations=3)
    assert mean.count() == 15
    assert {n for n, leaf in zip(*(lambda t: (t.name, t.leaf))(newick.parse(text))) if leaf} == set(names)
    assert 0 < max(r["support"] for r in supports.collect()) <= 1


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "s long, v double").repartition(4)
    rows.write.parquet(f"{tmp_path}/in")
    got = {r["sample_id"]: (r["total"], r["n"]) for r in incremental.running_totals(spark, f"{tmp_path}/in", "s", "v").collect()}
    assert got == {str(k): (float(sum(range(k, 30, 3))), 10) for k in range(3)}


def test_histogram(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert [(r["bin"], r["n"]) for r in S.histogram(rows, "v", 5).orderBy("bin").collect()] == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]


@pytest.mark.parametrize("wider,spare", [(2, 64), (1, 0)])
def test_rarefied_rows_are_cut_where_they_are_made(spark, monkeypatch, wider, spare):
    """The first counts by hash, of which only few are shuffled; a bound that leaves too few (1, 0) is made good."""
    import hashlib
    from collections import Counter

    made = {}
    keep = R.materialise
    monkeypatch.setattr(R, "materialise", lambda df, name: made.setdefault(name, keep(df, name)))
    monkeypatch.setattr(R, "WIDER", wider)
    monkeypatch.setattr(R, "SPARE", spare)
    counts = {("a", "x"): 900, ("a", "y"): 700, ("a", "z"): 1, ("b", "x"): 6, ("b", "y"): 4, ("c", "x"): 9}
    table = spark.createDataFrame([(s, f, float(n)) for (s, f), n in counts.items()], "sample_id string, feature_id string, value double")
    got = {tuple(r)[:3]: r["value"] for r in R.rarefied(table, 10, 42, 3).collect()}
    want = {}
    for g in range(3):
        for s in "ab":
            lots = sorted((hashlib.md5(f"42:{g}:{s}:{f}:{k}".encode()).hexdigest(), f, k) for (t, f), n in counts.items() if t == s for k in range(1, n + 1))
            want |= {(g, s, f): float(n) for f, n in Counter(f for _, f, _ in lots[:10]).items()}
    assert got == want
    assert made["lots"].count() < 3 * (10 + 200)  # of 4,833 counts

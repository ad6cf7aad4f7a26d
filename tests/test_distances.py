"""Distances against plain numpy definitions, on fixed small communities and random ones."""

import itertools

import numpy as np
import pytest

from cladeframe.operators import branches as B
from cladeframe.operators import distances as D
from cladeframe.operators import sketches as H
from cladeframe.operators import statistics as S
from cladeframe.plans import engines as E
from cladeframe.sources import newick

# fixed values: a small tree and table, and distances published for them
TREE = "((T1:0.1,(T2:0.05,T3:0.05):0.02):0.3,(T4:0.2,(T5:0.1,T6:0.15,T7:0.2):0.05):0.4);"
TABLE = {"A": {"T1": 2, "T3": 5, "T4": 3}, "B": {"T2": 3, "T5": 9, "T6": 6}, "C": {"T1": 4, "T3": 7, "T7": 3}}
KNOWN = {
    "unweighted": [0.492958, 0.340909, 0.457746],
    "weighted": [0.646859, 0.206144, 0.692871],
    "raw": [0.693834, 0.272899, 0.707595],
    "generalized": [0.699390, 0.301208, 0.735067],
    "generalized0": [0.668426, 0.340507, 0.691919],
    "variance_adjusted": [0.669941, 0.238938, 0.714323],
    "emd": [0.635000, 0.182143, 0.675714],
    "emd_unweighted": [0.483333, 0.150000, 0.466667],
}


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(s, t, float(v)) for s, r in TABLE.items() for t, v in r.items()]
    table = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    samples = spark.createDataFrame([(s, i) for i, s in enumerate("ABC")], "sample_id string, sample_ordinal int")
    return E.Community(table, samples, newick.tree_paths(newick.tree_nodes(spark, TREE)))


def values(frame):
    got = {(r["sample_i"], r["sample_j"]): r["distance"] for r in frame.collect()}
    return [got[p] for p in itertools.combinations("ABC", 2)]


@pytest.mark.parametrize("method", ["blocked", "joined"])
def test_unweighted_and_weighted(toy, method):
    assert values(E.exact(toy, method=method)) == pytest.approx(KNOWN["unweighted"], abs=1e-6)
    assert values(E.exact(toy, "weighted", method=method)) == pytest.approx(KNOWN["weighted"], abs=1e-6)
    assert values(E.exact(toy, "weighted", raw_counts=True, method=method)) == pytest.approx(KNOWN["raw"], abs=1e-6)
    assert values(E.emd(toy, True, method)) == pytest.approx(KNOWN["emd"], abs=1e-6)
    assert values(E.emd(toy, False, method)) == pytest.approx(KNOWN["emd_unweighted"], abs=1e-6)


def test_generalized_and_variance_adjusted(toy, spark):
    assert values(E.exact(toy, "generalized")) == pytest.approx(KNOWN["generalized"], abs=1e-6)
    whole = B.total_length(newick.tree_nodes(spark, TREE))
    assert values(E.exact(toy, "generalized", 0.0, tree_length=whole)) == pytest.approx(KNOWN["generalized0"], abs=1e-6)
    assert values(E.exact(toy, "generalized", 1.0)) == pytest.approx(KNOWN["weighted"], abs=1e-6)
    assert values(E.exact(toy, "variance_adjusted")) == pytest.approx(KNOWN["variance_adjusted"], abs=1e-6)


def test_contributions_and_factors(toy, spark):
    nodes = newick.tree_nodes(spark, TREE).filter("is_leaf")
    leaf = nodes.selectExpr("name as feature_id", "length")
    got = {r["taxon"]: r["contribution"] for r in E.emd_contributions(toy, leaf, True).filter("sample_i = 'A' and sample_j = 'B'").collect()}
    # fixed values
    assert got == pytest.approx({"T1": 0.02, "T2": 0.008333, "T3": 0.025, "T4": 0.06, "T5": 0.05, "T6": 0.05}, abs=1e-6)
    factors = {r[0]: r[1] for r in E.emd_factors(toy, nodes.selectExpr("name as feature_id", "depth"), True).collect()}
    assert factors == pytest.approx({"A": 0.445, "B": 0.536667, "C": 0.438571}, abs=1e-6)


def random_community(spark, rng, n, features=40):
    """Random binary tree over features; some taxa are not in it, some samples are empty."""
    clades = [f"f{i}:{rng.random():.3f}" for i in range(features)]
    while len(clades) > 1:
        a = clades.pop(rng.integers(len(clades)))
        b = clades.pop(rng.integers(len(clades)))
        clades.append(f"({a},{b}):{rng.random():.3f}")
    names = [f"s{i:03d}" for i in range(n)]
    rows = [(s, f"f{j}", float(rng.integers(1, 30))) for i, s in enumerate(names) if i % 17 != 5 for j in rng.choice(features + 5, rng.integers(1, 15), replace=False)]
    table = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "sample_id string, sample_ordinal int")
    paths = newick.tree_paths(newick.tree_nodes(spark, clades[0] + ";"))
    return E.Community(table, samples, paths), rows, names


@pytest.mark.parametrize("metric", ["unweighted", "weighted", "generalized", "variance_adjusted", "emd"])
def test_random_community(spark, metric):
    c, rows, names = random_community(spark, np.random.default_rng(3), 30)
    path = {}
    length = {}
    for r in c.paths.collect():
        path.setdefault(r["feature_id"], []).append(r["edge_id"])
        length[r["edge_id"]] = r["length"]
    edges = {e: k for k, e in enumerate(sorted(length))}
    ell = np.array([length[e] for e in sorted(length)])
    total = {s: sum(v for a, _, v in rows if a == s) for s in names}
    mass = np.zeros((len(names), len(edges)))
    for s, f, v in rows:
        for e in path.get(f, ()):
            if metric == "unweighted":
                mass[names.index(s), edges[e]] = 1
            else:
                mass[names.index(s), edges[e]] += v / total[s]
    got = {(r[0], r[1]): r[2] for r in (E.emd(c, True) if metric == "emd" else E.exact(c, metric)).collect()}
    assert len(got) == 30 * 29 // 2
    for i, j in itertools.combinations(range(30), 2):
        a, b = mass[i], mass[j]
        s, d = a + b, np.abs(a - b)
        live = s > 0
        if metric == "unweighted":
            num, den = (ell * d).sum(), (ell * np.maximum(a, b)).sum()
        elif metric == "weighted":
            num, den = (ell * d).sum(), (ell * s).sum()
        elif metric == "emd":
            num, den = (ell * d).sum(), 1.0
        elif metric == "generalized":
            num, den = (ell * d)[live] @ s[live] ** -0.5, (ell[live] * s[live] ** 0.5).sum()
        else:
            m, t = a * total[names[i]] + b * total[names[j]], total[names[i]] + total[names[j]]
            ok = live & (m > 0) & (t - m > 1e-12 * t)
            w = ell[ok] / np.sqrt(m[ok] * (t - m[ok]))
            num, den = (w * d[ok]).sum(), (w * s[ok]).sum()
        assert got[names[i], names[j]] == pytest.approx(num / den if den > 0 else 0.0, abs=1e-9)


def test_blocks_do_not_matter(spark):
    from cladeframe.operators import distances as D

    c, _, _ = random_community(spark, np.random.default_rng(4), 23)
    m = E.masses(c, True)
    one = {tuple(r) for r in D.blocked(m, c.samples, "weighted").collect()}
    small = {(a, b): d for a, b, d in D.blocked(m, c.samples, "weighted", block=4).collect()}
    assert len(small) == len(one)
    assert all(small[a, b] == pytest.approx(d, abs=1e-12) for a, b, d in one)


def test_zero_length_branches_do_not_count(spark, toy):
    more = toy.paths.selectExpr("feature_id", "edge_id + 1000 as edge_id", "0.0 as length").unionByName(toy.paths)
    assert values(E.exact(E.Community(toy.table, toy.samples, more))) == pytest.approx(KNOWN["unweighted"], abs=1e-6)


def test_no_match_is_an_error(spark, toy):
    other = toy.table.selectExpr("sample_id", "concat('x', feature_id) as feature_id", "value")
    with pytest.raises(ValueError):
        E.emd(E.Community(other, toy.samples, toy.paths))


@pytest.mark.parametrize("method", ["dmh", "tmh", "icws", "ers"])
@pytest.mark.parametrize("weighted", [False, True])
def test_sketches_estimate(toy, method, weighted):
    truth = np.array(KNOWN["weighted" if weighted else "unweighted"])
    errors = [np.array(values(E.approximate(toy, weighted, sketch=512, method=method, seed=s, bits=32))) - truth for s in range(4)]
    assert np.abs(np.mean(errors, axis=0)).max() < 0.05
    assert np.sqrt(np.mean(np.square(errors))) < 3 * 0.5 / np.sqrt(512)


def test_portable_sketches_do_not_depend_on_the_sample_set(spark, toy):
    def sig(c, portable):
        return {r["sample_id"]: r["signature"] for r in E.sketch(c, True, sketch=64, portable=portable).collect()}

    part = E.Community(toy.table.filter("sample_id <> 'B'"), toy.samples.filter("sample_id <> 'B'"), toy.paths)
    assert sig(part, True) == {k: v for k, v in sig(toy, True).items() if k != "B"}
    assert sig(part, False) != {k: v for k, v in sig(toy, False).items() if k != "B"}


def test_sketch_arguments(toy):
    for bad in ({"method": "ers", "portable": True}, {"raw_counts": True}, {"method": "ers", "length": 10}, {"method": "x"}, {"bits": 8}):
        with pytest.raises(ValueError):
            E.sketch(toy, sketch=16, **bad).collect()
    lone = E.Community(toy.table.filter("sample_id = 'A'"), toy.samples, toy.paths)
    with pytest.raises(ValueError):
        E.sketch(lone, sketch=16)


def test_truncated_ids(toy):
    ids = [x for r in E.sketch(toy, sketch=64, bits=16).collect() for x in r["signature"]]
    assert 0 <= min(ids) <= max(ids) < 1 << 16


def test_race_is_exact_on_average(toy):
    w = B.branch_weights(E.masses(toy, False))
    got = H.race_distances(H.race(w, 2048), toy.samples, 2048)
    assert values(got) == pytest.approx(KNOWN["unweighted"], abs=0.05)


def test_dense_table_with_negative_and_zero(spark, toy):
    extra = spark.createDataFrame([("A", "T2", 0.0), ("A", "T7", -4.0)], toy.table.schema)
    assert values(E.exact(E.Community(toy.table.unionByName(extra), toy.samples, toy.paths))) == pytest.approx(KNOWN["unweighted"], abs=1e-6)


def test_compare_without_variance(spark):
    rows = spark.createDataFrame([("a", "b", 1.0, 1.0), ("a", "c", 1.0, 2.0), ("b", "c", 1.0, 3.0)], "sample_i string, sample_j string, x double, y double")
    r = S.compare(rows).first()
    assert r["pearson"] is None and r["bias"] == 1.0 and r["max_abs_error"] == 2.0


def test_contributions_by_blocks(spark, monkeypatch):
    """Every pair and taxon with a difference, whatever the blocks; a sample without taxa differs by all of the other's."""
    monkeypatch.setattr(D, "CONTRIBUTION_BLOCK", 3)
    rng = np.random.default_rng(12)
    mass = {(f"s{i}", f"t{j}"): float(rng.integers(0, 4)) / 8 for i in range(7) for j in range(6) if i != 4}
    rows = [(s, t, v) for (s, t), v in mass.items() if v] + [("s0", "unknown", 0.5)]
    length = {f"t{j}": 0.5 + j for j in range(5)} | {"t5": 0.0}
    table = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    leaves = spark.createDataFrame(list(length.items()), "feature_id string, length double")
    samples = spark.createDataFrame([(f"s{i}", i) for i in range(7)], "sample_id string, sample_ordinal int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in D.contributions(table, leaves, samples).collect()}
    want = {}
    for i in range(7):
        for j in range(i + 1, 7):
            for t in ("t0", "t1", "t2", "t3", "t4"):
                d = mass.get((f"s{i}", t), 0.0) - mass.get((f"s{j}", t), 0.0)
                if d:
                    want[f"s{i}", f"s{j}", t] = (length[t], d, length[t] * abs(d))
    assert got == want
    assert D.contributions(table.limit(0), leaves, samples).count() == 0


@pytest.mark.parametrize("metric,alpha", [("unweighted", 0.5), ("weighted", 0.5), ("emd", 0.5), ("generalized", 0.5), ("generalized", 0.0), ("variance_adjusted", 0.5)])
@pytest.mark.parametrize("block", [4, 256])
def test_cells_do_not_matter(spark, monkeypatch, metric, alpha, block):
    """Branches dealt to many small cells add up to the same distances; no kernel holds many more entries than a cell's."""
    from pyspark.sql import functions as F

    c, _, _ = random_community(spark, np.random.default_rng(5), 9)
    m, totals = E.masses(c, metric != "unweighted"), B.totals(c.table)
    whole = {(a, b): d for a, b, d in D.blocked(m, c.samples, metric, alpha, totals, 3.0).collect()}
    assert len(whole) == 36
    monkeypatch.setattr(D, "CELL", 5)
    split = {(a, b): d for a, b, d in D.blocked(m, c.samples, metric, alpha, totals, 3.0, block).collect()}
    assert split == {p: pytest.approx(d, abs=1e-12) for p, d in whole.items()}
    query = c.samples.select("sample_id", (F.col("sample_ordinal") % 3 == 0).alias("is_query"))
    want = S.neighbours(D.blocked(m, c.samples, metric, alpha, totals, 3.0).withColumn("distance", F.round("distance", 9)), c.samples, query, 3)
    got = D.nearest(m, c.samples, query, 3, metric, alpha, totals, 3.0, block, 9)
    assert sorted(map(tuple, got.select("query", "neighbour", "rank").collect())) == sorted(map(tuple, want.select("query", "neighbour", "rank").collect()))


def test_blocks_meet_without_a_shuffle(spark):
    """Cells are read where they are stored, once for each two blocks, whichever has the lesser number."""
    cells = spark.createDataFrame([(b, c, f"{b}/{c}") for b in range(5) for c in range(2)], "b int, c int, what string").repartition(3)
    met = D.meetings(cells, ["c"], ["what"])
    assert "CartesianProduct" in met._jdf.queryExecution().toString() and "SortMergeJoin" not in met._jdf.queryExecution().toString()
    assert sorted((r["i_what"], r["j_what"]) for r in met.collect()) == sorted((f"{i}/{c}", f"{j}/{c}") for c in range(2) for i in range(5) for j in range(i, 5))


def test_a_race_neither_joins_nor_sorts_its_draws(spark, toy):
    plan = H.race(B.branch_weights(E.masses(toy, False)).localCheckpoint(), 64)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("method", [H.dart, H.tree])
def test_sketches_hold_few_branches_at_a_time(monkeypatch, method):
    """The same signature whatever the parts, and memory that does not grow with cells."""
    import tracemalloc

    rng = np.random.default_rng(6)
    edges, weights = rng.choice(1 << 40, 60_000, replace=False), rng.gamma(0.3, 1, 60_000) + 1e-9
    tracemalloc.start()
    want = method(edges, weights, 64, 3)
    assert tracemalloc.get_traced_memory()[1] < 40 << 20  # of darts: 88 MB in one piece
    tracemalloc.stop()
    monkeypatch.setattr(H, "PART", 7_001)
    assert (method(edges, weights, 64, 3) == want).all()


def test_pairs_and_contributions_of_many_blocks_are_not_dealt(spark, monkeypatch):
    """Rows of samples are shuffled once and not for every block, whatever the blocks; every pair stays."""
    monkeypatch.setattr(D, "CONTRIBUTION_BLOCK", 2)
    monkeypatch.setattr(D, "PAIRED", 3)
    samples = spark.createDataFrame([(f"s{i:02d}", i) for i in range(14)], "sample_id string, sample_ordinal int")
    table = spark.createDataFrame([(f"s{i:02d}", f"t{i % 4}", 1.0) for i in range(14)], "sample_id string, feature_id string, value double")
    leaves = spark.createDataFrame([(f"t{k}", 0.5) for k in range(4)], "feature_id string, length double")
    want = {(f"s{i:02d}", f"s{j:02d}") for i, j in itertools.combinations(range(14), 2)}
    pairs = D.sample_pairs(samples)
    assert sorted(map(tuple, pairs.select("sample_i", "sample_j").collect())) == sorted(want)
    rows = D.contributions(table, leaves, samples)
    got = {tuple(r)[:4] for r in rows.select("sample_i", "sample_j", "taxon", "contribution").collect()}
    assert got == {(i, j, f"t{int(s[1:]) % 4}", 0.5) for i, j in want for s in (i, j) if int(i[1:]) % 4 != int(j[1:]) % 4}
    for frame in (pairs, rows):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_contributions_leave_in_runs(spark):
    """By taxon, sample and the other's mass: equal differences of a sample follow one another, so stored results are small."""
    table = spark.createDataFrame([(f"s{i}", f"t{k}", float(v)) for i in range(8) for k, v in ((0, i % 3 + 1), (1, i % 2 + 1))], "sample_id string, feature_id string, value double")
    leaves = spark.createDataFrame([("t0", 0.5), ("t1", 2.0)], "feature_id string, length double")
    samples = spark.createDataFrame([(f"s{i}", i) for i in range(8)], "sample_id string, sample_ordinal int")
    rows = D.contributions(table, leaves, samples).collect()
    want = {(i, j, t) for i, j in itertools.combinations(range(8), 2) for t, n in (("t0", 3), ("t1", 2)) if i % n != j % n}
    assert sorted((int(r[0][1:]), int(r[1][1:]), r[2]) for r in rows) == sorted(want)
    groups = [(key, [r["signed_mass_difference"] for r in own]) for key, own in itertools.groupby(rows, lambda r: (r["taxon"], r["sample_i"]))]
    assert len({key for key, _ in groups}) == len(groups)
    assert all(signed == sorted(signed, reverse=True) for _, signed in groups)


def test_tasks_hold_few_cells(spark, tmp_path, monkeypatch):
    """Stored cells are as large as they are in memory, in row groups of few cells, and partitions of them are bounded."""
    import pyarrow.parquet as pq

    from cladeframe import session

    stored = session.materialise(spark.range(0, 8, 1, 1).selectExpr("id", "cast(repeat('x', 1000000) as binary) as v"), "long", block_bytes=2 << 20)
    metadata = pq.ParquetFile(next(f for f in stored.inputFiles()).removeprefix("file://")).metadata
    assert metadata.num_row_groups > 2 and metadata.row_group(0).column(1).total_compressed_size > 1_000_000
    c, _, _ = random_community(spark, np.random.default_rng(4), 23)
    monkeypatch.setattr(session, "READ_BYTES", 4 << 20)
    assert D.blocked(E.masses(c, True), c.samples, "weighted", block=4).count() == 253
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= 4 << 20
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("weighted", [False, True])
def test_rejection_sampling_has_no_limit_of_branches(spark, monkeypatch, weighted):
    """The signatures of one line of all caps, though no table of branches is sent to the driver or to tasks."""
    monkeypatch.setattr(H, "BROADCAST_ROWS", 3, raising=False)
    c, _, names = random_community(spark, np.random.default_rng(8), 12)
    k, length, seed = 64, 600, 5
    rows = B.branch_weights(E.masses(c, weighted)).select("sample_id", "edge_id", "weight").collect()
    got = {r["sample_id"]: r["signature"] for r in H.sketches(spark.createDataFrame(rows), c.samples, k, "ers", seed, 64, length).collect()}
    edges = sorted({r["edge_id"] for r in rows})
    cap = np.array([max(r["weight"] for r in rows if r["edge_id"] == e) for e in edges])
    line = np.cumsum(cap)
    at = H._unit(H.mix((np.arange(k)[:, None] * (1 << 20) + np.arange(length)).astype(np.uint64) ^ H.mix(np.full(1, (seed << 8) + 3, np.uint64)))) * line[-1]
    on = np.minimum(np.searchsorted(line, at), len(line) - 1)
    high = at - (line[on] - cap[on])
    assert sorted(got) == sorted(names)
    for name in names:
        weight = {r["edge_id"]: r["weight"] for r in rows if r["sample_id"] == name}
        hit = high < np.array([weight.get(e, 0.0) for e in edges])[on]
        first = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        want = np.zeros(k, np.int64)
        if hit.any():
            for slot in range(k):
                own, turn = slot, 0
                while first[own] < 0:
                    own, turn = int(H.mix(np.full(1, slot * 65537 + turn, np.uint64))[0] % np.uint64(k)), turn + 1
                want[slot] = H.mix(np.full(1, first[own] + (0 if own == slot else (own + 1) * length), np.uint64)).view(np.int64)[0]
        assert got[name] == want.tolist()

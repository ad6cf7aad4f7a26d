"""Sweeps, sinks of engines, streams of sketches and the registry."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cladeframe.plans import engines as E
from cladeframe.plans import sweeps
from cladeframe.sources import matrices
from cladeframe.streaming import incremental


@pytest.fixture(scope="module")
def star(spark):
    rows = [(f"s{i}", f"f{j}", float((i * j) % 5 + 1)) for i in range(5) for j in range(12) if (i + j) % 3]
    table = spark.createDataFrame(rows, "sample_id string, feature_id string, value double")
    samples = spark.createDataFrame([(f"s{i}", i) for i in range(5)], "sample_id string, sample_ordinal int")
    paths = spark.createDataFrame([(f"f{j}", j, 1.0) for j in range(12)], "feature_id string, edge_id long, length double")
    return E.Community(table, samples, paths)


def test_star_is_bray_curtis(star):
    v = {}
    for s, f, x in star.table.collect():
        v.setdefault(s, {})[f] = x
    share = {s: {f: x / sum(r.values()) for f, x in r.items()} for s, r in v.items()}
    for r in E.exact(star, "weighted").collect():
        a, b = share[r["sample_i"]], share[r["sample_j"]]
        want = sum(abs(a.get(f, 0) - b.get(f, 0)) for f in {*a, *b}) / 2
        assert r["distance"] == pytest.approx(want)


def test_sweep(star):
    out = sweeps.summarise(sweeps.sweep(star, E.exact(star), sizes=(32, 512), seeds=(1, 2, 3), portable=True)).orderBy("sketch_size").collect()
    assert [r["n"] for r in out] == [3, 3] and out[1]["mean"] < out[0]["mean"]
    with pytest.raises(ValueError):
        sweeps.sweep(star, E.exact(star), sizes=())


def test_written_contributions_and_factors(spark, star, tmp_path):
    leaf = star.paths.select("feature_id", "length")
    matrices.write_contributions(E.emd_contributions(star, leaf, True), f"{tmp_path}/c")
    back = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/c")
    assert back.columns == ["sample_i", "sample_j", "taxon", "edge_length", "signed_mass_difference", "contribution"]
    assert all(len(r["contribution"].split(".")[1]) == 12 for r in back.collect())
    matrices.write_factors(E.emd_factors(star, star.paths.select("feature_id", F.col("length").alias("depth")), True), f"{tmp_path}/f")
    assert {r[1] for r in spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/f").collect()} == {"1.000000000000"}


def test_stream_of_samples_gives_the_same_sketches(spark, star, tmp_path):
    for i in range(5):
        star.table.filter(F.col("sample_id") == f"s{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(star.table.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    names = star.samples

    def sketch(rows):
        own = names.join(rows.select("sample_id").distinct(), "sample_id", "left_semi")
        return E.sketch(E.Community(rows, own, star.paths), True, sketch=32, portable=True, least=1)

    got = {r["sample_id"]: r["signature"] for r in incremental.sketched_stream(stream, sketch).collect()}
    assert got == {r["sample_id"]: r["signature"] for r in E.sketch(star, True, sketch=32, portable=True).collect()}


def test_stream_of_parts_of_samples_gives_the_sketch_of_the_whole(spark, star, tmp_path):
    from cladeframe.operators import sketches

    odd = spark.createDataFrame([("s0", "nowhere", 1.0), ("lost", "nowhere", 1.0), ("none", None, 1.0)], star.table.schema)
    rows = star.table.unionByName(star.table.limit(3)).unionByName(odd)
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = lambda path: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = incremental.raced_stream(stream(f"{tmp_path}/in"), star.paths, 16).collect()
    present = star.table.filter("value > 0").join(star.paths, "feature_id").select("sample_id", "edge_id", star.paths["length"].alias("weight")).distinct()
    want = sketches.race(present, 16).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    (tmp_path / "empty").mkdir()
    assert incremental.raced_stream(stream(f"{tmp_path}/empty"), star.paths, 16).collect() == []


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"m1_unweighted", "m2_weighted", "m5_variance_adjusted"} <= set(sql)

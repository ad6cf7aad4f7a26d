"""Readers, writers and the Newick parser."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.sources import matrices, newick, onefile, tables


def test_newick_comments_labels_and_quotes():
    tree = newick.parse("((A:0.1,'b c':2[x[y]z])0.95:0.5,(,D:3)'in\\'ner'[k]:1,Ü)root;")
    assert [n for n, leaf in zip(tree.name, tree.leaf) if leaf] == ["A", "b c", "L5", "D", "Ü"]
    assert tree.parent == [-1, 0, 1, 1, 0, 4, 4, 0]
    assert tree.length[1] == pytest.approx(0.5) and tree.length[5] == 0
    again = newick.parse(newick.write(tree))
    assert (again.parent, again.name, again.leaf) == (tree.parent, tree.name, tree.leaf)


@pytest.mark.parametrize("text", ["((A,B);", "A)B;", "", "(A[x,B);", "('A,B);"])
def test_newick_errors(text):
    with pytest.raises(ValueError):
        newick.parse(text)


def test_newick_lengths_are_single_precision(spark):
    rows = newick.tree_nodes(spark, "(A:0.1,B:0.2):0.3;").orderBy("node_id").collect()
    assert rows[1]["length"] == 0.10000000149011612
    assert [r["post"] for r in rows] == [2, 1, 2]
    assert newick.tree_nodes(spark, "(A:0.1,B:0.2):0.3;", include_root_length=False).first()["length"] == 0


def test_last_of_equal_leaf_names_counts(spark):
    paths = newick.tree_paths(newick.tree_nodes(spark, "(A:1,(A:2,B:1):4);"))
    assert sorted(r["length"] for r in paths.filter("feature_id = 'A'").collect()) == [2.0, 4.0]


def test_closure_matches_paths(spark):
    nodes = newick.tree_nodes(spark, "((A:1,(B:1,(C:1,D:1):1):1):1,E:1):1;")
    leaf = nodes.filter("is_leaf").selectExpr("node_id", "explode(path) as edge_id")
    reach = newick.closure(spark, nodes.select("node_id", "parent_id"))
    got = {tuple(r) for r in reach.join(nodes.filter("is_leaf").select("node_id"), "node_id").collect()}
    assert got == {tuple(r) for r in leaf.collect()}


def test_dense_table(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes(b"#OTU\ts1\ts2\ts3\r\nA\t1\t0\tx\r\nB\t-2\t3.5\t\r\n")
    long, samples = tables.read_dense(spark, str(tmp_path / "t.tsv"))
    assert {tuple(r) for r in long.collect()} == {("s1", "A", 1.0), ("s2", "B", 3.5)}
    assert [r[0] for r in samples.orderBy("sample_ordinal").collect()] == ["s1", "s2", "s3"]
    assert {r[2] for r in tables.read_dense(spark, str(tmp_path / "t.tsv"), presence=True)[0].collect()} == {1.0}


def test_dense_table_rows_like_the_header(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("T\t1\t2\nT\t1\t2\nU\t0\t3\n")
    long, _ = tables.read_dense(spark, str(tmp_path / "t.tsv"))
    assert {tuple(r) for r in long.collect()} == {("1", "T", 1.0), ("2", "T", 2.0), ("2", "U", 3.0)}


def test_paths_of_a_chain_and_of_a_ladder(spark):
    """A chain of 10,000 inner nodes, and leaves that hang from a chain, one at each node."""
    paths = newick.tree_paths(newick.tree_nodes(spark, "(" * 10000 + "A:1" + "):1" * 10000 + ";"))
    assert paths.count() == 10001
    assert paths.distinct().count() == 10001
    n = 600
    ladder = "(" * n + "L0:1" + "".join(f",L{i}:1):1" for i in range(1, n + 1)) + ";"
    got = {r["feature_id"]: r["n"] for r in newick.tree_paths(newick.tree_nodes(spark, ladder)).groupBy("feature_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {f"L{i}": n - max(i, 1) + 2 for i in range(n + 1)}
    assert "path" not in newick.tree_nodes(spark, ladder).drop("path")._jdf.queryExecution().optimizedPlan().toString()


class Stored(dict):
    """What the BIOM reader asks of an HDF5 file, from arrays by path."""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def __getitem__(self, path):
        held = dict.__getitem__(self, path)
        return type("Data", (), {"__getitem__": lambda _, key: held})()


@pytest.mark.parametrize("group", ["observation/matrix", "observation"])
@pytest.mark.parametrize("width", [np.int32, np.int64])
def test_biom_table(spark, monkeypatch, group, width):
    file = Stored({
        "observation/ids": np.array([b"A", b"B"], object), "sample/ids": np.array(["x", "y", "z"], object),
        f"{group}/indptr": np.array([0, 2, 3], width), f"{group}/indices": np.array([0, 2, 1], width), f"{group}/data": np.array([1, 0, 4], np.float32),
    })
    monkeypatch.setitem(sys.modules, "h5py", type("H5", (), {"File": staticmethod(lambda path, mode: file)}))
    long, samples = tables.read_feature_table(spark, "table.biom")
    assert {tuple(r) for r in long.collect()} == {("x", "A", 1.0), ("y", "B", 4.0)}
    assert [r["sample_id"] for r in samples.orderBy("sample_ordinal").collect()] == ["x", "y", "z"]
    present = tables.read_feature_table(spark, "table", kind="biom", presence=True)[0]
    assert {tuple(r) for r in present.collect()} == {("x", "A", 1.0), ("z", "A", 1.0), ("y", "B", 1.0)}
    file[f"{group}/indices"] = np.array([0, 2, 7], width)
    with pytest.raises(ValueError):
        tables.read_feature_table(spark, "table.biom")


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        tables.read_feature_table(spark, "x.tsv", kind="csv")


@pytest.mark.parametrize("text", ["#\ta\tb\nT\t1\n", "#\n", "#\ta\ta\nT\t1\t2\n", "#\ta\tb\n", ""])
def test_dense_table_errors(spark, tmp_path, text):
    (tmp_path / "t.tsv").write_text(text)
    with pytest.raises(ValueError):
        tables.read_dense(spark, str(tmp_path / "t.tsv"))


@pytest.mark.parametrize(
    "indptr, indices", [([0, 1], [0, 1]), ([1, 1, 2], [0, 1]), ([0, 2, 1], [0]), ([0, 1, 2], [0, 5]), ([0, 1], [0])]
)
def test_csr_validation(indptr, indices):
    with pytest.raises(ValueError):
        tables.validate_csr(indptr, indices, 2, 3)


def test_csr_to_table(spark):
    rows = tables.from_csr(spark, ["A", "B"], ["x", "y", "z"], [0, 2, 3], [0, 2, 1], [1.0, 0.0, 4.0]).collect()
    assert {tuple(r) for r in rows} == {("x", "A", 1.0), ("y", "B", 4.0)}


def _random_matrix(n):
    rng = random.Random(n)
    names = [f"s{k}" for k in rng.sample(range(100), n)]
    half = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n)}
    cell = lambda i, j: 0.0 if i == j else half[min(i, j), max(i, j)]
    return names, half, [[repr(cell(i, j)) for j in range(n)] for i in range(n)]


def _matrix_text(names, rows, order, end="\n"):
    return end.join(["\t".join(["", *names]), *("\t".join([names[i], *rows[i]]) for i in order)]) + end


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10])
def test_matrix_by_tiles(spark, tmp_path, n):
    """Tiles that do and do not divide the matrix; rows in any order; blank lines and either line end."""
    names, half, rows = _random_matrix(n)
    order = random.Random(1).sample(range(n), n)
    (tmp_path / "m.tsv").write_bytes(("\r\n" + _matrix_text(names, rows, order, "\r\n") + "\t\r\n").encode())
    pairs, samples = matrices.read_matrix(spark, f"{tmp_path}/m.tsv", tile=3)
    assert [r[0] for r in samples.orderBy("sample_ordinal").collect()] == names
    got = {(r["sample_i"], r["sample_j"]): r["distance"] for r in pairs.collect()}
    assert got == {(names[i], names[j]): d for (i, j), d in half.items()}


@pytest.mark.parametrize(
    ("at", "value", "told"),
    [((6, 1), "0.5", "2 asymmetric cells, 0 on"), ((4, 5), "9", "2 asymmetric"), ((5, 5), "0.1", "0 asymmetric cells, 1 on"), ((0, 6), "x", "1 cells"), ((6, 0), "nan", "1 cells"), ((4, 3), "", "1 cells")],
)
def test_matrix_errors_by_tiles(spark, tmp_path, at, value, told):
    names, _, rows = _random_matrix(7)
    rows[at[0]][at[1]] = value
    (tmp_path / "m.tsv").write_text(_matrix_text(names, rows, range(7)))
    with pytest.raises(ValueError, match=told):
        matrices.read_matrix(spark, f"{tmp_path}/m.tsv", tile=3)


@pytest.mark.parametrize("text", ["\ta\tb\na\t0\t1\n", "\ta\tb\na\t0\t1\nc\t1\t0\n", "\ta\tb\na\t0\t1\na\t0\t1\n", "\ta\ta\na\t0\t1\na\t1\t0\n", "\ta\tb\na\t0\t1\nb\t1\n", "\ta\tb\na\t0\t1\nb\t1\t0\t0\n"])
def test_matrix_ids_must_agree(spark, tmp_path, text):
    (tmp_path / "m.tsv").write_text(text)
    with pytest.raises(ValueError, match="ids differ"):
        matrices.read_matrix(spark, f"{tmp_path}/m.tsv")


def test_one_file_from_many_tasks(spark, tmp_path):
    """Frames of several tasks are one valid file, byte for byte the text in order, and nothing else is left."""
    import zstandard

    lines = [(i, f"line {i} é " + "x" * (i % 50)) for i in range(-1, 999)]
    want = "".join(f"{t}\n" for _, t in lines).encode()
    table = spark.createDataFrame(random.Random(3).sample(lines, len(lines)) + [(5000, None)], "i long, line string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        onefile.write_lines(table, f"{tmp_path}/t.zst")
        onefile.write_lines(table, f"{tmp_path}/t.txt", "none")
        onefile.write_lines(table.limit(0), f"{tmp_path}/t.txt.empty", "none")
        onefile.write_lines(table, f"file://{tmp_path}/t.txt", "none")  # an address, and a file that is there already
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    data = (tmp_path / "t.zst").read_bytes()
    assert data.count(b"\x28\xb5\x2f\xfd") > 1
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == want
    assert (tmp_path / "t.txt").read_bytes() == want and (tmp_path / "t.txt.empty").read_bytes() == b""
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t.txt", "t.txt.empty", "t.zst"]
    with pytest.raises(ValueError, match="unknown compression"):
        onefile.write_lines(table, f"{tmp_path}/u", "lzma")


def test_one_file_of_a_task_that_fails(spark, tmp_path):
    broken = F.udf(lambda i: 1 // (7 - i), "long")
    table = spark.range(20).select(F.col("id").alias("i"), broken("id").cast("string").alias("line"))
    with pytest.raises(Exception, match="ZeroDivisionError"):
        onefile.write_lines(table, f"{tmp_path}/t.zst")
    assert list(tmp_path.iterdir()) == []


def test_matrix_round_trip_and_validation(spark, tmp_path):
    samples = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "sample_id string, sample_ordinal int")
    d = spark.createDataFrame([("b", "a", 0.25), ("b", "c", 0.5), ("a", "c", 1 / 3)], "sample_i string, sample_j string, distance double")
    matrices.write_matrix(d, samples, f"{tmp_path}/m")
    back, order = matrices.read_matrix(spark, f"{tmp_path}/m")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in d.collect()}
    assert [r[0] for r in order.orderBy("sample_ordinal").collect()] == ["b", "a", "c"]
    matrices.write_matrix_blocks(d, samples, f"{tmp_path}/blocks", 2)
    assert spark.read.text(f"{tmp_path}/blocks").count() == 4
    name = matrices.compressed_matrix(d, samples, f"{tmp_path}/m.tsv", digits=3)
    import zstandard

    assert name.endswith(".zst")
    with open(name, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f).read().decode().split("\n")[1] == "b\t0.000\t0.250\t0.500"
    (tmp_path / "bad.tsv").write_text("\ta\tb\na\t0\t1\nb\t2\t0\n")
    with pytest.raises(ValueError, match="asymmetric"):
        matrices.read_matrix(spark, f"{tmp_path}/bad.tsv")
    assert matrices.read_matrix(spark, f"{tmp_path}/bad.tsv", strict=False)[0].first()["distance"] == 1.5
    (tmp_path / "nan.tsv").write_text("\ta\tb\na\t0\tx\nb\t2\t0\n")
    with pytest.raises(ValueError, match="no numbers"):
        matrices.read_matrix(spark, f"{tmp_path}/nan.tsv")


def test_ordination_text_round_trip():
    text = matrices.pcoa_text(["a", "b"], [[0.1, -2.0], [3.5, 0.0]], [0.75, 0.25])
    assert matrices.parse_pcoa_text(text) == (["a", "b"], [[0.1, -2.0], [3.5, 0.0]], [0.75, 0.25])
    assert "Site\t2\t2" in matrices.ordination_text(["a", "b"], [[0.1, -2.0], [3.5, 0.0]], [3.0, 1.0], [0.75, 0.25])


def test_metadata_bench_and_logs(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("SampleID\tClimate\na\twet\n")
    assert tuple(matrices.read_metadata(spark, f"{tmp_path}/m.tsv", "Climate").first()) == ("a", "wet")
    with pytest.raises(ValueError):
        matrices.read_metadata(spark, f"{tmp_path}/m.tsv", "Country")
    (tmp_path / "b.csv").write_text("samples;seconds\n10;1.5\n")
    assert tuple(matrices.read_bench(spark, f"{tmp_path}/b.csv", ["seconds"]).first()) == (10, 1.5)
    lines = ["[2024-01-01T00:00:00Z INFO] nodes = 3", "[2024-01-01T00:00:02.5Z INFO] pairwise distances", "noise"]
    assert matrices.log_seconds(spark.createDataFrame([(x,) for x in lines], "value string")).first()["seconds"] == 2.5
    assert matrices.log_seconds(spark.createDataFrame([("noise",)], "value string")).first()["seconds"] is None


def test_ordinals(spark):
    got = matrices.ordinals(spark.createDataFrame([(f"s{i:03d}",) for i in range(97)], "sample_id string").repartition(5))
    assert [tuple(r) for r in got.orderBy("sample_id").collect()] == [(f"s{i:03d}", i) for i in range(97)]

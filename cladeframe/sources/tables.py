"""Feature tables: dense text, sparse arrays, and their validation.

The long form is ``feature_table(sample_id, feature_id, value)`` with positive values; sample order is kept in
``samples(sample_id, sample_ordinal)``. A cell that is no number counts as 0; zeros and negative values are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dense(spark: SparkSession, path: str, presence: bool = False) -> tuple[DataFrame, DataFrame]:
    """A tab-separated table with taxa in rows: the long table and the sample order.

    The first header cell is ignored. Rows of another width than the header, and tables without samples or taxa, are
    errors. Files may have either kind of line end.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("at"))
    header = lines.first()
    if header is None:
        raise ValueError("the table is empty")
    names = header[0].split("\t")[1:]
    if not names:
        raise ValueError("the table names no samples")
    if len(set(names)) != len(names):
        raise ValueError("sample names repeat")
    cells = lines.filter(F.col("at") != header[1]).select(F.split("value", "\t", -1).alias("c"))
    if cells.isEmpty():
        raise ValueError("the table has no taxa")
    wrong = cells.filter(F.size("c") != len(names) + 1).limit(1).collect()
    if wrong:
        raise ValueError(f"a row has {len(wrong[0][0]) - 1} values for {len(names)} samples: {wrong[0][0][0]!r}")
    samples = spark.createDataFrame(list(enumerate(names)), "sample_ordinal int, sample_id string").select("sample_id", "sample_ordinal")
    value = F.coalesce(F.expr("try_cast(trim(v) as double)"), F.lit(0.0))
    long = (
        cells.select(F.col("c")[0].alias("feature_id"), F.posexplode(F.slice("c", 2, len(names))).alias("sample_ordinal", "v"))
        .withColumn("value", F.when(value > 0, F.lit(1.0)).otherwise(F.lit(0.0)) if presence else value)
        .filter("value > 0")
        .join(F.broadcast(samples), "sample_ordinal")  # one row for each column of the file
        .select("sample_id", "feature_id", "value")
    )
    return long, samples


def from_wide(wide: DataFrame, feature_col: str, presence: bool = False) -> DataFrame:
    """A DataFrame with taxa in rows and samples in columns, as a long table."""
    names = [c for c in wide.columns if c != feature_col]
    text = wide.select(F.col(feature_col).alias("feature_id"), *(F.col(f"`{c}`").cast("string").alias(c) for c in names))
    long = text.unpivot("feature_id", [F.col(f"`{c}`") for c in names], "sample_id", "v")
    value = F.coalesce(F.expr("try_cast(trim(v) as double)"), F.lit(0.0))
    long = long.withColumn("value", value).filter("value > 0")
    return long.select("sample_id", "feature_id", F.lit(1.0).alias("value") if presence else "value")


def validate_csr(indptr: list[int], indices: list[int], rows: int, columns: int, values: list[float] | None = None) -> None:
    if len(indptr) != rows + 1:
        raise ValueError(f"indptr has {len(indptr)} entries for {rows} rows")
    if indptr[0] != 0:
        raise ValueError("indptr does not begin with 0")
    if indptr[-1] != len(indices):
        raise ValueError(f"indptr ends with {indptr[-1]}; there are {len(indices)} indices")
    if values is not None and len(values) != len(indices):
        raise ValueError(f"{len(values)} values for {len(indices)} indices")
    if any(b < a for a, b in zip(indptr, indptr[1:], strict=False)):
        raise ValueError("indptr decreases")
    if indices and not 0 <= min(indices) <= max(indices) < columns:
        raise ValueError(f"an index lies outside 0 .. {columns - 1}")


def from_csr(
    spark: SparkSession, taxa: list[str], samples: list[str], indptr: list[int], indices: list[int], values: list[float] | None = None
) -> DataFrame:
    """Compressed sparse rows (taxa by samples) as a long table. Without values every stored entry is a presence."""
    validate_csr(indptr, indices, len(taxa), len(samples), values)
    arrays = [(t, indices[a:b], (values[a:b] if values is not None else [1.0] * (b - a))) for t, a, b in zip(taxa, indptr, indptr[1:], strict=False)]
    frame = spark.createDataFrame(arrays, "feature_id string, i array<int>, v array<double>")
    names = spark.createDataFrame(list(enumerate(samples)), "j int, sample_id string")
    each = frame.select("feature_id", F.explode(F.arrays_zip("i", "v")).alias("z")).select("feature_id", F.col("z.i").alias("j"), F.col("z.v").alias("value"))
    return each.filter("value > 0").join(names, "j").select("sample_id", "feature_id", "value")


def to_csc(long: DataFrame) -> DataFrame:
    """Per sample: its features and values in order of feature."""
    return long.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("feature_id", "value"))).alias("entries")).select(
        "sample_id", F.col("entries.feature_id").alias("features"), F.col("entries.value").alias("values")
    )


def read_biom(spark: SparkSession, path: str, presence: bool = False) -> tuple[DataFrame, DataFrame]:
    """A BIOM file in HDF5 (a local file; the h5py library must be there): the long table and the sample order."""
    try:
        import h5py
    except ImportError as missing:
        raise ImportError("reading BIOM files needs h5py") from missing
    with h5py.File(path, "r") as f:
        group = "observation/matrix" if "observation/matrix/indptr" in f else "observation"
        text = lambda name: [x.decode() if isinstance(x, bytes) else str(x) for x in f[name][()]]
        taxa, samples = text("observation/ids"), text("sample/ids")
        indptr, indices = f[f"{group}/indptr"][()].astype(int).tolist(), f[f"{group}/indices"][()].astype(int).tolist()
        values = None if presence else f[f"{group}/data"][()].astype(float).tolist()
    order = spark.createDataFrame(list(enumerate(samples)), "sample_ordinal int, sample_id string").select("sample_id", "sample_ordinal")
    return from_csr(spark, taxa, samples, indptr, indices, values), order


def read_feature_table(spark: SparkSession, path: str, kind: str = "auto", presence: bool = False) -> tuple[DataFrame, DataFrame]:
    """Dense text or BIOM, by ``kind`` or by the file's extension."""
    if kind == "auto":
        kind = "biom" if path.lower().endswith((".biom", ".h5", ".hdf5")) else "tsv"
    if kind not in ("tsv", "biom"):
        raise ValueError(f"unknown format {kind!r}")
    return (read_biom if kind == "biom" else read_dense)(spark, path, presence)


def deep_enough(long: DataFrame, depth: float) -> DataFrame:
    """Rows of samples whose total reaches ``depth``."""
    totals = long.groupBy("sample_id").agg(F.sum("value").alias("total")).filter(F.col("total") >= depth)
    return long.join(totals.select("sample_id"), "sample_id", "left_semi")

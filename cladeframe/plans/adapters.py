"""Communities from business tables: a catalogue, a geography, a star of events, and a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.plans.engines import Community


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paths(rows: DataFrame, steps: list) -> DataFrame:
    """``feature_id, edge_id, length`` from a leaf's columns: a struct of edge and length for each step."""
    return rows.select("feature_id", F.explode(F.array(*steps)).alias("s")).select("feature_id", "s.edge_id", "s.length").filter("length > 0")


def _edge(edge, length) :
    return F.struct(edge.cast("long").alias("edge_id"), length.cast("double").alias("length"))


def catalogue_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand (0.1), type in brand (0.05) and part (price / 10000). Inner edges have negative ids made of small codes."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    code = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    leaf = part.select(F.col("p_partkey").cast("string").alias("feature_id"), "*")
    return _paths(
        leaf,
        [
            _edge(-1 - code(F.col("p_brand")), F.lit(0.1)),
            _edge(-(1 << 33) - code(F.concat_ws("|", "p_brand", "p_type")), F.lit(0.05)),
            _edge(F.col("p_partkey"), F.col("p_retailprice") / 10000),
        ],
    )


def numbered(names: DataFrame) -> DataFrame:
    from cladeframe.sources.matrices import ordinals

    return ordinals(names)


def suppliers(spark: SparkSession, sf_dir: str) -> Community:
    """Suppliers as samples: quantities of parts."""
    sold = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("sample_id"), F.col("l_partkey").cast("string").alias("feature_id")).agg(F.sum("l_quantity").alias("value"))
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sample_id"))
    return Community(sold, numbered(names), catalogue_paths(spark, sf_dir))


def nations(spark: SparkSession, sf_dir: str) -> Community:
    """Supplier nations as samples."""
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    home = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    name = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sample_id"))
    sold = line.join(home, "l_suppkey").join(name, "s_nationkey").groupBy("sample_id", F.col("l_partkey").cast("string").alias("feature_id")).agg(F.sum("l_quantity").alias("value"))
    return Community(sold, numbered(name.select("sample_id")), catalogue_paths(spark, sf_dir))


def users(spark: SparkSession, sf_dir: str) -> Community:
    """Users as samples of event types on a star of unit branches (so: Jaccard and Bray-Curtis)."""
    seen = read(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("sample_id"), F.col("event_type").alias("feature_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    star = seen.select("feature_id").distinct().select("feature_id", F.conv(F.substring(F.md5("feature_id"), 1, 8), 16, 10).cast("long").alias("edge_id"), F.lit(1.0).alias("length"))
    return Community(seen, numbered(seen.select("sample_id").distinct()), star)


def markets(spark: SparkSession, sf_dir: str) -> Community:
    """Order priority and year as samples of customers, on region (0.5), nation (0.3) and customer (0.2)."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    table = orders.groupBy(F.concat_ws("|", "o_orderpriority", F.col("y").cast("string")).alias("sample_id"), F.col("o_custkey").cast("string").alias("feature_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    leaf = read(spark, sf_dir, "customer").join(nation, "c_nationkey").select(F.col("c_custkey").cast("string").alias("feature_id"), "c_custkey", "c_nationkey", "n_regionkey")
    paths = _paths(leaf, [_edge(-1 - F.col("n_regionkey"), F.lit(0.5)), _edge(-1000 - F.col("c_nationkey"), F.lit(0.3)), _edge(F.col("c_custkey"), F.lit(0.2))])
    return Community(table, numbered(table.select("sample_id").distinct()), paths)


def corpus(spark: SparkSession, sf_dir: str) -> Community:
    """Sources as samples of words on a star of unit branches. A word is a run of bytes other than ASCII white space."""
    words = read(spark, sf_dir, "documents").select(F.col("source").alias("sample_id"), F.explode(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")).alias("feature_id")).filter("feature_id <> ''")
    table = words.groupBy("sample_id", "feature_id").agg(F.count(F.lit(1)).cast("double").alias("value"))
    star = table.select("feature_id").distinct().select("feature_id", F.conv(F.substring(F.md5("feature_id"), 1, 15), 16, 10).cast("long").alias("edge_id"), F.lit(1.0).alias("length"))
    return Community(table, numbered(table.select("sample_id").distinct()), star)

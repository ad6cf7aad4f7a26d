"""Incremental community tables with Structured Streaming.

Totals are a stateful aggregation. Sketches of whole samples are portable, so a stream of new samples is sketched
batch by batch and appended to the kept ones; nothing earlier is computed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.session import shared_folder


def drain(stream: DataFrame, name: str, mode: str = "update", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it emitted, with the batch in ``batch``.

    A batch writes to a folder of its own, replacing it if the batch is repeated.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schemas: list = []

    def emit(rows: DataFrame, batch: int) -> None:
        out = each(rows, batch) if each else rows
        schemas.append(out.schema)
        out.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/marks").trigger(availableNow=True).foreachBatch(emit).start()
    query.awaitTermination()
    if not schemas:
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schemas[0].add("batch", T.IntegerType())).parquet(f"{base}/out")


def running_totals(spark: SparkSession, path: str, sample: str, value: str, files_per_batch: int = 1) -> DataFrame:
    """``sample_id, total, n`` after all files under ``path``: the last state of each sample."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    totals = rows.groupBy(F.col(sample).cast("string").alias("sample_id")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    changes = drain(totals, "totals")
    return changes.groupBy("sample_id").agg(F.max_by("total", "batch").alias("total"), F.max("n").alias("n"))


def windowed_totals(spark: SparkSession, path: str, time: str, key: str, value: str, window: str = "1 day", late: str = "1 day", files_per_batch: int | None = None) -> DataFrame:
    """``window_start, key, n, total`` by event time. A watermark bounds the state; all windows are emitted as they change.

    Files are taken by age, ``files_per_batch`` at a time (None: all). A row is dropped if its window has been closed: if the
    window ended ``late`` before the latest time of the batches but for the last one, when the row's batch begins.
    """
    schema = spark.read.parquet(path).schema
    files = spark.readStream.schema(schema)
    files = files.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else files
    rows = files.parquet(path).withWatermark(time, late)
    grouped = rows.groupBy(F.window(time, window).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    changes = drain(grouped.select(F.col("w.start").alias("window_start"), "key", "n", "total"), "windows")
    return changes.groupBy("window_start", "key").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


def sketched_stream(stream: DataFrame, sketch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sketches of the samples in a stream of feature rows. A sample's rows must come in one batch."""
    return drain(stream, "sketched", "append", lambda rows, _: sketch(rows))


def raced_stream(stream: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """``sample_id, slot, edge_id``: presence sketches of samples whose feature rows may come in any batches.

    A batch leaves the minimum of each slot over its own rows; the minima of all batches merge by the lesser, so any
    split of the rows, repeated rows and repeated batches give the sketch of the whole. Rows without a positive value, or
    of features outside the tree, do not count; a sample without others has no sketch. No rows at all give none.
    """
    from cladeframe.operators.sketches import race_minima

    def minima(rows: DataFrame, _: int) -> DataFrame:
        present = rows.filter("value > 0").select("sample_id", "feature_id").join(paths, "feature_id")
        return race_minima(present.select("sample_id", "edge_id", F.col("length").alias("weight")).distinct(), k)

    kept = drain(stream, "raced", "append", minima)
    if "m" not in kept.columns:  # no batch at all
        return stream.sparkSession.createDataFrame([], "sample_id string, slot int, edge_id long")
    whole = kept.groupBy("sample_id", "slot").agg(F.min("m").alias("m"))
    return whole.select("sample_id", "slot", F.col("m.edge_id").alias("edge_id"))

"""Exact deduplication by stateful streaming, in DataFrame operations only.

A streaming query over the digest log keeps one row of state per digest in RocksDB, without expiry: the number of
copies and the row that stays (its identifier and content locator). What the state says is then checked on the texts
themselves: wherever a digest was hit more than once, all its texts must be byte for byte equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm import workspace

_STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    # many small stores: preallocated logs would take more disk than the state
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # stores of a finished query are closed soon, not within a minute
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

#: The row that stays is the greatest of these: largest identifier, then latest row of the log.
_KEEPER = ("id", "row", "locator")


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def digest_log(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row for each document, written to ``path``: digest, length, identifier, row number, locator.

    The locator names the file the text was read from ('' where rows do not come straight from files).
    """
    content = _bytes(text_col)
    log = docs.select(
        F.unhex(F.sha2(content, 256)).alias("digest"),
        F.octet_length(content).cast("long").alias("bytes"),
        F.col(id_col).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.input_file_name().alias("locator"),
    )
    log.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(log.schema).parquet(path)


def stream_state(spark: SparkSession, log: DataFrame, log_path: str, max_bytes_per_trigger: int) -> DataFrame:
    """Final state of the streaming query over the log: digest, size, keeper."""
    out, marks = workspace.new_path(spark, "state"), workspace.new_path(spark, "stream")
    session = spark.newSession()
    for key, value in _STREAM_CONF.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", workspace.shuffle_width(spark))

    def emit(changed: DataFrame, batch: int) -> None:
        # overwriting a folder of its own makes a repeated batch harmless
        changed.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={batch}")

    query = (
        session.readStream.schema(log.schema)
        .option("maxBytesPerTrigger", max_bytes_per_trigger)
        .parquet(log_path)
        .groupBy("digest", "bytes")
        .agg(F.count(F.lit(1)).alias("size"), F.max(F.struct(*_KEEPER)).alias("keeper"))
        .writeStream.outputMode("update")
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .foreachBatch(emit)
        .start()
    )
    query.awaitTermination()
    state = T.StructType.fromDDL(
        "digest binary, bytes long, size long, keeper struct<id: long, row: long, locator: string>, batch int"
    )
    if query.lastProgress is None:  # no batch ran
        return spark.createDataFrame([], state).drop("batch")
    changes = spark.read.schema(state).parquet(out)
    # size and keeper only ever grow, so the last change of a digest is its largest; written, so that the join with it
    # has plain exchanges on both sides, which Spark splits where one digest has many rows
    return workspace.materialise(changes.groupBy("digest", "bytes").agg(F.max("size").alias("size"), F.max("keeper").alias("keeper")), "state")


def _differing(docs: DataFrame, text_col: str) -> DataFrame:
    """Digests whose texts are not all equal. Texts are compared whole; copies meet in the map-side aggregate."""
    content = _bytes(text_col)
    return (
        docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(content).cast("long").alias("bytes"), content.alias("content"))
        .groupBy("digest", "bytes")
        .agg(F.min("content").alias("low"), F.max("content").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("digest", "bytes")
    )


def decide(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes_per_trigger: int = 4 << 30
) -> DataFrame:
    """For every row: id, keep_id, group_size, kept, digest, row.

    Texts are equal when their bytes are; null counts as empty, so null and empty texts form one group. The row with
    the largest id stays; a null id is less than any other, and of rows with equal text and id exactly one stays.
    An empty table gives an empty result. Any text column length is compared whole.
    """
    spark = docs.sparkSession
    log_path = workspace.new_path(spark, "digests")
    log = digest_log(docs, log_path, id_col, text_col)
    state = stream_state(spark, log, log_path, max_bytes_per_trigger)
    collided = workspace.materialise(_differing(docs, text_col), "differing")
    if not collided.isEmpty():
        raise ValueError("two different texts share a SHA-256 digest and a length; their groups cannot be told apart")
    return log.join(state, ["digest", "bytes"]).select(
        "id",
        F.col("keeper.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keeper.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
        F.col("keeper.locator").alias("keep_locator"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the row that stays for its text, the size of its group and the text's SHA-256.

    Null and empty texts are one group. Rows with null or repeated ids stand for themselves, as :func:`decide` says; a
    text of any length is compared whole. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decide(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged. Same rules as :func:`decide`."""
    since = workspace.mark()
    decisions = workspace.materialise(decide(docs, id_col, text_col), "exact")
    workspace.discard(docs.sparkSession, since)
    stay = decisions.filter("kept").select(F.col("id").alias("keep_id"), "text_sha256")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.sha2(_bytes(text_col), 256).alias("digest"))
    kept = rows.join(stay, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("text_sha256")), "left_semi")
    repeated = decisions.filter(F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("kept"))
    if not repeated.isEmpty():  # rows repeated with id and text: one of each
        kept = kept.dropDuplicates(["digest"])
    return kept.select("row.*")

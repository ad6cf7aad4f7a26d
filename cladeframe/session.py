"""Sessions, the shared folder for intermediate tables, and bounds that plans check before they broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Largest number of rows that a plan marks for broadcast, and only after counting them.
BROADCAST_ROWS = 2_000_000
#: Bytes of one Arrow batch handed to a kernel.
BATCH_BYTES = 4 << 20
#: Bytes of a stored table's partition where tasks hold one whole.
READ_BYTES = 64 << 20


def build(app: str = "cladeframe", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for; on a cluster, use the cluster's own."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where none is set, as in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cladeframe-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that long rows cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bounded_reads(spark: SparkSession) -> None:
    """Bound partitions of stored tables by ``READ_BYTES``: with the session's default, a large table's files are packed to 128 MB."""
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if most > READ_BYTES:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(READ_BYTES))


def materialise(df: DataFrame, name: str, block_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back, with its lineage cut.

    Long rows go in row groups of ``block_bytes``, as they are: compressed, a small file may be any size in memory.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "none" if block_bytes else "zstd")
    if block_bytes:  # Parquet looks at a group's size only after 100 rows otherwise
        writer = writer.option("parquet.block.size", block_bytes).option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

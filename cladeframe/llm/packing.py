"""Best-fit packing under conflicts.

Documents longer than a bin are cut into full bins and a rest. Rests and shorter documents are packed by decreasing
length: each goes to the fullest bin that has room and holds neither its source nor its duplicate cluster. Bins are
ordered by residual room; each carries a bitmap of sources and one of clusters, with a bit for every source and cluster
that could conflict in its shard, so the bits are exact. The search goes from the tightest bin upwards until one is
compatible (of equally tight ones, the first opened). A tree over residuals keeps the bits that all bins below a node
share, so the search steps over whole ranges of bins that conflict anyway.

Documents are dealt to shards of bounded size by a hash of their id, and each shard is packed on its own: every
document is packed, and no task holds more than a shard.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import textkernels as tk
from cladeframe.llm import workspace
from cladeframe.llm.substring import keyed

CAPACITY = 2048
SHARD_DOCUMENTS = 20_000
_ALL = -1  # all bits of a bitmap of any width
_NONE = 1  # a bit that no bin has: what asks for it passes over residuals without bins


class Bins:
    """Open bins by residual room, with the search for the tightest compatible one."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.shared_source = [_ALL] * (2 * self.size)
        self.shared_cluster = [_ALL] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _refresh(self, residual: int) -> None:
        source = cluster = _ALL
        for b in self.at[residual]:
            source &= self.sources[b]
            cluster &= self.clusters[b]
            if not source | cluster:
                break
        a, c, i = self.shared_source, self.shared_cluster, self.size + residual
        while i and (a[i] != source or c[i] != cluster):
            a[i], c[i] = source, cluster
            i >>= 1
            if not i:
                break
            source, cluster = a[2 * i] & a[2 * i + 1], c[2 * i] & c[2 * i + 1]

    def _next(self, residual: int, source: int, cluster: int) -> int:
        """The least residual of at least this that may hold a compatible bin, or -1."""
        a, c, i = self.shared_source, self.shared_cluster, self.size + residual
        while a[i] & source or c[i] & cluster:
            while i & 1:  # up while a right child
                i >>= 1
            if not i:
                return -1
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of this level
                return -1
        while i < self.size:
            i *= 2
            if a[i] & source or c[i] & cluster:
                i += 1
        return i - self.size

    def place(self, length: int, source: int, cluster: int) -> int:
        """The bin of a piece, given the bits of its source and cluster."""
        residual = length
        while residual <= self.capacity:
            residual = self._next(residual, source | _NONE, cluster)
            if residual < 0 or residual > self.capacity:
                break
            for b in self.at[residual]:
                if self.sources[b] & source or self.clusters[b] & cluster:
                    continue
                self.at[residual].remove(b)
                self._put(b, residual - length, source, cluster)
                self._refresh(residual)
                return b
            residual += 1
        self.sources.append(0)
        self.clusters.append(0)
        b = len(self.sources) - 1
        self._put(b, self.capacity - length, source, cluster)
        return b

    def _put(self, b: int, residual: int, source: int, cluster: int) -> None:
        self.sources[b] |= source
        self.clusters[b] |= cluster
        insort(self.at[residual], b)
        self._refresh(residual)


def bits(names: pd.Series) -> list[int]:
    """A bit of its own for each name found twice or more, the most frequent lowest; 0 for others, which conflict with none."""
    counts = names.value_counts(sort=True)
    own = {name: 2 << i for i, name in enumerate(counts.index[counts > 1].tolist())}
    return [own.get(name, 0) for name in names.tolist()]


def pack_shard(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """``key, start, length, bin`` of every piece of the shard's documents; bins are numbered from 0."""
    items = items.sort_values("key", kind="stable")
    whole = (items["length"] // capacity).to_numpy()
    out_key, out_start, out_length, out_bin = [], [], [], []
    full = 0
    for key, n in zip(items["key"].to_numpy()[whole > 0].tolist(), whole[whole > 0].tolist(), strict=True):
        for i in range(n):
            out_key.append(key), out_start.append(i * capacity), out_length.append(capacity), out_bin.append(full)
            full += 1
    rest = (items["length"] - whole * capacity).to_numpy()
    order = np.lexsort((items["key"].to_numpy(), -rest))
    bins = Bins(capacity)
    keys, starts = items["key"].to_numpy(), whole * capacity
    order = order[rest[order] > 0]
    sources, clusters = (bits(items[name].iloc[order]) for name in ("source_hash", "cluster"))
    for i, source, cluster in zip(order.tolist(), sources, clusters, strict=True):
        b = bins.place(int(rest[i]), source, cluster)
        out_key.append(keys[i]), out_start.append(starts[i]), out_length.append(rest[i]), out_bin.append(full + b)
    return pd.DataFrame({"key": out_key, "start": out_start, "length": out_length, "bin": out_bin}, dtype="int64")


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each text."""
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            count = tk.Words(*tk.buffer(part.column("text"))).count
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(count, pa.int64()), part.column("source_hash"), part.column("cluster")], ["key", "length", "source_hash", "cluster"])


ITEMS = "key long, length long, source_hash long, cluster long"


def pack(items: DataFrame, capacity: int = CAPACITY, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """``key, start, length, bin_id`` of every piece of ``items`` (columns of ITEMS).

    A bin holds at most ``capacity`` and no two pieces of one cluster or of one source. An item of length 0 takes no room: one piece, in no bin (null).
    """
    items = workspace.materialise(items, "items")
    shards = max(1, -(-items.count() // shard_documents))
    dealt = items.filter("length > 0").withColumn("shard", F.pmod(F.xxhash64(F.lit(8), "key"), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(pdf, capacity).assign(shard=pdf["shard"].iat[0])

    packed = dealt.groupBy("shard").applyInPandas(one, "key long, start long, length long, bin long, shard long")
    packed = packed.select("key", "start", "length", (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("bin_id"))
    none = items.filter("length = 0").select("key", F.lit(0).cast("long").alias("start"), "length", F.lit(None).cast("long").alias("bin_id"))
    return packed.unionByName(none)


def document_items(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Items of documents: length in words, source, and the cluster of equal texts (by digest)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(
        F.col("__key").alias("key"),
        text.alias("text"),
        F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("source_hash"),
        F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long").alias("cluster"),
    )
    return workspace.arrow_map(own, measure, ITEMS)


def packed_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, bin_id``: words start .. start+length-1 of a document lie in that bin.

    Null and empty texts have no words and no bin; a null source is one source. Rows with null or repeated ids are
    packed one by one. An empty table gives an empty result.
    """
    workspace.bounded_batches(docs.sparkSession)
    plain = docs.select("doc_id", "text", "source")
    docs, own = keyed(plain, "doc_id")
    pieces = pack(document_items(docs), capacity)
    if docs is not own:
        return pieces.withColumnRenamed("key", "doc_id")
    return pieces.join(docs.select(F.col("__key").alias("key"), "doc_id"), "key").drop("key")


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's words lie: pieces of at most a bin's words, and their bins.

    A null or empty text makes one row of length 0 without a bin. Rows with null or repeated ids are told apart and named by their
    ids; ties in length are taken in order of those. A very long text is cut into pieces. An empty table gives an empty
    result.
    """
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

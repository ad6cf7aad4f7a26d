"""Token ids in files of Simple-8b words.

A word of 64 bits has a selector in its top four bits and packs as many ids as fit at that selector's width in the
other 60. Ids of 2**60 and more are escapes: selector 15, whose payload is an index into a table of whole values at
the end. Blocks hold a fixed number of ids and have an offset each, and the encoder runs all blocks of a shard in step.

A file is a run of shards, each ended by one newline byte. A shard is, little-endian: the magic ``S8B1``; int64 counts
of documents, ids, words, escapes and ids in a block; then document ids (int64), whether each is known (uint8), ids in
each document (int64), the first word of each block (int64), words (uint64) and escaped values (uint64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.llm import textkernels as tk
from cladeframe.llm import workspace
from cladeframe.llm.bpe import codec, default_vocabulary

#: Ids in a word and bits for each, by selector 1 to 14.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15

BLOCK = 1024
SHARD_IDS = 1 << 19
MAGIC = b"S8B1"
_COUNT = np.array([0, *COUNTS, 1], np.int64)
_U = np.uint64


def _bits(values: np.ndarray) -> np.ndarray:
    need = np.ones(len(values), np.uint8)
    rest = values >> _U(1)
    while rest.any():
        need += rest > 0
        rest = rest >> _U(1)
    return need


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and escaped values of an array of uint64."""
    values = np.ascontiguousarray(values, _U)
    n = len(values)
    starts = np.arange(0, n, block)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, _U)
    need = _bits(values)
    rest = np.minimum(block - np.arange(n) % block, n - np.arange(n))
    best = np.full(n, ESCAPE, np.uint8)
    most, have = need.copy(), 1
    for selector in range(len(COUNTS), 0, -1):  # from one id in a word to sixty: the last that fits wins
        count, width = COUNTS[selector - 1], WIDTHS[selector - 1]
        while have < count:  # most[i] is the widest of values i .. i+have-1
            step = min(have, count - have)
            if step < n:
                most[: n - step] = np.maximum(most[: n - step], most[step:])
            have += step
        best[(most <= width) & (rest >= count)] = selector
    head = np.zeros(n, bool)
    at, end = starts.copy(), np.minimum(starts + block, n)
    while len(at):
        head[at] = True
        at = at + _COUNT[best[at]]
        live = at < end
        at, end = at[live], end[live]
    at = np.flatnonzero(head)
    chosen = best[at]
    words = chosen.astype(_U) << _U(60)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            words[mine] |= np.arange(len(mine)).astype(_U)
            escaped = values[at[mine]]
            continue
        for j in range(COUNTS[selector - 1]):
            words[mine] |= values[at[mine] + j] << _U(j * WIDTHS[selector - 1])
    if ESCAPE not in chosen:
        escaped = np.zeros(0, _U)
    return words, np.searchsorted(at, starts), escaped


def unpack(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """Values of words; a slice of words from one block's offset to another's decodes on its own."""
    selectors = (words >> _U(60)).astype(np.int64)
    size = _COUNT[selectors]
    first = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), _U)
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        payload = words[mine] & _U((1 << 60) - 1)
        if selector == ESCAPE:
            out[first[mine]] = escaped[payload.astype(np.int64)]
            continue
        width = WIDTHS[selector - 1]
        for j in range(COUNTS[selector - 1]):
            out[first[mine] + j] = (payload >> _U(j * width)) & _U((1 << width) - 1)
    return out


def write_shard(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escaped = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        [
            MAGIC,
            struct.pack("<5q", len(doc_ids), len(ids), len(words), len(escaped), BLOCK),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            known.tobytes(),
            np.asarray(sizes, "<i8").tobytes(),
            offsets.astype("<i8").tobytes(),
            words.astype("<u8").tobytes(),
            escaped.astype("<u8").tobytes(),
        ]
    )


def read_shards(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, whether known, sizes and ids of each shard of a file."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no shard begins at byte {at}")
        docs, n, words, escapes, block = struct.unpack_from("<5q", data, at + 4)
        at += 44
        parts = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", -(-n // block)), ("<u8", words), ("<u8", escapes)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        ids = unpack(parts[4], parts[5])
        if len(ids) != n:
            raise ValueError(f"a shard holds {len(ids)} ids and names {n}")
        yield parts[0], parts[1].astype(bool), parts[2], ids
        at += 1


def encode_rows(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    names: list[int | None] = []
    sizes: list[np.ndarray] = []
    held: list[np.ndarray] = []
    total = 0

    def shard() -> pa.RecordBatch:
        image = write_shard(names, np.concatenate(sizes), np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], ["image"])

    for batch in batches:
        for part in tk.chunks(batch, "text"):
            ids, offsets = own.encode(*tk.buffer(part.column("text")))
            names += part.column("doc_id").to_pylist()
            sizes.append(np.diff(offsets) + 1)
            held.append(np.insert(ids, offsets[1:], end_id))
            total += len(held[-1])
            if total >= SHARD_IDS:
                yield shard()
                names, sizes, held, total = [], [], [], 0
    if names:
        yield shard()


def write_ids(docs: DataFrame, out: str, vocabulary: str, end_id: int) -> None:
    """Encode ``doc_id, text`` into files under ``out``, in ascending order of doc_id over files and inside them.

    Files are written by Spark's committer, so a lost or repeated task leaves nothing behind.
    """
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = workspace.arrow_map(ordered, lambda batches: encode_rows(vocabulary, end_id, batches), "image binary")
    (
        shards.select(F.col("image").cast("string").alias("value"))
        .write.option("compression", "none")
        .option("lineSep", "\n")
        .option("maxRecordsPerFile", 32)
        .text(out)
    )


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            before = 0
            for docs, known, sizes, ids in read_shards(data.as_py()):
                ends = np.cumsum(sizes)
                whole = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(whole[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(docs)),
                        pa.array(docs, pa.int64(), mask=~known),
                        pa.array(before + ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["file", "doc_id", "at", "n_tokens", "ids_crc32"],
                )
                before += int(ends[-1]) if len(ends) else 0


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(out).select("path", "content")
    rows = workspace.arrow_map(files, read_rows, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    rows = workspace.materialise(rows, "ids")
    # one row for each file, in the order of the ids they hold
    order = Window.orderBy(F.col("first").asc_nulls_first(), "last").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy("file")
        .agg(F.expr("min_by(doc_id, at)").alias("first"), F.max("doc_id").alias("last"), F.sum("n_tokens").alias("ids"))
        .select("file", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))
    )
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_simple8b(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Every document encoded, written in ascending doc_id order and read back. Null counts as empty: the end id alone.

    Documents with equal or null ids keep their rows (null first); an empty table gives files without shards.
    """
    workspace.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = workspace.new_path(spark, "simple8b")
    write_ids(docs, out, vocabulary or default_vocabulary(), end_id)
    return read_ids(spark, out)

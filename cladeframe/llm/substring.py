"""Substring deduplication by fixed-block anchors.

A window of W words holds a whole aligned block of B = (W + 1) // 2 words, so two equal windows always meet in an
indexed block: one of the non-overlapping blocks of either text equals a rolling window of B words of the other.

1. Every rolling window of B words is a probe; those at multiples of B are the index. Probes meet by fingerprint, and
   a fingerprint with an indexed block and two occurrences is a hit at each of them.
2. A hit is extended: all windows of W words around it are fingerprinted in full (96 bits) and those found twice or
   more, one by one to both sides, make up the maximal exact repeats.
3. Words covered by a repeated window go.

Occurrences that meet in one task are settled there and one of them goes on, so a passage that many documents share
costs a row for each task and not for each document, and no pairs are formed. Entries travel packed (see ``blobs``),
texts compressed. Fingerprints of step 1 may collide; step 2 decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import blobs, workspace
from cladeframe.llm import textkernels as tk

WINDOW = 35
FOUND, ENTRY, TEXT, DONE = range(4)
ALIGNED, SETTLED = 1, 2

#: Entries that a task gathers before it deals them out, and bytes of text that it packs at a time.
FLUSH = 1 << 19
FLUSH_BYTES = 6 << 20
#: Words for which there is a bucket.
BUCKET_WORDS = 1 << 19


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (tk.mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal entries together, and where each group begins (its end last)."""
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    if len(new):
        new[0] = True
    return order, np.concatenate([np.flatnonzero(new), [len(order)]])


class _Gather:
    """Entries of a task: what repeats here is settled here; one entry of each fingerprint goes to its bucket."""

    def __init__(self, sender: blobs.Sender, buckets: int):
        self.sender, self.buckets, self.held, self.size = sender, buckets, [], 0

    def add(self, prints: tuple[np.ndarray, ...], keys: np.ndarray, places: np.ndarray, flags: np.ndarray) -> None:
        self.held.append((*prints, keys, places.astype(np.uint32), flags))
        self.size += len(keys)

    def flush(self) -> list[tuple[int, int, int, bytes]]:
        if not self.size:
            return []
        *prints, keys, places, flags = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order, edges = _groups(*prints)
        count = np.diff(edges)
        first = np.minimum.reduceat(order, edges[:-1])
        twice = np.zeros(len(order), bool)
        twice[order] = np.repeat(count > 1, count)
        found = np.flatnonzero(twice)
        rows = self.sender.deal(FOUND, _bucket(keys[found], self.buckets), keys[found], places[found])
        flag = np.bitwise_or.reduceat(flags[order], edges[:-1]) | np.where(count > 1, SETTLED, 0).astype(np.uint8)
        by = np.argsort(first)
        first, flag = first[by], flag[by]
        prints = [p[first] for p in prints]
        bucket = ((prints[0] >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)
        if len(prints) == 1:
            prints = [prints[0].astype(np.uint32)]  # the rest of the fingerprint chose the bucket
        return rows + self.sender.deal(ENTRY, bucket, *prints, keys[first], places[first], flag)


def probe(buckets: int, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = (window + 1) // 2
    gather = _Gather(blobs.Sender(), buckets)
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            keys = part.column("key").to_numpy()
            words = tk.Words(*tk.buffer(part.column("text")))
            at, prints = words.grams(words.hashes(), block)
            long = words.count[words.text[at]] >= window
            at, prints = at[long], prints[long]
            if len(at):
                gather.add((prints,), keys[words.text[at]], words.place[at], (words.place[at] % block == 0).astype(np.uint8) * np.uint8(ALIGNED))
            if gather.size >= FLUSH:
                yield from blobs.batches(gather.flush())
    yield from blobs.batches(gather.flush())


def meet(buckets: int, anchored: bool, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a bucket whose fingerprint occurs twice (and, if anchored, in an indexed block) are found."""
    sender = blobs.Sender()
    for bucket, rows in blobs.by_bucket(stream):
        held = []
        for kind, payload in rows:
            if kind == ENTRY:
                held.append(blobs.unpack(payload))
            else:
                yield from blobs.batches([sender.row(bucket, kind, payload)])
        if not held:
            continue
        *prints, keys, places, flags = (np.concatenate(c) for c in zip(*held, strict=True))
        order, edges = _groups(*prints)
        count = np.diff(edges)
        hit = count > 1
        if anchored:
            hit &= (np.bitwise_or.reduceat(flags[order], edges[:-1]) & ALIGNED) > 0
        found = np.zeros(len(order), bool)
        found[order] = np.repeat(hit, count)
        found = np.flatnonzero(found & ((flags & SETTLED) == 0))
        found = found[np.lexsort((places[found], keys[found]))]
        yield from blobs.batches(sender.deal(FOUND, _bucket(keys[found], buckets), keys[found], places[found]))


_squeeze = zstandard.ZstdCompressor(level=3)
_stretch = zstandard.ZstdDecompressor()


def _pack_texts(keys: np.ndarray, texts: list[bytes]) -> bytes:
    head = blobs.pack(keys, np.array([len(t) for t in texts], np.uint32))
    return len(head).to_bytes(4, "little") + head + _squeeze.compress(b"".join(texts))


def _unpack_texts(payload: bytes) -> tuple[np.ndarray, list[bytes]]:
    size = int.from_bytes(payload[:4], "little")
    keys, lengths = blobs.unpack(payload[4 : 4 + size])
    ends = np.cumsum(lengths, dtype=np.int64)
    data = _stretch.decompress(payload[4 + size :], max_output_size=int(ends[-1]) + 1)
    return keys, [data[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def ship(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed, to their documents' buckets."""
    sender = blobs.Sender()
    keys: list[np.ndarray] = []
    texts: list[bytes] = []
    size = 0

    def flush() -> list[tuple[int, int, int, bytes]]:
        key = np.concatenate(keys)
        bucket = _bucket(key, buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
        return [
            sender.row(int(bucket[order[a]]), TEXT, _pack_texts(key[order[a:b]], [texts[i] for i in order[a:b].tolist()]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
        ]

    for batch in batches:
        for part in tk.chunks(batch, "text"):
            raw, offsets = tk.buffer(part.column("text"))
            data, ends = raw.tobytes(), offsets.tolist()
            keys.append(part.column("key").to_numpy())
            texts += [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            size += len(data)
            if size >= FLUSH_BYTES:
                yield from blobs.batches(flush())
                keys, texts, size = [], [], 0
    if keys:
        yield from blobs.batches(flush())


RESULT = pa.schema(
    [("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
)


def _result(keys: list[int], texts: list[bytes], gone: list[np.ndarray | None]) -> pa.RecordBatch:
    rows = []
    for key, text, off in zip(keys, texts, gone, strict=True):
        words = text.split()  # on ASCII white space alone, as bytes do
        kept = b" ".join(words if off is None else compress(words, (~off).tolist()))
        removed = 0 if off is None else int(off.sum())
        rows.append((key, len(words), removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if removed else None))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT.types, strict=True)], schema=RESULT)


def _documents(rows: Iterator[tuple[int, bytes]], aside: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes], list[np.ndarray]]]:
    """About a chunk of a bucket's documents at a time, with the places found in each; other rows are put aside."""
    found: list[list[np.ndarray]] = []
    where = None
    keys, texts, size = [], [], 0

    def chunk() -> tuple[np.ndarray, list[bytes], list[np.ndarray]]:
        all_keys, places = where
        own = np.concatenate(keys)
        low, high = np.searchsorted(all_keys, own), np.searchsorted(all_keys, own, "right")
        return own, texts, [places[a:b].astype(np.int64) for a, b in zip(low.tolist(), high.tolist(), strict=True)]

    for kind, payload in rows:  # in order of kind: all that was found precedes the texts
        if kind == FOUND:
            found.append(blobs.unpack(payload))
            continue
        if kind == DONE:
            aside.append(payload)
            continue
        if where is None:
            k, p = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
            order = np.argsort(k, kind="stable")
            where = k[order], p[order]
        key, text = _unpack_texts(payload)
        keys.append(key)
        texts += text
        size += sum(map(len, text))
        if size >= tk.CHUNK_BYTES:
            yield chunk()
            keys, texts, size = [], [], 0
    if keys:
        yield chunk()


def extend(buckets: int, window: int, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the windows around hits; documents without any are done."""
    block = (window + 1) // 2
    sender = blobs.Sender()
    gather = _Gather(sender, buckets)
    for bucket, rows in blobs.by_bucket(stream):
        for keys, texts, found in _documents(rows, []):
            some = [i for i, f in enumerate(found) if len(f)]
            rest = [i for i, f in enumerate(found) if not len(f)]
            if rest:
                batch = _result(keys[rest].tolist(), [texts[i] for i in rest], [None] * len(rest))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, RESULT) as writer:
                    writer.write_batch(batch)
                yield from blobs.batches([sender.row(bucket, DONE, sink.getvalue().to_pybytes())])
            if not some:
                continue
            keys, texts, found = keys[some], [texts[i] for i in some], [found[i] for i in some]
            yield from blobs.batches([sender.row(bucket, TEXT, _pack_texts(keys, texts))])
            ends = np.cumsum([0, *map(len, texts)])
            words = tk.Words(np.frombuffer(b"".join(texts), np.uint8), ends)
            start = np.repeat(words.before[:-1], [len(f) for f in found])
            hits = start + np.concatenate(found)
            edge = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edge, np.maximum(hits - (window - block), start), 1)
            np.add.at(edge, hits + 1, -1)
            at = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (words.place + window <= words.count[words.text]))
            if len(at):
                gather.add(
                    (tk.windows(words.hashes(0), at, window, 0), tk.windows(words.hashes(1), at, window, 1).astype(np.uint32)),
                    keys[words.text[at]], words.place[at], np.zeros(len(at), np.uint8),
                )
            if gather.size >= FLUSH:
                yield from blobs.batches(gather.flush())
    yield from blobs.batches(gather.flush())


def remove(window: int, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in blobs.by_bucket(stream):
        aside: list[bytes] = []
        for keys, texts, found in _documents(rows, aside):
            gone = [tk.cover(f, window, len(t.split())) if len(f) else None for t, f in zip(texts, found, strict=True)]
            yield _result(keys.tolist(), texts, gone)
        for payload in aside:
            yield from pa.ipc.open_stream(payload)


def _exchange(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "src")


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key that tells all rows apart, and what joins results back: the id where it does so itself."""
    spread = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null")
    if spread.isEmpty():
        return docs.withColumn("__key", F.col(id_col).cast("long")), docs
    docs = workspace.materialise(docs.withColumn("__key", F.monotonically_increasing_id()), "keyed")
    return docs, docs


def repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (told apart by ``__key``): key, n_words, n_removed, kept_sha256, kept_text (null: unchanged).

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. Copies of a text lose every word of their windows, all
    alike; a text shorter than a window loses none. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    workspace.bounded_batches(spark)
    own = docs.select(F.col("__key").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(16, size // 6 // BUCKET_WORDS)
    probes = workspace.arrow_map(own, lambda b: probe(n, window, b), blobs.SCHEMA)
    hits = workspace.arrow_map(_exchange(probes), lambda s: meet(n, True, s), blobs.SCHEMA)
    texts = workspace.arrow_map(own, lambda b: ship(n, b), blobs.SCHEMA)
    windows = workspace.arrow_map(_exchange(hits.unionByName(texts)), lambda s: extend(n, window, s), blobs.SCHEMA)
    found = workspace.arrow_map(_exchange(windows), lambda s: meet(n, False, s), blobs.SCHEMA)
    return workspace.arrow_map(_exchange(found),
        lambda s: remove(window, s), "key long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words, those that repeated windows cover, and a digest of what is left.

    A null or empty text has no words; a text shorter than a window loses none; equal texts lose all windows alike.
    Rows with null or repeated ids are told apart and named by their ids. A very long text is worked on alone and whole.
    An empty table gives an empty result.
    """
    docs, own = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    found = repeats(docs).drop("kept_text")
    if docs is not own:
        return found.withColumnRenamed("key", "doc_id")
    return found.join(docs.select(F.col("__key").alias("key"), "doc_id"), "key").drop("key")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the kept words, joined by a space, as the text of rows that lose any; ``chars_col`` follows it."""
    rows, _ = keyed(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id")), "doc_id")
    texts = rows.select("__key", F.col("row").getField(text_col).alias("text"))
    changed = workspace.materialise(repeats(texts).filter("n_removed > 0").select("key", "kept_text"), "repeats")
    out, new = rows.join(changed, rows["__key"] == changed["key"], "left"), F.col("key").isNotNull()
    row = F.col("row").withField(text_col, F.when(new, F.col("kept_text")).otherwise(F.col("row").getField(text_col)))
    if chars_col in docs.columns:
        count = F.char_length("kept_text").cast(docs.schema[chars_col].dataType)
        row = row.withField(chars_col, F.when(new, count).otherwise(F.col("row").getField(chars_col)))
    return out.select(row.alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 33, 1))) AS i, ws FROM d WHERE len(ws) >= 35),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS gram FROM w),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY gram) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
k AS (SELECT u.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY u.i) FILTER (gone.i IS NULL), '') AS kept
      FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY u.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

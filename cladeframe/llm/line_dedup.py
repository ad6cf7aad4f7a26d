"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

Lines are signed by MinHash of one permutation (every shingle is hashed once and dealt to a bin), banded, verified and
closed to components by :mod:`neardup`, where equal lines (by two digests of the text) collapse. Of each component the first line (by
document id, then line number) stays in place and all others go.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import neardup, poisson, workspace
from cladeframe.llm import textkernels as tk
from cladeframe.llm.minhash_dedup import ROWS, Verifier
from cladeframe.llm.substring import keyed

SHINGLE = 8
SLOTS = 64


def char_shingles(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line of every shingle of k characters; a shorter line has one shingle of all of them."""
    start = np.flatnonzero((raw & 0xC0) != 0x80)
    before = np.searchsorted(start, offsets)
    count = np.diff(before)
    line = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(start)) - before[line]
    at = np.flatnonzero((place + k <= count[line]) | ((place == 0) & (count[line] < k)))
    bounds = np.append(start, len(raw))
    stop = bounds[np.minimum(at + k, before[line[at] + 1])]
    n, base = len(raw), tk._BASES[0]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * tk._powers(base, False, n)[:n], out=total[1:])
    return tk.mix((total[stop] - total[start[at]]) * tk._powers(base, True, n)[start[at]]), line[at]


def binned(h: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """MinHash by one permutation dealt to bins; an empty bin takes the value of the first full one in an order of its own."""
    none, last = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(SLOTS - 1)
    low = np.full(n * SLOTS, none)
    np.minimum.at(low, bag * SLOTS + (h & last).view(np.int64), h)
    full = low != none
    empty, turn = np.flatnonzero(~full), 0
    source = np.arange(n * SLOTS)
    while len(empty):
        draw = (tk.mix(np.arange(SLOTS, dtype=np.uint64) + tk.salt(turn)) & last).view(np.int64)
        source[empty] = (empty & -SLOTS) | draw[empty & (SLOTS - 1)]
        empty, turn = empty[~full[source[empty]]], turn + 1
    return low[source].reshape(n, SLOTS)


def split(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number, start and end of each line that has a word."""
    cuts = np.flatnonzero(raw == 10)
    before = np.searchsorted(cuts, offsets)
    count = np.diff(before) + 1
    text = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    pos = np.arange(len(text)) - first[text]
    start, end = np.zeros((2, len(text)), np.int64)
    later, last = pos > 0, pos == count[text] - 1
    start[~later], start[later] = offsets[:-1], cuts + 1
    end[last], end[~last] = offsets[1:], cuts
    some = end > start
    some[some] = np.logical_or.reduceat(~tk.SPACE[raw], start[some]) if some.any() else False
    return text[some], pos[some], start[some], end[some]


def sign_lines(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each line, two digests of its text, and its bands."""
    n, size = len(start), len(raw)
    view = memoryview(raw)
    whole = b"".join(xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(start.tolist(), end.tolist(), strict=True))
    digests = np.frombuffer(whole, np.int64).reshape(n, 2)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * tk._powers(tk._BASES[0], False, size)[:size], out=total[1:])
    back = tk._powers(tk._BASES[0], True, size)
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    first, stop = np.searchsorted(chars, start), np.searchsorted(chars, end)
    count = stop - first
    long = count >= SHINGLE
    edge = np.zeros(len(chars) + 1, np.int8)
    np.add.at(edge, first[long], 1)
    np.add.at(edge, stop[long] - SHINGLE + 1, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)[: max(len(chars) - SHINGLE + 1, 0)]
    sums = total[np.append(chars, size)]
    shingles = np.where(long, count - SHINGLE + 1, 1)
    grams = ((sums[SHINGLE:] - sums[:-SHINGLE]) * back[chars[: len(inside)]])[inside] if len(inside) else np.zeros(0, np.uint64)
    line = np.repeat(np.flatnonzero(long), shingles[long])
    short = np.flatnonzero(~long)
    grams = np.concatenate([grams, digests[short, 0].view(np.uint64)])
    bands = poisson.bands(binned(tk.mix(grams), np.concatenate([line, short]), n), ROWS)
    return shingles, digests[:, 0].copy(), digests[:, 1].copy(), bands


def sign_batch(batch: pa.RecordBatch, ids: Iterator[int]) -> Iterator[neardup.Signed]:
    for part in tk.chunks(batch, "text", 1 << 17):
        raw, offsets = tk.buffer(part.column("text"))
        text, pos, start, end = split(raw, offsets)
        n = len(text)
        if n:
            keys = np.fromiter(itertools.islice(ids, n), np.int64, n)
            sizes, bag1, bag2, bands = sign_lines(raw, start, end)
            docs = part.column("key").to_numpy()[text]
            yield neardup.Signed(keys, sizes, bag1, bag2, np.repeat(np.arange(n), bands.shape[1]), bands.ravel(), (docs, pos))


def signer() -> Callable[[pa.RecordBatch], Iterator[neardup.Signed]]:
    """Signs a task's lines and numbers them, each task in a range of its own."""
    ids: list[Iterator[int]] = []

    def sign(batch: pa.RecordBatch) -> Iterator[neardup.Signed]:
        if not ids:
            context = TaskContext.get()
            ids.append(itertools.count((context.partitionId() if context else 0) << 40))
        return sign_batch(batch, ids[0])

    return sign


REMOVED = "array<struct<line_no:int,kept_key:long,kept_line_no:int>>"
_OWN = pa.schema([("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        column = batch.column("removed")
        numbers = pa.array(column.flatten().field("line_no")) if len(column) else []
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        for text, low, high in zip(batch.column("text"), [0, *ends.tolist()], ends.tolist(), strict=False):
            if low == high:
                whole = text.as_buffer().to_pybytes()
                rows.append((whole.count(b"\n") + 1, 0, hashlib.sha256(whole).hexdigest(), None))
                continue
            lines, drop = text.as_py().split("\n"), set(numbers[low:high].to_pylist())
            kept = "\n".join(x for i, x in enumerate(lines) if i not in drop)
            rows.append((len(lines), len(drop), hashlib.sha256(kept.encode()).hexdigest(), kept))
        own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OWN.types, strict=True)] if rows else [pa.array([], t) for t in _OWN.types]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *own, column], ["key", *_OWN.names, "removed"])


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, text`` of the lines that rows of ``text, want`` (number and key of lines) name."""
    for batch in batches:
        rows = []
        for text, want in zip(batch.column("text"), batch.column("want").to_pylist(), strict=True):
            lines = text.as_py().split("\n")
            rows += [(w["id"], lines[w["pos"]]) for w in want]
        keys, lines = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.string())], ["key", "text"])


class LineVerifier(Verifier):
    """A verifier whose texts are lines of ``docs`` (``key, text``), at the places that ``signed`` names."""

    def __init__(self, docs: DataFrame, signed: DataFrame):
        super().__init__(docs, char_shingles, as_sets=True)
        self.signed = signed

    def prepare(self, keys: DataFrame) -> None:
        want = self.signed.join(keys, "key", "left_semi").groupBy(F.col("doc").alias("key")).agg(F.collect_list(F.struct("pos", F.col("key").alias("id"))).alias("want"))
        rows = self.texts.join(workspace.materialise(want, "want").hint("merge"), "key").select("text", "want")
        self.texts = workspace.materialise(workspace.arrow_map(rows, line_rows, "key long, text string"), "texts")


def removed_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key, pos, kept_key, kept_pos`` of every line that goes, with the line that stays for it."""
    workspace.bounded_batches(docs.sparkSession)
    own = docs.select(F.col("__key").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed, shared = neardup.banded(own, lambda batch, sign=signer(): sign(batch), SLOTS // ROWS, each=10)
    found = workspace.materialise(neardup.classes(signed, shared, LineVerifier(own, signed), alone=False), "near")
    # classes of several lines, their places and what stays for them
    several = found.groupBy("class").agg(F.min(F.struct(F.col("doc").alias("key"), "pos")).alias("stay"))
    return (
        found.join(workspace.materialise(several, "several"), "class").select(F.col("doc").alias("key"), "pos", "stay")
        .filter((F.col("key") != F.col("stay.key")) | (F.col("pos") != F.col("stay.pos")))
        .select("key", "pos", F.col("stay.key").alias("kept_key"), F.col("stay.pos").alias("kept_pos"))
    )


def dedup_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row of ``docs`` key, n_lines, n_removed, kept_sha256, kept_text (null: unchanged), and for each line removed its
    number and the key and number of the one that stays for it."""
    since = workspace.mark()
    gone = removed_lines(docs, text_col)
    own = docs.select(F.col("__key").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    place = F.struct(F.col("pos").cast("int").alias("line_no"), "kept_key", F.col("kept_pos").cast("int").alias("kept_line_no"))
    per_doc = gone.groupBy("key").agg(F.sort_array(F.collect_list(place)).alias("removed"))
    per_doc = workspace.materialise(per_doc, "gone")
    workspace.discard(docs.sparkSession, since)
    rows = own.join(per_doc.hint("merge"), "key", "left").select("key", "text", F.coalesce("removed", F.array().cast(REMOVED)).alias("removed"))
    return workspace.arrow_map(rows, cut_rows, f"key long, n_lines long, n_removed long, kept_sha256 string, kept_text string, removed {REMOVED}")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_removed, kept_sha256 of the lines left, and for each removed line what stays for it.

    Lines are split at ``\\n``; those without a word are left alone. Two lines are linked when the Jaccard similarity
    of their sets of eight-character shingles is 0.8 or more (a line of fewer characters has one shingle, itself).
    Null counts as empty: one line, nothing removed. Rows with null or repeated ids are told apart; of two such rows
    with one text the lines of the second go. An empty table gives an empty result.
    """
    docs, own = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    rows = dedup_lines(docs).drop("kept_text")
    if own is docs:  # rows have keys of their own: ids take their place
        rows = workspace.materialise(rows, "cut")
        ids = docs.select(F.col("__key").alias("key"), "doc_id")
        each = rows.select("key", F.explode("removed").alias("r")).join(ids.select(F.col("key").alias("kept_key"), F.col("doc_id").alias("kept_id")), F.col("r.kept_key") == F.col("kept_key"))
        place = F.struct(F.col("r.line_no").alias("line_no"), F.col("kept_id").alias("kept_key"), F.col("r.kept_line_no").alias("kept_line_no"))
        said = each.groupBy("key").agg(F.sort_array(F.collect_list(place)).alias("said"))
        rows = rows.join(ids, "key").join(said, "key", "left").withColumn("removed", F.coalesce("said", "removed"))
    else:
        rows = rows.withColumn("doc_id", F.col("key"))
    removed = F.col("removed").cast("array<struct<line_no:int,kept_doc_id:long,kept_line_no:int>>")
    return rows.select("doc_id", "n_lines", "n_removed", "kept_sha256", removed.alias("removed"))

"""Near-duplicate documents by BagMinHash over bags of five-word shingles, verified by multiset overlap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import blobs, differences, neardup, poisson, workspace
from cladeframe.llm import textkernels as tk
from cladeframe.llm.substring import keyed

SHINGLE = 5
SLOTS, ROWS = 96, 4
SIGN_BAGS = 256

def word_shingles(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every k-word shingle; a text of fewer words has one shingle of all of them."""
    words = tk.Words(raw, offsets)
    hashes = words.hashes()
    at, grams = words.grams(hashes, k)
    bag = words.text[at]
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(few):
        short = [tk.windows(hashes, words.before[few[words.count[few] == n]], n) for n in range(1, k)]
        grams = np.concatenate([grams, *short])
        bag = np.concatenate([bag, *(few[words.count[few] == n] for n in range(1, k))])
    return grams, bag


def distinct(grams: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """44 bits of the distinct elements of each bag in order, their counts and bags."""
    key = np.sort((bag.astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(new)]]))
    return key[at] & np.uint64((1 << 44) - 1), count, (key[at] >> np.uint64(44)).astype(np.int64)


def poisson_bands(elements: np.ndarray, weights: np.ndarray, bag: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bands of every bag; a few bags at a time, as each makes some hundreds of points, however small it is."""
    n, out = len(edges) - 1, [np.zeros((0, SLOTS // ROWS), np.int64)]
    for low in range(0, n, SIGN_BAGS):
        high = min(low + SIGN_BAGS, n)
        own = slice(edges[low], edges[high])
        out.append(poisson.bands(poisson.signatures(elements[own], weights[own], bag[own] - low, high - low, SLOTS), ROWS))
    return np.concatenate(out)


def sign(keys: np.ndarray, elements: np.ndarray, weights: np.ndarray, bag: np.ndarray, bands: Callable) -> neardup.Signed:
    """Size, digest (two sums of mixed elements and weights) and bands of each bag; ``bands`` gives a row of them for each bag."""
    n = len(keys)
    edges = np.searchsorted(bag, np.arange(n + 1))
    sums = []
    for which in range(2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(tk.mix(tk.mix(elements ^ tk.salt(which)) + weights.astype(np.uint64)), dtype=np.uint64)])
        sums.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
    size = np.bincount(bag, weights, n).astype(np.int64)
    some = np.flatnonzero(size > 0)
    own = np.searchsorted(some, bag)
    rows = bands(elements, weights, own, np.searchsorted(own, np.arange(len(some) + 1)))
    return neardup.Signed(keys, size, *sums, np.repeat(some, rows.shape[1]), rows.ravel())


def sign_batch(batch: pa.RecordBatch) -> Iterator[neardup.Signed]:
    for part in tk.chunks(batch, "text"):
        yield sign(part.column("key").to_numpy(), *distinct(*word_shingles(*tk.buffer(part.column("text")))), poisson_bands)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Exact sizes of the multiset overlap and union."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    both = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return both, int(a[1].sum()) + int(b[1].sum()) - both


def _bag(elements: np.ndarray, as_set: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements in order, and their counts (or ones)."""
    elements = np.sort(elements)
    new = np.ones(len(elements), bool)
    new[1:] = elements[1:] != elements[:-1]
    at = np.flatnonzero(new)
    return elements[at], (np.ones(len(at), np.int64) if as_set else np.diff(np.append(at, len(new))))


def bags_of(shingles: Callable, as_sets: bool, batch: pa.RecordBatch, held: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bags of the texts that pairs of a batch name, by key; those in ``held`` are taken from there."""
    texts = {}
    for keys, column in (("a", "a_text"), ("b", "b_text")):
        values = batch.column(column)
        for i, key in enumerate(batch.column(keys).to_pylist()):
            if key not in held and key not in texts:
                texts[key] = values[i]
    bags = dict(held)
    if texts:
        names = list(texts)
        cut = pa.RecordBatch.from_arrays([pa.array(names), pa.array([texts[k].as_py() for k in names], pa.string())], ["key", "text"])
        for part in tk.chunks(cut, "text"):
            elements, bag = shingles(*tk.buffer(part.column("text")))
            if (bag[1:] < bag[:-1]).any():
                order = np.argsort(bag, kind="stable")
                elements, bag = elements[order], bag[order]
            edges = np.searchsorted(bag, np.arange(part.num_rows + 1)).tolist()
            for k, x, y in zip(part.column("key").to_pylist(), edges, edges[1:], strict=False):
                bags[k] = _bag(elements[x:y], as_sets)
    return bags


def verify_rows(shingles: Callable, as_sets: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts: similarity, and whether it reaches the threshold (told from whole numbers). A text is cut once as long as it stays in turn."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        bags = bags_of(shingles, as_sets, batch, held)
        sizes = [overlap(bags[x], bags[y]) for x, y in zip(a, b, strict=True)]
        linked = [neardup.SIMILAR[1] * o >= neardup.SIMILAR[0] * u for o, u in sizes]
        other = [c for c in batch.schema.names if c not in ("a_text", "b_text")]
        told = [pa.array([o / u for o, u in sizes], pa.float64()), pa.array(linked, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in other), *told], [*other, "similarity", "linked"])
        held = {k: bags[k] for k in a[-1:]}


def difference_rows(shingles: Callable, as_sets: bool, gather: Callable[[], differences.Gather], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a gatherer makes of pairs with their texts."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    to = gather()
    for batch in batches:
        a, b, comp, flags, shards = (batch.column(c).to_pylist() for c in ("a", "b", "comp", "flags", "shards"))
        bags = bags_of(shingles, as_sets, batch, held)
        for x, y, c, f, s in zip(a, b, comp, flags, shards, strict=True):
            to.add(x, y, c, f, bags[x], bags[y], s)
            if to.full():
                yield from blobs.batches(to.flush())
        held = {k: bags[k] for k in a[-1:]}
    yield from blobs.batches(to.flush())


class Verifier:
    """For :func:`neardup.classes`: texts ``key, text`` that pairs name are written once and joined to both sides."""

    def __init__(self, texts: DataFrame, shingles: Callable, as_sets: bool):
        self.texts, self.shingles, self.as_sets, self.sized = texts, shingles, as_sets, not as_sets

    def prepare(self, keys: DataFrame) -> None:
        # shuffled at every size: a broadcast would only serve small inputs
        self.texts = workspace.materialise(self.texts.join(keys.hint("merge"), "key", "left_semi"), "texts")

    def _with_texts(self, pairs: DataFrame) -> DataFrame:
        right = pairs.join(self.texts.select(F.col("key").alias("b"), F.col("text").alias("b_text")), "b")
        both = right.join(self.texts.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a")
        return both.select(*pairs.columns, "a_text", "b_text")

    def check(self, pairs: DataFrame) -> DataFrame:
        shingles, as_sets = self.shingles, self.as_sets
        rows = self._with_texts(pairs)
        kinds = ", ".join(f"{c} long" for c in pairs.columns)
        return workspace.arrow_map(rows, lambda s: verify_rows(shingles, as_sets, s), f"{kinds}, similarity double, linked boolean")

    def differences(self, pairs: DataFrame, gather: Callable[[], differences.Gather]) -> DataFrame:
        shingles, as_sets = self.shingles, self.as_sets
        return workspace.arrow_map(self._with_texts(pairs), lambda s: difference_rows(shingles, as_sets, gather, s), blobs.SCHEMA)


def near_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key, class`` for each row of ``docs`` (told apart by ``__key``)."""
    workspace.bounded_batches(docs.sparkSession)
    own = docs.select(F.col("__key").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return neardup.classes(*neardup.banded(own, sign_batch, SLOTS // ROWS), Verifier(own, word_shingles, as_sets=False)).select("key", "class")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class (the least doc_id in it), the class's size and whether it is the one that stays.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Two documents are linked when the weighted Jaccard similarity of
    their bags of five-word shingles is 0.8 or more; classes are the components of links. A text of one to four words
    has one shingle of them all; a null or empty text is a class of its own. Rows with null or repeated ids are told
    apart, and named by their ids in the result. An empty table gives an empty result.
    """
    docs, _ = keyed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    since = workspace.mark()
    found = workspace.materialise(near_duplicates(docs), "near")
    workspace.discard(spark, since)
    return named(docs, found)


def named(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    sizes = found.groupBy("class").agg(F.count(F.lit(1)).alias("class_size"))
    ids = docs.select(F.col("__key").alias("key"), F.col(id_col).cast("long").alias("doc_id"))
    sizes = sizes.join(ids.select(F.col("key").alias("class"), F.col("doc_id").alias("class_id")), "class")
    sizes = workspace.materialise(sizes, "sizes")
    return found.join(ids, "key").join(sizes, "class").select("doc_id", "class_id", "class_size", (F.col("key") == F.col("class")).alias("kept"))


#: All links by counting shared shingles, closed by the least id that reaches a document. Ids must be unique.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
parts AS (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS e
  FROM words WHERE len(w) > 0),
bags AS (SELECT doc_id, e, count(*) AS n FROM parts GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS size FROM bags GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS common FROM bags a JOIN bags b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 10 * common >= 8 * (x.size + y.size - common)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id WHERE root < b),
least AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY ALL)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM least
"""


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The least row of every class, all columns unchanged."""
    rows, _ = keyed(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id")), "doc_id")
    since = workspace.mark()
    found = near_duplicates(rows.select("__key", F.col("row").getField(text_col).alias("text")))
    keep = workspace.materialise(found.filter("key = class").select(F.col("key").alias("__key")), "near")
    workspace.discard(docs.sparkSession, since)
    return rows.join(keep, "__key", "left_semi").select("row.*")

"""Phrase collocations: all phrases of one to five words counted for each language, scored and ranked.

Phrases of all lengths become rows of language and phrase, which are added up by hash aggregation, within the task that
read the text first. Left and right parts' counts are joined to each candidate by every cut, scores are decimals, and an
anti-join with the candidates one word longer drops what they hold.

Most phrases of a corpus occur once or twice, and rows of all of them are many times the text. A phrase is no more
frequent than any three neighbouring words in it, so a first pass counts hashes of two and three words alone, and a bitmap
of fixed size remembers those that reach the least count. Phrases with two or three words outside the bitmap cannot be
candidates, nor parts of one, and are left out of the rows; single words, of which there are few in a task, all stay. The
bitmap has no false negatives, whatever collides in it: it only saves rows, and the counts of what is left are of the
phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.llm import textkernels as tk
from cladeframe.llm import workspace

MAX_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
NO_LANGUAGE = "und"
#: Words of the phrases whose hashes are counted first, at most.
FILTER_WORDS = 3
#: Bits of the map of frequent hashes (8 MB), which travels to every task. More hashes than bits only make it less sharp.
FILTER_BITS = 1 << 26
#: Hashes that a task adds up before it hands them on.
HELD = 1 << 21
#: Rows of phrases that a task adds up before it hands them on.
HELD_ROWS = 400_000

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


class Pieces(tk.Words):
    """Lower-cased words of a few texts with the piece that each is in."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        self.raw, self.offsets = raw, offsets
        solid = ~_GAP[raw]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.piece = np.cumsum(_BREAK[raw])[self.start] + self.text  # both only grow
        # the words in order with a space after each, so that a phrase is one slice
        size = self.end - self.start
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        self.flat = np.full(int(self.at[-1]), 32, np.uint8)
        into = np.ones(len(self.flat), bool)
        into[self.at[1:] - 1] = False
        self.flat[into] = raw[solid]

    def fits(self, k: int) -> np.ndarray:
        """Which words start k words of one piece."""
        out = np.zeros(len(self.start), bool)
        if len(out) >= k:
            out[: len(out) - k + 1] = self.piece[k - 1 :] == self.piece[: len(out) - k + 1]
        return out

    def phrases(self, which: np.ndarray, k: int) -> pa.Array:
        """The k words from each of ``which``."""
        low, high = self.at[which], self.at[which + k] - 1
        size = high - low
        ends = np.concatenate([[0], np.cumsum(size)])
        spread = np.arange(int(ends[-1])) + np.repeat(low - ends[:-1], size)
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(self.flat[spread]))


def _read(batch: pa.RecordBatch) -> Iterator[tuple[Pieces, np.ndarray, pa.RecordBatch]]:
    """Words of each part of a batch, with their language's hash."""
    for part in tk.chunks(batch, "text"):
        words = Pieces(*tk.buffer(part.column("text")))
        if len(words.start):
            yield words, tk.mix(part.column("lang_hash").to_numpy().astype(np.int64).view(np.uint64))[words.text], part


def _grams(words: Pieces, lang: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of 2 to FILTER_WORDS words: where they start and their hashes, apart for each language."""
    h = words.hashes()
    for k in range(2, FILTER_WORDS + 1):
        at = np.flatnonzero(words.fits(k))
        yield at, tk.mix(tk.windows(h, at, k) ^ lang[at])


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(tk.as_long(grams)), pa.array(n)], ["gram", "n"])

    for batch in batches:
        for words, lang, _ in _read(batch):
            held += [h for _, h in _grams(words, lang)]
            if sum(map(len, held)) >= HELD:
                yield flush()
    if held:
        yield flush()


def frequent_bits(docs: DataFrame, least: int, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap, as bytes, of the hashes of short phrases that reach ``least``; its size does not grow with the corpus."""
    grams = workspace.arrow_map(docs, gram_counts, "gram long, n long")  # added up as far as a task can
    counted = grams.repartition(workspace.shuffle_width(docs.sparkSession), "gram").groupBy("gram").agg(F.sum("n").alias("n"))
    place = F.pmod("gram", F.lit(bits))
    byte = F.expr("bit_or(shiftleft(1, cast(place % 8 as int)))")
    set_bytes = counted.filter(F.col("n") >= least).select(place.alias("place")).groupBy(F.expr("place div 8").alias("byte")).agg(byte.alias("bits"))
    found = set_bytes.toArrow()  # at most a row for each byte of the map
    out = np.zeros(bits // 8, np.uint8)
    out[found["byte"].to_numpy()] = found["bits"].to_numpy()
    return out


def phrase_rows(docs: DataFrame, kept: np.ndarray, max_words: int) -> DataFrame:
    """``lang, words, phrase, n`` of words and of phrases that the bitmap lets through, added up by task; ``words`` 0: all words."""
    shared = docs.sparkSession.sparkContext.broadcast(kept)
    bits = len(kept) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held, rows = shared.value, [], 0

        def passes(grams: np.ndarray) -> np.ndarray:
            place = np.mod(tk.as_long(grams), bits)
            return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

        def added(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by(["lang", "words", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "words", "phrase", "n"])

        def table(words: Pieces, part: pa.RecordBatch, at: np.ndarray, k: int) -> pa.Table:
            lang = part.column("lang").cast(pa.large_string()).take(pa.array(words.text[at]))
            return pa.table({"lang": lang, "words": pa.array(np.full(len(at), k, np.int32)), "phrase": words.phrases(at, k), "n": pa.array(np.ones(len(at), np.int64))})

        for batch in batches:
            for words, lang, part in _read(batch):
                run_on = np.ones(len(words.start), bool)
                tables = [table(words, part, np.flatnonzero(run_on), 1)]
                for k, (at, grams) in zip(range(2, max_words + 1), _grams(words, lang), strict=False):
                    run_on = np.zeros(len(words.start), bool)
                    run_on[at[passes(grams)]] = True
                    tables.append(table(words, part, np.flatnonzero(run_on), k))
                last = run_on  # of longer ones all parts of this length must pass
                for k in range(FILTER_WORDS + 1, max_words + 1):
                    run_on = run_on[:-1] & last[k - FILTER_WORDS :]
                    tables.append(table(words, part, np.flatnonzero(run_on), k))
                all_words = np.bincount(words.text, minlength=part.num_rows)
                tables.append(pa.table({"lang": part.column("lang").cast(pa.large_string()), "words": pa.array(np.zeros(part.num_rows, np.int32)), "phrase": pa.array([""] * part.num_rows, pa.large_string()), "n": pa.array(all_words)}))
                held.append(added(tables))
                rows += held[-1].num_rows
                if rows >= HELD_ROWS:
                    held = [added(held)]
                    if held[0].num_rows >= HELD_ROWS // 2:
                        yield from held.pop().to_batches()
                    rows = sum(t.num_rows for t in held)
        if held:
            yield from added(held).to_batches()

    return workspace.arrow_map(docs, run, "lang string, words int, phrase string, n long")


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, words, phrase, f``: phrases of 1 to ``max_words`` words that occur ``least`` times; ``words`` 0: all words of a language."""
    workspace.bounded_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    own = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.col(text_col).cast("string").alias("text"))
    counted = phrase_rows(own, frequent_bits(own, least), max_words).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
    return counted.filter((F.col("f") >= least) | (F.col("words") == 0))


def scored(counts: DataFrame) -> DataFrame:
    """Of :func:`phrase_counts`, written: ``lang, words, phrase, a, l, r, n, score`` of all phrases of two words and more, by their lowest cut."""
    whole = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    part = lambda name, f: counts.filter("words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), F.split("phrase", " ").alias("w"))
    cuts = cuts.select(
        "lang", "words", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    known = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(whole, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    upper = (exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).alias("upper")
    ratio = known.select("*", upper, (exact("l") * exact("r")).alias("lower")).withColumn("score", F.expr("upper div lower"))
    lowest = ratio.groupBy("lang", "words", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    return lowest.select("lang", "words", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """Without those whose words lie in a longer candidate that is as frequent.

    What lies between two phrases of one count has that count, so it is enough to look at one word more.
    """
    shorter = lambda first: F.array_join(F.slice(F.split("phrase", " "), 1 if first else 2, F.col("words") - 1), " ")
    longer = candidates.filter("words > 2")
    held = longer.select("lang", "a", F.explode(F.array(shorter(True), shorter(False))).alias("phrase"))
    return candidates.join(held, ["lang", "phrase", "a"], "left_anti")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score."""
    counts = workspace.materialise(phrase_counts(docs, lang_col, text_col, least, max_words), "phrases")
    best = maximal(workspace.materialise(scored(counts), "candidates"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language the 2,000 phrases that are most often together, of those that occur 100 times.

    Null texts are empty and a null language is ``und``; nulls in other columns play no part, nor do ids: repeated rows
    count as often as they are there. Texts of any length are read whole. Equal scores follow by count, then by phrase.
    Other columns are not read. An empty table gives an empty result.
    """
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM c WHERE k = 1 GROUP BY lang),
x AS (SELECT lang, k AS m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 100),
u AS (SELECT lang, m, phrase, a, ws, unnest(range(1, m)) AS cut FROM x),
s AS (SELECT u.*, l.f AS l, r.f AS r, n, (1000 * a::HUGEINT * n) // (l.f::HUGEINT * r.f) AS score FROM u JOIN n USING (lang)
  JOIN c l ON l.lang = u.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN c r ON r.lang = u.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
z AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = b.lang AND x.m > b.m AND 100 * x.a >= 100 * b.a AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM z) WHERE rank <= 2000
"""

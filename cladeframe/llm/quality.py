"""Quality rules with cross-document line frequency.

Base figures come from one pass over the text. Lines are normalised (lower case, runs of white space to one space) and
hashed; for each host the documents with a line are counted, a document once however often it has the line. A line in
more of a host's documents than the limit is taken out of all of them, and a document left with less than a share of
its words is rejected as depleted. The limit is one number, whatever the host's size. :func:`judge` says which
documents stay; :func:`accepted` also takes the lines out of their texts.

Copies are documents like any others, so a text with more copies in a host than the limit loses all its lines in all of
them. ``copies_once`` is for callers that take copies out later: rows of one host with equal text count as one
document, as if copies had been taken out before, and the first document with a frequent line keeps it, so that one of
a group of near copies is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cladeframe.llm import textkernels as tk
from cladeframe.llm import workspace

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A line is frequent in a host above this many documents.
LINE_DOCUMENTS = 50
#: A document that keeps less than this share of its words is depleted.
KEPT_SHARE = 0.25


def repeated_words(words: tk.Words, k: int = 3) -> np.ndarray:
    """Words in each text that lie in a k-word window found twice or more in the text."""
    n = len(words.start)
    at, grams = words.grams(words.hashes(), k)
    key = tk.mix(grams ^ tk.mix(words.text[at].astype(np.uint64)))  # equal only inside one text
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = tk.cover(at[order[twice]], k, n)
    return np.bincount(words.text[hit], minlength=len(words.count))


def line_facts(text: str) -> tuple[int, list[int], list[int]]:
    """Later lines equal to an earlier one; normalised lines' hashes and words (a repeated line counts with all its words)."""
    seen: set[str] = set()
    dup, found = 0, {}
    for line in text.split("\n"):
        parts = [w for w in _words(line) if w]
        if not parts:
            continue
        if line in seen:
            dup += 1
        seen.add(line)
        key = " ".join(parts).lower()
        found[key] = found.get(key, 0) + len(parts)
    return dup, [_line_hash(k) for k in found], list(found.values())


_TO_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")


def _words(line: str) -> list[str]:
    return line.translate(_TO_SPACE).split(" ")


def _line_hash(normalised: str) -> int:
    return int.from_bytes(hashlib.md5(normalised.encode()).digest()[:8], "little", signed=True)


def without_lines(text: str, hashes: set[int]) -> str:
    """The text without the lines whose normalised form has one of the hashes; other lines stay as they are."""
    stays = lambda parts: not parts or _line_hash(" ".join(parts).lower()) not in hashes
    return "\n".join(line for line in text.split("\n") if stays([w for w in _words(line) if w]))


def base_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            raw, offsets = tk.buffer(part.column("text"))
            words = tk.Words(raw, offsets)
            before = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])  # noqa: B023,E731
            texts = [t or "" for t in part.column("text").to_pylist()]
            facts = [line_facts(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("host"),
                    part.column("unit"),
                    pa.array(words.count, pa.int64()),
                    pa.array(before(words.solid & ((raw & 0xC0) != 0x80)), pa.int64()),
                    pa.array(before(SYMBOLS[raw]), pa.int64()),
                    pa.array([f[0] for f in facts], pa.int64()),
                    pa.array(repeated_words(words), pa.int64()),
                    pa.array([f[1] for f in facts], pa.list_(pa.int64())),
                    pa.array([f[2] for f in facts], pa.list_(pa.int64())),
                ],
                ["doc_id", "host", "unit", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes", "line_words"],
            )


BASE_SCHEMA = (
    "doc_id long, host string, unit long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, line_hashes array<long>, line_words array<long>"
)


def _text_hash(text: Column) -> Column:
    """Tells the texts of one host apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def base(docs: DataFrame, id_col: str, text_col: str, host_col: str, copies_once: bool) -> DataFrame:
    """Base figures of each row; ``unit`` is the document within its host: the row, or its text if copies count once."""
    workspace.bounded_batches(docs.sparkSession)
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        (_text_hash(F.col(text_col)) if copies_once else F.monotonically_increasing_id()).alias("unit"),
    )
    return workspace.arrow_map(own, base_rows, BASE_SCHEMA)


def _verdicts(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, line_documents: int, kept_share: float, copies_once: bool
) -> DataFrame:
    """What :func:`judge` says, with ``host, unit`` and the hashes of the lines that go from the text (null: none)."""
    facts = workspace.materialise(base(docs, id_col, text_col, host_col, copies_once), "quality")
    of_host = ["host", "line"]
    lines = facts.select("host", "unit", "doc_id", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("l")).select(
        "host", "unit", "doc_id", F.col("l.line_hashes").alias("line"), F.col("l.line_words").alias("words")
    )
    if copies_once:
        lines = lines.groupBy(*of_host, "unit").agg(F.min("doc_id").alias("doc_id"), F.max("words").alias("words"))
    owner = F.min(F.struct("doc_id", "unit"))["unit"] if copies_once else F.lit(None).cast("long")
    counts = lines.groupBy(*of_host).agg(F.count(F.lit(1)).alias("documents"), owner.alias("owner"))
    # written before they meet the lines: a line that a whole host has is then a skewed join, which can be split
    frequent = workspace.materialise(counts.filter(F.col("documents") > line_documents).drop("documents"), "frequent")
    met = lines.join(frequent, of_host).filter(~F.col("unit").eqNullSafe(F.col("owner")))
    lost = workspace.materialise(
        met.groupBy("host", "unit").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("cut_lines")), "lost"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    removed = F.coalesce(F.col("removed_words"), F.lit(0))
    return (
        facts.drop("line_hashes", "line_words")
        .join(lost, ["host", "unit"], "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & (F.col("n_words") - removed >= F.lit(kept_share) * F.col("n_words"))).alias("kept"),
            F.coalesce(F.array_size("cut_lines"), F.lit(0)).cast("long").alias("removed_lines"),
            removed.alias("removed_words"),
            "host", "unit", "cut_lines",
        )
    )


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    line_documents: int = LINE_DOCUMENTS,
    kept_share: float = KEPT_SHARE,
    copies_once: bool = False,
) -> DataFrame:
    """Per row: the base figures, base_failed, lines and words removed, and kept.

    A null text counts as empty (no words, so base_failed); a null host is one host. Repeated rows, and rows with null
    or repeated ids, are documents of their own (with ``copies_once``, equal texts of a host are one document). Lines of
    equal frequency are treated alike; the limit itself is not above the limit. Other columns are not read. An empty
    table gives an empty result.
    """
    return _verdicts(docs, id_col, text_col, host_col, line_documents, kept_share, copies_once).drop("host", "unit", "cut_lines")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the base rules' counts, the lines and words that are too frequent on its host, and the verdict.

    A null or empty text has no words and fails the base rules. Null sources are one host. Repeated rows, and rows with
    null or repeated ids, are documents of their own and count as such. Lines that tie are treated alike. Texts of any
    length are read whole. Other columns are not read. An empty table gives an empty result.
    """
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


@F.pandas_udf(StringType())
def _cut(texts: pd.Series, cut_lines: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else without_lines(t, set(c.tolist())) for t, c in zip(texts, cut_lines, strict=True)], dtype=object)


def accepted(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars"
) -> DataFrame:
    """The rows that the rules keep, without the frequent lines of their texts; ``chars_col`` follows the text.

    Copies count once and the first document with a frequent line keeps it. All columns of ``docs`` stay as they are;
    rows alike in id, text and host are judged alike, and null ids and texts as in :func:`judge`.
    """
    names = ("kept_id", "kept_host", "kept_text")
    verdict = _verdicts(docs, id_col, text_col, host_col, LINE_DOCUMENTS, KEPT_SHARE, True).filter("kept")
    verdict = verdict.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "host", "unit"), names, strict=True)), "cut_lines")
    verdict = verdict.groupBy(*names).agg(F.first("cut_lines").alias("cut_lines"))  # rows alike in all three are judged alike
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), _text_hash(F.col(text_col)).alias("text_hash"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
    )
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_text")) & (F.col("host") == F.col("kept_host"))
    cut, old = F.col("cut_lines").isNotNull(), F.col("row").getField(text_col)
    # texts that lose nothing do not travel to Python
    out = rows.join(verdict, same).withColumn("left_text", _cut(F.when(cut, old.cast("string")), "cut_lines"))
    row = F.col("row").withField(text_col, F.when(cut, F.col("left_text")).otherwise(old))
    if chars_col in docs.columns:
        count = F.char_length("left_text").cast(docs.schema[chars_col].dataType)
        row = row.withField(chars_col, F.when(cut, count).otherwise(F.col("row").getField(chars_col)))
    return out.select(row.alias("row")).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS twice FROM g),
r AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words FROM (
        SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM t) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
lines AS (SELECT doc_id, host, line, lower(array_to_string(ws, ' ')) AS norm, len(ws) AS n FROM lw WHERE len(ws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
pd AS (SELECT doc_id, host, norm, sum(n) AS n FROM lines GROUP BY ALL),
f AS (SELECT host, norm FROM pd GROUP BY ALL HAVING count(*) > 50),
lost AS (SELECT doc_id, sum(n)::BIGINT AS removed_words, count(*) AS removed_lines FROM pd JOIN f USING (host, norm) GROUP BY ALL),
b AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM w),
x AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed,
        coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_words, 0) AS removed_words
      FROM b LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND n_words - removed_words >= 0.25 * n_words AS kept,
  removed_lines, removed_words FROM x
"""

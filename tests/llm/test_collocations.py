"""Collocations against counting everything, with small and with the contract's settings."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from cladeframe.llm import collocations as cl

KIND = "lang string, text string"


def everything(rows, least, longest, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n, out = collections.Counter(), collections.Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    for lang in n:
        mine = []
        for (of, w), a in found.items():
            if of != lang:
                continue
            longer = (x for (o, x), b in found.items() if o == lang and len(x) > len(w) and 100 * b >= 100 * a)
            if any(x[i : i + len(w)] == w for x in longer for i in range(len(x) - len(w) + 1)):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            mine.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(out)


def prose(rng, texts):
    words = ["New", "york", "city", "É", "b", "C", "d", "the", "of", "漢"]
    end = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "?!"]
    return [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice(end) for _ in range(rng.randrange(80)))) for _ in range(texts)]


@pytest.mark.parametrize("least,longest,top", [(4, 5, 30), (9, 3, 2000), (1, 2, 10), (3, 7, 15)])
def test_collocations(spark, least, longest, top):
    rows = prose(random.Random(least), 60) + [("en", None), ("en", ""), (None, None), ("xx", "lonely"), ("en", "a b c d e f " * 40), ("fr", "q" * 9000)]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    got = cl.collocations(docs, least=least, max_words=longest, top=top).collect()
    assert sorted(map(tuple, got)) == everything(rows, least, longest, top)


def test_filter_only_saves_rows(spark):
    """A map of few bits, where everything collides, lets all phrases through and changes nothing."""
    rows = prose(random.Random(1), 40)
    own = cl.F
    docs = spark.createDataFrame(rows, KIND).select("lang", own.xxhash64("lang").alias("lang_hash"), "text").fillna("und", ["lang"])
    count = lambda bits: {tuple(r) for r in cl.phrase_rows(docs, bits, 5).groupBy("lang", "words", "phrase").agg(own.sum("n").alias("f")).filter("f >= 5 or words = 0").collect()}
    sharp = cl.frequent_bits(docs, 5)
    assert count(sharp) == count(np.full(1, 255, np.uint8)) and 0 < np.unpackbits(sharp).sum() < 5000


def test_settings_of_the_query_against_sql(spark, tmp_path):
    rows = prose(random.Random(2), 600) + [("en", "Over 9,000 of them. ") for _ in range(99)] + [("en", "one hundred times; ") for _ in range(100)]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    got = cl.op13_collocations(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = duck.sql(cl.ORACLE)
    assert got.columns == found.columns
    rows_got = sorted(map(tuple, got.collect()))
    assert rows_got == sorted(found.fetchall()) and any(r[2] == "one hundred times" for r in rows_got) and not any("of them" == r[2] for r in rows_got)

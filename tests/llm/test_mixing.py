"""Targets against the rule itself, tilts against the balance they must keep, copies against targets and limits."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import mixing


def by_rule(sizes):
    """Shares by weight; what is above three times a size is shared anew until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        rest, share = sum(sizes.values()) - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: float(3 * sizes[s]) if s in full else rest * weight[s] / share for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def corpus(rng, shape):
    """Rows of (doc_id, text, source) with the given documents and longest text of each source."""
    rows = [(f"{s}" if s is not None else None, rng.randrange(1, longest + 1)) for s, (n, longest) in shape.items() for _ in range(n)]
    return [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(rows)]


SHAPES = [
    {"a": (400, 30), "b": (90, 300), "c": (50, 9), "É": (60, 100), None: (80, 50), "": (70, 40)},
    {"big": (900, 200), "few": (40, 20), "one": (1, 500), "z": (30, 60)},  # little sources reach the limit
    {"a": (200, 1), "b": (100, 1), "c": (100, 1)},  # one size
    {"only": (50, 40)},
]


@pytest.mark.parametrize("shape", SHAPES)
def test_mix(spark, shape):
    rows = corpus(random.Random(3), shape)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    source = {i: s for i, _, s in rows}
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(list(source))
    sizes, taken, target, longest = (collections.defaultdict(float) for _ in range(4))
    for i, text, s in rows:
        sizes[s] += len(text.split())
    want = by_rule(sizes)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[s] and 0 <= r["copies"] <= 3
        taken[s] += r["size"] * r["copies"]
        target[s] = r["target"]
        longest[s] = max(longest[s], r["size"])
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-12)
        few = collections.Counter(source.values())[s] < 5
        assert abs(taken[s] - want[s]) <= (longest[s] / 2 if few else max(3, 0.01 * want[s])), s
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_tilts_balance(spark):
    """Rates min(3, exp(tilt * size / mean)) give each source its words; no other rates are nearer to one copy of everything."""
    sizes = {"up": {1: 50, 10: 20, 400: 3}, "down": {5: 30, 7: 30, 9000: 1}, "full": {3: 9, 4: 9}, "same": {2: 10}}
    wanted = {"up": 2.5, "down": 0.07, "full": 3.0, "same": 1.0}
    rows = [(s, k, n) for s, h in sizes.items() for k, n in h.items()]
    total = {s: sum(k * n for k, n in h.items()) for s, h in sizes.items()}
    have = spark.createDataFrame(rows, "key string, size long, n long")
    want = spark.createDataFrame([(s, total[s], wanted[s] * total[s]) for s in sizes], "key string, source_size long, target double")
    found = {r["key"]: r for r in mixing.tilts(have, want).collect()}
    assert found.keys() == sizes.keys()
    for s, h in sizes.items():
        rate = lambda k: min(3.0, math.exp(found[s]["tilt"] * k / found[s]["mean"]))  # noqa: B023,E731
        assert sum(k * n * rate(k) for k, n in h.items()) == pytest.approx(wanted[s] * total[s], rel=1e-6)
    assert found["same"]["tilt"] == 0


def test_drawn_rows(spark):
    rows = corpus(random.Random(4), {"a": (60, 9), "b": (60, 9)}) + [(None, "x y", "a"), (None, "x y", "a"), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("kept"))
    plan, out = mixing.mix(docs).collect(), mixing.drawn(docs)
    assert out.columns == docs.columns
    want = collections.Counter()
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in out.collect()) == +want


def test_one_cell_of_many_rows(spark):
    """Documents of one size in one source are told apart by part and hash, and together get their copies."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs).groupBy("key.name").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.max("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 3 for r in got)

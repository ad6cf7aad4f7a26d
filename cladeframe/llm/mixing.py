"""Mixing sources to target weights by entropy balancing.

Sources share the words of the whole corpus by weight; none is repeated beyond a limit, and what a source cannot take is
shared anew by weight. Of all document rates that give each source its words, those nearest to one copy of everything
(by relative entropy over documents, no rate above the limit) are exponentially tilted by size:
``rate = min(limit, exp(tilt * size / mean size))``. A source's tilt is the solution of the convex dual, found by Newton
steps over the histogram of sizes, each step one aggregate on the cluster, held in a bracket that bisection narrows.

Rates become whole copies by systematic rounding along each source's sizes, so that no stretch of sizes is favoured and a
source's words stray by no more than one document. A last step spends that remainder on a few documents of falling size.
All sums are of integers or decimals, so that a run gives the same copies however its tasks are scheduled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.llm import workspace

WEIGHTS = (5, 2, 1)
#: Copies of a document, and of a source's words, at most.
LIMIT = 3
#: Parts that documents of one source and size are split into by hash.
SALTS = 64
#: Newton steps at most, and the relative error of a source's words at which they end.
STEPS, NEAR = 60, 1e-7
#: Sizes of each power of two that the remainder may be spent on, in either direction.
SPARE = 4

_EXACT = "decimal(38,0)"
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, key, size, salt, tie``: words of each row's text; ``key`` is the source, told apart from a null one."""
    text, source = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(source_col).cast("string")
    tie, own_id = F.xxhash64(text), F.col(id_col).cast("long")
    return docs.select(
        own_id.alias("doc_id"), F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("key"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"), F.pmod(F.xxhash64(own_id, tie), F.lit(SALTS)).cast("int").alias("salt"), tie.alias("tie"),
    )


def sums_before(rows: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """Adds, for each row, sums over all rows before it in an order without ties: ranges side by side, an offset for each."""
    parts = workspace.materialise(rows.repartitionByRange(F.col(order)).withColumn("part", F.spark_partition_id()), "ranges")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside, across = earlier(Window.partitionBy("part").orderBy(order)), earlier(Window.orderBy("part"))
    total = lambda of, w: F.coalesce(F.sum(F.expr(of)).over(w), F.lit(0))
    whole = parts.groupBy("part").agg(*(F.sum(F.expr(of)).alias(f"in_{name}") for name, of in sums.items()))  # a row for each range
    offsets = whole.select("part", *(total(f"in_{name}", across).alias(f"off_{name}") for name in sums))
    own = parts.withColumns({f"own_{name}": total(of, inside) for name, of in sums.items()}).join(offsets, "part")
    return own.select(*rows.columns, *((F.col(f"own_{n}") + F.col(f"off_{n}")).alias(n) for n in sums))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``key, source_size, target`` of ``key, source_size``: words by weight in order of the sources, null last.

    A source stops at ``limit`` times its words; the excess is shared by weight among the others. Filled in order of
    limit to weight, the sources at their limit are the first ones, so that one running sum finds the level of the rest.
    """
    placed = sums_before(sources, "key", {"place": "1"})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    exact = lambda c: c.cast(_EXACT)
    weighed = placed.select("key", "source_size", exact(weight).alias("weight"), exact(F.col("source_size") * limit).alias("most"))
    ordered = weighed.withColumn("fill", F.struct((F.col("most").cast("double") / F.col("weight").cast("double")).alias("ratio"), "key"))
    filled = workspace.materialise(sums_before(ordered, "fill", {"spent": "most", "passed": "weight"}), "filled")
    words, every = (exact(F.lit(x or 0)) for x in filled.agg(F.sum("source_size"), F.sum("weight")).first())
    rest, share = words - F.col("spent"), every - F.col("passed")
    free = F.col("most") * share >= F.col("weight") * rest
    level = filled.filter(free).agg(F.min_by(F.struct(rest.alias("rest"), share.alias("share")), "fill").alias("x")).first()["x"]  # one row
    rest, share = (F.lit(level[k]) if level else F.lit(None) for k in ("rest", "share"))
    target = F.when(F.col("most") * share >= F.col("weight") * rest, (F.col("weight") * rest).cast("double") / share.cast("double")).otherwise(F.col("most").cast("double"))
    return filled.select("key", "source_size", target.alias("target"))


def _rate(limit: int) -> Column:
    return F.least(F.lit(float(limit)), F.exp(F.col("tilt") * F.col("size") / F.col("mean")))


def tilts(sizes: DataFrame, wanted: DataFrame, limit: int = LIMIT, near: float = NEAR, steps: int = STEPS) -> DataFrame:
    """``key, mean, tilt`` of ``key, size, n`` and ``key, target``: the dual's solution for each source with words.

    Each step adds up a source's words and their slope at its present tilt. The next tilt is Newton's for the logarithm
    of the words (convex below one copy of everything), or the middle of the bracket where that leads out of it.
    """
    known = sizes.filter("size > 0")
    begin = known.groupBy("key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    top = math.log(limit) * F.col("mean") / F.col("least")  # all rates are at the limit
    state = begin.join(wanted, "key").select(
        "key", "mean", "target", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), top.alias("high"), F.lit(None).cast("double").alias("error")
    )
    state = workspace.materialise(state, "tilts")
    fixed = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    words = F.col("n") * F.col("size") * _rate(limit)
    slope = F.when(_rate(limit) < limit, words * F.col("size") / F.col("mean")).otherwise(0.0)
    for _ in range(steps):
        at = known.join(state, "key").groupBy("key").agg(fixed(words).alias("words"), fixed(slope).alias("slope"))
        now = state.join(at, "key")
        over = F.col("words") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.nullif("slope", F.lit(0.0))
        inside = F.coalesce((newton < high) & (low.isNull() | (newton > low)), F.lit(False))
        middle = F.when(low.isNull(), 2 * high - 1).otherwise((low + high) / 2)
        error = F.abs(F.col("words") - F.col("target")) / F.col("target")
        moved = F.when(error <= near, F.col("tilt")).when(F.col("target") >= limit * F.col("source_size"), F.col("high")).when(inside, newton).otherwise(middle)
        state = workspace.materialise(now.join(wanted.select("key", "source_size"), "key").select("key", "mean", "target", moved.alias("tilt"), low.alias("low"), high.alias("high"), error.alias("error")), "tilts")
        if not state.filter(F.col("error") > near).limit(1).count():
            break
    return state.select("key", "mean", "tilt")


def rounded(sizes: DataFrame, tilted: DataFrame, wanted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``key, size, n, copies``: whole copies of all documents of a source and size together."""
    along = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rated = sizes.join(tilted, "key", "left").select("key", "size", "n", F.when(F.col("size") > 0, _rate(limit)).otherwise(1.0).alias("rate"))
    expected = (F.col("n") * F.col("rate")).cast("decimal(38,9)")
    upto = F.sum("expected").over(along)
    whole = lambda c: F.floor(c + F.lit(0.5).cast("decimal(2,1)")).cast("long")
    first = rated.withColumn("expected", expected).withColumn("upto", upto).select("key", "size", "n", (whole(F.col("upto")) - whole(F.col("upto") - F.col("expected"))).alias("copies"))
    first = workspace.materialise(first, "copies")
    left = first.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(wanted, "key").select("key", (F.col("target") - F.col("taken")).alias("left"))
    more, fewer = F.col("copies") < F.col("n") * limit, F.col("copies") > 0
    rank = lambda may: F.when(may, F.row_number().over(Window.partitionBy("key", "octave", may).orderBy("size")))
    spare = first.filter("size > 0").withColumn("octave", F.floor(F.log2("size"))).withColumn("more", more).withColumn("fewer", fewer)
    spare = spare.withColumn("up", rank(F.col("more"))).withColumn("down", rank(F.col("fewer"))).filter((F.col("up") <= SPARE) | (F.col("down") <= SPARE))
    # at most twice SPARE sizes for each power of two
    each = spare.groupBy("key").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "more", "fewer")))).alias("sizes")).join(left, "key")

    def spend(so_far: Column, s: Column) -> Column:
        step = F.when(s["more"] & (so_far["left"] > s["size"] / 2), 1).when(s["fewer"] & (so_far["left"] < -s["size"] / 2), -1).otherwise(0)
        return F.struct((so_far["left"] - step * s["size"]).alias("left"), F.array_append(so_far["steps"], F.struct(s["size"].alias("size"), step.alias("step"))).alias("steps"))

    begin = F.struct(F.col("left").alias("left"), F.expr("cast(array() as array<struct<size: bigint, step: int>>)").alias("steps"))
    steps = each.select("key", F.explode(F.aggregate("sizes", begin, spend)["steps"]).alias("s")).filter("s.step <> 0").select("key", "s.size", "s.step")
    return first.join(steps, ["key", "size"], "left").select("key", "size", "n", (F.col("copies") + F.coalesce("step", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``doc_id, key, tie, size, source_size, target, copies`` for each row."""
    rows = workspace.materialise(sized(docs, id_col, text_col, source_col), "sizes")
    cells = workspace.materialise(rows.groupBy("key", "size", "salt").agg(F.count(F.lit(1)).alias("here")), "cells")
    sizes = workspace.materialise(cells.groupBy("key", "size").agg(F.sum("here").alias("n")), "histogram")
    sources = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = workspace.materialise(targets(sources, weights, limit), "targets")
    copies = rounded(sizes, tilts(sizes, wanted, limit), wanted, limit)
    # those of one source and size get as many each, and the rest goes to the parts by their rows
    along = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = cells.withColumn("upto", F.sum("here").over(along)).join(copies, ["key", "size"]).withColumn("extra", F.expr("copies % n"))
    share = lambda upto: F.expr(f"cast(extra as {_EXACT}) * ({upto}) div n")
    parts = spread.select("key", "size", "salt", F.expr("copies div n").alias("each"), (share("upto") - share("upto - here")).alias("more")).join(wanted, "key")
    nth = F.row_number().over(Window.partitionBy("key", "size", "salt").orderBy(F.xxhash64("doc_id", "tie"), "doc_id", "tie"))
    chosen = rows.withColumn("nth", nth).join(parts, ["key", "size", "salt"])
    return chosen.select("doc_id", "key", "tie", "size", "source_size", "target", (F.col("each") + (F.col("nth") <= F.col("more")).cast("long")).alias("copies"))


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as its copies say."""
    plan = mix(docs, id_col, text_col, source_col, weights, limit)
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tie"),
        F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("key"),
    )
    same = ("doc_id", "tie", "key")
    number = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))  # noqa: E731  rows alike in all three
    p = number(plan.filter("copies > 0").select(*same, "copies")).select(*(F.col(c).alias(f"p_{c}") for c in (*same, "nth", "copies")))
    met = number(rows).join(p, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*same, "nth")])
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("p_copies").cast("int")))).select("row.*")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words, its source's words and target, and the words that the mix takes of it.

    Null and empty texts have no words and give none. A null source is the last one, apart from an empty name. Rows with
    null or repeated ids, and repeated rows, stand for themselves and get copies of their own. Documents of one size in
    a source are told apart by a hash of id and text. A text is counted whole, whatever its length, and taken whole or
    not at all, so that a source of few documents comes as near as these allow. An empty table gives an empty result.
    """
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")

"""From banded signatures to classes of near duplicates.

Signatures' bands travel packed (see ``blobs``): items that share a band inside one task are told there, and of those
and of equal bags one goes on, so a group of copies costs a row for each task and not for each member. Items with equal
bags collapse to one representative. Representatives that share a band are a bucket; each is compared with the bucket's
lead, the member that meets most others (a star, not all pairs), and the links found are closed to components.

What a star can miss is a link between two members that do not both link to their lead. Two or three such members are
compared as they are; links of more are found through the members' differences from the lead (:mod:`differences`),
exactly and without pairs of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import blobs, differences, workspace
from cladeframe.llm.components import components
from cladeframe.llm.differences import SIMILAR

class Signed(NamedTuple):
    """Signatures of some items: keys, sizes, two 64-bit digests of each bag, rows of item and band, and where items stand."""

    keys: np.ndarray
    sizes: np.ndarray
    bag1: np.ndarray
    bag2: np.ndarray
    who: np.ndarray
    bands: np.ndarray
    places: tuple[np.ndarray, ...] = ()


FOUND, ENTRY, ITEM = range(3)
#: Bands that a task gathers before it deals them out, and those for which there is a bucket.
FLUSH = 1 << 19
BUCKET_BANDS = 1 << 20

ROWS = "kind int, key long, size long, bag1 long, bag2 long, bucket long, doc long, pos long"
ARROW = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("key", "size", "bag1", "bag2", "bucket", "doc", "pos"))])


def _send(sign: Callable[[pa.RecordBatch], Iterator[Signed]], buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sender = blobs.Sender()
    held: list[Signed] = []
    size = 0

    def flush() -> list[tuple[int, int, int, bytes]]:
        first = np.cumsum([0, *(len(s.keys) for s in held)])
        keys, sizes, bag1, bag2 = (np.concatenate([s[i] for s in held]) for i in range(4))
        places = [np.concatenate(c) for c in zip(*(s.places for s in held), strict=True)]
        who = np.concatenate([s.who + n for s, n in zip(held, first, strict=False)])
        bands = np.concatenate([s.bands for s in held]).view(np.uint64)
        by = np.argsort(keys, kind="stable") if (keys[1:] < keys[:-1]).any() else slice(None)
        home = (keys % buckets).astype(np.int64)
        rows = sender.deal(ITEM, home[by], keys[by], sizes[by], bag1[by].view(np.uint64), bag2[by].view(np.uint64), *(c[by] for c in places))
        # of equal bags one goes on
        on = np.zeros(len(keys), bool)
        on[np.unique(bag1, return_index=True)[1]] = True
        mine = on[who]
        ids, bands = bag1[who[mine]], bands[mine]
        bucket = ((bands >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        name = (bucket << 32) | (bands & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(name)
        ids, bucket, name = ids[order], bucket[order], name[order]
        head = np.ones(len(name), bool)
        head[1:] = name[1:] != name[:-1]
        at = np.flatnonzero(head)
        count = np.diff(np.append(at, len(name)))
        many = np.repeat(count > 1, count)
        rows += sender.deal(FOUND, bucket[many], ids[many].view(np.uint64), name[many], np.repeat(count, count)[many])
        one, settled = ids[at], (count > 1).astype(np.uint8)
        by = np.argsort(one)
        rows += sender.deal(ENTRY, bucket[at][by], name[at][by].astype(np.uint32), one[by], settled[by])
        return rows

    for batch in batches:
        for signed in sign(batch):
            held.append(signed)
            size += len(signed.bands) + len(signed.keys)
            if size >= FLUSH:
                yield from blobs.batches(flush())
                held, size = [], 0
    if held:
        yield from blobs.batches(flush())


def _meet(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(n, pa.int64())
        cells = [pa.array(columns[c].view(np.int64)) if c in columns else none for c in ARROW.names[1:]]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *cells], schema=ARROW)

    for bucket, parts in blobs.by_bucket(stream):
        held = []
        for kind, payload in parts:
            columns = blobs.unpack(payload)
            if kind == ENTRY:
                held.append(columns)
            elif kind == FOUND:
                yield rows(FOUND, len(columns[0]), bag1=columns[0], bucket=columns[1], size=columns[2])
            else:
                yield rows(ITEM, len(columns[0]), **dict(zip(("key", "size", "bag1", "bag2", "doc", "pos"), columns, strict=False)))
        if held:
            prints, ids, settled = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort((prints.astype(np.uint64) << np.uint64(32)) | (ids.view(np.uint64) >> np.uint64(32)))
            prints, ids, settled = prints[order], ids[order], settled[order]
            new = np.concatenate([[True], prints[1:] != prints[:-1]])
            other = new | np.concatenate([[True], ids[1:] != ids[:-1]])
            at = np.flatnonzero(new)
            company = np.repeat(np.add.reduceat(other, at, dtype=np.int64), np.diff(np.append(at, len(order))))
            found = np.flatnonzero(other & (settled == 0) & (company > 1))
            if len(found):
                yield rows(FOUND, len(found), bag1=ids[found], bucket=(np.int64(bucket) << 32) | prints[found].astype(np.int64), size=company[found])


def banded(items: DataFrame, sign: Callable[[pa.RecordBatch], Iterator[Signed]], bands: int, each: int = 1) -> tuple[DataFrame, DataFrame]:
    """``key, size, bag1, bag2, doc, pos`` of all items; ``bucket, bag1, company`` of bags that share a band with others.

    A bag may stand in a bucket more than once; ``company`` says how many it was met with there.

    ``each`` says how many items a row of ``items`` has, about; it only sets the number of buckets.
    """
    n = max(16, items.count() * each * bands // BUCKET_BANDS)
    rows = workspace.arrow_map(items, lambda b: _send(sign, n, b), blobs.SCHEMA)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "kind", "src")
    rows = workspace.materialise(workspace.arrow_map(rows, _meet, ROWS), "banded")
    signed = rows.filter(F.col("kind") == ITEM).select("key", "size", "bag1", "bag2", "doc", "pos")
    return signed, rows.filter(F.col("kind") == FOUND).select("bucket", "bag1", F.col("size").alias("company"))


#: Members of a group that are compared one by one.
FEW = 3


class Verifier(Protocol):
    """What knows the items themselves."""

    #: Whether sizes are those of the bags, so that they bound what can be similar.
    sized: bool

    def prepare(self, keys: DataFrame) -> None:
        """Keys (column ``key``) that the other calls can name."""

    def check(self, pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` with their other columns (long), ``similarity`` and ``linked``."""

    def differences(self, pairs: DataFrame, gather: Callable[[], "differences.Gather"]) -> DataFrame:
        """What a gatherer makes of the bags of pairs ``a, b`` with their other columns."""


def comparable(a: str, b: str, share: tuple[int, int] = SIMILAR) -> Column:
    """Whether sizes leave room for the similarity: the lesser is at least that share of the greater."""
    return share[1] * F.least(a, b) >= share[0] * F.greatest(a, b)


def _led(members: DataFrame) -> DataFrame:
    """``a, b, a_size, b_size``: every member of a bucket with the bucket's lead, the member with most company in all its buckets."""
    company = members.groupBy("rep").agg(F.sum("company").alias("company"))
    met = members.drop("company").join(workspace.materialise(company, "company"), "rep")
    # company decides, then a hash of the member: numbers, so that they are aggregated in hash maps
    met = met.withColumn("rank", F.col("company") * (1 << 20) + F.xxhash64("rep").bitwiseAND((1 << 20) - 1))
    leads = met.groupBy("bucket").agg(F.max_by("rep", "rank").alias("a"), F.max_by("size", "rank").alias("a_size"))
    led = members.join(workspace.materialise(leads, "leads"), "bucket").filter("rep <> a")
    return led.select("a", F.col("rep").alias("b"), "a_size", F.col("size").alias("b_size")).distinct()


def _open(pairs: DataFrame, near: float) -> DataFrame:
    """``a, b, comp, linked``: of ``a, b, a_comp, comp, similarity, linked``, what can have links that the star missed.

    Such a link has an end that is not linked to the lead. The other is not either, or it is, and then (Jaccard
    distance is a metric) the first's similarity to the lead is 2t - 1 or more and the second's is t short of one at most.
    """
    loose = ~F.col("linked")
    apart = F.max(F.when(loose & (F.col("comp") != F.col("a_comp")), F.col("similarity"))).alias("apart")
    groups = pairs.groupBy("a").agg(F.min(F.when(loose, F.col("comp"))).alias("low"), F.max(F.when(loose, F.col("comp"))).alias("high"), apart)
    groups = groups.select("a", (F.col("low") != F.col("high")).alias("several"), F.coalesce("apart", F.lit(-1.0)).alias("apart"), (F.col("apart") >= near).alias("between"))
    groups = workspace.materialise(groups.filter("several or between"), "open")
    held = pairs.join(groups, "a").filter(
        F.when(loose, F.col("several") | ((F.col("comp") != F.col("a_comp")) & (F.col("similarity") >= near)))
        .otherwise(F.col("between") & (F.col("similarity") <= F.col("apart") + (1 - SIMILAR[0] / SIMILAR[1]) + 1e-9))
    )
    return held.select("a", "b", "comp", "linked", F.coalesce("between", F.lit(False)).alias("between"), "a_size", "b_size")


def classes(signed: DataFrame, shared: DataFrame, verifier: Verifier, alone: bool = True) -> DataFrame:
    """``key, class, doc, pos`` for every item, given what :func:`banded` returns; class is the least key of the class.

    Without ``alone``, only items of classes of several.

    Items of size 0 have nothing to compare and are classes of their own.
    """
    near = (2 * SIMILAR[0] - SIMILAR[1], SIMILAR[1])
    bags = signed.filter("size > 0").groupBy("bag1", "bag2").agg(F.min("key").alias("rep"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    bags = workspace.materialise(bags, "bags")
    members = shared.join(bags.select("bag1", "rep", "size"), "bag1").select("bucket", "rep", "size", "company")
    led = workspace.materialise(_led(workspace.materialise(members, "members")), "led")
    verifier.prepare(led.select(F.col("a").alias("key")).unionByName(led.select(F.col("b").alias("key"))).distinct())

    fit = comparable("a_size", "b_size", near) if verifier.sized else F.lit(True)
    told = workspace.materialise(verifier.check(led.filter(fit)), "star")
    comps = workspace.materialise(components(told.filter("linked").select("a", "b")), "first")
    placed = told.unionByName(led.filter(~fit).select("*", F.lit(0.0).alias("similarity"), F.lit(False).alias("linked")))
    placed = placed.join(comps.select(F.col("node").alias("b"), "comp"), "b", "left")
    placed = placed.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("a_comp")), "a", "left")
    placed = placed.withColumns({"comp": F.coalesce("comp", "b"), "a_comp": F.coalesce("a_comp", "a")})
    held = workspace.materialise(_open(workspace.materialise(placed, "placed"), near[0] / near[1] - 1e-9), "held")
    # where two or three members are left, they are compared as they are
    count = held.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a_size") + F.col("b_size")).alias("weight"))
    count = workspace.materialise(count, "count")
    held = held.join(count, "a")
    few = held.filter(F.col("n") <= FEW).select("a", "b", "comp", "linked")
    two = few.join(few.select("a", *(F.col(c).alias(f"{c}2") for c in ("b", "comp", "linked"))), "a")
    two = two.filter("b < b2 and comp <> comp2 and not (linked and linked2)").select(F.col("b").alias("a"), F.col("b2").alias("b")).distinct()
    links = verifier.check(workspace.materialise(two, "two")).filter("linked").select("a", "b")
    for end in ("a", "b"):
        links = links.join(comps.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp")), end, "left")
    links = links.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    more = differences.links(workspace.materialise(held.filter(F.col("n") > FEW), "many"), verifier)
    links = workspace.materialise(links if more is None else links.unionByName(more), "links")
    if not links.isEmpty():  # between components of the star
        joined = workspace.materialise(components(links).select(F.col("node").alias("comp"), F.col("comp").alias("all")), "joined")
        every = comps.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left_anti").select("node", F.col("node").alias("comp")))
        comps = workspace.materialise(every.join(joined, "comp", "left").select("node", F.coalesce("all", "comp").alias("comp")), "last")
    # bags of several items and those that have a class; any other item is its own
    named = bags.join(comps.withColumnRenamed("node", "rep"), "rep", "left").filter("comp is not null or n > 1")
    named = workspace.materialise(named.select("bag1", "bag2", F.coalesce("comp", "rep").alias("class")), "classes")
    return signed.join(named, ["bag1", "bag2"], "left" if alone else "inner").select("key", F.coalesce("class", "key").alias("class"), "doc", "pos")

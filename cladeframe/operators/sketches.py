"""Weighted MinHash sketches of branch weights, and distances from them.

Every draw depends on the seed, the branch and the cell alone, so a sample's sketch does not depend on the other
samples: sketches may be kept, merged and compared later, as long as tree, seed and settings agree (``settings`` gives
the key to compare). With dense ids a sketch depends on the sample set instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators.distances import BLOCK, PAIRS, block_pairs
from cladeframe.session import materialise

U = np.uint64
SKETCH = "o long, sample_id string, signature array<bigint>"
ARROW = pa.schema([("o", pa.int64()), ("sample_id", pa.string()), ("signature", pa.list_(pa.int64()))])
#: Halvings of a weight below which its remaining mass is neglected (a share of 2**-LEVELS).
LEVELS = 24


def mix(x: np.ndarray) -> np.ndarray:
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)) + U(1)).astype(float) * 2.0**-53


#: Darts drawn in one array operation, at most (or one for each cell).
DRAWN = 1 << 14


def _darts(start: np.ndarray, width: np.ndarray, first: np.ndarray, bound: float):
    """Cell, time and id of every dart up to the bound, given each cell's seed, rate and first time.

    Cells are taken by their expected number of darts, which are then drawn side by side; the few cells that have not
    passed the bound go on from their last dart.
    """
    level = np.ceil(np.log2(np.maximum((bound - first) * width, 1.0))).astype(np.int64)
    for lam in np.unique(level).tolist():
        group = np.flatnonzero(level == lam)
        draws = 1 if lam == 0 else (1 << lam) + (1 << (lam // 2 + 1))
        step = max(DRAWN // draws, 1)
        for low in range(0, len(group), step):
            own = group[low : low + step]
            time, turn = first[own], 0
            while len(own):
                # the dart of each turn, and the gap to the one after it
                h = mix(start[own][:, None] + mix(np.arange(turn, turn + draws + 1).astype(U))[None, :])
                gaps = -np.log(_unit(h[:, 1:])) / width[own][:, None]
                times = time[:, None] + np.concatenate([np.zeros((len(own), 1)), np.cumsum(gaps, axis=1)], axis=1)
                row, column = np.nonzero(times[:, :-1] <= bound)
                yield own[row], times[row, column], mix(h[row, column])
                on = times[:, -1] <= bound
                own, time, turn = own[on], times[on, -1], turn + draws


def _earliest(cells: tuple[np.ndarray, ...], weight: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per slot the time and id of the earliest dart below its branch's weight; a cell spans its width above its width."""
    start, width, first = cells
    best, ident = np.full(k, np.inf), np.zeros(k, U)
    found = list(_darts(start, width, first, bound))
    if found:
        own, time, dart_id = (np.concatenate(c) for c in zip(*found, strict=True))
        hit = width[own] * (1.0 + _unit(mix(dart_id))) <= weight[own]
        slot = ((dart_id[hit] >> U(20)) % U(k)).astype(np.int64)
        time, dart_id = time[hit], dart_id[hit]
        np.minimum.at(best, slot, time)
        won = time == best[slot]
        ident[slot[won]] = dart_id[won]
    return best, ident


#: Branches whose cells are held at a time.
PART = 1 << 14


def _over_parts(cells: Callable, edges: np.ndarray, weights: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each slot's earliest dart over all branches, of which ``cells`` gets no more than PART at a time."""
    best, ident = np.full(k, np.inf), np.zeros(k, U)
    for low in range(0, len(edges), PART):
        *some, weight = cells(edges[low : low + PART], weights[low : low + PART], bound)
        time, dart_id = _earliest(tuple(some), weight, bound, k)
        sooner = time < best
        best[sooner], ident[sooner] = time[sooner], dart_id[sooner]
    return best, ident


def dart(edges: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Darts thrown at the region under the weights: per slot, the earliest dart below its branch's weight.

    The weight axis is cut at powers of two. Each cell (branch, power) has a Poisson process of darts of its own, with
    the cell's width as its rate; a cell that the weight cuts keeps the darts below the weight. Darts are thrown up to
    a time by which all slots are expected to have one, and again up to twice that time if some have none.
    """
    total = weights.sum()
    if not total > 0:
        return np.zeros(k, np.int64)
    salt = mix(np.full(1, seed << 8, U))

    def cells(edges: np.ndarray, weights: np.ndarray, bound: float) -> tuple[np.ndarray, ...]:
        top = np.floor(np.log2(weights)).astype(np.int64) + 1  # the least power above the weight
        power = (top[:, None] - np.arange(LEVELS)[None, :]).ravel()
        edge, weight = np.repeat(edges.astype(U), LEVELS), np.repeat(weights, LEVELS)
        width = np.exp2(power - 1.0)
        start = mix(mix(edge ^ salt) + (power + 4096).astype(U))
        first = -np.log(_unit(mix(start + mix(np.zeros(1, U))))) / width
        some = first <= bound  # most cells are narrow and have no dart so early
        return start[some], width[some], first[some], weight[some]

    scale = math.log(k) + 3
    while True:
        bound = scale * k / total
        best, ident = _over_parts(cells, edges, weights, bound, k)
        if not np.isinf(best).any():
            return ident.view(np.int64)
        scale *= 2


#: Weights of the tree method lie below two to this power.
TREE_TOP = 48


def tree(edges: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The tree method: each branch has one process over the whole weight axis, split by halving the axis.

    The earliest dart of an interval belongs to one of its halves by a coin; the other half's earliest comes an
    exponential time later. The upper half is a cell with darts of its own, the lower one is halved again, as long as
    its earliest dart comes before the bound. So a branch costs as many steps as its axis has powers worth looking at,
    and no part of a weight is neglected however small or large it is. Slots and bounds are those of :func:`dart`.
    """
    total = weights.sum()
    if not total > 0:
        return np.zeros(k, np.int64)
    if not weights.max() < 2.0**TREE_TOP:
        raise ValueError(f"weights of the tree method lie below 2**{TREE_TOP}")
    salt = mix(np.full(1, (seed << 8) + 1, U))

    def split(edges: np.ndarray, weights: np.ndarray, bound: float) -> tuple[np.ndarray, ...]:
        root = mix(edges.astype(U) ^ salt)
        own, width, cells = np.arange(len(root)), 2.0**TREE_TOP, []
        first = -np.log(_unit(mix(root + U(1)))) / width
        depth = 0
        while len(own):
            own, first = own[first <= bound], first[first <= bound]
            width, depth = width / 2, depth + 1
            node = mix(root[own] + mix(np.full(1, depth, U)))
            later = first - np.log(_unit(mix(node + U(2)))) / width
            upper = (mix(node + U(3)) >> U(63)).astype(bool)
            high = np.where(upper, first, later)
            seen = (weights[own] > width) & (high <= bound)
            cells.append((own[seen], node[seen], np.full(seen.sum(), width), high[seen]))
            first = np.where(upper, later, first)
        branch, start, widths, high = (np.concatenate(c) for c in zip(*cells, strict=True))
        return start, widths, high, weights[branch]

    scale = math.log(k) + 3
    while True:
        bound = scale * k / total
        best, ident = _over_parts(split, edges, weights, bound, k)
        if not np.isinf(best).any():
            return ident.view(np.int64)
        scale *= 2


def consistent(edges: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Improved consistent weighted sampling: exact, with work for every branch and slot; the test's yardstick."""
    if not weights.sum() > 0:
        return np.zeros(k, np.int64)
    base = mix(edges.astype(U) ^ mix(np.full(1, (seed << 8) + 2, U)))
    out = np.zeros(k, np.int64)
    log = np.log(weights)
    for slot in range(k):
        u = [_unit(mix(base + U(slot * 8 + i))) for i in range(5)]
        r, c, beta = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
        t = np.floor(log / r + beta)
        y = np.exp(r * (t - beta))
        best = int(np.argmin(c / (y * np.exp(r))))
        out[slot] = mix(base[best : best + 1] + U(int(t[best]) & 0xFFFFFFFF)).view(np.int64)[0]
    return out


def throws(k: int, length: int, seed: int) -> np.ndarray:
    """Where the ``length`` throws of each of k slots fall, as shares of the line of caps; ``slot * length + turn`` is a throw's place."""
    slots = (np.arange(k)[:, None] * U(1 << 20).astype(np.int64) + np.arange(length)[None, :]).astype(U)
    return _unit(mix(slots ^ mix(np.full(1, (seed << 8) + 3, U)))).ravel()


def borrowed(first: np.ndarray, length: int) -> np.ndarray:
    """The signature of each slot's first throw that hit (-1: none did): a slot without borrows from another, chosen by a hash."""
    k = len(first)
    if not (first >= 0).any():
        return np.zeros(k, np.int64)
    out = first.astype(np.int64)
    for slot in np.flatnonzero(first < 0):
        at, turn = slot, 0
        while first[at] < 0:
            at = int(mix(np.full(1, slot * 65537 + turn, U))[0] % U(k))
            turn += 1
        out[slot] = first[at] + (at + 1) * length
    return mix(out.astype(U)).view(np.int64)


def _thrown(weights: DataFrame, k: int, length: int, seed: int) -> DataFrame:
    """``edge_id, slot, turn, offset``: the branch that each throw falls on, and how high on its cap.

    The line of caps is a range-sorted table: sums run within its partitions, to which those before are added. Each task makes
    the throws, as many whatever the tree, and finds those that fall on its branches.
    """
    caps = weights.groupBy(F.col("edge_id").cast("long").alias("edge_id")).agg(F.max(F.col("weight").cast("double")).alias("cap"))
    caps = caps.repartitionByRange("edge_id").withColumn("p", F.spark_partition_id())
    along = Window.partitionBy("p").orderBy("edge_id")
    line = caps.withColumn("high", F.sum("cap").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("low", F.coalesce(F.lag("high").over(along), F.lit(0.0)))
    line = materialise(line, "line")
    base, total = {}, 0.0
    for part, high in sorted(map(tuple, line.groupBy("p").agg(F.max("high")).collect())):  # a row for each partition
        base[part], total = total, total + high

    def fallen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = throws(k, length, seed) * total
        order = np.argsort(at)
        at = at[order]
        for batch in batches:
            before = np.array([base[p] for p in batch.column("p").to_pylist()], float)
            low, high = before + batch.column("low").to_numpy(), before + batch.column("high").to_numpy()
            start, end = np.searchsorted(at, low, side="right"), np.searchsorted(at, high, side="right")
            n = end - start
            edge = np.repeat(np.arange(len(n)), n)
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
            offset = at[which] - (high - batch.column("cap").to_numpy())[edge]
            place = order[which]
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column("edge_id").to_numpy()[edge]), pa.array((place // length).astype(np.int32)), pa.array((place % length).astype(np.int32)), pa.array(offset),
            ], names=["edge_id", "slot", "turn", "offset"])

    return line.mapInArrow(fallen, "edge_id long, slot int, turn int, offset double")


def rejection(weights: DataFrame, own: DataFrame, k: int, length: int, seed: int) -> DataFrame:
    """``o, sample_id, signature`` by efficient rejection sampling: per slot, the first of ``length`` throws below a sample's weight wins.

    Throws meet weights by branch, and minima of turns are combined where they are made: no table of branches is sent anywhere.
    """
    each = weights.join(own, "sample_id").select("o", F.col("edge_id").cast("long").alias("edge_id"), F.col("weight").cast("double").alias("weight"))
    hits = each.join(_thrown(weights, k, length, seed), "edge_id").filter("offset < weight").groupBy("o", "slot").agg(F.min("turn").alias("turn"))
    hits = hits.groupBy("o").agg(F.collect_list("slot").alias("slots"), F.collect_list("turn").alias("turns"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for slots, turns in zip(batch.column("slots"), batch.column("turns"), strict=True):
                first = np.full(k, -1, np.int64)
                if slots.is_valid:
                    first[slots.values.to_numpy()] = turns.values.to_numpy()
                found.append(borrowed(first, length))
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("sample_id"), pa.array(found, pa.list_(pa.int64()))], schema=ARROW)

    return own.join(hits, "o", "left").select("o", F.col("sample_id").cast("string").alias("sample_id"), "slots", "turns").mapInArrow(sign, SKETCH)


def settings(method: str, k: int, seed: int, bits: int, weighted: bool, raw_counts: bool, portable: bool = True) -> str:
    """The key under which sketches may be compared."""
    return f"{method};k={k};seed={seed};bits={bits};weighted={weighted};raw={raw_counts};portable={portable}"


def validate(method: str, portable: bool, raw_counts: bool, weighted: bool, length: int) -> None:
    if method not in ("dmh", "tmh", "ers", "icws"):
        raise ValueError(f"unknown method {method!r}")
    if method == "ers" and portable:
        raise ValueError("rejection sampling depends on the sample set through its caps: it cannot be portable")
    if raw_counts and not weighted:
        raise ValueError("raw counts only go with weighted sketches")
    if method == "ers" and length < 512:
        raise ValueError("rejection sampling needs sequences of 512 throws at least")


def truncate(signature: Column, bits: int) -> Column:
    """The low bits of every id; 64 keeps them whole."""
    if bits not in (16, 32, 64):
        raise ValueError("sketch ids have 16, 32 or 64 bits")
    return signature if bits == 64 else F.transform(signature, lambda x: x.bitwiseAND(F.lit((1 << bits) - 1).cast("long")))


def sketches(weights: DataFrame, samples: DataFrame, k: int = 2048, method: str = "dmh", seed: int = 1337, bits: int = 16, length: int = 2048, portable: bool | None = None) -> DataFrame:
    """``o, sample_id, signature`` of every sample's branch weights (``sample_id, edge_id, weight``)."""
    validate(method, bool(portable) and method == "ers", False, True, length)
    if portable is False and method != "ers":
        from cladeframe.operators.branches import dense_ids

        weights = weights.join(dense_ids(weights), "edge_id").select("sample_id", F.col("dense_id").alias("edge_id"), "weight")
    own = samples.select(F.col("sample_ordinal").cast("long").alias("o"), "sample_id")
    if method == "ers":
        return rejection(weights, own, k, length, seed).withColumn("signature", truncate(F.col("signature"), bits))
    each = weights.join(own, "sample_id").select("o", F.lit(None).cast("string").alias("sample_id"), F.col("edge_id").cast("long").alias("edge_id"), F.col("weight").cast("double").alias("weight"))
    every = own.select("o", F.col("sample_id").cast("string").alias("sample_id"), F.lit(None).cast("long").alias("edge_id"), F.lit(None).cast("double").alias("weight"))
    kernels = {"dmh": dart, "tmh": tree, "icws": consistent}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sample's rows come in batches, of which only ids and weights are kept."""
        o, name, edges, values = None, None, [], []
        for batch in batches:
            mine = batch.filter(batch.column("edge_id").is_valid())
            edges.append(mine.column("edge_id").to_numpy())
            values.append(mine.column("weight").to_numpy())
            if len(mine) < len(batch):
                who = batch.filter(batch.column("sample_id").is_valid())
                o, name = who.column("o")[0].as_py(), who.column("sample_id")[0].as_py()
        edges, values = np.concatenate(edges), np.concatenate(values)
        sig = kernels[method](edges, values, k, seed) if len(edges) else np.zeros(k, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([o], pa.int64()), pa.array([name], pa.string()), pa.array([sig], pa.list_(pa.int64()))], schema=ARROW)

    return each.unionByName(every).groupBy("o").applyInArrow(rows_of, SKETCH).withColumn("signature", truncate(F.col("signature"), bits))


def mismatch_distances(sketched: DataFrame, weighted: bool, block: int = BLOCK) -> DataFrame:
    """``sample_i, sample_j, distance`` from signatures: the share d of slots that differ; d / (2 - d) if weighted."""
    sketched = materialise(sketched.select("o", "sample_id", "signature"), "sketches")
    n = sketched.agg(F.max("o")).first()[0]
    blocks = 1 if n is None else int(n) // block + 1

    def kernel(table: pa.Table) -> pa.Table:
        o, names, b = table["o"].to_numpy(), table["sample_id"].to_pylist(), table["b"].to_numpy()
        flat = table["signature"].combine_chunks()
        sig = flat.flatten().to_numpy().reshape(len(o), -1)
        if sig.size and 0 <= sig.min() and sig.max() < 1 << 16:  # ids of 16 bits compare faster as such
            sig = sig.astype(np.uint16)
        left, right = (np.flatnonzero(b == table[x][0].as_py()) for x in ("bi", "bj"))
        left, right = left[np.argsort(o[left])], right[np.argsort(o[right])]
        others = np.ascontiguousarray(sig[right])
        d = np.stack([np.count_nonzero(others != sig[i], axis=1) for i in left]) / max(sig.shape[1], 1)
        if weighted:
            d = np.where(d < 2, d / (2 - d), 1.0)
        i, j = np.nonzero(o[left][:, None] < o[right][None, :])
        return pa.table({"sample_i": [names[x] for x in left[i]], "sample_j": [names[x] for x in right[j]], "distance": d[i, j]}, schema=PAIRS)

    return block_pairs(sketched, blocks, block).groupBy("bi", "bj").applyInArrow(kernel, "sample_i string, sample_j string, distance double")


def race_minima(weights: DataFrame, k: int) -> DataFrame:
    """``sample_id, slot, m``: the earliest branch of an exponential race and its time, ``m(t, edge_id)``.

    The draw of a branch in a slot is an MD5 prefix, so any engine gives the same sketch, and minima of parts of a
    sample merge by the lesser. A branch's draws are made once, next to the list of its samples, and minima are combined
    where they are made: rows of branches by slots are never shuffled.
    """
    branches = weights.groupBy("edge_id", "weight").agg(F.collect_list("sample_id").alias("samples"))
    times = branches.select("edge_id", "weight", "samples", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("edge_id").cast("string"), F.col("slot").cast("string"))), 1, 12), 16, 10).cast("double") + 1.0) / F.lit(2.0**48 + 1)
    own = times.select((-F.log(u) / F.col("weight")).alias("t"), "edge_id", "slot", "samples").select("t", "edge_id", "slot", F.explode("samples").alias("sample_id"))
    # numbers, not structs: a minimum of structs would sort all rows
    return own.groupBy("sample_id", "slot").agg(F.min("t").alias("t"), F.min_by("edge_id", "t").alias("edge_id")).select("sample_id", "slot", F.struct("t", "edge_id").alias("m"))


def race(weights: DataFrame, k: int) -> DataFrame:
    """``sample_id, slot, edge_id``: an exponential race in SQL alone, exact for presence weights."""
    return race_minima(weights, k).select("sample_id", "slot", F.col("m.edge_id").alias("edge_id"))


def race_distances(raced: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """Pairs by equality of slots."""
    own = raced.join(samples, "sample_id")
    a, b = own.alias("a"), own.alias("b")
    same = (
        a.join(b, (F.col("a.slot") == F.col("b.slot")) & (F.col("a.edge_id") == F.col("b.edge_id")) & (F.col("a.sample_ordinal") < F.col("b.sample_ordinal")))
        .groupBy(F.col("a.sample_id").alias("sample_i"), F.col("b.sample_id").alias("sample_j")).agg(F.count(F.lit(1)).alias("n"))
    )
    from cladeframe.operators.distances import sample_pairs

    pairs = sample_pairs(samples.join(raced.select("sample_id").distinct(), "sample_id", "left_semi"))
    return pairs.join(same, ["sample_i", "sample_j"], "left").select("sample_i", "sample_j", (1 - F.coalesce(F.col("n"), F.lit(0)) / F.lit(float(k))).alias("distance"))

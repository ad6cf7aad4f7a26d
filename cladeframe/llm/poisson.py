"""BagMinHash signatures: hierarchical Poisson processes over discretised weights.

Every element owns independent Poisson processes on the weight ranges (0, 1], (1, 2], (2, 4], (4, 8] and so on, seeded
by the element and the range alone. A bag with weight w of the element sees all points of the ranges below w and, of
the range that w cuts, the points whose cell (drawn by halving the range again and again) lies below w. Each point has
a slot; a slot's value is its earliest point. Two bags agree in a slot with probability equal to their weighted
Jaccard similarity. Points are only made up to a bound at which all slots are expected to be filled; the few bags with
an empty slot are done again with twice the bound, so nothing is approximated.
"""

from __future__ import annotations

import math

import numpy as np

from cladeframe.llm import textkernels as tk

U64 = np.uint64


def _processes(elements: np.ndarray, weights: np.ndarray, bag: np.ndarray):
    """Seed, bag, rate, and of how many cells the lowest count, for each process that a bag sees."""
    seeds, bags, rates, cells = [tk.mix(elements)], [bag], [np.ones(len(bag))], [np.ones(len(bag), np.int64)]
    span = 1
    while True:
        over = np.flatnonzero(weights > span)
        if not len(over):
            break
        seeds.append(tk.mix(elements[over] ^ tk.salt(span.bit_length())))
        bags.append(bag[over])
        rates.append(np.full(len(over), float(span)))
        cells.append(np.minimum(weights[over], 2 * span) - span)
        span *= 2
    return [np.concatenate(x) for x in (seeds, bags, rates, cells)]


#: Points drawn in one array operation, at most (or one turn of all processes).
DRAW = 1 << 14


def _points(seed: np.ndarray, own: np.ndarray, rate: np.ndarray, cells: np.ndarray, bound: np.ndarray):
    """Bag, time and hash of all points up to each process's bound that its weight sees.

    Processes are taken by their expected number of points, which are then drawn side by side; those that have not
    passed the bound go on from their last point.
    """
    expected, cut = rate * bound, cells < rate
    level = np.ceil(np.log2(np.maximum(expected, 1.0))).astype(np.int64)
    for lam in np.unique(level).tolist():
        group = np.flatnonzero(level == lam)
        first, later = (1, 1) if lam < 2 else (1 << lam, 1 << (lam // 2 + 1))
        step = max(DRAW // first, 1)
        for low in range(0, len(group), step):
            mine = group[low : low + step]
            time, turn, draws = np.zeros(len(mine)), 0, first
            while len(mine):
                turns = (np.arange(turn + 1, turn + draws + 1).astype(U64) * U64(tk.salt(0)))[None, :]
                h = tk.mix(seed[mine][:, None] + turns)
                gap = np.log(((h >> U64(11)) + U64(1)).astype(np.float64) * 2.0**-53)
                times = time[:, None] - (np.cumsum(gap, axis=1) if draws > 1 else gap) / rate[mine][:, None]
                seen = times <= bound[mine][:, None]
                row = np.nonzero(seen)[0] if draws > 1 else np.flatnonzero(seen[:, 0])
                point, who, when = tk.mix(h[seen]), mine[row], times[seen]
                if cut[mine].any():
                    inside = ((point & U64(0xFFFFFFFF)).astype(np.float64) * rate[who] * 2.0**-32).astype(np.int64) < cells[who]
                    point, who, when = point[inside], who[inside], when[inside]
                yield own[who], when, point
                on = seen[:, -1]
                mine, time = mine[on], times[on, -1]
                turn += draws
                draws = later


def signatures(elements: np.ndarray, weights: np.ndarray, bag: np.ndarray, n: int, slots: int = 64) -> np.ndarray:
    """An (n, slots) array of uint64 for n bags; ``bag`` gives the bag of each distinct element. Empty bags get zeros."""
    out = np.zeros(n * slots, U64)
    total = np.bincount(bag, weights, n)
    todo, scale = np.flatnonzero(total > 0), math.log(slots) + 3
    while len(todo):
        bound = np.zeros(n)
        bound[todo] = scale * slots / total[todo]
        mine = bound[bag] > 0
        seed, own, rate, cells = _processes(elements[mine], weights[mine], bag[mine])
        found = list(_points(seed, own, rate, cells, bound[own]))
        who, times, point = (np.concatenate(c) for c in zip(*found, strict=True))
        at = who * slots + ((point >> U64(32)) % U64(slots)).astype(np.int64)
        first = np.full(n * slots, np.inf)
        np.minimum.at(first, at, times)
        won = times == first[at]
        out[at[won]] = point[won]
        todo = todo[np.isinf(first.reshape(n, slots)[todo]).any(axis=1)]
        scale *= 2
    return out.reshape(n, slots)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """An (n, slots / rows) array of int64: a hash of each band and its number."""
    n, slots = signature.shape
    parts = signature.reshape(n, slots // rows, rows)
    h = np.zeros(parts.shape[:2], U64)
    for i in range(rows):
        h = tk.mix(h ^ parts[:, :, i])
    return tk.mix(h + np.array([tk.salt(b) for b in range(slots // rows)], U64)).view(np.int64)

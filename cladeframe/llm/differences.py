"""Links between members of a group, found through their differences from the group's lead.

The symmetric difference of two bags is that of their differences from any third bag: with ``d`` the difference of an
item from its lead, two items differ in ``|d1| + |d2| - 2 |d1 and d2|`` elements. They are near duplicates when that is
at most ``T (n1 + n2) / S`` (sizes n; at a similarity of 0.8, a ninth of both sizes), so they must share

    2 S |d1 and d2|  >=  F1 + F2      with  F = S |d| - T n

elements of their differences, and sharing as many is enough. F is above ``T`` times the lead's size for items that are
not linked to the lead, which bounds the right side from below for either item alone. Most differences are edits of one
text alone, shared with nobody: texts whose shared ones do not reach the bound are done.

1. Differences are cut from the texts; every element is counted over its group's items. Each chunk of items asks for an
   element once, so that what all items of a group share costs a row for each chunk.
2. Elements that the same items have are one (their items' keys add up to the same sum), with the number as weight. An
   item sends its elements, the rarest first, as long as what is left still reaches its bound: two near duplicates meet
   in the first element that they share.
3. Items that meet are compared in the first element that they share, if what both lists weigh from there on reaches
   the bound of the two. Links that join components go on.

Elements are named after their group, so only items of one group meet: an item's list goes to its group's cell once, and
not to a place for each of its elements, which would send it as often as it is long. Groups of many items or shingles are
cut to shards of bounded size, and shards meet two by two, a cell for each two; no list, partner or candidate is capped.
Elements are told apart by 64-bit hashes, as in all comparisons of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import blobs, workspace
from cladeframe.llm import textkernels as tk

if TYPE_CHECKING:
    from cladeframe.llm.neardup import Verifier

#: Similarity from which items are near duplicates, as a fraction.
SIMILAR = (8, 10)
S, T = SIMILAR[1] + SIMILAR[0], SIMILAR[1] - SIMILAR[0]

ASKED, HELD, REPLY, LIST = range(4)
LINKED, BETWEEN, HALF = 1, 2, 4
#: Elements of one chunk, elements for which there is a bucket, items of one shard and shingles of theirs and their leads,
#: pairs settled at once, lookups of one array operation.
FLUSH, BUCKET_ELEMENTS, SHARD, SHARD_ELEMENTS, PAIRS, LOOKUPS = 1 << 19, 1 << 20, 4096, 1 << 22, 1 << 17, 1 << 22

U64 = np.uint64
Bag = tuple[np.ndarray, np.ndarray]

#: What marks an element's first occurrence.
FIRST = tk.mix(np.zeros(1, U64))


def difference(a: Bag, b: Bag) -> np.ndarray:
    """Names of what one of two bags (distinct elements in order, weights) has more of, one for each occurrence."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        elements, low, more = b[0], np.zeros(len(b[0]), np.int64), b[1]
    else:
        at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
        hit = b[0][at] == a[0]
        other = np.zeros(len(b[0]), np.int64)
        other[at[hit]] = a[1][hit]
        elements = np.concatenate([a[0][~hit], b[0]])
        low = np.concatenate([np.zeros(len(elements) - len(other), np.int64), np.minimum(other, b[1])])
        more = np.concatenate([a[1][~hit], np.abs(other - b[1])])
    if len(more) and more.max() == 1 and not low[more > 0].any():
        return tk.mix(elements[more > 0] ^ FIRST)
    which = np.repeat(np.arange(len(elements)), more)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(more) - more, more) + low[which]
    return tk.mix(elements[which] ^ tk.mix(turn.astype(U64)))


def _ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair of a start and a length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Gather:
    """Differences of a task's items; a chunk at a time asks for its elements' counts."""

    def __init__(self, buckets: int):
        self.buckets, self.sender, self.flushed = buckets, blobs.Sender(), 0
        self._clear()

    def _clear(self) -> None:
        self.items: list[tuple[int, ...]] = []
        self.names: list[np.ndarray] = []
        self.size = 0

    def add(self, lead: int, key: int, comp: int, flags: int, a: Bag, b: Bag, shards: int = 1) -> None:
        names = difference(a, b)
        n = int(b[1].sum())
        excess, size = S * len(names) - T * n, int(a[1].sum())
        reach = 2 * excess - 2 * T * (min(n, size) * SIMILAR[1] // SIMILAR[0])
        self.items.append((lead, key, comp, flags, excess, T * size, reach, shards))
        self.names.append(tk.mix(names ^ tk.mix(np.array([lead], np.int64).view(U64))))
        self.size += len(names) + 8

    def full(self) -> bool:
        return self.size >= FLUSH

    def flush(self) -> list[tuple[int, int, int, bytes]]:
        if not self.items:
            return []
        lead, key, *items = (np.array(c, np.int64) for c in zip(*self.items, strict=True))
        count = np.array([len(x) for x in self.names], np.int64)
        names = np.concatenate(self.names)
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        home = int(tk.mix(np.array([(task << 32) + self.flushed], U64))[0] >> U64(33))
        token = np.repeat(tk.mix(key.view(U64) ^ tk.mix(lead.view(U64))), count)
        order = np.argsort(names, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = names[order][1:] != names[order][:-1]
        at = np.flatnonzero(new)
        each = names[order][at]
        own = np.diff(np.append(at, len(order))).astype(np.int64)
        total = np.concatenate([[U64(0)], np.cumsum(token[order], dtype=U64)])
        sums = total[np.append(at[1:], len(order))] - total[at]
        bucket = (each % U64(self.buckets)).astype(np.int64)
        rows = self.sender.deal(ASKED, bucket, each, own, sums, np.full(len(each), home, np.int64))
        about = blobs.pack(lead, key, *items, count)
        rows.append(self.sender.row(home, HELD, b"".join([len(about).to_bytes(8, "little"), about, blobs.pack(names)])))
        self.flushed += 1
        self._clear()
        return rows


def _counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements that two items or more have go back to the chunks that asked, with their items' number and sum."""
    sender = blobs.Sender()
    for _, parts in blobs.by_bucket(stream):
        each, own, sums, home = (np.concatenate(c) for c in zip(*(blobs.unpack(p) for _, p in parts), strict=True))
        order = np.argsort(each, kind="stable")
        each, own, sums, home = each[order], own[order], sums[order], home[order]
        new = np.ones(len(each), bool)
        new[1:] = each[1:] != each[:-1]
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        owners = np.add.reduceat(own, at)[group] if len(at) else own
        tokens = np.add.reduceat(sums, at)[group] if len(at) else sums
        some = owners > 1
        rows = sender.deal(REPLY, home[some], each[some], owners[some], tk.mix(tokens[some] ^ tk.mix(owners[some].view(U64))))
        yield from blobs.batches(rows)


def _prefixes(buckets: int, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's weighted shared elements, sent to the cells of its group if they reach its bound."""
    sender = blobs.Sender()
    for _, parts in blobs.by_bucket(stream):
        held, replies = [], []
        for kind, payload in parts:
            if kind == REPLY:
                replies.append(blobs.unpack(payload))
            else:
                held.append(payload)
        if not replies:
            continue
        names, owners, tokens = (np.concatenate(c) for c in zip(*replies, strict=True))
        names, first = np.unique(names, return_index=True)
        owners, tokens = owners[first], tokens[first]
        for payload in held:
            cut = 8 + int.from_bytes(payload[:8], "little")
            *items, count = blobs.unpack(payload[8:cut])
            (body,) = blobs.unpack(payload[cut:])
            yield from blobs.batches(_sent(sender, buckets, items, count, body, names, owners, tokens))


def _sent(sender, buckets, items, count, body, names, owners, tokens) -> list[tuple[int, int, int, bytes]]:
    lead, key, comp, flags, excess, base, reach, shards = items
    at = np.minimum(np.searchsorted(names, body), len(names) - 1)
    hit = names[at] == body
    item, at = np.repeat(np.arange(len(key)), count)[hit], at[hit]
    order = np.lexsort((tokens[at], owners[at], item))
    item, at = item[order], at[order]
    token = tokens[at]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (token[1:] != token[:-1])
    start = np.flatnonzero(new)
    weight = np.diff(np.append(start, len(item))).astype(np.int64)
    item, token, df = item[start], token[start], owners[at[start]]
    # what an item's list still weighs from each element on
    total = np.concatenate([[0], np.cumsum(weight)])
    ends = np.searchsorted(item, np.arange(len(key)), "right")
    begins = np.searchsorted(item, np.arange(len(key)), "left")
    left = total[ends[item]] - total[:-1]
    linked = (flags & LINKED) > 0
    # against items that are not linked to the lead, whose excess is above the base
    half = 2 * S * left > (excess + base)[item]
    # items that are not linked against those that are, whose differences are at least as large as the triangle leaves
    some = ~linked & ((flags & BETWEEN) > 0)
    go = half | (some[item] & (2 * S * left >= reach[item]))
    if not go.any():
        return []
    # an item meets its group in a cell for each other shard
    mark = go + half.astype(np.uint8)
    some = np.flatnonzero(np.bincount(item[go], minlength=len(key)))
    mine = (tk.mix(key[some].view(U64)) % shards[some].astype(U64)).astype(np.int64)
    who, mine, other = np.repeat(some, shards[some]), np.repeat(mine, shards[some]), _ragged(shards[some], np.zeros(len(some), np.int64))
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    cell = tk.mix(tk.mix(lead[who].view(U64)) ^ ((low.astype(U64) << U64(32)) | high.astype(U64)))
    side = np.where(low == high, 0, np.where(mine == low, 1, 2))
    bucket = (cell % U64(buckets)).astype(np.int64)
    rows = []
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = order[x:y]
        own = who[at]
        length = ends[own] - begins[own]
        lists = _ragged(length, begins[own])
        about = blobs.pack(key[own], comp[own], flags[own], excess[own], length, cell[at], side[at])
        payload = b"".join([len(about).to_bytes(8, "little"), about, blobs.pack(token[lists], weight[lists], mark[lists])])
        rows.append(sender.row(int(bucket[at[0]]), LIST, payload))
    return rows


def _root(up: dict[int, int], x: int) -> int:
    top = x
    while up.setdefault(top, top) != top:
        top = up[top]
    while up[x] != top:
        up[x], x = top, up[x]
    return top


def _unite(up: dict[int, int], a: int, b: int) -> bool:
    a, b = _root(up, a), _root(up, b)
    up[max(a, b)] = min(a, b)
    return a != b


class Meetings:
    """Items that meet in one bucket, their lists in the common order (rarest first) and sorted for lookups."""

    def __init__(self, key, comp, excess, start, length, token, weight):
        self.comp, self.excess, self.start, self.length = comp, excess, start, length
        tokens, self.token = np.unique(token, return_inverse=True)
        self.span = np.int64(len(tokens))
        place = np.repeat(np.arange(len(key)), length) * self.span + self.token
        order = np.argsort(place)
        self.place, self.weight = place[order], weight[order]
        total = np.concatenate([[0], np.cumsum(weight)])
        self.ends = total[start + length]
        self.total = total

    def rest(self, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What an item's list weighs from a place on."""
        return self.ends[item] - self.total[self.start[item] + at]

    def _shared(self, x, y, low, high) -> np.ndarray:
        """What the elements of x's list from ``low`` up to ``high`` weigh that y has too."""
        out, n = np.zeros(len(x), np.int64), high - low
        cost = np.cumsum(n + 1)
        edges = np.searchsorted(cost, np.arange(0, int(cost[-1]) + LOOKUPS, LOOKUPS)) if len(x) else []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i < j:
                want = np.repeat(y[i:j], n[i:j]) * self.span + self.token[_ragged(n[i:j], (self.start[x] + low)[i:j])]
                found = np.minimum(np.searchsorted(self.place, want), len(self.place) - 1)
                same = np.where(self.place[found] == want, self.weight[found], 0)
                out[i:j] = np.bincount(np.repeat(np.arange(j - i), n[i:j]), same, j - i)
        return out

    def first(self, x, y, at_x, at_y) -> np.ndarray:
        """Whether the element in which two items meet is the first that they share."""
        swap = at_y < at_x
        x, y, at = np.where(swap, y, x), np.where(swap, x, y), np.minimum(at_x, at_y)
        return self._shared(x, y, np.zeros_like(at), at) == 0

    def near(self, x, y, at_x, at_y) -> np.ndarray:
        """Whether two items that share nothing before the element in which they meet are near duplicates."""
        swap = self.length[y] - at_y < self.length[x] - at_x
        x, y, at = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, at_y, at_x)
        return 2 * S * self._shared(x, y, at, self.length[x]) >= self.excess[x] + self.excess[y]


def _met(key, comp, flags, excess, start, length, token, weight, name, local, at, side, half) -> set[tuple[int, int]]:
    """Pairs of components that a link joins, among the items that meet in one bucket; a forest of them.

    A pair is compared in the first element that both lists have, and there only: what both weigh from there on bounds
    what they share, so that most partners fall to two bounds. Of two shards that meet, pairs inside one are left to the
    meeting of that shard with itself.
    """
    meetings = Meetings(key, comp, excess, start, length, token, weight)
    linked = (flags & LINKED) > 0
    # lists: those that are not linked first, by excess
    order = np.lexsort((excess[local], linked[local], name))
    name, local, at, side, half = (c[order] for c in (name, local, at, side, half))
    group, own, tied = comp[local], excess[local], linked[local]
    bound = 2 * S * meetings.rest(local, at) - own
    edges = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
    names, comps = np.unique(comp, return_inverse=True)
    up: dict[int, int] = {}
    out: set[tuple[int, int]] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def settle() -> None:
        i, j = (np.concatenate(c) for c in zip(*held, strict=True))
        top = np.array([_root(up, c) for c in names.tolist()])[comps]
        apart = top[local[i]] != top[local[j]]
        i, j = i[apart], j[apart]
        new = meetings.first(local[i], local[j], at[i], at[j])
        i, j = i[new], j[new]
        for k in np.flatnonzero(meetings.near(local[i], local[j], at[i], at[j])).tolist():
            a, b = int(group[i[k]]), int(group[j[k]])
            if _unite(up, a, b):
                out.add((min(a, b), max(a, b)))

    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if high - low < 2 or (group[low:high] == group[low]).all():
            continue
        middle = low + int((~tied[low:high]).sum())
        mine = bound[low:middle]
        last = low + np.searchsorted(own[low:middle], mine, "right")
        far = middle + np.searchsorted(own[middle:high], mine, "right")
        for i in range(low, middle):  # a member that is not linked against those after it
            others = np.arange(middle, far[i - low])
            if half[i]:
                others = np.concatenate([np.arange(i + 1, max(i + 1, last[i - low])), others])
            fit = (group[others] != group[i]) & (own[i] <= bound[others]) & (half[others] | tied[others])
            others = others[fit & ((side[others] == 0) | (side[others] != side[i]))]
            if len(others):
                held.append((np.full(len(others), i), others))
                size += len(others)
                if size >= PAIRS:
                    settle()
                    held, size = [], 0
    if held:
        settle()
    return out


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, parts in blobs.by_bucket(stream):
        items, lists = [], []
        for _, payload in parts:
            cut = 8 + int.from_bytes(payload[:8], "little")
            items.append(blobs.unpack(payload[8:cut]))
            lists.append(blobs.unpack(payload[cut:]))
        key, comp, flags, excess, length, cell, side = (np.concatenate(c) for c in zip(*items, strict=True))
        token, weight, mark = (np.concatenate(c) for c in zip(*lists, strict=True))
        start = np.cumsum(length) - length
        entry = np.flatnonzero(mark)
        local = np.repeat(np.arange(len(key)), length)[entry]
        name, at, side, half = tk.mix(token[entry] ^ cell[local]), entry - start[local], side[local], mark[entry] > 1
        found = _met(key, comp, flags, excess, start, length, token, weight, name, local, at, side, half)
        if found:
            a, b = zip(*sorted(found), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=PAIR)


def _dealt(rows: DataFrame, width: int | None = None) -> DataFrame:
    dealt = rows.repartition(width, "bucket") if width else rows.repartition("bucket")
    return dealt.sortWithinPartitions("bucket", "kind", "src")


def links(held: DataFrame, verifier: Verifier) -> DataFrame | None:
    """``a, b``: components that near duplicates join among ``a, b, comp, linked, between, a_size, b_size, n, weight``, or None.

    ``n`` and ``weight`` are the group's items and the sum of all ``a_size`` and ``b_size`` in it.
    """
    spark = held.sparkSession
    known = held.agg(F.sum(F.col("a_size") + F.col("b_size"))).first()[0]
    if not known:
        return None
    buckets = max(16, int(known) // BUCKET_ELEMENTS)
    flags = F.when(F.col("linked"), LINKED).otherwise(0) + F.when(F.col("between"), BETWEEN).otherwise(0)
    shards = F.greatest(F.ceil(F.col("n") / SHARD), F.ceil(F.col("weight") / SHARD_ELEMENTS))
    since = workspace.mark()
    rows = verifier.differences(held.select("a", "b", "comp", flags.cast("long").alias("flags"), shards.cast("long").alias("shards")), lambda: Gather(buckets))
    rows = workspace.materialise(rows, "differences", "kind")
    asked = rows.filter(F.col("kind") == ASKED).select("bucket", "kind", "src", "payload")
    replies = workspace.arrow_map(_dealt(asked), _counted, blobs.SCHEMA)
    kept = rows.filter(F.col("kind") == HELD).select("bucket", "kind", "src", "payload")
    sent = workspace.arrow_map(_dealt(kept.unionByName(replies)), lambda b: _prefixes(buckets, b), blobs.SCHEMA)
    # lists are small for the work that they make: their partitions are not joined by size
    sent = _dealt(sent, min(buckets, workspace.shuffle_width(spark)))
    found = workspace.materialise(workspace.arrow_map(sent, _links, "a long, b long").distinct(), "links")
    workspace.discard(spark, since)
    return None if found.isEmpty() else found

"""Columns of numbers packed into binary rows, for exchanges of many small entries.

A kernel gathers entries (document id, position and the like), deals them to buckets and ships one compressed row for
each bucket, so the JVM moves few large rows. ``src`` numbers rows by task and order: consumers sort by it, so what
they see does not depend on the order in which shuffle blocks arrive, even after a lost executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

SCHEMA = "bucket int, kind int, src long, payload binary"
ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("src", pa.int64()), ("payload", pa.binary())])

_pack = zstandard.ZstdCompressor(level=1)
_unpack = zstandard.ZstdDecompressor()


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of one length, their bytes in planes; 64-bit ones are stored as differences of neighbours."""
    out = [len(columns[0]).to_bytes(4, "little")]
    for c in columns:
        raw = np.diff(c, prepend=c.dtype.type(0)) if c.dtype.itemsize == 8 and c.dtype.kind == "i" else c
        planes = np.ascontiguousarray(raw).view(np.uint8).reshape(len(raw), c.dtype.itemsize)
        data = _pack.compress(planes.T.tobytes())
        out += [c.dtype.str.encode(), len(data).to_bytes(4, "little"), data]
    return b"".join(out)


def unpack(payload: bytes) -> list[np.ndarray]:
    n, at, out = int.from_bytes(payload[:4], "little"), 4, []
    while at < len(payload):
        kind = np.dtype(payload[at : at + 3].decode())
        size = int.from_bytes(payload[at + 3 : at + 7], "little")
        planes = np.frombuffer(_unpack.decompress(payload[at + 7 : at + 7 + size], max_output_size=n * kind.itemsize + 1), np.uint8)
        raw = np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()
        out.append(np.cumsum(raw, dtype=kind) if kind.itemsize == 8 and kind.kind == "i" else raw)
        at += 7 + size
    return out


class Sender:
    """Numbers the rows that a task sends."""

    def __init__(self) -> None:
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 40

    def row(self, bucket: int, kind: int, payload: bytes) -> tuple[int, int, int, bytes]:
        self.next += 1
        return bucket, kind, self.next, payload

    def deal(self, kind: int, buckets: np.ndarray, *columns: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        """A row for each bucket that has entries; entries keep their order."""
        if not len(buckets):
            return []
        small = buckets.astype(np.uint16) if buckets.max() < 1 << 16 else buckets
        order = np.argsort(small, kind="stable")
        dealt = buckets[order]
        edges = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1], [True]]))
        columns = tuple(c[order] for c in columns)
        return [
            self.row(int(dealt[a]), kind, pack(*(c[a:b] for c in columns))) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
        ]


def batches(rows: list[tuple[int, int, int, bytes]], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about ``limit`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= limit:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def by_bucket(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """Groups of sorted rows: a bucket, then kind and payload of each of its rows, read as they come."""
    import itertools

    def each() -> Iterator[tuple[int, int, bytes]]:
        for batch in stream:
            b, k, p = batch.column("bucket"), batch.column("kind"), batch.column("payload")
            for i in range(batch.num_rows):
                yield b[i].as_py(), k[i].as_py(), p[i].as_py()

    for bucket, rows in itertools.groupby(each(), key=lambda r: r[0]):
        yield bucket, ((k, p) for _, k, p in rows)

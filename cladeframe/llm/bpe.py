"""Byte-pair encoding by forced boundaries.

A pair of adjacent bytes that no vocabulary token contains can never be merged over, so a text may be cut there and
its fragments encoded on their own. Three rules keep the cut independent of the pre-tokeniser as well: a cut stands
between whole characters, never after white space (the rule for runs of white space looks ahead) and never before an
apostrophe (a contraction could begin there). Special tokens stand alone. Fragments repeat far more than texts do, so
each is encoded once by the tokenizers library and remembered in a memo of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cladeframe.llm import textkernels as tk
from cladeframe.llm import workspace


TABLE_BITS = 20
#: Bytes of remembered fragments from which the memo starts anew: texts without forced cuts make long ones.
MEMO_BYTES = 32 << 20
#: Fragments given to the library at a time.
LEARN = 2048
#: Masks of the first n of eight bytes.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte: visible Latin-1 characters stand for themselves, the rest follow from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def white_space_ends(raw: np.ndarray) -> np.ndarray:
    """Whether each byte ends a white-space character (Unicode's, and the ASCII separators to be safe)."""
    end = (raw == 32) | ((raw >= 9) & (raw <= 13)) | ((raw >= 28) & (raw <= 31))
    if len(raw) > 1:
        b1, b0 = raw[:-1], raw[1:]
        end[1:] |= (b1 == 0xC2) & ((b0 == 0x85) | (b0 == 0xA0))
    if len(raw) > 2:
        b2, b1, b0 = raw[:-2], raw[1:-1], raw[2:]
        general = (b1 == 0x80) & ((b0 <= 0x8A) | (b0 == 0xA8) | (b0 == 0xA9) | (b0 == 0xAF)) | (b1 == 0x81) & (b0 == 0x9F)
        ogham = (b1 == 0x9A) & (b0 == 0x80) | (b1 == 0xA0) & (b0 == 0x8E)
        end[2:] |= (b2 == 0xE2) & general | (b2 == 0xE1) & ogham | (b2 == 0xE3) & (b1 == 0x80) & (b0 == 0x80)
    return end


class Codec:
    """Encoder and decoder of one vocabulary. ``memo`` bounds the number of remembered fragments."""

    def __init__(self, path: str, memo: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would each keep memory
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        self.joined = np.zeros((256, 256), bool)
        for t in token.values():
            b = np.frombuffer(t, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        token |= {i: t.encode() for t, i in special.items()}
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(special, key=len, reverse=True)) or b"(?!)")
        size = max(token) + 1
        self.length = np.array([len(token.get(i, b"")) for i in range(size)], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(token.get(i, b"") for i in range(size)), np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.limit = memo
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 16, np.int64)  # fragment i has flat[at[i] : at[i + 1]]
        # a direct-mapped table before the memo: fragments of up to 15 bytes, whole, with their length on top
        self.table_low = np.zeros(1 << TABLE_BITS, np.uint64)
        self.table_high = np.zeros(1 << TABLE_BITS, np.uint64)
        self.table_index = np.zeros(1 << TABLE_BITS, np.int32)

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where fragments begin, with the end of the buffer last."""
        n = len(raw)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            left, right = raw[:-1], raw[1:]
            cut[1:n] = ~self.joined[left, right] & ((right & 0xC0) != 0x80) & (right != 39) & ~white_space_ends(raw)[:-1]
        for m in self.special.finditer(raw.tobytes()):
            if not np.any((offsets > m.start()) & (offsets < m.end())):
                cut[m.start() : m.end()] = False
                cut[[m.start(), m.end()]] = True
        cut[offsets] = True
        return np.flatnonzero(cut)

    def _learn(self, missing: list[bytes]) -> None:
        ids = []
        for at in range(0, len(missing), LEARN):
            texts = [m.decode("utf-8") for m in missing[at : at + LEARN]]
            ids += [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        have, n = len(self.known), len(ids)
        if have + n + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), n + 1), np.int64)])
        self.at[have + 1 : have + n + 1] = self.at[have] + np.cumsum(np.fromiter(map(len, ids), np.int64, n))
        low, high = int(self.at[have]), int(self.at[have + n])
        if high > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), high), np.int32)])
        self.flat[low:high] = np.fromiter(chain.from_iterable(ids), np.int32, high - low)
        self.known.update(zip(missing, range(have, have + n), strict=True))
        self.held += sum(map(len, missing))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and their n+1 offsets."""
        edges = self.cuts(raw, offsets)
        if len(edges) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if len(self.known) > self.limit or self.held > MEMO_BYTES:
            self._forget()
        start, size = edges[:-1], np.diff(edges)
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(raw) + 8,), "<u8", padded, 0, (1,))
        low = eight[start] & FIRST[np.minimum(size, 8)]
        high = (eight[start + 8] & FIRST[np.clip(size - 8, 0, 7)]) | (size.astype(np.uint64) << np.uint64(56))
        slot = ((low ^ (high * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)
        index = self.table_index[slot].astype(np.int64)
        rest = np.flatnonzero((size > 15) | (self.table_low[slot] != low) | (self.table_high[slot] != high))
        data = raw.tobytes()
        parts = [data[a:b] for a, b in zip(start[rest].tolist(), edges[1:][rest].tolist(), strict=True)]
        if missing := [p for p in set(parts) if p not in self.known]:
            self._learn(missing)
        index[rest] = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        new = rest[size[rest] <= 15]
        self.table_low[slot[new]], self.table_high[slot[new]], self.table_index[slot[new]] = low[new], high[new], index[new]
        first = self.at[index]
        length = self.at[index + 1] - first
        before = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(first - before[:-1], length) + np.arange(before[-1])]
        return ids, before[np.searchsorted(edges, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; invalid sequences are replaced as the library does."""
        size = self.length[ids]
        before = np.cumsum(size) - size
        data = self.bytes[np.repeat(self.begin[ids] - before, size) + np.arange(int(size.sum()))].tobytes()
        return data.decode("utf-8", "replace").encode("utf-8")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def op6_rows(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        for part in tk.chunks(batch, "text"):
            ids, offsets = own.encode(*tk.buffer(part.column("text")))
            spans = [ids[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(",".join([own.decimal[i] for i in x.tolist()]).encode()).hexdigest() for x in spans]),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in spans]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def op6_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every text encoded and decoded again. Null counts as empty: no ids, an empty text. One scan, no shuffle.

    Rows stand for themselves, so null and repeated ids, ties and repeated texts need no rule; a very long text is worked
    on alone and whole. An empty table gives an empty result.
    """
    workspace.bounded_batches(spark)
    path = vocabulary or default_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return workspace.arrow_map(docs,
        lambda batches: op6_rows(path, batches), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

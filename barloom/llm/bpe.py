"""Byte-level BPE by merge rank: pre-tokens from the given pattern, merges from a rank queue, and back to bytes.

The queue of one pre-token has a bucket of positions per merge rank.  Three
levels of 64-bit words mark the non-empty buckets, so the next rank is found
by three find-first-set steps whatever the length; positions point into a
linked list of parts, and an entry whose pair has changed meanwhile is skipped.
A very long pre-token costs a constant number of steps per merge.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from barloom.llm.common import by_size
from barloom.llm.tokens import UnitEncoder, Units


class RankQueue:
    """Min-queue of (rank, position) for ranks below 64 ** 3."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}          # only words that are not zero
        self.mid: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(position)
            return
        self.buckets[rank] = [position]
        a = rank >> 6
        if a in self.low:
            self.low[a] |= 1 << (rank & 63)
            return
        self.low[a] = 1 << (rank & 63)
        b = rank >> 12
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions, taken out; (-1, []) when empty."""
        top = self.top
        if not top:
            return -1, []
        b = (top & -top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = self.low[a]
        rank = a << 6 | (w & -w).bit_length() - 1
        w &= w - 1
        if w:
            self.low[a] = w
        else:
            del self.low[a]
            m &= m - 1
            self.mid[b] = m
            if not m:
                self.top = top & (top - 1)
        return rank, self.buckets.pop(rank)


class Ranks:
    """A rank file: ``ids`` by bytes, ``pairs`` (left id * 2**20 + right id -> merged id), ``table`` of bytes by id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if max(self.ids.values()) >= 64 ** 3:
            raise ValueError("ranks must lie below 262,144")
        self.table = [b""] * (max(self.ids.values()) + 1)
        self.pairs: dict[int, int] = {}
        for token, i in self.ids.items():
            self.table[i] = token
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = i
        self.bytes = [self.ids[bytes([b])] for b in range(256)]

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest-ranked pair next, the leftmost among equals."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        tok = [self.bytes[b] for b in word]
        n = len(tok)
        pairs = self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [pairs(a << 20 | b, -1) for a, b in zip(tok, tok[1:])]
        rank.append(-1)
        queue = RankQueue()
        push, pop = queue.push, queue.pop
        for i, r in enumerate(rank):
            if r >= 0:
                push(r, i)
        while True:
            r, todo = pop()
            if r < 0:
                break
            if len(todo) > 1:
                todo.sort()
            for k, i in enumerate(todo):
                if rank[i] != r:                       # stale: a neighbour's merge changed this pair
                    continue
                j = after[i]
                nxt = after[j]
                tok[i], after[i], tok[j], rank[j] = r, nxt, -1, -1
                lowest = r
                if nxt < n:
                    before[nxt] = i
                    new = rank[i] = pairs(r << 20 | tok[nxt], -1)
                    if new >= 0:
                        push(new, i)
                        lowest = new if new < lowest else lowest
                else:
                    rank[i] = -1
                p = before[i]
                if p >= 0:
                    new = rank[p] = pairs(tok[p] << 20 | r, -1)
                    if new >= 0:
                        push(new, p)
                        lowest = new if new < lowest else lowest
                if lowest < r:                         # a new pair comes first: the rest waits in its bucket
                    for x in todo[k + 1:]:
                        if rank[x] == r:
                            push(r, x)
                    break
        return [t for t in tok if t >= 0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> UnitEncoder:
    """The worker's encoder: pre-tokens of each distinct unit, each through the rank queue."""
    import regex

    table, find = ranks(path), regex.compile(pattern).findall
    known = [Units()]

    def encode_units(units: list[str]) -> list[bytes]:
        words = known[0] = known[0].turned()
        rows = [list(map(words.__getitem__, find(u))) for u in units]
        words.settle(lambda new: [np.array(table.encode(w.encode("utf-8")), dtype="<u4").tobytes() for w in new])
        return [b"".join(r) for r in rows]

    return UnitEncoder(encode_units, keep_space=True)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of the whole text; null counts as empty and gives an empty array.

    Every other column passes through; a column called ``ids`` is replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in by_size(texts):
                packed = [np.frombuffer(x, "<u4").astype(np.int32) for x in enc(texts[a:b])]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*packed, np.zeros(0, np.int32)])))
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*cut.columns, ids], names=[*cut.schema.names, "ids"])

    kept = docs.drop("ids")
    return kept.mapInArrow(run, StructType([*kept.schema, StructField("ids", ArrayType(IntegerType()))]))


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``bytes`` (binary) decoded from the ids; null ids give null, an unknown id raises."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            out = pa.array([None if not v.is_valid else table.decode(v.values.to_pylist()) for v in col], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "bytes"])

    kept = df.drop("bytes")
    return kept.mapInArrow(run, StructType([*kept.schema, StructField("bytes", BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digest per document of ids and of the bytes decoded from them, in one pass without a shuffle.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256, lossless``; null text counts
    as empty, repeated rows give repeated rows, other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = encoder(path, pattern), ranks(path)
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_size(texts):
                n, sha, back, same = [], [], [], []
                for t, packed in zip(texts[a:b], enc(texts[a:b])):
                    whole = table.decode(np.frombuffer(packed, "<u4").tolist())
                    n.append(len(packed) // 4)
                    sha.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(whole).hexdigest())
                    same.append(whole == t.encode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a), pa.array(n, pa.int64()), pa.array(sha), pa.array(back), pa.array(same)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")

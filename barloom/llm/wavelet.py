"""Token shards as wavelet matrices: succinct bit-planes with rank and select in one file per shard.

A shard holds the ids of consecutive documents.  Its tokens are numbered by
the sorted distinct ids of the shard, so a shard with few distinct tokens has
few planes; plane by plane, tokens with a 0 move before those with a 1.  From
the planes alone any token can be read (``access``), counted in a range
(``rank``) or found (``select``), without unpacking the shard.

Layout of a segment (little-endian): magic, header, document ids and validity,
document lengths, distinct ids, then per plane the number of zeros, running
counts of ones per 512 bits, and the bits.  A file is a sequence of segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import by_size, work_path
from barloom.llm.tokens import library_encoder

MAGIC = b"WMX1"
_HEADER = struct.Struct("<4sQQQQQII")     # magic, bytes, part, segment, documents, tokens, distinct ids, planes
SEGMENT_TOKENS = 1 << 20
_WORDS = 8                                # 64-bit words per entry of the rank directory


class WaveletMatrix:
    """Access, rank and select over a sequence of ids."""

    def __init__(self, n: int, ids: np.ndarray, zeros: list[int], ones: list[np.ndarray], planes: list[np.ndarray]):
        self.n, self.ids, self.zeros, self.ones, self.planes = n, ids, zeros, ones, planes

    @classmethod
    def build(cls, tokens: np.ndarray) -> "WaveletMatrix":
        n = len(tokens)
        ids = np.flatnonzero(np.bincount(tokens)) if n else np.zeros(0, np.int64)
        code = np.zeros(int(ids[-1]) + 1 if n else 1, dtype=np.uint32)
        code[ids] = np.arange(len(ids))
        cur = code[tokens]
        if len(ids) <= 1 << 16:
            cur = cur.astype(np.uint16)
        zeros, ones, planes = [], [], []
        for level in reversed(range(int(len(ids) - 1).bit_length() if n else 0)):
            bit = (cur >> level) & 1 != 0
            low = cur[np.flatnonzero(~bit)]              # by positions: masks of random bits cost twice the time
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(-(-n // (64 * _WORDS)) * _WORDS, dtype="<u8")
            words.view(np.uint8)[:len(packed)] = packed
            counts = np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1, dtype=np.uint32)
            zeros.append(len(low))
            ones.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4"))
            planes.append(words)
            cur = np.concatenate([low, cur[np.flatnonzero(bit)]])
        return cls(n, ids.astype("<u4"), zeros, ones, planes)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        if i <= 0:
            return 0
        word, bit = divmod(i, 64)
        block = word // _WORDS
        if block >= len(self.ones[level]):
            return self.n - self.zeros[level]
        plane = self.planes[level]
        out = int(self.ones[level][block]) + int(np.bitwise_count(plane[block * _WORDS:word]).sum())
        if bit:
            out += (int(plane[word]) & ((1 << bit) - 1)).bit_count()
        return out

    def _select(self, level: int, k: int, one: bool) -> int:
        """Position of the ``k``-th (from 0) one or zero of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            r = self._rank1(level, mid + 1)
            if (r if one else mid + 1 - r) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i // 64]) >> (i % 64) & 1
            r = self._rank1(level, i)
            code = code << 1 | bit
            i = self.zeros[level] + r if bit else i - r
        return int(self.ids[code])

    def _code(self, token: int) -> int | None:
        c = int(np.searchsorted(self.ids, token))
        return c if c < len(self.ids) and self.ids[c] == token else None

    def rank(self, token: int, end: int, start: int = 0) -> int:
        """Occurrences of ``token`` in ``[start, end)``."""
        code = self._code(token)
        if code is None:
            return 0
        lo, hi = max(start, 0), min(end, self.n)
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if code >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return max(hi - lo, 0)

    def select(self, token: int, k: int) -> int | None:
        """Position of the ``k``-th (from 0) occurrence, or None."""
        code = self._code(token)
        if code is None or not 0 <= k < self.rank(token, self.n):
            return None
        lo, depth = 0, len(self.planes)
        for level in range(depth):
            a = self._rank1(level, lo)
            lo = self.zeros[level] + a if code >> (depth - 1 - level) & 1 else lo - a
        i = lo + k
        for level in reversed(range(depth)):
            one = bool(code >> (depth - 1 - level) & 1)
            i = self._select(level, i - self.zeros[level] if one else i, one)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence: undo the moves from the last plane up."""
        depth = len(self.planes)
        cur = np.zeros(self.n, dtype=np.uint16 if len(self.ids) <= 1 << 16 else np.uint32)
        for level in reversed(range(depth)):
            bit = np.unpackbits(self.planes[level].view(np.uint8), count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[level], np.empty_like(cur)
            up[np.flatnonzero(~bit)] = cur[:z]
            up[np.flatnonzero(bit)] = cur[z:] | (1 << (depth - 1 - level))
            cur = up
        return self.ids[cur]

    def to_bytes(self) -> bytes:
        out = [self.ids.astype("<u4").tobytes()]
        for z, o, p in zip(self.zeros, self.ones, self.planes):
            out += [struct.pack("<Q", z), o.tobytes(), p.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, buf, n: int, sigma: int, depth: int) -> "WaveletMatrix":
        ids = np.frombuffer(buf, "<u4", sigma)
        at, blocks = 4 * sigma, -(-n // (64 * _WORDS))
        zeros, ones, planes = [], [], []
        for _ in range(depth):
            zeros.append(struct.unpack_from("<Q", buf, at)[0])
            ones.append(np.frombuffer(buf, "<u4", blocks, at + 8))
            planes.append(np.frombuffer(buf, "<u8", blocks * _WORDS, at + 8 + 4 * blocks))
            at += 8 + 4 * blocks + 8 * _WORDS * blocks
        return cls(n, ids, zeros, ones, planes)


class Segment:
    """Documents of a shard: ``doc_ids`` (None for a null id), ``ends`` of their tokens, and the matrix."""

    def __init__(self, part: int, number: int, doc_ids: list, lengths: np.ndarray, matrix: WaveletMatrix):
        self.part, self.number, self.doc_ids, self.lengths, self.matrix = part, number, doc_ids, lengths, matrix

    def to_bytes(self) -> bytes:
        m, n = self.matrix, len(self.doc_ids)
        body = b"".join([np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes(),
                         np.array([d is not None for d in self.doc_ids], dtype=np.uint8).tobytes(),
                         self.lengths.astype("<u8").tobytes(), m.to_bytes()])
        return _HEADER.pack(MAGIC, _HEADER.size + len(body), self.part, self.number, n, m.n, len(m.ids), len(m.planes)) + body


def segments(content) -> Iterator[Segment]:
    """The segments of a file's bytes; a line feed may follow each."""
    view, at = memoryview(content), 0
    while at + _HEADER.size <= len(view):
        magic, size, part, number, docs, n, sigma, depth = _HEADER.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        p = at + _HEADER.size
        ids, known = np.frombuffer(view, "<i8", docs, p), np.frombuffer(view, np.uint8, docs, p + 8 * docs)
        lengths = np.frombuffer(view, "<u8", docs, p + 9 * docs)
        yield Segment(part, number, [int(i) if k else None for i, k in zip(ids, known)], lengths,
                      WaveletMatrix.from_bytes(view[p + 17 * docs:at + size], n, sigma, depth))
        at += size + 1


def write_shards(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int | None = 2,
                 keep_space: bool = True, segment_tokens: int = SEGMENT_TOKENS) -> str:
    """Encode every text and write shard files in ascending ``doc_id`` order; returns their folder.

    Documents are range-partitioned and sorted by ``doc_id`` (nulls first,
    equal ids by text), so file k+1 continues where file k ends.  A segment is
    closed at a document's end once it has ``segment_tokens`` tokens, which
    bounds a task's memory.  A null or empty text is just ``end_id``; an empty
    table writes no segment.  Other columns are ignored.  The number of shards
    follows ``spark.sql.shuffle.partitions``; a shard must stay below 2 GB.
    """
    path = path or work_path(docs.sparkSession, "shards")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = library_encoder(vocabulary, keep_space), TaskContext.get().partitionId()
        tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        held_ids, held, size, number = [], [], 0, 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(b) // 4 for b in held], dtype="<u8")
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([Segment(part, number, held_ids, lengths, matrix).to_bytes()], pa.binary())], ["segment"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_size(texts):
                for d, packed in zip(names[a:b], ids_of(texts[a:b])):
                    held_ids.append(d)
                    held.append(packed + tail)
                    size += len(held[-1]) // 4
                    if size >= segment_tokens:
                        yield close()
                        held_ids, held, size, number = [], [], 0, number + 1
        if held_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
         .mapInArrow(encode, "segment binary")
         .select(F.col("segment").cast("string").alias("value"))      # the text writer copies a value's bytes as they are
         .write.text(path))
    return path


def read_shards(spark, path: str) -> DataFrame:
    """Documents of the shards: ``doc_id, start, n_tokens, ids_crc32``, read from the files alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                local = 0
                for seg in segments(content.as_buffer()):
                    ids = seg.matrix.tokens().astype("<u4", copy=False)
                    ends = np.cumsum(seg.lengths).astype(np.int64)
                    starts = ends - seg.lengths.astype(np.int64)
                    crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                    n = len(crc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([seg.part] * n, pa.int64()), pa.array(seg.doc_ids, pa.int64()),
                         pa.array(starts + local, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                        ["part", "doc_id", "local", "n_tokens", "ids_crc32"])
                    local += seg.matrix.n

    from barloom.llm.common import stored

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    rows = stored(files.mapInArrow(decode, "part long, doc_id long, local long, n_tokens long, ids_crc32 long"), "shard-docs")
    before = (rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))        # a row per shard
              .withColumn("before", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
              .select("part", F.coalesce("before", F.lit(0)).alias("before")))
    return (rows.join(before, "part")
            .select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", F.col("part").alias("shard")))

"""Packing by non-negative least squares over the histogram of piece lengths.

Documents are cut into full windows and a rest, so lengths lie in 1..window.
The driver sees only the histogram.  It enumerates combinations of up to three
lengths that fill a window, solves for their repeat counts, rounds down to
what the histogram holds, and packs the residual counts greedily, length by
length.  The result is a list of patterns with repeat counts; on the cluster a
piece finds its pattern, sequence and offset from its number among the pieces
of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_size, give_back, stored, text_slices
from barloom.llm.tokens import CACHE_UNITS, library_encoder
from barloom.plans.rank import numbered

ITERATIONS = 300


def patterns_of(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: unused) that fill ``window``: alone, in pairs and in threes of lengths that occur."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    out = [np.array([[window, 0, 0]])] if has[window] else []
    a = np.arange(1, window // 2 + 1)
    pair = has[a] & has[window - a]
    out.append(np.stack([window - a[pair], a[pair], 0 * a[pair]], axis=1))
    for c in range(1, window // 3 + 1):
        if has[c]:
            b = np.arange(c, (window - c) // 2 + 1)
            ok = has[b] & has[window - c - b]
            b = b[ok]
            out.append(np.stack([window - c - b, b, np.full(len(b), c)], axis=1))
    return np.concatenate(out).astype(np.int64)


def least_squares(pats: np.ndarray, hist: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """x >= 0 that brings the lengths used by the patterns near ``hist``: accelerated projected gradient.

    The error of a length counts by the length, as a long piece left over wastes more.
    """
    if not len(pats):
        return np.zeros(0)
    size = len(hist)
    weight = np.arange(size) / size
    weight[0] = 0.0
    used = np.bincount(pats.ravel(), minlength=size)
    step = 1.0 / (9.0 * max(1.0, (used * weight).max() / 3))       # below 1 / largest eigenvalue of A' W A
    x = z = np.zeros(len(pats))
    t = 1.0
    for _ in range(iterations):
        have = sum(np.bincount(pats[:, k], weights=z, minlength=size) for k in range(3))
        slope = (have - hist) * weight
        new = np.maximum(0.0, z - step * slope[pats].sum(axis=1))
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / nt * (new - x)
        x, t = new, nt
    return x


def solve(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (lists of lengths padded by 0) and repeats that use every piece of ``hist`` (index: length) exactly once."""
    window, left = len(hist) - 1, hist.astype(np.int64).copy()
    left[0] = 0
    pats = patterns_of(window, np.flatnonzero(left))
    chosen: list[tuple[tuple[int, ...], int]] = []
    want = np.floor(least_squares(pats, left.astype(float)) + 0.5).astype(np.int64)
    for k in np.argsort(-want, kind="stable"):
        if want[k] <= 0:
            break
        lengths, times = np.unique(pats[k][pats[k] > 0], return_counts=True)
        n = int(min(want[k], (left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            chosen.append((tuple(int(v) for v in pats[k] if v), n))
    while (rest := np.flatnonzero(left)).size:                          # residual: longest first, then the longest that fits
        room, take = window, {}
        pos = len(rest) - 1
        while room and pos >= 0:
            pos = min(pos, int(np.searchsorted(rest, room, side="right")) - 1)
            if pos < 0:
                break
            v = int(rest[pos])
            m = int(min(left[v], room // v))
            if not take:
                m = 1 if room // v < 2 else min(m, room // v)
            take[v] = m
            room -= m * v
            pos -= 1
        n = min(int(left[v]) // m for v, m in take.items())
        for v, m in take.items():
            left[v] -= n * m
        chosen.append((tuple(v for v, m in take.items() for _ in range(m)), n))
    width = max((len(p) for p, _ in chosen), default=1)
    return (np.array([p + (0,) * (width - len(p)) for p, _ in chosen], np.int64).reshape(-1, width),
            np.array([n for _, n in chosen], np.int64))


def pieces(docs: DataFrame, vocabulary: str, window: int, end_id: int | None, keep_space: bool,
           cache_units: int = CACHE_UNITS) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of the cut documents; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = library_encoder(vocabulary, keep_space, cache_units)
        tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, texts in text_slices(batch.column(1), limit=2_000_000):
                rows = [(d, s, min(window, n - s), zlib.crc32(p[4 * s:4 * (s + window)]), n)
                        for d, p in ((d, q + tail) for d, q in zip(names[a:], ids_of(texts)))
                        for n in (len(p) // 4,) for s in range(0, n, window)]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def _slots(pats: np.ndarray, repeats: np.ndarray, window: int) -> list[tuple]:
    """``length, low, high, sequence, times, place, offset``: the pieces numbered low..high-1 of a length.

    A pattern that uses a length ``times`` times takes that many consecutive
    pieces per sequence, at ``offset`` and onwards.
    """
    out, taken, first = [], np.zeros(window + 1, np.int64), 0
    for pat, n in zip(pats.tolist(), repeats.tolist()):
        at = 0
        for v in sorted({p for p in pat if p}, reverse=True):
            times = pat.count(v)
            low = int(taken[v])
            taken[v] += n * times
            out.append((v, low, int(taken[v]), first, times, at))
            at += v * times
        first += n
    return out


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int | None = 1, keep_space: bool = False,
         cache_units: int = CACHE_UNITS) -> DataFrame:
    """Place every token of ``docs`` (``doc_id``, ``text``; other columns are ignored) in sequences of ``window`` ids.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  Null and empty texts are one piece of ``end_id``
    (none without it); repeated rows and ids are packed one by one; an empty
    table gives no piece.  The histogram has ``window`` counts whatever the
    input; pieces of one length are numbered in range partitions, so a common
    length is not one task.  Texts of a document are tokenised once.
    A worker remembers the ids of up to twice ``cache_units`` units (about 200
    bytes each); fewer cost time, never results.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary, window, end_id, keep_space, cache_units), "pieces")
    counts = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()           # ``window`` rows at most
    hist = np.zeros(window + 1, np.int64)
    for r in counts:
        hist[r.length] = r.n
    pats, repeats = solve(hist)
    slots = spark.createDataFrame(_slots(pats, repeats, window), "length long, low long, high long, first long, times long, at long") \
        if len(pats) else spark.createDataFrame([], "length long, low long, high long, first long, times long, at long")
    order = [F.col(c) for c in ("doc_id", "start", "ids_crc32")]
    placed = numbered(cut, ("length",), order, "rank", "of_length").drop("of_length").withColumn("rank", F.col("rank") - 1)
    return _assign(placed, slots)


def _assign(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """Look each piece's number up in the slot that holds it: both sides meet in blocks of numbers of a length."""
    block = 4096
    s = (slots.withColumn("block", F.explode(F.expr(f"sequence(low div {block}, (high - 1) div {block})")))
         .withColumnRenamed("length", "slot_length"))
    p = placed.withColumn("piece_block", F.expr(f"rank div {block}"))
    hit = p.join(s, (p.length == s.slot_length) & (p.piece_block == s.block) & (p["rank"] >= s.low) & (p["rank"] < s.high))
    k = F.col("rank") - F.col("low")
    return hit.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      (F.col("first") + F.expr("(rank - low) div times")).alias("sequence_id"),
                      (F.col("at") + F.pmod(k, F.col("times")) * F.col("length")).alias("offset"))


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, window: int = 2048, end_id: int | None = 1,
              keep_space: bool = False, pad_id: int = 0) -> DataFrame:
    """``sequence_id, ids`` (array<int>, padded by ``pad_id``) from ``pack``'s rows and the documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = library_encoder(vocabulary, keep_space)
        tail = [] if end_id is None else [end_id]
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_size(texts):
                rows = [(d, s, ids[s:s + window], zlib.crc32(np.array(ids[s:s + window], "<u4").tobytes()))
                        for d, p in zip(names[a:b], ids_of(texts[a:b]))
                        for ids in (np.frombuffer(p, "<u4").tolist() + tail,) for s in range(0, len(ids), window)]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32())),
                     pa.array(cols[3], pa.int64())], ["doc_id", "start", "ids", "ids_crc32"])

    cut = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
           .mapInArrow(run, "doc_id long, start long, ids array<int>, ids_crc32 long").dropDuplicates(["doc_id", "start", "ids_crc32"]))
    key = [F.col("p." + c).eqNullSafe(F.col("c." + c)) for c in ("doc_id", "start", "ids_crc32")]
    flat = (placed.alias("p").join(cut.alias("c"), key[0] & key[1] & key[2])
            .groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("p.offset", "c.ids"))).alias("parts")))   # ``window`` ids at most
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return flat.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(window) - F.size(ids))).alias("ids"))

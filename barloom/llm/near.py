"""SimHash near-duplicates at a Jaccard similarity of word shingles.

Four bits of 64 reach texts of a similarity of about 0.96 and more.  For 0.8
one 64-bit word is too coarse and its pigeonhole would probe nearly every
value, so this operator lengthens the fingerprint to ``WORDS`` words, all of
the distinct shingles of a text.  The first word goes through the generalised
pigeonhole of ``simhash.links``.  Links that it leaves out are candidates of
banded least hashes of the same shingles (16 bands of 8: a pair of similarity
0.8 meets with probability 0.95), judged by all 1,024 bits: sets of Jaccard
similarity s and equal size have cosine 2s / (1 + s) and differ in
arccos(cosine) / pi of the bits.  Four standard deviations below that a link is
sure, three above it there is none.  A task returns the least spanning forest
of a key's candidates, no pairs of a group; forest links that are not sure, and
those of the pigeonhole, are settled by the exact similarity of both texts'
shingles.  Documents of fewer than ``SMALL`` shingles, where the law is rough,
carry their shingles and are compared exactly at once; sizes too far apart
never link.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import give_back, stored, text_slices
from barloom.llm.components import components
from barloom.llm.simhash import CHUNK, links

WORDS, BANDS, ROWS, SMALL = 16, 16, 8, 64
BITS = 64 * WORDS

_draw = np.random.default_rng(42).integers(0, 2**64, (4, BANDS * ROWS), dtype=np.uint64)
FACTOR, FLIP, WORD, ODD = _draw[0] | np.uint64(1), _draw[1], _draw[2, 1:WORDS], _draw[3, :3] | np.uint64(1)


def differing_bits(similarity: float) -> float:
    """Expected number of differing bits of two equally large sets of this Jaccard similarity."""
    return BITS * acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def limits(similarity: float) -> tuple[int, int]:
    """Bits up to which a link is sure, and beyond which there is none."""
    mean = differing_bits(similarity)
    deviation = sqrt(mean * (1 - mean / BITS))
    return max(0, round(mean - 4 * deviation)), round(mean + 3 * deviation)


def shingles(text: str, width: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of a text in ASCII lower case; fewer words are one shingle, none are none."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - width + 1]
    hashes = (xxh64_intdigest(line[s:e], seed) for s, e in zip(starts.tolist(), ends[width - 1:].tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


def long_fingerprint(h: np.ndarray) -> np.ndarray:
    """``WORDS`` words; a bit is 1 if set in over half of the hashes.  The first word uses the hashes as they are."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 255):                          # at most 255 rows, so bytes hold the counts
        part = h[a:a + 255, None]
        x = (part ^ WORD) * ODD[0]
        x ^= x >> np.uint64(32)
        x *= ODD[1]
        x ^= x >> np.uint64(29)
        bits = np.unpackbits(np.concatenate([part, x], axis=1).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """One key per band, of the least values of its ``ROWS`` hash functions; none for a text without words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 512):
        np.minimum(least, ((h[a:a + 512, None] ^ FLIP) * FACTOR).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * ODD[2]
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * ODD[0]
        key ^= key >> np.uint64(31)
    return key


def sketches(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """``doc_id, n, fp, sig, bands, small`` of every row with an id: ``fp`` is the first word of ``sig``, ``small`` the shingles of short documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                sets = [shingles(t, width, seed) for t in texts]
                sig = [long_fingerprint(h) for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), pa.array([len(h) for h in sets], pa.int64()),
                     pa.array(np.array([s[0] for s in sig], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary()),
                     pa.array([bands(h).view(np.int64) for h in sets], pa.list_(pa.int64())),
                     pa.array([h.view(np.int64) if len(h) < SMALL else None for h in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n", "fp", "sig", "bands", "small"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, n long, fp long, sig binary, bands array<long>, small array<long>")


def _forest(sig: np.ndarray, n: np.ndarray, small: list, similarity: float) -> list[tuple[int, int, bool]]:
    """Least spanning forest (two positions, sure or not) of the candidates among these rows, grown row by row."""
    sure, radius = limits(similarity)
    m = len(n)
    held = [k for k in range(m) if small[k] is not None]
    where = np.array(held, np.int64)
    if held:
        ids = np.unique(np.concatenate([small[k] for k in held]), return_inverse=True)[1]
        ends = np.cumsum([len(small[k]) for k in held])
        own = dict(zip(held, np.split(ids, ends[:-1])))
        mark = np.zeros(ids.max() + 1 if len(ids) else 1, bool)
        owner = np.repeat(np.arange(len(held)), np.diff(ends, prepend=0))
    best, source, free, out = np.full(m, BITS + 1), np.zeros(m, np.int64), np.ones(m, bool), []
    at = 0
    for _ in range(m):
        free[at] = False
        if best[at] <= radius:
            out.append((int(source[at]), at, bool(best[at] <= sure)))
        d = np.bitwise_count(sig ^ sig[at]).sum(axis=1, dtype=np.int64)
        d[np.minimum(n, n[at]) < similarity * np.maximum(n, n[at])] = BITS + 1
        if small[at] is not None:
            mark[own[at]] = True
            common = np.bincount(owner[mark[ids]], minlength=len(held))
            mark[own[at]] = False
            alike = common >= similarity * (n[where] + n[at] - common)
            d[where] = np.where(alike, np.minimum(d[where], sure), BITS + 1)
        closer = free & (d < best)
        best[closer], source[closer] = d[closer], at
        if not free.any():
            break
        at = int(np.argmin(np.where(free, best, BITS + 2)))
    return out


def _banded(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """Spanning links ``a, b, sure`` of the nodes of each run of equal ``keys``; a run has at most about two chunks of rows."""
    def solve(t: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        node, n = np.asarray(t.column("node")), np.asarray(t.column("n"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(-1, WORDS)
        small = [s.values.to_numpy() if s.is_valid else None for s in t.column("small")]
        pairs, s = [], 0
        for e in ends.tolist():
            pairs.extend((s + i, s + j, k) for i, j, k in _forest(sig[s:e], n[s:e], small[s:e], similarity))
            s = e
        at = np.array(pairs, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]]), pa.array(at[:, 2] > 0)], ["a", "b", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            change = np.zeros(len(t) - 1, bool)
            for k in keys:
                c = np.asarray(t.column(k))
                change |= c[1:] != c[:-1]
            ends = np.flatnonzero(change) + 1
            if len(ends):
                yield solve(t.slice(0, int(ends[-1])), ends)
                t = t.slice(int(ends[-1]))
            held = t
        if held is not None and len(held):
            yield solve(held, np.array([len(held)]))
        give_back()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, sure boolean")


def banded_links(nodes: DataFrame, similarity: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """Spanning links ``a, b, sure`` of ``nodes`` (``node, n, sig, bands, small``) that meet in a band and may be close enough.

    Keys held once go before any fingerprint moves.  A key with more than
    ``chunk`` nodes is cut into chunks by hash and each pair of chunks compared
    in a task of its own, so that no group is gathered whole.
    """
    keyed = stored(nodes.select("node", F.explode("bands").alias("key")), "near-keys")
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    c = F.ceil(F.col("c") / chunk).cast("int")
    cut = (keyed.join(met, "key").withColumn("c", c).withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
           .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node"))
    rows = cut.join(nodes.select("node", "n", "sig", "small"), "node").select("key", "x", "y", "node", "n", "sig", "small")
    return _banded(rows, ["key", "x", "y"], similarity)


def settled(docs: DataFrame, found: DataFrame, similarity: float, width: int = 5, seed: int = 42) -> DataFrame:
    """Those links ``a, b`` of ``found`` whose texts in ``docs`` have this exact Jaccard similarity; other texts are not read into sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                sets = [shingles(t, width, seed).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(sets, pa.list_(pa.int64()))], ["id", "words"])
        give_back()

    ends = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ends, "id", "left_semi")
    sets = stored(rows.mapInArrow(run, "id long, words array<long>"), "near-sets")
    x, y = sets.select(F.col("id").alias("a"), F.col("words").alias("x")), sets.select(F.col("id").alias("b"), F.col("words").alias("y"))
    both = found.join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.filter(F.col("common") >= similarity * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, component_id`` per row of ``docs`` that has an id (columns ``doc_id``, ``text``; others are ignored).

    ``component_id`` is the smallest id reachable by links.  Texts of equal
    shingle sets are one node whatever their number; null, empty and blank
    texts are one node, and so are the texts of one id.  Rows without an id link with nothing and are left
    out; repeated rows stay repeated; an empty table gives none.
    """
    rows = stored(sketches(docs, width, seed), "near-sketches")
    nodes = stored(rows.groupBy("sig", "n").agg(*(F.min(c).alias(d) for c, d in [("doc_id", "node"), ("fp", "fp"), ("bands", "bands"), ("small", "small")])),
                   "near-nodes")
    fps = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "near-words")
    close = links(fps, radius)
    a, b = fps.select(F.col("fp").alias("a"), F.col("least").alias("p")), fps.select(F.col("fp").alias("b"), F.col("least").alias("q"))
    probed = (close.join(a, "a").join(b, "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
              .unionByName(nodes.join(fps, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))))
    found = probed.withColumn("sure", F.lit(False)).unionByName(banded_links(nodes, similarity)).filter("a <> b")
    found = stored(found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sure").alias("sure")), "near-links")
    kept = found.filter("sure").select("a", "b").unionByName(settled(docs, found.filter("NOT sure").select("a", "b"), similarity, width, seed))
    named = components(kept)
    least = nodes.select("sig", "n", "node").join(named, "node", "left").select("sig", "n", F.coalesce("component", "node").alias("component_id"))
    return rows.select("doc_id", "sig", "n").join(least, ["sig", "n"]).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, similarity: float = 0.8, width: int = 5, radius: int = 4, seed: int = 42) -> DataFrame:
    """Rows whose id is the smallest of its component; rows without an id and repeats of a staying id stay (exact dedup takes those)."""
    marks = near_duplicates(docs, similarity, width, radius, seed).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(marks, "doc_id", "left_anti")

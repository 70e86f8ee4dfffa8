"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``radius`` bits are linked.  The 64 bits are grouped into
partitions of correlated bits; thresholds t_i >= -1 with sum(t_i + 1) =
radius + 1 guarantee that linked fingerprints differ in at most t_i bits of
some partition (Qin et al., 2018).  The number of partitions and the
thresholds come from dynamic programming on estimated costs.  A partition with
t_i = -1 is not probed; otherwise every distinct fingerprint stands at its own
value, and those below probe the values within t_i bits above their own.
Tasks verify the candidates of a value and return a spanning forest of its
links, so a dense group yields a link per member and not per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import by_size, stored
from barloom.llm.components import components

CHUNK = 2048                 # fingerprints of a probed value per side of a task
ROW_COST, PAIR_COST = 2e-6, 1e-8


def fingerprint(text: str, width: int = 4, seed: int = 42, step: int = 100_000) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles of a text in ASCII lower case."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for a in range(0, n, step):
        b = min(a + step, n)
        h = np.array([xxh64_intdigest(line[s:e], seed)
                      for s, e in zip(starts[a:b].tolist(), ends[a + width - 1:b + width - 1].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (signed long) of every row; null and empty texts have fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in by_size(texts):
                fp = np.array([fingerprint(t, width, seed) for t in texts[a:b]], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of jointly set bits, over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = np.unpackbits(np.asarray(batch.column(0)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel().astype(np.int64))], ["i", "j", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([-1]), pa.array([n])], ["i", "j", "c"])

    n, joint = 0, np.zeros((64, 64))
    for r in fps.select("fp").mapInArrow(run, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():  # 4,097 rows
        if r.i < 0:
            n = r.c
        else:
            joint[r.i, r.j] = r.c
    return n, joint


def group_bits(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of near-equal width: each takes a free bit and the free bits most correlated with what it has."""
    p = np.diag(joint) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    free, out = list(range(64)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        own = [max(free, key=lambda b: corr[b, free].sum())]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda b: corr[b, own].sum()))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def plan(n: int, joint: np.ndarray, radius: int, most_parts: int = 8) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the probed partitions with least estimated cost.

    A partition's candidates at threshold t are the pairs that differ in at
    most t of its bits, estimated from the frequency of every bit; its rows are
    the fingerprints times half the values within t bits.
    """
    p = np.diag(joint) / max(n, 1)
    differ = 2 * p * (1 - p)
    best_cost, best = float("inf"), []
    for parts in range(1, most_parts + 1):
        groups = group_bits(joint, n, parts)
        costs = []
        for bits in groups:
            dist = np.zeros(radius + 1)
            dist[0] = 1.0
            for b in bits:
                dist[1:] = dist[1:] * (1 - differ[b]) + dist[:-1] * differ[b]
                dist[0] *= 1 - differ[b]
            near = np.cumsum(dist)
            costs.append([0.0] + [n * (1 + sum(comb(len(bits), d) for d in range(1, t + 1)) / 2) * ROW_COST
                                  + n * (n - 1) / 2 * near[t] * PAIR_COST for t in range(radius + 1)])
        units = radius + 1                                   # a threshold t takes t + 1 units
        table = {0: (0.0, [])}
        for cost in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table.items():
                for u in range(units - used + 1):
                    cand = (c + cost[u], ts + [u - 1])
                    if used + u not in nxt or cand[0] < nxt[used + u][0]:
                        nxt[used + u] = cand
            table = nxt
        if units in table and table[units][0] < best_cost:
            best_cost, best = table[units][0], [(g, t) for g, t in zip(groups, table[units][1]) if t >= 0]
    return best


def _signatures(fps: DataFrame, probes: list[tuple[list[int], int]]) -> DataFrame:
    """``part, value, home, fp``: own values, and probes of greater values within the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = []
        for bits, t in probes:
            whole = sum(1 << b for b in bits)
            flips = [sum(1 << b for b in c) for d in range(1, t + 1) for c in combinations(bits, d)]
            masks.append((np.uint64(whole), np.array(flips, dtype=np.uint64)))
        for batch in batches:
            every = np.asarray(batch.column(0)).view(np.uint64)
            for a in range(0, len(every), 4096):
                fp = every[a:a + 4096]
                for k, (whole, flips) in enumerate(masks):
                    v = fp & whole
                    values, own, who = [v], [np.ones(len(v), bool)], [fp]
                    for f in flips:
                        w = v ^ f
                        up = w > v
                        values.append(w[up])
                        own.append(np.zeros(int(up.sum()), bool))
                        who.append(fp[up])
                    values = np.concatenate(values)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)), pa.array(np.concatenate(own)),
                         pa.array(np.concatenate(who).view(np.int64))], ["part", "value", "home", "fp"])

    return fps.select("fp").mapInArrow(run, "part int, value long, home boolean, fp long")


def forest(fp: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest (pairs of positions) of the links with at least one end at home."""
    n = len(fp)
    label, out = np.arange(n), []
    for a in range(0, n, 256):
        near = np.bitwise_count(fp[a:a + 256, None] ^ fp[None, :]) <= radius
        near &= home[a:a + 256, None] | home[None, :]
        for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
            roots = np.unique(label[near[i]])
            own = label[a + i]
            if len(roots) > 1:
                out.extend((int(own), int(r)) for r in roots if r != own)
                label[np.isin(label, roots)] = own
    return out


def _links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Spanning links of each run of equal ``keys``; a run has at most about two chunks of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def solve(cols: list[np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
            fp, home = cols[-1].view(np.uint64), cols[-2].astype(bool)
            starts = np.concatenate([[0], ends[:-1]])
            sizes, a, b = ends - starts, [], []
            run_of = np.repeat(np.arange(len(ends)), sizes)
            small = np.flatnonzero(sizes[run_of] <= 16)                # short runs: all rows d apart at once
            for d in range(1, 16):
                small = small[small + d < ends[run_of[small]]]
                if not len(small):
                    break
                x, y = small, small + d
                hit = (np.bitwise_count(fp[x] ^ fp[y]) <= radius) & (home[x] | home[y])
                a.append(fp[x[hit]])
                b.append(fp[y[hit]])
            for k in np.flatnonzero(sizes > 16).tolist():
                s, e = int(starts[k]), int(ends[k])
                for i, j in forest(fp[s:e], home[s:e], radius):
                    a.append(fp[s + i:s + i + 1])
                    b.append(fp[s + j:s + j + 1])
            empty = np.zeros(0, np.uint64)
            a, b = np.concatenate([*a, empty]).view(np.int64), np.concatenate([*b, empty]).view(np.int64)
            other = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[other]), pa.array(b[other])], ["a", "b"])

        for batch in batches:
            cols = [np.asarray(c) if not pa.types.is_boolean(c.type) else np.array(c.to_pylist(), bool) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            n = len(cols[0])
            if not n:
                continue
            change = np.zeros(n - 1, bool)
            for c in cols[:len(keys)]:
                change |= c[1:] != c[:-1]
            ends = np.flatnonzero(change) + 1
            if len(ends):
                yield solve([c[:ends[-1]] for c in cols], ends)
                held = [c[ends[-1]:] for c in cols]
            else:
                held = cols
        if held is not None and len(held[0]):
            yield solve(held, np.array([len(held[0])]))

    cut = rows.select(*keys, "home", "fp").repartition(*keys).sortWithinPartitions(*keys)
    return cut.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Spanning links ``a, b`` of distinct fingerprints (column ``fp``): their components are those of all links.

    A value with more than ``chunk`` rows is cut into chunks by hash; each pair
    of chunks is a task of its own, so no group is gathered whole and no link
    is lost.
    """
    n, joint = bit_moments(fps)
    rows = _signatures(fps, plan(n, joint, radius))
    heavy = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    c = F.ceil(F.coalesce("n", F.lit(1)) / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    cut = (rows.join(heavy, ["part", "value"], "left").withColumn("c", c).withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
           .select("part", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "home", "fp"))
    return _links(cut, ["part", "value", "x", "y"], radius).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs`` (columns ``doc_id``, ``text``; others are ignored).

    ``component_id`` is the smallest id reachable by links; null ids count only
    where a component has no other.  Equal fingerprints are one node whatever
    their number; null, empty and blank texts share fingerprint zero.  Repeated
    rows stay repeated; an empty table gives none.
    """
    rows = stored(fingerprints(docs, width, seed), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    found = components(links(nodes, radius)).select(F.col("node").alias("fp"), "component")
    member = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    member = stored(member, "fingerprint-members")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """Rows whose id is the smallest of its component; rows without an id and repeats of a staying id stay (exact dedup takes those)."""
    marks = near_duplicates(docs, radius, width, seed).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(marks, "doc_id", "left_anti")

"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c.  After a
rotation the coordinates are cut into low-dimensional blocks; each block gets
the share of that budget that its dimensions have, and vectors within the whole
budget are within the share in at least one block.  Each block is range-joined:
one side's vectors are cut at medians into cells, whose boxes find the vectors
of the other side that some ball of the cell can touch.

Vectors are packed once into tiles: the rotated vector as signed bytes, in three
digits of base 254 per component.  Each pair of tiles is one row of a product
that pulls both tiles from the stored table, so no vector is copied per cell or
per partner and the work tables grow with the input; what grows faster is
arithmetic and what tasks read.  Rounding to the first digit moves a vector by at most
sqrt(dimensions) / 254, so distances between rounded vectors bound the true
ones on both sides.  Pairs that the first digit leaves open get a second look at
all three digits in the same task, whose bounds are 64,516 times closer; only a
pair within about 3e-7 of the wanted cosine (64 dimensions) leaves the task as
a row, to be decided by the original vectors in double precision.  A pair is
settled in the first block that admits it, so tasks return counts per vector
and a spanning forest, not all pairs, dense groups included.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import stored
from barloom.llm.components import components

SCALE = 127
BASE = 254                       # of the two further digits of a component
CELL_ROWS = 256
BLOCK_DIMS = 8
CHUNK_ROWS = 16_384              # rows of a tile at most
TILE_BYTES = 4 << 20             # and its bytes, about
TILES = 24                       # smaller tiles before fewer, for tasks enough
BATCH_PAIRS = 4                  # pairs of tiles handed to a worker at once


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array<float> as given, else array<double>): null unless every component is finite and one is not zero."""
    kind = df.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return df.select(F.col(vec_id).alias("vec_id"), F.when(~bad & some, v).alias("v"))


def _rounded(classes: DataFrame, dims: int) -> DataFrame:
    """``cid, w, q``: three bytes per component of the rotated unit vector, all first digits, all second, all third."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).astype(np.float64, copy=False).reshape(-1, dims)
            x = x / np.abs(x).max(axis=1, keepdims=True)                 # no overflow in the squares
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            y = x @ turn * SCALE
            first = np.rint(y)
            rest = np.rint(y * BASE ** 2) - first * BASE ** 2
            second = np.rint(rest / BASE)
            q = np.hstack([first, second, rest - second * BASE]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in q], pa.binary())],
                                             ["cid", "w", "q"])

    return classes.select("cid", "w", "v").mapInArrow(run, "cid long, w long, q binary")


def _tiled(rounded: DataFrame, dims: int, tiles: int) -> DataFrame:
    """``tile, rows``: each tile's ids, weights and digits one after the other in one value; vectors are dealt by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def close() -> pa.RecordBatch:
            cid, w = (np.concatenate([c[i] for c in held]).astype("<i8").tobytes() for i in (0, 1))
            body = b"".join([cid, w, *[c[2] for c in held]])
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([body], pa.binary())], ["tile", "rows"])

        for batch in batches:
            tile = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                if start == end:
                    continue
                if held and tile[start] != last:
                    yield close()
                    held = []
                last = int(tile[start])
                part = batch.slice(start, end - start)
                held.append((np.asarray(part.column(1)), np.asarray(part.column(2)), b"".join(part.column(3).to_pylist())))
        if held:
            yield close()

    return (rounded.select(F.pmod(F.xxhash64("q"), F.lit(tiles)).alias("tile"), "cid", "w", "q").repartition(tiles, "tile")
            .sortWithinPartitions("tile").mapInArrow(run, "tile long, rows binary"))


def _cells(g: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of ``g`` cut at the median of their widest coordinate until a cell has ``size`` rows at most."""
    out, todo = [], [np.arange(len(g))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        x = g[rows]
        x = x[:, np.argmax(x.max(axis=0) - x.min(axis=0))]
        order, mid = np.argpartition(x, len(rows) // 2), len(rows) // 2
        todo += [rows[order[:mid]], rows[order[mid:]]]
    return out


class _Tile:
    """A tile's columns; ``f`` are the first digits, ``sides`` each block's factors of a product that gives squared distances."""

    def __init__(self, body: bytes, dims: int, blocks: list[tuple[int, int]]):
        n = len(body) // (16 + 3 * dims)
        self.cid, self.w = np.frombuffer(body, "<i8", n), np.frombuffer(body, "<i8", n, 8 * n)
        self.q = np.frombuffer(body, np.int8, n * 3 * dims, 16 * n).reshape(n, 3 * dims)
        self.f, one = self.q[:, :dims].astype(np.float32), np.ones((n, 1), np.float32)
        self.sides = []
        for s, e in blocks:
            g = self.f[:, s:e]
            sq = (g * g).sum(axis=1, keepdims=True)
            self.sides.append((np.hstack([-2 * g, sq, one]), np.hstack([g, one, sq]).T.copy()))
        self.cells: dict[int, list[np.ndarray]] = {}


@contextmanager
def _few_records(spark: SparkSession, records: int):
    """Batches of ``records`` rows for workers while a table of large values is written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(records))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bounds(reach: float, dims: int) -> tuple[float, float]:
    """Squared distances of rounded vectors up to which a link is sure, and beyond which there is none."""
    return -1.0 if reach <= sqrt(dims) else max(0.0, reach - sqrt(dims) - 1e-3) ** 2, (reach + sqrt(dims)) ** 2


def _settle(pairs: DataFrame, dims: int, blocks: list[tuple[int, int]], limits: list[float], reach: float, cell: int) -> DataFrame:
    """``kind, a, b, n``: sure links counted per vector (kind 0), spanning links (1), pairs at the very limit (2)."""
    sure, maybe = _bounds(reach, dims)
    sure_fine, maybe_fine = _bounds(reach * BASE ** 2, dims)

    def near(a: _Tile, b: _Tile) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Block, rows of ``a`` and rows of ``b`` within the block's limit; in one tile the lesser row is of ``a``."""
        for k in range(len(blocks)):
            left, right = a.sides[k][0], b.sides[k][1]
            x = right[:-2]
            if k not in a.cells:
                a.cells[k] = _cells(a.f[:, slice(*blocks[k])], cell)
            for rows in a.cells[k]:
                g = a.f[rows, slice(*blocks[k])]
                gap = np.maximum(g.min(axis=0)[:, None] - x, x - g.max(axis=0)[:, None])
                np.maximum(gap, 0, out=gap)
                gap *= gap
                some = np.flatnonzero(gap.sum(axis=0) <= limits[k])
                if not len(some):
                    continue
                i, j = np.divmod(np.flatnonzero(left[rows] @ right[:, some] <= limits[k]), len(some))   # exact in integers
                i, j = rows[i], some[j]
                if a is b:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield k, i, j

    def solve(a: _Tile, b: _Tile):
        alone = a is b
        f, q, cid, w = (x if alone else np.concatenate([x, y]) for x, y in ((a.f, b.f), (a.q, b.q), (a.cid, b.cid), (a.w, b.w)))
        n, shift = len(cid), 0 if alone else len(a.cid)
        count, label = np.zeros(n, np.int64), np.arange(n)
        kinds = [[], [], [], []]

        def put(kind, a, b, m):
            for col, v in zip(kinds, (np.full(len(a), kind, np.int32), a, b, m)):
                col.append(v)

        for block, i, j in near(a, b):
            j = j + shift
            for p in range(0, len(i), 1 << 17):
                x, y = i[p:p + (1 << 17)], j[p:p + (1 << 17)]
                d = f[x] - f[y]
                d *= d
                whole, keep = d.sum(axis=1), np.ones(len(x), bool)
                for c in range(block):                                # an earlier block settles it
                    keep &= d[:, blocks[c][0]:blocks[c][1]].sum(axis=1) > limits[c]
                keep &= whole <= maybe
                x, y, whole = x[keep], y[keep], whole[keep]
                yes = whole <= sure
                open_ = np.flatnonzero(~yes)
                doubt = np.zeros(len(x), bool)
                for lo in range(0, len(open_), 1 << 14):               # the second look, in all three digits
                    some = open_[lo:lo + (1 << 14)]
                    d = (q[x[some]].astype(np.float64) - q[y[some]]).reshape(-1, 3, dims)
                    d = d[:, 0] * BASE ** 2 + d[:, 1] * BASE + d[:, 2]
                    fine = (d * d).sum(axis=1)
                    yes[some] = fine <= sure_fine
                    doubt[some] = (fine > sure_fine) & (fine <= maybe_fine)
                np.add.at(count, x[yes], w[y[yes]])
                np.add.at(count, y[yes], w[x[yes]])
                put(2, cid[x[doubt]], cid[y[doubt]], np.zeros(int(doubt.sum()), np.int64))
                x, y = x[yes], y[yes]
                while len(x):                                         # halve the links to a spanning forest, all at once
                    lx, ly = label[x], label[y]
                    open_ = lx != ly
                    x, y, lx, ly = x[open_], y[open_], lx[open_], ly[open_]
                    if not len(x):
                        break
                    hi, lo = np.maximum(lx, ly), np.minimum(lx, ly)
                    to, first = np.unique(hi, return_index=True)
                    put(1, cid[x[first]], cid[y[first]], np.zeros(len(first), np.int64))
                    move = np.arange(n)
                    move[to] = lo[first]
                    while True:
                        nxt = move[move]
                        if (nxt == move).all():
                            break
                        move = nxt
                    label = move[label]
        some = np.flatnonzero(count)
        put(0, cid[some], cid[some], count[some])
        return [np.concatenate(k) for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, None                                              # the left tile stays while its partners pass
        for batch in batches:
            for left, right, ours, theirs in zip(*batch.columns):
                if left.as_py() != last:
                    last, a = left.as_py(), _Tile(ours.as_py(), dims, blocks)
                b = a if right.as_py() == last else _Tile(theirs.as_py(), dims, blocks)
                kind, x, y, n = solve(a, b)
                if len(kind):
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y), pa.array(n)], ["kind", "a", "b", "n"])

    return pairs.mapInArrow(run, "kind int, a long, b long, n long")


def _links(classes: DataFrame, dims: int, cosine: float, block_dims: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Links of distinct vectors of one length: ``cid, n`` (rows linked) and ``a, b`` (a spanning forest)."""
    n = classes.count()
    count = max(1, round(dims / block_dims))
    bounds = np.linspace(0, dims, count + 1).round().astype(int).tolist()
    blocks = list(zip(bounds[:-1], bounds[1:]))
    budget = 2 - 2 * cosine + 1e-9
    slack = [sqrt(e - s) for s, e in blocks]                              # rounding, in units of 1 / SCALE
    limits = [(sqrt(budget * (e - s) / dims) * SCALE + r) ** 2 for (s, e), r in zip(blocks, slack)]
    room = max(1, min(chunk, TILE_BYTES // (3 * dims + 16)))
    tiles = stored(_tiled(_rounded(classes, dims), dims, max(ceil(n / room), min(ceil(n / (4 * CELL_ROWS)), TILES))), "tiles")
    left, right = tiles.toDF("left", "ours"), tiles.toDF("right", "theirs")
    # each pair of tiles once, dealt evenly over both orders
    once = (F.col("left") == F.col("right")) | ((F.col("left") < F.col("right")) == ((F.col("left") + F.col("right")) % 2 == 0))
    pairs = left.join(right.hint("shuffle_replicate_nl"), once).select("left", "right", "ours", "theirs")
    with _few_records(classes.sparkSession, BATCH_PAIRS):
        found = stored(_settle(pairs, dims, blocks, limits, sqrt(budget) * SCALE, CELL_ROWS), "settled")
    vs = classes.select("cid", F.col("v").cast("array<double>").alias("v"), "w")
    pairs = (found.filter("kind = 2").select("a", "b").join(vs.toDF("a", "va", "wa"), "a").join(vs.toDF("b", "vb", "wb"), "b"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    unit = lambda p: F.transform(p, lambda s: s / F.array_max(F.transform(p, F.abs)))
    checked = stored(pairs.select("a", "b", "wa", "wb", unit("va").alias("va"), unit("vb").alias("vb"))
                     .filter(dot(F.col("va"), F.col("vb")) / (F.sqrt(dot(F.col("va"), F.col("va"))) * F.sqrt(dot(F.col("vb"), F.col("vb")))) >= cosine)
                     .select("a", "b", "wa", "wb"), "verified")
    counts = found.filter("kind = 0").select(F.col("a").alias("cid"), "n").union(checked.select("a", "wb")).union(checked.select("b", "wa"))
    return counts, found.filter("kind = 1").select("a", "b").union(checked.select("a", "b"))


def near_duplicates(df: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
                    block_dims: int = BLOCK_DIMS, chunk: int = CHUNK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``df``; other columns are ignored.

    Links are all pairs of different rows with cosine >= ``cosine``, whatever
    else the rows hold.  Null, zero and not wholly finite vectors, rows without
    an id and an empty table's rows link with nothing.  Equal vectors are one
    class from the start, counted by its size, so copies cost nothing.  An id
    that repeats with another vector is one node.  Vectors of different lengths
    have no cosine and never link; each length is joined by itself.  Tiles have
    about ``chunk`` rows at most; every pair of tiles is compared by itself.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie in (0, 1]")
    rows = vectors(df, vec_id, embedding)
    good = rows.filter("v is not null and vec_id is not null")
    classes = stored(good.groupBy("v").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("w")), "vector-classes")
    lengths = [r[0] for r in classes.select(F.size("v")).distinct().collect()]       # lengths of vectors are few
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts, edges = None, None
    for dims in lengths:
        n, e = _links(classes.filter(F.size("v") == dims), dims, cosine, block_dims, chunk)
        # an id with several vectors has its counts added under the vector's length
        n = n.groupBy("cid").agg(F.sum("n").alias("n")).withColumn("dims", F.lit(dims))
        counts, edges = (n, e) if counts is None else (counts.union(n), edges.union(e))
    comp = components(edges).withColumnRenamed("node", "cid")
    named = (classes.withColumn("dims", F.size("v")).join(counts, ["cid", "dims"], "left").join(comp, "cid", "left")
             .select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id")))
    hit = good.join(named, "v").select("vec_id", "n_links", "component_id")
    rest = rows.filter("v is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return hit.union(rest).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))

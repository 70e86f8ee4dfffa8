"""Ordered work over a series that may be far too long for one task.

A plain ``Window.partitionBy(symbol)`` sends a whole symbol to one task. When
one symbol holds a third of all rows that task never ends, so every ordered
operator of this package goes through :func:`framed` instead:

1. a pre-aggregate counts rows per (key, time bucket); map-side combined, it
   ships one row per bucket;
2. a running sum over that small table numbers the buckets and cuts each
   series into blocks of about ``block_rows`` rows;
3. rows join their bucket, buckets that reach into the last ``lookback`` rows
   before a block are also sent to that block as halo rows, and all windows
   run over (key, block).

The result equals the unblocked window exactly: each body row sees at least
``lookback`` predecessors, its global position ``_rn`` and, for unbounded
running aggregates, the carry of everything before its block. Only forward
dependencies exist; an operator that looks ahead by h rows is written as one
that emits the row h later with ``lag``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BLOCK_ROWS = 131_072
GROUP_LIMIT = 1_000             # spark.sql.optimizer.windowGroupLimitThreshold
HELPERS = ("_bkt", "_blk", "_halo", "_rn", "_n", "_base")


@dataclass(frozen=True)
class Series:
    """How a table is keyed and ordered. ``bucket()`` must be monotone in the order.

    It is a function because columns can only be made once a session runs.
    """

    key: tuple[str, ...]
    order: tuple[str, ...]
    bucket: Callable[[], Column]

    def with_key(self, *extra: str) -> "Series":
        return Series(self.key + extra, self.order, self.bucket)


def time_series(key, order=("ts",), bucket_seconds: int = 3600) -> Series:
    return Series(tuple(key), tuple(order), lambda: F.floor(
        F.unix_micros(F.col(order[0]).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)))


def value_bucket(x: Column) -> Column:
    """Monotone integer of a double, for ranking by value in blocks: 4,096 buckets per doubling.

    Values within one per cent still spread over 59 buckets, and a key has a few hundred thousand at most.
    """
    mag = F.floor(F.log2(F.abs(x) + F.lit(1e-12)) * 4096).cast("long") + F.lit(262_144)
    return F.when(x > 0, mag).when(x < 0, -mag).otherwise(F.lit(0))


def value_series(key, value: str, ties=()) -> Series:
    return Series(tuple(key), (value, *ties), lambda: value_bucket(F.col(value)))


@dataclass(frozen=True, eq=False)
class Recurrence:
    """``y_t = decay * y_(t-1) + b_t``; null ``b`` adds nothing, ``y`` is null before row ``first``."""

    name: str
    b: Column
    decay: float
    first: int = 1


@dataclass(frozen=True)
class Frame:
    """Rows laid out in blocks, with the window that belongs to them."""

    df: DataFrame
    series: Series
    carries: tuple[tuple[str, str], ...]

    @property
    def parts(self) -> tuple[str, ...]:
        return (*self.series.key, "_blk")

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy("_rn")

    def rows(self, lo: int, hi: int = 0) -> WindowSpec:
        return self.w.rowsBetween(lo, hi)

    def with_columns(self, **cols: Column) -> "Frame":
        """Add columns in one projection, so windows of one spec share one operator."""
        return Frame(self.df.withColumns(cols), self.series, self.carries)

    def drop(self, *names: str) -> "Frame":
        return Frame(self.df.drop(*names), self.series, self.carries)

    def running(self, name: str, kind: str, expr: Column, inclusive: bool = True) -> Column:
        """Running aggregate from the start of the series (``name`` was carried)."""
        span = self.w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        own = F.when(~F.col("_halo"), expr)
        carry = F.col(f"_c_{name}")
        if kind == "sum":
            return F.coalesce(carry, F.lit(0)) + F.coalesce(F.sum(own).over(span), F.lit(0))
        if kind == "max":
            return F.greatest(carry, F.max(own).over(span))
        if kind == "min":
            return F.least(carry, F.min(own).over(span))
        if kind == "last":
            return F.coalesce(F.last(own, ignorenulls=True).over(span), carry)
        raise ValueError(kind)

    def recur(self, *recs: "Recurrence") -> "Frame":
        """Solve ``y_t = decay * y_(t-1) + b_t`` for many recurrences with two windows in all.

        A scaled prefix sum restarts every ``span`` rows, where the slowest decay
        has fallen below 1e-18, so powers stay in range and only the previous
        restart still matters. The frame needs a lookback of ``2 * span`` rows.
        """
        if not recs:
            return self
        span = max(ewm_span(r.decay) for r in recs)
        if max(-math.log(r.decay) for r in recs) * span > 600:
            slow = [r for r in recs if -math.log(r.decay) * span <= 600]
            return self.recur(*slow).recur(*[r for r in recs if r not in slow])
        pos = (F.col("_rn") - 1) % span
        sub = Window.partitionBy(*self.parts, "_sub").orderBy("_rn").rowsBetween(
            Window.unboundedPreceding, 0)
        past = self.w.rowsBetween(Window.unboundedPreceding, -1)
        df = self.df.withColumns({"_sub": F.floor((F.col("_rn") - 1) / span),
                                  **{f"_b_{r.name}": r.b for r in recs}})
        df = df.withColumns({
            f"_l_{r.name}": F.pow(F.lit(r.decay), pos) * F.coalesce(
                F.sum(F.col(f"_b_{r.name}") * F.pow(F.lit(r.decay), -pos)).over(sub), F.lit(0.0)) for r in recs})
        last = {r.name: F.last(F.when(pos == span - 1, F.col(f"_l_{r.name}")), ignorenulls=True).over(past) for r in recs}
        df = df.withColumns({
            r.name: F.when(F.col("_rn") >= r.first, F.col(f"_l_{r.name}") + F.pow(F.lit(r.decay), pos + 1)
                           * F.coalesce(last[r.name], F.lit(0.0))) for r in recs})
        df = df.drop("_sub", *[f"_{x}_{r.name}" for x in "bl" for r in recs])
        return Frame(df, self.series, self.carries)

    def body(self, keep_rn: bool = False) -> DataFrame:
        """Drop halo rows and helper columns."""
        drop = [c for c in HELPERS if not (keep_rn and c in ("_rn", "_n"))]
        drop += [f"_c_{n}" for n, _ in self.carries]
        return self.df.filter(~F.col("_halo")).drop(*drop)


def ewm_span(decay: float) -> int:
    return max(2, math.ceil(42.0 / -math.log(decay)))


def ema_lookback(*periods: int) -> int:
    """Halo rows an EMA chain of these periods needs."""
    return sum(2 * ewm_span((p - 1) / (p + 1)) + p for p in periods)


def wilder_lookback(period: int) -> int:
    return 2 * ewm_span((period - 1) / period) + period + 1


def framed(df: DataFrame, series: Series, lookback: int = 0,
           carry: dict[str, tuple[str, Column]] | None = None,
           block_rows: int | None = None) -> Frame:
    carry = carry or {}
    size = max(block_rows or BLOCK_ROWS, lookback, 1)
    key = list(series.key)
    src = df.withColumn("_bkt", series.bucket())
    order = F.struct(*series.order)

    def bucket_agg(kind: str, expr: Column) -> Column:
        if kind == "last":
            return F.max_by(expr, F.when(expr.isNotNull(), order))
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](expr)

    counts = src.groupBy(*key, "_bkt").agg(
        F.count(F.lit(1)).alias("_cnt"),
        *[bucket_agg(kind, expr).alias(f"_m_{name}") for name, (kind, expr) in carry.items()])
    by_key = Window.partitionBy(*key)
    past = by_key.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    prefix = {"sum": F.sum, "max": F.max, "min": F.min,
              "last": lambda c: F.last(c, ignorenulls=True)}
    counts = counts.select(
        *key, "_bkt", "_cnt",
        F.coalesce(F.sum("_cnt").over(past), F.lit(0)).alias("_start"),
        F.sum("_cnt").over(by_key).alias("_n"),
        *[prefix[kind](F.col(f"_m_{name}")).over(past).alias(f"_c_{name}")
          for name, (kind, _) in carry.items()])
    own = F.floor(F.col("_start") / size)
    end = F.col("_start") + F.col("_cnt")
    if lookback:
        targets = F.array_distinct(F.concat(F.array(own), F.sequence(
            F.floor(end / size), F.floor((end + (lookback - 1)) / size))))
    else:
        targets = F.array(own)
    counts = counts.withColumn("_own", own).withColumn("_blk", F.explode(targets))
    in_block = Window.partitionBy(*key, "_blk")
    halo = F.col("_blk") != F.col("_own")
    layout = counts.select(
        *key, "_bkt", "_blk", "_n", halo.alias("_halo"),
        F.min("_start").over(in_block).alias("_base"),
        *[F.min_by(f"_c_{name}", F.when(~halo, F.col("_bkt"))).over(in_block).alias(f"_c_{name}")
          for name in carry])
    laid = src.join(layout, [*key, "_bkt"])
    place = Window.partitionBy(*key, "_blk").orderBy(*series.order)
    laid = laid.withColumn("_rn", F.col("_base") + F.row_number().over(place))
    return Frame(laid, series, tuple((n, k) for n, (k, _) in carry.items()))


def recent_buckets(df: DataFrame, series: Series, n: int) -> DataFrame:
    """Rows of the newest buckets that hold the last ``n`` rows of each key (at most one bucket more)."""
    key = list(series.key)
    src = df.withColumn("_bkt", series.bucket())
    newer = Window.partitionBy(*key).orderBy(F.col("_bkt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = (src.groupBy(*key, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
             .withColumn("_after", F.coalesce(F.sum("_c").over(newer), F.lit(0))).filter(F.col("_after") < n).select(*key, "_bkt"))
    return src.join(reach, [*key, "_bkt"], "left_semi").drop("_bkt")


def tail(df: DataFrame, series: Series, n: int) -> Frame:
    """The last ``n`` rows per key as one block each (bounded by n, so a plain window is safe).

    Older rows go before they are ordered: up to ``GROUP_LIMIT`` rows Spark trims
    ``row_number <= n`` in each map task; above it, row counts per bucket show
    which buckets reach the last n rows. ``_rn`` counts from the first kept row,
    ``_n`` is the number of kept rows.
    """
    if n > GROUP_LIMIT:
        df = recent_buckets(df, series, n)
    latest = Window.partitionBy(*series.key).orderBy(*[F.col(c).desc() for c in series.order])
    kept = (df.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= n))
    kept = (kept.withColumn("_n", F.max("_back").over(Window.partitionBy(*series.key)))
            .withColumn("_rn", F.col("_n") - F.col("_back") + 1).drop("_back")
            .withColumn("_blk", F.lit(0)).withColumn("_halo", F.lit(False)))
    return Frame(kept, series, ())


def islands(df: DataFrame, series: Series, flag: str, block_rows: int | None = None) -> DataFrame:
    """Runs of equal ``flag``: adds ``run_id`` (1-based per key) and ``run_rn`` helpers."""
    fr = framed(df, series, lookback=1, block_rows=block_rows)
    prev = F.lag(flag).over(fr.w)
    starts = fr.with_columns(
        _new=F.when(prev.isNull() | (prev != F.col(flag)), F.lit(1)).otherwise(F.lit(0))
    ).body()
    fr2 = framed(starts, series, carry={"run": ("sum", F.col("_new"))}, block_rows=block_rows)
    return fr2.with_columns(run_id=fr2.running("run", "sum", F.col("_new"))).body().drop("_new")

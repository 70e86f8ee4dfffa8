"""Joins and alignment: aligned panels, pair moments, rolling pairs, profiles, as-of joins.

Pair statistics never emit one row per pair and timestamp. Rows of one timestamp
are brought together, each task multiplies dense blocks, and only the moments of
each pair leave the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import half_up, safe_div
from ..plans.blocks import Series, framed, time_series
from ..plans.lineage import cut
from ..plans.rank import with_row
from ..sources.views import BAR_SERIES

TS_SERIES = time_series(("_all",), ("ts",), bucket_seconds=86_400)


def common_ts(df: DataFrame, ts: str = "ts", symbol: str = "symbol", symbols: list[str] | None = None) -> DataFrame:
    """Rows at the timestamps where every symbol has a row: those asked for, or all of the table.

    One late listing empties the result over a whole table, so name the ``symbols`` of a portfolio.
    """
    if symbols is not None:
        df = df.filter(F.col(symbol).isin(symbols))
    n = df.agg(F.count_distinct(symbol).alias("_k"))
    ok = with_row(df.groupBy(ts).agg(F.count_distinct(symbol).alias("_h")), n).filter("_h = _k").select(ts)
    return df.join(ok, ts, "left_semi")


def pivot_align(bars: DataFrame, symbols: list[str] | None = None, value: str = "close") -> DataFrame:
    """Wide panel, one column per symbol, complete timestamps only (long rows when symbols is None)."""
    if symbols is None:
        return common_ts(bars.filter(F.col(value).isNotNull()))
    wide = bars.filter(F.col("symbol").isin(symbols)).groupBy("ts").pivot("symbol", symbols).agg(F.max(value))
    return wide.dropna()


TILE_SYMBOLS = 1_024            # symbols on each side of a tile: six matrices of 8 MB in a task
TILE_ROWS = 4_000_000           # rows a task brings together for one tile


def tile_plan(n_symbols: int, n_rows: int, parts: int, side: int = TILE_SYMBOLS) -> tuple[int, int]:
    """Symbol groups and timestamp chunks: groups of about ``side`` symbols, chunks of about ``TILE_ROWS`` rows of a tile.

    Each pair of groups is a tile.  Few tiles are cut in more chunks, so that all ``parts`` tasks have work.
    """
    groups = max(1, -(-n_symbols // side))
    rows = n_rows * (2 if groups > 1 else 1) // groups
    return groups, max(1, -(-rows // TILE_ROWS), -(-parts // (groups * (groups + 1) // 2)))


def tiled(df: DataFrame, groups: int, symbol: str = "s") -> DataFrame:
    """``df`` with the group ``g`` of its symbol, once for each tile ``p`` = lesser group * groups + greater group."""
    df = df.withColumn("g", F.pmod(F.xxhash64(symbol), F.lit(groups)))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return df.withColumn("p", F.least("g", "_o") * groups + F.greatest("g", "_o")).drop("_o")


class Tile:
    """Moments of the pairs between the symbols of two groups (or within one), added up from dense blocks of rows."""

    def __init__(self, same: bool):
        self.same, self.left, self.right = same, {}, {}
        self.sums = [np.zeros((0, 0)) for _ in range(6)]

    @staticmethod
    def dense(index: dict, s: np.ndarray, t: np.ndarray, v: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(s, return_inverse=True)
        for name in names:
            index.setdefault(name, len(index))
        x = np.full((height, len(index)), np.nan)
        x[t, np.array([index[n] for n in names], int)[at]] = v      # of equal (symbol, ts), the last
        there = ~np.isnan(x)
        return np.where(there, x, 0.0), there.astype(float)

    def add(self, s: np.ndarray, t: np.ndarray, v: np.ndarray, in_left: np.ndarray) -> None:
        stamps, at = np.unique(t, return_inverse=True)
        for lo in range(0, len(stamps), 4096):
            here = (at >= lo) & (at < lo + 4096)
            height = min(4096, len(stamps) - lo)
            pick = here & in_left
            x, m = self.dense(self.left, s[pick], at[pick] - lo, v[pick], height)
            y, k = x, m
            if not self.same:
                pick = here & ~in_left
                y, k = self.dense(self.right, s[pick], at[pick] - lo, v[pick], height)
            shape = (x.shape[1], y.shape[1])
            for i, prod in enumerate((m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y)):
                old = self.sums[i]
                if old.shape != shape:
                    old = np.pad(old, ((0, shape[0] - old.shape[0]), (0, shape[1] - old.shape[1])))
                self.sums[i] = old + prod

    def rows(self):
        """Frames ``a, b, n, sa, sb, saa, sbb, sab`` with a <= b, some left symbols at a time."""
        left = np.array(list(self.left), dtype=object)
        right = left if self.same else np.array(list(self.right), dtype=object)
        step = max(1, 200_000 // max(1, len(right)))
        for lo in range(0, len(left), step):
            n = self.sums[0][lo:lo + step]
            i, j = np.nonzero(n > 0)
            a, b = left[lo + i], right[j]
            turn = a > b
            if self.same:
                i, j, a, b = i[~turn], j[~turn], a[~turn], b[~turn]
                turn = np.zeros(len(a), bool)
            _, sx, sy, sxx, syy, sxy = (m[lo + i, j] for m in self.sums)
            yield pd.DataFrame({"a": np.where(turn, b, a), "b": np.where(turn, a, b), "n": n[i, j].astype("int64"),
                                "sa": np.where(turn, sy, sx), "sb": np.where(turn, sx, sy), "saa": np.where(turn, syy, sxx),
                                "sbb": np.where(turn, sxx, syy), "sab": sxy})


def tile_moments(batches, groups: int):
    """Moments of all pairs of the tiles in rows (s, t, v, g, p, c) sorted by tile, chunk and timestamp; one tile is held at a time."""
    tile, at, carry = None, None, None

    def add(pdf: pd.DataFrame) -> None:
        tile.add(pdf["s"].to_numpy(), pdf["t"].to_numpy(), pdf["v"].to_numpy(), (pdf["g"] == at[0] // groups).to_numpy())

    for pdf in batches:
        for key, part in pdf.groupby(["p", "c"], sort=False):
            if key != at:
                if tile is not None:
                    add(carry)
                    yield from tile.rows()
                tile, at, carry = Tile(key[0] // groups == key[0] % groups), key, part
                continue
            part = pd.concat([carry, part])
            unfinished = (part["t"] == part["t"].iloc[-1]).to_numpy()      # the next batch may go on with this timestamp
            carry = part[unfinished]
            if not unfinished.all():
                add(part[~unfinished])
    if tile is not None:
        add(carry)
        yield from tile.rows()


def pair_moments(df: DataFrame, value: str = "ret", symbol: str = "symbol", ts: str = "ts",
                 blocks: int | None = None) -> DataFrame:
    """Counts and power sums of every symbol pair a <= b over their common timestamps.

    Symbols are split in groups (``blocks`` of them, by default as many as keep
    a task's matrices at ``TILE_SYMBOLS`` squared); a task turns the rows of two
    groups into dense blocks of timestamps x symbols, one tile at a time, and
    adds their Gram products.  Only moments per pair leave it.  Of several rows
    of one symbol and timestamp the greatest value counts.
    """
    src = df.select(F.col(symbol).alias("s"), F.col(ts).alias("t"), F.col(value).cast("double").alias("v")) \
        .filter(F.col("v").isNotNull() & F.col("s").isNotNull() & F.col("t").isNotNull())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if blocks is None:
        size = src.agg(F.count_distinct("s").alias("k"), F.count(F.lit(1)).alias("n")).first()
        groups, chunks = tile_plan(size.k, size.n, parts)
    else:
        groups, chunks = blocks, max(1, -(-parts // (blocks * (blocks + 1) // 2)))
    src = tiled(src, groups).withColumn("c", F.pmod(F.xxhash64("t"), F.lit(chunks)))
    src = src.repartition("p", "c").sortWithinPartitions("p", "c", "t", "s", "v")
    out = src.select("s", "t", "v", "g", "p", "c").mapInPandas(
        lambda batches: tile_moments(batches, groups),
        "a string, b string, n long, sa double, sb double, saa double, sbb double, sab double")
    return out.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def corr_of(n="n", sa="sa", sb="sb", saa="saa", sbb="sbb", sab="sab") -> Column:
    n, sa, sb, saa, sbb, sab = (F.col(c) if isinstance(c, str) else c for c in (n, sa, sb, saa, sbb, sab))
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    return F.when((va <= 0) | (vb <= 0), 0.0).otherwise((sab - sa * sb / n) / F.sqrt(va * vb))


def covar_of() -> Column:
    return (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1)


def pairwise_correlations(rets: DataFrame, min_correlation: float = 0.0, blocks: int | None = None) -> DataFrame:
    """All pairs a < b with |corr| at least the threshold, strongest first."""
    m = pair_moments(rets, blocks=blocks).filter("a < b")
    c = m.select("a", "b", "n", corr_of().alias("corr"))
    return c.filter(F.abs("corr") >= abs(min_correlation)).orderBy(F.abs("corr").desc(), "a", "b")


def correlation_matrix(rets: DataFrame, blocks: int | None = None) -> DataFrame:
    """Both triangles and a unit diagonal in long form."""
    m = pair_moments(rets, blocks=blocks).withColumn(
        "corr", F.when(F.col("a") == F.col("b"), 1.0).otherwise(corr_of()))
    other = m.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr", "n")
    return m.select("a", "b", "corr", "n").unionByName(other)


ROLLING_SYMBOLS = 256           # symbols on each side of a rolling tile


class RollingTile:
    """Co-moments of the last ``window`` rows of a tile: entering rows are added, leaving rows taken off, a window at a time."""

    def __init__(self, window: int, step: int, same: bool):
        self.window, self.step, self.same = window, step, same
        self.new, self.held, self.left, self.right = [], [], None, None

    def row(self, s: np.ndarray, v: np.ndarray, in_left: np.ndarray) -> None:
        if self.left is None:
            self.left, self.right = s[in_left], s[in_left] if self.same else s[~in_left]
            a, b = len(self.left), len(self.right)
            self.sums = [np.zeros(a), np.zeros(b), np.zeros(a), np.zeros(b), np.zeros((a, b))]
        x = v[in_left]
        self.new.append((x, x if self.same else v[~in_left]))

    def _book(self, rows: list, sign: int) -> None:
        if rows:
            x, y = (np.array(side) for side in zip(*rows))
            for total, part in zip(self.sums, (x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0), x.T @ y)):
                total += sign * part

    def correlations(self) -> pd.DataFrame:
        """Correlations of the pairs a < b over the last ``window`` rows; 0 where one side does not move."""
        if len(self.new) >= self.window:
            self.held, self.new = self.new[-self.window:], []
            for total in self.sums:
                total[...] = 0
            self._book(self.held, 1)
        else:
            gone, self.held = self.held[:len(self.new)], self.held[len(self.new):] + self.new
            self._book(self.new, 1)
            self._book(gone, -1)
            self.new = []
        n = len(self.held)
        sx, sy, sxx, syy, sxy = self.sums
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        vx, vy = np.where(vx > 1e-12 * sxx, vx, 0), np.where(vy > 1e-12 * syy, vy, 0)
        scale = np.sqrt(np.outer(vx, vy))
        c = np.divide(sxy - np.outer(sx, sy) / n, scale, out=np.zeros_like(sxy), where=scale > 0)
        a, b = np.repeat(self.left, len(self.right)), np.tile(self.right, len(self.left))
        if self.same:
            keep = a < b
            return pd.DataFrame({"a": a[keep], "b": b[keep], "corr": c.ravel()[keep]})
        turn = a > b
        return pd.DataFrame({"a": np.where(turn, b, a), "b": np.where(turn, a, b), "corr": c.ravel()})


def rolling_tiles(batches, groups: int, window: int, step: int):
    """Windows of every tile in rows (s, t, v, g, p, _blk, _halo, _rn) sorted by block, tile and row number."""
    tile, at, carry = None, None, None

    def finish(pdf: pd.DataFrame):
        nonlocal tile, at
        for (block, p, rn), part in pdf.groupby(["_blk", "p", "_rn"], sort=False):
            if (block, p) != at:
                tile, at = RollingTile(window, step, p // groups == p % groups), (block, p)
            tile.row(part["s"].to_numpy(), part["v"].to_numpy(), (part["g"] == p // groups).to_numpy())
            if not part["_halo"].iloc[0] and rn >= window and (rn - window) % step == 0:
                yield tile.correlations().assign(ts=part["t"].iloc[0])

    for pdf in batches:
        pdf = pdf if carry is None else pd.concat([carry, pdf])
        last = pdf.iloc[-1]
        unfinished = ((pdf["_rn"] == last["_rn"]) & (pdf["p"] == last["p"]) & (pdf["_blk"] == last["_blk"])).to_numpy()
        carry = pdf[unfinished]
        yield from finish(pdf[~unfinished])
    if carry is not None:
        yield from finish(carry)


def rolling_correlation_matrix(bars: DataFrame, window: int = 30, step: int = 10, block_rows: int = 4096,
                               symbols: list[str] | None = None, side: int = ROLLING_SYMBOLS) -> DataFrame:
    """Correlation of every pair a < b of ``symbols`` (all by default) over ``window`` aligned rows, every ``step`` rows.

    The aligned panel is cut in runs of timestamps with a halo and in tiles of
    two groups of about ``side`` symbols.  A task walks one run of one tile,
    keeps ``window`` rows and their co-moments, and gives out one window at a
    time, so no task holds all symbols or all windows.  Of several rows of one
    symbol and timestamp the greatest close counts.
    """
    aligned = common_ts(bars.groupBy("symbol", "ts").agg(F.max("close").alias("close")), symbols=symbols)
    r = framed(aligned, time_series(("symbol",), ("ts",), 365 * 86_400), lookback=1)
    prev = F.lag("close").over(r.w)
    r = cut(r.with_columns(v=F.when(prev == 0, 0.0).otherwise(F.col("close") / prev - 1)).body()
            .filter("v is not null").select(F.col("symbol").alias("s"), "ts", "v"))
    groups = max(1, -(-r.agg(F.count_distinct("s")).first()[0] // side))
    stamps = r.select("ts").distinct().withColumn("_all", F.lit(0))
    pos = framed(stamps, TS_SERIES, lookback=window, block_rows=block_rows).df.select("ts", "_blk", "_halo", "_rn")
    laid = tiled(r.join(pos, "ts"), groups).withColumnRenamed("ts", "t")
    laid = laid.repartition("_blk", "p").sortWithinPartitions("_blk", "p", "_rn", "s")
    out = laid.select("s", "t", "v", "g", "p", "_blk", "_halo", "_rn").mapInPandas(
        lambda batches: rolling_tiles(batches, groups, window, step), "a string, b string, corr double, ts timestamp")
    return out.select("ts", "a", "b", "corr")


def rolling_beta(bars: DataFrame, benchmark: DataFrame, window: int = 30, series: Series = BAR_SERIES) -> DataFrame:
    """Rolling beta (1 on zero variance), alpha and R2 of returns on the rows both series have."""
    j = bars.join(benchmark.select("ts", F.col("close").alias("bench_close")), "ts")
    fr = framed(j, series, lookback=window + 1)
    pa, pb = F.lag("close").over(fr.w), F.lag("bench_close").over(fr.w)
    fr = fr.with_columns(ra=F.when(pa != 0, F.col("close") / pa - 1), rb=F.when(pb != 0, F.col("bench_close") / pb - 1))
    w = fr.rows(-(window - 1))
    fr = fr.with_columns(_v=F.var_samp("rb").over(w), _s=F.regr_slope("ra", "rb").over(w),
                         _ma=F.avg("ra").over(w), _mb=F.avg("rb").over(w), _r2=F.regr_r2("ra", "rb").over(w))
    fr = fr.with_columns(beta=F.when(F.coalesce("_v", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_s")))
    out = fr.with_columns(alpha=F.col("_ma") - F.col("beta") * F.col("_mb"),
                          r_squared=F.greatest(F.coalesce("_r2", F.lit(0.0)), F.lit(0.0)),
                          _ok=F.col("_rn") > window).body()
    return out.filter("_ok").drop("_ok", "_v", "_s", "_ma", "_mb", "_r2")


def correlation_regime(pairs: DataFrame, series: Series, window: int = 20, max_samples: int = 50) -> DataFrame:
    """Rolling correlation of ``a`` and ``b`` changes: last value, mean, sign flips and regime."""
    fr = framed(pairs, series, lookback=window + 2)
    pa, pb = F.lag("a").over(fr.w), F.lag("b").over(fr.w)
    fr = fr.with_columns(_ra=F.when(pa.isNotNull(), F.when(pa == 0, 0.0).otherwise(F.col("a") / pa - 1)),
                         _rb=F.when(pb.isNotNull(), F.when(pb == 0, 0.0).otherwise(F.col("b") / pb - 1)))
    c = F.coalesce(F.corr("_ra", "_rb").over(fr.rows(-(window - 1))), F.lit(0.0))
    fr = fr.with_columns(corr=F.when(F.col("_rn") > window, half_up(c, 2)))
    prev = F.lag("corr").over(fr.w)
    fr = fr.with_columns(flip=F.when(((prev >= 0) & (F.col("corr") < 0)) | ((prev < 0) & (F.col("corr") >= 0)), 1)
                         .otherwise(0))
    rows = fr.body(keep_rn=True).filter("corr is not null")
    o = F.struct(*series.order)
    g = rows.groupBy(*series.key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("corr").alias("avg_corr"), F.min("corr").alias("min_corr"),
        F.max("corr").alias("max_corr"), F.sum("flip").alias("flips"), F.max_by("corr", o).alias("corr"))
    k = F.col("corr")
    return g.withColumn("regime", F.when(k > 0.7, "strongly_correlated").when(k > 0.3, "moderately_correlated")
                        .when(k >= -0.3, "uncorrelated").otherwise("negatively_correlated"))


def correlation_samples(pairs: DataFrame, series: Series, window: int, max_samples: int = 50) -> DataFrame:
    """Thinned rolling correlations, at most ``max_samples`` per pair."""
    from .returns import downsample_series

    fr = framed(pairs, series, lookback=window)
    c = fr.with_columns(corr=F.when(F.col("_rn") >= window, half_up(F.corr("a", "b").over(fr.rows(-(window - 1))), 2)))
    return downsample_series(c.body().filter("corr is not null"), max_samples, series)


def cross_symbol_stats(bars: DataFrame, periods: int = 365, series: Series = BAR_SERIES) -> DataFrame:
    """Per symbol, in percent rounded to 2 dp: total and mean return, vol, Sharpe, Sortino, drawdown."""
    from .returns import returns_series
    from .stats import benchmark_return, max_drawdown, series_stats

    key = list(series.key)
    s = series_stats(returns_series(bars, series), key, rf=0.0, periods=periods)
    t = benchmark_return(bars, series)
    d = max_drawdown(bars, "close", series).select(*key, "max_drawdown")
    j = s.join(t, key).join(d, key)
    pct = lambda c: half_up(F.col(c) * 100, 2)
    return j.select(*key, "n_obs", pct("total_return").alias("total_return_pct"), pct("mean").alias("mean_pct"),
                    pct("annualized_vol").alias("vol_pct"), half_up(F.col("sharpe"), 2).alias("sharpe"),
                    half_up(F.col("sortino"), 2).alias("sortino"), pct("max_drawdown").alias("max_drawdown_pct"))


def correlation_clusters(rets: DataFrame, threshold: float = 0.8, blocks: int | None = None) -> DataFrame:
    """One row: pairs above the threshold, mean off-diagonal correlation, risk score and status."""
    c = pair_moments(rets, blocks=blocks).filter("a < b").withColumn("corr", corr_of())
    g = c.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("corr").alias("avg_corr"),
              F.sum(F.when(F.abs("corr") >= threshold, 1).otherwise(0)).alias("n_high"))
    score = F.when(F.col("n_pairs") == 0, 0.0).otherwise(
        F.least(F.lit(100.0), half_up(F.col("n_high") * 100 / F.col("n_pairs"), 0)))
    return g.withColumn("risk_score", score).withColumn(
        "status", F.when(score > 60, "HIGH_RISK").when(score > 30, "MODERATE").otherwise("DIVERSIFIED"))


def lead_lag(panel: DataFrame, max_lag: int = 10, venue: str = "venue") -> DataFrame:
    """Level correlation and best lag of every venue pair of one symbol, common ts only.

    ``lag`` > 0 means b follows a by that many rows; the leader is the one that moves first.
    Shifted copies meet by equi join on the row number.
    """
    aligned = panel.select("symbol", venue, "ts", "price")
    n_v = aligned.groupBy("symbol").agg(F.count_distinct(venue).alias("_k"))
    full_ts = aligned.groupBy("symbol", "ts").agg(F.count_distinct(venue).alias("_h")).join(n_v, "symbol") \
        .filter("_h = _k").select("symbol", "ts")
    fr = framed(full_ts, time_series(("symbol",), ("ts",), 7 * 86_400))
    pos = fr.body(keep_rn=True).select("symbol", "ts", F.col("_rn").alias("rn"), F.col("_n").alias("n"))
    rows = aligned.join(pos, ["symbol", "ts"])
    lim = F.least(F.lit(max_lag), F.floor(F.col("n") / 4)).cast("int")
    shifted = rows.withColumn("lag", F.explode(F.sequence(-lim, lim)))
    # row r of a meets row r + lag of b
    a = shifted.select("symbol", F.col(venue).alias("a"), (F.col("rn") + F.col("lag")).alias("rn"), "lag",
                       F.col("price").alias("pa"))
    b = rows.select("symbol", F.col(venue).alias("b"), "rn", F.col("price").alias("pb"))
    c = a.join(b, ["symbol", "rn"]).filter("a < b").groupBy("symbol", "a", "b", "lag").agg(
        F.coalesce(F.corr("pa", "pb"), F.lit(0.0)).alias("corr"))
    best = c.groupBy("symbol", "a", "b").agg(
        F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("corr"),
        F.max_by("lag", F.struct(F.round(F.abs("corr"), 9), -F.abs("lag"), "lag")).alias("lag"))
    return best.withColumn("leader", F.when(F.col("lag") >= 0, F.col("a")).otherwise(F.col("b")))


def price_discovery(ll: DataFrame) -> DataFrame:
    """Venue with most leads per symbol."""
    g = ll.groupBy("symbol", "leader").agg(F.count(F.lit(1)).alias("leads"))
    return g.groupBy("symbol").agg(F.max_by("leader", F.struct("leads", "leader")).alias("leader"),
                                   F.max("leads").alias("leads"))


def volume_profile(bars: DataFrame, bins: int = 24, strict: bool = False, key=("symbol",)) -> DataFrame:
    """Volume by price bin, spread by overlap; flags the point of control and the 70 % value area."""
    key = list(key)
    lim = bars.groupBy(*key).agg(F.min("low").alias("lo"), F.max("high").alias("hi"), F.count(F.lit(1)).alias("_c"))
    src = bars.select(*key, "low", "high", "volume").join(lim.filter("_c >= 10"), key)
    size = (F.col("hi") - F.col("lo")) / bins
    src = src.withColumn("sz", size).filter("sz > 0")
    bin_of = lambda p: F.least(F.floor((p - F.col("lo")) / F.col("sz")), F.lit(bins - 1))
    e = src.withColumn("bin", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high")))))
    left, right = F.col("lo") + F.col("bin") * F.col("sz"), F.col("lo") + (F.col("bin") + 1) * F.col("sz")
    rng = F.col("high") - F.col("low")
    overlap = F.greatest(F.least(F.col("high"), right) - F.greatest(F.col("low"), left), F.lit(0.0))
    flat = F.lit(0.0) if strict else F.col("volume")
    e = e.withColumn("v", F.when(rng > 0, F.col("volume") * overlap / rng).otherwise(flat))
    got = e.groupBy(*key, "bin").agg(F.sum("v").alias("volume"))
    dense = lim.filter("_c >= 10").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    p = dense.join(got, [*key, "bin"], "left").withColumn("volume", half_up(F.coalesce("volume", F.lit(0.0)), 2))
    w = Window.partitionBy(*key)
    by_size = w.orderBy(F.col("volume").desc(), "bin")
    p = p.withColumn("price", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    p = p.withColumn("_r", F.row_number().over(by_size)).withColumn(
        "_before", F.coalesce(F.sum("volume").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    total = F.sum("volume").over(w)
    return p.withColumn("poc", F.col("_r") == 1).withColumn("value_area", F.col("_before") < 0.7 * total) \
        .select(*key, "bin", "price", "volume", "poc", "value_area")


def param_grid(spark, **values: list) -> DataFrame:
    """Cartesian product of parameter lists as a small table."""
    df = spark.range(1).drop("id")
    for name, vals in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vals])))
    return df


def asof_trades_quotes(trades: DataFrame, quotes: DataFrame, series: Series, values=("bid", "ask")) -> DataFrame:
    """Last quote at or before each trade, per key: union, then the last known quote carried forward."""
    key = list(series.key)
    order = list(series.order)
    extra = [c for c in trades.columns if c not in (*key, *order)]
    q = quotes.select(*key, *[F.col(c) if c in quotes.columns else F.lit(-1).cast(trades.schema[c].dataType).alias(c)
                              for c in order], *[F.lit(None).cast(trades.schema[c].dataType).alias(c) for c in extra],
                      F.struct(*values).alias("_q"), F.lit(0).alias("_kind"))
    t = trades.select(*key, *order, *extra,
                      F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), F.lit(1).alias("_kind"))
    both = q.unionByName(t)
    s = Series(series.key, (order[0], "_kind", *order[1:]), series.bucket)
    fr = framed(both, s, carry={"q": ("last", F.col("_q"))})
    rows = fr.with_columns(_last=fr.running("q", "last", F.col("_q"))).body().filter("_kind = 1")
    return rows.select(*key, *order, *extra, *[F.col(f"_last.{v}").alias(v) for v in values])

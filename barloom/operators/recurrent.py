"""Recurrences: EMA family, Wilder smoothing, EWMA and GARCH variance, Kalman hedge, Hurst.

Linear ones are prefix sums inside blocks (:meth:`Frame.recur`); the Kalman filter
composes per-block maps, so no series is ever walked by one task from end to end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clamp, safe_div
from ..plans.blocks import (Frame, Recurrence, Series, ema_lookback, ewm_span, framed, tail, time_series,
                            wilder_lookback)
from ..plans.rank import linear_percentiles
from ..sources.views import BAR_SERIES
from .indicators import add_true_range, full


def ema_rec(fr: Frame, x: str, p: int, name: str, start: int = 1) -> Recurrence:
    """EMA seeded by the mean of the first p values (from position ``start``)."""
    first, rn = start + p - 1, F.col("_rn")
    b = F.when(rn == first, F.avg(x).over(fr.rows(-(p - 1)))).when(rn > first, F.col(x) * 2 / (p + 1))
    return Recurrence(name, b, (p - 1) / (p + 1), first)


def wilder_rec(fr: Frame, x: str, p: int, name: str, mean: bool) -> Recurrence:
    """Wilder average (or sum) of column ``x``, which starts at row 2, seeded by its first p values."""
    first, rn, win = p + 1, F.col("_rn"), fr.rows(-(p - 1))
    seed = F.avg(x).over(win) if mean else F.sum(x).over(win)
    b = F.when(rn == first, seed).when(rn > first, F.col(x) / p if mean else F.col(x))
    return Recurrence(name, b, (p - 1) / p, first)


def add_smoothed(fr: Frame, emas: dict[str, int] | None = None, macd: tuple[int, int, int] | None = None,
                 rsi: int | None = None, adx: int | None = None) -> Frame:
    """Any mix of EMAs of the close, MACD, RSI and ADX; all first-level recurrences share two windows."""
    w, pre, recs = fr.w, {}, []
    if rsi:
        chg = F.col("close") - F.lag("close").over(w)
        pre |= {"_up_chg": F.greatest(chg, F.when(chg.isNotNull(), 0.0)), "_dn_chg": F.greatest(-chg, F.when(chg.isNotNull(), 0.0))}
    if adx:
        fr = add_true_range(fr)
        up, dn = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
        pre |= {"_up": F.when(up > dn, F.greatest(up, F.lit(0.0))).when(up.isNotNull(), 0.0),
                "_dn": F.when(dn > up, F.greatest(dn, F.lit(0.0))).when(dn.isNotNull(), 0.0)}
    fr = fr.with_columns(**pre)
    recs += [ema_rec(fr, "close", p, name) for name, p in (emas or {}).items()]
    if macd:
        recs += [ema_rec(fr, "close", macd[0], "_fast"), ema_rec(fr, "close", macd[1], "_slow")]
    if rsi:
        recs += [wilder_rec(fr, "_up_chg", rsi, "_gain", True), wilder_rec(fr, "_dn_chg", rsi, "_loss", True)]
    if adx:
        recs += [wilder_rec(fr, src, adx, name, False) for src, name in (("tr", "_str"), ("_up", "_sup"), ("_dn", "_sdn"))]
    fr = fr.recur(*recs)
    post = {}
    if rsi:
        g, l = F.col("_gain"), F.col("_loss")
        # a loss average that has decayed to nothing is a zero loss
        post["rsi"] = F.when(l <= 0, 100.0).when(l > 0, 100 - 100 / (1 + g / l))
    if macd:
        post["macd"] = F.col("_fast") - F.col("_slow")
    if adx:
        post |= {"plus_di": safe_div(F.col("_sup") * 100, F.col("_str"), 0.0), "minus_di": safe_div(F.col("_sdn") * 100, F.col("_str"), 0.0)}
    fr = fr.with_columns(**post).drop("_up_chg", "_dn_chg", "_gain", "_loss", "_fast", "_slow", "_up", "_dn", "_str", "_sup", "_sdn")
    if adx:
        total = F.col("plus_di") + F.col("minus_di")
        fr = fr.with_columns(dx=safe_div(F.abs(F.col("plus_di") - F.col("minus_di")) * 100, total, 0.0))
        fr = fr.with_columns(adx=full(fr, F.avg("dx").over(fr.rows(-(adx - 1))), adx, start=adx + 1)).drop("tr")
    if macd:
        fr = fr.recur(ema_rec(fr, "macd", macd[2], "macd_signal", start=macd[1]))
        fr = fr.with_columns(macd_hist=F.col("macd") - F.col("macd_signal"))
    return fr


def ema(df: DataFrame, *periods: int, x: str = "close", series: Series = BAR_SERIES,
        block_rows: int | None = None) -> DataFrame:
    fr = framed(df, series, lookback=max(ema_lookback(p) for p in periods), block_rows=block_rows)
    return fr.recur(*[ema_rec(fr, x, p, f"ema_{p}") for p in periods]).body()


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, series: Series = BAR_SERIES,
         block_rows: int | None = None) -> DataFrame:
    fr = framed(bars, series, lookback=ema_lookback(slow, signal), block_rows=block_rows)
    return add_smoothed(fr, macd=(fast, slow, signal)).body()


def rsi(bars: DataFrame, p: int = 14, series: Series = BAR_SERIES, block_rows: int | None = None) -> DataFrame:
    return add_smoothed(framed(bars, series, lookback=wilder_lookback(p), block_rows=block_rows), rsi=p).body()


def adx(bars: DataFrame, p: int = 14, series: Series = BAR_SERIES, block_rows: int | None = None) -> DataFrame:
    """Directional indices and their smoothed strength; 0 instead of a zero division."""
    return add_smoothed(framed(bars, series, lookback=wilder_lookback(p) + p, block_rows=block_rows), adx=p).body()


def ewma_vol(rets: DataFrame, lam: float = 0.94, span: int | None = None, series: Series = BAR_SERIES,
             block_rows: int | None = None) -> DataFrame:
    """var = lam*var + (1-lam)*r^2, started from r0^2 before r0 itself is applied."""
    lam = 1 - 2 / (span + 1) if span else lam
    fr = framed(rets, series, lookback=2 * ewm_span(lam), block_rows=block_rows)
    r2 = F.col("ret") * F.col("ret")
    fr = fr.recur(Recurrence("_var", F.when(F.col("_rn") == 1, r2).otherwise((1 - lam) * r2), lam))
    return fr.with_columns(ewma_vol=F.sqrt("_var")).body().drop("_var")


def funding_predict(rates: DataFrame, series: Series, method: str = "ewma", lookback: int = 96,
                    half_life: float = 12.0, x: str = "rate") -> DataFrame:
    """Next rate from the last ``lookback`` rows with confidence and +-2 sd bounds."""
    t = tail(rates, series, lookback).df
    w = F.pow(F.lit(0.5), (F.col("_n") - F.col("_rn")) / half_life)
    key = list(series.key)
    mean, sd = F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0))
    point = F.sum(F.col(x) * w) / F.sum(w) if method == "ewma" else mean
    g = t.groupBy(*key).agg(point.alias("predicted"), mean.alias("_m"), sd.alias("_s"))
    if method == "median":
        med = linear_percentiles(t.select(*key, x), key, x, {"predicted": 0.5}).drop("n")
        g = g.drop("predicted").join(med, key)
    m, s = F.abs("_m"), F.col("_s")
    conf = F.when(m == 0, F.when(s == 0, 1.0).otherwise(0.0)).otherwise(clamp(1 - s / (m + s)))
    return g.select(*key, "predicted", conf.alias("confidence"), (F.col("predicted") + 2 * s).alias("upper"),
                    (F.col("predicted") - 2 * s).alias("lower"))


def garch11_fit(rets: DataFrame, steps: int = 20, series: Series = BAR_SERIES,
                block_rows: int | None = None) -> DataFrame:
    """Best (alpha, beta) of the grid by Gaussian likelihood with variance targeting, and the forecast.

    The likelihood of every grid point is summed per block in Arrow batches and
    then added up; a block starts ``2 * span`` rows early, where the largest beta
    of the grid has forgotten its start.
    """
    grid = [(a * 0.02, b * 0.04) for a in range(1, steps + 1) for b in range(1, steps + 1)
            if a * 0.02 + b * 0.04 < 1]
    alphas, betas = np.array([g[0] for g in grid]), np.array([g[1] for g in grid])
    span = ewm_span(float(betas.max()))
    key = list(series.key)
    unc = rets.groupBy(*key).agg(F.avg(F.col("ret") * F.col("ret")).alias("uv"), F.count("ret").alias("n_obs"))
    fr = framed(rets.select(*key, *series.order, "ret"), series, lookback=2 * span, block_rows=block_rows)
    fr = Frame(fr.df.join(unc, key), series, ())

    def likelihood(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        uv = float(pdf["uv"].iloc[0])
        omega = uv * (1 - alphas - betas)
        var, total = np.full(len(alphas), uv), np.zeros(len(alphas))
        for r2, halo in zip(np.square(pdf["ret"].to_numpy()), pdf["_halo"].to_numpy()):
            if not halo:
                total -= 0.5 * (np.log(2 * np.pi) + np.log(var) + r2 / var)
            var = omega + alphas * r2 + betas * var
        out = pd.DataFrame({"alpha": alphas, "beta": betas, "ll": total})
        for k in reversed(key):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    schema = T.StructType([rets.schema[k] for k in key] + [
        T.StructField(c, T.DoubleType()) for c in ("alpha", "beta", "ll")])
    part = fr.df.filter("uv > 0").groupBy(*fr.parts).applyInPandas(likelihood, schema)
    ll = part.groupBy(*key, "alpha", "beta").agg(F.sum("ll").alias("ll"))
    best = ll.groupBy(*key).agg(F.max_by(F.struct("alpha", "beta", "ll"), F.struct(
        F.round("ll", 9), -F.col("alpha"), -F.col("beta"))).alias("b")).select(*key, "b.*").join(
        unc.filter("n_obs >= 5"), key)
    best = best.withColumn("omega", F.col("uv") * (1 - F.col("alpha") - F.col("beta")))
    # one-step forecast: the variance after the last row, older rows being forgotten
    last = tail(rets, series, 2 * span).df.join(best.select(*key, "alpha", "beta", "omega", "uv"), key)
    age = F.col("_n") - F.col("_rn")
    mass = F.sum(F.pow("beta", age) * (F.col("omega") + F.col("alpha") * F.col("ret") * F.col("ret")))
    fc = last.groupBy(*key).agg((mass + F.max(F.pow("beta", F.col("_n")) * F.col("uv"))).alias("_v"))
    return best.join(fc, key).withColumn("forecast_vol", F.sqrt("_v")).withColumn(
        "persistence", F.col("alpha") + F.col("beta")).withColumn("long_run_var", F.col("uv")).drop("_v", "uv")


def kalman_hedge(pairs: DataFrame, series: Series, q: float = 1e-5, r: float = 1e-3,
                 block_rows: int | None = None) -> DataFrame:
    """Time-varying hedge ratio of ``a`` on ``b`` per pair.

    P follows a linear-fractional map of itself and the ratio, given P, an affine
    one, so blocks are summarised by a 2x2 matrix and then by (slope, shift);
    only one summary row per block is walked in order.
    """
    key, stamps = list(series.key), list(series.order)
    fr = framed(pairs.select(*key, *series.order, "a", "b"), series, block_rows=block_rows)
    rows = fr.df.select(*key, *series.order, "a", "b", "_blk", "_rn")
    seed = rows.filter("_rn <= 20").groupBy(*key).agg(
        F.coalesce(F.regr_slope("a", "b"), F.lit(0.0)).alias("_seed"))
    kf = [pairs.schema[k] for k in key]
    num = lambda *names: [T.StructField(n, T.DoubleType()) for n in names]
    blk = [T.StructField("_blk", T.LongType())]

    def head(pdf, names):
        return {n: [pdf[n].iloc[0]] for n in names}

    def p_map(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.eye(2)
        for h in pdf.sort_values("_rn")["b"].to_numpy():
            m = np.array([[r, r * q], [h * h, h * h * q + r]]) @ m
            m /= np.abs(m).max()
        return pd.DataFrame({**head(pdf, key), "_blk": [int(pdf["_blk"].iloc[0])], "m00": m[0, 0],
                             "m01": m[0, 1], "m10": m[1, 0], "m11": m[1, 1]})

    def p_walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, p, out = pdf.sort_values("_blk"), 1.0, []
        for m in pdf[["m00", "m01", "m10", "m11"]].to_numpy():
            out.append(p)
            p = (m[0] * p + m[1]) / (m[2] * p + m[3])
        return pdf[[*key, "_blk"]].assign(p_in=out)

    def gains(a, b, p):
        for x, h in zip(a, b):
            p += q
            s = h * p * h + r
            k = 0.0 if s == 0 else p * h / s
            p = (1 - k * h) * p
            yield k, 1 - k * h, k * x, p

    def b_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, slope, shift = pdf.sort_values("_rn"), 1.0, 0.0
        for _, s, c, _p in gains(pdf["a"].to_numpy(), pdf["b"].to_numpy(), float(pdf["p_in"].iloc[0])):
            slope, shift = s * slope, s * shift + c
        return pd.DataFrame({**head(pdf, key), "_blk": [int(pdf["_blk"].iloc[0])], "slope": slope,
                             "shift": shift, "_seed": float(pdf["_seed"].iloc[0])})

    def b_walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("_blk"), []
        x = float(pdf["_seed"].iloc[0])
        for s, c in pdf[["slope", "shift"]].to_numpy():
            out.append(x)
            x = s * x + c
        return pdf[[*key, "_blk"]].assign(b_in=out)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        x, ratio, conf = float(pdf["b_in"].iloc[0]), [], []
        for _, s, c, p in gains(pdf["a"].to_numpy(), pdf["b"].to_numpy(), float(pdf["p_in"].iloc[0])):
            x = s * x + c
            ratio.append(x)
            conf.append(max(0.0, min(1.0, 1 - np.sqrt(p))))
        return pdf[[*key, *stamps]].assign(ratio=ratio, confidence=conf)

    on = [*key, "_blk"]
    maps = rows.groupBy(*on).applyInPandas(p_map, T.StructType(kf + blk + num("m00", "m01", "m10", "m11")))
    p_in = maps.groupBy(*key).applyInPandas(p_walk, T.StructType(kf + blk + num("p_in")))
    with_p = rows.join(p_in, on).join(seed, key)
    lin = with_p.groupBy(*on).applyInPandas(b_map, T.StructType(kf + blk + num("slope", "shift", "_seed")))
    b_in = lin.groupBy(*key).applyInPandas(b_walk, T.StructType(kf + blk + num("b_in")))
    order = [pairs.schema[c] for c in series.order]
    return with_p.drop("_seed").join(b_in, on).groupBy(*on).applyInPandas(
        fill, T.StructType(kf + order + num("ratio", "confidence")))


def hurst_rs(df: DataFrame, x: str = "ret", max_lag: int = 20, series: Series = BAR_SERIES) -> DataFrame:
    """Rescaled range over lags 2..max_lag on non-overlapping segments, slope in [0, 1]."""
    key = list(series.key)
    fr = framed(df.select(*key, *series.order, F.col(x).cast("double").alias("_x")), series, lookback=max_lag)
    lags = range(2, max_lag + 1)
    ends = lambda l: F.col("_rn") % l == 0
    df1 = fr.df
    for l in lags:
        win = fr.rows(-(l - 1))
        df1 = df1.withColumn(f"m{l}", F.avg("_x").over(win)).withColumn(f"d{l}", F.stddev_pop("_x").over(win))
    df1 = df1.withColumn("_seg", F.collect_list("_x").over(fr.rows(-(max_lag - 1))))
    rows = Frame(df1, series, ()).body(keep_rn=True)
    g = rows.groupBy(*key).agg(F.max("_n").alias("n"), *[
        F.avg(F.when(ends(l) & (F.col(f"d{l}") > 0), walk_range(F.slice("_seg", -l, l), F.col(f"m{l}"))
                     / F.col(f"d{l}"))).alias(f"s{l}") for l in lags])
    pts = F.array(*[F.struct(F.lit(float(np.log(l))).alias("x"), F.when(F.col(f"s{l}") > 0, F.ln(f"s{l}")).alias("y"))
                    for l in range(2, max_lag + 1)])
    e = g.select(*key, "n", F.explode(pts).alias("p")).filter("p.y IS NOT NULL")
    s = e.groupBy(*key, "n").agg(F.regr_slope("p.y", "p.x").alias("h"), F.count(F.lit(1)).alias("k"))
    out = g.select(*key, "n").join(s.drop("n"), key, "left")
    return out.select(*key, "n", F.when((F.col("n") < max_lag + 1) | F.col("h").isNull() | (F.col("k") < 2), 0.5)
                      .otherwise(clamp(F.col("h"))).alias("hurst"))


def walk_range(seg: Column, m: Column) -> Column:
    """Range of the cumulative deviations of a short array from ``m``."""
    walk = F.aggregate(
        seg, F.struct(F.lit(0.0).alias("c"), F.lit(float("-inf")).alias("hi"), F.lit(float("inf")).alias("lo")),
        lambda a, v: F.struct((a.c + v - m).alias("c"), F.greatest(a.hi, a.c + v - m).alias("hi"),
                              F.least(a.lo, a.c + v - m).alias("lo")), lambda a: a.hi - a.lo)
    return walk


def hurst_exponent(df: DataFrame, x: str = "ret", method: str = "rs", min_window: int = 10,
                   series: Series = BAR_SERIES) -> DataFrame:
    """Hurst exponent over windows growing by floor(1.5 w) up to half the series.

    Windows may be as long as half a series, so block means and the ranges of
    the cumulative deviations come from a global running sum and plain
    aggregates per (window, block), never from a window over one block.
    """
    key = list(series.key)
    sizes, w = [], min_window
    while w < 10 ** 12:
        sizes.append(w)
        w = int(w * 1.5)
    means = df.groupBy(*key).agg(F.avg(x).alias("_mu"))
    src = df.select(*key, *series.order, F.col(x).alias("_x")).join(means, key).withColumn(
        "_d", F.col("_x") - F.col("_mu"))
    fr = framed(src, series, carry={"c": ("sum", F.col("_d"))})
    rows = fr.with_columns(_cum=fr.running("c", "sum", F.col("_d"))).body(keep_rn=True)
    ladder = F.filter(F.array(*[F.lit(s).cast("long") for s in sizes]),
                      lambda s: s <= F.floor(F.col("_n") / 2))
    e = rows.select(*key, "_rn", "_n", "_d", "_cum", F.explode(ladder).alias("w")).withColumn(
        "blk", F.floor((F.col("_rn") - 1) / F.col("w"))).filter("(blk + 1) * w <= _n")
    pos = F.col("_rn") - 1 - F.col("blk") * F.col("w")
    by = [*key, "_n", "w", "blk"]
    if method == "rs":
        start = F.min_by(F.col("_cum") - F.col("_d"), "_rn").alias("c0")
        m = e.groupBy(*by).agg(F.avg("_d").alias("m"), F.stddev_samp("_d").alias("sd"), start)
        dev = F.col("_cum") - F.col("c0") - F.col("m") * (pos + 1)
        per = e.join(m, by).groupBy(*by).agg(
            (F.when(F.first("sd") > 0, (F.max(dev) - F.min(dev)) / F.first("sd"))).alias("v"))
        pts = per.groupBy(*key, "_n", "w").agg((F.sum("v") / F.floor(F.col("_n") / F.col("w"))).alias("v"))
        y = F.ln("v")
    else:
        yv = F.col("_cum")
        per = e.groupBy(*by).agg(
            ((F.regr_syy(yv, pos) - F.pow(F.regr_sxy(yv, pos), 2) / F.regr_sxx(yv, pos)) / F.col("w")).alias("v"))
        pts = per.groupBy(*key, "_n", "w").agg((F.sum("v") / F.floor(F.col("_n") / F.col("w"))).alias("v"))
        y = 0.5 * F.ln("v")
    pts = pts.withColumn("y", F.when(F.col("v") > 0, y)).withColumn("lx", F.ln("w"))
    g = pts.groupBy(*key, F.col("_n").alias("n")).agg(
        F.regr_slope("y", "lx").alias("h"), F.regr_r2("y", "lx").alias("r2"), F.count("y").alias("k"))
    out = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_obs")).join(g.drop("n"), key, "left")
    ok = (F.col("n_obs") >= 2 * min_window) & (F.col("k") >= 2)
    h = F.when(ok, clamp(F.col("h"))).otherwise(0.5)
    return out.select(*key, "n_obs", h.alias("hurst"), F.when(ok, F.coalesce("r2", F.lit(0.0))).otherwise(0.0)
                      .alias("r_squared"),
                      F.when(h > 0.55, "trending").when(h < 0.45, "mean_reverting").otherwise("random_walk")
                      .alias("regime"))

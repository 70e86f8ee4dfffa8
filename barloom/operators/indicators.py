"""Fixed-frame indicators: every symbol at once, one block layout per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import safe_div
from ..plans.blocks import Frame, Series, framed, islands, tail
from ..plans.lineage import cut
from ..sources.views import BAR_SERIES


def full(fr: Frame, x: Column, rows: int, start: int = 1) -> Column:
    """``x`` once ``rows`` inputs exist, counting from position ``start``."""
    return F.when(F.col("_rn") >= start + rows - 1, x)


def sma_col(fr: Frame, x: str, p: int, start: int = 1) -> Column:
    return full(fr, F.avg(x).over(fr.rows(-(p - 1))), p, start)


def with_sma(bars: DataFrame, *periods: int, series: Series = BAR_SERIES, x: str = "close",
             extra_return: bool = False) -> DataFrame:
    fr = framed(bars, series, lookback=max(*periods, 2))
    fr = fr.with_columns(**{f"sma_{p}": sma_col(fr, x, p) for p in periods})
    if extra_return:
        prev = F.lag(x).over(fr.w)
        fr = fr.with_columns(change=F.when(prev != 0, F.col(x) / prev - 1))
    return fr.body()


def add_bollinger(fr: Frame, x: str = "close", p: int = 20, k: float = 2.0) -> Frame:
    fr = fr.with_columns(bb_mid=sma_col(fr, x, p),
                         bb_sd=full(fr, F.stddev_pop(x).over(fr.rows(-(p - 1))), p))
    m, s = F.col("bb_mid"), F.col("bb_sd")
    return fr.with_columns(bb_upper=m + k * s, bb_lower=m - k * s,
                           bb_width=safe_div(2 * k * s, m, 0.0))


def bollinger(bars: DataFrame, p: int = 20, k: float = 2.0, series: Series = BAR_SERIES) -> DataFrame:
    return add_bollinger(framed(bars, series, lookback=p), "close", p, k).body()


def add_true_range(fr: Frame) -> Frame:
    pc = F.lag("close").over(fr.w)
    h, l = F.col("high"), F.col("low")
    return fr.with_columns(tr=F.when(F.col("_rn") > 1, F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))))


def add_atr(fr: Frame, p: int = 14) -> Frame:
    fr = add_true_range(fr)
    return fr.with_columns(atr=full(fr, F.avg("tr").over(fr.rows(-(p - 1))), p, start=2))


def true_range_atr(bars: DataFrame, p: int = 14, series: Series = BAR_SERIES) -> DataFrame:
    return add_atr(framed(bars, series, lookback=p + 1), p).body()


def add_stochastic(fr: Frame, k: int = 14, d: int = 3) -> Frame:
    hi, lo = F.max("high").over(fr.rows(-(k - 1))), F.min("low").over(fr.rows(-(k - 1)))
    fr = fr.with_columns(stoch_k=full(fr, F.when(hi == lo, 50.0).otherwise(
        (F.col("close") - lo) / (hi - lo) * 100), k))
    return fr.with_columns(stoch_d=full(fr, F.avg("stoch_k").over(fr.rows(-(d - 1))), d, start=k))


def stochastic(bars: DataFrame, k: int = 14, d: int = 3, series: Series = BAR_SERIES) -> DataFrame:
    return add_stochastic(framed(bars, series, lookback=k + d), k, d).body()


def obv(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Running volume signed by the close direction, from 0."""
    fr = framed(bars, series, lookback=1)
    prev = F.lag("close").over(fr.w)
    step = F.when(F.col("close") > prev, F.col("volume")).when(F.col("close") < prev, -F.col("volume")) \
        .otherwise(0.0)
    steps = fr.with_columns(_step=step).body()
    fr2 = framed(steps, series, carry={"obv": ("sum", F.col("_step"))})
    return fr2.with_columns(obv=fr2.running("obv", "sum", F.col("_step"))).body().drop("_step")


def vwap_running(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Cumulative typical price by volume; the typical price itself while volume is 0."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    pv = typical * F.col("volume")
    fr = framed(bars, series, carry={"pv": ("sum", pv), "v": ("sum", F.col("volume"))})
    fr = fr.with_columns(_pv=fr.running("pv", "sum", pv), _v=fr.running("v", "sum", F.col("volume")))
    return fr.with_columns(vwap=F.when(F.col("_v") == 0, typical).otherwise(F.col("_pv") / F.col("_v"))) \
        .body().drop("_pv", "_v")


def volume_spike(bars: DataFrame, short: int = 5, long: int = 63, series: Series = BAR_SERIES) -> DataFrame:
    """Mean volume of the last ``short`` rows over that of the last ``long`` rows."""
    fr = framed(bars, series, lookback=long)
    a, b = F.avg("volume").over(fr.rows(-(short - 1))), F.avg("volume").over(fr.rows(-(long - 1)))
    return fr.with_columns(spike=safe_div(a, b, 0.0)).body()


def regime_stats(rets: DataFrame, window: int = 20, periods: int = 365,
                 series: Series = BAR_SERIES) -> DataFrame:
    """Rolling mean, sd, third and fourth standardised moments (sample sd) and a regime label."""
    fr = framed(rets, series, lookback=window)
    w, r, n = fr.rows(-(window - 1)), F.col("ret"), float(window)
    fr = fr.with_columns(mean=F.avg(r).over(w), sd=F.stddev_samp(r).over(w),
                         _s2=F.sum(r * r).over(w), _s3=F.sum(r * r * r).over(w),
                         _s4=F.sum(r * r * r * r).over(w))
    m, s = F.col("mean"), F.col("sd")
    third = F.col("_s3") / n - 3 * m * F.col("_s2") / n + 2 * m * m * m
    fourth = F.col("_s4") / n - 4 * m * F.col("_s3") / n + 6 * m * m * F.col("_s2") / n - 3 * m * m * m * m
    vol = s * periods ** 0.5
    out = fr.with_columns(
        skew=safe_div(third, s * s * s, 0.0),
        kurt=F.when(s == 0, 0.0).otherwise(fourth / (s * s * s * s) - 3), annual_vol=vol,
        regime=F.when(vol > 0.8, "crisis").when(vol > 0.5, "high-volatility")
        .when(F.abs(m) > s / 2, F.when(m > 0, "trending-up").otherwise("trending-down"))
        .otherwise("mean-reverting"))
    return out.with_columns(_full=F.col("_rn") >= window).body().filter("_full").drop(
        "_full", "_s2", "_s3", "_s4")


def bb_squeeze(bars: DataFrame, p: int = 20, threshold: float = 0.5, series: Series = BAR_SERIES) -> DataFrame:
    """Last bandwidth against the mean bandwidth of the series, and length of the current squeeze."""
    # three aggregates read the bandwidths: written once, the bars are neither built nor held again for each
    bw = cut(bollinger(bars, p, 2.0, series).filter(F.col("bb_mid").isNotNull()).select(
        *series.key, *series.order, (F.col("bb_width") * 100).alias("bw"),
        (F.col("close") > F.col("bb_mid")).alias("above")))
    g = bw.groupBy(*series.key).agg(F.avg("bw").alias("avg_bw"), F.max_by("above", F.struct(*series.order))
                                    .alias("above_middle"), F.max_by("bw", F.struct(*series.order))
                                    .alias("bandwidth"), F.max(F.struct(*series.order)).alias("_last"))
    rows = bw.join(g.select(*series.key, "avg_bw"), list(series.key)).withColumn(
        "_in", safe_div(F.col("bw"), F.col("avg_bw"), 1.0) < threshold)
    # the current run starts after the last row that is not squeezed
    stop = rows.groupBy(*series.key).agg(
        F.max(F.when(~F.col("_in"), F.struct(*series.order))).alias("_stop"))
    run = rows.join(stop, list(series.key)).filter(
        F.col("_stop").isNull() | (F.struct(*series.order) > F.col("_stop"))).groupBy(*series.key).agg(
        F.count(F.lit(1)).alias("squeeze_bars"))
    ratio = safe_div(F.col("bandwidth"), F.col("avg_bw"), 1.0)
    return g.join(run, list(series.key), "left").select(
        *series.key, "bandwidth", "avg_bw", ratio.alias("ratio"), (ratio < threshold).alias("squeeze"), "above_middle",
        F.coalesce("squeeze_bars", F.lit(0)).cast("long").alias("squeeze_bars"))


def mean_reversion_scan(bars: DataFrame, lookback: int = 20, threshold: float = 2.0,
                        series: Series = BAR_SERIES) -> DataFrame:
    t = tail(bars, series, lookback)
    last = F.max(F.when(F.col("_rn") == F.col("_n"), F.col("close")))
    g = t.df.groupBy(*series.key).agg(last.alias("last"), F.avg("close").alias("mean"),
                                      F.coalesce(F.stddev_samp("close"), F.lit(0.0)).alias("sd"))
    z = safe_div(F.col("last") - F.col("mean"), F.col("sd"), 0.0)
    return (g.withColumn("z", z).withColumn("deviation_pct", safe_div(
        (F.col("last") - F.col("mean")) * 100, F.col("mean"), 0.0))
        .withColumn("signal", F.when(z < -threshold, "oversold").when(z > threshold, "overbought")
                    .otherwise("neutral")))


# Bars per year of each timeframe.
PERIODS_PER_YEAR = {"1m": 525600, "5m": 105120, "15m": 35040, "30m": 17520, "1h": 8760, "4h": 2190,
                    "1d": 365, "1w": 52}


def resample(bars: DataFrame, interval: str, unit: str) -> DataFrame:
    """Coarser bars of the same symbols (unit as in date_trunc)."""
    t = F.struct("ts")
    out = bars.withColumn("_b", F.date_trunc(unit, "ts")).groupBy(
        "symbol", "exchange", F.lit(interval).alias("interval"), F.col("_b").alias("_ts")).agg(
        F.min_by("open", t).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", t).alias("close"), F.sum("volume").alias("volume"),
        F.first("asset_type").alias("asset_type"))
    return out.withColumnRenamed("_ts", "ts").select(*bars.columns)


def vol_term_structure(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Annualised volatility per (symbol, timeframe), shortest timeframe first, with adjacent ratios."""
    fr = framed(bars, series, lookback=1)
    prev = F.lag("close").over(fr.w)
    r = fr.with_columns(ret=F.when(prev != 0, F.col("close") / prev - 1)).body()
    # Bars per year as declared above.
    per = F.create_map(*[F.lit(x) for kv in PERIODS_PER_YEAR.items() for x in kv])
    g = r.groupBy("symbol", "exchange", "interval").agg(
        F.stddev_samp("ret").alias("_sd"), F.count("ret").alias("_c")).filter("_c >= 2")
    g = g.withColumn("_per", per[F.col("interval")]).withColumn("vol", F.col("_sd") * F.sqrt("_per"))
    w = Window.partitionBy("symbol", "exchange").orderBy(F.col("_per").desc())
    longer = F.lead("vol").over(w)
    g = g.withColumn("_step", F.when(longer.isNotNull(), F.when(longer > F.col("vol"), 1).otherwise(-1))) \
        .withColumn("ratio", F.when(longer != 0, F.col("vol") / longer))
    net = F.coalesce(F.sum("_step").over(Window.partitionBy("symbol", "exchange")), F.lit(1))
    return g.withColumn("structure", F.when(net > 0, "normal").when(net < 0, "inverted").otherwise("mixed")) \
        .drop("_sd", "_c", "_per", "_step")


def vol_regime(bars: DataFrame, p: int = 14, window: int = 100, series: Series = BAR_SERIES) -> DataFrame:
    """Last ATR against the mean ATR of the last ``window`` rows."""
    t = add_atr(tail(bars, series, window + p), p)
    g = t.df.groupBy(*series.key).agg(
        F.max_by("atr", "_rn").alias("atr"),
        F.avg(F.when(F.col("_rn") > F.col("_n") - window, F.col("atr"))).alias("avg_atr"))
    ratio = F.when(F.coalesce("avg_atr", F.lit(0.0)) == 0, 1.0).otherwise(F.col("atr") / F.col("avg_atr"))
    return g.withColumn("ratio", ratio).withColumn("regime", vol_label(ratio))


def vol_label(ratio: Column) -> Column:
    return F.when(ratio > 1.5, "high").when(ratio < 0.7, "low").otherwise("normal")


def cumulative(df: DataFrame, x: Column, name: str, series: Series) -> DataFrame:
    """Running sum of an expression over the whole series."""
    fr = framed(df, series, carry={"x": ("sum", x)})
    return fr.with_columns(**{name: fr.running("x", "sum", x)}).body()


def social_volume(df: DataFrame, series: Series, volume: str = "social_volume", price: str = "price") -> DataFrame:
    """Social volume z-scores per series with spike count, lag-free correlation and divergence."""
    stats = df.groupBy(*series.key).agg(F.avg(volume).alias("_m"),
                                        F.coalesce(F.stddev_samp(volume), F.lit(0.0)).alias("_s"))
    z = df.join(stats, list(series.key)).withColumn("z", safe_div(F.col(volume) - F.col("_m"), F.col("_s"), 0.0))
    fr = framed(z, series, lookback=3)
    pv, pp = F.lag(volume).over(fr.w), F.lag(price).over(fr.w)
    fr = fr.with_columns(
        dv=F.when(pv.isNotNull(), F.when(pv == 0, 0.0).otherwise(F.col(volume) / pv - 1)),
        dp=F.when(pp.isNotNull(), F.when(pp == 0, 0.0).otherwise(F.col(price) / pp - 1)),
        z3=F.avg("z").over(fr.rows(-2)), _p2=F.lag(price, 2).over(fr.w))
    rows = fr.body(keep_rn=True)
    o = F.struct(*series.order)
    trend = F.max_by(F.when(F.col("_p2") != 0, F.col(price) / F.col("_p2") - 1), o)
    return rows.groupBy(*series.key).agg(
        F.max_by("z", o).alias("z"), F.sum(F.when(F.col("z") > 2, 1).otherwise(0)).alias("spikes"),
        F.coalesce(F.corr("dv", "dp"), F.lit(0.0)).alias("price_corr"),
        (F.coalesce(F.max_by("z3", o) > 1.5, F.lit(False)) & F.coalesce(trend < 0, F.lit(False)))
        .alias("divergence"))


def sentiment_momentum(df: DataFrame, series: Series, x: str = "value", short: int = 5,
                       long: int = 20) -> DataFrame:
    """Short minus long mean, its change, crossover and trend at +-1, per row from the first full window."""
    fr = framed(df, series, lookback=long + 1)
    fr = fr.with_columns(momentum=full(fr, F.avg(x).over(fr.rows(-(short - 1)))
                                       - F.avg(x).over(fr.rows(-(long - 1))), long))
    prev = F.lag("momentum").over(fr.w)
    m = F.col("momentum")
    fr = fr.with_columns(
        acceleration=m - prev,
        crossover=F.coalesce(((prev <= 0) & (m > 0)) | ((prev >= 0) & (m < 0)), F.lit(False)),
        trend=F.when(m > 1, "improving").when(m < -1, "deteriorating").otherwise("stable"))
    return fr.body().filter(F.col("momentum").isNotNull())

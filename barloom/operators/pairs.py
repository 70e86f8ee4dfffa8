"""Pair trading statistics for all symbol pairs at once.

Every test statistic of a pair is a function of second moments of levels, lags
and changes of the two series. One Gram pass over the aligned panel gives them
all, so no (pair, timestamp) row ever exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import safe_div
from ..plans.blocks import Series, framed, tail, time_series
from ..plans.lineage import cut
from .align import common_ts, pair_moments
from .tseries import half_life_of, mackinnon_cv, mackinnon_p

SYMBOL_SERIES = time_series(("symbol",), ("ts",), bucket_seconds=86_400)
PARTS = [f + g for f in "xld" for g in "xld"]


def pair_gram(bars: DataFrame, price: str = "close", blocks: int | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Per pair a < b: sizes, means and cross moments of level (x), lag (l) and change (d), centred by symbol."""
    al = cut(common_ts(bars.select("symbol", "ts", F.col(price).alias("p")), symbols=symbols))
    mu = al.groupBy("symbol").agg(F.avg("p").alias("mu"))
    fr = framed(al.join(mu, "symbol").withColumn("x", F.col("p") - F.col("mu")), SYMBOL_SERIES, lookback=1)
    rows = cut(fr.with_columns(l=F.lag("x").over(fr.w)).body().select("symbol", "ts", "mu", "x", "l", (F.col("x") - F.col("l")).alias("d")))
    feats = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in "xld"])
    lng = rows.select("symbol", "ts", F.explode(feats).alias("e")).select(
        F.concat_ws("|", "e.f", "symbol").alias("symbol"), "ts", F.col("e.v").alias("v")).filter("v is not null")
    m = pair_moments(lng, "v", blocks=blocks)
    flip = m.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n", F.col("sb").alias("sa"),
                                     F.col("sa").alias("sb"), F.col("sbb").alias("saa"), F.col("saa").alias("sbb"), "sab")
    m = m.select("a", "b", "n", "sa", "sb", "saa", "sbb", "sab").unionByName(flip)
    m = m.select(F.substring("a", 1, 1).alias("fa"), F.expr("substring(a, 3)").alias("a"),
                 F.substring("b", 1, 1).alias("fb"), F.expr("substring(b, 3)").alias("b"), "n", "sa", "sb", "saa", "sbb", "sab")
    m = m.filter("a < b")
    at = lambda f, g, c: F.max(F.when((F.col("fa") == f) & (F.col("fb") == g), F.col(c)))
    aggs = [at("x", "x", "n").alias("n"), at("l", "l", "n").alias("m")]
    for f in "xld":
        aggs += [at(f, f, "sa").alias(f"s_a{f}"), at(f, f, "sb").alias(f"s_b{f}"),
                 at(f, f, "saa").alias(f"q_a{f}"), at(f, f, "sbb").alias(f"q_b{f}")]
    aggs += [at(f, g, "sab").alias(f"c_{f}{g}") for f in "xld" for g in "xld"]
    g = m.groupBy("a", "b").agg(*aggs)
    # products of one symbol's own lag and change: d*l = (x^2 - l^2 - d^2) / 2 summed over the lagged rows
    own = rows.groupBy("symbol").agg(F.sum(F.col("d") * F.col("l")).alias("dl"), F.max("mu").alias("mu"))
    a = own.select(F.col("symbol").alias("a"), F.col("dl").alias("dl_a"), F.col("mu").alias("mu_a"))
    b = own.select(F.col("symbol").alias("b"), F.col("dl").alias("dl_b"), F.col("mu").alias("mu_b"))
    return g.join(a, "a").join(b, "b")


def pair_stats(bars: DataFrame, price: str = "close", blocks: int | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Correlation, hedge ratios, residual unit-root test, half-life and trace statistics of every pair."""
    g = pair_gram(bars, price, blocks, symbols).filter("n >= 10")
    c = F.col
    n, m = c("n"), c("m")
    vaa, vbb = c("q_ax") - c("s_ax") * c("s_ax") / n, c("q_bx") - c("s_bx") * c("s_bx") / n
    vab = c("c_xx") - c("s_ax") * c("s_bx") / n
    g = g.withColumn("vaa", vaa).withColumn("vbb", vbb).withColumn("vab", vab)
    g = g.withColumn("corr", F.when((c("vaa") > 0) & (c("vbb") > 0), c("vab") / F.sqrt(c("vaa") * c("vbb"))).otherwise(0.0))
    g = g.withColumn("hedge", safe_div(c("vab"), c("vbb"), 0.0))
    g = g.withColumn("intercept", c("mu_a") - c("hedge") * c("mu_b"))
    diff = c("vaa") - c("vbb")
    g = g.withColumn("hedge_tls", F.when(c("vab") == 0, 0.0).otherwise(
        (diff + F.sqrt(diff * diff + 4 * c("vab") * c("vab"))) / (2 * c("vab"))))
    # residual e = xa - h xb: sums of its lag and change over the m lagged rows
    h = c("hedge")
    cov = lambda q, s1, s2: q - s1 * s2 / m
    ll = {"aa": cov(c("q_al"), c("s_al"), c("s_al")), "ab": cov(c("c_ll"), c("s_al"), c("s_bl")),
          "bb": cov(c("q_bl"), c("s_bl"), c("s_bl"))}
    dd = {"aa": cov(c("q_ad"), c("s_ad"), c("s_ad")), "ab": cov(c("c_dd"), c("s_ad"), c("s_bd")),
          "bb": cov(c("q_bd"), c("s_bd"), c("s_bd"))}
    dl = {"aa": cov(c("dl_a"), c("s_ad"), c("s_al")), "ab": cov(c("c_dl"), c("s_ad"), c("s_bl")),
          "ba": cov(c("c_ld"), c("s_bd"), c("s_al")), "bb": cov(c("dl_b"), c("s_bd"), c("s_bl"))}
    for name, e in {**{f"l{k}": v for k, v in ll.items()}, **{f"d{k}": v for k, v in dd.items()},
                    **{f"x{k}": v for k, v in dl.items()}}.items():
        g = g.withColumn(f"_{name}", e)
    sxx = c("_laa") - 2 * h * c("_lab") + h * h * c("_lbb")
    syy = c("_daa") - 2 * h * c("_dab") + h * h * c("_dbb")
    sxy = c("_xaa") - h * c("_xab") - h * c("_xba") + h * h * c("_xbb")
    g = g.withColumn("_sxx", sxx).withColumn("_syy", syy).withColumn("_sxy", sxy)
    g = g.withColumn("slope", safe_div(c("_sxy"), c("_sxx"), 0.0))
    se = F.sqrt(F.greatest(c("_syy") - c("_sxy") * c("slope"), F.lit(0.0)) / (m - 2) / c("_sxx"))
    g = g.withColumn("adf_stat", F.coalesce(F.when((c("_sxx") > 0) & (se > 0), c("slope") / se), F.lit(0.0)))
    g = g.withColumn("p_value", mackinnon_p(c("adf_stat"), n)).withColumn(
        "cointegrated", c("adf_stat") < mackinnon_cv(n)[1] - 0.25)
    return g.withColumn("half_life", half_life_of(c("slope")))


def engle_granger(bars: DataFrame, **kw) -> DataFrame:
    return pair_stats(bars, **kw).select("a", "b", "n", "hedge", "adf_stat", "p_value", "cointegrated")


def hedge_ratio(bars: DataFrame, **kw) -> DataFrame:
    """OLS and total-least-squares ratios with intercept and R2 of each."""
    c = F.col
    s = pair_stats(bars, **kw)
    res = lambda h: 1 - (c("vaa") - 2 * h * c("vab") + h * h * c("vbb")) / c("vaa")
    return s.select("a", "b", "n", "hedge", "intercept", F.when(c("vaa") > 0, res(c("hedge"))).otherwise(0.0).alias("r2"),
                    "hedge_tls", (c("mu_a") - c("hedge_tls") * c("mu_b")).alias("intercept_tls"),
                    F.when(c("vaa") > 0, res(c("hedge_tls"))).otherwise(0.0).alias("r2_tls"))


def score_pairs(bars: DataFrame, **kw) -> DataFrame:
    """40 for cointegration, 20 by |corr|, up to 30 by half-life (best near 30), up to 10 by the statistic."""
    s, hl = pair_stats(bars, **kw), F.col("half_life")
    life = F.when(hl.isNull() | (hl <= 0) | (hl == float("inf")), 0.0).when(
        (hl >= 5) & (hl <= 100), 30 * (1 - F.abs(hl - 30) / 70)).when(hl < 5, 10.0).otherwise(5.0)
    score = (F.when(F.col("cointegrated"), 40.0).otherwise(0.0) + 20 * F.abs("corr") + life
             + F.greatest(F.lit(0.0), F.least(F.lit(10.0), -F.col("adf_stat") - 2)))
    return s.select("a", "b", "n", "corr", "cointegrated", "adf_stat", "half_life", score.alias("score")).orderBy(
        F.col("score").desc(), "a", "b")


def johansen(bars: DataFrame, **kw) -> DataFrame:
    """Two-series trace test from the moments: eigenvalues of S11^-1 S10 S00^-1 S01 in closed form."""
    c = F.col
    g = pair_stats(bars, **kw)
    # S01 rows are changes, columns are lags; scale T cancels in the product
    det0 = c("_daa") * c("_dbb") - c("_dab") * c("_dab")
    det1 = c("_laa") * c("_lbb") - c("_lab") * c("_lab")
    detx = c("_xaa") * c("_xbb") - c("_xab") * c("_xba")
    # trace of S11^-1 S10 S00^-1 S01, entry by entry of the symmetric inner product
    p = {("a", "a"): c("_dbb"), ("a", "b"): -c("_dab"), ("b", "a"): -c("_dab"), ("b", "b"): c("_daa")}
    q = {("a", "a"): c("_lbb"), ("a", "b"): -c("_lab"), ("b", "a"): -c("_lab"), ("b", "b"): c("_laa")}
    x = {("a", "a"): c("_xaa"), ("a", "b"): c("_xab"), ("b", "a"): c("_xba"), ("b", "b"): c("_xbb")}
    terms = [q[(i, j)] * x[(k, j)] * p[(k, l)] * x[(l, i)] for i in "ab" for j in "ab" for k in "ab" for l in "ab"]
    trace = sum(terms[1:], terms[0]) / (det0 * det1)
    g = g.withColumn("_tr", trace).withColumn("_det", detx * detx / (det0 * det1))
    root = F.sqrt(F.greatest(c("_tr") * c("_tr") - 4 * c("_det"), F.lit(0.0)))
    unit = lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))
    g = g.withColumn("eig1", unit((c("_tr") + root) / 2)).withColumn("eig2", unit((c("_tr") - root) / 2))
    lg = lambda e: F.ln(1 - F.least(F.lit(0.9999), c(e)))
    g = g.withColumn("trace1", -c("m") * (lg("eig1") + lg("eig2"))).withColumn("trace2", -c("m") * lg("eig2"))
    # 5 % trace critical values for two series.
    rank = F.when(c("trace1") <= 15.41, 0).when(c("trace2") <= 3.76, 1).otherwise(2)
    return g.select("a", "b", "n", "eig1", "eig2", "trace1", "trace2", rank.cast("long").alias("rank"))


def with_spread(pairs: DataFrame, hedges: DataFrame | None, series: Series, ratio: float | None = None) -> DataFrame:
    """spread = a - ratio * b, the ratio given or joined per key (column hedge)."""
    if ratio is not None:
        return pairs.withColumn("spread", F.col("a") - ratio * F.col("b"))
    return pairs.join(hedges.select(*series.key, "hedge"), list(series.key)).withColumn(
        "spread", F.col("a") - F.col("hedge") * F.col("b"))


def ols_hedges(pairs: DataFrame, series: Series) -> DataFrame:
    return pairs.groupBy(*series.key).agg(F.coalesce(F.regr_slope("a", "b"), F.lit(0.0)).alias("hedge"))


def spread_zscore(spreads: DataFrame, series: Series, lookback: int) -> DataFrame:
    """z-score and percentile (<=) of the last spread within the lookback."""
    t = tail(spreads, series, lookback).df
    w = Window.partitionBy(*series.key)
    t = t.withColumn("_cur", F.max(F.when(F.col("_rn") == F.col("_n"), F.col("spread"))).over(w))
    g = t.groupBy(*series.key).agg(
        F.max("_cur").alias("spread"), F.avg("spread").alias("mean"),
        F.coalesce(F.stddev_samp("spread"), F.lit(0.0)).alias("sd"),
        (F.avg(F.when(F.col("spread") <= F.col("_cur"), 1.0).otherwise(0.0)) * 100).alias("percentile"))
    return g.withColumn("z", safe_div(F.col("spread") - F.col("mean"), F.col("sd"), 0.0))


def pair_signal(z: Column, entry: float = 2.0, exit_: float = 0.5, stop: float = 4.0) -> tuple[Column, Column]:
    a = F.abs(z)
    label = F.when(a >= stop, "stop").when(z >= entry, "short_spread").when(z <= -entry, "long_spread").when(
        a <= exit_, "exit").otherwise("neutral")
    strength = F.when(a >= stop, F.least(F.lit(1.0), a / stop)).when(
        a >= entry, F.least(F.lit(1.0), (a - entry) / (stop - entry) + 0.5)).when(a <= exit_, 1 - a / exit_).otherwise(0.0)
    return label, strength


def rolling_spread(spreads: DataFrame, series: Series, window: int) -> DataFrame:
    """Rolling mean, deviation, z and half-life of the spread, from the first full window."""
    fr = framed(spreads, series, lookback=window + 1)
    w = fr.rows(-(window - 1))
    lag = F.lag("spread").over(fr.w)
    fr = fr.with_columns(_l=lag, _d=F.col("spread") - lag, mean=F.avg("spread").over(w),
                         sd=F.coalesce(F.stddev_samp("spread").over(w), F.lit(0.0)))
    inner = fr.rows(-(window - 2))
    fr = fr.with_columns(_s=F.regr_slope("_d", "_l").over(inner))
    out = fr.with_columns(z=safe_div(F.col("spread") - F.col("mean"), F.col("sd"), 0.0),
                          half_life=half_life_of(F.col("_s")), _ok=F.col("_rn") >= window).body()
    return out.filter("_ok").drop("_ok", "_l", "_d", "_s")

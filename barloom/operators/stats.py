"""Statistics of a whole series: one row per key, by mergeable aggregates.

All inputs are long tables with a value or return column. Moments come from
power sums so a hot key is combined map-side; only path measures (drawdown,
runs) use the block layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clamp, log_growth, safe_div
from ..plans.blocks import Series, framed, islands, tail
from ..plans.rank import at_ranks, linear_percentiles
from ..sources.views import BAR_KEY, BAR_SERIES

RF, PERIODS = 0.05, 365
INF = float("inf")


def mean_sd(df: DataFrame, x: str, key=BAR_KEY) -> DataFrame:
    return df.groupBy(*key).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
                                F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"),
                                F.count(x).alias("n_obs"))


def z_score(df: DataFrame, x: str, key=BAR_KEY) -> DataFrame:
    """Each row's value against the mean and sample sd of its series."""
    m = mean_sd(df, x, key)
    return df.join(m, list(key)).withColumn("z", safe_div(F.col(x) - F.col("mean"), F.col("sd"), 0.0))


def sharpe_col(r: Column, rf: float = RF, periods: int = PERIODS) -> Column:
    sd = F.stddev_samp(r)
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise(
        (F.avg(r) - rf / periods) / sd * periods ** 0.5)


def sortino_col(r: Column, rf: float = RF, periods: int = PERIODS) -> Column:
    """Downside is the sample sd of the returns below rf/N; infinite when it is 0 or has no rows."""
    low = F.when(r < rf / periods, r)
    down = F.coalesce(F.stddev_samp(low), F.lit(0.0))
    return F.when(down == 0, F.lit(INF)).otherwise((F.avg(r) - rf / periods) / down * periods ** 0.5)


def skew_col(r: Column) -> Column:
    """Adjusted G1 from power sums with the sample sd; 0 below three rows."""
    n, m, sd = F.count(r), F.avg(r), F.stddev_samp(r)
    third = F.sum(r * r * r) - 3 * m * F.sum(r * r) + 2 * n * m * m * m
    return F.when((n < 3) | (sd == 0), 0.0).otherwise(n * third / (sd * sd * sd) / ((n - 1) * (n - 2)))


def kurt_col(r: Column) -> Column:
    """mean(z^4) - 3 with z by the sample sd; 0 below four rows."""
    n, m, sd = F.count(r), F.avg(r), F.stddev_samp(r)
    fourth = (F.sum(r * r * r * r) - 4 * m * F.sum(r * r * r) + 6 * m * m * F.sum(r * r)
              - 3 * n * m * m * m * m)
    return F.when((n < 4) | (sd == 0), 0.0).otherwise(fourth / (n * sd * sd * sd * sd) - 3)


def series_stats(rets: DataFrame, key=BAR_KEY, r: str = "ret", rf: float = RF,
                 periods: int = PERIODS) -> DataFrame:
    """Mean, deviation, Sharpe, Sortino, skewness, kurtosis and annual volatility in one pass."""
    c = F.col(r)
    return rets.groupBy(*key).agg(
        F.count(c).alias("n_obs"), F.avg(c).alias("mean"),
        F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"), sharpe_col(c, rf, periods).alias("sharpe"),
        sortino_col(c, rf, periods).alias("sortino"), skew_col(c).alias("skewness"),
        kurt_col(c).alias("kurtosis"),
        (F.coalesce(F.stddev_samp(c), F.lit(0.0)) * periods ** 0.5).alias("annualized_vol"))


def value_at_risk(rets: DataFrame, value: float, confidence: float = 0.95, horizon: float = 1,
                  key=BAR_KEY) -> DataFrame:
    z = 2.326 if confidence == 0.99 else 1.645
    return rets.groupBy(*key).agg(
        (F.coalesce(F.stddev_samp("ret"), F.lit(0.0)) * value * z * horizon ** 0.5).alias("var"))


def drawdown_series(df: DataFrame, x: str = "close", series: Series = BAR_SERIES) -> DataFrame:
    """Running peak and (value - peak) / peak per row."""
    fr = framed(df, series, carry={"peak": ("max", F.col(x))})
    fr = fr.with_columns(peak=fr.running("peak", "max", F.col(x)))
    return fr.with_columns(drawdown=safe_div(F.col(x) - F.col("peak"), F.col("peak"), 0.0)).body()


def max_drawdown(df: DataFrame, x: str = "close", series: Series = BAR_SERIES) -> DataFrame:
    """Largest fall from a running peak with the times of peak and trough (earliest on ties)."""
    at = -F.unix_micros(series.order[0])
    top = F.struct(F.col(x).alias("v"), at.alias("t"))
    fr = framed(df, series, carry={"top": ("max", top)})
    rows = fr.with_columns(_top=fr.running("top", "max", top)).body()
    dd = safe_div(F.col("_top.v") - F.col(x), F.col("_top.v"), 0.0)
    rows = rows.withColumn("dd", dd)
    worst = F.max_by(F.struct(F.col("_top.t").alias("p"), at.alias("t")), F.struct("dd", at.alias("t")))
    return rows.groupBy(*series.key).agg(F.max("dd").alias("max_drawdown"), worst.alias("w")).select(
        *series.key, "max_drawdown", F.timestamp_micros(-F.col("w.p")).alias("peak_ts"),
        F.timestamp_micros(-F.col("w.t")).alias("trough_ts"))


def calmar(bars: DataFrame, rets: DataFrame, periods: int = PERIODS, series: Series = BAR_SERIES) -> DataFrame:
    """Annualised compound return over the maximum drawdown; infinite without drawdown."""
    g = rets.groupBy(*series.key).agg(F.sum(log_growth(1 + F.col("ret"))).alias("_l"), F.count("ret").alias("_n"))
    dd = max_drawdown(bars, "close", series).select(*series.key, "max_drawdown")
    annual = F.exp(F.col("_l") * periods / F.col("_n")) - 1
    return g.join(dd, list(series.key)).withColumn("annual_return", annual).withColumn(
        "calmar", safe_div(F.col("annual_return"), F.col("max_drawdown"), INF)).drop("_l", "_n")


def against(rets: DataFrame, benchmark: DataFrame, key=BAR_KEY) -> DataFrame:
    """Returns joined to a benchmark return on ts: columns ret and bench."""
    return rets.join(benchmark.select("ts", F.col("ret").alias("bench")), "ts")


def benchmark_stats(joined: DataFrame, key=BAR_KEY, rf: float = RF, periods: int = PERIODS) -> DataFrame:
    """Correlation, beta, alpha, information ratio, tracking error and capture ratios in one pass."""
    r, b = F.col("ret"), F.col("bench")
    active = r - b
    te = F.coalesce(F.stddev_samp(active), F.lit(0.0))
    var = F.coalesce(F.var_samp(b), F.lit(0.0))
    beta = F.when((F.count(r) < 2) | (var == 0), 1.0).otherwise(F.covar_samp(r, b) / var)

    def capture(on: Column) -> Column:
        bench = F.avg(F.when(on, b))
        return F.coalesce(F.when(bench != 0, F.avg(F.when(on, r)) / bench), F.lit(0.0))

    return joined.groupBy(*key).agg(
        F.count(r).alias("n_obs"), F.coalesce(F.corr(r, b), F.lit(0.0)).alias("correlation"),
        beta.alias("beta"),
        ((F.avg(r) - rf / periods) - beta * (F.avg(b) - rf / periods)).alias("alpha"),
        F.when(te == 0, 0.0).otherwise(F.avg(active) / te).alias("information_ratio"),
        te.alias("tracking_error"), capture(b > 0).alias("up_capture"), capture(b < 0).alias("down_capture"))


def market_return(rets: DataFrame) -> DataFrame:
    """Equal-weight mean return per ts, a benchmark every table can give."""
    return rets.groupBy("ts").agg(F.avg("ret").alias("ret"))


def vol_percentile(rets: DataFrame, window: int = 30, lookback: int = 252,
                   series: Series = BAR_SERIES) -> DataFrame:
    """Share of the trailing window vols strictly below the newest one; .5 when too short."""
    t = tail(rets, series, window + lookback)
    t = t.with_columns(v=F.when(F.col("_rn") >= window, F.stddev_samp("ret").over(t.rows(-(window - 1)))))
    t = t.with_columns(cur=F.max(F.when(F.col("_rn") == F.col("_n"), F.col("v"))).over(
        Window.partitionBy(*t.parts)))
    share = F.avg(F.when(F.col("v") < F.col("cur"), 1.0).when(F.col("v").isNotNull(), 0.0))
    return t.df.groupBy(*series.key).agg(
        F.when(F.max("_n") < window + lookback, 0.5).otherwise(share).alias("percentile"))


def tail_ratio(rets: DataFrame, p: float = 0.05, key=BAR_KEY) -> DataFrame:
    """|upper| / |lower| nearest-rank tail value; 1 below 20 rows."""
    q = at_ranks(rets, key, "ret", {"hi": lambda n: F.floor(n * (1 - p)), "lo": lambda n: F.floor(n * p)})
    return q.withColumn("tail_ratio", F.when(F.col("n") < 20, 1.0).otherwise(
        safe_div(F.abs("hi"), F.abs("lo"), INF)))


def trade_stats(pnls: DataFrame, key, x: str = "pnl") -> DataFrame:
    """Win rate, profit factor, expectancy and payoff of a table of closed trades."""
    p = F.col(x)
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))
    wr = F.avg(F.when(p > 0, 1.0).otherwise(0.0))
    aw = F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0))
    al = F.coalesce(F.avg(F.when(p < 0, -p)), F.lit(0.0))
    return pnls.groupBy(*key).agg(
        F.count(p).alias("n"), wr.alias("win_rate"),
        F.when(loss == 0, F.lit(INF)).otherwise(gain / loss).alias("profit_factor"), aw.alias("avg_win"), al.alias("avg_loss"),
        (wr * aw - (1 - wr) * al).alias("expectancy"))


def max_consecutive_losses(pnls: DataFrame, series: Series, x: str = "pnl") -> DataFrame:
    runs = islands(pnls.withColumn("_loss", F.col(x) < 0), series, "_loss")
    n = runs.groupBy(*series.key, "run_id").agg(F.sum(F.col("_loss").cast("long")).alias("k"))
    return n.groupBy(*series.key).agg(F.coalesce(F.max("k"), F.lit(0)).alias("max_losses"))


def regression_slope(df: DataFrame, x: str = "close", series: Series = BAR_SERIES) -> DataFrame:
    fr = framed(df, series).body(keep_rn=True)
    return fr.groupBy(*series.key).agg(F.coalesce(F.regr_slope(F.col(x), F.col("_rn") - 1), F.lit(0.0))
                                       .alias("slope"))


def coef_variation(df: DataFrame, x: str = "close", key=BAR_KEY) -> DataFrame:
    return df.groupBy(*key).agg(safe_div(F.coalesce(F.stddev_samp(x), F.lit(0.0)), F.abs(F.avg(x)), INF)
                                .alias("cv"))


def benchmark_return(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    o = F.struct(*series.order)
    first = F.min_by("close", o)
    return bars.groupBy(*series.key).agg(((F.max_by("close", o) - first) / first).alias("total_return"))


def historical_vol(rets: DataFrame, periods: int = 365, key=BAR_KEY) -> DataFrame:
    return rets.groupBy(*key).agg((F.stddev_samp("ret") * periods ** 0.5).alias("vol"))


def realized_vol(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Root mean squared log return; .02 when there is none."""
    fr = framed(bars, series, lookback=1)
    lr = fr.with_columns(_p=F.lag("close").over(fr.w)).body().withColumn("lr", F.ln(F.col("close") / F.col("_p")))
    return lr.groupBy(*series.key).agg(
        F.coalesce(F.sqrt(F.avg(F.col("lr") * F.col("lr"))), F.lit(0.02)).alias("realized_vol"))


def vwap_window(bars: DataFrame, n: int = 20, series: Series = BAR_SERIES) -> DataFrame:
    """Volume-weighted close of the last n bars, deviation of the last close, signal at +-2 %."""
    t = tail(bars, series, n).df
    last = F.max(F.when(F.col("_rn") == F.col("_n"), F.col("close")))
    vol = F.sum("volume")
    vwap = F.when(vol != 0, F.sum(F.col("close") * F.col("volume")) / vol)
    g = t.groupBy(*series.key).agg(vwap.alias("vwap"), last.alias("last"))
    dev = (F.col("last") - F.col("vwap")) / F.col("vwap") * 100
    return g.withColumn("deviation_pct", dev).withColumn(
        "signal", F.when(dev > 2, "above").when(dev < -2, "below").otherwise("near"))


def pnl_report(fills: DataFrame, key=("exchange",)) -> DataFrame:
    cost = F.coalesce(F.col("cost"), F.col("amount") * F.col("price"), F.lit(0.0))
    buy = F.sum(F.when(F.col("side") == "buy", cost).otherwise(0.0))
    sell = F.sum(F.when(F.col("side") == "sell", cost).otherwise(0.0))
    fee = F.sum(F.coalesce(F.col("fee"), F.lit(0.0)))
    return fills.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_trades"), buy.alias("buy_notional"), sell.alias("sell_notional"),
        fee.alias("fees"), (sell - buy - fee).alias("realized_pnl"),
        F.sort_array(F.collect_set("symbol")).alias("symbols"))


def pnl_attribution(fills: DataFrame, by: str = "strategy", since=None) -> DataFrame:
    group = {"symbol": F.col("symbol"), "strategy": F.coalesce("strategy", F.lit("unknown")),
             "day": F.to_date("ts").cast("string"), "hour": F.hour("ts").cast("string")}[by]
    if since is not None:
        fills = fills.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    cost = F.coalesce("cost", F.lit(0.0))
    sign = F.when(F.col("side") == "sell", cost).otherwise(-cost)
    return fills.groupBy(group.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum(sign).alias("pnl"),
        F.sum(F.coalesce("fee", F.lit(0.0))).alias("fees"))


def latency_stats(calls: DataFrame, key=("method",), n: int = 1000, series: Series | None = None) -> DataFrame:
    """Per method over its last n samples: mean, range, p50/p95/p99 by nearest rank, error share."""
    t = tail(calls, series or Series(tuple(key), ("seq",), lambda: F.floor(F.col("seq") / 100_000)), n)
    by_val = Window.partitionBy(*key).orderBy("duration_ms", "_rn")
    r = t.df.withColumn("_k", F.row_number().over(by_val) - 1)
    at = lambda p: F.max(F.when(F.col("_k") == F.floor(F.col("_n") * p), F.col("duration_ms")))
    return r.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("duration_ms").alias("avg"), F.min("duration_ms").alias("min"),
        F.max("duration_ms").alias("max"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"),
        F.max(F.when(F.col("_rn") == F.col("_n"), F.col("duration_ms"))).alias("last"),
        (F.avg(F.col("is_error").cast("double")) * 100).alias("error_pct"))


def funding_stats(rates: DataFrame, series: Series, x: str = "rate", per_day: int = 3) -> DataFrame:
    """Level, spread, sign share and sign runs of a funding series."""
    r = F.col(x)
    g = rates.groupBy(*series.key).agg(
        F.avg(r).alias("mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sd"), F.min(r).alias("min"),
        F.max(r).alias("max"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("positive_share"),
        (F.avg(r) * per_day * 365).alias("annualized"))
    med = linear_percentiles(rates, series.key, x, {"median": 0.5}).drop("n")
    runs = islands(rates.withColumn("_pos", r >= 0), series, "_pos").groupBy(*series.key, "run_id", "_pos").agg(
        F.count(F.lit(1)).alias("k"))
    k = runs.groupBy(*series.key).agg(
        F.coalesce(F.max(F.when(F.col("_pos"), F.col("k"))), F.lit(0)).alias("longest_positive"),
        F.coalesce(F.max(F.when(~F.col("_pos"), F.col("k"))), F.lit(0)).alias("longest_negative"),
        F.max_by(F.when(F.col("_pos"), F.col("k")).otherwise(-F.col("k")), "run_id").alias("current_run"))
    return g.join(med, list(series.key)).join(k, list(series.key))


def dispersion_breadth(panel: DataFrame, key=("ts",)) -> DataFrame:
    """Breadth per ts over columns change, above_ma (boolean) and volume."""
    c, v = F.col("change"), F.col("volume")
    up, down = F.sum(F.when(c > 0, 1).otherwise(0)), F.sum(F.when(c < 0, 1).otherwise(0))
    n = F.count(F.lit(1))
    all_vol = F.sum(v)
    g = panel.groupBy(*key).agg(
        n.alias("n"), up.alias("advancers"), down.alias("decliners"),
        F.coalesce(F.avg(F.col("above_ma").cast("double")), F.lit(0.5)).alias("above_ma_pct"),
        F.when(all_vol == 0, 0.0).otherwise(F.sum(c * v) / all_vol).alias("weighted_change"))
    ratio = F.when(F.col("decliners") == 0, F.when(F.col("advancers") > 0, F.lit(INF)).otherwise(1.0)) \
        .otherwise(F.col("advancers") / F.col("decliners"))
    pct = F.col("advancers") / F.col("n")
    wc = F.col("weighted_change")
    return (g.withColumn("ad_ratio", ratio).withColumn("ad_line", F.col("advancers") - F.col("decliners"))
            .withColumn("positive_pct", pct).withColumn("thrust", pct > 0.8)
            .withColumn("divergence", F.when((wc > 0) & (pct < 0.4), "bearish_divergence")
                        .when((wc < 0) & (pct > 0.6), "bullish_divergence").otherwise("none")))

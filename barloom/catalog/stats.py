"""Whole-series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import returns as R
from ..operators import stats as S
from ..plans.blocks import Series, time_series
from ..sources import views as V
from .base import query
from .sql import BARS, RETS, ctes


def rets(spark, d):
    return R.returns_series(V.bars(spark, d))


_SERIES_SQL = """SELECT symbol, count(ret) AS n_obs, avg(ret) AS mean, stddev_samp(ret) AS sd,
  (avg(ret)-.05/365)/stddev_samp(ret)*sqrt(365) AS sharpe,
  (avg(ret)-.05/365)/stddev_samp(ret) FILTER (ret < .05/365)*sqrt(365) AS sortino,
  count(*)*sum(power((ret-m)/s,3))/((count(*)-1)*(count(*)-2)) AS skewness,
  avg(power((ret-m)/s,4))-3 AS kurtosis, stddev_samp(ret)*sqrt(365) AS annualized_vol
  FROM (SELECT *, avg(ret) OVER (PARTITION BY symbol) m, stddev_samp(ret) OVER (PARTITION BY symbol) s FROM rets)
  GROUP BY 1"""
for _name, _cols in {
        "mean_stddev": "mean:6 sd:6 n_obs", "sharpe": "sharpe:6", "sortino": "sortino:6",
        "skewness": "skewness:6", "kurtosis": "kurtosis:5", "annualized_vol": "annualized_vol:6",
        "series_stats": "n_obs mean:6 sd:6 sharpe:6 sortino:6 skewness:6 kurtosis:5 annualized_vol:6"}.items():
    query(_name, "symbol " + _cols, _SERIES_SQL, RETS)(lambda spark, d: S.series_stats(rets(spark, d)))

_BENCH = "mk AS (SELECT ts, avg(ret) AS bench FROM rets GROUP BY 1), j AS (SELECT * FROM rets JOIN mk USING (ts))"
_BENCH_SQL = """SELECT symbol, count(*) AS n_obs, corr(ret, bench) AS correlation,
  covar_samp(ret, bench)/var_samp(bench) AS beta,
  (avg(ret)-.05/365) - covar_samp(ret, bench)/var_samp(bench)*(avg(bench)-.05/365) AS alpha,
  avg(ret-bench)/stddev_samp(ret-bench) AS information_ratio, stddev_samp(ret-bench) AS tracking_error,
  avg(ret) FILTER (bench>0)/avg(bench) FILTER (bench>0) AS up_capture,
  avg(ret) FILTER (bench<0)/avg(bench) FILTER (bench<0) AS down_capture FROM j GROUP BY 1"""
for _name in ("correlation", "beta", "alpha", "information_ratio", "tracking_error", "up_capture",
              "down_capture"):
    query(_name, f"symbol n_obs {_name}:6", _BENCH_SQL, ctes("rets", more=_BENCH))(
        lambda spark, d: (lambda r: S.benchmark_stats(S.against(r, S.market_return(r))))(rets(spark, d)))


@query("z_score", "symbol ts z:6",
       """SELECT symbol, ts, (close-avg(close) OVER w)/stddev_samp(close) OVER w AS z FROM bars
          WINDOW w AS (PARTITION BY symbol)""", BARS)
def _(spark, d):
    return S.z_score(V.bars(spark, d), "close")


@query("simple_returns", "symbol ts ret:6", "SELECT symbol, ts, close/prev-1 AS ret FROM rets", RETS)
def _(spark, d):
    return rets(spark, d)


@query("value_at_risk", "symbol var:2",
       "SELECT symbol, 100000*2.326*stddev_samp(ret)*sqrt(10) AS var FROM rets GROUP BY 1", RETS)
def _(spark, d):
    return S.value_at_risk(rets(spark, d), 100_000, 0.99, 10)


_DD = """dd AS (SELECT *, max(close) OVER w AS peak,
  (max(close) OVER w - close)/max(close) OVER w AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 wd AS (SELECT symbol, max(dd) AS max_drawdown, arg_max(ts, ROW(dd, -epoch_us(ts))) AS trough_ts,
  arg_max(peak, ROW(dd, -epoch_us(ts))) AS pk FROM dd GROUP BY 1)"""


@query("max_drawdown", "symbol max_drawdown:6 peak_ts trough_ts",
       """SELECT wd.symbol, max_drawdown, min(b.ts) AS peak_ts, trough_ts FROM wd JOIN bars b
          ON b.symbol = wd.symbol AND b.close = pk AND b.ts <= trough_ts GROUP BY 1,2,4""",
       ctes("bars", more=_DD))
def _(spark, d):
    return S.max_drawdown(V.bars(spark, d))


@query("drawdown_series", "symbol ts peak:2 drawdown:6",
       "SELECT symbol, ts, peak, (close-peak)/peak AS drawdown FROM dd", ctes("bars", more=_DD))
def _(spark, d):
    return S.drawdown_series(V.bars(spark, d))


@query("calmar", "symbol annual_return:6 calmar:6",
       """SELECT symbol, a AS annual_return, a/max_drawdown AS calmar FROM (
          SELECT symbol, pow(product(1+ret), 365.0/count(*))-1 AS a FROM rets GROUP BY 1) JOIN wd USING (symbol)""",
       ctes("rets", more=_DD))
def _(spark, d):
    b = V.bars(spark, d)
    return S.calmar(b, R.returns_series(b))


@query("vol_percentile", "symbol percentile:6",
       """SELECT symbol, CASE WHEN count(*) < 282 THEN .5 ELSE
            avg(CASE WHEN v < cur THEN 1.0 ELSE 0.0 END) FILTER (k <= 253) END AS percentile FROM (
          SELECT *, first(v) OVER (PARTITION BY symbol ORDER BY k) AS cur FROM (
          SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k,
           stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) AS v FROM rets)) GROUP BY 1""",
       RETS)
def _(spark, d):
    return S.vol_percentile(rets(spark, d))


@query("tail_ratio", "symbol n tail_ratio:6",
       """SELECT symbol, count(*) AS n, abs(list_sort(list(ret))[CAST(floor(count(*)*(1-.05)) AS BIGINT)+1])
          / abs(list_sort(list(ret))[CAST(floor(count(*)*.05) AS BIGINT)+1]) AS tail_ratio FROM rets GROUP BY 1""",
       RETS)
def _(spark, d):
    return S.tail_ratio(rets(spark, d))


_PNL = """pnl AS (SELECT symbol, ts, close-open AS pnl FROM bars)"""
_PNL_SQL = """SELECT symbol, count(*) AS n, avg(CASE WHEN pnl>0 THEN 1.0 ELSE 0.0 END) AS win_rate,
  sum(pnl) FILTER (pnl>0)/abs(sum(pnl) FILTER (pnl<0)) AS profit_factor,
  avg(CASE WHEN pnl>0 THEN 1.0 ELSE 0.0 END)*avg(pnl) FILTER (pnl>0)
   - (1-avg(CASE WHEN pnl>0 THEN 1.0 ELSE 0.0 END))*abs(avg(pnl) FILTER (pnl<0)) AS expectancy FROM pnl GROUP BY 1"""


def pnls(spark, d):
    return V.bars(spark, d).withColumn("pnl", F.col("close") - F.col("open"))


for _name, _dig in (("win_rate", 6), ("profit_factor", 6), ("expectancy", 2)):
    query(_name, f"symbol n {_name}:{_dig}", _PNL_SQL, ctes("bars", more=_PNL))(
        lambda spark, d: S.trade_stats(pnls(spark, d), ("symbol",)))


@query("max_consecutive_losses", "symbol max_losses",
       """SELECT symbol, max(k) AS max_losses FROM (SELECT symbol, g, count(*) FILTER (pnl<0) AS k FROM (
          SELECT *, sum(CASE WHEN pnl >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS g
          FROM pnl) GROUP BY 1,2) GROUP BY 1""", ctes("bars", more=_PNL))
def _(spark, d):
    return S.max_consecutive_losses(pnls(spark, d), V.BAR_SERIES)


@query("regression_slope", "symbol slope:4",
       """SELECT symbol, regr_slope(close, rn) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY symbol
          ORDER BY ts) AS rn FROM bars) GROUP BY 1""", BARS)
def _(spark, d):
    return S.regression_slope(V.bars(spark, d))


@query("coef_variation", "symbol cv:6",
       "SELECT symbol, stddev_samp(close)/abs(avg(close)) AS cv FROM bars GROUP BY 1", BARS)
def _(spark, d):
    return S.coef_variation(V.bars(spark, d))


@query("benchmark_return", "symbol total_return:6",
       "SELECT symbol, arg_max(close,ts)/arg_min(close,ts)-1 AS total_return FROM bars GROUP BY 1", BARS)
def _(spark, d):
    return S.benchmark_return(V.bars(spark, d))


@query("historical_vol", "symbol vol:6", "SELECT symbol, stddev_samp(ret)*sqrt(365) AS vol FROM rets GROUP BY 1", RETS)
def _(spark, d):
    return S.historical_vol(rets(spark, d))


@query("realized_vol", "symbol realized_vol:6",
       "SELECT symbol, sqrt(avg(power(ln(close/prev),2))) AS realized_vol FROM rets GROUP BY 1", RETS)
def _(spark, d):
    return S.realized_vol(V.bars(spark, d))


@query("vwap_window", "symbol vwap:2 last:2 deviation_pct:4 signal",
       """SELECT *, CASE WHEN deviation_pct > 2 THEN 'above' WHEN deviation_pct < -2 THEN 'below' ELSE 'near' END
          AS signal FROM (SELECT symbol, sum(close*volume)/sum(volume) AS vwap, arg_max(close, ts) AS last,
          (arg_max(close, ts)/(sum(close*volume)/sum(volume))-1)*100 AS deviation_pct FROM (
          SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20) GROUP BY 1)""",
       BARS)
def _(spark, d):
    return S.vwap_window(V.bars(spark, d))


@query("pnl_report", "exchange n_trades buy_notional:2 sell_notional:2 fees:2 realized_pnl:2 symbols",
       """SELECT exchange, count(*) AS n_trades, sum(cost) FILTER (side='buy') AS buy_notional,
          sum(cost) FILTER (side='sell') AS sell_notional, sum(fee) AS fees,
          sum(cost) FILTER (side='sell') - sum(cost) FILTER (side='buy') - sum(fee) AS realized_pnl,
          list_sort(list(DISTINCT symbol)) AS symbols FROM fills GROUP BY 1""", ctes("fills"))
def _(spark, d):
    return S.pnl_report(V.fills(spark, d))


_ATTR = """SELECT {g} AS bucket, count(*) AS n_trades, sum(CASE WHEN side='sell' THEN cost ELSE -cost END) AS pnl,
   sum(fee) AS fees FROM fills GROUP BY 1"""
query("pnl_attribution", "bucket n_trades pnl:2 fees:2", _ATTR.format(g="strategy"), ctes("fills"))(
    lambda spark, d: S.pnl_attribution(V.fills(spark, d), "strategy"))
query("pnl_attribution_daily", "bucket n_trades pnl:2 fees:2",
      _ATTR.format(g="strftime(ts, '%Y-%m-%d')"), ctes("fills"))(
    lambda spark, d: S.pnl_attribution(V.fills(spark, d), "day"))


@query("latency_stats", "method n avg:6 min:4 max:4 p50:4 p95:4 p99:4 last:4 error_pct:6",
       """SELECT method, count(*) AS n, avg(v) AS avg, min(v) AS min, max(v) AS max,
          list_sort(list(v))[CAST(floor(count(*)*.5) AS BIGINT)+1] AS p50,
          list_sort(list(v))[CAST(floor(count(*)*.95) AS BIGINT)+1] AS p95,
          list_sort(list(v))[CAST(floor(count(*)*.99) AS BIGINT)+1] AS p99, arg_max(v, seq) AS last,
          avg(CASE WHEN user_id % 10 = 0 THEN 100.0 ELSE 0 END) AS error_pct FROM (
          SELECT event_type AS method, event_id AS seq, value AS v, user_id FROM events
          QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 1000) GROUP BY 1""")
def _(spark, d):
    e = V.table(spark, d, "events").select(
        F.col("event_type").alias("method"), F.col("event_id").alias("seq"),
        F.col("value").alias("duration_ms"), (F.col("user_id") % 10 == 0).alias("is_error"))
    return S.latency_stats(e)


# Funding rates: hourly mean of the tick value against its hourly mid, signed around its level.
FUNDING = """funding AS MATERIALIZED (SELECT symbol, venue, date_trunc('hour', ts) AS ts,
  avg(CASE WHEN side='buy' THEN price-110 ELSE 90-price END)/100000 AS rate, max(price) AS mark,
  avg(price) AS idx, min(fee) AS taker_fee FROM ticks GROUP BY 1,2,3)"""
FUND_SERIES = time_series(("symbol", "venue"), ("ts",), bucket_seconds=7 * 86_400)


def funding(spark, d):
    p = F.col("price")
    return V.ticks(spark, d).groupBy("symbol", "venue", F.date_trunc("hour", "ts").alias("ts")).agg(
        (F.avg(F.when(F.col("side") == "buy", p - 110).otherwise(90 - p)) / 100000).alias("rate"),
        F.max(p).alias("mark"), F.avg(p).alias("idx"), F.min("fee").alias("taker_fee"))


@query("funding_stats", "symbol venue mean:9 sd:9 min:9 max:9 positive_share:6 annualized:6 median:9 "
       "longest_positive longest_negative current_run",
       """SELECT * FROM (SELECT symbol, venue, avg(rate) AS mean, stddev_samp(rate) AS sd, min(rate) AS min,
           max(rate) AS max, avg(CASE WHEN rate>0 THEN 1.0 ELSE 0 END) AS positive_share,
           avg(rate)*3*365 AS annualized, median(rate) AS median FROM funding GROUP BY 1,2)
         JOIN (SELECT symbol, venue, coalesce(max(k) FILTER (p),0) AS longest_positive,
           coalesce(max(k) FILTER (NOT p),0) AS longest_negative,
           arg_max(CASE WHEN p THEN k ELSE -k END, t) AS current_run
           FROM (SELECT symbol, venue, p, g, count(*) AS k, max(ts) AS t FROM (
             SELECT *, rate>=0 AS p, row_number() OVER (PARTITION BY symbol, venue ORDER BY ts)
              - row_number() OVER (PARTITION BY symbol, venue, rate>=0 ORDER BY ts) AS g FROM funding)
             GROUP BY 1,2,3,4) GROUP BY 1,2) USING (symbol, venue)""",
       ctes("ticks", more=FUNDING))
def _(spark, d):
    return S.funding_stats(funding(spark, d), FUND_SERIES)


@query("dispersion_breadth", "ts n advancers decliners ad_ratio:6 ad_line positive_pct:6 above_ma_pct:6 thrust divergence",
       """SELECT *, advancers-decliners AS ad_line, advancers/n AS positive_pct, advancers/n > .8 AS thrust,
          CASE WHEN decliners = 0 THEN NULL ELSE advancers/decliners END AS ad_ratio,
          CASE WHEN wc>0 AND advancers/n < .4 THEN 'bearish_divergence'
               WHEN wc<0 AND advancers/n > .6 THEN 'bullish_divergence' ELSE 'none' END AS divergence FROM (
          SELECT ts, count(*) AS n, CAST(count(*) FILTER (close>prev) AS BIGINT) AS advancers,
           CAST(count(*) FILTER (close<prev) AS BIGINT) AS decliners,
           coalesce(avg(CASE WHEN ma IS NULL THEN NULL WHEN close>ma THEN 1.0 ELSE 0.0 END), .5) AS above_ma_pct,
           sum((close/prev-1)*volume)/sum(volume) AS wc FROM (
            SELECT *, CASE WHEN rn>=20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) END
             AS ma FROM b0) WHERE prev IS NOT NULL GROUP BY 1)""", RETS)
def _(spark, d):
    p = I.with_sma(V.bars(spark, d), 20, extra_return=True).filter(F.col("change").isNotNull())
    p = p.withColumn("above_ma", F.when(F.col("sma_20").isNotNull(), F.col("close") > F.col("sma_20")))
    return S.dispersion_breadth(p)

"""Frame indicators and recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import signed
from ..operators import indicators as I
from ..operators import recurrent as C
from ..operators import returns as R
from ..plans.blocks import time_series
from ..sources import views as V
from .base import query
from .sql import BARS, RETS, ctes
from .stats import FUND_SERIES, FUNDING, funding

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"

query("sma", "symbol ts sma_20:2", f"""SELECT symbol, ts, CASE WHEN row_number() OVER w >= 20 THEN avg(close)
   OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) END AS sma_20 FROM bars {_W}""", BARS)(
    lambda s, d: I.with_sma(V.bars(s, d), 20))

BB = """bb AS (SELECT *, CASE WHEN rn>=20 THEN avg(close) OVER w END AS bb_mid,
  CASE WHEN rn>=20 THEN stddev_pop(close) OVER w END AS bb_sd FROM b0
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))"""
query("bollinger", "symbol ts bb_mid:2 bb_upper:2 bb_lower:2 bb_width:6",
      """SELECT symbol, ts, bb_mid, bb_mid+2*bb_sd AS bb_upper, bb_mid-2*bb_sd AS bb_lower,
         4*bb_sd/bb_mid AS bb_width FROM bb""", ctes("rets", more=BB))(lambda s, d: I.bollinger(V.bars(s, d)))

ATR = """tr AS (SELECT *, CASE WHEN rn>1 THEN greatest(high-low, abs(high-prev), abs(low-prev)) END AS tr FROM b0),
 atr AS (SELECT *, CASE WHEN rn>=15 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) END AS atr
  FROM tr)"""
query("true_range_atr", "symbol ts tr:2 atr:2", "SELECT symbol, ts, tr, atr FROM atr", ctes("rets", more=ATR))(
    lambda s, d: I.true_range_atr(V.bars(s, d)))

STO = """sk AS (SELECT *, CASE WHEN rn>=14 THEN CASE WHEN max(high) OVER w = min(low) OVER w THEN 50 ELSE
   (close-min(low) OVER w)/(max(high) OVER w-min(low) OVER w)*100 END END AS stoch_k FROM b0
   WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)),
 sto AS (SELECT *, CASE WHEN rn>=16 THEN avg(stoch_k) OVER (PARTITION BY symbol ORDER BY ts ROWS 2 PRECEDING) END
   AS stoch_d FROM sk)"""
query("stochastic", "symbol ts stoch_k:4 stoch_d:4", "SELECT symbol, ts, stoch_k, stoch_d FROM sto",
      ctes("rets", more=STO))(lambda s, d: I.stochastic(V.bars(s, d)))

query("obv", "symbol ts obv:2", """SELECT symbol, ts, sum(CASE WHEN close>prev THEN volume WHEN close<prev
   THEN -volume ELSE 0 END) OVER w AS obv FROM b0 """ + _W, RETS)(lambda s, d: I.obv(V.bars(s, d)))
query("vwap_running", "symbol ts vwap:2",
      f"SELECT symbol, ts, sum((high+low+close)/3*volume) OVER w/sum(volume) OVER w AS vwap FROM bars {_W}",
      BARS)(lambda s, d: I.vwap_running(V.bars(s, d)))
query("volume_spike", "symbol ts spike:6",
      """SELECT symbol, ts, avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)
         /avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 62 PRECEDING) AS spike FROM bars""", BARS)(
    lambda s, d: I.volume_spike(V.bars(s, d)))

query("regime_stats", "symbol ts mean:6 sd:6 skew:5 kurt:5 annual_vol:5 regime",
      """SELECT symbol, ts, mean, sd, list_avg(list_transform(l, lambda x: power((x-mean)/sd, 3))) AS skew,
          list_avg(list_transform(l, lambda x: power((x-mean)/sd, 4)))-3 AS kurt, sd*sqrt(365) AS annual_vol,
          CASE WHEN sd*sqrt(365)>.8 THEN 'crisis' WHEN sd*sqrt(365)>.5 THEN 'high-volatility'
           WHEN abs(mean)>sd/2 THEN CASE WHEN mean>0 THEN 'trending-up' ELSE 'trending-down' END
           ELSE 'mean-reverting' END AS regime FROM (
          SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, avg(ret) OVER w AS mean,
           stddev_samp(ret) OVER w AS sd, list(ret) OVER w AS l FROM rets
          WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)) WHERE k >= 20""", RETS)(
    lambda s, d: I.regime_stats(R.returns_series(V.bars(s, d))))

query("cvd", "symbol seq delta:2 cvd:2",
      """SELECT symbol, seq, CASE WHEN side='buy' THEN volume ELSE -volume END AS delta,
         sum(CASE WHEN side='buy' THEN volume ELSE -volume END) OVER (PARTITION BY symbol ORDER BY ts, seq) AS cvd
         FROM ticks""", ctes("ticks"))(
    lambda s, d: I.cumulative(V.ticks(s, d).withColumn("delta", signed(F.col("side"), F.col("volume"))),
                              F.col("delta"), "cvd", V.TICK_SERIES))

query("bb_squeeze", "symbol bandwidth:4 avg_bw:4 ratio:6 squeeze squeeze_bars above_middle",
      """SELECT symbol, arg_max(bw, ts) AS bandwidth, any_value(ab) AS avg_bw, arg_max(bw, ts)/any_value(ab) AS ratio,
          arg_max(bw, ts)/any_value(ab) < .5 AS squeeze, arg_max(close > bb_mid, ts) AS above_middle,
          count(*) FILTER (ts > coalesce(st, TIMESTAMP '1900-01-01')) AS squeeze_bars FROM (
          SELECT *, max(ts) FILTER (bw/ab >= .5) OVER (PARTITION BY symbol) AS st FROM (
           SELECT *, 400*bb_sd/bb_mid AS bw, avg(400*bb_sd/bb_mid) OVER (PARTITION BY symbol) AS ab FROM bb
           WHERE rn>=20)) GROUP BY 1""", ctes("rets", more=BB))(lambda s, d: I.bb_squeeze(V.bars(s, d)))

query("mean_reversion_scan", "symbol last:2 mean:2 sd:2 z:6 deviation_pct:4 signal",
      """SELECT *, (last-mean)/sd AS z, (last-mean)/mean*100 AS deviation_pct,
          CASE WHEN (last-mean)/sd < -1 THEN 'oversold' WHEN (last-mean)/sd > 1 THEN 'overbought' ELSE 'neutral' END
          AS signal FROM (SELECT symbol, arg_max(close, ts) AS last, avg(close) AS mean, stddev_samp(close) AS sd
          FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20) GROUP BY 1)""",
      BARS)(lambda s, d: I.mean_reversion_scan(V.bars(s, d), 20, 1.0))


def two_frames(s, d):
    """Weekly bars plus the same symbols resampled to months, labelled 1d for the period table."""
    b = V.bars(s, d)
    return b.unionByName(I.resample(b, "1d", "month"))


TWO = """mb AS (SELECT symbol, exchange, '1d' AS "interval", date_trunc('month', ts) AS ts, 'stock' AS asset_type,
  arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
  FROM bars GROUP BY symbol, exchange, date_trunc('month', ts)),
 two AS MATERIALIZED (SELECT * FROM bars UNION ALL SELECT * FROM mb)"""

query("vol_term_structure", "symbol interval vol:6 ratio:6 structure",
      """SELECT symbol, "interval", vol, vol/nxt AS ratio,
          CASE WHEN sum(CASE WHEN nxt>vol THEN 1 WHEN nxt IS NULL THEN 0 ELSE -1 END) OVER (PARTITION BY symbol) > 0
           THEN 'normal' ELSE 'inverted' END AS structure FROM (
         SELECT *, lead(vol) OVER (PARTITION BY symbol ORDER BY per DESC) AS nxt FROM (
          SELECT symbol, "interval", CASE WHEN "interval"='1d' THEN 365 ELSE 52 END AS per,
           stddev_samp(close/p-1)*sqrt(CASE WHEN "interval"='1d' THEN 365 ELSE 52 END) AS vol FROM (
           SELECT *, lag(close) OVER (PARTITION BY symbol, "interval" ORDER BY ts) AS p FROM two) GROUP BY 1,2,3))""",
      ctes("bars", more=TWO))(lambda s, d: I.vol_term_structure(two_frames(s, d)))

query("vol_regime", "symbol atr:2 avg_atr:2 ratio:6 regime",
      """SELECT *, atr/avg_atr AS ratio, CASE WHEN atr/avg_atr>1.5 THEN 'high' WHEN atr/avg_atr<.7 THEN 'low'
          ELSE 'normal' END AS regime FROM (SELECT symbol, arg_max(atr, ts) AS atr,
          avg(atr) FILTER (rn > n-100) AS avg_atr FROM atr GROUP BY 1)""", ctes("rets", more=ATR))(
    lambda s, d: I.vol_regime(V.bars(s, d)))

# Social volume: trades per symbol and hour with the hour's last price.
HOURLY = """hourly AS (SELECT symbol, date_trunc('hour', ts) AS ts, CAST(count(*) AS DOUBLE) AS social_volume,
  arg_max(price, ROW(ts, seq)) AS price, avg(CASE WHEN side='buy' THEN price ELSE 200-price END) AS value,
  sum(volume) AS volume FROM ticks GROUP BY 1,2)"""
HOUR_SERIES = time_series(("symbol",), ("ts",), bucket_seconds=7 * 86_400)


def hourly(s, d):
    t = V.ticks(s, d)
    return t.groupBy("symbol", F.date_trunc("hour", "ts").alias("_h")).agg(
        F.count(F.lit(1)).cast("double").alias("social_volume"),
        F.max_by("price", F.struct("ts", "seq")).alias("price"),
        F.avg(F.when(F.col("side") == "buy", F.col("price")).otherwise(200 - F.col("price"))).alias("value"),
        F.sum("volume").alias("volume")).withColumnRenamed("_h", "ts")


query("social_volume", "symbol z:6 spikes price_corr:6 divergence",
      """SELECT symbol, arg_max(z, ts) AS z, CAST(count(*) FILTER (z>2) AS BIGINT) AS spikes, corr(dv, dp) AS price_corr,
          avg(z) FILTER (k<=3) > 1.5 AND max(price) FILTER (k=1)/max(price) FILTER (k=3)-1 < 0 AS divergence FROM (
          SELECT *, (social_volume-avg(social_volume) OVER p)/stddev_samp(social_volume) OVER p AS z,
           social_volume/lag(social_volume) OVER o-1 AS dv, price/lag(price) OVER o-1 AS dp,
           row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM hourly
          WINDOW p AS (PARTITION BY symbol), o AS (PARTITION BY symbol ORDER BY ts)) GROUP BY 1""",
      ctes("ticks", more=HOURLY))(lambda s, d: I.social_volume(hourly(s, d), HOUR_SERIES))

query("sentiment_momentum", "symbol ts momentum:9 acceleration:9 crossover trend",
      """SELECT *, momentum-pm AS acceleration, coalesce((pm<=0 AND momentum>0) OR (pm>=0 AND momentum<0), false)
          AS crossover, CASE WHEN momentum>1 THEN 'improving' WHEN momentum<-1 THEN 'deteriorating' ELSE 'stable' END
          AS trend FROM (SELECT symbol, ts, m AS momentum, lag(m) OVER (PARTITION BY symbol ORDER BY ts) AS pm FROM (
          SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k,
           avg(value) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)
           - avg(value) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS m FROM hourly) WHERE k>=20)""",
      ctes("ticks", more=HOURLY))(lambda s, d: I.sentiment_momentum(hourly(s, d), HOUR_SERIES))


# --- recurrences: the expected values walk rows one by one in a recursive CTE
def recursion(src: str, init: str, step: str, name: str = "rec") -> str:
    return (f"{name} AS (SELECT p.*, {init} FROM {src} p WHERE rn = 1 UNION ALL SELECT p.*, {step} "
            f"FROM {name} r JOIN {src} p ON p.symbol = r.symbol AND p.rn = r.rn + 1)")


def ema_step(p: int, x: str = "close", start: int = 1, name: str = "e") -> str:
    return (f"CASE WHEN p.rn < {start + p - 1} THEN NULL WHEN p.rn = {start + p - 1} THEN p.m_{name} "
            f"ELSE r.{name} + (p.{x} - r.{name}) * 2.0 / {p + 1} END")


def means(**cols) -> str:
    return ", ".join(f"avg({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS {p - 1} PRECEDING) AS m_{n}"
                     for n, (x, p) in cols.items())


NUL = "CAST(NULL AS DOUBLE)"
EMA_PRE = f"pre AS MATERIALIZED (SELECT *, {means(e12=('close', 12), e26=('close', 26), e20=('close', 20))} FROM b0)"
EMA_REC = recursion("pre", f"{NUL} AS e12, {NUL} AS e26, {NUL} AS e20",
                    ", ".join(ema_step(p, name=f"e{p}") for p in (12, 26, 20)))
MACD = f"""{EMA_PRE}, {EMA_REC},
 mp AS MATERIALIZED (SELECT symbol, ts, rn, n, close, e20, macd, {means(sig=('macd', 9))} FROM (SELECT *, e12-e26 AS macd FROM rec)),
 {recursion("mp", f"{NUL} AS sig", ema_step(9, "macd", 26, "sig"), "mrec")},
 mac AS MATERIALIZED (SELECT symbol, ts, rn, n, close, e20, macd, sig AS macd_signal, macd-sig AS macd_hist FROM mrec)"""
query("ema", "symbol ts ema_12:3 ema_26:3", "SELECT symbol, ts, e12 AS ema_12, e26 AS ema_26 FROM rec",
      ctes("rets", more=f"{EMA_PRE}, {EMA_REC}", recursive=True))(lambda s, d: C.ema(V.bars(s, d), 12, 26))
query("macd", "symbol ts macd:3 macd_signal:3 macd_hist:3", "SELECT symbol, ts, macd, macd_signal, macd_hist FROM mac",
      ctes("rets", more=MACD, recursive=True))(lambda s, d: C.macd(V.bars(s, d)))

RSI = f"""gp AS (SELECT *, greatest(close-prev,0) AS gain, greatest(prev-close,0) AS loss FROM b0),
 gl AS MATERIALIZED (SELECT *, {means(g=('gain', 14), l=('loss', 14))} FROM gp),
 {recursion("gl", f"{NUL} AS g, {NUL} AS l",
            "CASE WHEN p.rn<15 THEN NULL WHEN p.rn=15 THEN p.m_g ELSE (r.g*13+p.gain)/14 END, "
            "CASE WHEN p.rn<15 THEN NULL WHEN p.rn=15 THEN p.m_l ELSE (r.l*13+p.loss)/14 END", "rrec")},
 rsi AS MATERIALIZED (SELECT symbol, ts, rn, n, CASE WHEN l=0 THEN 100 ELSE 100-100/(1+g/l) END AS rsi FROM rrec)"""
query("rsi_wilder", "symbol ts rsi:5", "SELECT symbol, ts, rsi FROM rsi", ctes("rets", more=RSI, recursive=True))(
    lambda s, d: C.rsi(V.bars(s, d)))

ADX = f"""ap0 AS (SELECT *, high-lag(high) OVER w AS up, lag(low) OVER w-low AS dn,
  greatest(high-low, abs(high-prev), abs(low-prev)) AS t FROM b0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 ap1 AS (SELECT *, CASE WHEN up>dn THEN greatest(up,0) ELSE 0 END AS pd, CASE WHEN dn>up THEN greatest(dn,0) ELSE 0 END
  AS md FROM ap0),
 ap AS MATERIALIZED (SELECT *, 14*avg(t) OVER w AS st, 14*avg(pd) OVER w AS sp, 14*avg(md) OVER w AS sm FROM ap1
  WHERE rn>1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)),
 ap2 AS MATERIALIZED (SELECT * REPLACE (rn-1 AS rn) FROM ap),
 {recursion("ap2", f"{NUL} AS a, {NUL} AS b, {NUL} AS c",
            ", ".join(f"CASE WHEN p.rn<14 THEN NULL WHEN p.rn=14 THEN p.{s} ELSE r.{v}-r.{v}/14+p.{x} END"
                      for v, s, x in (("a", "st", "t"), ("b", "sp", "pd"), ("c", "sm", "md"))), "arec")},
 dx AS (SELECT symbol, ts, rn+1 AS rn, n, b/a*100 AS plus_di, c/a*100 AS minus_di, CASE WHEN a IS NOT NULL THEN
  CASE WHEN b+c=0 THEN 0 ELSE abs(b-c)/(b+c)*100 END END AS dx FROM arec),
 adx AS MATERIALIZED (SELECT *, CASE WHEN rn>=28 THEN avg(dx) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)
  END AS adx FROM dx)"""
query("adx", "symbol ts plus_di:5 minus_di:5 dx:5 adx:5",
      """SELECT b.symbol, b.ts, plus_di, minus_di, dx, adx FROM b0 b LEFT JOIN adx a ON a.symbol=b.symbol AND a.ts=b.ts""",
      ctes("rets", more=ADX, recursive=True))(lambda s, d: C.adx(V.bars(s, d)))

query("ewma_vol", "symbol ts ewma_vol:6", "SELECT symbol, ts, sqrt(v) AS ewma_vol FROM vrec",
      ctes("rets", more="rr AS MATERIALIZED (SELECT symbol, ts, ret, rn-1 AS rn FROM rets), "
           + recursion("rr", "ret*ret AS v", ".94*r.v+(1-.94)*p.ret*p.ret", "vrec"), recursive=True))(
    lambda s, d: C.ewma_vol(R.returns_series(V.bars(s, d))))

query("funding_predict", "symbol venue predicted:9 confidence:6 upper:9 lower:9",
      """SELECT symbol, venue, p AS predicted, greatest(0, least(1, 1-s/(abs(m)+s))) AS confidence, p+2*s AS upper,
          p-2*s AS lower FROM (SELECT symbol, venue, sum(rate*power(.5,(k-1)/12))/sum(power(.5,(k-1)/12)) AS p,
          avg(rate) AS m, stddev_samp(rate) AS s FROM (SELECT *, row_number() OVER (PARTITION BY symbol, venue
          ORDER BY ts DESC) AS k FROM funding) WHERE k<=96 GROUP BY 1,2)""", ctes("ticks", more=FUNDING))(
    lambda s, d: C.funding_predict(funding(s, d), FUND_SERIES))

GRID = """gr AS (SELECT a*.02::DOUBLE AS a, b*.04::DOUBLE AS b FROM range(1,21) x(a), range(1,21) y(b)
  WHERE a*2+b*4 < 100),
 uv AS (SELECT symbol, avg(ret*ret) AS uv, list(ret*ret ORDER BY ts) AS l, count(*) AS n_obs FROM rets GROUP BY 1),
 rr AS MATERIALIZED (SELECT symbol, ret*ret AS r2, rn-1 AS rn FROM rets),
 grec AS (SELECT symbol, 0::BIGINT AS rn, a, b, uv, uv AS v, 0::DOUBLE AS ll FROM uv, gr UNION ALL
  SELECT g.symbol, p.rn, g.a, g.b, g.uv, g.uv*(1-g.a-g.b)+g.a*p.r2+g.b*g.v,
   g.ll-.5*(ln(2*pi())+ln(g.v)+p.r2/g.v) FROM grec g JOIN rr p ON p.symbol=g.symbol AND p.rn=g.rn+1),
 gbest AS (SELECT symbol, arg_max(ROW(a,b,ll,v), ROW(round(ll,9),-a,-b)) AS w FROM grec JOIN uv USING (symbol)
  WHERE rn=n_obs GROUP BY 1)"""
query("garch11_fit", "symbol alpha:4 beta:4 omega:6 ll:4 forecast_vol:6 persistence:4 n_obs",
      """SELECT symbol, w[1] AS alpha, w[2] AS beta, uv*(1-w[1]-w[2]) AS omega, w[3] AS ll, sqrt(w[4]) AS forecast_vol,
         w[1]+w[2] AS persistence, n_obs FROM gbest JOIN uv USING (symbol)""",
      ctes("rets", more=GRID, recursive=True))(lambda s, d: C.garch11_fit(R.returns_series(V.bars(s, d))))


def index_pairs(s, d):
    """Every symbol's close against the mean close of all symbols at the same time."""
    b = V.bars(s, d)
    m = b.groupBy("ts").agg(F.avg("close").alias("b"))
    return b.select(*V.BAR_KEY, "ts", F.col("close").alias("a")).join(m, "ts")


PAIRS = """pr AS MATERIALIZED (SELECT symbol, ts, close AS a, avg(close) OVER (PARTITION BY ts) AS b, rn FROM b0)"""
query("kalman_hedge", "symbol ts ratio:6 confidence:6",
      "SELECT symbol, ts, x AS ratio, greatest(0, least(1, 1-sqrt(pp))) AS confidence FROM krec WHERE rn>0",
      ctes("rets", more=PAIRS + """, ks AS (SELECT symbol, regr_slope(a,b) AS x FROM pr WHERE rn<=20 GROUP BY 1),
 krec AS (SELECT symbol, TIMESTAMP '1900-01-01' AS ts, 0::BIGINT AS rn, x, 1::DOUBLE AS pp FROM ks UNION ALL
  SELECT p.symbol, p.ts, p.rn, r.x + (r.pp+1e-5)*p.b/(p.b*p.b*(r.pp+1e-5)+1e-3)*(p.a-r.x*p.b),
   (1-(r.pp+1e-5)*p.b*p.b/(p.b*p.b*(r.pp+1e-5)+1e-3))*(r.pp+1e-5)
  FROM krec r JOIN pr p ON p.symbol=r.symbol AND p.rn=r.rn+1)""", recursive=True))(
    lambda s, d: C.kalman_hedge(index_pairs(s, d), V.BAR_SERIES))

HURST = """hx AS (SELECT symbol, ret, rn-1 AS k, n-1 AS m FROM rets),
 hs AS (SELECT symbol, lag, (k-1)//lag AS seg, list(ret ORDER BY k) AS l FROM hx, range({lo}, {hi}) t(lag) {where}
  GROUP BY 1,2,3 HAVING count(*) = lag),
 hr AS (SELECT symbol, lag, (list_max(c)-list_min(c))/sd AS rs FROM (SELECT symbol, lag,
   {sd}(l) AS sd, list_transform(range(1, lag+1), lambda i: list_sum(l[1:i])-i*list_avg(l)) AS c FROM hs) WHERE sd>0)"""
query("hurst_rs", "symbol n hurst:6",
      """SELECT symbol, n, greatest(0, least(1, regr_slope(ln(v), ln(lag)))) AS hurst FROM (
         SELECT symbol, lag, avg(rs) AS v FROM hr GROUP BY 1,2) JOIN (SELECT symbol, max(m) AS n FROM hx GROUP BY 1)
         USING (symbol) GROUP BY 1,2""",
      ctes("rets", more=HURST.format(lo=2, hi=21, where="", sd="list_stddev_pop")))(
    lambda s, d: C.hurst_rs(R.returns_series(V.bars(s, d))))
query("hurst_exponent", "symbol n_obs hurst:6 r_squared:6 regime",
      """SELECT *, CASE WHEN hurst>.55 THEN 'trending' WHEN hurst<.45 THEN 'mean_reverting' ELSE 'random_walk' END
         AS regime FROM (SELECT symbol, n AS n_obs, greatest(0, least(1, regr_slope(ln(v), ln(lag)))) AS hurst,
         regr_r2(ln(v), ln(lag)) AS r_squared FROM (
         SELECT symbol, lag, sum(rs)/(n//lag) AS v, n FROM hr JOIN (SELECT symbol, max(m) AS n FROM hx GROUP BY 1)
         USING (symbol) WHERE lag <= n//2 GROUP BY symbol, lag, n) GROUP BY 1,2)""",
      ctes("rets", more=HURST.format(lo=10, hi=2000, sd="list_stddev_samp",
                                     where="WHERE lag IN (10,15,22,33,49,73,109,163,244,366)")))(
    lambda s, d: C.hurst_exponent(R.returns_series(V.bars(s, d))))

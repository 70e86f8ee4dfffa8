"""Alignment, pair correlations, profiles and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import returns as R
from ..plans.blocks import time_series
from ..sources import views as V
from .base import ORACLES, query
from .indicators import PAIRS, index_pairs
from .sql import BARS, RETS, ctes
from .stats import FUNDING, funding, rets

COMMON = """al AS MATERIALIZED (SELECT * FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY 1 HAVING
  count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars)))"""
query("pivot_align", "symbol ts close:2", "SELECT symbol, ts, close FROM al", ctes("bars", more=COMMON))(
    lambda s, d: A.pivot_align(V.bars(s, d)))

query("rolling_correlation_matrix", "ts a b corr:6",
      """SELECT ts, a, b, c AS corr FROM (SELECT x.ts, x.symbol AS a, y.symbol AS b,
          coalesce(corr(x.ret, y.ret) OVER (PARTITION BY x.symbol, y.symbol ORDER BY x.ts ROWS 29 PRECEDING), 0) AS c,
          row_number() OVER (PARTITION BY x.symbol, y.symbol ORDER BY x.ts) AS k
         FROM ar x JOIN ar y ON x.ts = y.ts AND x.symbol < y.symbol) WHERE k >= 30 AND (k-30) % 10 = 0""",
      ctes("bars", more=COMMON + """, ar AS MATERIALIZED (SELECT symbol, ts, ret FROM (SELECT symbol, ts,
        close/lag(close) OVER (PARTITION BY symbol ORDER BY ts)-1 AS ret FROM al) WHERE ret IS NOT NULL)"""))(
    lambda s, d: A.rolling_correlation_matrix(V.bars(s, d), 30, 10))

PAIRC = """pc AS MATERIALIZED (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.ret, y.ret) AS corr
  FROM rets x JOIN rets y ON x.ts = y.ts AND x.symbol <= y.symbol GROUP BY 1,2)"""
query("pairwise_correlations", "a b n corr:6", "SELECT * FROM pc WHERE a < b AND abs(corr) >= .02",
      ctes("rets", more=PAIRC))(lambda s, d: A.pairwise_correlations(rets(s, d), 0.02))
query("correlation_matrix", "a b corr:6", """SELECT a, b, CASE WHEN a=b THEN 1 ELSE corr END AS corr FROM pc
  UNION ALL SELECT b, a, corr FROM pc WHERE a<b""", ctes("rets", more=PAIRC))(
    lambda s, d: A.correlation_matrix(rets(s, d), blocks=3))
query("correlation_clusters", "n_pairs avg_corr:6 n_high risk_score:2 status",
      """SELECT *, least(100, floor(n_high*100/n_pairs+.5)) AS risk_score, CASE WHEN n_high*100/n_pairs > 60.5 THEN
          'HIGH_RISK' WHEN n_high*100/n_pairs > 30.5 THEN 'MODERATE' ELSE 'DIVERSIFIED' END AS status FROM (
         SELECT count(*) AS n_pairs, avg(corr) AS avg_corr, CAST(count(*) FILTER (abs(corr)>=.05) AS BIGINT) AS n_high
         FROM pc WHERE a<b)""", ctes("rets", more=PAIRC))(lambda s, d: A.correlation_clusters(rets(s, d), 0.05))

query("rolling_beta", "symbol ts beta:6 alpha:6 r_squared:6",
      """SELECT symbol, ts, regr_slope(ra, rb) OVER w AS beta, avg(ra) OVER w - regr_slope(ra, rb) OVER w*avg(rb) OVER w
          AS alpha, greatest(regr_r2(ra, rb) OVER w, 0) AS r_squared FROM (SELECT symbol, ts, rn, a/lag(a) OVER p-1 AS ra,
          b/lag(b) OVER p-1 AS rb FROM pr WINDOW p AS (PARTITION BY symbol ORDER BY ts))
         WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) QUALIFY rn > 30""",
      ctes("rets", more=PAIRS))(
    lambda s, d: A.rolling_beta(V.bars(s, d), V.bars(s, d).groupBy("ts").agg(F.avg("close").alias("close"))))

query("correlation_regime", "symbol n avg_corr:6 min_corr:2 max_corr:2 flips corr:2 regime",
      """SELECT symbol, count(*) AS n, avg(c) AS avg_corr, min(c) AS min_corr, max(c) AS max_corr,
          CAST(count(*) FILTER ((p>=0 AND c<0) OR (p<0 AND c>=0)) AS BIGINT) AS flips, arg_max(c, ts) AS corr,
          CASE WHEN arg_max(c, ts)>.7 THEN 'strongly_correlated' WHEN arg_max(c, ts)>.3 THEN 'moderately_correlated'
           WHEN arg_max(c, ts)>=-.3 THEN 'uncorrelated' ELSE 'negatively_correlated' END AS regime FROM (
         SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM (
          SELECT symbol, ts, rn, floor(corr(ra, rb) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)*100+.5)/100
           AS c FROM (SELECT symbol, ts, rn, a/lag(a) OVER p-1 AS ra, b/lag(b) OVER p-1 AS rb FROM pr
           WINDOW p AS (PARTITION BY symbol ORDER BY ts))) WHERE rn>20) GROUP BY 1""", ctes("rets", more=PAIRS))(
    lambda s, d: A.correlation_regime(index_pairs(s, d), V.BAR_SERIES, 20))

query("cross_symbol_stats", "symbol n_obs total_return_pct:2 mean_pct:2 vol_pct:2 sharpe:2 sortino:2 max_drawdown_pct:2",
      """SELECT *, 100*dd AS max_drawdown_pct FROM (SELECT symbol, count(*) AS n_obs,
         (arg_max(close, ts)/arg_min(prev, ts)-1)*100 AS total_return_pct, avg(ret)*100 AS mean_pct,
         stddev_samp(ret)*sqrt(365)*100 AS vol_pct, avg(ret)/stddev_samp(ret)*sqrt(365) AS sharpe,
         avg(ret)/stddev_samp(ret) FILTER (ret<0)*sqrt(365) AS sortino FROM rets GROUP BY 1) JOIN (
         SELECT symbol, max((pk-close)/pk) AS dd FROM (SELECT symbol, close, max(close) OVER (PARTITION BY symbol
          ORDER BY ts) AS pk FROM bars) GROUP BY 1) USING (symbol)""", RETS)(
    lambda s, d: A.cross_symbol_stats(V.bars(s, d)))


def venue_panel(s, d):
    return funding(s, d).select("symbol", "venue", "ts", F.col("idx").alias("price"))


query("lead_lag_join", "symbol a b corr:6 lag leader",
      """SELECT symbol, a, b, max(c) FILTER (lag=0) AS corr, arg_max(lag, ROW(round(abs(c),9), -abs(lag), lag)) AS lag,
          CASE WHEN arg_max(lag, ROW(round(abs(c),9), -abs(lag), lag)) >= 0 THEN a ELSE b END AS leader FROM (
         SELECT x.symbol, x.venue AS a, y.venue AS b, y.rn-x.rn AS lag, corr(x.idx, y.idx) AS c FROM al x JOIN al y
          ON x.symbol=y.symbol AND x.venue<y.venue AND abs(y.rn-x.rn) <= least(10, x.n//4) GROUP BY 1,2,3,4) GROUP BY 1,2,3""",
      ctes("ticks", more=FUNDING + """, al AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY ts)
        AS rn, count(*) OVER (PARTITION BY symbol)//4 AS n FROM (SELECT *, count(*) OVER (PARTITION BY symbol, ts) AS k
        FROM funding) WHERE k=4)"""))(lambda s, d: A.lead_lag(venue_panel(s, d)))

query("price_discovery", "symbol leader leads",
      f"""SELECT symbol, arg_max(leader, ROW(k, leader)) AS leader, max(k) AS leads FROM (SELECT symbol, leader, count(*) AS k FROM
         ({ORACLES['lead_lag_join']}) GROUP BY 1,2) GROUP BY 1""")(lambda s, d: A.price_discovery(A.lead_lag(venue_panel(s, d))))

query("volume_profile", "symbol bin price:2 volume:2 poc value_area",
      """SELECT symbol, bin, lo+(bin+.5)*sz AS price, v AS volume, r=1 AS poc,
          coalesce(sum(v) OVER (PARTITION BY symbol ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           < .7*sum(v) OVER (PARTITION BY symbol) AS value_area FROM (
         SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v DESC, bin) AS r FROM (
         SELECT symbol, bin, lo, sz, floor(coalesce(sum(CASE WHEN high>low THEN volume*greatest(least(high, lo+(bin+1)*sz)
           -greatest(low, lo+bin*sz), 0)/(high-low) WHEN bin = least(floor((low-lo)/sz), 23) THEN volume END), 0)*100+.5)/100
           AS v FROM (SELECT *, min(low) OVER (PARTITION BY symbol) AS lo,
            (max(high) OVER (PARTITION BY symbol)-min(low) OVER (PARTITION BY symbol))/24 AS sz FROM bars),
           range(24) t(bin) GROUP BY 1,2,3,4))""", BARS)(lambda s, d: A.volume_profile(V.bars(s, d), 24))

query("param_grid", "p_brand fast slow n",
      """SELECT p_brand, fast, slow, count(*) AS n FROM part, (SELECT unnest([5,10,20]) AS fast),
         (SELECT unnest([30,50]) AS slow) GROUP BY 1,2,3""")(
    lambda s, d: V.table(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "g", F.explode(F.flatten(F.transform(F.array(*[F.lit(x) for x in (5, 10, 20)]), lambda f: F.transform(
            F.array(F.lit(30), F.lit(50)), lambda w: F.struct(f.alias("fast"), w.alias("slow")))))))
    .select("p_brand", "g.fast", "g.slow", "n"))

query("asof_trades_quotes", "symbol venue seq bid:4 ask:4",
      """SELECT t.symbol, t.venue, t.seq, q.bid, q.ask FROM ticks t ASOF LEFT JOIN quotes q
          ON t.symbol=q.symbol AND t.venue=q.venue AND t.ts >= q.ts""", ctes("quotes"))(
    lambda s, d: A.asof_trades_quotes(V.ticks(s, d), V.quotes(s, d), V.VENUE_SERIES))

"""Time-series tests and pair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators import tseries as T
from ..sources import views as V
from .align import COMMON
from .base import query
from .indicators import PAIRS, index_pairs
from .sql import BARS, RETS, ctes
from .stats import rets

ACF = """rc AS (SELECT symbol, ts, ret, ret-avg(ret) OVER (PARTITION BY symbol) AS y, rn, n-1 AS n FROM rets),
 ac AS MATERIALIZED (SELECT a.symbol, any_value(a.n) AS n, k AS lag, sum(a.y*b.y)/(SELECT sum(y*y) FROM rc z WHERE z.symbol=a.symbol) AS acf
  FROM rc a, range(0, 41) t(k), rc b WHERE b.symbol=a.symbol AND b.rn=a.rn+k AND k <= least(40, a.n//4) GROUP BY a.symbol, k)"""
query("acf", "symbol lag acf:6 band:6 significant",
      "SELECT symbol, lag, acf, 1.96/sqrt(n) AS band, lag>0 AND abs(acf)>1.96/sqrt(n) AS significant FROM ac",
      ctes("rets", more=ACF))(lambda s, d: T.acf(rets(s, d)).withColumn("lag", F.col("lag").cast("long")))
PACF = """pl AS (SELECT symbol, any_value(n) AS n, list(acf ORDER BY lag) AS r FROM ac GROUP BY 1),
 dl AS (SELECT symbol, n, r, 1::BIGINT AS k, [r[2]] AS phi, r[2] AS v FROM pl UNION ALL SELECT symbol, n, r, k+1,
   list_concat(list_transform(range(1, k+1), lambda i: phi[i]-nv*phi[k+1-i]), [nv]), nv FROM (SELECT *,
   (r[k+2]-list_sum(list_transform(range(1, k+1), lambda i: phi[i]*r[k+2-i])))/(1-list_sum(list_transform(range(1, k+1),
   lambda i: phi[i]*r[i+1]))) AS nv FROM dl WHERE k+2 <= len(r)))"""
query("pacf", "symbol lag pacf:6 significant",
      """SELECT symbol, k AS lag, v AS pacf, abs(v)>1.96/sqrt(n) AS significant FROM dl UNION ALL
         SELECT symbol, 0, 1, false FROM pl""", ctes("rets", more=f"{ACF}, {PACF}", recursive=True))(
    lambda s, d: T.pacf(rets(s, d)).withColumn("lag", F.col("lag").cast("long")))

AR = """ar AS (SELECT symbol, count(*)+1 AS n, regr_slope(d, l) AS slope, regr_slope(d,l)/sqrt(greatest(regr_syy(d,l)
  -regr_sxy(d,l)*regr_sxy(d,l)/regr_sxx(d,l),0)/(count(*)-2)/regr_sxx(d,l)) AS t FROM (SELECT symbol, close-prev AS d,
  prev-avg(close) OVER (PARTITION BY symbol) AS l FROM b0 QUALIFY prev IS NOT NULL) GROUP BY 1)"""
query("adf_lag0", "symbol n statistic:5 p_value:6 stationary",
      """SELECT symbol, n, t AS statistic, CASE WHEN t<=-3.43-6/n THEN .005 WHEN t<=-2.86-2.74/n THEN .03 WHEN t<=-2.57-1.67/n
         THEN .07 ELSE least(1, .1+(t-(-2.57-1.67/n))*.15) END AS p_value, t < -2.86-2.74/n AS stationary FROM ar""",
      ctes("rets", more=AR))(lambda s, d: T.adf_lag0(V.bars(s, d)))
MK = """CASE WHEN {t}<=c1 THEN .005 WHEN {t}<=c5 THEN .01+({t}-c1)/(c5-c1)*.04 WHEN {t}<=c10 THEN .05+({t}-c5)/(c10-c5)*.05
  ELSE least(1, .1+({t}-c10)/abs(c10-c1)*.45) END"""
CV = "-3.4336-5.999/n-29.25/(n*n) AS c1, -2.8621-2.738/n-8.36/(n*n) AS c5, -2.5671-1.438/n-4.48/(n*n) AS c10"
query("adf_mackinnon", "symbol n statistic:5 p_value:6 cv_5:5 stationary",
      f"SELECT symbol, n, t AS statistic, {MK.format(t='t')} AS p_value, c5 AS cv_5, t<c5 AS stationary FROM (SELECT *, {CV} FROM ar)",
      ctes("rets", more=AR))(lambda s, d: T.adf_mackinnon(V.bars(s, d)))
query("half_life", "symbol n slope:6 half_life:5 mean_reverting",
      "SELECT symbol, n, slope, CASE WHEN slope<0 THEN -ln(2)/ln(1+slope) END AS half_life, slope<0 AS mean_reverting FROM ar",
      ctes("rets", more=AR))(lambda s, d: T.half_life(V.bars(s, d)))
query("cusum_breaks", "symbol index break_ts significance:6",
      """SELECT symbol, k-1 AS index, ts AS break_ts, c/.4 AS significance FROM (SELECT *, lag(c) OVER w AS p, lead(c) OVER w AS x,
         row_number() OVER w AS k FROM (SELECT symbol, ts, abs(sum((ret-m)/sd) OVER (PARTITION BY symbol ORDER BY ts))/sqrt(n) AS c
         FROM (SELECT symbol, ts, ret, avg(ret) OVER p AS m, stddev_samp(ret) OVER p AS sd, count(*) OVER p AS n FROM rets
          WINDOW p AS (PARTITION BY symbol))) WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE c>.4 AND c>=p AND c>=x""",
      RETS)(lambda s, d: T.cusum_breaks(rets(s, d), threshold=0.4))
query("variance_ratio", "symbol n period ratio:6 z:5 p_value:4",
      """SELECT *, 0 AS p_value FROM (SELECT symbol, n, q AS period, vq/(q*v1) AS ratio, (vq/(q*v1)-1)/sqrt(2*(2*q-1)*(q-1)/(3*q*(n-1.0)))
         AS z FROM (SELECT a.symbol, any_value(a.n) AS n, q, avg(power(a.close/b.close-1,2)) AS vq, (SELECT avg(ret*ret) FROM rets r
          WHERE r.symbol=a.symbol) AS v1 FROM b0 a, (SELECT unnest([2,5,10,20]) AS q), b0 b WHERE b.symbol=a.symbol AND b.rn=a.rn-q
         GROUP BY a.symbol, q))""", RETS)(
    lambda s, d: T.variance_ratio(V.bars(s, d)).withColumn("period", F.col("period").cast("int"))
    .withColumn("p_value", F.when(F.col("p_value").between(-1e-6, 1.0), 0.0).otherwise(F.col("p_value"))))

_W = 20
RCH = f"""ro AS (SELECT symbol, ts, close, rn, n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS v FROM b0
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS {_W - 1} PRECEDING)),
 ra AS (SELECT *, avg(v) OVER (PARTITION BY symbol) AS av, abs(v-lag(v) OVER o) AS dv, abs(m-lag(m) OVER o) AS dm FROM ro
  WHERE rn>={_W} WINDOW o AS (PARTITION BY symbol ORDER BY rn)),
 cd AS (SELECT symbol, any_value(av) AS av, list(rn ORDER BY rn) FILTER (dv/av>.3 OR dm/av>.6) AS c, any_value(n) AS n FROM ra GROUP BY 1),
 cp AS (SELECT symbol, av, n, list_distinct(list_concat(list_concat([1::BIGINT], coalesce(list_reduce(list_transform(c, lambda x: [x]),
   lambda a, x: CASE WHEN x[1]-a[len(a)] > {_W}/2 THEN list_concat(a, x) ELSE a END), []::BIGINT[])), [n])) AS e FROM cd),
 sg AS (SELECT symbol, av, unnest(list_transform(range(1, len(e)), lambda i: [i, list_sort(e)[i], list_sort(e)[i+1]])) AS s FROM cp),
 sd AS (SELECT b.symbol, s[1] AS seg, s[2] AS start, s[3] AS fin, av, b.rn, close, CASE WHEN b.rn>s[2] THEN close-prev END AS d
  FROM sg JOIN b0 b ON b.symbol=sg.symbol AND b.rn BETWEEN s[2] AND s[3]),
 sd2 AS (SELECT *, d-avg(d) OVER (PARTITION BY symbol, seg) AS dc FROM sd),
 sd3 AS (SELECT *, lag(dc) OVER (PARTITION BY symbol, seg ORDER BY rn) AS dl FROM sd2)"""
query("regime_change", "symbol seg start end_rn mean:2 vol:2 label",
      """SELECT *, CASE WHEN vol>1.3*av THEN 'high_vol' WHEN vol<.7*av THEN 'low_vol' WHEN kd<3 THEN 'low_vol' WHEN r1>.1 THEN 'trending'
         ELSE 'mean_reverting' END AS label FROM (SELECT symbol, seg, min(start) AS start, max(fin) AS end_rn, avg(close) AS mean,
         coalesce(stddev_samp(close), 0) AS vol, max(av) AS av, count(d) AS kd, sum(dc*dl)/sum(dc*dc) AS r1 FROM sd3 GROUP BY 1,2)""",
      ctes("rets", more=RCH))(
    lambda s, d: T.regime_change(V.bars(s, d), window=20, threshold=0.6).withColumn("seg", F.col("seg").cast("long"))
    .withColumnRenamed("end", "end_rn"))

# --- all pairs: the expected values come from a join of every pair on ts
PJ = COMMON + """, pp AS MATERIALIZED (SELECT x.symbol AS a, y.symbol AS b, x.ts, x.close AS pa, y.close AS pb FROM al x JOIN al y
  ON x.ts=y.ts AND x.symbol<y.symbol),
 ol AS MATERIALIZED (SELECT a, b, count(*) AS n, regr_slope(pa,pb) AS h, regr_intercept(pa,pb) AS i, regr_r2(pa,pb) AS r2, corr(pa,pb) AS corr,
   regr_syy(pa,pb) AS vaa, regr_sxx(pa,pb) AS vbb, regr_sxy(pa,pb) AS vab, avg(pa) AS ma, avg(pb) AS mb FROM pp GROUP BY 1,2),
 re AS (SELECT a, b, e, e-lag(e) OVER (PARTITION BY a, b ORDER BY ts) AS d, lag(e) OVER (PARTITION BY a, b ORDER BY ts) AS l FROM (
   SELECT a, b, ts, pa-i-h*pb AS e FROM pp JOIN ol USING (a, b))),
 eg AS MATERIALIZED (SELECT a, b, regr_slope(d,l) AS sl, regr_slope(d,l)/sqrt((regr_syy(d,l)-regr_sxy(d,l)*regr_sxy(d,l)/regr_sxx(d,l))
   /(count(d)-2)/regr_sxx(d,l)) AS t FROM re WHERE d IS NOT NULL GROUP BY 1,2),
 ps AS MATERIALIZED (SELECT *, t < c5-.25 AS co FROM (SELECT *, """ + CV + """ FROM ol JOIN eg USING (a, b)))"""
PCT = ctes("bars", more=PJ)
query("engle_granger", "a b n hedge:5 adf_stat:5 p_value:5 cointegrated",
      f"SELECT a, b, n, h AS hedge, t AS adf_stat, {MK.format(t='t')} AS p_value, co AS cointegrated FROM ps", PCT)(
    lambda s, d: P.engle_granger(V.bars(s, d)))
query("hedge_ratio", "a b n hedge:5 intercept:2 r2:6 hedge_tls:4 intercept_tls:0",
      """SELECT a, b, n, h AS hedge, i AS intercept, r2, tl AS hedge_tls, ma-tl*mb AS intercept_tls FROM (SELECT *,
         (vaa-vbb+sqrt((vaa-vbb)*(vaa-vbb)+4*vab*vab))/(2*vab) AS tl FROM ol)""", PCT)(lambda s, d: P.hedge_ratio(V.bars(s, d)))
query("score_pairs", "a b n corr:6 cointegrated adf_stat:5 half_life:5 score:4",
      """SELECT a, b, n, corr, co AS cointegrated, t AS adf_stat, hl AS half_life, CASE WHEN co THEN 40 ELSE 0 END+20*abs(corr)
         +CASE WHEN hl IS NULL THEN 0 WHEN hl BETWEEN 5 AND 100 THEN 30*(1-abs(hl-30)/70) WHEN hl<5 THEN 10 ELSE 5 END
         +greatest(0, least(10, -t-2)) AS score FROM (SELECT *, CASE WHEN sl<0 AND sl>-1 THEN -ln(2)/ln(1+sl) END AS hl FROM ps)""", PCT)(
    lambda s, d: P.score_pairs(V.bars(s, d)))
JO = """jd AS (SELECT a, b, pa-lag(pa) OVER w AS da, pb-lag(pb) OVER w AS db, lag(pa) OVER w AS la, lag(pb) OVER w AS lb FROM pp
   WINDOW w AS (PARTITION BY a, b ORDER BY ts)),
 jm AS (SELECT a, b, count(*) AS m, covar_pop(da,da) AS p, covar_pop(da,db) AS q, covar_pop(db,db) AS r, covar_pop(la,la) AS s,
   covar_pop(la,lb) AS t, covar_pop(lb,lb) AS u, covar_pop(da,la) AS w, covar_pop(da,lb) AS x, covar_pop(db,la) AS y, covar_pop(db,lb) AS z
   FROM jd WHERE da IS NOT NULL GROUP BY 1,2),
 -- F = S00^-1 S01, G = S11^-1 S10, M = G F
 jf AS (SELECT *, (r*w-q*y)/(p*r-q*q) AS f11, (r*x-q*z)/(p*r-q*q) AS f12, (p*y-q*w)/(p*r-q*q) AS f21, (p*z-q*x)/(p*r-q*q) AS f22,
   (u*w-t*x)/(s*u-t*t) AS g11, (u*y-t*z)/(s*u-t*t) AS g12, (s*x-t*w)/(s*u-t*t) AS g21, (s*z-t*y)/(s*u-t*t) AS g22 FROM jm),
 je AS (SELECT a, b, m, tr/2+sqrt(greatest(tr*tr/4-dt,0)) AS e1, tr/2-sqrt(greatest(tr*tr/4-dt,0)) AS e2 FROM (SELECT *,
   g11*f11+g12*f21+g21*f12+g22*f22 AS tr, (g11*g22-g12*g21)*(f11*f22-f12*f21) AS dt FROM jf))"""
query("johansen", "a b n eig1:6 eig2:6 trace1:3 trace2:3 rank",
      """SELECT *, CAST(CASE WHEN trace1<=15.41 THEN 0 WHEN trace2<=3.76 THEN 1 ELSE 2 END AS BIGINT) AS rank FROM (SELECT a, b, m+1 AS n,
         e1 AS eig1, e2 AS eig2, -m*(ln(1-e1)+ln(1-e2)) AS trace1, -m*ln(1-e2) AS trace2 FROM je)""",
      ctes("bars", more=f"{PJ}, {JO}"))(lambda s, d: P.johansen(V.bars(s, d)))

SPR = """hd AS (SELECT symbol, regr_slope(a,b) AS h FROM pr GROUP BY 1),
 sp AS MATERIALIZED (SELECT symbol, ts, rn, a-h*b AS s FROM pr JOIN hd USING (symbol))"""


def spreads(s, d):
    p = index_pairs(s, d)
    return P.with_spread(p, P.ols_hedges(p, V.BAR_SERIES), V.BAR_SERIES)


query("spread_zscore", "symbol spread:2 mean:2 sd:2 percentile:4 z:6",
      """SELECT *, (spread-mean)/sd AS z FROM (SELECT symbol, any_value(c) AS spread, avg(s) AS mean, stddev_samp(s) AS sd,
         avg(CASE WHEN s<=c THEN 100.0 ELSE 0 END) AS percentile FROM (SELECT *, first(s) OVER (PARTITION BY symbol ORDER BY ts DESC) AS c,
         row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM sp) WHERE k<=60 GROUP BY 1)""",
      ctes("rets", more=f"{PAIRS}, {SPR}"))(lambda s, d: P.spread_zscore(spreads(s, d), V.BAR_SERIES, 60))
ROLL = """rz AS (SELECT *, s-lag(s) OVER (PARTITION BY symbol ORDER BY ts) AS d, lag(s) OVER (PARTITION BY symbol ORDER BY ts) AS l FROM sp),
 rw AS MATERIALIZED (SELECT symbol, ts, s AS spread, avg(s) OVER w AS mean, stddev_samp(s) OVER w AS sd, (s-avg(s) OVER w)/stddev_samp(s) OVER w AS z,
  regr_slope(d, l) OVER (PARTITION BY symbol ORDER BY ts ROWS 28 PRECEDING) AS sl FROM rz
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) QUALIFY rn>=30)"""
query("rolling_spread", "symbol ts mean:2 sd:2 z:6 half_life:5",
      "SELECT *, CASE WHEN sl<0 AND sl>-1 THEN -ln(2)/ln(1+sl) END AS half_life FROM rw", ctes("rets", more=f"{PAIRS}, {SPR}, {ROLL}"))(
    lambda s, d: P.rolling_spread(spreads(s, d), V.BAR_SERIES, 30))
query("pair_signal", "symbol ts z:6 signal strength:6",
      """SELECT symbol, ts, z, CASE WHEN abs(z)>=4 THEN 'stop' WHEN z>=2 THEN 'short_spread' WHEN z<=-2 THEN 'long_spread' WHEN
         abs(z)<=.5 THEN 'exit' ELSE 'neutral' END AS signal, CASE WHEN abs(z)>=4 THEN least(1, abs(z)/4) WHEN abs(z)>=2 THEN
         least(1, (abs(z)-2)/2+.5) WHEN abs(z)<=.5 THEN 1-abs(z)/.5 ELSE 0 END AS strength FROM rw""",
      ctes("rets", more=f"{PAIRS}, {SPR}, {ROLL}"))(
    lambda s, d: (lambda r: r.withColumn("signal", P.pair_signal(F.col("z"))[0]).withColumn(
        "strength", P.pair_signal(F.col("z"))[1]))(P.rolling_spread(spreads(s, d), V.BAR_SERIES, 30)))

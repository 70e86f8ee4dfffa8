"""Trade stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ticks as K
from ..plans.blocks import time_series
from ..sources import views as V
from .base import ORACLES, query
from .indicators import HOUR_SERIES
from .sql import BARS, RETS, TICKS, ctes
from .stats import funding, FUNDING

QT = "qt AS MATERIALIZED (SELECT t.*, bid, ask, (bid+ask)/2 AS mid FROM ticks t JOIN quotes q ON q.venue=t.venue AND q.symbol=t.symbol AND q.ts=date_trunc('hour', t.ts))"


def quoted(s, d):
    """Trades with the quote of their venue and hour."""
    t = V.ticks(s, d).withColumn("h", F.date_trunc("hour", "ts"))
    q = V.quotes(s, d).select("venue", "symbol", F.col("ts").alias("h"), "bid", "ask")
    return t.join(q, ["venue", "symbol", "h"]).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


T = V.ticks
BS = "sum(CASE WHEN side='buy' THEN volume ELSE 0 END) AS b, sum(CASE WHEN side='sell' THEN volume ELSE 0 END) AS s"

query("footprint", "symbol level price:4 bid_volume:2 ask_volume:2 delta:2 total_volume:2 imbalance:6 poc",
      f"""SELECT symbol, level, level*.5 AS price, s AS bid_volume, b AS ask_volume, b-s AS delta, b+s AS total_volume,
         (b-s)/(b+s) AS imbalance, row_number() OVER (PARTITION BY symbol ORDER BY b+s DESC, level)=1 AS poc FROM (
         SELECT symbol, CAST(floor(price/.5+.5) AS BIGINT) AS level, {BS} FROM ticks GROUP BY 1,2)""", TICKS)(
    lambda s, d: K.footprint(T(s, d), 0.5))

def absorbed(s, d):
    return K.absorption(T(s, d), V.book_levels(s, d).groupBy("symbol", "price").agg(
        F.sum(F.when(F.col("side") == "bid", F.col("qty"))).alias("bid_qty"),
        F.sum(F.when(F.col("side") == "ask", F.col("qty"))).alias("ask_qty")), 3)


query("absorption", "symbol price:4 absorbed_volume:2 n_trades ts side strength:6",
      """SELECT g.symbol, g.price, v AS absorbed_volume, n_trades, g.ts, CASE WHEN coalesce(bq,0)>=coalesce(aq,0)
          THEN 'bid' ELSE 'ask' END AS side, least(v/(m*3), 5) AS strength FROM (SELECT symbol, price, sum(volume) AS v,
          count(*) AS n_trades, max(ts) AS ts FROM ticks GROUP BY 1,2) g JOIN (SELECT symbol, avg(volume) AS m,
          stddev_samp(volume) AS sd FROM ticks GROUP BY 1) a USING (symbol) JOIN (SELECT symbol, price,
          sum(qty) FILTER (side='bid') AS bq, sum(qty) FILTER (side='ask') AS aq FROM book GROUP BY 1,2) k
          ON k.symbol=g.symbol AND k.price=g.price WHERE n_trades>=3 AND v > m+2*sd AND greatest(coalesce(bq,0),
          coalesce(aq,0))>0""", ctes("ticks", "book"))(
    absorbed)
query("absorption_summary", "symbol total_absorbed:1 dominant_side",
      f"""SELECT symbol, sum(absorbed_volume) AS total_absorbed, CASE WHEN sum(CASE WHEN side='bid' THEN absorbed_volume ELSE 0 END)/sum(absorbed_volume)>.6
         THEN 'buyers' WHEN sum(CASE WHEN side='bid' THEN absorbed_volume ELSE 0 END)/sum(absorbed_volume)<.4 THEN 'sellers' ELSE 'balanced' END
         AS dominant_side FROM ({ORACLES['absorption']}) GROUP BY 1""")(lambda s, d: K.absorption_summary(absorbed(s, d)))
query("tick_side", "symbol seq side",
      """SELECT symbol, seq, CASE WHEN seq%3=0 THEN CASE WHEN price<lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) THEN 'sell' ELSE 'buy' END
         ELSE side END AS side FROM ticks""", ctes("ticks"))(
    lambda s, d: K.tick_side(T(s, d).withColumn("side", F.when(F.col("seq") % 3 != 0, F.col("side")))))

query("iceberg", "symbol side price:4 fill_count avg_fill:4 confidence:6 estimated_size:4 first_ts",
      """SELECT *, avg_fill*fill_count AS estimated_size FROM (SELECT symbol, side, arg_min(price, ROW(ts, seq)) AS price,
          count(*) AS fill_count, avg(volume) AS avg_fill, greatest(0, least(1, 1-stddev_samp(volume)/avg(volume)))
          AS confidence, min(ts) AS first_ts FROM (SELECT *, sum(nw) OVER (PARTITION BY symbol, side, band ORDER BY ts, seq)
          AS run FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts)-epoch_us(lag(ts) OVER w) > 7200000000
           THEN 1 ELSE 0 END AS nw FROM (SELECT *, floor(ln(price)/.01) AS band FROM ticks)
          WINDOW w AS (PARTITION BY symbol, side, band ORDER BY ts, seq))) GROUP BY symbol, side, band, run
          HAVING count(*)>=3) WHERE confidence > .3""", TICKS)(lambda s, d: K.iceberg(T(s, d), 3, 0.01, 7200))

query("aggressive_passive", "symbol aggressive_buy:2 aggressive_sell:2 passive_buy:2 passive_sell:2 aggressive_ratio:6 net_aggressive:2 signal",
      """SELECT *, ab-aa AS net_aggressive, ab AS aggressive_buy, aa AS aggressive_sell, pb AS passive_buy, ps AS passive_sell,
          (ab+aa)/t AS aggressive_ratio, CASE WHEN ab/t>.35 THEN 'aggressive_buying' WHEN aa/t>.35 THEN 'aggressive_selling'
          WHEN pb/t>.35 THEN 'passive_accumulation' WHEN ps/t>.35 THEN 'passive_distribution' ELSE 'balanced' END AS signal
         FROM (SELECT symbol, sum(volume) FILTER (NOT is_maker AND side='buy') AS ab, sum(volume) FILTER (NOT is_maker AND
          side='sell') AS aa, sum(volume) FILTER (is_maker AND side='buy') AS pb, sum(volume) FILTER (is_maker AND side='sell')
          AS ps, sum(volume) AS t FROM ticks GROUP BY 1)""", TICKS)(lambda s, d: K.aggressive_passive(T(s, d)))

query("volume_clock", "symbol current_rate:2 average_rate:6 percentile:6 acceleration:6 regime ms_to_next:2",
      """SELECT symbol, cur AS current_rate, avg(v) AS average_rate, avg(CASE WHEN v<=cur THEN 1.0 ELSE 0 END) AS percentile,
          max(cur)/max(v) FILTER (k=2)-1 AS acceleration, CASE WHEN avg(CASE WHEN v<=cur THEN 1.0 ELSE 0 END)>.75 THEN 'fast'
          WHEN avg(CASE WHEN v<=cur THEN 1.0 ELSE 0 END)<.25 THEN 'slow' ELSE 'normal' END AS regime,
          ((max(b)+1)*60000000-max(t))/1000 AS ms_to_next FROM (SELECT *, first(v) OVER (PARTITION BY symbol ORDER BY b DESC)
           AS cur, row_number() OVER (PARTITION BY symbol ORDER BY b DESC) AS k FROM (SELECT symbol, epoch_us(ts)//60000000 AS b,
           sum(volume) AS v, max(epoch_us(ts)) AS t FROM ticks GROUP BY 1,2)) WHERE k<=20 GROUP BY symbol, cur""", TICKS)(
    lambda s, d: K.volume_clock(T(s, d)))

query("imbalance_profile", "symbol level price:4 buy_volume:2 sell_volume:2 imbalance:6 significant kind",
      """SELECT *, CASE WHEN significant THEN CASE WHEN imbalance>0 THEN 'support' ELSE 'resistance' END END AS kind FROM (
          SELECT symbol, l AS level, lo+st*(l+.5) AS price, b AS buy_volume, s AS sell_volume, CASE WHEN b+s=0 THEN 0 ELSE
           (b-s)/(b+s) END AS imbalance, b+s>0 AND abs((b-s)/(b+s))>.3 AS significant FROM (
          SELECT symbol, l, lo, st, coalesce(sum(volume) FILTER (side='buy' AND i=l),0) AS b,
           coalesce(sum(volume) FILTER (side='sell' AND i=l),0) AS s FROM (SELECT *, least(floor((price-lo)/st),19) AS i FROM (
            SELECT *, min(price) OVER (PARTITION BY symbol) AS lo, (max(price) OVER (PARTITION BY symbol)
             -min(price) OVER (PARTITION BY symbol))/20 AS st FROM ticks)), range(20) r(l) GROUP BY 1,2,3,4))""", TICKS)(
    lambda s, d: K.imbalance_profile(T(s, d), 20))


def flow_bars(s, d):
    t = V.ticks(s, d)
    o = F.struct("ts", "seq")
    return t.groupBy("symbol", F.date_trunc("hour", "ts").alias("_h")).agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.when(F.col("side") == "buy", F.col("volume")).otherwise(0.0)).alias("buy_volume"),
        F.sum(F.when(F.col("side") == "sell", F.col("volume")).otherwise(0.0)).alias("sell_volume")
    ).withColumnRenamed("_h", "ts")


FLOW = f"""fb AS (SELECT symbol, date_trunc('hour', ts) AS ts, max(price) AS high, min(price) AS low,
  arg_max(price, ROW(ts, seq)) AS close, sum(volume) AS volume, {BS} FROM ticks GROUP BY 1,2)"""
query("delta_profile", "symbol ts delta:2 cum_delta:2 divergence exhaustion",
      """SELECT symbol, ts, b-s AS delta, cd AS cum_delta, CASE WHEN pc>=0 AND cd-cd2<0 THEN 'bearish' WHEN pc<0 AND
          cd-cd2>=0 THEN 'bullish' END AS divergence, CASE WHEN k>3 AND volume>1.5*av AND pr>0 AND high-low<.5*pr THEN
          CASE WHEN b>s THEN 'buying_exhaustion' WHEN b<s THEN 'selling_exhaustion' END END AS exhaustion FROM (
         SELECT *, lag(cd,2) OVER w AS cd2, close-lag(close,2) OVER w AS pc, lag(high-low) OVER w AS pr,
          avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS av,
          row_number() OVER w AS k FROM (SELECT *, sum(b-s) OVER (PARTITION BY symbol ORDER BY ts) AS cd FROM fb)
          WINDOW w AS (PARTITION BY symbol ORDER BY ts))""", ctes("ticks", more=FLOW))(
    lambda s, d: K.delta_profile(flow_bars(s, d), HOUR_SERIES))

_LT = """lt AS (SELECT *, (volume-m)/sd AS z FROM (SELECT *, avg(volume) OVER (PARTITION BY symbol) AS m,
  stddev_samp(volume) OVER (PARTITION BY symbol) AS sd FROM ticks) WHERE volume >= m+1.5*sd)"""
query("large_trades", "symbol seq volume:2 z:6", "SELECT * FROM lt", ctes("ticks", more=_LT))(
    lambda s, d: K.large_trades(T(s, d), "stddev", 1.5))
query("large_trades_percentile", "symbol seq volume:2",
      """SELECT symbol, seq, volume FROM ticks JOIN (SELECT symbol, list_sort(list(volume))[CAST(least(floor(count(*)*.95),
          count(*)-1) AS BIGINT)+1] AS c FROM ticks GROUP BY 1) USING (symbol) WHERE volume>=c""", TICKS)(
    lambda s, d: K.large_trades(T(s, d), "percentile", 95))
query("whale_activity", "symbol n_large large_volume:2 net_large_flow:2 large_ratio:6 activity",
      """SELECT *, CASE WHEN b/large_volume>.65 THEN 'heavy_buying' WHEN b/large_volume<.35 THEN 'heavy_selling' ELSE 'mixed'
          END AS activity FROM (SELECT symbol, count(*) AS n_large, sum(volume) AS large_volume,
          sum(CASE WHEN side='buy' THEN volume ELSE -volume END) AS net_large_flow,
          sum(volume)/(SELECT sum(volume) FROM ticks t WHERE t.symbol=lt.symbol) AS large_ratio,
          sum(CASE WHEN side='buy' THEN volume ELSE 0 END) AS b FROM lt GROUP BY symbol)""", ctes("ticks", more=_LT))(
    lambda s, d: (lambda t: K.whale_activity(t, K.large_trades(t, "stddev", 1.5)))(T(s, d)))

_CELL = """cell AS MATERIALIZED (SELECT *, volume/max(volume) OVER (PARTITION BY symbol) AS intensity FROM (
  SELECT symbol, epoch_us(ts)//3600000000 AS slot, CAST(floor(price/20+.5) AS BIGINT) AS level, sum(volume) AS volume,
   count(*) AS n_trades FROM ticks GROUP BY 1,2,3))"""
query("intensity_map", "symbol slot level volume:2 n_trades intensity:6 hotspot",
      """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, slot, level) <=
          greatest(1, floor(count(*) OVER (PARTITION BY symbol)*.1)) AS hotspot FROM cell""", ctes("ticks", more=_CELL))(
    lambda s, d: K.intensity_cells(T(s, d), 3_600_000, 20.0))
query("quiet_periods", "symbol start end_slot",
      """SELECT symbol, min(slot) AS start, coalesce(min(nx), max(slot)+1) AS end_slot FROM (SELECT *, slot_rn
          - row_number() OVER (PARTITION BY symbol, q ORDER BY slot) AS g, CASE WHEN NOT lead(q) OVER (PARTITION BY symbol
          ORDER BY slot) THEN lead(slot) OVER (PARTITION BY symbol ORDER BY slot) END AS nx FROM (
          SELECT symbol, slot, v <= .25*avg(v) OVER (PARTITION BY symbol) AS q, row_number() OVER (PARTITION BY symbol
           ORDER BY slot) AS slot_rn FROM (SELECT symbol, slot, sum(volume) AS v FROM cell GROUP BY 1,2))) WHERE q
         GROUP BY symbol, g""", ctes("ticks", more=_CELL))(
    lambda s, d: K.quiet_periods(K.intensity_cells(T(s, d), 3_600_000, 20.0)).withColumnRenamed("end", "end_slot"))

_VP = """cum AS (SELECT *, sum(volume) OVER (PARTITION BY symbol ORDER BY ts, seq) AS e FROM ticks),
 vb AS (SELECT symbol, k, sum(CASE WHEN side='buy' THEN ov ELSE 0 END) AS b, sum(CASE WHEN side='sell' THEN ov ELSE 0 END) AS s
  FROM (SELECT symbol, side, k, least(e,(k+1)*5000)-greatest(e-volume,k*5000) AS ov, mx FROM (SELECT *, max(e) OVER
   (PARTITION BY symbol) AS mx, unnest(range(CAST(floor((e-volume)/5000) AS BIGINT), CAST(floor(e/5000) AS BIGINT)+1)) AS k
   FROM cum)) WHERE ov>0 AND (k+1)*5000<=mx GROUP BY 1,2)"""
query("vpin", "symbol n_buckets vpin:6 toxicity",
      """SELECT *, CASE WHEN vpin>.7 THEN 'high' WHEN vpin>.4 THEN 'medium' ELSE 'low' END AS toxicity FROM (
          SELECT symbol, count(*) AS n_buckets, avg(abs(b-s)/5000) AS vpin FROM vb GROUP BY 1)""", ctes("ticks", more=_VP))(
    lambda s, d: K.vpin(T(s, d), 5000))
query("vpin_buckets", "symbol bucket buy_volume:2 sell_volume:2 imbalance:6",
      "SELECT symbol, k AS bucket, b AS buy_volume, s AS sell_volume, abs(b-s)/(b+s) AS imbalance FROM vb",
      ctes("ticks", more=_VP))(lambda s, d: K.vpin_buckets(T(s, d), 5000))

query("kyle_lambda", "symbol n impact:8 t_stat:5 r_squared:8 significant",
      """SELECT *, abs(t_stat)>1.96 AS significant FROM (SELECT symbol, count(*) AS n, regr_slope(dy,dx) AS impact,
          regr_r2(dy,dx) AS r_squared, regr_slope(dy,dx)/sqrt(regr_syy(dy,dx)*(1-regr_r2(dy,dx))/(count(*)-2)/regr_sxx(dy,dx))
          AS t_stat FROM (SELECT symbol, price-lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS dy,
          CASE WHEN side='buy' THEN volume ELSE -volume END AS dx FROM ticks) WHERE dy IS NOT NULL GROUP BY 1)""", TICKS)(
    lambda s, d: K.kyle_lambda(T(s, d)))

_DT = "dt AS (SELECT *, price-lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS d FROM qt)"
query("classify_trades", "symbol seq cls confidence:6",
      """SELECT symbol, seq, CASE WHEN price>mid THEN 'buy' WHEN price<mid THEN 'sell' WHEN d<0 THEN 'sell' ELSE 'buy' END AS cls,
          CASE WHEN price<>mid THEN least(.95, .7+.25*least(1, abs(price-mid)/CASE WHEN ask=bid THEN 1 ELSE (ask-bid)/2 END))
           WHEN d<>0 THEN .6 ELSE .5 END AS confidence FROM dt""", ctes("quotes", more=f"{QT}, {_DT}"))(
    lambda s, d: K.classify_trades(quoted(s, d)))
query("classify_trades_tick", "symbol seq cls confidence:6",
      """SELECT symbol, seq, CASE WHEN d IS NULL THEN CASE WHEN price>=mid THEN 'buy' ELSE 'sell' END ELSE coalesce(p,'buy') END
          AS cls, CASE WHEN d IS NULL THEN .5 WHEN d<>0 THEN .85 WHEN p IS NOT NULL THEN .6 ELSE .5 END AS confidence FROM (
          SELECT *, last_value(CASE WHEN d>0 THEN 'buy' WHEN d<0 THEN 'sell' END IGNORE NULLS) OVER (PARTITION BY symbol
          ORDER BY ts, seq) AS p FROM dt)""", ctes("quotes", more=f"{QT}, {_DT}"))(
    lambda s, d: K.classify_trades(quoted(s, d), "tick"))

query("adverse_selection", "symbol cost_1:9 cost_5:9 cost_10:9 average_cost:9 informed_pct:6",
      """SELECT *, (cost_1+cost_5+cost_10)/3 AS average_cost, ((cost_1>0)::INT+(cost_5>0)::INT+(cost_10>0)::INT)/3 AS informed_pct
         FROM (SELECT symbol, avg(sg*(lead(mid,1)-mid)/mid) AS cost_1, 0 AS x FROM (SELECT 1) GROUP BY 1)""".replace(
          "avg(sg*(lead(mid,1)-mid)/mid) AS cost_1, 0 AS x FROM (SELECT 1) GROUP BY 1",
          """avg(sg*(m1-mid)/mid) AS cost_1, avg(sg*(m5-mid)/mid) AS cost_5, avg(sg*(m10-mid)/mid) AS cost_10 FROM (
          SELECT *, CASE WHEN side='buy' THEN 1 ELSE -1 END AS sg, lead(mid,1) OVER w AS m1, lead(mid,5) OVER w AS m5,
          lead(mid,10) OVER w AS m10 FROM qt WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) GROUP BY 1"""),
      ctes("quotes", more=QT))(lambda s, d: K.adverse_selection(quoted(s, d)))

query("amihud", "symbol ratio:9 liquidity",
      """SELECT *, CASE WHEN ratio<1e-9 THEN 'high' WHEN ratio<1e-6 THEN 'medium' ELSE 'low' END AS liquidity FROM (
          SELECT symbol, avg(abs(ret)/volume) AS ratio FROM rets GROUP BY 1)""", RETS)(
    lambda s, d: K.amihud(V.bars(s, d), V.BAR_SERIES))

query("spread_decomposition", "symbol effective_spread:9 realized_spread:9 price_impact:9 adverse_pct:6",
      """SELECT symbol, e AS effective_spread, r AS realized_spread, e-r AS price_impact, CASE WHEN e>0 THEN
          greatest(0, least(1, (e-r)/e)) ELSE 0 END AS adverse_pct FROM (SELECT symbol, avg(2*sg*(price-mid)/mid) AS e,
          avg(2*sg*(price-m5)/mid) AS r FROM (SELECT *, CASE WHEN side='buy' THEN 1 ELSE -1 END AS sg, lead(mid,5) OVER
          (PARTITION BY symbol ORDER BY ts, seq) AS m5 FROM qt) WHERE m5 IS NOT NULL GROUP BY 1)""", ctes("quotes", more=QT))(
    lambda s, d: K.spread_decomposition(quoted(s, d)))

query("roll_spread", "symbol serial_cov:5 implied_spread:5",
      """SELECT symbol, c AS serial_cov, CASE WHEN c<0 THEN 2*sqrt(-c) ELSE 0 END AS implied_spread FROM (
          SELECT symbol, avg(d*pd) AS c FROM (SELECT symbol, d, lag(d) OVER (PARTITION BY symbol ORDER BY ts, seq) AS pd FROM (
          SELECT *, price-lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS d FROM ticks)) GROUP BY 1)""", TICKS)(
    lambda s, d: K.roll_spread(T(s, d)))

query("pin_estimate", "symbol buys sells periods eps:6 mu:6 alpha:6 delta:6 pin:6",
      """SELECT *, alpha*mu/(alpha*mu+2*eps) AS pin FROM (SELECT *, least(1, mu/((buys+sells)/periods)) AS alpha,
          CASE WHEN mu>0 THEN greatest(0, sells/periods-eps)/mu ELSE .5 END AS delta FROM (SELECT *, abs(buys-sells)/periods AS mu,
          least(buys, sells)/periods AS eps FROM (SELECT symbol, CAST(count(*) FILTER (side='buy') AS BIGINT) AS buys,
          CAST(count(*) FILTER (side='sell') AS BIGINT) AS sells, count(DISTINCT date_trunc('hour', ts)) AS periods FROM ticks
          GROUP BY 1)))""", TICKS)(lambda s, d: K.pin_estimate(K.trade_counts(T(s, d))))


def venue_pairs(s, d):
    """Hourly mean prices of venue v0 (a) against each other venue (b)."""
    f = funding(s, d)
    a = f.filter("venue = 'v0'").select("symbol", "ts", F.col("idx").alias("a"))
    return f.filter("venue <> 'v0'").select("symbol", "venue", "ts", F.col("idx").alias("b")).join(a, ["symbol", "ts"])


VPAIR = FUNDING + """, vpair AS MATERIALIZED (SELECT x.symbol, x.venue, x.ts, y.idx AS a, x.idx AS b,
  row_number() OVER (PARTITION BY x.symbol, x.venue ORDER BY x.ts) AS rn, count(*) OVER (PARTITION BY x.symbol, x.venue) AS n
  FROM funding x JOIN funding y ON x.symbol=y.symbol AND x.ts=y.ts AND y.venue='v0' WHERE x.venue<>'v0')"""
VP_SERIES = time_series(("symbol", "venue"), ("ts",), bucket_seconds=7 * 86_400)
query("info_share", "symbol venue n share_a:6 share_b:6 dominant",
      """SELECT *, 1-share_a AS share_b, CASE WHEN share_a>=.5 THEN 'A' ELSE 'B' END AS dominant FROM (
          SELECT symbol, venue, count(ra) AS n, .5*var_samp(ra)/(var_samp(ra)+var_samp(rb))
           + .5*abs(avg(la*rb))/(abs(avg(la*rb))+abs(avg(lb*ra))) AS share_a FROM (SELECT *, lag(ra) OVER w AS la,
           lag(rb) OVER w AS lb FROM (SELECT *, a/lag(a) OVER w-1 AS ra, b/lag(b) OVER w-1 AS rb FROM vpair
           WINDOW w AS (PARTITION BY symbol, venue ORDER BY ts)) WINDOW w AS (PARTITION BY symbol, venue ORDER BY ts)) GROUP BY 1,2)""",
      ctes("ticks", more=VPAIR))(lambda s, d: K.info_share(venue_pairs(s, d), VP_SERIES))

query("flow_toxicity", "symbol n flow_imbalance:6 toxicity:6 arrival_rate:6 regime",
      """SELECT *, abs(flow_imbalance) AS toxicity, CASE WHEN abs(flow_imbalance)>.7 THEN 'toxic' WHEN abs(flow_imbalance)<.2
          THEN 'benign' ELSE 'normal' END AS regime FROM (SELECT symbol, count(*) AS n, sum(CASE WHEN side='buy' THEN volume ELSE
          -volume END)/sum(volume) AS flow_imbalance, count(*)/((max(epoch_us(ts))-min(epoch_us(ts)))/1000)*1000 AS arrival_rate
          FROM ticks JOIN (SELECT symbol, max(epoch_us(ts)) AS t1 FROM ticks GROUP BY 1) USING (symbol)
          WHERE epoch_us(ts) >= t1-86400000000 GROUP BY 1)""", TICKS)(
    lambda s, d: K.flow_toxicity(T(s, d), 86_400_000))

query("trade_flow", "symbol buy_volume:2 sell_volume:2 buy_count sell_count ratio:2 imbalance_pct:2 signal large_cut:4 n_large",
      """SELECT *, CASE WHEN imbalance_pct>20 THEN 'strong_buy_pressure' WHEN imbalance_pct>5 THEN 'moderate_buy_pressure' WHEN
          imbalance_pct<-20 THEN 'strong_sell_pressure' WHEN imbalance_pct<-5 THEN 'moderate_sell_pressure' ELSE 'neutral' END
          AS signal FROM (SELECT symbol, b AS buy_volume, s AS sell_volume, buy_count, sell_count, floor(b/s*100+.5)/100 AS ratio,
          floor((b-s)/(b+s)*10000+.5)/100 AS imbalance_pct, large_cut, n_large FROM (SELECT symbol, sum(volume) FILTER (side='buy')
          AS b, sum(volume) FILTER (side='sell') AS s, CAST(count(*) FILTER (side='buy') AS BIGINT) AS buy_count,
          CAST(count(*) FILTER (side='sell') AS BIGINT) AS sell_count, max(c) AS large_cut,
          CAST(count(*) FILTER (volume>c) AS BIGINT) AS n_large FROM (SELECT *, 2*avg(volume) OVER (PARTITION BY symbol) AS c
          FROM ticks) GROUP BY 1))""", TICKS)(lambda s, d: K.trade_flow(T(s, d)))

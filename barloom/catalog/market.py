"""Book, quote, venue and execution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import book as B
from ..operators import execution as X
from ..operators import venue as N
from ..sources import views as V
from .base import query
from .indicators import ATR, BB
from .sql import BARS, TICKS, ctes

BK = ctes("book")
BQ = """bq AS MATERIALIZED (SELECT venue, symbol, ts, max(price) FILTER (side='bid') AS best_bid, min(price) FILTER (side='ask')
  AS best_ask, max(qty) FILTER (side='bid' AND level=1) AS bid_top, max(qty) FILTER (side='ask' AND level=1) AS ask_top,
  (max(price) FILTER (side='bid')+min(price) FILTER (side='ask'))/2 AS mid,
  coalesce(sum(qty) FILTER (side='bid'),0) AS b, coalesce(sum(qty) FILTER (side='ask'),0) AS a FROM book GROUP BY 1,2,3)"""
WB = """wf AS (SELECT *, greatest(0, least(qty, 60-coalesce(sum(qty) OVER (PARTITION BY venue, symbol, ts, side ORDER BY level
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS f FROM book),
 wb AS (SELECT w.venue, w.symbol, w.ts, side, sum(f) AS filled, sum(f*price)/sum(f) AS avg_price, count(*) FILTER (f>0)
   AS levels_used, max(price) FILTER (level=1) AS best_price, sum(qty) AS book_depth, any_value(mid) AS mid FROM wf w
   JOIN bq q ON q.venue=w.venue AND q.symbol=w.symbol AND q.ts=w.ts GROUP BY 1,2,3,4)"""
FULLB = ctes("book", more=f"{BQ}, {WB}")

query("walk_book", "venue symbol ts side filled:4 avg_price:4 slippage:8 fill_probability:6 impact_bps:4 levels_used book_depth:4",
      """SELECT venue, symbol, ts, side, filled, avg_price, abs(avg_price-mid)/mid AS slippage, least(filled/60,1) AS fill_probability,
         abs(avg_price-best_price)/best_price*10000 AS impact_bps, CAST(levels_used AS BIGINT) AS levels_used, book_depth FROM wb""",
      FULLB)(lambda s, d: B.walk_book(V.book_levels(s, d), 60.0))

query("depth_bands", "venue symbol ts band:4 bid_depth:4 ask_depth:4 total:4",
      """SELECT *, bid_depth+ask_depth AS total FROM (SELECT k.venue, k.symbol, k.ts, band,
         coalesce(sum(qty) FILTER (side='bid' AND abs(price-mid)/mid<=band),0) AS bid_depth,
         coalesce(sum(qty) FILTER (side='ask' AND abs(price-mid)/mid<=band),0) AS ask_depth FROM book k JOIN bq q ON
         q.venue=k.venue AND q.symbol=k.symbol AND q.ts=k.ts, (SELECT unnest([0.05::DOUBLE,0.2::DOUBLE]) AS band)
         WHERE mid IS NOT NULL GROUP BY 1,2,3,4)""", FULLB)(lambda s, d: B.depth_bands(V.book_levels(s, d), (0.05, 0.2)))

query("book_imbalance", "venue symbol ts bid_volume:4 ask_volume:4 imbalance:4",
      "SELECT venue, symbol, ts, b AS bid_volume, a AS ask_volume, floor((b-a)/(b+a)*1e4+.5)/1e4 AS imbalance FROM bq", FULLB)(
    lambda s, d: B.book_imbalance(V.book_levels(s, d)))

query("book_shape", "venue symbol ts side level price:4 qty:4 ratio_vs_top:4",
      """SELECT *, floor(qty/first(qty) OVER (PARTITION BY venue, symbol, ts, side ORDER BY level)*1e4+.5)/1e4 AS ratio_vs_top
         FROM book""", BK)(lambda s, d: B.book_shape(V.book_levels(s, d)))

query("weighted_mid", "venue symbol ts weighted_mid:2",
      """SELECT venue, symbol, ts, (best_bid*ask_top+best_ask*bid_top)/(bid_top+ask_top) AS weighted_mid FROM bq
         WHERE mid IS NOT NULL""", FULLB)(lambda s, d: B.weighted_mids(V.book_levels(s, d)))

query("microstructure_report", "venue symbol ts spread_bps:4 weighted_mid:2 imbalance:4 depth_1pct:4 buy_slippage:8 sell_slippage:8",
      """SELECT q.venue, q.symbol, q.ts, (best_ask-best_bid)/q.mid*10000 AS spread_bps, (best_bid*ask_top+best_ask*bid_top)/(bid_top
         +ask_top) AS weighted_mid, floor((b-a)/(b+a)*1e4+.5)/1e4 AS imbalance, (SELECT coalesce(sum(qty),0) FROM book k WHERE
         k.venue=q.venue AND k.symbol=q.symbol AND k.ts=q.ts AND abs(price-q.mid)/q.mid<=.01) AS depth_1pct,
         abs(x.avg_price-q.mid)/q.mid AS buy_slippage, abs(y.avg_price-q.mid)/q.mid AS sell_slippage FROM bq q
         JOIN wb x ON x.venue=q.venue AND x.symbol=q.symbol AND x.ts=q.ts AND x.side='ask'
         JOIN wb y ON y.venue=q.venue AND y.symbol=q.symbol AND y.ts=q.ts AND y.side='bid' WHERE q.mid IS NOT NULL""", FULLB)(
    lambda s, d: B.microstructure_report(V.book_levels(s, d), 60.0))

query("aggregate_books", "symbol ts side level price:4 qty:4 n_venues",
      """SELECT * FROM (SELECT symbol, ts, side, price, sum(qty) AS qty, count(*) AS n_venues, row_number() OVER (PARTITION BY
         symbol, ts, side ORDER BY CASE WHEN side='bid' THEN -price ELSE price END) AS level FROM book GROUP BY 1,2,3,4)
         WHERE level<=3""", BK)(
    lambda s, d: B.aggregate_books(V.book_levels(s, d), 3).withColumn("n_venues", F.size("venues").cast("long")))

query("cross_venue_imbalance", "symbol ts n_venues imbalance:6 pressure divergence",
      """SELECT *, CASE WHEN imbalance>.1 THEN 'buy' WHEN imbalance<-.1 THEN 'sell' ELSE 'neutral' END AS pressure FROM (
         SELECT symbol, ts, count(*) AS n_venues, sum(b-a)/sum(b+a) AS imbalance, max((b-a)/(b+a))>.1 AND min((b-a)/(b+a))<-.1
         AS divergence FROM bq GROUP BY 1,2)""", FULLB)(lambda s, d: B.cross_venue_imbalance(V.book_levels(s, d)))

Q = V.quotes
query("cross_venue_spread", "symbol ts n_venues bid_venue best_bid:4 ask_venue best_ask:4 cross_spread:4 cross_pct:6 arbitrage net_profit:4",
      """SELECT *, greatest(net, 0) AS net_profit, net>0 AS arbitrage FROM (SELECT *, best_bid-best_ask AS cross_spread,
         (best_bid-best_ask)/((best_bid+best_ask)/2)*100 AS cross_pct, CASE WHEN best_bid>best_ask THEN best_bid-best_ask
          -best_ask*af-best_bid*bf ELSE 0 END AS net FROM (SELECT symbol, ts, count(*) AS n_venues,
         arg_min(venue, ROW(-bid, venue)) AS bid_venue, max(bid) AS best_bid, arg_min(venue, ROW(ask, venue)) AS ask_venue, min(ask)
         AS best_ask, arg_min(fee, ROW(-bid, venue)) AS bf, arg_min(fee, ROW(ask, venue)) AS af FROM quotes GROUP BY 1,2))""",
      ctes("quotes"))(lambda s, d: N.cross_venue_spread(Q(s, d).withColumn("venue", F.col("venue"))))
query("venue_spreads", "venue symbol ts spread_bps:4 effective_spread:6",
      "SELECT *, (ask-bid)/((ask+bid)/2)*10000 AS spread_bps, ask-bid+(ask+bid)*fee AS effective_spread FROM quotes",
      ctes("quotes"))(lambda s, d: N.venue_spreads(Q(s, d)))
query("detect_arbitrage", "symbol ts gross_pct:6 net_pct:6 profitable",
      """SELECT *, gross_pct-.2 AS net_pct, gross_pct-.2>0 AS profitable FROM (SELECT symbol, ts, (max(bid)-min(ask))/min(ask)*100
         AS gross_pct FROM quotes GROUP BY 1,2 HAVING count(*)>=2)""", ctes("quotes"))(lambda s, d: N.arbitrage(Q(s, d)))


def currency_pairs(s, d):
    e = V.table(s, d, "events").select(
        F.concat(F.lit("C"), F.least(F.col("event_id") % 4, F.col("user_id") % 4)).alias("base"),
        F.concat(F.lit("C"), F.greatest(F.col("event_id") % 4, F.col("user_id") % 4)).alias("quote"),
        F.concat(F.lit("v"), F.col("user_id") % 3).alias("venue"), F.date_trunc("day", "ts").alias("ts"), "value")
    px = F.avg(100 + F.col("value")) / 100
    return e.filter("base <> quote").groupBy("ts", "base", "quote", "venue").agg(
        (px * 0.999).alias("bid"), (px * 1.001).alias("ask"), F.lit(0.001).alias("fee"))


query("triangular_arb", "ts path sides venues net_profit:8",
      """SELECT a.ts, a.src||'>'||a.dst||'>'||b.dst||'>'||a.src AS path, a.side||','||b.side||','||c.side AS sides,
         a.venue||','||b.venue||','||c.venue AS venues, a.rate*b.rate*c.rate-1 AS net_profit FROM edge a JOIN edge b ON a.ts=b.ts
         AND b.src=a.dst AND b.pair<>a.pair AND b.dst<>a.src JOIN edge c ON c.ts=a.ts AND c.src=b.dst AND c.dst=a.src
         WHERE a.rate*b.rate*c.rate>1""",
      """WITH cp AS (SELECT date_trunc('day', ts) AS ts, 'C'||least(event_id%4, user_id%4) AS base, 'C'||greatest(event_id%4,
          user_id%4) AS quote, 'v'||(user_id%3) AS venue, avg(100+value)/100 AS p FROM events WHERE event_id%4<>user_id%4
          GROUP BY 1,2,3,4),
         edge AS MATERIALIZED (SELECT ts, base AS src, quote AS dst, base||quote AS pair, 'sell' AS side, arg_min(venue, ROW(-p, venue)) AS venue,
          max(p)*.999*.999 AS rate FROM cp GROUP BY 1,2,3 UNION ALL SELECT ts, quote, base, base||quote, 'buy', arg_min(venue, ROW(p, venue)),
          1/(min(p)*1.001)*.999 FROM cp GROUP BY ts, base, quote)""")(
    lambda s, d: N.triangular_arb(currency_pairs(s, d), ("ts",)))

ROUTE = """rt AS (SELECT *, first(eff) OVER (PARTITION BY symbol, ts ORDER BY eff DESC, venue DESC) AS w FROM (SELECT *, greatest(0, least(q,
   150-coalesce(sum(q) OVER (PARTITION BY symbol, ts ORDER BY eff, venue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))
   AS fill FROM (SELECT *, ask*(1+fee) AS eff, coalesce(ask_qty, 0) AS q FROM quotes)))"""
query("smart_route", "symbol ts n_venues filled:4 total_cost:9 total_fees:9 savings:9",
      """SELECT *, total_cost/filled AS avg_price, abs(filled*w-total_cost) AS savings FROM (SELECT symbol, ts, count(*) AS n_venues,
         sum(fill) AS filled, sum(fill*ask*(1+fee)) AS total_cost, sum(fill*ask*fee) AS total_fees, max(w) AS w FROM rt
         WHERE fill>0 GROUP BY 1,2)""", ctes("quotes", more=ROUTE))(
    lambda s, d: N.route_summary(N.smart_route(Q(s, d), "buy", 150.0)))
query("equal_route", "symbol ts venue fill:6",
      "SELECT symbol, ts, venue, 150/count(*) OVER (PARTITION BY symbol, ts) AS fill FROM quotes", ctes("quotes"))(
    lambda s, d: N.equal_route(Q(s, d), 150.0))


def metrics(s, d, *key):
    p, v = F.col("price"), F.col("volume")
    return V.ticks(s, d).groupBy(*key, "venue").agg(
        F.avg(F.when(v > 2, 1.0).otherwise(0.0)).alias("uptime"), F.avg(p - 100).alias("latency"),
        (F.stddev_samp(p) / F.avg(p) * 10).alias("spread"), F.avg(F.when(v > 15, 1.0).otherwise(0.0)).alias("fill_rate"),
        F.avg(v).alias("slippage"), F.sum(v).alias("volume"), F.sum(v).alias("depth"), F.min("fee").alias("fee"))


MET = """avg(CASE WHEN volume>2 THEN 1.0 ELSE 0 END) AS uptime, avg(price-100) AS latency, stddev_samp(price)/avg(price)*10 AS spread,
  avg(CASE WHEN volume>15 THEN 1.0 ELSE 0 END) AS fill_rate, avg(volume) AS slippage, sum(volume) AS volume, sum(volume) AS depth,
  min(fee) AS fee"""
query("venue_quality", "venue score:6 rank n_strong n_weak",
      """SELECT *, row_number() OVER (ORDER BY score DESC, venue) AS rank FROM (SELECT venue, .2*u+.2*l+.2*sp+.2*f+.1*sl+.1*v AS score,
         CAST((u>=.99)::INT+(l>=.8)::INT+(sp>=.8)::INT+(f>=.95)::INT+(sl>=.8)::INT+(v>=.5)::INT AS BIGINT) AS n_strong,
         CAST((u<.95)::INT+(l<.3)::INT+(sp<.3)::INT+(f<.8)::INT+(sl<.3)::INT+(v<.1)::INT AS BIGINT) AS n_weak FROM (
         SELECT venue, uptime AS u, 1-latency/greatest(max(latency) OVER (), 1) AS l, 1-spread/greatest(max(spread) OVER (), 1) AS sp,
         fill_rate AS f, 1-slippage/greatest(max(slippage) OVER (), 1) AS sl, volume/greatest(max(volume) OVER (), 1) AS v FROM met))""",
      ctes("ticks", more=f"met AS (SELECT venue, {MET} FROM ticks GROUP BY 1)"))(
    lambda s, d: N.venue_quality(metrics(s, d)).withColumn("n_strong", F.size("strengths").cast("long"))
    .withColumn("n_weak", F.size("weaknesses").cast("long")))
query("venue_selection", "symbol first_venue second_venue score:6 expected_slippage:4 expected_cost:4 split",
      """SELECT symbol, max(venue) FILTER (k=1) AS first_venue, max(venue) FILTER (k=2) AS second_venue, max(sc) FILTER (k=1) AS score,
         max(9000/depth*spread) FILTER (k=1) AS expected_slippage, max(9000*spread+9000*fee+9000/depth*spread) FILTER (k=1)
         AS expected_cost, max(9000>depth*.3) FILTER (k=1) AS split FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY
         sc DESC, venue) AS k FROM (SELECT *, .25*(1-spread/greatest(max(spread) OVER w, 1e-10))+.2*(1-fee/greatest(max(fee) OVER w,
         1e-10))+.2*depth/greatest(max(depth) OVER w,1e-10)+.2*fill_rate+.15*(1-latency/greatest(max(latency) OVER w, 1)) AS sc
         FROM met WINDOW w AS (PARTITION BY symbol))) GROUP BY 1""",
      ctes("ticks", more=f"met AS (SELECT symbol, venue, {MET} FROM ticks GROUP BY 1,2)"))(
    lambda s, d: N.venue_selection(metrics(s, d, "symbol"), 9000.0))
query("fragmentation", "symbol hhi:4 top_share:6 effective_venues:6 level",
      """SELECT *, 10000/hhi AS effective_venues, CASE WHEN hhi>2500 THEN 'consolidated' WHEN hhi>1500 THEN 'moderate' ELSE
         'fragmented' END AS level FROM (SELECT symbol, sum(sh*sh) AS hhi, max(sh) AS top_share FROM (SELECT symbol, venue,
         sum(volume)/sum(sum(volume)) OVER (PARTITION BY symbol)*100 AS sh FROM ticks GROUP BY 1,2) GROUP BY 1)""", TICKS)(
    lambda s, d: N.fragmentation(V.ticks(s, d).groupBy("symbol", "venue").agg(F.sum("volume").alias("volume"))))

query("execution_quality", "order_id n_fills vwap:2 avg_price:2 makers takers slippage_bps:2",
      """SELECT *, floor((vwap-mid)/mid*1e6+.5)/100 AS slippage_bps FROM (SELECT order_id, count(*) AS n_fills,
         floor(sum(cost)/sum(amount)*100+.5)/100 AS vwap, floor(avg(price)*100+.5)/100 AS avg_price, CAST(count(*) FILTER
         (k3%2=0) AS BIGINT) AS makers, CAST(count(*) FILTER (k3%2=1) AS BIGINT) AS takers, min(price) AS mid FROM fills GROUP BY 1)""",
      ctes("fills"))(lambda s, d: (lambda f: X.execution_quality(f.withColumn("liquidity", F.when(
          F.col("k3") % 2 == 0, "maker").otherwise("taker")), f.groupBy("order_id").agg(F.min("price").alias("mid"))))(V.fills(s, d)))


def parents(s, d):
    """Parent orders: one per customer order, amount in lots, daily volume by priority, symbol by brand number."""
    o = V.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
                    (F.col("o_totalprice") / 1000).alias("amount"), F.lit(100.0).alias("price"),
                    F.concat(F.lit("Brand#"), F.col("o_custkey") % 25 + 1).alias("symbol"),
                    (F.col("o_custkey") % 4 * 30 + 30).alias("duration_min"),
                    (F.col("o_custkey") % 7 * 1000 + 5000).cast("double").alias("daily_volume"))


PAR = """par AS (SELECT o_orderkey AS order_id, o_orderdate AS ts, o_totalprice/1000 AS amount, 100.0 AS price,
  'Brand#'||(o_custkey%25+1) AS symbol, o_custkey%4*30+30 AS duration_min, CAST(o_custkey%7*1000+5000 AS DOUBLE) AS daily_volume
  FROM orders)"""
query("schedule_twap", "order_id slice scheduled slice_amount:6 impact_bps:4",
      """SELECT order_id, k AS slice, ts+to_microseconds((k-1)*duration_min*60000000//4) AS scheduled, amount/4 AS slice_amount,
         sqrt(amount/daily_volume)*100 AS impact_bps FROM par, range(1,5) t(k)""", "WITH " + PAR)(
    lambda s, d: X.schedule_twap(parents(s, d), 4).withColumn("slice", F.col("slice").cast("long")))
query("schedule_vwap", "order_id slice slice_amount:6 weight:6",
      """SELECT order_id, sl AS slice, amount*v/sum(v) OVER (PARTITION BY order_id) AS slice_amount,
         v/sum(v) OVER (PARTITION BY order_id) AS weight FROM par JOIN (SELECT symbol, (rn-1)//(n//4)+1 AS sl, greatest(sum(volume),
         .001) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol)
         AS n FROM bars) WHERE (rn-1)//(n//4) < 4 GROUP BY 1,2) USING (symbol)""", ctes("bars", more=PAR))(
    lambda s, d: X.schedule_vwap(parents(s, d), V.bars(s, d), 4).withColumn("slice", F.col("slice").cast("long")))
query("schedule_vwap_whole", "order_id slice slice_amount:6 weight:6",
      """SELECT order_id, sl AS slice, amount*v/sum(v) OVER (PARTITION BY order_id) AS slice_amount,
         v/sum(v) OVER (PARTITION BY order_id) AS weight FROM par JOIN (SELECT symbol, least((rn-1)//greatest(n//4, 1)+1, 4) AS sl,
         greatest(sum(volume), .001) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
         count(*) OVER (PARTITION BY symbol) AS n FROM bars) GROUP BY 1,2) USING (symbol)""", ctes("bars", more=PAR))(
    lambda s, d: X.schedule_vwap(parents(s, d), V.bars(s, d), 4, whole=True).withColumn("slice", F.col("slice").cast("long")))
query("schedule_iceberg", "order_id clip_no clip_amount:6 n_clips",
      """SELECT order_id, k AS clip_no, CASE WHEN amount<100 THEN amount WHEN k<=floor(amount/100) THEN 100 ELSE
         amount-floor(amount/100)*100 END AS clip_amount, m AS n_clips FROM (SELECT *, unnest(range(1, m+1)) AS k FROM (SELECT *,
         CAST(greatest(1, floor(amount/100)+CASE WHEN amount-floor(amount/100)*100>1e-10 THEN 1 ELSE 0 END) AS BIGINT) AS m
         FROM par))""", "WITH " + PAR)(lambda s, d: X.schedule_iceberg(parents(s, d), 100.0))
query("dca_schedule", "symbol order_no amount_quote:4 amount_base:6",
      """SELECT symbol, k+1 AS order_no, w/sum(w) OVER (PARTITION BY symbol)*1000 AS amount_quote,
         w/sum(w) OVER (PARTITION BY symbol)*1000/px AS amount_base FROM (SELECT symbol, k, 1/stddev_samp(ret) AS w, any_value(px) AS px
         FROM (SELECT symbol, close/lag(close) OVER o-1 AS ret, row_number() OVER o-2 AS i, count(*) OVER (PARTITION BY symbol)-1 AS nr,
         last(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS px FROM bars
         WINDOW o AS (PARTITION BY symbol ORDER BY ts)), range(5) t(k) WHERE i >= nr-5+k-9 AND i <= nr-5+k GROUP BY 1,2)""", BARS)(
    lambda s, d: X.dca_schedule(V.bars(s, d), 1000.0, 5).withColumn("order_no", F.col("order_no").cast("long")))
query("grid_levels", "symbol level level_price:2 side amount:6 expected_trades:0 regime",
      """SELECT symbol, k AS level, bo+(k-.5)*(tp-bo)/10 AS level_price, CASE WHEN bo+(k-.5)*(tp-bo)/10<px THEN 'buy' ELSE 'sell' END
         AS side, 1000/(bo+(k-.5)*(tp-bo)/10) AS amount, floor(a/((tp-bo)/10)+.5) AS expected_trades, CASE WHEN a/aa>1.5 THEN 'high'
         WHEN a/aa<.7 THEN 'low' ELSE 'normal' END AS regime FROM (SELECT b.symbol, arg_max(b.close, b.ts) AS px,
         arg_max(bb_mid+2*bb_sd, b.ts) AS tp, arg_max(bb_mid-2*bb_sd, b.ts) AS bo, arg_max(atr, b.ts) AS a, avg(atr) AS aa FROM bb b
         JOIN atr t ON t.symbol=b.symbol AND t.ts=b.ts GROUP BY 1), range(1,11) r(k)""", ctes("rets", more=f"{BB}, {ATR}"))(
    lambda s, d: X.grid_levels(V.bars(s, d), 10).withColumn("level", F.col("level").cast("long")))

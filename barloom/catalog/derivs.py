"""Derivatives, sentiment and panel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derivs as D
from ..operators import panels as P
from ..sources import views as V
from .base import ORACLES, query
from .indicators import HOUR_SERIES
from .sql import TICKS, ctes
from .stats import FUND_SERIES, FUNDING, funding

FP = ctes("ticks", more=FUNDING)


def futures(s, d):
    """One contract per part type and brand: monthly expiries against the brand's mean price."""
    p = V.table(s, d, "part")
    spot = p.groupBy(F.col("p_brand").alias("symbol")).agg(F.avg("p_retailprice").alias("spot"))
    c = p.groupBy(F.col("p_brand").alias("symbol"), (F.col("p_size") % 6).alias("m")).agg(F.avg("p_retailprice").alias("price"))
    return c.join(spot, "symbol").withColumn("expiry", F.expr("timestamp'2025-01-01' + make_dt_interval(30 * m)")).drop("m")


FUT = """fut AS (SELECT symbol, price, spot, TIMESTAMP '2025-01-01'+to_days(CAST(30*m AS INTEGER)) AS expiry, 30*m+184 AS days FROM (SELECT p_brand AS
   symbol, p_size%6 AS m, avg(p_retailprice) AS price FROM part GROUP BY 1,2) JOIN (SELECT p_brand AS symbol, avg(p_retailprice) AS spot FROM part
   GROUP BY 1) USING (symbol))"""
query("basis_curve", "symbol expiry basis:4 basis_pct:6 annualized:6 max_basis:4 contango",
      """SELECT *, price-spot AS basis, (price-spot)/spot AS basis_pct, (price-spot)/spot*365/days AS annualized, max(abs(price-spot)) OVER
         (PARTITION BY symbol) AS max_basis, last(price-spot) OVER (PARTITION BY symbol ORDER BY expiry ROWS BETWEEN UNBOUNDED PRECEDING AND
         UNBOUNDED FOLLOWING)>0 AS contango FROM fut""", "WITH " + FUT)(lambda s, d: D.basis_curve(futures(s, d), "2024-07-01"))
query("roll_yield", "symbol expiry roll_yield:6 annualized:6 direction",
      """SELECT symbol, expiry, y AS roll_yield, y*365/gap AS annualized, CASE WHEN y>=0 THEN 'contango' ELSE 'backwardation' END AS direction FROM (
         SELECT *, lead(price) OVER w/price-1 AS y, lead(days) OVER w-days AS gap FROM fut WINDOW w AS (PARTITION BY symbol ORDER BY expiry))
         WHERE y IS NOT NULL""", "WITH " + FUT)(lambda s, d: P.roll_yield(futures(s, d)))
query("funding_arb", "symbol ts long_venue short_venue spread:9 annualized:9 net:9",
      """SELECT a.symbol, a.ts, a.venue AS long_venue, b.venue AS short_venue, b.rate-a.rate AS spread, (b.rate-a.rate)*1095 AS annualized,
         b.rate-a.rate-a.taker_fee-b.taker_fee AS net FROM funding a JOIN funding b ON a.symbol=b.symbol AND a.ts=b.ts AND a.venue<>b.venue AND
         b.rate>a.rate""", FP)(lambda s, d: D.funding_arb(funding(s, d)))
query("funding_sentiment", "symbol venue rate:9 mean:9 sd:9 percentile:6 z:6 extreme:6 sentiment mean_revert",
      """SELECT *, least(1, abs(z)/3) AS extreme, CASE WHEN z>1.5 THEN 'crowded_long' WHEN z<-1.5 THEN 'crowded_short' ELSE 'neutral' END AS
         sentiment, abs(z)>2 AS mean_revert FROM (SELECT symbol, venue, any_value(c) AS rate, avg(rate) AS mean, stddev_samp(rate) AS sd,
         avg(CASE WHEN rate<c THEN 1.0 ELSE 0 END) AS percentile, (any_value(c)-avg(rate))/stddev_samp(rate) AS z FROM (SELECT *, first(rate) OVER w AS c,
         row_number() OVER w AS k FROM funding WINDOW w AS (PARTITION BY symbol, venue ORDER BY ts DESC)) WHERE k<=100 GROUP BY 1,2)""", FP)(
    lambda s, d: D.funding_sentiment(funding(s, d), FUND_SERIES))


def markets(s, d):
    return V.ticks(s, d).groupBy("symbol").agg(
        F.avg("price").alias("price"), F.sum("volume").alias("open_interest"), F.avg("price").alias("spot"),
        (F.sum("volume") / 100).alias("depth"), (F.sum("volume") * 2).alias("daily_volume"))


def levels(s, d):
    return V.ticks(s, d).select("symbol", "price", F.col("volume").alias("size"), "seq",
                                F.when(F.col("side") == "buy", "long").otherwise("short").alias("side"))


MK = """mk AS MATERIALIZED (SELECT symbol, avg(price) AS spot, sum(volume) AS oi, sum(volume)/100 AS depth, sum(volume)*2 AS dv FROM ticks GROUP BY 1),
 lq AS (SELECT symbol, spot, l.k AS leverage, sd AS side, CASE WHEN sd='long' THEN spot*(1-(1.0/l.k-.005)) ELSE spot*(1+(1.0/l.k-.005)) END AS level,
   oi*l.w/2 AS size, 1.0/l.k-.005 AS distance_pct FROM mk, (SELECT unnest([{'k':2,'w':.15},{'k':3,'w':.15},{'k':5,'w':.2},{'k':10,'w':.2},
   {'k':20,'w':.15},{'k':50,'w':.1},{'k':100,'w':.05}]) AS l), (SELECT unnest(['long','short']) AS sd))"""
MP = ctes("ticks", more=MK)
query("liquidation_levels", "symbol leverage side level:4 size:4 distance_pct:6", "SELECT * FROM lq", MP)(
    lambda s, d: D.liquidation_levels(markets(s, d)))
query("liquidation_zones", "symbol lo:4 hi:4 size:4",
      """SELECT symbol, lo, lo+spot*.02 AS hi, size FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY size DESC, lo) AS k FROM (SELECT symbol,
         any_value(spot) AS spot, lo, sum(size) AS size FROM zz GROUP BY symbol, lo)) WHERE k<=5""",
      ctes("ticks", more=MK + """, ord AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY level) AS i FROM lq),
 zz AS (SELECT symbol, spot, i, level, size, level AS lo FROM ord WHERE i=1 UNION ALL SELECT o.symbol, o.spot, o.i, o.level, o.size,
   CASE WHEN o.level<=z.lo+o.spot*.02 THEN z.lo ELSE o.level END FROM zz z JOIN ord o ON o.symbol=z.symbol AND o.i=z.i+1)""", recursive=True))(
    lambda s, d: D.density_zones(D.liquidation_levels(markets(s, d))))
query("cascade", "symbol depth_stages impact:6 score:4 risk",
      """SELECT *, CASE WHEN score>=75 THEN 'critical' WHEN score>=50 THEN 'high' WHEN score>=25 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT symbol,
         max(st) AS depth_stages, max(im) AS impact, least(100, max(st)*15+any_value(oi)/any_value(dv)*30+max(im)*200) AS score FROM (SELECT symbol, side,
         count(*) AS st, max(far)/max(spot) AS im, any_value(oi) AS oi, any_value(dv) AS dv FROM (SELECT *, min(CASE WHEN k>1 AND NOT CASE WHEN side='long'
         THEN spot*(1-bf/depth*.5)<=price ELSE spot*(1+bf/depth*.5)>=price END THEN k END) OVER (PARTITION BY symbol, side) AS stop FROM (SELECT *,
         row_number() OVER w AS k, coalesce(sum(volume) OVER (PARTITION BY symbol, side ORDER BY far, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         0) AS bf FROM (SELECT t.symbol, CASE WHEN side='buy' THEN 'long' ELSE 'short' END AS side, price, volume, seq, spot, depth, oi, dv,
         abs(price-spot) AS far FROM ticks t JOIN mk USING (symbol) WHERE CASE WHEN side='buy' THEN price<spot ELSE price>spot END)
         WINDOW w AS (PARTITION BY symbol, side ORDER BY far, seq))) WHERE stop IS NULL OR k<stop GROUP BY 1,2) GROUP BY 1)""", MP)(
    lambda s, d: D.cascade(levels(s, d), markets(s, d)))
query("leverage_heatmap", "symbol band price_from:4 longs:2 shorts:2 intensity:6 asymmetry:6",
      """SELECT symbol, b AS band, spot+(b-10)*spot*.01 AS price_from, l AS longs, h AS shorts, (l+h)/greatest(max(l+h) OVER w, 1) AS intensity,
         (sum(l) OVER w-sum(h) OVER w)/(sum(l) OVER w+sum(h) OVER w) AS asymmetry FROM (SELECT mk.symbol, b, any_value(spot) AS spot,
         coalesce(sum(volume) FILTER (side='buy' AND bb=b),0) AS l, coalesce(sum(volume) FILTER (side='sell' AND bb=b),0) AS h FROM (SELECT t.*, spot,
         floor((CASE WHEN side='buy' THEN price*(1-1/(2+seq%20)) ELSE price*(1+1/(2+seq%20)) END-(spot-spot*.01*20/2))/(spot*.01)) AS bb FROM ticks t JOIN
         mk USING (symbol)) mk, range(20) r(b) GROUP BY 1,2) WINDOW w AS (PARTITION BY symbol)""", MP)(
    lambda s, d: D.leverage_heatmap(levels(s, d).withColumn("leverage", (2 + F.col("seq") % 20).cast("double")), markets(s, d)))
query("liq_heatmap_book", "venue symbol ts leverage long_liq:2 short_liq:2 bid_volume:4 ask_volume:4",
      """SELECT venue, symbol, ts, lv AS leverage, mid*(1-1.0/lv) AS long_liq, mid*(1+1.0/lv) AS short_liq, coalesce(sum(qty) FILTER (side='bid' AND
         abs(price-mid*(1-1.0/lv))<=mid*.005),0) AS bid_volume, coalesce(sum(qty) FILTER (side='ask' AND abs(price-mid*(1+1.0/lv))<=mid*.005),0) AS
         ask_volume FROM (SELECT *, (max(price) FILTER (side='bid' AND level=1) OVER w+max(price) FILTER (side='ask' AND level=1) OVER w)/2 AS mid FROM book
         WINDOW w AS (PARTITION BY venue, symbol, ts)), (SELECT unnest([2,5,10,50]) AS lv) WHERE mid IS NOT NULL GROUP BY venue, symbol, ts, lv, mid""",
      ctes("book"))(lambda s, d: D.liq_heatmap_book(V.book_levels(s, d), (2, 5, 10, 50)))


def oi(s, d):
    t = V.ticks(s, d)
    return t.groupBy("symbol", F.date_trunc("hour", "ts").alias("_h")).agg(
        F.sum("volume").alias("open_interest"), F.max_by("price", F.struct("ts", "seq")).alias("price"),
        (F.avg(F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)) / 1000).alias("funding_rate")).withColumnRenamed("_h", "ts")


query("oi_analysis", "symbol n oi_change:6 corr:6 trend build_up deleveraging long_ratio:6 reading_1 reading_3 reading_5",
      """SELECT symbol, n, c AS oi_change, corr, CASE WHEN c>.05 THEN 'increasing' WHEN c<-.05 THEN 'decreasing' ELSE 'stable' END AS trend, c>.1 AND pv<.05
         AS build_up, c<-.1 OR (c<-.05 AND sign(f3)<>sign(f)) AS deleveraging, .5+greatest(-.4, least(.4, f*100)) AS long_ratio, """ + ", ".join(
          f"""CASE WHEN o0>o{k} AND p0>p{k} THEN 'new_longs' WHEN o0>o{k} AND p0<p{k} THEN 'new_shorts' WHEN o0<o{k} AND p0<p{k} THEN 'long_liquidations'
         WHEN o0<o{k} AND p0>p{k} THEN 'short_liquidations' ELSE 'neutral' END AS reading_{k}""" for k in (1, 3, 5)) + """ FROM (SELECT symbol, count(*) AS n,
         avg(o) FILTER (k>n//2)/avg(o) FILTER (k<=n//2)-1 AS c, corr(o, p) AS corr, stddev_samp(p)/avg(p) AS pv, avg(f) AS f, avg(f) FILTER (n-k<3) AS f3, """
      + ", ".join(f"max({c}) FILTER (n-k={k}) AS {c}{k}" for c in "op" for k in (0, 1, 3, 5)) + """ FROM (SELECT symbol, ts, o, p, f, row_number() OVER
         (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, date_trunc('hour', ts) AS ts, sum(volume) AS o,
         arg_max(price, ROW(ts, seq)) AS p, avg(CASE WHEN side='buy' THEN 1.0 ELSE -1.0 END)/1000 AS f FROM ticks GROUP BY 1,2)) GROUP BY 1)""", TICKS)(
    lambda s, d: D.oi_analysis(oi(s, d), HOUR_SERIES))


def margin_positions(s, d):
    c = V.table(s, d, "customer")
    return c.select(F.col("c_nationkey").alias("account"), F.abs("c_acctbal").alias("size"), (100.0 + F.col("c_custkey") % 10).alias("entry_price"),
                    (2.0 + F.col("c_custkey") % 20).alias("leverage"), F.lit(0.005).alias("maintenance_margin"),
                    F.when(F.col("c_acctbal") >= 0, "long").otherwise("short").alias("side"))


query("margin_call_grid", "account shock:2 n_liquidated loss:2 pnl:2 surviving_margin:2",
      """SELECT account, shock, CAST(count(*) FILTER (o) AS BIGINT) AS n_liquidated, sum(CASE WHEN o THEN greatest(0, m-greatest(0, m+p)) ELSE 0 END) AS loss,
         sum(CASE WHEN o THEN -m ELSE p END) AS pnl, sum(CASE WHEN o THEN 0 ELSE m+p END) AS surviving_margin FROM (SELECT *, m+p < nt*.005 AS o FROM (SELECT
         account, shock, nt, nt/lv AS m, CASE WHEN lg THEN nt*shock ELSE -nt*shock END AS p FROM (SELECT c_nationkey AS account, abs(c_acctbal)*(100.0+
         c_custkey%10) AS nt, 2.0+c_custkey%20 AS lv, c_acctbal>=0 AS lg FROM customer), (SELECT unnest([-.2::DOUBLE,-.1,-.05,.05,.1,.2]) AS shock)))
         GROUP BY 1,2""")(lambda s, d: D.margin_call_grid(margin_positions(s, d), [-0.2, -0.1, -0.05, 0.05, 0.1, 0.2]))
query("worst_shock", "account shock:2 loss:0",
      f"SELECT account, arg_min(shock, ROW(-loss, shock)) AS shock, max(loss) AS loss FROM ({ORACLES['margin_call_grid']}) GROUP BY 1")(
    lambda s, d: D.worst_shock(D.margin_call_grid(margin_positions(s, d), [-0.2, -0.1, -0.05, 0.05, 0.1, 0.2])))
query("effective_leverage", "account gross:6 net:6 long:6 short:6 margin_used:3 free_margin:3 margin_level:6 distance:6",
      """SELECT account, g/e AS gross, abs(l-h)/e AS net, l/e AS long, h/e AS short, m AS margin_used, greatest(0,e-m) AS free_margin, e/m AS margin_level,
         greatest(0,e-m)/g AS distance FROM (SELECT c_nationkey AS account, sum(abs(c_acctbal)) AS g, sum(abs(c_acctbal))*.1 AS m, sum(greatest(c_acctbal,0))
         AS l, sum(greatest(-c_acctbal,0)) AS h, count(*)*1000.0 AS e FROM customer GROUP BY 1)""")(
    lambda s, d: (lambda c: D.effective_leverage(
        c.select(F.col("c_nationkey").alias("account"), F.col("c_acctbal").alias("notional"), (F.abs("c_acctbal") * 0.1).alias("margin")),
        c.groupBy(F.col("c_nationkey").alias("account")).agg((F.count(F.lit(1)) * 1000.0).alias("equity"))))(V.table(s, d, "customer")))
query("liq_flow", "symbol total_flow:2 n_levels multiplier:6 slippage:6 flow",
      """SELECT symbol, f AS total_flow, k AS n_levels, CASE WHEN k<=1 THEN 1 ELSE 1+log2(k)*.3 END AS multiplier, least(.1, f/(spot*1000)*.01) AS slippage,
         'sell' AS flow FROM (SELECT symbol, any_value(spot) AS spot, coalesce(sum(volume) FILTER (h),0) AS f, CAST(count(*) FILTER (h) AS BIGINT) AS k FROM (
         SELECT symbol, volume, spot, side='buy' AND price BETWEEN spot*(1-.1) AND spot AS h FROM ticks JOIN mk USING (symbol)) GROUP BY 1)""", MP)(
    lambda s, d: D.liq_flow(levels(s, d), markets(s, d), "down", 0.1))


def chain(s, d):
    p = V.table(s, d, "part")
    spot = p.groupBy(F.col("p_brand").alias("underlying")).agg(F.avg("p_retailprice").alias("spot"))
    return p.select(F.col("p_brand").alias("underlying"), F.col("p_partkey").alias("seq"),
                    F.expr("timestamp'2025-01-01' + make_dt_interval(CAST(p_partkey % 3 AS INT) * 60)").alias("expiry"),
                    F.floor(F.col("p_retailprice") / 10).cast("double").alias("k"), F.when(F.floor(F.col("p_partkey") / 3) % 2 == 0, "call").otherwise("put").alias("type"),
                    (0.2 + F.col("p_size") / 100).alias("iv"), (F.col("p_size") * 10.0).alias("open_interest"), F.lit(0.03).alias("rate")
                    ).withColumn("strike", F.col("k") * 10).drop("k").join(spot, "underlying")


CH = """ch AS MATERIALIZED (SELECT p_brand AS underlying, p_partkey AS seq, TIMESTAMP '2025-01-01'+to_days(CAST(p_partkey%3*60 AS INTEGER)) AS expiry,
  floor(p_retailprice/10)*10 AS strike, CASE WHEN (p_partkey//3)%2=0 THEN 'call' ELSE 'put' END AS type, .2+p_size/100 AS iv, p_size*10.0::DOUBLE AS oi,
  avg(p_retailprice) OVER (PARTITION BY p_brand) AS spot, (184+p_partkey%3*60)/365 AS t FROM part)"""
query("vol_surface", "underlying expiry n atm_strike:2 atm_iv:6 skew:6 kurtosis:6",
      """SELECT underlying, expiry, n, ks[n//2+1] AS atm_strike, (SELECT arg_min(iv, seq) FROM ch c WHERE c.underlying=g.underlying AND c.expiry=g.expiry AND
         c.strike=g.ks[g.n//2+1]) AS atm_iv, skew, kurtosis FROM (SELECT underlying, expiry, count(*) AS n, list_sort(list(strike)) AS ks FROM ch GROUP BY 1,2) g
         JOIN (SELECT underlying, avg(power((iv-m)/s,3)) AS skew, avg(power((iv-m)/s,4))-3 AS kurtosis FROM (SELECT *, avg(iv) OVER (PARTITION BY underlying)
         AS m, stddev_samp(iv) OVER (PARTITION BY underlying) AS s FROM ch) GROUP BY 1) USING (underlying)""", "WITH " + CH)(
    lambda s, d: D.vol_surface(chain(s, d)))
query("skew_metrics", "underlying expiry risk_reversal:6 butterfly:6 skew_index:6 put_call_skew:6",
      """SELECT underlying, expiry, coalesce(c-p,0) AS risk_reversal, coalesce((c+p)/2-a,0) AS butterfly, coalesce(pi/ci-1,0) AS skew_index, coalesce(pi-ci,0) AS put_call_skew FROM (SELECT underlying, expiry,
         arg_min(iv, ROW(abs(strike-k75), strike, seq)) FILTER (type='call') AS c, arg_min(iv, ROW(abs(strike-k25), strike, seq)) FILTER (type='put') AS p,
         arg_min(iv, ROW(abs(strike-k50), strike, seq)) AS a, avg(iv) FILTER (type='put') AS pi, avg(iv) FILTER (type='call') AS ci FROM ch JOIN (SELECT underlying,
         expiry, list_sort(list(strike))[CAST(floor(count(*)*.25) AS INT)+1] AS k25, list_sort(list(strike))[CAST(floor(count(*)*.5) AS INT)+1] AS k50,
         list_sort(list(strike))[CAST(floor(count(*)*.75) AS INT)+1] AS k75 FROM ch GROUP BY 1,2) USING (underlying, expiry) GROUP BY 1,2)""", "WITH " + CH)(
    lambda s, d: D.skew_metrics(chain(s, d)))
query("greeks_exposure", "underlying delta:4 gamma:4 theta:4 vega:4",
      """SELECT underlying, sum(iv*oi) AS delta, sum(strike*oi/1000) AS gamma, sum(-iv*oi) AS theta, sum(spot*oi/1000) AS vega FROM ch GROUP BY 1""", "WITH " + CH)(
    lambda s, d: D.greeks_exposure(chain(s, d).select("underlying", F.col("iv").alias("delta"), (F.col("strike") / 1000).alias("gamma"),
                                                     (-F.col("iv")).alias("theta"), (F.col("spot") / 1000).alias("vega"), F.col("open_interest").alias("quantity"))))
query("max_pain", "underlying expiry max_pain:2 pain:2",
      """SELECT underlying, expiry, arg_min(k, ROW(round(pain,6), k)) AS max_pain, min(pain) AS pain FROM (SELECT a.underlying, a.expiry, k, sum(CASE WHEN type='call'
         THEN greatest(k-strike,0) ELSE greatest(strike-k,0) END*oi) AS pain FROM (SELECT DISTINCT underlying, expiry, strike AS k FROM ch) a JOIN ch b ON
         a.underlying=b.underlying AND a.expiry=b.expiry GROUP BY 1,2,3) GROUP BY 1,2""", "WITH " + CH)(lambda s, d: D.max_pain(chain(s, d)))
CDF = "(0.5*(1+{s}*(1-((((1.061405429*{t}-1.453152027)*{t}+1.421413741)*{t}-0.284496736)*{t}+0.254829592)*{t}*exp(-{x}*{x}/2))))"


def ncdf(x: str) -> str:
    z = f"abs({x})/sqrt(2)"
    return CDF.format(s=f"(CASE WHEN {x}>=0 THEN 1 ELSE -1 END)", t=f"(1/(1+0.3275911*{z}))", x=f"({x})")


THEO = f"""(SELECT *, CASE WHEN type='call' THEN spot*n1-strike*dc*n2 ELSE
         strike*dc*(1-n2)-spot*(1-n1) END AS theo, CASE WHEN type='call' THEN n1 ELSE n1-1 END AS delta FROM (SELECT *, exp(-.03*t) AS dc, exp(-d1*d1/2)/sqrt(2*pi())
         AS pd, {ncdf('d1')} AS n1, {ncdf('d2')} AS n2 FROM (SELECT *, d1-iv*sqrt(t) AS d2 FROM (SELECT *, (ln(spot/strike)+(.03+.5*iv*iv)*t)/(iv*sqrt(t)) AS d1
         FROM ch))))"""
query("chain_panel", "underlying seq theo:5 delta:5 gamma:7 vega:5 theta:6 rho:5 implied:3 breakeven:5",
      f"""SELECT underlying, seq, theo, delta, pd/(spot*iv*sqrt(t)) AS gamma, spot*pd*sqrt(t)/100 AS vega, (-(spot*pd*iv)/(2*sqrt(t))-.03*strike*dc*CASE WHEN
         type='call' THEN n2 ELSE n2-1 END)/365 AS theta, strike*t*dc*CASE WHEN type='call' THEN n2 ELSE n2-1 END/100 AS rho, iv AS implied,
         CASE WHEN type='call' THEN strike+theo ELSE strike-theo END AS breakeven FROM {THEO}""", "WITH " + CH)(
    lambda s, d: P.chain_panel(chain(s, d), "2024-07-01"))
query("put_call_parity", "underlying expiry strike:2 gap:3",
      f"""SELECT underlying, expiry, strike, avg(theo) FILTER (type='call')-avg(theo) FILTER (type='put')-max(spot)+strike*exp(-.03*max(t)) AS gap
         FROM {THEO} GROUP BY 1,2,3 HAVING count(*) FILTER (type='call')>0 AND count(*) FILTER (type='put')>0""", "WITH " + CH)(
    lambda s, d: P.parity_gap(P.chain_panel(chain(s, d), "2024-07-01")))


# --- panels
def fundamentals(s, d):
    o = V.table(s, d, "orders").join(V.table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    g = o.groupBy(F.col("c_mktsegment").alias("asset"), F.date_trunc("month", "o_orderdate").alias("date")).agg(
        F.sum("o_totalprice").alias("x"), F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("b"), F.max("o_totalprice").alias("m"))
    x, n, b, m = F.col("x"), F.col("n"), F.col("b"), F.col("m")
    return g.select("asset", "date", F.array(x / 10, x / 9, x / 8).alias("cash_flows"), F.lit(0.1).alias("discount_rate"), (x * 1.2).alias("fair_value"),
                    (x + b).alias("price"), x.alias("market_cap"), (x / 30).alias("daily_volume"), (b + x / 2).alias("realized_cap"), (n * 100.0).alias("supply"),
                    (n * 1.0).alias("annual_production"), (x * 1.5).alias("fdv"), (x / 20).alias("fees"), (n * 1.0).alias("addresses"), m.alias("security_spend"),
                    (b + x).alias("tvl"), (x / 10).alias("fcf"), (m / 1000).alias("eps"), (m / 100).alias("bvps"), b.alias("net_income"), n.alias("depreciation"),
                    (n * 2).alias("capex"), (b / 10).alias("wc_change"), F.lit(0.6).alias("equity_weight"), F.lit(0.09).alias("cost_equity"),
                    F.lit(0.05).alias("cost_debt"), (n / 100).alias("asset_beta"), (m / n).alias("pe"), (n * 1.0).alias("growth"), (x * 1.1).alias("ev"), (x / 7).alias("ebitda"))


VAL = """fn AS (SELECT c_mktsegment AS asset, date_trunc('month', o_orderdate) AS date, sum(o_totalprice) AS x, count(*) AS n, sum(c_acctbal) AS b,
   max(o_totalprice) AS m FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1,2),
 vp AS (SELECT *, x/10/1.1+x/9/1.21+x/8/1.331+x/8*1.02/.08/1.331 AS dcf, (x*1.2-x-b)/(x*1.2) AS margin_of_safety, x/(x/30*365) AS nvt, x/(b+x/2) AS mvrv,
   100.0 AS stock_to_flow, exp(3.21*ln(100)+14.6) AS s2f_price, x*1.5/(x/20) AS price_to_fees, x/20*10 AS fee_value, .001*n*n AS metcalfe, x/m AS thermocap,
   x/(b+x) AS mcap_tvl, x/10*(1.08/1.1+power(1.08/1.1,2)+power(1.08/1.1,3)+power(1.08/1.1,4)+16*power(1.08/1.1,5)) AS intrinsic, sqrt(22.5*m/1000*m/100) AS graham,
   b+n-2*n-b/10 AS owner_earnings, .6*.09+.4*.05*.75 AS wacc, .03+n/100*.05 AS capm, m/n/n AS peg, .1 AS fcf_yield, x*1.1/(x/7) AS ev_ebitda FROM fn)"""
_VALS = ("dcf:2 margin_of_safety:6 nvt:6 mvrv:6 stock_to_flow:4 s2f_price:0 price_to_fees:6 fee_value:2 metcalfe:6 thermocap:6 mcap_tvl:6 intrinsic:2 graham:7 "
         "owner_earnings:2 wacc:6 capm:6 peg:6 fcf_yield:6 ev_ebitda:6")
query("valuation_panel", f"asset date {_VALS} date_percentile:6 history_z:6",
      """SELECT *, (SELECT count(*) FROM vp q WHERE q.date=vp.date AND q.mvrv<vp.mvrv)/count(*) OVER (PARTITION BY date) AS date_percentile,
         (mvrv-avg(mvrv) OVER (PARTITION BY asset))/stddev_samp(mvrv) OVER (PARTITION BY asset) AS history_z FROM vp""", "WITH " + VAL)(
    lambda s, d: P.valuation_panel(fundamentals(s, d)))
query("sizing_panel", "order_id strategy kelly_fraction:6 kelly_value:2 fixed_size:4",
      """SELECT id AS order_id, strategy, k AS kelly_fraction, k*100000 AS kelly_value, CASE WHEN price=price*.9+fee/amount THEN 0 ELSE 2000/abs(price-(price*.9+
         fee/amount)) END AS fixed_size FROM fills JOIN (SELECT strategy, greatest(0, wr-(1-wr)/(aw/al))/2 AS k FROM (SELECT strategy, avg(CASE WHEN pnl>0 THEN 1.0
         ELSE 0 END) AS wr, avg(pnl) FILTER (pnl>0) AS aw, avg(-pnl) FILTER (pnl<0) AS al FROM (SELECT strategy, CASE WHEN side='sell' THEN cost ELSE -cost*.6 END
         AS pnl FROM fills) GROUP BY 1)) USING (strategy)""", ctes("fills"))(
    lambda s, d: (lambda f: P.sizing_panel(
        f.select("strategy", F.when(F.col("side") == "sell", F.col("cost")).otherwise(-F.col("cost") * 0.6).alias("pnl")),
        f.select(F.col("id").alias("order_id"), "strategy", F.col("price").alias("entry"), (F.col("price") * 0.9 + F.col("fee") / F.col("amount")).alias("stop")),
        100_000.0))(V.fills(s, d)))
query("carry_panel", "symbol ts funding_annual:11 carry_pnl:9 carry_annual:9 cash_carry:9 cash_carry_annual:9 hedge_cost_annual:11 net_carry:8 signal best",
      """SELECT *, CASE WHEN net_carry>5 THEN 'strong_positive' WHEN net_carry>1 THEN 'positive' WHEN net_carry>-1 THEN 'neutral' WHEN net_carry>-5 THEN 'negative'
         ELSE 'strong_negative' END AS signal, first(symbol) OVER (PARTITION BY ts ORDER BY net_carry DESC, symbol)=symbol AS best FROM (SELECT symbol, ts,
         r*1095 AS funding_annual, f-s+r*90*s-.05*30/365*s AS carry_pnl, ((f-s)/s+r*90-.05*30/365)/(30/365) AS carry_annual,
         f-s-s*.001-f*.0005-s*.05*30/365 AS cash_carry, (f-s-s*.001-f*.0005-s*.05*30/365)/s/(30/365) AS cash_carry_annual, abs(r)*1095 AS hedge_cost_annual,
         (f-s)/s*36500+r*109500-.2 AS net_carry FROM (SELECT symbol, ts, avg(idx) AS s, max(mark) AS f, avg(rate) AS r FROM funding GROUP BY 1,2))""", FP)(
    lambda s, d: P.carry_panel(funding(s, d).groupBy("symbol", "ts").agg(
        F.avg("idx").alias("spot"), F.max("mark").alias("futures"), F.avg("rate").alias("rate"))))
DAYS = """dy AS (SELECT venue, date_trunc('day', ts) AS day, sum(volume) FILTER (price>250) AS liq, sum(volume)*20 AS oi, sum(volume) AS vol, sum(volume)*2 AS fund,
   arg_max(price, ROW(ts, seq))/arg_min(price, ROW(ts, seq))-1 AS chg, avg(CASE WHEN side='buy' THEN 1.0 ELSE -1.0 END)/1000 AS fr, stddev_samp(price)/avg(price)
   AS sg FROM ticks GROUP BY 1,2)"""


def days(s, d):
    o, p, v = F.struct("ts", "seq"), F.col("price"), F.sum("volume")
    return V.ticks(s, d).groupBy("venue", F.date_trunc("day", "ts").alias("day")).agg(
        F.coalesce(F.sum(F.when(p > 250, F.col("volume"))), F.lit(0.0)).alias("liquidated"), (v * 20).alias("open_interest"), v.alias("volume"),
        (v * 2).alias("fund"), (F.max_by("price", o) / F.min_by("price", o) - 1).alias("price_change"),
        (F.avg(F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)) / 1000).alias("funding_rate"), (F.stddev_samp(p) / F.avg(p)).alias("volatility"))


query("leverage_panel", "venue coverage:6 coverage_days:4 depletion_risk:6 risk delev_index:6 delev_signal max_leverage:6 safe_leverage:6",
      """SELECT venue, f/oi AS coverage, f/l AS coverage_days, least(1, (l+2*ls)/f) AS depletion_risk, CASE WHEN f/oi>.02 AND f/l>30 AND f/av>.1 THEN 'healthy' WHEN
         f/oi>.01 AND f/l>14 THEN 'adequate' WHEN f/oi>.005 AND f/l>7 THEN 'stressed' ELSE 'critical' END AS risk, ix AS delev_index, CASE WHEN ix>.6 THEN
         'active_deleveraging' WHEN ix<.3 THEN 'building_leverage' ELSE 'neutral' END AS delev_signal, ml AS max_leverage, greatest(1, ml*.6) AS safe_leverage FROM (
         SELECT *, greatest(0, least(1, 1-oi/v))*.3+least(1, v/oi*2)*.3+least(1, abs(c)*10)*.25+least(1, abs(fr)*100)*.15 AS ix,
         greatest(1, least(100, .2/(1.645*sg*sqrt(5)))) AS ml FROM (SELECT venue, arg_max(fund, day) AS f, arg_max(oi, day) AS oi, avg(coalesce(liq,0)) AS l,
         stddev_samp(coalesce(liq,0)) AS ls, avg(vol) AS av, arg_max(vol, day) AS v, arg_max(chg, day) AS c, arg_max(fr, day) AS fr, avg(sg) AS sg FROM dy GROUP BY 1))""",
      ctes("ticks", more=DAYS))(lambda s, d: P.leverage_panel(days(s, d)))
HR = """hm AS (SELECT symbol, date_trunc('hour', ts) AS ts, avg(price) AS price, max(price) AS high, min(price) AS low, sum(volume) AS volume, avg(CASE WHEN side='buy'
   THEN 1.0 ELSE -1.0 END)/1000 AS rate, count(*) FILTER (side='buy')+1 AS buys, count(*) FILTER (side='sell')+1 AS sells, coalesce(sum(volume) FILTER
   (side='buy'),0)+1 AS bv, coalesce(sum(volume) FILTER (side='sell'),0)+1 AS sv FROM ticks GROUP BY 1,2),
 h1 AS (SELECT *, price/lag(price) OVER (PARTITION BY symbol ORDER BY ts)-1 AS ret, high-low AS rg FROM hm),
 h2 AS (SELECT *, coalesce(stddev_samp(ret) OVER w,0) AS vl, coalesce(avg(ret) OVER w,0) AS mo, avg(volume) OVER w AS av, avg(rg) OVER w AS ar, avg(rate) OVER w
   AS fr FROM h1 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
 h3 AS MATERIALIZED (SELECT *, avg(vl) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS avl, (sv/bv+sells/buys)/2 AS pc,
   (buys/(buys+sells)+bv/(bv+sv))/2 AS ls FROM h2)"""


def hour_market(s, d):
    buy, sell, v = F.col("side") == "buy", F.col("side") == "sell", F.col("volume")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)) + 1
    return V.ticks(s, d).groupBy("symbol", F.date_trunc("hour", "ts").alias("_h")).agg(
        F.avg("price").alias("price"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum(v).alias("volume"),
        (F.avg(F.when(buy, 1.0).otherwise(-1.0)) / 1000).alias("rate"), one(buy).alias("buys"), one(sell).alias("sells"),
        (F.sum(F.when(buy, v).otherwise(0.0)) + 1).alias("buy_volume"), (F.sum(F.when(sell, v).otherwise(0.0)) + 1).alias("sell_volume")).withColumnRenamed("_h", "ts")


CL = lambda x: f"greatest(0, least(100, {x}))"
query("sentiment_panel", "symbol ts fear_greed:5 label put_call:6 pc_signal account_ratio:6 crowding reversal_risk:6",
      f"""SELECT *, CASE WHEN fear_greed<=20 THEN 'extreme_fear' WHEN fear_greed<=40 THEN 'fear' WHEN fear_greed<=60 THEN 'neutral' WHEN fear_greed<=80 THEN 'greed' ELSE
         'extreme_greed' END AS label FROM (SELECT symbol, ts, {CL('100-(CASE WHEN avl=0 THEN 1 ELSE vl/avl END-.5)*100')}*.25+{CL('50+mo*500')}*.25+
         {CL('50+CASE WHEN mo>=0 THEN 1 ELSE -1 END*(volume/av-1)*50')}*.2+{CL('100-(CASE WHEN ar=0 THEN 1 ELSE rg/ar END-.5)*100')}*.15+{CL('50+fr*10000')}*.15
         AS fear_greed, pc AS put_call, CASE WHEN pc>1.5 THEN 'extreme_bearish' WHEN pc>1.1 THEN 'bearish' WHEN pc>.7 THEN 'neutral' WHEN pc>.5 THEN 'bullish' ELSE
         'extreme_bullish' END AS pc_signal, buys/(buys+sells) AS account_ratio, CASE WHEN ls>.65 THEN 'long_crowded' WHEN ls<.35 THEN 'short_crowded' ELSE 'balanced'
         END AS crowding, greatest(0, least(1, abs(ls-.5)*4)) AS reversal_risk FROM h3)""", ctes("ticks", more=HR))(
    lambda s, d: P.sentiment_panel(hour_market(s, d), HOUR_SERIES))
query("contrarian", "symbol percentile:6 n_extreme accuracy:6 extreme:6 signal confidence:6",
      """SELECT *, CASE WHEN signal='neutral' THEN 0 ELSE greatest(0, least(1, extreme*accuracy)) END AS confidence FROM (SELECT symbol, max(p) FILTER (k=n) AS percentile,
         CAST(count(*) FILTER (f IS NOT NULL AND (p>=.85 OR p<=.15)) AS BIGINT) AS n_extreme, count(*) FILTER ((p>=.85 AND f<price) OR (p<=.15 AND f>price))/count(*) FILTER
         (f IS NOT NULL AND (p>=.85 OR p<=.15)) AS accuracy, greatest(max(p) FILTER (k=n), 1-max(p) FILTER (k=n))*2-1 AS extreme, CASE WHEN max(p) FILTER (k=n)>=.85 THEN
         'contrarian_sell' WHEN max(p) FILTER (k=n)<=1-.85 THEN 'contrarian_buy' ELSE 'neutral' END AS signal FROM (SELECT *, (rank() OVER (PARTITION BY symbol ORDER BY
         volume)-1)/count(*) OVER (PARTITION BY symbol) AS p, lead(price, 10) OVER (PARTITION BY symbol ORDER BY ts) AS f, row_number() OVER (PARTITION BY symbol ORDER
         BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM hm) GROUP BY 1)""", ctes("ticks", more=HR))(
    lambda s, d: P.contrarian(hour_market(s, d), HOUR_SERIES, "volume", "price"))


def parent_costs(s, d):
    o, k = V.table(s, d, "orders"), F.col("o_custkey")
    p = 100.0 + k % 50
    return o.select(F.concat(F.lit("S"), k % 20).alias("symbol"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("o_totalprice") / 1000).alias("amount"),
                    p.alias("decision_price"), (p * (1 + (F.col("o_orderkey") % 7 - 3) / 1000)).alias("price"), (k % 7 * 1000 + 5000).cast("double").alias("daily_volume"),
                    (0.01 + k % 5 / 100).alias("volatility"), (1.0 + k % 9).alias("spread_bps"), (k % 4 * 30 + 30).alias("duration_min"),
                    F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3 + 1).cast("int")).alias("urgency"),
                    (p - 0.05).alias("bid"), (p + 0.05).alias("ask"), (k % 90 + 10).cast("double").alias("latency_ms"))


OC = """oc AS (SELECT 'S'||(c%20) AS symbol, c%2=0 AS buy, o_totalprice/1000 AS amount, 100.0::DOUBLE+c%50 AS dp, (100.0::DOUBLE+c%50)*(1+(o_orderkey%7-3)/1000) AS price,
   CAST(c%7*1000+5000 AS DOUBLE) AS dv, .01+c%5/100 AS vl, 1.0+c%9 AS sp, c%4*30+30 AS dm, c%3 AS ug, c%90+10 AS lat FROM (SELECT *, o_custkey AS c FROM orders)),
 od AS (SELECT *, CASE WHEN buy THEN price-dp ELSE dp-price END/dp*10000 AS sf, floor(amount*price*(.142*vl*sqrt(amount/dv)*10000+.314*vl*amount/dv*10000)/10000*100
   +.5)/100 AS ic, amount*price*sqrt(amount/dv/greatest(3, ceil(dm/10)))*80*.85/10000 AS vw, amount*price*(sp+sqrt(amount/dv)*30)/10000 AS ib,
   vl*sqrt(lat/1000)*sqrt(amount/dv)*10000 AS lb FROM oc)"""
query("order_cost_panel", "symbol n_orders shortfall_bps:4 impact_cost:1 plan_cost:2 latency_bps:4 n_vwap n_market",
      """SELECT symbol, count(*) AS n_orders, avg(sf) AS shortfall_bps, sum(ic) AS impact_cost, sum(least(vw, ib)) AS plan_cost, avg(lb) AS latency_bps,
         CAST(count(*) FILTER (vw<=ib) AS BIGINT) AS n_vwap, CAST(count(*) FILTER (ug=2) AS BIGINT) AS n_market FROM od GROUP BY 1""", "WITH " + OC)(
    lambda s, d: P.order_cost_panel(parent_costs(s, d)))
query("latency_curve", "latency_ms cost_bps:5",
      """SELECT l AS latency_ms, avg(vl*sqrt(l/1000)*sqrt(amount/dv)*10000) AS cost_bps FROM oc, (SELECT unnest([1,5,10,25,50,100,250,500,1000]) AS l) GROUP BY 1""",
      "WITH " + OC)(lambda s, d: P.latency_curve(parent_costs(s, d)))
query("cheapest_venue", "venue fee:8 monthly_cost:2 rank",
      """SELECT *, fee*1000000 AS monthly_cost, row_number() OVER (ORDER BY fee, venue) AS rank FROM (SELECT venue, min(fee)*.5*.6+min(fee)*.4 AS fee FROM ticks GROUP BY 1)""",
      TICKS)(lambda s, d: P.cheapest_venue(V.ticks(s, d).groupBy("venue").agg((F.min("fee") * 0.5).alias("maker_fee"), F.min("fee").alias("taker_fee"),
                                                                              F.lit(0.0).alias("maker_rebate")), 1_000_000.0, 0.6))

"""Factor and portfolio risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as A
from ..operators import risk as K
from ..sources import views as V
from .base import ORACLES, query
from .sql import BARS, RETS, ctes
from .stats import rets

CR = """cr AS MATERIALIZED (SELECT symbol, ts, ret, dense_rank() OVER (ORDER BY ts) AS t FROM rets WHERE ts IN (SELECT ts FROM rets
  GROUP BY 1 HAVING count(DISTINCT symbol)=(SELECT count(DISTINCT symbol) FROM rets)))"""


def half(col: str, name: str) -> str:
    return (f"(SELECT symbol, CASE WHEN row_number() OVER (ORDER BY {col}, symbol) <= count(*) OVER ()//2 THEN -1 ELSE 1 END "
            f"AS {name} FROM chars)")


FAC = "hv AS (SELECT * FROM " + " JOIN ".join(
    [half("market_cap", "sz"), half("book_to_market", "bm") + " USING (symbol)", half("profitability", "pr") + " USING (symbol)",
     half("investment", "iv") + " USING (symbol)"]).replace(") JOIN", ") x1 JOIN", 1) + """),
 fac AS MATERIALIZED (SELECT m.ts, market, smb, hml, rmw, cma FROM (SELECT ts, avg(ret) AS market FROM rets GROUP BY 1) m JOIN (
  SELECT ts, coalesce(avg(ret) FILTER (sz=-1),0)-coalesce(avg(ret) FILTER (sz=1),0) AS smb, coalesce(avg(ret) FILTER (bm=1),0)
   -coalesce(avg(ret) FILTER (bm=-1),0) AS hml, coalesce(avg(ret) FILTER (pr=1),0)-coalesce(avg(ret) FILTER (pr=-1),0) AS rmw,
   coalesce(avg(ret) FILTER (iv=-1),0)-coalesce(avg(ret) FILTER (iv=1),0) AS cma FROM rets JOIN hv USING (symbol) GROUP BY 1) f USING (ts))"""


def chars(s, d):
    return V.characteristics(s, d)


def facs(s, d):
    return A.factor_returns(rets(s, d), chars(s, d))


query("factor_returns", "ts market:6 smb:6 hml:6 rmw:6 cma:6", "SELECT * FROM fac", ctes("rets", "chars", more=FAC))(facs)

query("factor_returns_store", "ts market:6 smb:6 momentum:6",
      """SELECT ts, avg(ret) AS market, avg(ret) FILTER (h=-1)-avg(ret) FILTER (h=1) AS smb, CASE WHEN max(t)>20 THEN
         avg(ret) FILTER (b<=5)-avg(ret) FILTER (w<=5) ELSE 0 END AS momentum FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY
         tr DESC, symbol) AS b, row_number() OVER (PARTITION BY ts ORDER BY tr, symbol DESC) AS w FROM (SELECT *, sum(ret) OVER
         (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS tr FROM cr)) JOIN (SELECT symbol, CASE WHEN
         row_number() OVER (ORDER BY v, symbol) <= count(*) OVER ()//2 THEN -1 ELSE 1 END AS h FROM (SELECT symbol, avg(volume) AS v
         FROM bars GROUP BY 1)) USING (symbol) GROUP BY 1""", ctes("rets", more=CR))(
    lambda s, d: A.factor_returns_store(rets(s, d), V.bars(s, d).groupBy("symbol").agg(F.avg("volume").alias("size"))))

query("xs_momentum", "symbol cum:6 rank quintile z:6",
      """SELECT symbol, cum, row_number() OVER (ORDER BY cum DESC, symbol) AS rank, CAST(least(5, floor((row_number() OVER (ORDER BY
         cum DESC, symbol)-1)/count(*) OVER ()*5)+1) AS BIGINT) AS quintile, (cum-avg(cum) OVER ())/stddev_samp(cum) OVER () AS z FROM (
         SELECT symbol, product(1+ret)-1 AS cum FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM rets)
         WHERE k>21 AND k<=273 GROUP BY 1)""", RETS)(lambda s, d: A.xs_momentum(rets(s, d)))
query("long_short_spread", "spread:4",
      f"""SELECT coalesce(avg(cum) FILTER (quintile=1),0)-coalesce(avg(cum) FILTER (quintile=5),0) AS spread FROM ({ORACLES['xs_momentum']})""")(
    lambda s, d: A.long_short_spread(A.xs_momentum(rets(s, d))))

COV = """cv AS MATERIALIZED (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.ret, y.ret) AS cov, count(*) AS n FROM cr x JOIN cr y
  ON x.ts=y.ts AND x.symbol<=y.symbol GROUP BY 1,2)"""
query("covariance", "a b n cov:6", "SELECT * FROM cv", ctes("rets", more=f"{CR}, {COV}"))(lambda s, d: A.covariance(rets(s, d)))
query("covariance_exponential", "a b cov:6",
      """SELECT x.symbol AS a, y.symbol AS b, sum(power(.5,(mx-x.t)/30)*x.d*y.d)/sum(power(.5,(mx-x.t)/30)) AS cov FROM mm, dc x JOIN dc y
         ON x.ts=y.ts AND x.symbol<=y.symbol GROUP BY 1,2""",
      ctes("rets", more=CR + ", dc AS MATERIALIZED (SELECT *, ret-avg(ret) OVER (PARTITION BY symbol) AS d FROM cr), mm AS (SELECT max(t) AS mx FROM cr)"))(
    lambda s, d: A.covariance(rets(s, d), "exponential"))
SHR = """dc AS MATERIALIZED (SELECT *, ret-avg(ret) OVER (PARTITION BY symbol) AS d FROM cr),
 vr AS (SELECT a AS symbol, cov AS v FROM cv WHERE a=b),
 av AS (SELECT {tgt} AS tg FROM cv JOIN vr x ON x.symbol=a JOIN vr y ON y.symbol=b),
 sh AS MATERIALIZED (SELECT a, b, cov, {goal} AS goal, CASE WHEN a=b THEN 1 ELSE 2 END AS m, (SELECT avg(power(p.d*q.d-cov,2)) FROM dc p
   JOIN dc q ON p.ts=q.ts AND p.symbol=a AND q.symbol=b) AS pi FROM cv JOIN vr x ON x.symbol=a JOIN vr y ON y.symbol=b, av),
 kk AS (SELECT greatest(0, least(1, sum(m*pi)/((SELECT max(n) FROM cv)*sum(m*power(goal-cov,2))))) AS k FROM sh)"""
for _t, _tgt, _goal in (("identity", "avg(cov) FILTER (a=b)", "CASE WHEN a=b THEN tg ELSE 0 END"),
                        ("constant_correlation", "avg(cov/sqrt(x.v*y.v)) FILTER (a<b)",
                         "CASE WHEN a=b THEN x.v ELSE tg*sqrt(x.v*y.v) END")):
    query(f"covariance_shrinkage_{_t}", "a b cov:6 intensity:6", "SELECT a, b, k*goal+(1-k)*cov AS cov, k AS intensity FROM sh, kk",
          ctes("rets", more=f"{CR}, {COV}, " + SHR.format(tgt=_tgt, goal=_goal)))(
        lambda s, d, t=_t: A.covariance(rets(s, d), "shrinkage", target=t))

# leading eigenvectors by squaring the matrix 14 times, then taking the component off
EIG = """fm AS (SELECT list(r ORDER BY a) AS c, list(a ORDER BY a) AS names FROM (SELECT a, list(cov ORDER BY b) AS r FROM (
   SELECT a, b, cov FROM cv UNION ALL SELECT b, a, cov FROM cv WHERE a<>b) GROUP BY 1)),
 pw AS (SELECT 1 AS comp, 0 AS it, c, c AS m FROM fm UNION ALL
  SELECT CASE WHEN it<14 THEN comp ELSE comp+1 END, CASE WHEN it<14 THEN it+1 ELSE 0 END, CASE WHEN it<14 THEN c ELSE d END,
   CASE WHEN it<14 THEN list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s)/(tr*tr))) ELSE d END
  FROM (SELECT *, list_transform(range(1, len(c)+1), lambda i: list_transform(range(1, len(c)+1), lambda j: c[i][j]-lam*v[i]*v[j])) AS d
   FROM (SELECT *, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS lam FROM (
    SELECT *, list_transform(w, lambda x: x/sqrt(list_dot_product(w, w))) AS v FROM (SELECT *, m[list_position(dg, list_max(dg))] AS w,
     list_sum(dg) AS tr FROM (SELECT *, list_transform(range(1, len(m)+1), lambda i: m[i][i]) AS dg FROM pw WHERE comp <= 5)))))),
 ev AS MATERIALIZED (SELECT comp, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS lam FROM (
   SELECT comp, c, list_transform(w, lambda x: x/sqrt(list_dot_product(w, w))) AS v FROM (SELECT *, m[list_position(dg, list_max(dg))] AS w
    FROM (SELECT *, list_transform(range(1, len(m)+1), lambda i: m[i][i]) AS dg FROM pw WHERE comp <= 5 AND it = 14)))),
 ld AS (SELECT comp, lam, unnest(v) AS x, unnest(names) AS symbol FROM ev, fm)"""
query("pca", "factor symbol loading:6 explained:6",
      """SELECT CAST(comp AS BIGINT) AS factor, symbol, x*sign(arg_min(x, ROW(-round(abs(x), 9), symbol)) OVER (PARTITION BY comp)) AS loading,
         lam/(SELECT sum(cov) FROM cv WHERE a=b) AS explained FROM ld""",
      ctes("rets", more=f"{CR}, {COV}, {EIG}", recursive=True))(lambda s, d: A.pca(rets(s, d), 5))

# two-factor least squares by making each factor orthogonal to the other
OLS2 = """o0 AS (SELECT symbol, r.ts, ret AS y, market AS f, smb AS g FROM rets r JOIN fac USING (ts)),
 o1 AS (SELECT symbol, regr_slope(f,g) AS fs, regr_intercept(f,g) AS fi, regr_slope(g,f) AS gs, regr_intercept(g,f) AS gi FROM o0 GROUP BY 1),
 o2 AS (SELECT *, f-fi-fs*g AS rf, g-gi-gs*f AS rg FROM o0 JOIN o1 USING (symbol)),
 o3 AS (SELECT symbol, count(*) AS n, regr_slope(y,rf) AS bf, regr_slope(y,rg) AS bg, var_pop(rf)*count(*) AS sf, var_pop(rg)*count(*) AS sg,
   avg(y) AS my, avg(f) AS mf, avg(g) AS mg, sum(y) AS ty FROM o2 GROUP BY 1),
 o4 AS (SELECT symbol, stddev_samp(y-bf*f-bg*g) AS sd, var_pop(y-bf*f-bg*g)*count(*) AS ss, 1-var_pop(y-bf*f-bg*g)/var_pop(y) AS r2
   FROM o0 JOIN o3 USING (symbol) GROUP BY 1),
 ex AS MATERIALIZED (SELECT *, my-bf*mf-bg*mg AS alpha, bf/sqrt(ss/(n-3)/sf) AS tf, bg/sqrt(ss/(n-3)/sg) AS tg FROM o3 JOIN o4 USING (symbol))"""
EXC = ctes("rets", "chars", more=f"{FAC}, {OLS2}")
query("factor_exposure", "symbol n beta_market:5 beta_smb:5 t_market:5 t_smb:5 alpha:6 r_squared:6 residual_vol:6",
      """SELECT symbol, n, bf AS beta_market, bg AS beta_smb, tf AS t_market, tg AS t_smb, alpha, r2 AS r_squared, sd AS residual_vol FROM ex""",
      EXC)(lambda s, d: A.factor_exposure(rets(s, d), facs(s, d), ["market", "smb"]))
query("factor_attribution", "symbol factor contribution:5 pct:5",
      """SELECT symbol, factor, c AS contribution, c/ty AS pct FROM (SELECT symbol, ty, 'market' AS factor, bf*mf*n AS c FROM ex UNION ALL
         SELECT symbol, ty, 'smb', bg*mg*n FROM ex UNION ALL SELECT symbol, ty, 'specific', ty-bf*mf*n-bg*mg*n FROM ex)""", EXC)(
    lambda s, d: A.factor_attribution(A.factor_exposure(rets(s, d), facs(s, d), ["market", "smb"]), ["market", "smb"]))
query("equity_factor_model", "symbol n alpha:6 r_squared:6 idiosyncratic_vol:6 beta_market:5 beta_smb:5 n_significant",
      """SELECT symbol, n, alpha, r2 AS r_squared, sd AS idiosyncratic_vol, bf AS beta_market, bg AS beta_smb,
         CAST((abs(tf)>2)::INT+(abs(tg)>2)::INT AS BIGINT) AS n_significant FROM ex""", EXC)(
    lambda s, d: A.equity_factor_model(rets(s, d), facs(s, d), ["market", "smb"]).withColumn(
        "n_significant", F.size("significant").cast("long")))
query("style_ols", "symbol n beta_market:5 beta_smb:5 r_squared:6",
      "SELECT symbol, n, bf AS beta_market, bg AS beta_smb, r2 AS r_squared FROM ex", EXC)(
    lambda s, d: A.factor_exposure(rets(s, d), facs(s, d), ["market", "smb"]))
query("crypto_factor_model", "symbol n btc_beta:5 eth_beta:5 alpha:6 r_squared:6 idiosyncratic_vol:6",
      # beta on the orthogonal second factor equals the two-factor beta; the first absorbs the overlap
      """SELECT symbol, n, bf+bg*k AS btc_beta, bg AS eth_beta, alpha+bg*i AS alpha, r2 AS r_squared, sd AS idiosyncratic_vol FROM ex,
         (SELECT regr_slope(smb, market) AS k, regr_intercept(smb, market) AS i FROM fac)""", EXC)(
    lambda s, d: A.crypto_factor_model(rets(s, d), facs(s, d).select("ts", F.col("market").alias("btc"), F.col("smb").alias("eth"))))

CW = """wt AS (SELECT symbol, v/sum(v) OVER () AS w FROM (SELECT symbol, avg(volume) AS v FROM bars GROUP BY 1)),
 fu AS (SELECT a, b, cov FROM cv UNION ALL SELECT b, a, cov FROM cv WHERE a<>b),
 cw AS (SELECT a AS symbol, any_value(x.w) AS w, sum(cov*y.w) AS c, max(cov) FILTER (a=b) AS ii FROM fu JOIN wt x ON x.symbol=a
   JOIN wt y ON y.symbol=b GROUP BY 1),
 pv AS MATERIALIZED (SELECT *, sum(w*c) OVER () AS v FROM cw)"""
PV = ctes("rets", more=f"{CR}, {COV}, {CW}")


def weights(s, d):
    g = V.bars(s, d).groupBy("symbol").agg(F.avg("volume").alias("v"))
    from ..plans.rank import with_row
    return with_row(g, g.agg(F.sum("v").alias("t"))).select("symbol", (F.col("v") / F.col("t")).alias("weight"))


def cov(s, d):
    return A.covariance(rets(s, d))


query("component_var", "symbol weight:6 portfolio_var:6 component_var:6 share:6",
      "SELECT symbol, w AS weight, 1.645*sqrt(v) AS portfolio_var, 1.645*w*c/sqrt(v) AS component_var, w*c/v AS share FROM pv", PV)(
    lambda s, d: K.component_var(cov(s, d), weights(s, d)))
query("marginal_var", "symbol marginal_var:4 component_var:4 share:6",
      "SELECT symbol, c/v*1000 AS marginal_var, w*c/v*1000 AS component_var, w*c/v AS share FROM pv", PV)(
    lambda s, d: K.marginal_var(cov(s, d), weights(s, d), 1000.0))
query("incremental_var", "symbol incremental_var:6 diversification:6",
      """SELECT symbol, i AS incremental_var, 1.645*w*sqrt(ii)-i AS diversification FROM (SELECT *, 1.645*(sqrt(v)-sqrt(v-2*w*c+w*w*ii)) AS i
         FROM pv)""", PV)(lambda s, d: K.incremental_var(cov(s, d), weights(s, d)))
query("risk_decomposition", "total_risk:6 systematic_risk:6 idiosyncratic_risk:6 diversification_ratio:6",
      """SELECT sqrt(max(v)) AS total_risk, sqrt(greatest(max(v)-sum(w*w*ii),0)) AS systematic_risk, sqrt(sum(w*w*ii)) AS idiosyncratic_risk,
         sum(w*sqrt(ii))/sqrt(max(v)) AS diversification_ratio FROM pv""", PV)(lambda s, d: K.risk_decomposition(cov(s, d), weights(s, d)))
query("risk_contributions", "symbol risk:6 marginal_risk:6", "SELECT symbol, w*c/sqrt(v) AS risk, c/sqrt(v) AS marginal_risk FROM pv", PV)(
    lambda s, d: K.risk_contributions(cov(s, d), weights(s, d)))
query("risk_report", "symbol n_obs mean:6 annualized_vol:6 sharpe:6 component_var:6 share:6",
      """SELECT r.symbol, n_obs, mean, av AS annualized_vol, sh AS sharpe, 1.645*w*c/sqrt(v) AS component_var, w*c/v AS share FROM pv JOIN (
         SELECT symbol, count(*) AS n_obs, avg(ret) AS mean, stddev_samp(ret)*sqrt(365) AS av, (avg(ret)-.05/365)/stddev_samp(ret)*sqrt(365)
         AS sh FROM rets GROUP BY 1) r USING (symbol)""",
      ctes("rets", more=f"{CR}, {COV}, " + CW.replace("avg(volume)", "1.0")))(lambda s, d: K.risk_report(rets(s, d)))
query("portfolio_risk", "n_obs mean:6 annual_vol:6 max_drawdown:6 sharpe:6 var:2",
      """SELECT count(*) AS n_obs, avg(r) AS mean, stddev_samp(r)*sqrt(365) AS annual_vol, max(1-v/pk) AS max_drawdown,
         (avg(r)-.05/365)/stddev_samp(r)*sqrt(365) AS sharpe, stddev_samp(r)*100000*1.645 AS var FROM (SELECT *, greatest(1, max(v) OVER
         (ORDER BY ts)) AS pk FROM (SELECT ts, r, exp(sum(ln(1+r)) OVER (ORDER BY ts)) AS v FROM (SELECT ts, sum(w*ret) AS r FROM cr
         JOIN wt USING (symbol) GROUP BY 1)))""", PV)(lambda s, d: K.portfolio_risk(rets(s, d), weights(s, d), 100_000.0))
query("equal_weight", "symbol weight:6", "SELECT symbol, 1/count(*) OVER () AS weight FROM (SELECT DISTINCT symbol FROM bars)", BARS)(
    lambda s, d: K.equal_weight(V.bars(s, d)))
query("inverse_vol", "symbol weight:6",
      "SELECT symbol, i/sum(i) OVER () AS weight FROM (SELECT symbol, 1/stddev_samp(ret) AS i FROM rets GROUP BY 1)", RETS)(
    lambda s, d: K.inverse_vol(rets(s, d)))

query("sector_exposure", "sector weight:6 contribution:6 concentration:6 herfindahl:6",
      """SELECT *, max(abs(weight)) OVER () AS concentration, sum(weight*weight) OVER () AS herfindahl FROM (SELECT sector, sum(w) AS weight,
         sum(w)*any_value(tr) AS contribution FROM wt JOIN chars USING (symbol) JOIN (SELECT sector, sum(m) AS tr FROM (SELECT sector, ts,
         avg(ret) AS m FROM rets JOIN chars USING (symbol) GROUP BY 1,2) GROUP BY 1) USING (sector) GROUP BY 1)""",
      ctes("rets", "chars", more=f"{CR}, {COV}, {CW}"))(
    lambda s, d: K.sector_exposure(weights(s, d).join(chars(s, d).select("symbol", "sector"), "symbol"), rets(s, d).join(
        chars(s, d).select("symbol", "sector"), "symbol").groupBy("sector", "ts").agg(F.avg("ret").alias("m")).groupBy("sector").agg(
        F.sum("m").alias("total_return"))))

# accounts hold market segments as currencies; HOUSEHOLD plays the stable coin, MACHINERY has no ticker
STABLE = ("HOUSEHOLD",)
ACC = """bal AS MATERIALIZED (SELECT c_nationkey AS account, c_mktsegment AS currency, sum(c_acctbal) AS total, sum(abs(c_acctbal))*.5 AS free,
   sum(abs(c_acctbal))*.2 AS used, max(c_acctbal) AS hi FROM customer GROUP BY 1,2),
 tk AS (SELECT c_mktsegment AS currency, avg(c_acctbal)/1000 AS last FROM customer WHERE c_mktsegment<>'MACHINERY' GROUP BY 1),
 va AS MATERIALIZED (SELECT b.*, CASE WHEN b.currency='HOUSEHOLD' THEN 1.0 ELSE coalesce(last,0) END AS price,
   total*CASE WHEN b.currency='HOUSEHOLD' THEN 1.0 ELSE coalesce(last,0) END AS value FROM bal b LEFT JOIN tk USING (currency))"""
AC = "WITH " + ACC


def balances(s, d):
    b = F.col("c_acctbal")
    return V.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("account"), F.col("c_mktsegment").alias("currency")).agg(
        F.sum(b).alias("total"), (F.sum(F.abs(b)) * 0.5).alias("free"), (F.sum(F.abs(b)) * 0.2).alias("used"), F.max(b).alias("hi"))


def tickers(s, d):
    return V.table(s, d, "customer").filter("c_mktsegment <> 'MACHINERY'").groupBy(F.col("c_mktsegment").alias("currency")).agg(
        (F.avg("c_acctbal") / 1000).alias("last"))


query("portfolio_exposure", "account total_value:2 long_exposure:2 short_exposure:2 net_exposure:2 long_short_ratio:4 n_positions top_weight:6",
      """SELECT *, top/total_value*100 AS top_weight, l AS long_exposure, s AS short_exposure, l-s AS net_exposure, CASE WHEN s>0 THEN l/s END
         AS long_short_ratio FROM (SELECT account, sum(abs(value)) AS total_value, coalesce(sum(value) FILTER (value>0),0) AS l,
         coalesce(-sum(value) FILTER (value<=0),0) AS s, CAST(count(*) FILTER (abs(value)>1) AS BIGINT) AS n_positions,
         arg_max(value, abs(value)) AS top FROM va WHERE total<>0 GROUP BY 1)""", AC)(
    lambda s, d: K.portfolio_exposure(balances(s, d), tickers(s, d), STABLE))
query("pre_trade_check", "order_id account order_value:2 order_pct:4 decision failed",
      """SELECT order_id, account, v AS order_value, v/pv*100 AS order_pct, CASE WHEN len(f)=0 THEN 'GO' ELSE 'NO_GO' END AS decision,
         f AS failed FROM (SELECT *, list_filter([CASE WHEN v/pv*100>1 THEN 'position_size' END, CASE WHEN v<=0 THEN 'order_value' END,
         CASE WHEN pv<=0 THEN 'portfolio_exists' END, CASE WHEN side='buy' AND coalesce(free,0)<v THEN 'sufficient_balance' END],
         lambda x: x IS NOT NULL) AS f FROM (SELECT o_orderkey AS order_id, o_custkey%25 AS account, CASE WHEN o_custkey%2=0 THEN 'buy' ELSE
         'sell' END AS side, o_totalprice/100*.5 AS v FROM orders) JOIN (SELECT account, sum(abs(value)) AS pv FROM va GROUP BY 1)
         USING (account) LEFT JOIN (SELECT account, free FROM bal WHERE currency='HOUSEHOLD') USING (account))""", AC)(
    lambda s, d: K.pre_trade_check(balances(s, d), tickers(s, d), V.table(s, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 25).cast("int").alias("account"),
        F.when(F.col("o_custkey") % 2 == 0, "buy").otherwise("sell").alias("side"), (F.col("o_totalprice") / 100).alias("amount"),
        F.lit(0.5).alias("price"), F.lit("HOUSEHOLD").alias("quote")), 1.0, STABLE).withColumn("account", F.col("account").cast("long")))
SHOCKS = {"crash": {"AUTOMOBILE": -0.6, "BUILDING": -0.5, "default": -0.3}, "mild": {"FURNITURE": -0.1, "HOUSEHOLD": 0.0, "default": -0.2}}
query("stress_test", "account scenario current_value:2 stressed_value:2 loss:2 loss_pct:4 survivable",
      """SELECT *, loss_pct<35 AS survivable FROM (SELECT account, sc AS scenario, sum(value) AS current_value, sum(value*(1+x)) AS stressed_value,
         sum(value)-sum(value*(1+x)) AS loss, CASE WHEN sum(value)>0 THEN (sum(value)-sum(value*(1+x)))/sum(value)*100 ELSE 0 END AS loss_pct
         FROM (SELECT *, CASE sc WHEN 'crash' THEN CASE currency WHEN 'AUTOMOBILE' THEN -.6 WHEN 'BUILDING' THEN -.5 ELSE -.3 END
         ELSE CASE currency WHEN 'FURNITURE' THEN -.1 WHEN 'HOUSEHOLD' THEN 0 ELSE -.2 END END AS x FROM va, (SELECT unnest(['crash','mild']) AS sc)
         WHERE total<>0) GROUP BY 1,2)""", AC)(
    lambda s, d: K.stress_test(balances(s, d), tickers(s, d), K.scenario_table(s, SHOCKS), 35.0, STABLE))
query("rebalance_trades", "account symbol side amount:4 notional:2 turnover_pct:4",
      """SELECT account, currency AS symbol, CASE WHEN dl>0 THEN 'buy' ELSE 'sell' END AS side, abs(dl)/price AS amount, abs(dl) AS notional,
         abs(dl)/pv*100 AS turnover_pct FROM (SELECT *, sum(value) OVER (PARTITION BY account) AS pv, sum(value) OVER (PARTITION BY account)
         *CASE WHEN currency='BUILDING' THEN .4 WHEN currency='FURNITURE' THEN .6 ELSE 0 END-value AS dl FROM va) WHERE pv>0 AND abs(dl)>=1
         AND price>0""", AC)(
    lambda s, d: (lambda v: K.rebalance_trades(
        v.select("account", F.col("currency").alias("symbol"), F.col("total").alias("amount"), "price"),
        v.filter("currency IN ('BUILDING', 'FURNITURE')").select("account", F.col("currency").alias("symbol"), F.when(
            F.col("currency") == "BUILDING", 0.4).otherwise(0.6).alias("weight"), "price")))(
        K.valued(balances(s, d), tickers(s, d), STABLE)))
query("rebalance_costed", "account symbol trade:6 new_weight:6 skipped est_cost:8",
      """SELECT account, currency AS symbol, CASE WHEN sk THEN 0 ELSE tg-c END AS trade, CASE WHEN sk THEN c ELSE tg END AS new_weight, sk AS
         skipped, CASE WHEN sk THEN 0 ELSE abs(tg-c)*.001 END AS est_cost FROM (SELECT *, abs(tg-c)<.05 AS sk FROM (SELECT account, currency,
         value/sum(value) OVER (PARTITION BY account) AS c, .2 AS tg FROM va))""", AC)(
    lambda s, d: (lambda v: (lambda w: K.rebalance_costed(w, w.withColumn("weight", F.lit(0.2)), min_trade=0.05))(
        v.join(v.groupBy("account").agg(F.sum("value").alias("t")), "account").select(
            "account", F.col("currency").alias("symbol"), (F.col("value") / F.col("t")).alias("weight"))))(
        K.valued(balances(s, d), tickers(s, d), STABLE)))
query("drawdown_monitor", "account drawdown_pct:4 recovery_pct:4 status",
      """SELECT account, (p-c)/p*100 AS drawdown_pct, (p/c-1)*100 AS recovery_pct, CASE WHEN (p-c)/p*100>60 THEN 'CRITICAL' WHEN (p-c)/p*100>42
         THEN 'WARNING' ELSE 'OK' END AS status FROM (SELECT c_nationkey AS account, avg(c_acctbal) AS c, CASE WHEN count(*)>60 THEN
         max(c_acctbal) ELSE avg(c_acctbal)*1.05 END AS p FROM customer GROUP BY 1)""")(
    lambda s, d: K.drawdown_monitor(V.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("account")).agg(
        F.avg("c_acctbal").alias("current"), F.when(F.count(F.lit(1)) > 60, F.max("c_acctbal")).alias("peak")), 60.0))
query("margin_health", "account equity:2 used:2 margin_ratio:4 health:4 status",
      """SELECT *, CASE WHEN health>70 THEN 'HEALTHY' WHEN health>40 THEN 'CAUTION' ELSE 'DANGER' END AS status FROM (SELECT *, greatest(0,
         100-margin_ratio) AS health FROM (SELECT account, coalesce(sum(total) FILTER (st),0) AS equity, coalesce(sum(used) FILTER (st),0) AS used,
         CASE WHEN sum(total) FILTER (st)>0 THEN sum(used) FILTER (st)/sum(total) FILTER (st)*100 ELSE 0 END AS margin_ratio FROM (SELECT *,
         currency IN ('HOUSEHOLD') AS st FROM bal) GROUP BY 1))""", AC)(lambda s, d: K.margin_health(balances(s, d), STABLE))
query("risk_dashboard", "account currency rank pct:6 n_positions top_pct:6 concentration diversification",
      """SELECT *, CASE WHEN top_pct>40 THEN 'red' WHEN top_pct>28 THEN 'yellow' ELSE 'green' END AS concentration, CASE WHEN n_positions>=5 THEN
         'green' WHEN n_positions>=3 THEN 'yellow' ELSE 'red' END AS diversification FROM (SELECT account, currency, pct, row_number() OVER
         (PARTITION BY account ORDER BY pct DESC, currency) AS rank, count(*) OVER (PARTITION BY account) AS n_positions, max(pct) OVER
         (PARTITION BY account) AS top_pct FROM (SELECT *, abs(value)/sum(abs(value)) OVER (PARTITION BY account)*100 AS pct FROM va WHERE
         total<>0) WHERE abs(value)>1) WHERE rank<=10""", AC)(lambda s, d: K.risk_dashboard(balances(s, d), tickers(s, d), 40.0, STABLE))

"""Backtest queries; the expected values walk every run bar by bar in a recursive CTE."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as B
from ..sources import views as V
from .base import query
from .indicators import ADX, BB, MACD, RSI, STO
from .sql import ctes

IND = f"{BB}, {STO}, {MACD}, {RSI}, {ADX}"


def _cross(a: str, b: str) -> str:
    return f"CASE WHEN lag({a}) OVER w<=lag({b}) OVER w AND {a}>{b} THEN 1 WHEN lag({a}) OVER w>=lag({b}) OVER w AND {a}<{b} THEN -1 ELSE 0 END"


SIG = {
    "sma_crossover": _cross("f", "s"),
    "rsi_mean_reversion": "CASE WHEN rsi<30 THEN 1 WHEN rsi>70 THEN -1 ELSE 0 END",
    "macd_momentum": _cross("macd", "macd_signal"),
    "bollinger_breakout": "CASE WHEN lag(close) OVER w<=lag(bu) OVER w AND close>bu THEN 1 WHEN lag(close) OVER w>=lag(bl) OVER w AND close<bl THEN -1 ELSE 0 END",
    "bollinger_mean_reversion": "CASE WHEN close<=bl THEN 1 WHEN close>=bu THEN -1 ELSE 0 END",
    "ema_trend_following": "CASE WHEN close>e20 AND e20>lag(e20) OVER w THEN 1 WHEN close<e20 AND e20<lag(e20) OVER w THEN -1 ELSE 0 END",
    "stochastic_oscillator": "CASE WHEN lag(k) OVER w<=lag(d) OVER w AND k>d AND k<20 THEN 1 WHEN lag(k) OVER w>=lag(d) OVER w AND k<d AND k>80 THEN -1 ELSE 0 END",
    "adx_trend_strength": "CASE WHEN rn>28 AND adx>=25 THEN CASE WHEN lag(pd) OVER w<=lag(md) OVER w AND pd>md THEN 1 WHEN lag(pd) OVER w>=lag(md) OVER w AND pd<md THEN -1 ELSE 0 END ELSE 0 END",
    "multi_indicator_confluence": "CASE WHEN rn<=34 THEN 0 WHEN (rsi<40)::INT+(close>s20)::INT+(macd_hist>0)::INT>=2 THEN 1 WHEN (rsi>60)::INT+(close<s20)::INT+(macd_hist<0)::INT>=2 THEN -1 ELSE 0 END",
}
WIDE = """wide AS MATERIALIZED (SELECT b.symbol, b.ts, b.rn, b.n, b.close, CASE WHEN b.rn>=10 THEN avg(b.close) OVER (PARTITION BY b.symbol ORDER BY
   b.ts ROWS 9 PRECEDING) END AS f, CASE WHEN b.rn>=30 THEN avg(b.close) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS 29 PRECEDING) END AS s,
   rsi, macd, macd_signal, macd_hist, bb_mid AS s20, bb_mid+2*bb_sd AS bu, bb_mid-2*bb_sd AS bl, e20, stoch_k AS k, stoch_d AS d, adx,
   plus_di AS pd, minus_di AS md FROM b0 b JOIN bb x USING (symbol, ts) JOIN sto USING (symbol, ts) JOIN mac USING (symbol, ts) JOIN rsi USING
   (symbol, ts) LEFT JOIN adx USING (symbol, ts))"""


def sig_cte(names) -> str:
    return "sg AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT symbol, ts, rn, n, close, '{s}' AS strategy, {SIG[s]} AS sig FROM wide WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
        for s in names) + ")"


def sim_cte(key: str = "symbol, strategy") -> str:
    on = " AND ".join(f"g.{k.strip()}=r.{k.strip()}" for k in key.split(","))
    cols = lambda a: ", ".join(f"{a}.{k.strip()}" for k in key.split(","))
    buy, sell = "g.sig=1 AND r.qty=0", "((g.sig=-1 AND r.qty>0) OR (g.rn=g.n AND r.qty>0))"
    both = "g.rn=g.n AND g.sig=1 AND r.qty=0"
    c, s = ".001", ".0005"
    out = f"(1-{s})*(1-{c})"
    amt = f"r.cash*(1-{c})/(g.close*(1+{s}))"
    return f"""sm AS (SELECT {cols('g')}, 0::BIGINT AS rn, g.n, min(g.ts)-INTERVAL 1 MILLISECOND AS ts, 10000::DOUBLE AS cash, 0::DOUBLE AS qty,
  CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS TIMESTAMP) AS ets, 10000::DOUBLE AS eq, CAST(NULL AS DOUBLE) AS pnl, CAST(NULL AS DOUBLE) AS hold,
  10000::DOUBLE AS pk, min(g.ts)-INTERVAL 1 MILLISECOND AS pt, 0::DOUBLE AS ret, 0::DOUBLE AS dd, 0::DOUBLE AS du FROM sg g GROUP BY {cols('g')}, g.n
 UNION ALL SELECT {key}, rn, n, ts, cash, qty, cost, ets, eq, pnl, hold, CASE WHEN eq>=pk THEN eq ELSE pk END, CASE WHEN eq>=pk THEN ts ELSE pt END,
  eq/pe-1, (greatest(pk,eq)-eq)/greatest(pk,eq), CASE WHEN eq<pk THEN epoch_ms(ts)-epoch_ms(pt) ELSE 0 END FROM (SELECT {cols('g')}, g.rn, g.n, g.ts,
  r.eq AS pe, r.pk, r.pt,
  CASE WHEN {both} THEN {amt}*g.close*{out} WHEN {buy} THEN 0 WHEN {sell} THEN r.qty*g.close*{out} ELSE r.cash END AS cash,
  CASE WHEN {both} THEN 0 WHEN {buy} THEN {amt} WHEN {sell} THEN 0 ELSE r.qty END AS qty,
  CASE WHEN {buy} THEN r.cash ELSE r.cost END AS cost, CASE WHEN {buy} THEN g.ts ELSE r.ets END AS ets,
  CASE WHEN {both} THEN {amt}*g.close*{out} WHEN {buy} THEN {amt}*g.close WHEN {sell} THEN r.qty*g.close*{out} WHEN r.qty>0 THEN r.qty*g.close
   ELSE r.cash END AS eq,
  CASE WHEN {both} THEN {amt}*g.close*{out}-r.cash WHEN {buy} THEN NULL WHEN {sell} THEN r.qty*g.close*{out}-r.cost END AS pnl,
  CASE WHEN {both} THEN 0 WHEN {buy} THEN NULL WHEN {sell} THEN epoch_ms(g.ts)-epoch_ms(r.ets) END AS hold
  FROM sm r JOIN sg g ON {on} AND g.rn=r.rn+1)),
 mt AS MATERIALIZED (SELECT *, arg_eq/10000-1 AS tr, round(31557600000/((t1-t0)/n_bars)) AS per FROM (SELECT {key}, CAST(max(rn) AS BIGINT) AS n_bars,
  arg_max(eq, rn) AS arg_eq, min(epoch_ms(ts)) AS t0, max(epoch_ms(ts)) AS t1, avg(ret) FILTER (rn>0) AS m, stddev_samp(ret) FILTER (rn>0) AS sd,
  list(ret) FILTER (rn>0) AS rl, max(dd) AS dd, max(du) AS du, count(pnl) AS total_trades, avg(pnl) FILTER (pnl>0) AS aw, avg(pnl) FILTER (pnl<=0) AS al,
  max(pnl) FILTER (pnl>0) AS lw, min(pnl) FILTER (pnl<=0) AS ll, count(*) FILTER (pnl>0) AS nw, sum(pnl) FILTER (pnl>0) AS gp,
  -sum(pnl) FILTER (pnl<0) AS gl, avg(hold) AS h, avg(pnl) AS x FROM sm GROUP BY {key})),
 fig AS MATERIALIZED (SELECT {key}, n_bars, total_trades, tr AS total_return, power(arg_eq/10000, 31557600000/(t1-t0))-1 AS annualized_return,
  CASE WHEN sd>0 THEN (m-.05/per)/sd*sqrt(per) ELSE 0 END AS sharpe, CASE WHEN coalesce(dn,0)=0 THEN NULL ELSE (m-.05/per)/dn*sqrt(per) END AS sortino,
  dd AS max_drawdown, du AS max_drawdown_ms, CASE WHEN total_trades>0 THEN nw/total_trades ELSE 0 END AS win_rate,
  CASE WHEN total_trades=0 THEN 0 WHEN coalesce(gl,0)=0 THEN NULL ELSE coalesce(gp,0)/gl END AS profit_factor, coalesce(aw,0) AS avg_win,
  coalesce(al,0) AS avg_loss, coalesce(lw,0) AS largest_win, coalesce(ll,0) AS largest_loss, coalesce(h,0) AS avg_holding_ms,
  CASE WHEN dd>0 THEN (power(arg_eq/10000, per/n_bars)-1)/dd ELSE 0 END AS calmar, coalesce(x,0) AS expectancy, arg_eq AS final_equity
  FROM (SELECT *, list_stddev_samp(list_filter(rl, lambda v: v<.05/per)) AS dn FROM mt))"""


MET = ("n_bars total_trades total_return:4 annualized_return:4 sharpe:2 sortino:2 max_drawdown:4 max_drawdown_ms:0 win_rate:4 profit_factor:2 "
       "avg_win:2 avg_loss:2 largest_win:2 largest_loss:2 avg_holding_ms:0 calmar:2 expectancy:2 final_equity:2")
ALL = ctes("rets", more=f"{IND}, {WIDE}, {sig_cte(SIG)}, {sim_cte()}", recursive=True)
query("backtest", "symbol strategy " + MET, "SELECT * FROM fig", ALL)(
    lambda s, d: B.backtest(V.bars(s, d), [(x, {}) for x in B.DEFAULTS]))
query("compare_strategies", "symbol strategy sharpe:2 rank",
      """SELECT symbol, strategy, sharpe, row_number() OVER (PARTITION BY symbol ORDER BY floor(sharpe*100+.5)/100 DESC, strategy) AS rank
         FROM fig""", ALL)(lambda s, d: B.compare_strategies(V.bars(s, d)))
ALIAS = {"sma_cross": "sma_crossover", "rsi_reversion": "rsi_mean_reversion", "macd_strategy": "macd_momentum",
         "boll_breakout": "bollinger_breakout", "boll_reversion": "bollinger_mean_reversion", "ema_trend": "ema_trend_following",
         "stoch_strategy": "stochastic_oscillator", "adx_strategy": "adx_trend_strength", "multi_confluence": "multi_indicator_confluence"}
for _q, _s in ALIAS.items():
    query(_q, "symbol ts signal", "SELECT symbol, ts, CAST(sig AS INTEGER) AS signal FROM sg",
          ctes("rets", more=f"{IND}, {WIDE}, {sig_cte([_s])}", recursive=True))(
        lambda s, d, x=_s: B.signal_table(V.bars(s, d), [(x, {})]))
query("backtest_metrics", "symbol strategy total_trades win_rate:4 profit_factor:2 expectancy:2 max_drawdown_ms:0",
      "SELECT * FROM fig", ctes("rets", more=f"{IND}, {WIDE}, {sig_cte(['sma_crossover', 'rsi_mean_reversion'])}, {sim_cte()}", recursive=True))(
    lambda s, d: B.metrics(B.simulate(B.signal_table(V.bars(s, d), [("sma_crossover", {}), ("rsi_mean_reversion", {})]))))

FAST, SLOW = (5, 8, 12), (20, 30, 50)
GRIDS = "ma AS MATERIALIZED (SELECT symbol, ts, rn, n, close, " + ", ".join(
    f"CASE WHEN rn>={p} THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS {p - 1} PRECEDING) END AS a{p}" for p in FAST + SLOW) + \
    " FROM b0), sg AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT symbol, ts, rn, n, close, '{f}-{w}' AS strategy, {_cross(f'a{f}', f'a{w}')} AS sig FROM ma WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    for f in FAST for w in SLOW) + ")"
PICK = lambda: F.concat_ws("-", F.get_json_object("params", "$.fast").cast("double").cast("int"), F.get_json_object("params", "$.slow").cast("double").cast("int"))
query("optimize", "symbol best sharpe:2 total_trades",
      """SELECT symbol, arg_min(strategy, ROW(-floor(sharpe*100+.5)/100, pr)) AS best, max(floor(sharpe*100+.5)/100) AS sharpe,
         arg_min(total_trades, ROW(-floor(sharpe*100+.5)/100, pr)) AS total_trades FROM (SELECT *, '{"fast":'||split_part(strategy,'-',1)||
         '.0,"slow":'||split_part(strategy,'-',2)||'.0}' AS pr FROM fig) GROUP BY 1""",
      ctes("rets", more=f"{GRIDS}, {sim_cte()}", recursive=True))(
    lambda s, d: B.optimize(V.bars(s, d), B.grid("sma_crossover", fast=list(FAST), slow=list(SLOW))).withColumn("best", PICK()))

SPLIT = """b1 AS (SELECT symbol, ts, close, CASE WHEN rn<=floor(n*CAST(.7 AS DOUBLE)+.5) THEN 'in_sample' ELSE 'out_of_sample' END AS segment FROM b0),
 b2 AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol, segment) AS n FROM b1 WINDOW w AS (PARTITION BY symbol, segment
   ORDER BY ts)),
 b3 AS (SELECT *, CASE WHEN rn>=10 THEN avg(close) OVER (PARTITION BY symbol, segment ORDER BY ts ROWS 9 PRECEDING) END AS f, CASE WHEN rn>=30 THEN
   avg(close) OVER (PARTITION BY symbol, segment ORDER BY ts ROWS 29 PRECEDING) END AS s FROM b2),
 sg AS MATERIALIZED (SELECT symbol, segment, ts, rn, n, close, """ + _cross("f", "s") + """ AS sig FROM b3 WINDOW w AS (PARTITION BY symbol, segment
   ORDER BY ts))"""
query("walk_forward_split", "symbol segment " + MET, "SELECT * FROM fig",
      ctes("rets", more=f"{SPLIT}, {sim_cte('symbol, segment')}", recursive=True))(
    lambda s, d: B.walk_forward_split(V.bars(s, d), [("sma_crossover", {})], 0.7))

WFR = "b1 AS (SELECT symbol, ts, close, k, CASE WHEN rn-k*40<=120 THEN 'train' ELSE 'test' END AS part FROM b0, range(0, 20) t(k) WHERE rn>k*40 AND " \
      "rn<=k*40+160 AND k*40+160<=n), b2 AS (SELECT *, row_number() OVER (PARTITION BY symbol, k, part ORDER BY ts) AS rn, count(*) OVER (PARTITION BY " \
      "symbol, k, part) AS n FROM b1), ma AS MATERIALIZED (SELECT *, " + ", ".join(
          f"CASE WHEN rn>={p} THEN avg(close) OVER (PARTITION BY symbol, k, part ORDER BY ts ROWS {p - 1} PRECEDING) END AS a{p}"
          for p in (4, 8, 16, 24)) + " FROM b2), sg AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT symbol, k, part, ts, rn, n, close, '{f}-{w}' AS strategy, {_cross(f'a{f}', f'a{w}')} AS sig FROM ma WINDOW w AS (PARTITION BY symbol, k, "
    f"part ORDER BY ts)" for f in (4, 8) for w in (16, 24)) + ")"
WFS = """wt AS (SELECT symbol, k, arg_min(strategy, ROW(-floor(sharpe*100+.5)/100, pr)) AS strategy, max(floor(sharpe*100+.5)/100) AS is_sharpe,
   arg_min(total_trades, ROW(-floor(sharpe*100+.5)/100, pr)) AS is_trades FROM (SELECT *, '{"fast":'||split_part(strategy,'-',1)||'.0,"slow":'||
   split_part(strategy,'-',2)||'.0}' AS pr FROM fig WHERE part='train' AND total_trades>0) GROUP BY 1,2),
 wf AS MATERIALIZED (SELECT t.*, floor(sharpe*100+.5)/100 AS oos_sharpe, floor(total_return*10000+.5)/10000 AS oos_return, total_trades AS oos_trades
   FROM wt t JOIN fig f ON f.symbol=t.symbol AND f.k=t.k AND f.strategy=t.strategy AND f.part='test')"""
WFP = ctes("rets", more=f"{WFR}, {sim_cte('symbol, k, part, strategy')}, {WFS}", recursive=True)
RUNS = B.grid("sma_crossover", fast=[4, 8], slow=[16, 24])
query("walk_forward_rolling", "symbol k best is_sharpe:2 is_trades oos_sharpe:2 oos_return:4 oos_trades",
      "SELECT *, strategy AS best FROM wf", WFP)(
    lambda s, d: B.walk_forward_rolling(V.bars(s, d), RUNS, 120, 40).withColumn("best", PICK()))
query("walk_forward_summary", "symbol n_windows avg_is:4 avg_oos:4 compounded_return:4",
      """SELECT symbol, count(*) AS n_windows, avg(is_sharpe) AS avg_is, avg(oos_sharpe) AS avg_oos, product(1+oos_return)-1 AS compounded_return
         FROM wf GROUP BY 1""", WFP)(
    lambda s, d: B.walk_forward_summary(B.walk_forward_rolling(V.bars(s, d), RUNS, 120, 40)))
query("sma_backtest_v1", "symbol n_trades win_rate:4 total_return:4",
      """SELECT symbol, count(*) AS n_trades, avg(CASE WHEN pnl>0 THEN 1.0 ELSE 0 END) AS win_rate, product(1+.5*pnl/base)-1 AS total_return FROM (
         SELECT *, eq-pnl AS base FROM sm WHERE pnl IS NOT NULL) GROUP BY 1""",
      ctes("rets", more=f"{IND}, {WIDE}, {sig_cte(['sma_crossover'])}, " + sim_cte().replace(".0005", "0.0").replace(".001", "0.0"),
           recursive=True))(lambda s, d: B.sma_backtest_v1(V.bars(s, d), 10, 30, fraction=0.5))

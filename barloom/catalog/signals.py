"""Signal and regime queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regime as R
from ..operators import signals as S
from ..plans.rank import with_row
from ..sources import views as V
from .base import query
from .indicators import ADX, ATR, BB, MACD, NUL, RSI, STO, TWO, ema_step, means, recursion, two_frames
from .sql import ctes

RIB = (8, 13, 21, 34, 55)
RIBBON = f"""rp AS MATERIALIZED (SELECT *, {means(**{f"q{p}": ("close", p) for p in RIB})} FROM b0),
 {recursion("rp", ", ".join(f"{NUL} AS q{p}" for p in RIB), ", ".join(ema_step(p, name=f"q{p}") for p in RIB), "rib")}"""
INPUT = f"""{BB}, {ATR}, {STO}, {MACD}, {RSI}, {ADX}, {RIBBON},
 ix AS MATERIALIZED (SELECT b.*, bb_mid, bb_mid+2*bb_sd AS bu, bb_mid-2*bb_sd AS bl, 4*bb_sd/bb_mid AS bw, atr, stoch_k AS k, stoch_d AS d,
   macd AS mc, macd_signal AS ms, macd_hist AS mh, rsi, coalesce(adx, NULL) AS adx, e20, q8, q13, q21, q34, q55,
   CASE WHEN b.rn>=50 THEN avg(b.close) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS 49 PRECEDING) END AS s50,
   CASE WHEN b.rn>=200 THEN avg(b.close) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS 199 PRECEDING) END AS s200,
   CASE WHEN b.rn>=20 THEN avg(b.close) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS 19 PRECEDING) END AS s20
  FROM b0 b JOIN bb USING (symbol, ts) JOIN atr USING (symbol, ts) JOIN sto USING (symbol, ts) JOIN mac USING (symbol, ts)
  JOIN rsi USING (symbol, ts) LEFT JOIN adx USING (symbol, ts) JOIN rib USING (symbol, ts)),
 lr AS (SELECT *, {", ".join(f"lag({c}) OVER w AS {c}_1" for c in ("s50", "s200", "mc", "ms", "bw", "k", "d", "adx", "open", "close"))},
   lag(close,2) OVER w AS close_2, lag(open,2) OVER w AS open_2, lag(close,4) OVER w AS close_4, lag(close,5) OVER w AS close_5,
   max(close) OVER r10 AS ph, max(close) OVER r20 AS pho, min(close) OVER r10 AS pl, min(close) OVER r20 AS plo,
   max(rsi) OVER r10 AS rh, max(rsi) OVER r20 AS rho, min(rsi) OVER r10 AS rl, min(rsi) OVER r20 AS rlo,
   avg(bw) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) AS wn, avg(bw) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN
   20 PRECEDING AND 5 PRECEDING) AS wo, avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS v20,
   max(high) OVER bd AS hb, min(low) OVER bd AS lb FROM ix WINDOW w AS (PARTITION BY symbol ORDER BY ts),
   r10 AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), r20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING),
   bd AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND 2 PRECEDING)),
 la AS MATERIALIZED (SELECT *, atr AS a, abs(close-open) AS body, high-low AS rg, high-greatest(open,close) AS us, least(open,close)-low AS ls
   FROM lr WHERE rn=n AND n>=55)"""


def rule(name: str, side: str, strength: str, conf: float, cond: str, t: str = "NULL", s: str = "NULL") -> str:
    side = f"'{side}'" if side in ("buy", "sell") else side
    strength = f"'{strength}'" if strength in ("strong", "moderate", "weak") else strength
    return (f"SELECT symbol, '{name}' AS name, {side} AS type, {strength} AS strength, {conf} AS confidence, "
            f"CAST({t} AS DOUBLE) AS target, CAST({s} AS DOUBLE) AS stop FROM la WHERE {cond}")


def twin(names, strength, conf, up, dn, t, s) -> list[str]:
    return [rule(names[0], "buy", strength, conf, up, f"close+{t}*a", f"close-{s}*a"),
            rule(names[1], "sell", strength, conf, dn, f"close-{t}*a", f"close+{s}*a")]


X = lambda x, y: (f"{x}_1<={y}_1 AND {x}>{y}", f"{x}_1>={y}_1 AND {x}<{y}")
GOLD, DIV = X("s50", "s200"), ("pl<plo AND rl>rlo", "ph>pho AND rh<rho")
MZ, MX, KX = ("mc_1<=0 AND mc>0", "mc_1>=0 AND mc<0"), X("mc", "ms"), X("k", "d")
CW = lambda up, t: f"CASE WHEN {up} THEN close+{t}*a ELSE close-{t}*a END"
CL = lambda up, t: f"CASE WHEN {up} THEN close-{t}*a ELSE close+{t}*a END"
SD = lambda up: f"CASE WHEN {up} THEN 'buy' ELSE 'sell' END"
BULL, BEAR = "q8>q13 AND q13>q21 AND q21>q34 AND q34>q55", "q8<q13 AND q13<q21 AND q21<q34 AND q34<q55"
POW = "CASE WHEN (greatest(q8,q13,q21,q34,q55)-least(q8,q13,q21,q34,q55))/close > .03 THEN 'strong' ELSE 'moderate' END"
RULES: dict[str, list[str]] = {
    "golden_death_cross": twin(("Golden Cross (SMA50 x SMA200)", "Death Cross (SMA50 x SMA200)"), "strong", .85, *GOLD, 3, 1.5),
    "rsi_divergence": twin(("Bullish RSI Divergence", "Bearish RSI Divergence"), "moderate", .7, *DIV, 2, 1),
    "macd_zero_cross": twin(("MACD Zero Cross (bullish)", "MACD Zero Cross (bearish)"), "moderate", .65, *MZ, 2, 1),
    "macd_signal_cross": twin(("MACD Signal Cross (bullish)", "MACD Signal Cross (bearish)"), "moderate", .6, *MX, 2, 1),
    "bollinger_bounce": [rule("Bollinger Band Bounce (lower)", "buy", "moderate", .6, "close<=bl", "bb_mid", "close-a"),
                         rule("Bollinger Band Bounce (upper)", "sell", "moderate", .6, "close>=bu", "bb_mid", "close+a")],
    "squeeze_release": [rule("Bollinger Squeeze Release", SD("close>bb_mid"), "strong", .75, "wn<.6*wo AND bw>1.2*bw_1",
                             CW("close>bb_mid", 3), CL("close>bb_mid", 1.5))],
    "volume_breakout": [rule("Volume Breakout", SD("close>close_1"), "moderate", .65, "volume>2*v20 AND v20>0", CW("close>close_1", 2),
                             CL("close>close_1", 1))],
    "sr_break": [rule("Resistance Break", "buy", "strong", .75, "close>hb", "close+3*a", "hb-.5*a"),
                 rule("Support Break", "sell", "strong", .75, "close<lb", "close-3*a", "lb+.5*a")],
    "ema_ribbon": [rule("EMA Ribbon (bullish aligned)", "buy", POW, .7, BULL, "close+2*a", "q55-.5*a"),
                   rule("EMA Ribbon (bearish aligned)", "sell", POW, .7, BEAR, "close-2*a", "q55+.5*a")],
    "stochastic_cross": twin(("Stochastic Oversold Crossover", "Stochastic Overbought Crossover"), "moderate", .65, f"k<20 AND {KX[0]}",
                             f"k>80 AND {KX[1]}", 2, 1),
    "adx_trend_start": [rule("ADX Trend Start", SD("close>close_4"), "moderate", .6, "adx_1<=25 AND adx>25", CW("close>close_4", 2.5),
                             CL("close>close_4", 1.5))],
    "three_soldiers_crows": [rule("Three White Soldiers", "buy", "moderate", .65, "close>open AND close_1>open_1 AND close_2>open_2 AND "
                                  "close_1>close_2 AND close>close_1"),
                             rule("Three Black Crows", "sell", "moderate", .65, "close<open AND close_1<open_1 AND close_2<open_2 AND "
                                  "close_1<close_2 AND close<close_1")],
    "engulfing": [rule("Bullish Engulfing", "buy", "moderate", .7, "close_1<open_1 AND close>open AND open<=close_1 AND close>=open_1 AND "
                       "body>abs(close_1-open_1)"),
                  rule("Bearish Engulfing", "sell", "moderate", .7, "close_1>open_1 AND close<open AND open>=close_1 AND close<=open_1 AND "
                       "body>abs(close_1-open_1)")],
    "doji_star": [rule("Doji Star (bearish)", "sell", "weak", .5, "rg>0 AND body/rg<.1 AND close_1>close_4"),
                  rule("Doji Star (bullish)", "buy", "weak", .5, "rg>0 AND body/rg<.1 AND close_1<close_4")],
    "hammer_star": [rule("Hammer", "buy", "moderate", .6, "body>0 AND close_1<close_5 AND ls>2*body AND us<.5*body"),
                    rule("Shooting Star", "sell", "moderate", .6, "body>0 AND close_1>close_5 AND us>2*body AND ls<.5*body")],
}
PV = """w30 AS (SELECT symbol, rn, n, high, low, close, lag(high) OVER w AS h1, lag(high,2) OVER w AS h2, lead(high) OVER w AS h3,
   lead(high,2) OVER w AS h4, lag(low) OVER w AS l1, lag(low,2) OVER w AS l2, lead(low) OVER w AS l3, lead(low,2) OVER w AS l4 FROM b0
   WHERE rn>n-30 WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
 pk AS (SELECT symbol, rn, high AS v, 1 AS top FROM w30 WHERE high>greatest(h1,h2,h3,h4) AND h2 IS NOT NULL AND h4 IS NOT NULL
   UNION ALL SELECT symbol, rn, low, 0 FROM w30 WHERE low<least(l1,l2,l3,l4) AND l2 IS NOT NULL AND l4 IS NOT NULL),
 dbl AS (SELECT x.symbol, x.rn, x.top, any_value(x.v) AS v1, arg_min(y.v, y.rn) AS v2 FROM pk x JOIN pk y ON x.symbol=y.symbol AND x.top=y.top
   AND y.rn-x.rn>=5 AND abs(x.v-y.v)/x.v<.015 JOIN la l ON l.symbol=x.symbol AND CASE WHEN x.top=1 THEN l.close<y.v ELSE l.close>y.v END
   GROUP BY 1,2,3)"""
RULES["double_top_bottom"] = ["""SELECT d.symbol, CASE WHEN top=1 THEN 'Double Top' ELSE 'Double Bottom' END AS name, CASE WHEN top=1 THEN
   'sell' ELSE 'buy' END AS type, 'strong' AS strength, .7 AS confidence, CASE WHEN top=1 THEN close-3*a ELSE close+3*a END AS target,
   CASE WHEN top=1 THEN greatest(v1,v2)+.5*a ELSE least(v1,v2)-.5*a END AS stop FROM dbl d JOIN la l ON l.symbol=d.symbol"""]
NAMES = {
    "golden_death_cross": "Cross (SMA50", "rsi_divergence": "Divergence", "macd_zero_cross": "MACD Zero", "macd_signal_cross": "MACD Signal",
    "bollinger_bounce": "Bounce", "squeeze_release": "Squeeze", "volume_breakout": "Volume", "sr_break": " Break$", "ema_ribbon": "Ribbon",
    "stochastic_cross": "Stochastic", "adx_trend_start": "ADX", "three_soldiers_crows": "Three", "engulfing": "Engulfing",
    "doji_star": "Doji", "hammer_star": "Hammer|Shooting", "double_top_bottom": "Double"}
CANDLES = ("three_soldiers_crows", "engulfing", "doji_star", "hammer_star")
PRE = ctes("rets", more=f"{INPUT}, {PV}", recursive=True)
COLS = "symbol name type strength confidence:2 target:2 stop:2"
ALL = "\nUNION ALL ".join(r for rs in RULES.values() for r in rs)

query("generate_signals", COLS, ALL, PRE)(lambda s, d: S.generate_signals(V.bars(s, d)))
query("candle_patterns", COLS, "\nUNION ALL ".join(r for c in CANDLES for r in RULES[c]), PRE)(lambda s, d: S.candle_patterns(V.bars(s, d)))
CUTS, CUT_DAYS = 12, 49


def as_of(s, d):
    """Every series as it stood at the end and at eleven earlier dates, as series of their own: rules then fire both ways."""
    b = V.bars(s, d)
    b = with_row(b, b.agg(F.max("ts").alias("_end"))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))))
    return b.filter(F.expr(f"ts <= _end - make_dt_interval({CUT_DAYS} * _k)")).withColumn("symbol", F.concat_ws("|", "symbol", "_k")).drop("_end", "_k")


AS_OF = ctes("bars") + f""",
 b00 AS (SELECT symbol||'|'||k AS symbol, bars.* EXCLUDE (symbol) FROM bars, range(0, {CUTS}) t(k)
  WHERE ts <= (SELECT max(ts) FROM bars) - to_days(CAST({CUT_DAYS}*k AS INTEGER))),
 b0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
  count(*) OVER (PARTITION BY symbol) AS n FROM b00), {INPUT}, {PV}"""
AS_OF = AS_OF.replace("WITH ", "WITH RECURSIVE ", 1)
for _name, _rules in RULES.items():
    query(_name, COLS, "\nUNION ALL ".join(_rules), AS_OF)(
        lambda s, d, p=NAMES[_name]: S.generate_signals(as_of(s, d)).filter(F.col("name").rlike(p.replace("(", "\\("))))
query("scan_divergences", COLS, "\nUNION ALL ".join(RULES["rsi_divergence"]), AS_OF)(lambda s, d: S.divergences(S.generate_signals(as_of(s, d))))

SCORE = f"""sig AS (SELECT *, CASE strength WHEN 'strong' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END*confidence AS w FROM ({ALL})),
 sc AS (SELECT symbol, count(*) AS n_signals, floor(sum(CASE WHEN type='buy' THEN w ELSE -w END)/sum(w)*100+.5) AS score,
   arg_min(name, ROW(-round(w,9), name)) AS top_signal FROM sig GROUP BY 1)"""
PRES = ctes("rets", more=f"{INPUT}, {PV}, {SCORE}", recursive=True)
BIAS = "CASE WHEN score>15 THEN 'bullish' WHEN score<-15 THEN 'bearish' ELSE 'neutral' END"
query("score_signals", "symbol n_signals score:0 top_signal bias", f"SELECT *, {BIAS} AS bias FROM sc", PRES)(
    lambda s, d: S.score_signals(S.generate_signals(V.bars(s, d))))
query("scan_market", "symbol score:0 bias rank",
      f"SELECT symbol, score, {BIAS} AS bias, row_number() OVER (ORDER BY abs(score) DESC, symbol) AS rank FROM sc WHERE abs(score)>=20",
      PRES)(lambda s, d: S.scan_market(S.generate_signals(V.bars(s, d)), 20))

SR = """w2 AS (SELECT symbol, rn, n, high, low, close, lag(high) OVER w AS h1, lag(high,2) OVER w AS h2, lead(high) OVER w AS h3,
   lead(high,2) OVER w AS h4, lag(low) OVER w AS l1, lag(low,2) OVER w AS l2, lead(low) OVER w AS l3, lead(low,2) OVER w AS l4 FROM b0
   WHERE rn>n-200 WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
 px AS (SELECT symbol, arg_max(close, rn) AS price FROM w2 GROUP BY 1),
 pl2 AS (SELECT symbol, 'r' AS t, list_sort(list(high)) AS l FROM w2 JOIN px USING (symbol) WHERE high>greatest(h1,h2,h3,h4) AND h2 IS NOT NULL
   AND h4 IS NOT NULL AND high>price GROUP BY 1 UNION ALL SELECT symbol, 's', list_sort(list(low)) FROM w2 JOIN px USING (symbol) WHERE
   low<least(l1,l2,l3,l4) AND l2 IS NOT NULL AND l4 IS NOT NULL AND low<price GROUP BY 1),
 gr AS (SELECT symbol, t, l, 2::BIGINT AS i, 1::BIGINT AS c, l[1] AS m, 1::BIGINT AS k, 1::BIGINT AS done FROM pl2 UNION ALL
   SELECT symbol, t, l, i+1, CASE WHEN abs(l[i]-m)/m<.01 THEN c ELSE c+1 END, CASE WHEN abs(l[i]-m)/m<.01 THEN (m*k+l[i])/(k+1) ELSE l[i] END,
   CASE WHEN abs(l[i]-m)/m<.01 THEN k+1 ELSE 1 END, i FROM gr WHERE i<=len(l)),
 gl2 AS (SELECT symbol, t, c, arg_max(m, done) AS m, max(k) AS k FROM gr GROUP BY 1,2,3),
 lv AS (SELECT symbol, t, list(floor(m*100+.5)/100 ORDER BY k DESC, c) AS lv FROM (SELECT * FROM gl2 QUALIFY row_number() OVER (PARTITION BY
   symbol, t ORDER BY k DESC, c)<=5) GROUP BY 1,2),
 sr AS MATERIALIZED (SELECT px.symbol, price, coalesce(a.lv, []) AS supports, coalesce(b.lv, []) AS resistances FROM px LEFT JOIN lv a ON
   a.symbol=px.symbol AND a.t='s' LEFT JOIN lv b ON b.symbol=px.symbol AND b.t='r')"""
query("support_resistance", "symbol price:2 nearest_support:2 nearest_resistance:2 n_supports n_resistances",
      """SELECT symbol, price, list_max(supports) AS nearest_support, list_min(resistances) AS nearest_resistance, len(supports) AS n_supports,
         len(resistances) AS n_resistances FROM sr""", ctes("rets", more=SR, recursive=True))(
    lambda s, d: S.support_resistance(V.bars(s, d)).withColumn("n_supports", F.size("supports").cast("long")).withColumn(
        "n_resistances", F.size("resistances").cast("long")))
query("breakout_scan", "symbol direction level:2 distance_pct:2 volume_ratio:2 confirmed",
      """SELECT symbol, CASE WHEN r IS NOT NULL THEN 'bullish_breakout' ELSE 'bearish_breakdown' END AS direction, coalesce(r,s) AS level,
         floor((coalesce(r,s)-price)/price*10000+.5)/100 AS distance_pct, floor(v/v20*100+.5)/100 AS volume_ratio, v/v20>1.5 AS confirmed FROM (
         SELECT *, list_filter(resistances, lambda x: abs(x-price)/price<.1)[1] AS r, list_filter(supports, lambda x: abs(x-price)/price<.1)[1]
         AS s FROM sr) JOIN (SELECT symbol, max(volume) FILTER (rn=n) AS v, avg(volume) FILTER (rn<n AND rn>=n-20) AS v20 FROM b0 GROUP BY 1)
         USING (symbol) WHERE coalesce(r,s) IS NOT NULL""", ctes("rets", more=SR, recursive=True))(
    lambda s, d: S.breakout_scan(V.bars(s, d), 10.0))
query("signal_dashboard", "symbol price:2 score:0 bias n_signals top_signal support_pct:4 resistance_pct:4",
      f"""SELECT sr.symbol, price, coalesce(score,0) AS score, coalesce({BIAS}, 'neutral') AS bias, coalesce(n_signals,0) AS n_signals,
         top_signal, abs(list_max(supports)-price)/price*100 AS support_pct, abs(list_min(resistances)-price)/price*100 AS resistance_pct FROM sr
         LEFT JOIN sc USING (symbol)""", ctes("rets", more=f"{INPUT}, {PV}, {SCORE}, {SR}", recursive=True))(
    lambda s, d: S.signal_dashboard(V.bars(s, d)))

READ = """CASE WHEN rsi>70 THEN 'overbought' WHEN rsi<30 THEN 'oversold' ELSE 'neutral' END AS rsi_signal, CASE WHEN mh>0 THEN 'bullish' ELSE
  'bearish' END AS macd_side, CASE WHEN coalesce(s20,0)>coalesce(s50,0) THEN 'bullish' ELSE 'bearish' END AS trend, CASE WHEN close>bu THEN
  'above_upper' WHEN close<bl THEN 'below_lower' ELSE 'inside' END AS band, CASE WHEN close>e20 THEN 'above' ELSE 'below' END AS vs_ema"""
query("timeframe_signals", "symbol rsi:2 macd_hist:3 rsi_signal macd_side trend band vs_ema",
      f"SELECT symbol, floor(rsi*100+.5)/100 AS rsi, mh AS macd_hist, {READ} FROM la", PRE)(lambda s, d: S.timeframe_signals(V.bars(s, d)))
# two timeframes: the single-series SQL runs over (symbol, timeframe) joined into one name
BOTH = ctes("bars", more=TWO) + """,
 b00 AS (SELECT symbol||'|'||"interval" AS symbol, * EXCLUDE (symbol) FROM two), b0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts)
 AS prev, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM b00), """
BOTH = BOTH.replace("WITH ", "WITH RECURSIVE ", 1)
query("confluence", "symbol n_frames bullish bearish score:0 direction strength",
      f"""SELECT symbol, n_frames, bullish, bearish, floor(greatest(bullish,bearish)/n_frames*100+.5) AS score, CASE WHEN bullish>=bearish THEN
         'bullish' ELSE 'bearish' END AS direction, CASE WHEN greatest(bullish,bearish)/n_frames>=.8 THEN 'strong' WHEN
         greatest(bullish,bearish)/n_frames>=.6 THEN 'moderate' ELSE 'weak' END AS strength FROM (SELECT split_part(symbol,'|',1) AS symbol,
         count(*) AS n_frames, CAST(count(*) FILTER (b>s) AS BIGINT) AS bullish, CAST(count(*) FILTER (s>b) AS BIGINT) AS bearish FROM (SELECT *,
         (macd_side='bullish')::INT+(trend='bullish')::INT+(vs_ema='above')::INT+(rsi_signal='oversold')::INT+(band='below_lower')::INT AS b,
         (macd_side='bearish')::INT+(trend='bearish')::INT+(vs_ema='below')::INT+(rsi_signal='overbought')::INT+(band='above_upper')::INT AS s
         FROM (SELECT symbol, {READ} FROM la)) GROUP BY 1)""", BOTH + INPUT)(lambda s, d: S.confluence(two_frames(s, d)))
query("multi_timeframe_signals", "symbol n_frames avg_score:0 alignment",
      """SELECT *, CASE WHEN lo>0 AND avg_score>25 THEN 'strong_bullish' WHEN hi<0 AND avg_score<-25 THEN 'strong_bearish' WHEN hi>15 AND lo<-15
         THEN 'mixed' ELSE 'neutral' END AS alignment FROM (SELECT split_part(symbol,'|',1) AS symbol, count(*) AS n_frames,
         floor(avg(score)+.5) AS avg_score, min(score) AS lo, max(score) AS hi FROM sc GROUP BY 1)""", BOTH + f"{INPUT}, {PV}, {SCORE}")(
    lambda s, d: S.multi_timeframe_signals(S.generate_signals(two_frames(s, d))))

# --- regimes
FEAT = f"""{BB}, {ATR}, {RSI}, {ADX},
 f0 AS MATERIALIZED (SELECT *, lead(high) OVER w AS h3, lead(high,2) OVER w AS h4, lag(high) OVER w AS h1, lag(high,2) OVER w AS h2, lead(low) OVER w AS l3,
   lead(low,2) OVER w AS l4, lag(low) OVER w AS l1, lag(low,2) OVER w AS l2 FROM (SELECT b.*, atr, 4*bb_sd/bb_mid AS bw, rsi, adx, b.close>bb_mid AS above, abs(b.close-b.prev) AS st, b.close/b.prev-1 AS ret,
   CASE WHEN b.rn>=50 THEN avg(b.close) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS 49 PRECEDING) END AS s50 FROM b0 b JOIN bb x
   USING (symbol, ts) JOIN atr USING (symbol, ts) JOIN rsi USING (symbol, ts) LEFT JOIN adx USING (symbol, ts))
   WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 sw AS (SELECT symbol, rn, CASE WHEN high>greatest(h1,h2,h3,h4) THEN high END AS sh, CASE WHEN low<least(l1,l2,l3,l4) THEN low END AS sl FROM f0
   WHERE h2 IS NOT NULL AND h4 IS NOT NULL),
 pick AS MATERIALIZED (SELECT *, {{pick}} FROM f0),
 hh AS (SELECT p.symbol, p.rn, list(sh ORDER BY s.rn) FILTER (sh IS NOT NULL) AS hs, list(sl ORDER BY s.rn) FILTER (sl IS NOT NULL) AS lw FROM pick p
   JOIN sw s ON s.symbol=p.symbol AND s.rn BETWEEN p.rn-27 AND p.rn-2 WHERE use AND p.rn>=30 GROUP BY 1,2),
 run AS (SELECT p.symbol, p.rn, count(r.ret) AS k, stddev_samp(r.ret) AS sd, max(r.close) AS mx, min(r.close) AS mn, arg_min(r.close, r.rn) AS fc,
   coalesce(sum(r.st),0) AS path, count(*) FILTER (r.above IS NOT NULL AND r.pa IS NOT NULL AND r.above<>r.pa) AS cr, count(r.atr) AS ka,
   count(*) FILTER (r.atr<p.atr) AS kb FROM pick p JOIN (SELECT *, lag(above) OVER (PARTITION BY symbol ORDER BY rn) AS pa FROM f0) r
   ON r.symbol=p.symbol AND r.rn<=p.rn WHERE use GROUP BY 1,2),
 w5 AS (SELECT symbol, rn, avg(s50) OVER f5 AS sm, lag(s50,4) OVER o AS sf, avg(adx) OVER (PARTITION BY symbol ORDER BY rn ROWS 2 PRECEDING) AS a3,
   avg(adx) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 4 PRECEDING AND 3 PRECEDING) AS a2, avg(volume) OVER f5 AS v5,
   avg(volume) OVER (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING) AS v20, min(bw) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 4
   PRECEDING AND 2 PRECEDING) AS nb, avg(CASE WHEN high=low THEN 0 ELSE abs(close-open)/(high-low) END) OVER (PARTITION BY symbol ORDER BY rn
   ROWS 19 PRECEDING) AS br FROM f0 WINDOW o AS (PARTITION BY symbol ORDER BY rn), f5 AS (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING)),
 snap AS MATERIALIZED (SELECT p.symbol, p.ts, p.rn, p.n, coalesce(adx,0) AS adx, CASE WHEN p.rn<32 THEN 'flat' WHEN a3-a2>2 THEN 'rising' WHEN a3-a2<-2
   THEN 'falling' ELSE 'flat' END AS adx_trend, CASE WHEN p.rn<54 THEN 'neutral' WHEN (s50-sf)/sm*100>.5 THEN 'up' WHEN (s50-sf)/sm*100<-.5 THEN
   'down' ELSE 'neutral' END AS trend, CASE WHEN ka<10 THEN 50 ELSE floor(kb/ka*100+.5) END AS vol_pct, coalesce(bw,0) AS bb_width,
   coalesce(rsi,50) AS rsi, floor(coalesce((close-s50)/s50,0)*10000+.5)/100 AS vs_sma50, coalesce(len(hs)>=2 AND hs[-1]>hs[-2] AND
   (len(hs)<3 OR hs[-2]>hs[-3]), false) AS higher_highs, coalesce(len(lw)>=2 AND lw[-1]<lw[-2] AND (len(lw)<3 OR lw[-2]<lw[-3]), false) AS
   lower_lows, p.rn>=20 AND v20>0 AND v5/v20>1.5 AS vol_spike, coalesce(p.rn>=24 AND nb<.03 AND bw>.045, false) AS "release", br AS body_ratio,
   coalesce(atr,0)/abs(close)*100 AS norm_atr, CASE WHEN k>1 THEN sd ELSE 0 END AS ret_sd, CASE WHEN mx=mn THEN 0 ELSE abs(close-fc)/(mx-mn) END
   AS net_dir, CAST(cr AS BIGINT) AS crosses, CASE WHEN abs(close-fc)<.001 THEN 100 ELSE path/abs(close-fc) END AS path_ratio FROM pick p JOIN run
   USING (symbol, rn) JOIN w5 USING (symbol, rn) LEFT JOIN hh USING (symbol, rn) WHERE use),
 sc0 AS (SELECT *, (CASE WHEN net_dir>.6 AND trend='up' THEN .3 WHEN trend='up' THEN .15 ELSE 0 END+CASE WHEN adx>25 THEN .2 ELSE 0 END+CASE WHEN
   vs_sma50>2 THEN .15 WHEN vs_sma50>0 THEN .05 ELSE 0 END+CASE WHEN higher_highs THEN .15 ELSE 0 END+CASE WHEN rsi>55 AND rsi<80 THEN .1 ELSE 0 END)
   *damp AS s1, (CASE WHEN net_dir>.6 AND trend='down' THEN .3 WHEN trend='down' THEN .15 ELSE 0 END+CASE WHEN adx>25 THEN .2 ELSE 0 END+CASE WHEN
   vs_sma50<-2 THEN .15 WHEN vs_sma50<0 THEN .05 ELSE 0 END+CASE WHEN lower_lows THEN .15 ELSE 0 END+CASE WHEN rsi<45 AND rsi>20 THEN .1 ELSE 0 END)
   *damp AS s2, (CASE WHEN path_ratio>10 THEN .3 WHEN path_ratio>5 THEN .2 WHEN path_ratio>3 THEN .1 ELSE 0 END+CASE WHEN crosses>10 THEN .2 WHEN
   crosses>5 THEN .1 ELSE 0 END+CASE WHEN adx<20 THEN .15 ELSE 0 END+CASE WHEN NOT higher_highs AND NOT lower_lows THEN .1 ELSE 0 END+CASE WHEN
   trend='neutral' THEN .1 ELSE 0 END+CASE WHEN norm_atr>.3 AND norm_atr<8 THEN .1 ELSE 0 END)*CASE WHEN path_ratio<2 THEN .3 ELSE 1 END*CASE WHEN
   ret_sd>.08 THEN .3 WHEN ret_sd>.05 THEN .6 ELSE 1 END*CASE WHEN ret_sd<.002 THEN .5 ELSE 1 END AS s3, (CASE WHEN ret_sd>.12 THEN .4 WHEN
   ret_sd>.06 THEN .25 WHEN ret_sd>.03 THEN .15 ELSE 0 END+CASE WHEN norm_atr>15 THEN .3 WHEN norm_atr>8 THEN .2 WHEN norm_atr>4 THEN .1 ELSE 0 END
   +CASE WHEN bb_width>.08 THEN .1 ELSE 0 END+CASE WHEN body_ratio>.6 THEN .1 ELSE 0 END)*CASE WHEN norm_atr<2 THEN .3 ELSE 1 END AS s4,
   (CASE WHEN ret_sd<.002 THEN .35 WHEN ret_sd<.005 THEN .25 WHEN ret_sd<.01 THEN .1 ELSE 0 END+CASE WHEN norm_atr<.2 THEN .25 WHEN norm_atr<.5
   THEN .15 ELSE 0 END+CASE WHEN bb_width<.03 THEN .15 ELSE 0 END+CASE WHEN body_ratio<.35 THEN .1 ELSE 0 END+CASE WHEN adx<15 THEN .1 ELSE 0 END)
   *CASE WHEN norm_atr>1 THEN .3 ELSE 1 END AS s5, CASE WHEN "release" THEN .3 ELSE 0 END+CASE WHEN vol_spike THEN .25 ELSE 0 END+CASE WHEN
   adx_trend='rising' THEN .2 ELSE 0 END+CASE WHEN vol_pct>60 AND vol_pct<90 THEN .15 ELSE 0 END+CASE WHEN body_ratio>.6 THEN .1 ELSE 0 END AS s6 FROM (
   SELECT *, CASE WHEN net_dir<.3 THEN .5 ELSE 1 END*CASE WHEN ret_sd>.05 THEN .3 WHEN norm_atr>6 THEN .5 ELSE 1 END*CASE WHEN path_ratio>8 THEN .5
   ELSE 1 END AS damp FROM snap)),
 dec AS MATERIALIZED (SELECT *, CASE greatest(s1,s2,s3,s4,s5,s6) WHEN s1 THEN 'trending_up' WHEN s2 THEN 'trending_down' WHEN s3 THEN 'ranging' WHEN s4
   THEN 'volatile' WHEN s5 THEN 'quiet' ELSE 'breakout' END AS regime, greatest(0, least(1, q[1]*.7+(q[1]-q[2])*.6)) AS conf FROM (SELECT *,
   list_reverse_sort([s1,s2,s3,s4,s5,s6]::DOUBLE[]) AS q FROM sc0))"""
LASTP = ctes("rets", more=FEAT.format(pick="rn=n AS use"), recursive=True)
SNAP = ("symbol n adx:4 adx_trend trend vol_pct:0 bb_width:5 rsi:4 vs_sma50:2 higher_highs lower_lows vol_spike release body_ratio:5 norm_atr:4 "
        "ret_sd:6 net_dir:6 crosses path_ratio:4")
query("regime_snapshot", SNAP, "SELECT * FROM snap", LASTP)(lambda s, d: R.snapshot(V.bars(s, d)))
query("regime_scores", "symbol s_trending_up:5 s_trending_down:5 s_ranging:5 s_volatile:5 s_quiet:5 s_breakout:5",
      """SELECT symbol, s1 AS s_trending_up, s2 AS s_trending_down, s3 AS s_ranging, s4 AS s_volatile, s5 AS s_quiet, s6 AS s_breakout FROM sc0""",
      LASTP)(lambda s, d: R.regime_scores(V.bars(s, d)))
query("regime_detect", "symbol regime confidence:2", "SELECT symbol, regime, conf AS confidence FROM dec", LASTP)(
    lambda s, d: R.detect(V.bars(s, d)))
query("regime_match", "symbol regime risk_level sizing",
      """SELECT symbol, regime, CASE regime WHEN 'trending_down' THEN 'high' WHEN 'volatile' THEN 'high' WHEN 'ranging' THEN 'low' WHEN 'quiet' THEN
         'low' ELSE 'low' END AS risk_level, CASE regime WHEN 'volatile' THEN 'reduced' ELSE 'full' END AS sizing FROM dec""", LASTP)(
    lambda s, d: R.match(V.bars(s, d), "aggressive"))
SAMP = "rn>=greatest(50, n-{span}) AND (rn-greatest(50, n-{span}))%10=0 AS use"
TRP = ctes("rets", more=FEAT.format(pick=SAMP.format(span=200)), recursive=True)
TR = """(SELECT t.symbol, from_regime, regime AS to_regime, b.ts, t.n-b.rn+1 AS bars_ago FROM (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY
   rn) AS from_regime FROM dec) t JOIN b0 b ON b.symbol=t.symbol AND b.rn=least(t.rn+1, t.n) WHERE from_regime<>regime)"""
query("regime_transitions", "symbol from_regime to_regime ts bars_ago", f"SELECT * FROM {TR}", TRP)(lambda s, d: R.transitions(V.bars(s, d)))
query("scan_regime_changes", "symbol n_changes bars_ago regime",
      f"""SELECT symbol, count(*) AS n_changes, min(bars_ago) AS bars_ago, arg_min(to_regime, bars_ago) AS regime FROM {TR} WHERE bars_ago<=120
         GROUP BY 1""", TRP)(lambda s, d: R.scan_changes(V.bars(s, d), 120))
query("regime_history", "symbol seg regime start end_rn duration confidence:2",
      """SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY start)-1 AS seg, regime, start, fin AS end_rn, fin-start AS duration, cf AS
         confidence FROM (SELECT symbol, regime, min(rn) AS start, coalesce(lead(min(rn)) OVER (PARTITION BY symbol ORDER BY min(rn)), any_value(n)) AS fin,
         list_reduce(list(floor(conf*1000+.5)/1000 ORDER BY rn), lambda a, x: (a+x)/2) AS cf FROM (SELECT *, row_number() OVER (PARTITION BY symbol
         ORDER BY rn)-row_number() OVER (PARTITION BY symbol, regime ORDER BY rn) AS g FROM dec) GROUP BY symbol, regime, g)""",
      ctes("rets", more=FEAT.format(pick=SAMP.format(span=300)), recursive=True))(
    lambda s, d: R.history(V.bars(s, d)).withColumn("seg", F.col("seg").cast("long")).withColumnRenamed("end", "end_rn"))

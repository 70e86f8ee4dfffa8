"""Trading signals of the last bar of every series, as one exploded table.

A rule is an expression over the last row of an indicator table. The last
``TAIL`` rows per series hold every lookback (the longest EMA has forgotten
anything older), so each series is a bounded group; ``n_bars`` is counted apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_up
from ..plans.blocks import Frame, Series, ema_lookback, tail
from ..plans.rank import ranked
from ..sources.views import BAR_SERIES
from .indicators import add_atr, add_bollinger, add_stochastic, sma_col
from .recurrent import add_smoothed

TAIL = ema_lookback(55) + 60
RIBBON = (8, 13, 21, 34, 55)


def indicator_tail(bars: DataFrame, series: Series = BAR_SERIES, rows: int = TAIL) -> Frame:
    fr = tail(bars, series, rows)
    fr = add_stochastic(add_bollinger(add_atr(fr)))
    fr = add_smoothed(fr, {f"ema_{p}": p for p in (*RIBBON, 20)}, (12, 26, 9), 14, 14)
    return fr.with_columns(sma_20=sma_col(fr, "close", 20), sma_50=sma_col(fr, "close", 50),
                           sma_200=sma_col(fr, "close", 200))


def last_rows(fr: Frame, cols: dict[str, Column], bars: DataFrame) -> DataFrame:
    """The last row of each series; ``n_bars`` counts all its bars, not only the kept ones."""
    df = fr.df.select("*", *[c.alias(n) for n, c in cols.items()])
    total = bars.groupBy(*fr.series.key).agg(F.count(F.lit(1)).alias("n_bars"))
    return df.filter(F.col("_rn") == F.col("_n")).drop("_n", "_blk", "_halo", "_rn").join(total, list(fr.series.key))


def signal_inputs(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """One row per series with everything the rules read."""
    fr = indicator_tail(bars, series)
    lag = lambda c, k=1: F.lag(c, k).over(fr.w)
    span = lambda fn, c, lo, hi=0: fn(c).over(fr.rows(lo, hi))
    cols = {f"{c}_1": lag(c) for c in ("sma_50", "sma_200", "macd", "macd_signal", "bb_width", "stoch_k", "stoch_d",
                                       "adx", "open", "high", "low", "close")}
    cols |= {"close_2": lag("close", 2), "open_2": lag("open", 2), "close_4": lag("close", 4), "close_5": lag("close", 5)}
    cols |= {"ph_now": span(F.max, "close", -9), "ph_old": span(F.max, "close", -19, -10),
             "pl_now": span(F.min, "close", -9), "pl_old": span(F.min, "close", -19, -10),
             "rh_now": span(F.max, "rsi", -9), "rh_old": span(F.max, "rsi", -19, -10),
             "rl_now": span(F.min, "rsi", -9), "rl_old": span(F.min, "rsi", -19, -10),
             "w_now": span(F.avg, "bb_width", -4), "w_old": span(F.avg, "bb_width", -20, -5),
             "v20": span(F.avg, "volume", -20, -1), "hi_band": span(F.max, "high", -19, -2),
             "lo_band": span(F.min, "low", -19, -2),
             "last30": F.collect_list(F.struct(F.col("_rn").alias("i"), "high", "low")).over(fr.rows(-29))}
    return last_rows(fr, cols, bars)


def _rule(cond: Column, name: str, side: Column | str, strength: Column | str, conf: float, target: Column | None = None,
          stop: Column | None = None) -> Column:
    d = F.lit(None).cast("double")
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(cond, F.struct(
        F.lit(name).alias("name"), lit(side).alias("type"), lit(strength).alias("strength"), F.lit(conf).alias("confidence"),
        (target if target is not None else d).alias("target"), (stop if stop is not None else d).alias("stop")))


def _two_way(up: Column, dn: Column, names: tuple[str, str], strength, conf: float, t: float | None, s: float | None) -> list[Column]:
    """A buy rule and its mirror: target t ATR ahead, stop s ATR behind; the sell side only when the buy side is not met."""
    px, a = F.col("close"), F.col("a")
    tgt = (px + t * a, px - t * a) if t else (None, None)
    stp = (px - s * a, px + s * a) if s else (None, None)
    return [_rule(up, names[0], "buy", strength, conf, tgt[0], stp[0]), _rule(dn, names[1], "sell", strength, conf, tgt[1], stp[1])]


def trend_rules() -> list[Column]:
    c, px, a, n = F.col, F.col("close"), F.col("a"), F.col("n_bars")
    cross = lambda x, y: ((c(f"{x}_1") <= c(f"{y}_1")) & (c(x) > c(y)), (c(f"{x}_1") >= c(f"{y}_1")) & (c(x) < c(y)))
    gold, death = cross("sma_50", "sma_200")
    rules = _two_way((n >= 201) & gold, (n >= 201) & death, ("Golden Cross (SMA50 x SMA200)", "Death Cross (SMA50 x SMA200)"),
                     "strong", 0.85, 3, 1.5)
    div = n >= 34  # twenty RSI values
    rules += _two_way(div & (c("pl_now") < c("pl_old")) & (c("rl_now") > c("rl_old")),
                      div & (c("ph_now") > c("ph_old")) & (c("rh_now") < c("rh_old")),
                      ("Bullish RSI Divergence", "Bearish RSI Divergence"), "moderate", 0.7, 2, 1)
    rules += _two_way((c("macd_1") <= 0) & (c("macd") > 0), (c("macd_1") >= 0) & (c("macd") < 0),
                      ("MACD Zero Cross (bullish)", "MACD Zero Cross (bearish)"), "moderate", 0.65, 2, 1)
    up, dn = cross("macd", "macd_signal")
    rules += _two_way(up, dn, ("MACD Signal Cross (bullish)", "MACD Signal Cross (bearish)"), "moderate", 0.6, 2, 1)
    low, high = px <= c("bb_lower"), px >= c("bb_upper")
    rules += [_rule((n >= 21) & low, "Bollinger Band Bounce (lower)", "buy", "moderate", 0.6, c("bb_mid"), px - a),
              _rule((n >= 21) & ~low & high, "Bollinger Band Bounce (upper)", "sell", "moderate", 0.6, c("bb_mid"), px + a)]
    squeeze = (n >= 40) & (c("w_now") < 0.6 * c("w_old")) & (c("bb_width") > 1.2 * c("bb_width_1"))
    buy = px > c("bb_mid")
    pick = lambda y, x: F.when(y, x[0]).otherwise(x[1])
    side = lambda y: F.when(y, "buy").otherwise("sell")
    rules.append(_rule(squeeze, "Bollinger Squeeze Release", side(buy), "strong", 0.75, pick(buy, (px + 3 * a, px - 3 * a)),
                       pick(buy, (px - 1.5 * a, px + 1.5 * a))))
    burst, rise = (n >= 21) & (c("volume") > 2 * c("v20")) & (c("v20") > 0), px > c("close_1")
    rules.append(_rule(burst, "Volume Breakout", side(rise), "moderate", 0.65, pick(rise, (px + 2 * a, px - 2 * a)),
                       pick(rise, (px - a, px + a))))
    rules += [_rule((n >= 20) & (px > c("hi_band")), "Resistance Break", "buy", "strong", 0.75, px + 3 * a, c("hi_band") - 0.5 * a),
              _rule((n >= 20) & (px < c("lo_band")), "Support Break", "sell", "strong", 0.75, px - 3 * a, c("lo_band") + 0.5 * a)]
    e = [c(f"ema_{p}") for p in RIBBON]
    down = lambda op: e_and([op(e[i], e[i + 1]) for i in range(4)])
    bull, bear = down(lambda x, y: x > y), down(lambda x, y: x < y)
    spread = (F.greatest(*e) - F.least(*e)) / px
    power = F.when(spread > 0.03, "strong").otherwise("moderate")
    rules += [_rule((n >= 56) & bull, "EMA Ribbon (bullish aligned)", "buy", power, 0.7, px + 2 * a, e[4] - 0.5 * a),
              _rule((n >= 56) & bear, "EMA Ribbon (bearish aligned)", "sell", power, 0.7, px - 2 * a, e[4] + 0.5 * a)]
    kup, kdn = cross("stoch_k", "stoch_d")
    rules += _two_way((c("stoch_k") < 20) & kup, (c("stoch_k") > 80) & kdn,
                      ("Stochastic Oversold Crossover", "Stochastic Overbought Crossover"), "moderate", 0.65, 2, 1)
    start, up4 = (c("adx_1") <= 25) & (c("adx") > 25), px > c("close_4")
    rules.append(_rule(start, "ADX Trend Start", side(up4), "moderate", 0.6, pick(up4, (px + 2.5 * a, px - 2.5 * a)),
                       pick(up4, (px - 1.5 * a, px + 1.5 * a))))
    return rules


def e_and(conds: list[Column]) -> Column:
    out = conds[0]
    for x in conds[1:]:
        out = out & x
    return out


def candle_rules() -> list[Column]:
    c, o, px = F.col, F.col("open"), F.col("close")
    n = c("n_bars")
    body, rng = F.abs(px - o), c("high") - c("low")
    green = e_and([px > o, c("close_1") > c("open_1"), c("close_2") > c("open_2")])
    red = e_and([px < o, c("close_1") < c("open_1"), c("close_2") < c("open_2")])
    rules = [_rule((n >= 4) & green & (c("close_1") > c("close_2")) & (px > c("close_1")), "Three White Soldiers", "buy", "moderate", 0.65),
             _rule((n >= 4) & red & (c("close_1") < c("close_2")) & (px < c("close_1")), "Three Black Crows", "sell", "moderate", 0.65)]
    bigger = body > F.abs(c("close_1") - c("open_1"))
    rules += [_rule((c("close_1") < c("open_1")) & (px > o) & (o <= c("close_1")) & (px >= c("open_1")) & bigger,
                    "Bullish Engulfing", "buy", "moderate", 0.7),
              _rule((c("close_1") > c("open_1")) & (px < o) & (o >= c("close_1")) & (px <= c("open_1")) & bigger,
                    "Bearish Engulfing", "sell", "moderate", 0.7)]
    doji = (rng > 0) & (body / rng < 0.1)
    rules += [_rule(doji & (c("close_1") > c("close_4")), "Doji Star (bearish)", "sell", "weak", 0.5),
              _rule(doji & (c("close_1") < c("close_4")), "Doji Star (bullish)", "buy", "weak", 0.5)]
    up, lo = c("high") - F.greatest(o, px), F.least(o, px) - c("low")
    real = (n >= 5) & (rng > 0) & (body > 0)
    rules += [_rule(real & (c("close_1") < c("close_5")) & (lo > 2 * body) & (up < 0.5 * body), "Hammer", "buy", "moderate", 0.6),
              _rule(real & (c("close_1") > c("close_5")) & (up > 2 * body) & (lo < 0.5 * body), "Shooting Star", "sell", "moderate", 0.6)]
    return rules


def double_pivots() -> Column:
    """Array of double top and bottom signals from the last 30 bars, one per first pivot."""
    px, a, w = F.col("close"), F.col("a"), F.col("last30")

    def pivots(field: str, top: bool) -> Column:
        def is_pivot(x: Column, i: Column) -> Column:
            near = [F.get(w, i + k)[field] for k in (-2, -1, 1, 2)]
            beyond = [(x[field] > y) if top else (x[field] < y) for y in near]
            return (i >= 2) & (i < 28) & e_and(beyond)
        return F.transform(F.filter(w, is_pivot), lambda x: F.struct(x.i.alias("i"), x[field].alias("v")))

    def signals(p: Column, top: bool) -> Column:
        def one(x: Column) -> Column:
            beyond = lambda y: (px < y.v) if top else (px > y.v)
            mate = F.get(F.filter(p, lambda y: (y.i - x.i >= 5) & (F.abs(x.v - y.v) / x.v < 0.015) & beyond(y)), F.lit(0))
            edge = F.greatest(x.v, mate.v) + 0.5 * a if top else F.least(x.v, mate.v) - 0.5 * a
            return _rule(mate.isNotNull(), "Double Top" if top else "Double Bottom", "sell" if top else "buy", "strong", 0.7,
                         px - 3 * a if top else px + 3 * a, edge)
        return F.transform(p, one)

    both = F.concat(signals(pivots("high", True), True), signals(pivots("low", False), False))
    return F.when(F.col("n_bars") >= 30, both).otherwise(F.filter(both, lambda x: F.lit(False)))


def generate_signals(bars: DataFrame, series: Series = BAR_SERIES, candles_only: bool = False,
                     min_bars: int = 55) -> DataFrame:
    """Every signal of the last bar of every series with at least 55 bars."""
    x = signal_inputs(bars, series).withColumn("a", F.coalesce("atr", F.col("close") * 0.02))
    rules = F.array(*candle_rules()) if candles_only else F.concat(
        F.array(*trend_rules()), F.array(*candle_rules()), double_pivots())
    x = x.filter(F.col("n_bars") >= (4 if candles_only else min_bars))
    return x.select(*series.key, *series.order, F.col("close").alias("price"), F.explode(F.array_compact(rules)).alias("s")) \
        .select(*series.key, *series.order, "price", "s.*")


def candle_patterns(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    return generate_signals(bars, series, candles_only=True)


def divergences(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("name").contains("Divergence"))


def score_signals(signals: DataFrame, key=BAR_SERIES.key) -> DataFrame:
    """Score in -100..100, bias at +-15, and the signal with the greatest weighted confidence."""
    # Weight of each strength.
    w = (F.when(F.col("strength") == "strong", 3).when(F.col("strength") == "moderate", 2).otherwise(1)) * F.col("confidence")
    sign = F.when(F.col("type") == "buy", w).when(F.col("type") == "sell", -w).otherwise(0.0)
    score = F.when(F.sum(w) == 0, 0.0).otherwise(half_up(F.sum(sign) / F.sum(w) * 100, 0))
    g = signals.groupBy(*key).agg(F.count(F.lit(1)).alias("n_signals"), score.alias("score"),
                                  F.min_by("name", F.struct(-F.round(w, 9), "name")).alias("top_signal"))
    return g.withColumn("bias", F.when(F.col("score") > 15, "bullish").when(F.col("score") < -15, "bearish").otherwise("neutral"))


def scan_market(signals: DataFrame, min_score: float = 0.0, key=BAR_SERIES.key) -> DataFrame:
    s = score_signals(signals, key).filter(F.abs("score") >= min_score)
    return ranked(s, F.abs("score"), ties=key, descending=True)


def multi_timeframe_signals(signals: DataFrame) -> DataFrame:
    """Scores of all timeframes of a symbol: strong when all have one sign and the mean exceeds 25."""
    s = score_signals(signals)
    some = lambda cond: F.max(F.when(cond, 1).otherwise(0)) == 1
    g = s.groupBy("symbol", "exchange").agg(
        F.count(F.lit(1)).alias("n_frames"), half_up(F.avg("score"), 0).alias("avg_score"), F.min("score").alias("_lo"),
        F.max("score").alias("_hi"), (some(F.col("score") > 15) & some(F.col("score") < -15)).alias("_mix"))
    a = F.col("avg_score")
    return g.withColumn("alignment", F.when((F.col("_lo") > 0) & (a > 25), "strong_bullish").when(
        (F.col("_hi") < 0) & (a < -25), "strong_bearish").when(F.col("_mix"), "mixed").otherwise("neutral")).drop(
        "_lo", "_hi", "_mix")


def levels_from(pivots: Column) -> Column:
    """Greedy clusters of a sorted price array (within 1 % of the running mean), the five largest, rounded."""
    start = F.array().cast("array<struct<s:double,n:int>>")

    def add(acc: Column, v: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        near = (F.size(acc) > 0) & (F.abs(v - last.s / last.n) / (last.s / last.n) < 0.01)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                         F.array(F.struct((last.s + v).alias("s"), (last.n + 1).alias("n"))))
        return F.when(near, grown).otherwise(F.concat(acc, F.array(F.struct(v.alias("s"), F.lit(1).alias("n")))))

    groups = F.aggregate(pivots, start, add)
    ranks = F.sort_array(F.transform(groups, lambda g, i: F.struct((-g.n).alias("k"), i.alias("i"), (g.s / g.n).alias("m"))))
    return F.transform(F.slice(ranks, 1, 5), lambda r: half_up(r.m, 2))


def support_resistance(bars: DataFrame, limit: int = 200, series: Series = BAR_SERIES) -> DataFrame:
    """Clustered strict 5-bar pivots of the last ``limit`` bars below and above the last close."""
    t = tail(bars, series, limit)
    lag = lambda c, k: F.lag(c, k).over(t.w)
    mid_h, mid_l = lag("high", 2), lag("low", 2)
    full = F.col("_rn") >= 5
    hi = full & e_and([mid_h > x for x in (F.col("high"), lag("high", 1), lag("high", 3), lag("high", 4))])
    lo = full & e_and([mid_l < x for x in (F.col("low"), lag("low", 1), lag("low", 3), lag("low", 4))])
    t = t.with_columns(_ph=F.when(hi, mid_h), _pl=F.when(lo, mid_l))
    g = t.df.groupBy(*series.key).agg(
        F.max_by("close", "_rn").alias("price"), F.sort_array(F.collect_list("_ph")).alias("h"),
        F.sort_array(F.collect_list("_pl")).alias("l"))
    g = g.withColumn("resistances", levels_from(F.filter("h", lambda v: v > F.col("price")))).withColumn(
        "supports", levels_from(F.filter("l", lambda v: v < F.col("price"))))
    return g.select(*series.key, "price", "supports", "resistances", F.array_max("supports").alias("nearest_support"),
                    F.array_min("resistances").alias("nearest_resistance"))


def breakout_scan(bars: DataFrame, proximity_pct: float = 2.0, limit: int = 200, series: Series = BAR_SERIES) -> DataFrame:
    """Series within proximity of a resistance (first) or support, confirmed by 1.5 times the mean volume."""
    t = tail(bars, series, 25)
    back = F.col("_n") - F.col("_rn")
    v = t.df.groupBy(*series.key).agg(F.max("_n").alias("_n"), F.max(F.when(back == 0, F.col("volume"))).alias("_v"),
                                      (F.sum(F.when((back > 0) & (back <= 20), F.col("volume"))) / 20).alias("_v20"))
    lv = support_resistance(bars, limit, series).join(v.filter("_n >= 25"), list(series.key))
    px = F.col("price")
    near = lambda c: F.get(F.filter(c, lambda p: F.abs(p - px) / px < proximity_pct / 100), F.lit(0))
    lv = lv.withColumn("_r", near("resistances")).withColumn("_s", near("supports"))
    lv = lv.withColumn("level", F.coalesce("_r", "_s")).filter("level is not null")
    ratio = F.when(F.col("_v20") > 0, F.col("_v") / F.col("_v20")).otherwise(1.0)
    return lv.select(
        *series.key, "price", F.when(F.col("_r").isNotNull(), "bullish_breakout").otherwise("bearish_breakdown").alias("direction"),
        "level", half_up((F.col("level") - px) / px * 100, 2).alias("distance_pct"), half_up(ratio, 2).alias("volume_ratio"),
        (ratio > 1.5).alias("confirmed")).orderBy(F.col("confirmed").desc(), F.abs("distance_pct"), "symbol")


def signal_dashboard(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Score, bias, top signal and nearest levels with distance per series."""
    s = score_signals(generate_signals(bars, series), series.key)
    lv = support_resistance(bars, 200, series)
    d = lambda c: (F.abs(F.col(c) - F.col("price")) / F.col("price") * 100)
    out = lv.join(s, list(series.key), "left").na.fill({"score": 0.0, "n_signals": 0, "bias": "neutral"})
    return out.withColumn("support_pct", d("nearest_support")).withColumn("resistance_pct", d("nearest_resistance"))


def timeframe_signals(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Readings of the last bar: RSI zone, MACD sign, SMA trend, band position, price against EMA20."""
    x = last_rows(indicator_tail(bars, series), {}, bars)
    c, px = F.col, F.col("close")
    r = half_up(F.coalesce("rsi", F.lit(50.0)), 2)
    x = x.withColumn("rsi", r)
    return x.select(
        *series.key, *series.order, "n_bars", "rsi", "macd_hist",
        F.when(c("rsi") > 70, "overbought").when(c("rsi") < 30, "oversold").otherwise("neutral").alias("rsi_signal"),
        F.when(c("macd_hist") > 0, "bullish").otherwise("bearish").alias("macd_side"),
        F.when(F.coalesce(c("sma_20"), F.lit(0.0)) > F.coalesce(c("sma_50"), F.lit(0.0)), "bullish").otherwise("bearish").alias("trend"),
        F.when(px > c("bb_upper"), "above_upper").when(px < c("bb_lower"), "below_lower").otherwise("inside").alias("band"),
        F.when(px > F.coalesce(c("ema_20"), px), "above").otherwise("below").alias("vs_ema"))


def confluence(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Majority vote of the timeframes of each symbol; ties go bullish."""
    t = timeframe_signals(bars, series)
    one = lambda cond: F.when(cond, 1).otherwise(0)
    c = F.col
    bull = (one(c("macd_side") == "bullish") + one(c("trend") == "bullish") + one(c("vs_ema") == "above")
            + one(c("rsi_signal") == "oversold") + one(c("band") == "below_lower"))
    bear = (one(c("macd_side") == "bearish") + one(c("trend") == "bearish") + one(c("vs_ema") == "below")
            + one(c("rsi_signal") == "overbought") + one(c("band") == "above_upper"))
    g = t.withColumn("_b", one(bull > bear)).withColumn("_s", one(bear > bull)).groupBy("symbol", "exchange").agg(
        F.count(F.lit(1)).alias("n_frames"), F.sum("_b").alias("bullish"), F.sum("_s").alias("bearish"))
    score = half_up(F.greatest("bullish", "bearish") / F.col("n_frames") * 100, 0)
    return g.withColumn("score", score).withColumn("direction", F.when(F.col("bullish") >= F.col("bearish"), "bullish")
                        .otherwise("bearish")).withColumn("strength", F.when(F.col("score") >= 80, "strong")
                        .when(F.col("score") >= 60, "moderate").otherwise("weak"))

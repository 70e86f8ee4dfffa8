"""Market regimes: features of every prefix of a series, six scores, segments and transitions.

Features that look at the whole history are running aggregates, so a sampled
prefix is just a row of the feature table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, half_up, safe_div
from ..plans.blocks import Series, framed, wilder_lookback
from ..plans.lineage import cut
from ..sources.views import BAR_SERIES
from .indicators import add_atr, add_bollinger, sma_col
from .recurrent import add_smoothed

REGIMES = ("trending_up", "trending_down", "ranging", "volatile", "quiet", "breakout")
# Strategies, risk level and position sizing of each regime.
PLAYBOOK = {
    "trending_up": (["momentum", "trend-following", "breakout"], "medium", "full"),
    "trending_down": (["short-selling", "hedging", "mean-reversion"], "high", "reduced"),
    "ranging": (["mean-reversion", "grid-trading", "range-trading"], "low", "full"),
    "volatile": (["reduce-size", "widen-stops", "volatility-selling"], "high", "minimal"),
    "quiet": (["accumulate", "bollinger-squeeze", "breakout-preparation"], "low", "full"),
    "breakout": (["momentum", "trend-following", "scale-in"], "medium", "reduced"),
}


def features(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """One row per prefix (ending at each bar) with all features but the volatility percentile."""
    fr = framed(bars, series, lookback=wilder_lookback(14) + 40)
    fr = add_smoothed(add_bollinger(add_atr(fr)), rsi=14, adx=14)
    c, w = F.col, fr.w
    prev = F.lag("close").over(w)
    s20 = sma_col(fr, "close", 20)
    fr = fr.with_columns(ret=safe_div(c("close") - prev, prev), step=F.abs(c("close") - prev), above=c("close") > s20,
                         sma_50=sma_col(fr, "close", 50), sma_200=sma_col(fr, "close", 200))
    lag = lambda x, k: F.lag(x, k).over(w)
    hi = c("_rn") >= 5
    for x in (c("high"), lag("high", 1), lag("high", 3), lag("high", 4)):
        hi = hi & (lag("high", 2) > x)
    lo = c("_rn") >= 5
    for x in (c("low"), lag("low", 1), lag("low", 3), lag("low", 4)):
        lo = lo & (lag("low", 2) < x)
    rng = c("high") - c("low")
    fr = fr.with_columns(cross=F.when(lag("above", 1).isNotNull() & (lag("above", 1) != c("above")), 1).otherwise(0),
                         sw_h=F.when(hi, lag("high", 2)), sw_l=F.when(lo, lag("low", 2)),
                         body=F.when(rng == 0, 0.0).otherwise(F.abs(c("close") - c("open")) / rng))
    avg = lambda x, lo_, hi_=0: F.avg(x).over(fr.rows(lo_, hi_))
    s_first, s_mean = F.lag("sma_50", 4).over(w), avg("sma_50", -4)
    slope = F.when(s_mean == 0, 0.0).otherwise((c("sma_50") - s_first) / s_mean * 100)
    adx_move = (avg("adx", -2) - avg("adx", -4, -3))
    v5, v20 = avg("volume", -4), avg("volume", -19)

    def staircase(x: str, up: bool) -> Column:
        s = F.collect_list(x).over(fr.rows(-25))
        last = F.slice(s, F.greatest(F.size(s) - 2, F.lit(1)), 3)
        pairs = F.zip_with(F.slice(last, 1, F.size(last) - 1), F.slice(last, 2, F.size(last) - 1),
                           (lambda a, b: b > a) if up else (lambda a, b: b < a))
        return (c("_rn") >= 30) & (F.size(s) >= 2) & F.forall(pairs, lambda p: p)

    narrow, now = F.min("bb_width").over(fr.rows(-4, -2)), c("bb_width")
    fr = fr.with_columns(
        trend=F.when(c("_rn") < 54, "neutral").when(slope > 0.5, "up").when(slope < -0.5, "down").otherwise("neutral"),
        adx_trend=F.when(c("_rn") < 32, "flat").when(adx_move > 2, "rising").when(adx_move < -2, "falling").otherwise("flat"),
        vs_sma50=half_up(F.coalesce(safe_div(c("close") - c("sma_50"), c("sma_50"), 0.0), F.lit(0.0)) * 100, 2),
        vs_sma200=half_up(F.coalesce(safe_div(c("close") - c("sma_200"), c("sma_200"), 0.0), F.lit(0.0)) * 100, 2),
        vol_trend=F.when((c("_rn") < 20) | (v20 == 0), "stable").when(v5 / v20 > 1.2, "increasing")
        .when(v5 / v20 < 0.8, "decreasing").otherwise("stable"),
        vol_spike=(c("_rn") >= 20) & (v20 > 0) & (v5 / v20 > 1.5),
        squeeze=F.coalesce(now, F.lit(0.0)) < 0.03,
        release=(c("_rn") >= 24) & (narrow < 0.03) & (now > 0.045),
        higher_highs=staircase("sw_h", True), lower_lows=staircase("sw_l", False), body_ratio=avg("body", -19),
        norm_atr=F.when(c("close") == 0, 0.0).otherwise(F.coalesce("atr", F.lit(0.0)) / F.abs("close") * 100))
    keep = [*series.key, *series.order, "close", "atr", "adx", "rsi", "bb_width", "ret", "step", "cross", "trend", "adx_trend",
            "vs_sma50", "vs_sma200", "vol_trend", "vol_spike", "squeeze", "release", "higher_highs", "lower_lows", "body_ratio",
            "norm_atr"]
    rows = cut(fr.body().select(*keep))
    r = c("ret")
    run = {"n1": ("sum", F.when(r.isNotNull(), 1).otherwise(0)), "s1": ("sum", r), "s2": ("sum", r * r), "path": ("sum", c("step")),
           "crosses": ("sum", c("cross")), "hi": ("max", c("close")), "lo": ("min", c("close"))}
    first_key = F.struct(*series.order)
    first = rows.groupBy(*series.key).agg(F.min_by("close", first_key).alias("first_close"))
    fr = framed(rows, series, carry=run)
    fr = fr.with_columns(**{f"x_{k}": fr.running(k, kind, e) for k, (kind, e) in run.items()})
    out = fr.body(keep_rn=True).withColumnsRenamed({"_rn": "rn", "_n": "n"}).join(first, list(series.key))
    n1 = c("x_n1")
    out = cut(out)
    var = (c("x_s2") - c("x_s1") * c("x_s1") / n1) / (n1 - 1)
    span, net = c("x_hi") - c("x_lo"), F.abs(c("close") - c("first_close"))
    return (out.withColumn("ret_sd", F.when(n1 > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0))
            .withColumn("net_dir", F.when(span == 0, 0.0).otherwise(net / span))
            .withColumn("path_ratio", F.when(net < 0.001, 100.0).otherwise(c("x_path") / net))
            .withColumn("crosses", c("x_crosses")).withColumn("adx", F.coalesce("adx", F.lit(0.0)))
            .withColumn("rsi", F.coalesce("rsi", F.lit(50.0))).withColumn("bb_width", F.coalesce("bb_width", F.lit(0.0)))
            .drop("ret", "step", "cross", "first_close", *[f"x_{k}" for k in run]))


def with_vol_percentile(feats: DataFrame, picked: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Share (in %) of the ATR values of each picked prefix below its last one; 50 under ten values.

    Picked rows are few per series; they travel as one array to the rows of their series.
    """
    key = list(series.key)
    marks = picked.groupBy(*key).agg(F.collect_list(F.struct("rn", "atr")).alias("_p"))
    e = feats.filter("atr IS NOT NULL").select(*key, F.col("rn").alias("j"), F.col("atr").alias("aj")).join(marks, key)
    e = e.withColumn("m", F.explode(F.filter("_p", lambda p: p.rn >= F.col("j"))))
    g = e.groupBy(*key, F.col("m.rn").alias("rn")).agg(
        F.count(F.lit(1)).alias("_c"), F.sum(F.when(F.col("aj") < F.col("m.atr"), 1).otherwise(0)).alias("_b"))
    pct = F.when(F.coalesce("_c", F.lit(0)) < 10, 50.0).otherwise(half_up(F.col("_b") / F.col("_c") * 100, 0))
    return picked.join(g, [*key, "rn"], "left").withColumn("vol_pct", pct).drop("_c", "_b")


def _sum(*parts: Column) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def _first(*steps: tuple[Column, float]) -> Column:
    """Points of the first condition that holds, else 0."""
    out = F.when(steps[0][0], steps[0][1])
    for cond, pts in steps[1:]:
        out = out.when(cond, pts)
    return out.otherwise(0.0)


def with_scores(f: DataFrame) -> DataFrame:
    """Six scores in [0, 1] from fixed ladders of points and damping factors."""
    c = F.col
    sd, na, pr = c("ret_sd"), c("norm_atr"), c("path_ratio")
    damp = lambda x, *steps: x * F.coalesce(_first_factor(*steps), F.lit(1.0))

    def trend(side: str) -> Column:
        up = side == "up"
        vs, stair = c("vs_sma50") if up else -c("vs_sma50"), c("higher_highs") if up else c("lower_lows")
        zone = (c("rsi") > 55) & (c("rsi") < 80) if up else (c("rsi") < 45) & (c("rsi") > 20)
        x = _sum(_first(((c("net_dir") > 0.6) & (c("trend") == side), 0.3), (c("trend") == side, 0.15)), _first((c("adx") > 25, 0.2)),
                 _first((vs > 2, 0.15), (vs > 0, 0.05)), _first((stair, 0.15)), _first((zone, 0.1)))
        x = damp(x, (c("net_dir") < 0.3, 0.5))
        x = damp(x, (sd > 0.05, 0.3), (na > 6, 0.5))
        return damp(x, (pr > 8, 0.5))

    rng = _sum(_first((pr > 10, 0.3), (pr > 5, 0.2), (pr > 3, 0.1)), _first((c("crosses") > 10, 0.2), (c("crosses") > 5, 0.1)),
               _first((c("adx") < 20, 0.15)), _first((~c("higher_highs") & ~c("lower_lows"), 0.1)), _first((c("trend") == "neutral", 0.1)),
               _first(((na > 0.3) & (na < 8), 0.1)))
    rng = damp(damp(damp(rng, (pr < 2, 0.3)), (sd > 0.08, 0.3), (sd > 0.05, 0.6)), (sd < 0.002, 0.5))
    vol = damp(_sum(_first((sd > 0.12, 0.4), (sd > 0.06, 0.25), (sd > 0.03, 0.15)), _first((na > 15, 0.3), (na > 8, 0.2), (na > 4, 0.1)),
                    _first((c("bb_width") > 0.08, 0.1)), _first((c("body_ratio") > 0.6, 0.1))), (na < 2, 0.3))
    quiet = damp(_sum(_first((sd < 0.002, 0.35), (sd < 0.005, 0.25), (sd < 0.01, 0.1)), _first((na < 0.2, 0.25), (na < 0.5, 0.15)),
                      _first((c("bb_width") < 0.03, 0.15)), _first((c("body_ratio") < 0.35, 0.1)), _first((c("adx") < 15, 0.1))),
                 (na > 1, 0.3))
    brk = _sum(_first((c("release"), 0.3)), _first((c("vol_spike"), 0.25)), _first((c("adx_trend") == "rising", 0.2)),
               _first(((c("vol_pct") > 60) & (c("vol_pct") < 90), 0.15)), _first((c("body_ratio") > 0.6, 0.1)))
    scores = dict(zip(REGIMES, (trend("up"), trend("down"), rng, vol, quiet, brk)))
    for k, e in scores.items():
        f = f.withColumn(f"s_{k}", F.least(F.lit(1.0), e))
    return f


def _first_factor(*steps: tuple[Column, float]) -> Column:
    out = F.when(steps[0][0], steps[0][1])
    for cond, k in steps[1:]:
        out = out.when(cond, k)
    return out


def decide(f: DataFrame) -> DataFrame:
    """Winner (first maximum), confidence and rounded scores."""
    cols = [F.col(f"s_{k}") for k in REGIMES]
    top = F.greatest(*cols)
    win = F.when(cols[0] == top, REGIMES[0])
    for k, x in zip(REGIMES[1:], cols[1:]):
        win = win.when(x == top, k)
    ordered = F.sort_array(F.array(*cols), asc=False)
    f = f.withColumn("regime", win).withColumn("confidence", half_up(clamp(top * 0.7 + (top - F.get(ordered, F.lit(1))) * 0.6), 3))
    for k in REGIMES:
        f = f.withColumn(f"s_{k}", half_up(F.col(f"s_{k}"), 3))
    return f


def snapshot(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Features of the whole series, one row each."""
    f = features(bars, series)
    return with_vol_percentile(f, f.filter("rn = n"), series).withColumn(
        "rsi_zone", F.when(F.col("rsi") < 30, "oversold").when(F.col("rsi") > 70, "overbought").otherwise("neutral"))


def regime_scores(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    return with_scores(snapshot(bars, series))


def detect(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Regime per series; below 20 bars the default is ranging with confidence 0."""
    d = decide(regime_scores(bars, series))
    short = F.col("n") < 20
    return d.withColumn("regime", F.when(short, "ranging").otherwise(F.col("regime"))).withColumn(
        "confidence", F.when(short, 0.0).otherwise(F.col("confidence")))


def sampled(bars: DataFrame, span: int, step: int, series: Series = BAR_SERIES) -> DataFrame:
    """Regime of the prefixes max(50, n - span), +step, ... up to n."""
    f = features(bars, series)
    start = F.greatest(F.lit(50), F.col("n") - span)
    picked = f.filter((F.col("rn") >= start) & ((F.col("rn") - start) % step == 0))
    return decide(with_scores(with_vol_percentile(f, picked, series)))


def transitions(bars: DataFrame, step: int = 10, span: int = 200, series: Series = BAR_SERIES) -> DataFrame:
    """Regime changes between sampled prefixes, stamped with the bar that follows the prefix."""
    key = list(series.key)
    s = sampled(bars, span, step, series).filter("n >= 60").select(*key, "rn", "n", "regime")
    prev = s.select(*key, (F.col("rn") + step).alias("rn"), F.col("regime").alias("from_regime"))
    t = s.join(prev, [*key, "rn"]).filter("from_regime <> regime").withColumn("at", F.least(F.col("rn") + 1, F.col("n")))
    stamps = framed(bars.select(*key, *series.order), series).body(keep_rn=True).select(*key, F.col("_rn").alias("at"), *series.order)
    return t.join(stamps, [*key, "at"]).select(*key, "from_regime", F.col("regime").alias("to_regime"), *series.order,
                                               (F.col("n") - F.col("at") + 1).alias("bars_ago"))


def scan_changes(bars: DataFrame, within: int, step: int = 10, series: Series = BAR_SERIES) -> DataFrame:
    """Series whose regime changed within the last bars, with the latest change."""
    t = transitions(bars, step, 200, series).filter(F.col("bars_ago") <= within)
    return t.groupBy(*series.key).agg(F.count(F.lit(1)).alias("n_changes"), F.min("bars_ago").alias("bars_ago"),
                                      F.min_by("to_regime", "bars_ago").alias("regime"))


def history(bars: DataFrame, step: int = 10, span: int = 300, series: Series = BAR_SERIES) -> DataFrame:
    """Segments of equal regime over the sampled prefixes; confidence is the running pairwise mean."""
    key = list(series.key)
    s = sampled(bars, span, step, series).select(*key, "rn", "n", "regime", "confidence")
    # at most span/step + 1 samples per series
    arr = s.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rn", "regime", "confidence"))).alias("a"))
    start = F.array().cast("array<struct<regime:string,confidence:double,start:bigint>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        same = (F.size(acc) > 0) & (last.regime == x.regime)
        grown = F.struct(x.regime.alias("regime"), ((last.confidence + x.confidence) / 2).alias("confidence"),
                         last.start.alias("start"))
        new = F.struct(x.regime.alias("regime"), x.confidence.alias("confidence"), x.rn.alias("start"))
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(
            F.concat(acc, F.array(new)))

    segs = arr.withColumn("g", F.aggregate("a", start, add)).join(s.groupBy(*key).agg(F.max("n").alias("n")), key)
    e = segs.select(*key, "n", "g", F.posexplode("g").alias("seg", "s"))
    # a segment ends where the next one starts, the last one at the last bar
    end = F.coalesce(F.get("g", F.col("seg") + 1)["start"], F.col("n"))
    return e.select(*key, "seg", "s.regime", "s.confidence", "s.start", end.alias("end"),
                    (end - F.col("s.start")).alias("duration"))


def match(bars: DataFrame, tolerance: str = "moderate", series: Series = BAR_SERIES) -> DataFrame:
    """Strategies, sizing and risk level of each series' regime, shifted by risk tolerance."""
    risk = F.create_map(*[x for k, v in PLAYBOOK.items() for x in (F.lit(k), F.lit(v[1]))])
    size = F.create_map(*[x for k, v in PLAYBOOK.items() for x in (F.lit(k), F.lit(v[2]))])
    plan = F.create_map(*[x for k, v in PLAYBOOK.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v[0]]))])
    d = detect(bars, series).select(*series.key, "regime", "confidence")
    r, s = risk[F.col("regime")], size[F.col("regime")]
    if tolerance == "conservative":
        s = F.when(s == "full", "reduced").when(s == "reduced", "minimal").otherwise(s)
        r = F.when(r == "medium", "high").otherwise(r)
    elif tolerance == "aggressive":
        s = F.when(s == "minimal", "reduced").when(s == "reduced", "full").otherwise(s)
        r = F.when(r == "medium", "low").otherwise(r)
    return d.withColumn("risk_level", r).withColumn("sizing", s).withColumn("strategies", plan[F.col("regime")])

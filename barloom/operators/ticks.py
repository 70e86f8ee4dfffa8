"""Trade stream analytics: order flow and microstructure per symbol, over whole tick tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clamp, half_up, safe_div, signed
from ..plans.blocks import Series, framed, islands, tail
from ..plans.rank import at_ranks, ranked
from ..sources.views import TICK_SERIES

KEY = ("symbol",)


def _vol(side: str) -> Column:
    return F.sum(F.when(F.col("side") == side, F.col("volume")).otherwise(0.0))


def _label(x: Column, hi: tuple[float, str], lo: tuple[float, str], mid: str) -> Column:
    return F.when(x > hi[0], hi[1]).when(x < lo[0], lo[1]).otherwise(mid)


def footprint(ticks: DataFrame, tick_size: float, key=KEY) -> DataFrame:
    """Volume per price bucket: buys lift the ask, sells hit the bid; flags the busiest bucket."""
    b = ticks.withColumn("level", F.floor(F.col("price") / tick_size + 0.5))
    g = b.groupBy(*key, "level").agg(_vol("buy").alias("ask_volume"), _vol("sell").alias("bid_volume"))
    total, delta = F.col("ask_volume") + F.col("bid_volume"), F.col("ask_volume") - F.col("bid_volume")
    g = (g.withColumn("price", F.col("level") * tick_size).withColumn("delta", delta)
         .withColumn("total_volume", total).withColumn("imbalance", safe_div(delta, total, 0.0)))
    top = g.groupBy(*key).agg(F.max_by("level", F.struct("total_volume", -F.col("level"))).alias("_t"))
    return g.join(top, list(key)).withColumn("poc", F.col("level") == F.col("_t")).drop("_t")


def absorption(ticks: DataFrame, book: DataFrame, min_trades: int = 10, threshold: float = 2.0,
               key=KEY) -> DataFrame:
    """Prices where much volume traded against resting size. ``book`` has price, bid_qty, ask_qty."""
    stats = ticks.groupBy(*key).agg(F.avg("volume").alias("_m"),
                                    F.coalesce(F.stddev_samp("volume"), F.lit(0.0)).alias("_s"))
    g = ticks.groupBy(*key, "price").agg(F.sum("volume").alias("absorbed_volume"),
                                         F.count(F.lit(1)).alias("n_trades"), F.max("ts").alias("ts"))
    j = g.filter(F.col("n_trades") >= min_trades).join(stats, list(key)).join(book, [*key, "price"])
    bid, ask = F.coalesce("bid_qty", F.lit(0.0)), F.coalesce("ask_qty", F.lit(0.0))
    j = j.filter((F.col("absorbed_volume") > F.col("_m") + threshold * F.col("_s")) & (F.greatest(bid, ask) > 0))
    return j.select(*key, "price", "absorbed_volume", "n_trades", "ts",
                    F.when(bid >= ask, "bid").otherwise("ask").alias("side"),
                    F.least(F.col("absorbed_volume") / (F.col("_m") * min_trades), F.lit(5.0)).alias("strength"))


def absorption_summary(found: DataFrame, key=KEY) -> DataFrame:
    v = F.col("absorbed_volume")
    share = F.sum(F.when(F.col("side") == "bid", v).otherwise(0.0)) / F.sum(v)
    return found.groupBy(*key).agg(F.sum(v).alias("total_absorbed"), F.when(share > 0.6, "buyers").when(
        share < 0.4, "sellers").otherwise("balanced").alias("dominant_side"))


def iceberg(ticks: DataFrame, min_repeat: int = 3, price_tolerance: float = 0.001, gap_seconds: float = 60,
            series: Series = TICK_SERIES) -> DataFrame:
    """Runs of same-side fills in one logarithmic price band with no gap above the tolerance."""
    t = ticks.withColumn("band", F.floor(F.ln("price") / price_tolerance))
    s = series.with_key("side", "band")
    fr = framed(t, s, lookback=1)
    prev = F.lag("ts").over(fr.w)
    gap = F.unix_micros("ts") - F.unix_micros(prev)
    t = fr.with_columns(_new=F.when(prev.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)).body()
    fr = framed(t, s, carry={"r": ("sum", F.col("_new"))})
    t = fr.with_columns(run=fr.running("r", "sum", F.col("_new"))).body()
    g = t.groupBy(*s.key, "run").agg(
        F.min_by("price", F.struct(*s.order)).alias("price"), F.count(F.lit(1)).alias("fill_count"),
        F.avg("volume").alias("avg_fill"), F.coalesce(F.stddev_samp("volume"), F.lit(0.0)).alias("_s"),
        F.min("ts").alias("first_ts")).filter(F.col("fill_count") >= min_repeat)
    cv = F.when(F.col("avg_fill") > 0, F.col("_s") / F.col("avg_fill")).otherwise(1.0)
    return g.withColumn("confidence", clamp(1 - cv)).filter("confidence > 0.3").withColumn(
        "estimated_size", F.col("avg_fill") * F.col("fill_count")).drop("_s", "run", "band")


def aggressive_passive(ticks: DataFrame, last_n: int | None = None, series: Series = TICK_SERIES) -> DataFrame:
    t = tail(ticks, series, last_n).df if last_n else ticks
    v, mk, buy = F.col("volume"), F.col("is_maker"), F.col("side") == "buy"
    part = lambda c: F.sum(F.when(c, v).otherwise(0.0))
    g = t.groupBy(*series.key).agg(part(~mk & buy).alias("aggressive_buy"), part(~mk & ~buy).alias("aggressive_sell"),
                                   part(mk & buy).alias("passive_buy"), part(mk & ~buy).alias("passive_sell"))
    names = ("aggressive_buy", "aggressive_sell", "passive_buy", "passive_sell")
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    # Labels in the order they are tested.
    labels = ("aggressive_buying", "aggressive_selling", "passive_accumulation", "passive_distribution")
    sig = F.when(total == 0, "balanced")
    for n, label in zip(names, labels):
        sig = sig.when(F.col(n) / total > 0.35, label)
    agg = F.col("aggressive_buy") + F.col("aggressive_sell")
    return (g.withColumn("aggressive_ratio", safe_div(agg, total, 0.0))
            .withColumn("net_aggressive", F.col("aggressive_buy") - F.col("aggressive_sell"))
            .withColumn("signal", sig.otherwise("balanced")))


def volume_clock(ticks: DataFrame, bucket_ms: int = 60_000, lookback: int = 20, key=KEY) -> DataFrame:
    """Volume per time bucket (empty ones absent): last against the mean of the last 20."""
    us = bucket_ms * 1000
    b = ticks.groupBy(*key, F.floor(F.unix_micros("ts") / us).alias("bucket")).agg(
        F.sum("volume").alias("rate"), F.max(F.unix_micros("ts")).alias("_t"))
    t = tail(b, Series(tuple(key), ("bucket",), lambda: F.floor(F.col("bucket") / 10_000)), lookback).df
    back = F.col("_n") - F.col("_rn")
    cur = F.max(F.when(back == 0, F.col("rate"))).over(Window.partitionBy(*key))
    t = t.withColumn("_cur", cur)
    g = t.groupBy(*key).agg(
        F.max("_cur").alias("current_rate"), F.avg("rate").alias("average_rate"),
        F.max(F.when(back == 1, F.col("rate"))).alias("_prev"),
        F.avg(F.when(F.col("rate") <= F.col("_cur"), 1.0).otherwise(0.0)).alias("percentile"),
        ((F.max("bucket") + 1) * us - F.max("_t")).alias("_left"))
    acc = F.when(F.coalesce("_prev", F.lit(0.0)) == 0, 0.0).otherwise(
        (F.col("current_rate") - F.col("_prev")) / F.col("_prev"))
    return g.withColumn("acceleration", acc).withColumn("ms_to_next", F.col("_left") / 1000.0).withColumn(
        "regime", _label(F.col("percentile"), (0.75, "fast"), (0.25, "slow"), "normal")).drop("_prev", "_left")


def imbalance_profile(ticks: DataFrame, levels: int, key=KEY) -> DataFrame:
    """Buy/sell imbalance in equal price bins, empty bins included."""
    key = list(key)
    lim = ticks.groupBy(*key).agg(F.min("price").alias("_lo"), F.max("price").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / levels
    one = F.col("_hi") == F.col("_lo")
    idx = F.when(one, 0).otherwise(F.least(F.floor((F.col("price") - F.col("_lo")) / step), F.lit(levels - 1)))
    got = ticks.join(lim, key).withColumn("level", idx.cast("long")).groupBy(*key, "level").agg(
        _vol("buy").alias("buy_volume"), _vol("sell").alias("sell_volume"))
    dense = lim.withColumn("level", F.explode(F.sequence(
        F.lit(0).cast("long"), F.when(one, F.lit(0)).otherwise(F.lit(levels - 1)).cast("long"))))
    p = dense.join(got, [*key, "level"], "left").na.fill(0.0, ["buy_volume", "sell_volume"])
    total = F.col("buy_volume") + F.col("sell_volume")
    p = p.withColumn("price", F.when(one, F.col("_lo")).otherwise(F.col("_lo") + step * (F.col("level") + 0.5)))
    p = p.withColumn("imbalance", safe_div(F.col("buy_volume") - F.col("sell_volume"), total, 0.0))
    strong = (F.abs("imbalance") > 0.3) & (total > 0)
    return p.withColumn("significant", strong).withColumn("kind", F.when(strong, F.when(
        F.col("imbalance") > 0, "support").otherwise("resistance"))).drop("_lo", "_hi")


def delta_profile(bars: DataFrame, series: Series) -> DataFrame:
    """Bar delta, cumulative delta, divergence over two rows and exhaustion. Needs buy/sell volume."""
    d = bars.withColumn("delta", F.col("buy_volume") - F.col("sell_volume"))
    fr = framed(d, series, lookback=6, carry={"d": ("sum", F.col("delta"))})
    # the change of the running delta over two rows is the sum of the last two deltas
    two = F.sum("delta").over(fr.rows(-1))
    price_up = (F.col("close") - F.lag("close", 2).over(fr.w)) >= 0
    avg5 = F.avg("volume").over(fr.rows(-5, -1))
    rng, prev_rng = F.col("high") - F.col("low"), F.lag(F.col("high") - F.col("low")).over(fr.w)
    worn = (F.col("_rn") > 3) & (F.col("volume") > 1.5 * avg5) & (prev_rng > 0) & (rng < 0.5 * prev_rng)
    later = F.col("_rn") > 2
    return fr.with_columns(
        cum_delta=fr.running("d", "sum", F.col("delta")),
        divergence=F.when(later & price_up & (two < 0), "bearish").when(later & ~price_up & (two >= 0), "bullish"),
        exhaustion=F.when(worn & (F.col("delta") > 0), "buying_exhaustion")
        .when(worn & (F.col("delta") < 0), "selling_exhaustion")).body()


def large_trades(ticks: DataFrame, method: str = "stddev", threshold: float = 2.0, key=KEY) -> DataFrame:
    """Trades at or above the cutoff with their z-score."""
    key = list(key)
    stats = ticks.groupBy(*key).agg(F.avg("volume").alias("_m"),
                                    F.coalesce(F.stddev_samp("volume"), F.lit(0.0)).alias("_s"))
    if method == "percentile":
        cut = at_ranks(ticks, key, "volume", {"cutoff": lambda n: F.least(F.floor(n * (threshold / 100)), n - 1)})
        stats = stats.join(cut.drop("n"), key)
    else:
        stats = stats.withColumn("cutoff", F.lit(float(threshold)) if method == "fixed"
                                 else F.col("_m") + threshold * F.col("_s"))
    j = ticks.join(stats, key).filter("volume >= cutoff")
    return j.withColumn("z", safe_div(F.col("volume") - F.col("_m"), F.col("_s"), 0.0)).drop("_m", "_s")


def whale_activity(ticks: DataFrame, large: DataFrame, key=KEY) -> DataFrame:
    key = list(key)
    g = large.groupBy(*key).agg(F.count(F.lit(1)).alias("n_large"), F.sum("volume").alias("large_volume"),
                                F.sum(signed(F.col("side"), F.col("volume"))).alias("net_large_flow"),
                                _vol("buy").alias("_b"))
    g = ticks.groupBy(*key).agg(F.sum("volume").alias("_v")).join(g, key, "left").na.fill(0)
    share = F.col("_b") / F.col("large_volume")
    return g.withColumn("large_ratio", safe_div(F.col("large_volume"), F.col("_v"), 0.0)).withColumn(
        "activity", F.when(F.col("large_volume") == 0, "quiet").otherwise(
            _label(share, (0.65, "heavy_buying"), (0.35, "heavy_selling"), "mixed"))).drop("_b", "_v")


def intensity_cells(ticks: DataFrame, time_ms: int = 60_000, price_step: float = 1.0, key=KEY) -> DataFrame:
    """Volume and trade count per time slot and price level, intensity against the busiest cell, hotspots."""
    us = time_ms * 1000
    c = ticks.groupBy(*key, F.floor(F.unix_micros("ts") / us).alias("slot"),
                      F.floor(F.col("price") / price_step + 0.5).alias("level")).agg(
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_trades"))
    top = c.groupBy(*key).agg(F.max("volume").alias("_mx"))
    c = c.join(top, list(key)).withColumn("intensity", safe_div(F.col("volume"), F.col("_mx"), 0.0)).drop("_mx")
    r = ranked(c, F.col("volume"), key, ties=("slot", "level"), descending=True)
    return r.withColumn("hotspot", F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n_ranked") * 0.1)))


def quiet_periods(cells: DataFrame, key=KEY, share: float = 0.25) -> DataFrame:
    """Runs of traded slots with at most a quarter of the mean slot volume, up to the next busy slot."""
    key = list(key)
    s = cells.groupBy(*key, "slot").agg(F.sum("volume").alias("v"))
    s = s.join(s.groupBy(*key).agg(F.avg("v").alias("_m")), key).withColumn(
        "quiet", F.col("v") <= share * F.col("_m"))
    ser = Series(tuple(key), ("slot",), lambda: F.floor(F.col("slot") / 10_000))
    runs = islands(s, ser, "quiet")
    g = runs.groupBy(*key, "run_id").agg(F.first("quiet").alias("quiet"), F.min("slot").alias("start"),
                                         F.max("slot").alias("_end"))
    nxt = g.select(*key, (F.col("run_id") - 1).alias("run_id"), F.col("start").alias("end"))
    return g.filter("quiet").join(nxt, [*key, "run_id"], "left").select(
        *key, "start", F.coalesce("end", F.col("_end") + 1).alias("end"))


def tick_side(ticks: DataFrame, series: Series = TICK_SERIES) -> DataFrame:
    """Fill missing sides by the last price change; a flat or first trade counts as a buy."""
    fr = framed(ticks, series, lookback=1)
    d = F.col("price") - F.lag("price").over(fr.w)
    return fr.with_columns(side=F.coalesce("side", F.when(d < 0, "sell").otherwise("buy"))).body()


def vpin_buckets(ticks: DataFrame, bucket: float, series: Series = TICK_SERIES) -> DataFrame:
    """Full equal-volume buckets; a trade crossing a boundary is split between its buckets."""
    key = list(series.key)
    fr = framed(ticks, series, carry={"v": ("sum", F.col("volume"))})
    t = fr.with_columns(_end=fr.running("v", "sum", F.col("volume"))).body()
    t = t.filter("volume > 0").withColumn("_start", F.col("_end") - F.col("volume"))
    last = F.ceil(F.col("_end") / bucket) - 1
    e = t.select(*key, "side", "_start", "_end", F.explode(F.sequence(
        F.floor(F.col("_start") / bucket), last)).alias("bucket"))
    part = F.least(F.col("_end"), (F.col("bucket") + 1) * bucket) - F.greatest(F.col("_start"), F.col("bucket") * bucket)
    e = e.withColumn("volume", part)
    total = t.groupBy(*key).agg(F.max("_end").alias("_total"))
    g = e.groupBy(*key, "bucket").agg(_vol("buy").alias("buy_volume"), _vol("sell").alias("sell_volume"))
    g = g.join(total, key).filter((F.col("bucket") + 1) * bucket <= F.col("_total")).drop("_total")
    return g.withColumn("imbalance", F.abs(F.col("buy_volume") - F.col("sell_volume"))
                        / (F.col("buy_volume") + F.col("sell_volume")))


def vpin(ticks: DataFrame, bucket: float, series: Series = TICK_SERIES) -> DataFrame:
    g = vpin_buckets(ticks, bucket, series).groupBy(*series.key).agg(
        F.count(F.lit(1)).alias("n_buckets"), F.avg("imbalance").alias("vpin"))
    return g.withColumn("toxicity", F.when(F.col("vpin") > 0.7, "high").when(F.col("vpin") > 0.4, "medium")
                        .otherwise("low"))


def kyle_lambda(ticks: DataFrame, last_n: int | None = None, series: Series = TICK_SERIES) -> DataFrame:
    """OLS of price change on signed volume with its t-statistic."""
    fr = tail(ticks, series, last_n) if last_n else framed(ticks, series, lookback=1)
    dy = F.col("price") - F.lag("price").over(fr.w)
    d = fr.with_columns(dy=dy, dx=signed(F.col("side"), F.col("volume"))).body().filter("dy IS NOT NULL")
    g = d.groupBy(*series.key).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("dy", "dx").alias("impact"), F.regr_sxx("dy", "dx").alias("_x"),
        F.regr_syy("dy", "dx").alias("_y"), F.regr_r2("dy", "dx").alias("r_squared"))
    res = F.col("_y") * (1 - F.col("r_squared"))
    se = F.sqrt(F.greatest(res / (F.col("n") - 2), F.lit(0.0)) / F.col("_x"))
    t = F.when((F.col("n") > 2) & (se > 0), F.col("impact") / se).otherwise(0.0)
    return g.withColumn("t_stat", t).withColumn("significant", F.abs("t_stat") > 1.96).drop("_x", "_y")


def classify_trades(ticks: DataFrame, method: str = "lee-ready", series: Series = TICK_SERIES) -> DataFrame:
    """Buyer or seller initiated with a confidence; needs bid and ask on every trade."""
    px, mid = F.col("price"), (F.col("bid") + F.col("ask")) / 2
    fr = framed(ticks, series, lookback=1)
    rows = fr.with_columns(_d=px - F.lag("price").over(fr.w)).body()
    d = F.col("_d")
    if method == "bulk":
        first = F.when(px >= mid, "buy").otherwise("sell")
        return rows.withColumn("cls", F.when(d.isNull(), first).when(d >= 0, "buy").otherwise("sell")).withColumn(
            "confidence", F.when(F.abs(d) > 0, 0.7).otherwise(0.5)).drop("_d")
    if method == "tick":
        sign = F.when(d > 0, "buy").when(d < 0, "sell")
        fr = framed(rows.withColumn("_s", sign), series, carry={"s": ("last", F.col("_s"))})
        rows = fr.with_columns(_past=fr.running("s", "last", F.col("_s"))).body()
        cls = F.when(d.isNull(), F.when(px >= mid, "buy").otherwise("sell")).otherwise(
            F.coalesce("_past", F.lit("buy")))
        conf = F.when(d.isNull(), 0.5).when(d != 0, 0.85).when(F.col("_past").isNotNull(), 0.6).otherwise(0.5)
        return rows.withColumn("cls", cls).withColumn("confidence", conf).drop("_d", "_s", "_past")
    half = (F.col("ask") - F.col("bid")) / 2
    far = F.abs(px - mid) / F.when(half == 0, 1.0).otherwise(half)
    near = F.least(F.lit(0.95), 0.7 + 0.25 * F.least(F.lit(1.0), far))
    cls = F.when(px > mid, "buy").when(px < mid, "sell").when(d < 0, "sell").otherwise("buy")
    conf = F.when(px != mid, near).when(d != 0, 0.6).otherwise(0.5)
    return rows.withColumn("cls", cls).withColumn("confidence", conf).drop("_d")


def adverse_selection(ticks: DataFrame, horizons=(1, 5, 10), series: Series = TICK_SERIES) -> DataFrame:
    """Mean signed mid change after h rows relative to the mid; booked when the later row arrives."""
    fr = framed(ticks, series, lookback=max(horizons))
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    fr = fr.with_columns(_sg=sign)
    for h in horizons:
        m0 = F.lag("mid", h).over(fr.w)
        fr = fr.with_columns(**{f"c{h}": F.when(m0 > 0, F.lag("_sg", h).over(fr.w) * (F.col("mid") - m0) / m0)})
    g = fr.body().groupBy(*series.key).agg(*[
        F.coalesce(F.avg(f"c{h}"), F.lit(0.0)).alias(f"cost_{h}") for h in horizons])
    cols = [F.col(f"cost_{h}") for h in horizons]
    n = float(len(cols))
    return g.withColumn("average_cost", sum(cols[1:], cols[0]) / n).withColumn(
        "informed_pct", sum([F.when(c > 0, 1.0).otherwise(0.0) for c in cols[1:]],
                            F.when(cols[0] > 0, 1.0).otherwise(0.0)) / n)


def amihud(bars: DataFrame, series: Series, price: str = "close") -> DataFrame:
    fr = framed(bars, series, lookback=1)
    p = F.lag(price).over(fr.w)
    r = F.when(p.isNotNull(), F.when(F.col("volume") > 0, F.abs(F.col(price) / p - 1) / F.col("volume")).otherwise(0.0))
    g = fr.with_columns(_r=r).body().groupBy(*series.key).agg(F.avg("_r").alias("ratio"))
    return g.withColumn("liquidity", F.when(F.col("ratio") < 1e-9, "high").when(F.col("ratio") < 1e-6, "medium")
                        .otherwise("low"))


def spread_decomposition(ticks: DataFrame, horizon: int = 5, series: Series = TICK_SERIES) -> DataFrame:
    """Effective, realised spread and impact relative to the mid, booked ``horizon`` rows later."""
    fr = framed(ticks, series, lookback=horizon)
    at = lambda c: F.lag(c, horizon).over(fr.w)
    fr = fr.with_columns(_sg=F.when(F.col("side") == "buy", 1).otherwise(-1))
    m, p, s = at("mid"), at("price"), at("_sg")
    fr = fr.with_columns(_e=F.when(m > 0, 2 * s * (p - m) / m), _r=F.when(m > 0, 2 * s * (p - F.col("mid")) / m))
    g = fr.body().groupBy(*series.key).agg(
        F.coalesce(F.avg("_e"), F.lit(0.0)).alias("effective_spread"),
        F.coalesce(F.avg("_r"), F.lit(0.0)).alias("realized_spread"),
        F.coalesce(F.avg(F.col("_e") - F.col("_r")), F.lit(0.0)).alias("price_impact"))
    return g.withColumn("adverse_pct", F.when(F.col("effective_spread") > 0, clamp(
        F.col("price_impact") / F.col("effective_spread"))).otherwise(0.0))


def roll_spread(df: DataFrame, series: Series = TICK_SERIES, price: str = "price") -> DataFrame:
    fr = framed(df, series, lookback=2)
    fr = fr.with_columns(_d=F.col(price) - F.lag(price).over(fr.w))
    fr = fr.with_columns(_p=F.col("_d") * F.lag("_d").over(fr.w))
    g = fr.with_columns(_p=F.when(F.col("_rn") > 2, F.col("_p"))).body().groupBy(*series.key).agg(
        F.coalesce(F.avg("_p"), F.lit(0.0)).alias("serial_cov"))
    return g.withColumn("implied_spread", F.when(F.col("serial_cov") < 0, 2 * F.sqrt(-F.col("serial_cov"))).otherwise(0.0))


def pin_estimate(counts: DataFrame) -> DataFrame:
    """Closed-form informed-trading share from buys, sells and periods per key."""
    b, s, n = F.col("buys"), F.col("sells"), F.col("periods")
    eps = F.least(b, s) / n
    mu = F.greatest(b / n - eps, F.lit(0.0)) + F.greatest(s / n - eps, F.lit(0.0))
    out = counts.withColumn("eps", eps).withColumn("mu", mu)
    out = out.withColumn("alpha", F.when(b + s > 0, F.least(F.lit(1.0), F.col("mu") / ((b + s) / n))).otherwise(0.0))
    out = out.withColumn("delta", F.when(F.col("mu") > 0, F.greatest(s / n - F.col("eps"), F.lit(0.0)) / F.col("mu"))
                         .otherwise(0.5))
    num = F.col("alpha") * F.col("mu")
    return out.withColumn("pin", safe_div(num, num + 2 * F.col("eps"), 0.0))


def trade_counts(ticks: DataFrame, period: str = "hour", key=KEY) -> DataFrame:
    """Buys, sells and traded periods per key, in two mergeable steps."""
    g = ticks.groupBy(*key, F.date_trunc(period, "ts").alias("_p")).agg(
        F.sum(F.when(F.col("side") == "buy", 1).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("side") == "sell", 1).otherwise(0)).alias("s"))
    return g.groupBy(*key).agg(F.sum("b").alias("buys"), F.sum("s").alias("sells"), F.count(F.lit(1)).alias("periods"))


def info_share(pairs: DataFrame, series: Series) -> DataFrame:
    """Half variance share, half lead share of two aligned price series ``a`` and ``b``."""
    fr = framed(pairs, series, lookback=2)
    ret = lambda c: F.col(c) / F.lag(c).over(fr.w) - 1
    fr = fr.with_columns(ra=ret("a"), rb=ret("b"))
    fr = fr.with_columns(_ab=F.lag("ra").over(fr.w) * F.col("rb"), _ba=F.lag("rb").over(fr.w) * F.col("ra"))
    g = fr.body().groupBy(*series.key).agg(
        F.count("ra").alias("n"), F.coalesce(F.var_samp("ra"), F.lit(0.0)).alias("va"),
        F.coalesce(F.var_samp("rb"), F.lit(0.0)).alias("vb"),
        F.abs(F.coalesce(F.avg("_ab"), F.lit(0.0))).alias("la"), F.abs(F.coalesce(F.avg("_ba"), F.lit(0.0))).alias("lb"))
    tv, tl = F.col("va") + F.col("vb"), F.col("la") + F.col("lb")
    raw = F.when((tv == 0) & (tl == 0), 0.5).when(tv == 0, F.col("la") / tl).when(tl == 0, F.col("va") / tv) \
        .otherwise(0.5 * F.col("va") / tv + 0.5 * F.col("la") / tl)
    share = F.when(F.col("n") < 2, 0.5).otherwise(clamp(raw))
    return g.withColumn("share_a", share).withColumn("share_b", 1 - F.col("share_a")).withColumn(
        "dominant", F.when(F.col("share_a") >= F.col("share_b"), "A").otherwise("B")).drop("va", "vb", "la", "lb")


def flow_toxicity(ticks: DataFrame, window_ms: int = 60_000, key=KEY) -> DataFrame:
    """Order imbalance and arrival rate of the trades within the window before each key's last trade."""
    us = F.unix_micros("ts")
    last = ticks.groupBy(*key).agg(F.max(us).alias("_t1"))
    t = ticks.join(last, list(key)).filter(us >= F.col("_t1") - window_ms * 1000)
    g = t.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), _vol("buy").alias("_b"), _vol("sell").alias("_s"),
                            ((F.max(us) - F.min(us)) / 1000.0).alias("_ms"))
    total, net = F.col("_b") + F.col("_s"), F.col("_b") - F.col("_s")
    ms = F.when(F.col("n") > 1, F.col("_ms")).otherwise(float(window_ms))
    g = g.withColumn("flow_imbalance", safe_div(net, total, 0.0)).withColumn("toxicity", F.abs("flow_imbalance"))
    return g.withColumn("arrival_rate", F.when(ms > 0, F.col("n") / ms * 1000).otherwise(0.0)).withColumn(
        "regime", _label(F.col("toxicity"), (0.7, "toxic"), (0.2, "benign"), "normal")).drop("_b", "_s", "_ms")


def trade_flow(ticks: DataFrame, last_n: int | None = None, series: Series = TICK_SERIES) -> DataFrame:
    """Buy/sell volumes, counts, ratio, imbalance signal and trades above twice the mean size."""
    key = list(series.key)
    t = tail(ticks, series, last_n).df if last_n else ticks
    mean = t.groupBy(*key).agg((F.avg("volume") * 2).alias("_cut"))
    g = t.join(mean, key).groupBy(*key).agg(
        _vol("buy").alias("buy_volume"), _vol("sell").alias("sell_volume"),
        F.sum(F.when(F.col("side") == "buy", 1).otherwise(0)).alias("buy_count"),
        F.sum(F.when(F.col("side") == "sell", 1).otherwise(0)).alias("sell_count"),
        F.max("_cut").alias("large_cut"),
        F.sum(F.when(F.col("volume") > F.col("_cut"), 1).otherwise(0)).alias("n_large"))
    b, s = F.col("buy_volume"), F.col("sell_volume")
    imb = F.when(b + s > 0, half_up((b - s) / (b + s) * 100, 2)).otherwise(0.0)
    g = g.withColumn("ratio", F.when(s > 0, half_up(b / s, 2)).when(b == 0, 0.0)).withColumn("imbalance_pct", imb)
    i = F.col("imbalance_pct")
    return g.withColumn("signal", F.when(i > 20, "strong_buy_pressure").when(i > 5, "moderate_buy_pressure")
                        .when(i < -20, "strong_sell_pressure").when(i < -5, "moderate_sell_pressure")
                        .otherwise("neutral"))

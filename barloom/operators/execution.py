"""Execution quality and order schedules over tables of parent orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_up, safe_div
from ..plans.blocks import Series, framed, tail
from ..sources.views import BAR_SERIES
from .indicators import add_atr, add_bollinger, vol_label


def execution_quality(fills: DataFrame, mids: DataFrame | None = None, key=("order_id",)) -> DataFrame:
    """Fill vwap, mean price, slippage against a mid per key, maker and taker counts (column liquidity)."""
    key = list(key)
    cost = F.coalesce(F.col("cost"), F.col("price") * F.col("amount"))
    g = fills.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_fills"),
        half_up(safe_div(F.sum(cost), F.sum("amount"), 0.0), 2).alias("vwap"),
        half_up(F.avg("price"), 2).alias("avg_price"),
        F.sum(F.when(F.col("liquidity") == "maker", 1).otherwise(0)).alias("makers"),
        F.sum(F.when(F.col("liquidity") == "taker", 1).otherwise(0)).alias("takers"))
    if mids is None:
        return g
    return g.join(mids.select(*key, "mid"), key, "left").withColumn("slippage_bps", F.when(
        F.col("mid") > 0, half_up((F.col("vwap") - F.col("mid")) / F.col("mid") * 10000, 2)))


def schedule_twap(orders: DataFrame, slices: int) -> DataFrame:
    """Equal slices over the duration. Columns: order_id, ts, amount, price, duration_min, daily_volume."""
    o = orders.withColumn("impact_bps", F.sqrt(F.col("amount") / F.col("daily_volume")) * 100)
    step = F.col("duration_min") * 6e7 / slices
    return o.withColumn("slice", F.explode(F.sequence(F.lit(1), F.lit(slices)))).withColumn(
        "scheduled", F.timestamp_micros((F.unix_micros("ts") + (F.col("slice") - 1) * step).cast("long"))).withColumn(
        "slice_amount", F.col("amount") / slices)


def volume_curve(bars: DataFrame, slices: int, series: Series = BAR_SERIES, whole: bool = False) -> DataFrame:
    """Share of volume in ``slices`` equal groups of bars; trailing bars beyond n * size are ignored, or if ``whole`` in the last slice."""
    rows = framed(bars, series).body(keep_rn=True)
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / slices))
    at = (F.floor((F.col("_rn") - 1) / size) + 1).cast("int")
    s = rows.withColumn("slice", F.least(at, F.lit(slices)) if whole else at).filter(F.col("slice") <= slices)
    key = list(series.key)
    got = s.groupBy(*key, "slice").agg(F.sum("volume").alias("_v"))
    dense = bars.select(*key).distinct().withColumn("slice", F.explode(F.sequence(F.lit(1), F.lit(slices))))
    c = dense.join(got, [*key, "slice"], "left").withColumn("_v", F.greatest(F.coalesce("_v", F.lit(0.0)), F.lit(0.001)))
    total = c.groupBy(*key).agg(F.sum("_v").alias("_t"))
    return c.join(total, key).withColumn("weight", F.col("_v") / F.col("_t")).drop("_v", "_t")


def schedule_vwap(orders: DataFrame, bars: DataFrame, slices: int, series: Series = BAR_SERIES, whole: bool = False) -> DataFrame:
    """Slices weighted by the volume curve of the order's series (``whole``: of all its bars).

    Orders meet curves on every key column of the series that they have. Bars that differ only in the others
    (two exchanges, say) are added up per timestamp, so an order never multiplies.
    """
    on = [c for c in series.key if c in orders.columns]
    if not on:
        raise ValueError(f"orders need one of {series.key}")
    if len(on) < len(series.key):
        bars = bars.groupBy(*on, *series.order).agg(F.sum("volume").alias("volume"))
        series = Series(tuple(on), series.order, series.bucket)
    curve = volume_curve(bars, slices, series, whole).select(*on, "slice", "weight")
    step = F.col("duration_min") * 6e7 / slices
    return orders.join(curve, on).withColumn("slice_amount", F.col("amount") * F.col("weight")).withColumn(
        "scheduled", F.timestamp_micros((F.unix_micros("ts") + (F.col("slice") - 1) * step).cast("long")))


def schedule_iceberg(orders: DataFrame, clip: float) -> DataFrame:
    """Full clips and the remainder of each order."""
    full = F.floor(F.col("amount") / clip)
    rest = F.col("amount") - full * clip
    n = F.greatest(full + F.when(rest > 1e-10, 1).otherwise(0), F.lit(1))
    o = orders.withColumn("n_clips", n).withColumn("clip_no", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return o.withColumn("clip_amount", F.when(full == 0, F.col("amount")).when(F.col("clip_no") <= full, F.lit(float(clip)))
                        .otherwise(half_up(rest, 8)))


def dca_schedule(bars: DataFrame, total: float, orders: int, vol_adjust: bool = True, window: int = 10,
                 series: Series = BAR_SERIES) -> DataFrame:
    """Split a total over orders, equally or by the inverse of staggered 10-return deviations."""
    key = list(series.key)
    t = tail(bars, series, orders + 2 * window + 2)
    prev = F.lag("close").over(t.w)
    t = t.with_columns(ret=F.col("close") / prev - 1)
    nret = F.col("_n") - 1
    rows = t.df.withColumn("i", F.col("_rn") - 2)  # 0-based return index within the kept rows
    e = rows.filter("i >= 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    start = F.greatest(F.lit(0), nret - orders + F.col("k") - window + 1)
    end = F.greatest(start + window, nret - orders + F.col("k") + 1)
    sd = F.stddev_samp(F.when((F.col("i") >= start) & (F.col("i") < end), F.col("ret")))
    g = e.groupBy(*key, "k").agg(F.coalesce(sd, F.lit(0.0)).alias("_sd"), F.max("_n").alias("n_bars"),
                                 F.max_by("close", "_rn").alias("price"))
    inv = 1 / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1e-8)
    short = (F.col("n_bars") < 12) | F.lit(not vol_adjust)
    g = g.withColumn("_w", F.when(short, 1.0).otherwise(inv))
    sums = g.groupBy(*key).agg(F.sum("_w").alias("_t"))
    out = g.join(sums, key).withColumn("amount_quote", F.lit(float(total)) * F.col("_w") / F.col("_t"))
    return out.withColumn("amount_base", F.col("amount_quote") / F.col("price")).withColumn(
        "order_no", F.col("k") + 1).drop("_w", "_t", "_sd", "k")


def grid_levels(bars: DataFrame, grids: int, notional: float = 10_000.0, series: Series = BAR_SERIES) -> DataFrame:
    """Grid inside the last Bollinger band: levels, side by last price, expected trades, volatility regime."""
    key = list(series.key)
    fr = add_atr(add_bollinger(framed(bars, series, lookback=21)))
    o = F.struct(*series.order)
    g = fr.body().groupBy(*key).agg(
        F.max_by("close", o).alias("price"), F.max_by("bb_upper", o).alias("top"), F.max_by("bb_lower", o).alias("bottom"),
        F.max_by("atr", o).alias("atr"), F.avg("atr").alias("avg_atr"))
    g = g.withColumn("spacing", (F.col("top") - F.col("bottom")) / grids)
    ratio = F.when(F.col("avg_atr") > 0, F.col("atr") / F.col("avg_atr")).otherwise(1.0)
    g = g.withColumn("expected_trades", F.when(F.col("spacing") > 0, half_up(F.col("atr") / F.col("spacing"), 0))
                     .otherwise(0.0)).withColumn("regime", vol_label(ratio))
    g = g.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(grids))))
    px = F.col("bottom") + (F.col("level") - 0.5) * F.col("spacing")
    return g.withColumn("level_price", px).withColumn(
        "side", F.when(px < F.col("price"), "buy").otherwise("sell")).withColumn("amount", notional / grids / px)

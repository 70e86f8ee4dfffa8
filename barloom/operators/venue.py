"""Comparisons of venues: spreads, routing, triangular cycles, quality, fragmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import safe_div
from ..plans.rank import ranked

MARKET = ("symbol", "ts")


def cross_venue_spread(quotes: DataFrame, key=MARKET) -> DataFrame:
    """Best bid and ask venue per market and the crossed spread net of both fees."""
    best_bid = F.min_by(F.struct("venue", "bid", "fee"), F.struct(-F.col("bid"), F.col("venue")))
    best_ask = F.min_by(F.struct("venue", "ask", "fee"), F.struct("ask", "venue"))
    g = quotes.groupBy(*key).agg(F.count(F.lit(1)).alias("n_venues"), best_bid.alias("b"), best_ask.alias("a"))
    cross = F.col("b.bid") - F.col("a.ask")
    mid = (F.col("b.bid") + F.col("a.ask")) / 2
    net = F.when(cross > 0, cross - F.col("a.ask") * F.col("a.fee") - F.col("b.bid") * F.col("b.fee")).otherwise(0.0)
    return g.select(*key, "n_venues", F.col("b.venue").alias("bid_venue"), F.col("b.bid").alias("best_bid"),
                    F.col("a.venue").alias("ask_venue"), F.col("a.ask").alias("best_ask"), cross.alias("cross_spread"),
                    safe_div(cross * 100, mid, 0.0).alias("cross_pct"), (net > 0).alias("arbitrage"),
                    F.greatest(net, F.lit(0.0)).alias("net_profit"))


def venue_spreads(quotes: DataFrame) -> DataFrame:
    mid, spread = (F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid")
    return quotes.withColumn("mid", mid).withColumn("spread_bps", safe_div(spread * 10000, mid, 0.0)).withColumn(
        "effective_spread", spread + mid * F.col("fee") * 2)


def arbitrage(quotes: DataFrame, fee: float = 0.001, key=MARKET) -> DataFrame:
    """Best bid against best ask over at least two venues with one fee a side."""
    g = cross_venue_spread(quotes.withColumn("fee", F.lit(fee)), key).filter("n_venues >= 2")
    gross = F.col("cross_spread") / F.col("best_ask") * 100
    return g.withColumn("gross_pct", gross).withColumn("net_pct", gross - 200 * fee).withColumn(
        "profitable", F.col("net_pct") > 0)


def triangular_arb(pairs: DataFrame, key=()) -> DataFrame:
    """Profitable three-leg cycles from every start currency and in both directions.

    ``pairs`` has base, quote, venue, bid, ask, fee. Each pair becomes a sell and
    a buy edge at its best venue; cycles are two equi joins on the currency.
    """
    key = list(key)
    g = pairs.groupBy(*key, "base", "quote").agg(
        F.min_by(F.struct("venue", "bid", "fee"), F.struct(-F.col("bid"), F.col("venue"))).alias("s"),
        F.min_by(F.struct("venue", "ask", "fee"), F.struct("ask", "venue")).alias("b"))
    pair = F.concat_ws("/", "base", "quote")
    sell = F.struct(F.col("base").alias("src"), F.col("quote").alias("dst"), F.lit("sell").alias("side"),
                    F.col("s.bid").alias("price"), F.col("s.venue").alias("venue"),
                    (F.col("s.bid") * (1 - F.col("s.fee"))).alias("rate"))
    buy = F.struct(F.col("quote").alias("src"), F.col("base").alias("dst"), F.lit("buy").alias("side"),
                   F.col("b.ask").alias("price"), F.col("b.venue").alias("venue"),
                   (1 / F.col("b.ask") * (1 - F.col("b.fee"))).alias("rate"))
    e = g.select(*key, pair.alias("pair"), F.explode(F.array(sell, buy)).alias("e")).select(*key, "pair", "e.*")

    def leg(i: int) -> DataFrame:
        return e.select(*key, *[F.col(c).alias(f"{c}{i}") for c in ("src", "dst", "pair", "side", "venue", "rate")])

    j = leg(1).join(leg(2).withColumnRenamed("src2", "dst1"), [*key, "dst1"]).filter(
        (F.col("pair1") != F.col("pair2")) & (F.col("dst2") != F.col("src1")))
    j = j.join(leg(3).withColumnsRenamed({"src3": "dst2", "dst3": "src1"}), [*key, "dst2", "src1"])
    net = F.col("rate1") * F.col("rate2") * F.col("rate3") - 1
    return j.select(*key, F.concat_ws(">", "src1", "dst1", "dst2", "src1").alias("path"),
                    F.concat_ws(",", "side1", "side2", "side3").alias("sides"),
                    F.concat_ws(",", "venue1", "venue2", "venue3").alias("venues"),
                    net.alias("net_profit")).filter("net_profit > 0").orderBy(F.col("net_profit").desc(), "path")


def smart_route(quotes: DataFrame, side: str, quantity: float, key=MARKET) -> DataFrame:
    """Greedy fills by fee-adjusted price per market; rows are the fills."""
    px, qty = (F.col("ask"), F.col("ask_qty")) if side == "buy" else (F.col("bid"), F.col("bid_qty"))
    sign = 1 if side == "buy" else -1
    q = quotes.withColumn("price", px).withColumn("qty", F.coalesce(qty, F.lit(0.0)))
    q = q.withColumn("effective", F.col("price") * (1 + sign * F.col("fee")))
    w = Window.partitionBy(*key).orderBy(sign * F.col("effective"), "venue")
    before = F.coalesce(F.sum("qty").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    worst = F.last("effective").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    f = q.withColumn("fill", F.greatest(F.lit(0.0), F.least(F.col("qty"), quantity - before))).withColumn("_w", worst)
    fee = F.col("fill") * F.col("price") * F.col("fee")
    return f.filter("fill > 0").withColumn("fee_paid", fee).withColumn(
        "cost", F.col("fill") * F.col("price") + sign * fee)


def route_summary(fills: DataFrame, key=MARKET) -> DataFrame:
    q, c = F.sum("fill"), F.sum("cost")
    return fills.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_venues"), q.alias("filled"), c.alias("total_cost"), (c / q).alias("avg_price"),
        F.sum("fee_paid").alias("total_fees"), F.abs(q * F.max("_w") - c).alias("savings"))


def equal_route(quotes: DataFrame, quantity: float, key=MARKET) -> DataFrame:
    """Equal split over the venues of each market, ignoring liquidity."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return quotes.withColumn("fill", quantity / n)


def venue_quality(metrics: DataFrame) -> DataFrame:
    """Weighted score of six normalised measures, rank, strengths and weaknesses.

    Columns: venue, uptime, latency, spread, fill_rate, slippage, volume.
    """
    names = ("latency", "spread", "slippage", "volume")
    from ..plans.rank import with_row
    mx = metrics.agg(*[F.greatest(F.max(c), F.lit(1.0)).alias(f"_{c}") for c in names])
    m = with_row(metrics, mx)
    low = lambda c: 1 - F.col(c) / F.col(f"_{c}")
    s = {"uptime": F.col("uptime"), "latency": low("latency"), "spread": low("spread"), "fill": F.col("fill_rate"),
         "slippage": low("slippage"), "volume": F.col("volume") / F.col("_volume")}
    # Weights and the (good, bad) bounds with their labels.
    weights = {"uptime": 0.2, "latency": 0.2, "spread": 0.2, "fill": 0.2, "slippage": 0.1, "volume": 0.1}
    bounds = {"uptime": (0.99, "high uptime", 0.95, "low uptime"), "latency": (0.8, "low latency", 0.3, "high latency"),
              "spread": (0.8, "tight spreads", 0.3, "wide spreads"), "fill": (0.95, "high fill rate", 0.8, "low fill rate"),
              "slippage": (0.8, "low slippage", 0.3, "high slippage"),
              "volume": (0.5, "deep liquidity", 0.1, "thin liquidity")}
    score = sum((s[k] * w for k, w in list(weights.items())[1:]), s["uptime"] * weights["uptime"])
    keep = lambda cols: F.array_compact(F.array(*cols))
    m = m.withColumn("score", score)
    m = m.withColumn("strengths", keep([F.when(s[k] >= b[0], b[1]) for k, b in bounds.items()]))
    m = m.withColumn("weaknesses", keep([F.when((s[k] < b[0]) & (s[k] < b[2]), b[3]) for k, b in bounds.items()]))
    return ranked(m.drop(*[f"_{c}" for c in names]), F.col("score"), ties=("venue",), descending=True)


# Weights by urgency for spread, fee, depth, fill rate, latency.
URGENCY = {"low": (0.35, 0.30, 0.15, 0.10, 0.10), "medium": (0.25, 0.20, 0.20, 0.20, 0.15),
           "high": (0.15, 0.10, 0.15, 0.30, 0.30)}


def venue_selection(metrics: DataFrame, size: float, urgency: str = "medium", key=("symbol",)) -> DataFrame:
    """Best and second venue per market, split advice above 30 % of the depth.

    Columns: venue, spread, fee, depth, fill_rate, latency.
    """
    key = list(key)
    w = Window.partitionBy(*key)
    top = lambda c, floor: F.greatest(F.max(c).over(w), F.lit(floor))
    a, b, c, d, e = URGENCY[urgency]
    score = ((1 - F.col("spread") / top("spread", 1e-10)) * a + (1 - F.col("fee") / top("fee", 1e-10)) * b
             + F.col("depth") / top("depth", 1e-10) * c + F.col("fill_rate") * d
             + (1 - F.col("latency") / top("latency", 1.0)) * e)
    s = metrics.withColumn("score", score)
    s = s.withColumn("_k", F.row_number().over(w.orderBy(F.col("score").desc(), "venue")))
    pick = lambda k, col: F.max(F.when(F.col("_k") == k, F.col(col)))
    g = s.groupBy(*key).agg(pick(1, "venue").alias("first_venue"), pick(2, "venue").alias("second_venue"),
                            pick(1, "score").alias("score"), pick(1, "depth").alias("_d"),
                            pick(1, "spread").alias("_s"), pick(1, "fee").alias("_f"))
    slip = safe_div(F.lit(size) / F.col("_d") * F.col("_s") * F.col("_d"), F.col("_d"), 0.0)
    g = g.withColumn("expected_slippage", slip).withColumn(
        "expected_cost", size * F.col("_s") + size * F.col("_f") + F.col("expected_slippage"))
    return g.withColumn("split", (F.lit(size) > F.col("_d") * 0.3) & F.col("second_venue").isNotNull()).drop("_d", "_s", "_f")


def fragmentation(volumes: DataFrame, key=("symbol",)) -> DataFrame:
    """Herfindahl index of venue volume shares in percent. Columns: key, venue, volume."""
    key = list(key)
    share = F.col("volume") / F.sum("volume").over(Window.partitionBy(*key)) * 100
    s = volumes.withColumn("share", F.coalesce(share, F.lit(0.0)))
    g = s.groupBy(*key).agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top_share"))
    return g.withColumn("effective_venues", safe_div(F.lit(10000.0), F.col("hhi"), 0.0)).withColumn(
        "level", F.when((F.col("hhi") > 2500) | (F.col("hhi") == 0), "consolidated")
        .when(F.col("hhi") > 1500, "moderate").otherwise("fragmented"))

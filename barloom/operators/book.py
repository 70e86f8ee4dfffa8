"""Order book measures over tables of snapshots (venue, symbol, ts, side, level, price, qty).

A window here spans one side of one snapshot, which is as deep as the book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import half_up, safe_div

SNAP = ("venue", "symbol", "ts")


def best_quotes(book: DataFrame, key=SNAP) -> DataFrame:
    side = lambda s, c: F.max(F.when((F.col("side") == s) & (F.col("level") == 1), F.col(c)))
    g = book.groupBy(*key).agg(side("bid", "price").alias("best_bid"), side("ask", "price").alias("best_ask"),
                               side("bid", "qty").alias("bid_top"), side("ask", "qty").alias("ask_top"))
    return g.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)


def walk_book(book: DataFrame, amount: float, key=SNAP) -> DataFrame:
    """Fill ``amount`` level by level on each side: average price, slippage, probability, levels used."""
    past = Window.partitionBy(*key, "side").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("qty").over(past), F.lit(0.0))
    fill = F.greatest(F.lit(0.0), F.least(F.col("qty"), amount - before))
    f = book.withColumn("_f", fill)
    top = F.max(F.when(F.col("level") == 1, F.col("price")))
    g = f.groupBy(*key, "side").agg(
        F.sum("_f").alias("filled"), F.sum(F.col("_f") * F.col("price")).alias("_cost"), top.alias("best_price"),
        F.sum(F.when(F.col("_f") > 0, 1).otherwise(0)).alias("levels_used"), F.sum("qty").alias("book_depth"))
    g = g.join(best_quotes(book, key).select(*key, "mid"), list(key))
    avg = safe_div(F.col("_cost"), F.col("filled"), 0.0)
    return (g.withColumn("avg_price", avg).withColumn("fill_probability", F.least(F.col("filled") / amount, F.lit(1.0)))
            .withColumn("slippage", F.when(F.col("mid") > 0, F.abs(F.col("avg_price") - F.col("mid")) / F.col("mid")))
            .withColumn("impact_bps", F.abs(F.col("avg_price") - F.col("best_price")) / F.col("best_price") * 10000)
            .drop("_cost"))


def depth_bands(book: DataFrame, bands=(0.001, 0.005, 0.01), key=SNAP) -> DataFrame:
    """Resting size within each distance of the mid, one row per snapshot and band."""
    j = book.join(best_quotes(book, key).filter("mid is not null").select(*key, "mid"), list(key))
    far = F.abs(F.col("price") - F.col("mid")) / F.col("mid")
    inside = lambda b, s: F.sum(F.when((F.col("side") == s) & (far <= b), F.col("qty")).otherwise(0.0))
    g = j.groupBy(*key).agg(*[inside(b, s).alias(f"_{s}{i}") for i, b in enumerate(bands) for s in ("bid", "ask")])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("band"), F.col(f"_bid{i}").alias("bid_depth"),
                              F.col(f"_ask{i}").alias("ask_depth")) for i, b in enumerate(bands)])
    return g.select(*key, F.explode(rows).alias("r")).select(*key, "r.*").withColumn(
        "total", F.col("bid_depth") + F.col("ask_depth"))


def side_volume(s: str) -> Column:
    return F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0.0))


def book_imbalance(book: DataFrame, key=SNAP, depth: int | None = None) -> DataFrame:
    b = book.filter(F.col("level") <= depth) if depth else book
    g = b.groupBy(*key).agg(side_volume("bid").alias("bid_volume"), side_volume("ask").alias("ask_volume"))
    t = F.col("bid_volume") + F.col("ask_volume")
    return g.withColumn("imbalance", F.when(t > 0, half_up((F.col("bid_volume") - F.col("ask_volume")) / t, 4))
                        .otherwise(0.0))


def book_shape(book: DataFrame, key=SNAP) -> DataFrame:
    w = Window.partitionBy(*key, "side").orderBy("level")
    top = F.first("qty").over(w)
    return book.withColumn("ratio_vs_top", F.when(top != 0, half_up(F.col("qty") / top, 4))).filter(
        "ratio_vs_top is not null")


def weighted_mid(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    return F.when(total == 0, (bid + ask) / 2).otherwise((bid * ask_size + ask * bid_size) / total)


def weighted_mids(book: DataFrame, key=SNAP) -> DataFrame:
    q = best_quotes(book, key).filter("best_bid is not null and best_ask is not null")
    return q.withColumn("weighted_mid", half_up(weighted_mid(
        F.col("best_bid"), F.col("best_ask"), F.col("bid_top"), F.col("ask_top")), 2))


def microstructure_report(book: DataFrame, amount: float = 100.0, key=SNAP) -> DataFrame:
    """Spread, weighted mid, imbalance, depth within 1 % and buy/sell slippage of every snapshot."""
    q = weighted_mids(book, key).withColumn("spread_bps", (F.col("best_ask") - F.col("best_bid")) / F.col("mid") * 10000)
    d = depth_bands(book, (0.01,), key).select(*key, F.col("total").alias("depth_1pct"))
    walk = walk_book(book, amount, key).groupBy(*key).agg(
        F.max(F.when(F.col("side") == "ask", F.col("slippage"))).alias("buy_slippage"),
        F.max(F.when(F.col("side") == "bid", F.col("slippage"))).alias("sell_slippage"))
    return q.join(book_imbalance(book, key), list(key)).join(d, list(key)).join(walk, list(key))


def aggregate_books(book: DataFrame, depth: int = 10, key=("symbol", "ts")) -> DataFrame:
    """Venues merged by price: total size, size per venue, top levels per side."""
    g = book.groupBy(*key, "side", "price").agg(
        F.sum("qty").alias("qty"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("venue", "qty")))).alias("venues"))
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*key, "side").orderBy(best)
    return g.withColumn("level", F.row_number().over(w)).filter(F.col("level") <= depth)


def cross_venue_imbalance(book: DataFrame, depth: int = 10, key=("symbol", "ts")) -> DataFrame:
    """Depth-weighted imbalance over venues, pressure at .1 and divergence of venue signs."""
    b = book.filter(F.col("level") <= depth)
    v = b.groupBy(*key, "venue").agg(side_volume("bid").alias("b"), side_volume("ask").alias("a"))
    v = v.withColumn("imb", safe_div(F.col("b") - F.col("a"), F.col("b") + F.col("a"), 0.0))
    total = F.sum(F.col("b") + F.col("a"))
    agg = F.when(total == 0, 0.0).otherwise(F.sum(F.col("imb") * (F.col("b") + F.col("a"))) / total)
    g = v.groupBy(*key).agg(F.count(F.lit(1)).alias("n_venues"), agg.alias("imbalance"),
                            (F.max("imb") > 0.1).alias("_p"), (F.min("imb") < -0.1).alias("_n"))
    i = F.col("imbalance")
    return g.withColumn("pressure", F.when(i > 0.1, "buy").when(i < -0.1, "sell").otherwise("neutral")).withColumn(
        "divergence", F.col("_p") & F.col("_n")).drop("_p", "_n")

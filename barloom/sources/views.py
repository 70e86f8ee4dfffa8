"""Market-shaped views over the given star-schema tables (see SURVEY 7.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.blocks import time_series

BAR_KEY = ("symbol", "exchange", "interval")
BAR_SERIES = time_series(BAR_KEY, ("ts",), bucket_seconds=86_400)
TICK_SERIES = time_series(("symbol",), ("ts", "seq"), bucket_seconds=3600)
VENUE_SERIES = time_series(("symbol", "venue"), ("ts", "seq"), bucket_seconds=3600)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    px = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("symbol"),
        F.date_trunc("week", "l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("o"))
    return px.groupBy("symbol", "ts").agg(
        F.min_by("price", "o").alias("open"), F.max("price").alias("high"),
        F.min("price").alias("low"), F.max_by("price", "o").alias("close"),
        F.sum("qty").alias("volume"),
    ).select("symbol", F.lit("sim").alias("exchange"), F.lit("1w").alias("interval"), "ts",
             F.lit("stock").alias("asset_type"), "open", "high", "low", "close", "volume")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("symbol"),
        F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("venue"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        (F.lit(100.0) + F.col("value")).alias("price"),
        (F.lit(1.0) + F.get_json_object("props", "$.k").cast("double")).alias("volume"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        (F.col("user_id") % 3 == 0).alias("is_maker"),
        (F.lit(0.0005) * (1 + F.col("user_id") % 4)).alias("fee"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.groupBy("venue", "symbol", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min("price").alias("bid"), F.max("price").alias("ask"),
        F.sum(F.when(F.col("side") == "buy", F.col("volume"))).alias("bid_qty"),
        F.sum(F.when(F.col("side") == "sell", F.col("volume"))).alias("ask_qty"),
        F.min("fee").alias("fee"))


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly books: buys below the hour's mean price are bids, sells above it are asks.

    A price level is one price; the book of an hour is bounded by the prices
    traded in it, and levels are ranked inside (symbol, venue, hour, side).
    """
    from pyspark.sql.window import Window

    t = ticks(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    lv = t.groupBy("venue", "symbol", "ts", "price").agg(F.sum("volume").alias("qty"))
    mid = F.avg("price").over(Window.partitionBy("venue", "symbol", "ts"))
    lv = lv.withColumn("m", mid).withColumn(
        "side", F.when(F.col("price") < F.col("m"), "bid").otherwise("ask"))
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("venue", "symbol", "ts", "side").orderBy(best)
    return lv.select("venue", "symbol", "ts", "side", F.row_number().over(w).alias("level"),
                     "price", "qty")


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_returnflag").alias("exchange"), F.col("l_linestatus").alias("symbol"),
        F.when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.lit("limit").alias("type"), F.col("l_quantity").alias("amount"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_extendedprice").alias("cost"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fee"),
        F.lit("USD").alias("fee_currency"), F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("o_orderpriority").alias("strategy"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"),
        F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_nationkey").alias("account"), F.col("c_mktsegment").alias("symbol")) \
        .agg(F.sum("c_acctbal").alias("qty"), F.count(F.lit(1)).alias("n_accounts"),
             F.avg("c_acctbal").alias("avg_balance"))


def characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("symbol")).agg(
        F.sum("p_retailprice").alias("market_cap"), F.avg("p_size").alias("book_to_market"),
        F.avg(F.length("p_name")).alias("profitability"),
        F.avg(F.col("p_retailprice") / (1 + F.col("p_size"))).alias("investment"),
        F.concat(F.lit("S"), (F.count(F.lit(1)) % 3).cast("string")).alias("sector"))

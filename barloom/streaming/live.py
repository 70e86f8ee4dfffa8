"""Structured Streaming forms: second bars, latest snapshot, book view, trades, toxicity, iceberg runs.

Event time is ``ts``. Rows later than the watermark are dropped; duplicates by
(venue, seq) are dropped within it. State is bounded by the watermark or by the
last ``n`` trades kept per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

LATE = "10 seconds"


def tick_source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """File stream of Parquet ticks."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def trade_stream(ticks: DataFrame, late: str = LATE) -> DataFrame:
    """Trades with duplicates dropped within the watermark."""
    t = ticks.withWatermark("ts", late)
    return t.dropDuplicatesWithinWatermark(["venue", "seq"]) if ticks.isStreaming else t.dropDuplicates(["venue", "seq"])


def second_bars(trades: DataFrame, width: str = "1 second") -> DataFrame:
    o = F.struct("ts", "seq")
    return trades.groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", o).alias("close"), F.sum("volume").alias("volume")).select(
        "symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def toxicity_windows(trades: DataFrame, width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Sliding order-flow imbalance."""
    buy = F.sum(F.when(F.col("side") == "buy", F.col("volume")).otherwise(0.0))
    g = trades.groupBy("symbol", F.window("ts", width, slide)).agg(buy.alias("b"), F.sum("volume").alias("v"))
    return g.select("symbol", F.col("window.start").alias("ts"), F.when(F.col("v") > 0, F.abs(2 * F.col("b") - F.col("v")) / F.col("v"))
                    .otherwise(0.0).alias("toxicity"))


def iceberg_sessions(trades: DataFrame, tolerance: float = 0.001, gap: str = "60 seconds", min_fills: int = 3) -> DataFrame:
    """Runs of same-side fills in one price band, closed by a gap."""
    t = trades.withColumn("band", F.floor(F.ln("price") / tolerance))
    g = t.groupBy("symbol", "side", "band", F.session_window("ts", gap)).agg(
        F.count(F.lit(1)).alias("fills"), F.sum("volume").alias("size"), F.avg("price").alias("price"))
    return g.filter(F.col("fills") >= min_fills).select("symbol", "side", "price", "fills", "size",
                                                        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"))


def latest_snapshot(trades: DataFrame) -> DataFrame:
    """Last trade per symbol by (ts, seq); use update or complete mode."""
    last = F.max_by(F.struct("ts", "seq", "price", "volume", "side"), F.struct("ts", "seq")).alias("l")
    return trades.groupBy("symbol").agg(last, F.count(F.lit(1)).alias("n_trades")).select("symbol", "l.*", "n_trades")


def book_view(books: DataFrame, depth: int = 20) -> DataFrame:
    """Top of nested books (bids, asks: arrays of price and size, best first): mid, spread, spread bps."""
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    spread, mid = ask - bid, (ask + bid) / 2
    return books.select("symbol", "ts", F.slice("bids", 1, depth).alias("bids"), F.slice("asks", 1, depth).alias("asks"),
                        bid.alias("best_bid"), ask.alias("best_ask"), mid.alias("mid"), spread.alias("spread"),
                        F.when(mid > 0, F.floor(spread / mid * 1e6 + 0.5) / 100).alias("spread_bps"))


def last_trades(trades: DataFrame, n: int = 100) -> DataFrame:
    """The last n trades per symbol by (ts, seq); of a stream after each batch, keyed state holding only those n.

    A batch table keeps them by a row number whose limit is applied before the shuffle (``n`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``), so a busy symbol is not gathered.
    """
    if not trades.isStreaming:
        newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc(), F.col("seq").desc())
        return trades.select("symbol", "ts", "seq", "price", "volume", "side", F.row_number().over(newest).alias("_k")).filter(
            F.col("_k") <= n).drop("_k")
    fields = "ts timestamp, seq long, price double, volume double, side string"

    def keep(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["ts", "seq", "price", "volume", "side"]
        parts = [pd.DataFrame(list(state.get[0]), columns=cols)] if state.exists and len(state.get[0]) else []
        for b in batches:
            parts.append(b[cols].sort_values(["ts", "seq"]).tail(n))
        kept = pd.concat(parts).sort_values(["ts", "seq"]).tail(n)
        state.update(([tuple(r) for r in kept.itertuples(index=False)],))
        yield kept.assign(symbol=key[0])[["symbol", *cols]]

    return trades.groupBy("symbol").applyInPandasWithState(
        keep, f"symbol string, {fields}", f"kept array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>", "update",
        GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drive a stream over all available files into a memory table (tests and small jobs)."""
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def bars_to_store(bars: DataFrame, path: str, checkpoint: str):
    """Upsert finished bars per batch; a repeated batch writes the same rows again."""
    from ..operators.store import upsert_path

    def write(batch: DataFrame, _epoch: int) -> None:
        rows = batch.select("symbol", F.lit("live").alias("exchange"), F.lit("1s").alias("interval"), "ts", F.lit("crypto").alias("asset_type"),
                            "open", "high", "low", "close", "volume")
        upsert_path(rows, path)

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

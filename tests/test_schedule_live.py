"""Orders of several exchanges, and batch forms of the streaming operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barloom.operators import execution as X
from barloom.streaming import live as L


def bars(spark):
    rows = [("A", e, "1d", datetime(2024, 1, 1 + i), v) for e, vs in (("x", (1., 1., 3., 3.)), ("y", (6., 2., 4., 4.)))
            for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, exchange string, interval string, ts timestamp, volume double")


def orders(spark):
    return spark.createDataFrame([(1, "A", "x", 80.0), (2, "A", "y", 160.0)], "order_id long, symbol string, exchange string, amount double").withColumn(
        "ts", F.lit("2024-02-01").cast("timestamp")).withColumn("duration_min", F.lit(60))


def weights(df):
    return {(r.order_id, r.slice): round(r.weight, 9) for r in df.collect()}


def test_schedule_takes_the_orders_own_exchange(spark):
    got = X.schedule_vwap(orders(spark), bars(spark), 2)
    assert got.count() == 4
    assert weights(got) == {(1, 1): 0.25, (1, 2): 0.75, (2, 1): 0.5, (2, 2): 0.5}


def test_schedule_without_exchange_adds_exchanges_up(spark):
    got = X.schedule_vwap(orders(spark).drop("exchange"), bars(spark), 2)
    assert got.count() == 4
    assert weights(got) == {(k, s): round(w, 9) for k in (1, 2) for s, w in ((1, 10 / 24), (2, 14 / 24))}
    with pytest.raises(ValueError):
        X.schedule_vwap(orders(spark).drop("exchange", "symbol"), bars(spark), 2)


def test_last_trades_of_a_table_limit_before_the_shuffle(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "HOT").otherwise("B").alias("symbol"), F.timestamp_seconds(F.col("id").cast("long") % 500).alias("ts"),
                                    F.col("id").alias("seq"), F.lit(1.0).alias("price"), F.lit(2.0).alias("volume"), F.lit("buy").alias("side"))
    last = L.last_trades(rows, 5)
    want = rows.toPandas().sort_values(["ts", "seq"]).groupby("symbol").tail(5)
    assert sorted(r.seq for r in last.collect()) == sorted(want["seq"])
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString()


def test_toxicity_windows_by_hand(spark):
    rows = [("s", "2024-01-01 00:00:05", "buy", 3.0), ("s", "2024-01-01 00:00:07", "sell", 1.0), ("s", "2024-01-01 00:00:31", "sell", 2.0)]
    d = spark.createDataFrame(rows, "symbol string, ts string, side string, volume double").withColumn("ts", F.to_timestamp("ts"))
    got = {r.ts.strftime("%H:%M:%S"): r.toxicity for r in L.toxicity_windows(d).collect()}
    assert got["00:00:00"] == 0.0 and got["23:59:10"] == 0.5 and got["00:00:30"] == 1.0 and len(got) == 9

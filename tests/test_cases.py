"""Hand cases, invariants, store, plans, streaming and bootstrap."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as B
from barloom.operators import bootstrap as BS
from barloom.operators import indicators as I
from barloom.operators import pages as G
from barloom.operators import panels as P
from barloom.operators import recurrent as C
from barloom.operators import stats as S
from barloom.operators import store as ST
from barloom.operators import ticks as K
from barloom.plans.blocks import Series, time_series
from barloom.sources import views as V
from barloom.streaming import live as L
from conftest import SF

KEY = ("symbol", "exchange", "interval")
SER = time_series(KEY, ("ts",), 86_400 * 30)


@pytest.fixture(scope="module")
def ten(spark):
    pdf = pd.DataFrame({"symbol": "S", "exchange": "x", "interval": "1d", "asset_type": "stock",
                        "ts": pd.date_range("2024-01-01", periods=10), "close": np.arange(1.0, 11.0), "volume": 1.0})
    return spark.createDataFrame(pdf.assign(open=pdf.close, high=pdf.close, low=pdf.close))


def col(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_sma_and_ema(ten):
    assert [x for x in col(I.with_sma(ten, 3, series=SER), "sma_3") if x is not None] == [float(x) for x in range(2, 10)]
    e = [x for x in col(C.ema(ten, 5, series=SER), "ema_5") if x is not None]
    assert len(e) == 6 and abs(e[0] - 3) < 1e-12


def test_sizing_and_var(spark, ten):
    r = spark.range(1).select(P.kelly(F.lit(0.6), F.lit(2.0)).alias("h"), P.kelly(F.lit(0.6), F.lit(2.0), False).alias("f"),
                              P.fixed_fraction(F.lit(100000.0), 0.02, F.lit(50.0), F.lit(48.0)).alias("s")).first()
    assert abs(r.h - 0.2) < 1e-12 and abs(r.f - 0.4) < 1e-12 and abs(r.s - 1000) < 1e-9
    x = ten.withColumn("ret", F.col("close") / 100)
    v = S.value_at_risk(x, 1000.0).first()["var"]
    assert abs(v - 1000 * 1.645 * np.std(np.arange(1, 11) / 100, ddof=1)) < 1e-9


def test_latency_percentile(spark):
    d = spark.createDataFrame([("m", i, float(10 - i), False) for i in range(10)], "method string, seq long, duration_ms double, is_error boolean")
    assert S.latency_stats(d).first()["p95"] == 10.0


def test_vpin_conserves_volume(skewed):
    df, pdf = skewed
    ser = time_series(("symbol",), ("ts", "seq"), 3600)
    b = K.vpin_buckets(df, 500, ser).toPandas()
    assert np.allclose(b["buy_volume"] + b["sell_volume"], 500)
    n = pdf.groupby("symbol")["volume"].sum() // 500
    assert b.groupby("symbol").size()["HOT"] == n["HOT"]


def test_trades_alternate_and_blocks_agree(skewed):
    df, _ = skewed
    ser = time_series(KEY, ("ts", "seq"), 3600 * 6)
    runs = [("sma_crossover", {"fast": 5, "slow": 20})]
    small = B.backtest(df, runs, series=ser, block_rows=64).orderBy("symbol").toPandas()
    big = B.backtest(df, runs, series=ser).orderBy("symbol").toPandas()
    pd.testing.assert_frame_equal(small, big, rtol=1e-6)
    t = B.trades(B.simulate(B.signal_table(df, runs, ser), series=ser), series=ser).toPandas()
    assert (t["exit_ts"] >= t["entry_ts"]).all()
    for _, g in t.sort_values("entry_ts").groupby("symbol"):
        assert (g["entry_ts"].iloc[1:].to_numpy() >= g["exit_ts"].iloc[:-1].to_numpy()).all()


def test_store_upsert_is_idempotent(spark, ten):
    path = os.path.join(tempfile.mkdtemp(), "bars")
    ST.upsert_path(ten, path)
    new = ten.filter("close > 8").withColumn("close", F.col("close") * 2)
    for _ in range(2):
        ST.upsert_path(new, path)
    rows = ST.read_bars(spark, path).collect()
    got = {r.ts.day: r.close for r in rows}
    assert len(rows) == len(got) == 10 and {r.interval for r in rows} == {"1d"} and got[10] == 20.0 and got[1] == 1.0


def test_sql_guard(spark):
    with pytest.raises(ValueError):
        ST.sql(spark, "DROP TABLE x", guard=True)
    assert ST.sql(spark, "SELECT 'drop' AS a", guard=True).first().a == "drop"


def test_asset_types(spark):
    d = spark.createDataFrame([("btc-usd",), ("SPY",), ("^GSPC",), ("AAPL",)], "s string")
    assert [r.k for r in d.select(ST.detect_asset_type(F.col("s")).alias("k")).collect()] == ["crypto", "etf", "index", "stock"]


@pytest.mark.parametrize("name", ["returns_series", "bollinger", "macd", "vpin", "asof_trades_quotes", "max_pain", "backtest_metrics"])
def test_plans_have_no_cross_product_or_python(spark, name):
    from barloom import catalog

    plan = catalog.load().QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan and "Pandas" not in plan


def test_garch_prefers_true_persistence(spark):
    rng, n, v, r = np.random.default_rng(3), 1500, 1e-4, []
    for _ in range(n):
        x = rng.normal() * np.sqrt(v)
        r.append(x)
        v = 1e-5 + 0.2 * x * x + 0.7 * v
    pdf = pd.DataFrame({"symbol": "G", "exchange": "x", "interval": "1d", "ts": pd.date_range("2020-01-01", periods=n), "ret": r})
    df = spark.createDataFrame(pdf)
    one = C.garch11_fit(df, series=SER).first()
    cut = C.garch11_fit(df, series=SER, block_rows=400).first()
    assert abs(one["persistence"] - 0.9) < 0.12
    assert (one["alpha"], one["beta"]) == (cut["alpha"], cut["beta"]) and abs(one["ll"] - cut["ll"]) < 1e-6


def test_bootstrap_matches_numpy_by_tolerance(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0.001, 0.02, 400)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "S", "exchange": "x", "interval": "1d",
                                             "ts": pd.date_range("2020-01-01", periods=400), "ret": r}))
    got = BS.bootstrap_var(df, 2000, 1, series=SER).first()
    assert abs(got["var_95"] + np.quantile(r, 0.05)) < 0.006
    ci = BS.bootstrap_ci(df, "mean", 200, series=SER).first()
    assert ci["lower"] < r.mean() < ci["upper"] and abs(ci["standard_error"] - r.std() / 20) < 3e-4


def test_stream_equals_batch(spark):
    src, ck = tempfile.mkdtemp(), tempfile.mkdtemp()
    t = V.ticks(spark, SF).select("symbol", "venue", "ts", "seq", "price", "volume", "side")
    t.orderBy("ts").coalesce(1).write.mode("overwrite").parquet(src)
    live = L.tick_source(spark, src, t.schema)
    # every row twice: the copies are dropped within the watermark
    bars = L.run_once(L.second_bars(L.trade_stream(live.unionByName(live))), "sec_bars", "append", ck)
    batch = L.second_bars(L.trade_stream(t))
    late = batch.agg(F.max("ts")).first()[0] - pd.Timedelta(seconds=30)
    a = {tuple(r) for r in bars.filter(F.col("ts") < F.lit(late)).collect()}
    b = {tuple(r) for r in batch.filter(F.col("ts") < F.lit(late)).collect()}
    assert a == b and len(a) > 100
    last = L.run_once(L.last_trades(live.withWatermark("ts", "10 seconds"), 5), "last5", "update", tempfile.mkdtemp()).toPandas()
    want = t.toPandas().sort_values(["ts", "seq"]).groupby("symbol").tail(5)
    assert sorted(last["seq"]) == sorted(want["seq"])


def test_session_windows(spark):
    rows = [("s", "buy", 100.0, f"2024-01-01 00:00:{i:02d}", i, 5.0) for i in (0, 10, 20)] + [("s", "buy", 100.0, "2024-01-01 01:00:00", 9, 5.0)]
    d = spark.createDataFrame(rows, "symbol string, side string, price double, ts string, seq long, volume double").withColumn("ts", F.to_timestamp("ts"))
    got = L.iceberg_sessions(d).collect()
    assert len(got) == 1 and got[0].fills == 3


def test_feed_parsing(spark):
    xml = "<rss><item><title><![CDATA[A &amp; B]]></title><link>http://x.io/a#t</link><dc:creator>me</dc:creator><pubDate>2024-01-01</pubDate></item></rss>"
    r = G.feed_items(spark.createDataFrame([("s", xml)], "source string, xml string"), 5).first()
    assert (r.title, r.url, r.author) == ("A & B", "http://x.io/a", "me")

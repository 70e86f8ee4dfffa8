"""Rules that only show at scale or in rare rows: trimming, bucket sizes, total losses, refused input."""

import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import log_growth
from barloom.operators import backtest, signals, store
from barloom.plans.blocks import tail, time_series, value_bucket
from barloom.plans.rank import ranked

HOURS = time_series(("symbol",), ("ts",), bucket_seconds=86_400)


def hourly(spark, n, symbol="A"):
    return spark.range(n).select(F.lit(symbol).alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.col("id").alias("v"))


@pytest.mark.parametrize("n", [3, 1000, 1001, 2425])
def test_tail_keeps_the_last_rows(spark, n):
    df = hourly(spark, 4000).union(hourly(spark, 10, "B"))
    got = tail(df, HOURS, n).df
    a = got.filter("symbol = 'A'").agg(F.count("*"), F.min("v"), F.max("_rn"), F.max("_n")).first()
    assert tuple(a) == (n, 4000 - n, n, n)
    assert got.filter("symbol = 'B'").count() == min(n, 10)


def test_long_tail_is_trimmed_by_buckets_first(spark):
    df = hourly(spark, 4000).withColumn("symbol", (F.col("v") % 2).cast("string"))
    plan = tail(df, HOURS, 2425).df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    plan = tail(df, HOURS, 1000).df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_narrow_values_spread_over_buckets(spark):
    df = spark.range(200_000).select((50_000 + F.col("id") / 400).alias("x"))
    most, buckets = df.groupBy(value_bucket(F.col("x")).alias("b")).count().agg(F.max("count"), F.count("*")).first()
    assert buckets > 50 and most < 10_000
    r = ranked(df.limit(5000), F.col("x"))
    assert r.filter(F.col("rank") == 5000).first()["x"] == pytest.approx(df.limit(5000).agg(F.max("x")).first()[0])


def test_total_loss_compounds_to_zero(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 0.5), ("b", 0.5), ("b", None)], "k string, r double")
    got = dict(df.groupBy("k").agg(F.exp(F.sum(log_growth(1 + F.col("r"))))).collect())
    assert got == {"a": 0.0, "b": 1.5}


def test_true_number_of_bars(spark):
    n = signals.TAIL + 40
    x = F.col("id")
    bars = spark.range(n).select(F.lit("A").alias("symbol"), F.lit("x").alias("exchange"), F.lit("1h").alias("interval"),
                                 F.timestamp_seconds(x * 3600).alias("ts"), *[(100 + F.sin(x / 9) + d).alias(c) for c, d in
                                 (("open", 0), ("high", 1), ("low", -1), ("close", 0.1))], F.lit(5.0).alias("volume"))
    assert signals.timeframe_signals(bars).first()["n_bars"] == n


def test_refused_input(spark, tmp_path):
    with pytest.raises(ValueError):
        backtest.walk_forward_rolling(hourly(spark, 10), [], 20, 10)
    row = ("A", "x", "1d", "2024-01-01", "stock", 1.0, 1.0, 1.0, 1.0, 1.0)
    names = [f.name for f in store.BARS_SCHEMA.fields]
    twice = spark.createDataFrame([row, row[:-2] + (2.0, 1.0)], names).withColumn("ts", F.col("ts").cast("timestamp"))
    with pytest.raises(ValueError):
        store.upsert_path(twice, str(tmp_path / "bars"))


def test_common_timestamps_of_the_symbols_asked_for(spark):
    from barloom.operators.align import common_ts

    df = hourly(spark, 10).union(hourly(spark, 8, "B")).union(hourly(spark, 1, "LATE"))
    assert common_ts(df).count() == 3 and common_ts(df, symbols=["A", "B"]).count() == 16


def test_a_late_listing_empties_no_panel(spark):
    import numpy as np
    import pandas as pd

    from barloom.operators import align, bootstrap, factors, pairs, risk

    rng, hours = np.random.default_rng(4), pd.date_range("2024-01-01", periods=80, freq="h")
    pdf = pd.concat([pd.DataFrame({"symbol": s, "ts": t, "ret": rng.normal(0, 0.01, len(t)), "close": rng.uniform(90, 110, len(t))})
                     for s, t in [("A", hours), ("B", hours), ("C", hours), ("D", hours), ("LATE", hours[-1:] + pd.Timedelta("1h"))]])
    df, old = spark.createDataFrame(pdf), ["A", "B", "C", "D"]
    want = pdf[pdf.symbol != "LATE"].pivot(index="ts", columns="symbol", values="ret").cov()
    assert factors.covariance(df).count() == 0
    for rows in (factors.covariance(df, symbols=old), factors.covariance(df, pairwise=True)):
        got = {(r.a, r.b): (r["cov"], r.n) for r in rows.collect() if "LATE" not in (r.a, r.b)}
        assert len(got) == 10 and all(np.isclose(c, want.loc[a, b]) and n == 80 for (a, b), (c, n) in got.items())
    for kind in ("exponential", "shrinkage"):
        assert factors.covariance(df, kind, symbols=old).count() == 10
    size = df.groupBy("symbol").agg({"close": "avg"}).toDF("symbol", "size")
    assert factors.factor_returns_store(df, size, symbols=old).count() == 80
    assert {r.symbol for r in factors.pca(df, 2, symbols=old).collect()} == set(old)
    assert bootstrap.bootstrap_scenarios(df, 7, symbols=old).count() == 28
    assert align.rolling_correlation_matrix(df, symbols=old).count() > 0
    assert pairs.pair_stats(df, symbols=old).count() == 6
    assert {r.symbol for r in risk.risk_report(df, symbols=old).collect()} == set(old)
    assert {r.symbol for r in risk.risk_report(df, pairwise=True).collect()} >= set(old)


def test_the_whole_volume_curve_keeps_the_newest_bars(spark):
    import pandas as pd

    from barloom.operators import execution

    bars = spark.createDataFrame(pd.DataFrame({"symbol": "A", "exchange": "x", "interval": "1h", "volume": 1.0,
                                               "ts": pd.date_range("2024-01-01", periods=39, freq="h"), "seq": range(39)}))
    curve = lambda whole: [r.weight for r in execution.volume_curve(bars, 20, whole=whole).orderBy("slice").collect()]
    assert curve(False) == [1 / 20] * 20
    assert curve(True) == [1 / 39] * 19 + [20 / 39]


def test_bb_squeeze_builds_the_bandwidths_once(skewed):
    from barloom.operators import indicators

    bars, pdf = skewed
    out = indicators.bb_squeeze(bars)
    assert "InMemoryTableScan" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.symbol for r in out.collect()} == {"HOT", "A", "B"}

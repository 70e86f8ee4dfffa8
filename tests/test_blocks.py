"""Blocked plans must equal plain pandas on skewed series cut into many small blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import recurrent as C
from barloom.plans.blocks import framed, islands, tail, time_series
from barloom.plans.rank import at_ranks, linear_percentiles, ranked

KEY = ("symbol", "exchange", "interval")
SER = time_series(KEY, ("ts", "seq"), 3600 * 6)


def grouped(df, pdf, cols):
    got = df.select("symbol", "seq", *cols).toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)
    want = pdf.sort_values(["symbol", "seq"]).reset_index(drop=True)
    return got, want


def test_frame_and_running(skewed):
    df, pdf = skewed
    fr = framed(df, SER, lookback=20, block_rows=64, carry={"v": ("sum", F.col("volume")), "p": ("max", F.col("price"))})
    fr = fr.with_columns(sma=F.when(F.col("_rn") >= 20, F.avg("close").over(fr.rows(-19))), lag7=F.lag("close", 7).over(fr.w),
                         cum=fr.running("v", "sum", F.col("volume")), peak=fr.running("p", "max", F.col("price")), rn=F.col("_rn"))
    got, want = grouped(fr.body(), pdf, ["sma", "lag7", "cum", "peak", "rn"])
    assert len(got) == len(want)
    g = want.groupby("symbol")
    np.testing.assert_allclose(got["sma"], g["close"].transform(lambda s: s.rolling(20).mean()), rtol=1e-10)
    np.testing.assert_allclose(got["lag7"], g["close"].shift(7), rtol=1e-12)
    np.testing.assert_allclose(got["cum"], g["volume"].cumsum(), rtol=1e-12)
    np.testing.assert_allclose(got["peak"], g["price"].cummax(), rtol=1e-12)
    assert (got["rn"] == g.cumcount() + 1).all()


def _ema(x, p):
    out = np.full(len(x), np.nan)
    if len(x) >= p:
        out[p - 1] = x[:p].mean()
        for i in range(p, len(x)):
            out[i] = out[i - 1] + (x[i] - out[i - 1]) * 2 / (p + 1)
    return out


def test_ema_and_rsi_over_blocks(skewed):
    df, pdf = skewed
    got, want = grouped(C.ema(df, 5, 12, series=SER, block_rows=100), pdf, ["ema_5", "ema_12"])
    for p in (5, 12):
        ref = np.concatenate([_ema(g["close"].to_numpy(), p) for _, g in want.groupby("symbol")])
        np.testing.assert_allclose(got[f"ema_{p}"], ref, rtol=1e-10)
    got, want = grouped(C.rsi(df, 14, series=SER, block_rows=100), pdf, ["rsi"])
    ref = []
    for _, g in want.groupby("symbol"):
        d = np.diff(g["close"].to_numpy())
        up, dn = np.maximum(d, 0), np.maximum(-d, 0)
        a, b = up[:14].mean(), dn[:14].mean()
        out = [np.nan] * 14 + [100 - 100 / (1 + a / b)]
        for u, v in zip(up[14:], dn[14:]):
            a, b = (a * 13 + u) / 14, (b * 13 + v) / 14
            out.append(100 - 100 / (1 + a / b))
        ref += out
    np.testing.assert_allclose(got["rsi"], ref, rtol=1e-8)


def test_kalman_blocks_equal_one_walk(skewed):
    df, pdf = skewed
    pairs = df.select(*KEY, "ts", "seq", F.col("close").alias("a"), F.col("price").alias("b"))
    got, want = grouped(C.kalman_hedge(pairs, SER, block_rows=128), pdf, ["ratio"])
    one, _ = grouped(C.kalman_hedge(pairs, SER, block_rows=10 ** 6), pdf, ["ratio"])
    np.testing.assert_allclose(got["ratio"], one["ratio"], rtol=1e-9)


def test_ranks_and_percentiles(skewed):
    df, pdf = skewed
    q = at_ranks(df, ["symbol"], "volume", {"p95": lambda n: F.floor(n * 0.95)}).toPandas().set_index("symbol")
    lin = linear_percentiles(df, ["symbol"], "close", {"m": 0.5}).toPandas().set_index("symbol")
    for s, g in pdf.groupby("symbol"):
        assert q.loc[s, "p95"] == np.sort(g["volume"])[int(len(g) * 0.95)]
        assert abs(lin.loc[s, "m"] - g["close"].median()) < 1e-9
    r = ranked(df, F.col("close"), ["symbol"], ties=("seq",), descending=True).select("symbol", "seq", "rank").toPandas()
    m = r.merge(pdf, on=["symbol", "seq"])
    assert (m["rank"] == m.groupby("symbol")["close"].rank(ascending=False, method="first")).all()


def test_islands_and_tail(skewed):
    df, pdf = skewed
    f = df.withColumn("up", F.col("side") == "buy")
    got, want = grouped(islands(f, SER, "up", block_rows=50), pdf, ["run_id"])
    new = want.groupby("symbol")["side"].transform(lambda s: (s != s.shift()).cumsum())
    assert (got["run_id"] == new).all()
    t = tail(df, SER, 60).df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("_rn").alias("r")).toPandas().set_index("symbol")
    assert t.loc["HOT", "n"] == 60 and t.loc["B", "n"] == 50 and t.loc["B", "r"] == 50

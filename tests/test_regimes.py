"""Spacing of jumps and the segments between them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import tseries
from barloom.plans.blocks import time_series

ROWS = time_series(("symbol",), ("ts",), bucket_seconds=86_400)


def greedy(positions, gap):
    kept = []
    for p in sorted(positions):
        if not kept or p - kept[-1] > gap:
            kept.append(p)
    return kept


@pytest.mark.parametrize("n, reach, gap", [(400, 900, 10), (300, 300, 1), (200, 100_000, 10), (1, 5, 3)])
def test_spacing_against_a_walk(spark, n, reach, gap):
    rng = np.random.default_rng(n)
    want, parts = {}, []
    for key in ("a", "b"):
        pos = rng.choice(np.arange(1, reach + 1), n, replace=False)
        want[key] = greedy(pos.tolist(), gap)
        parts.append(pd.DataFrame({"k": key, "p": pos, "g": gap}))
    got = tseries.spaced(spark.createDataFrame(pd.concat(parts)), ["k"], "p", "g").toPandas()
    assert {k: sorted(v) for k, v in got.groupby("k")["p"]} == want


def test_a_hundred_thousand_jumps_of_one_series(spark):
    df = spark.range(100_000).select(F.lit("x").alias("k"), (F.col("id") * 2 + F.col("id") % 2).alias("p"), F.lit(7).alias("g"))
    got = tseries.spaced(df, ["k"], "p", "g").select("p").toPandas()["p"].sort_values().tolist()
    assert got == greedy([2 * i + i % 2 for i in range(100_000)], 7)


def test_segments_share_their_edges(spark):
    rng = np.random.default_rng(5)
    px = 100 + np.cumsum(np.concatenate([rng.normal(0, 0.1, 150), rng.normal(0, 3, 120), rng.normal(0, 0.1, 130)]))
    ts = pd.date_range("2024-01-01", periods=400, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": ts, "close": px}))
    got = tseries.regime_change(df, window=20, threshold=0.6, series=ROWS).orderBy("seg").toPandas()
    assert got["seg"].tolist() == list(range(1, len(got) + 1)) and len(got) > 3
    assert got["start"][0] == 1 and got["end"].iloc[-1] == 400 and (got["start"][1:].to_numpy() == got["end"][:-1].to_numpy()).all()
    for r in got.itertuples():
        part = px[r.start - 1:r.end]
        assert r.mean == pytest.approx(part.mean()) and r.vol == pytest.approx(part.std(ddof=1))
    assert "high_vol" in set(got["label"]) and "FlatMapGroupsInPandas" not in tseries.regime_change(
        df, window=20, series=ROWS)._jdf.queryExecution().executedPlan().toString()

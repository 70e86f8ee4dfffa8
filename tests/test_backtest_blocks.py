"""Backtests summed up per block against the same runs simulated bar by bar."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import backtest as B
from barloom.plans.blocks import time_series

SERIES = time_series(("symbol", "exchange", "interval"), ("ts",), bucket_seconds=3600)
RUNS = [("sma_crossover", {"fast": 3, "slow": 8}), ("sma_crossover", {"fast": 2, "slow": 5}), ("rsi_mean_reversion", {"period": 4}),
        ("bollinger_mean_reversion", {"period": 6, "sd": 1})]


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(12)
    parts = []
    for key, n in (("A", 700), ("B", 90), ("C", 3)):
        px = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        parts.append(pd.DataFrame({"symbol": key, "exchange": "x", "interval": "1h", "ts": pd.date_range("2024-01-01", periods=n, freq="h"),
                                   "open": px, "high": px * 1.01, "low": px * 0.99, "close": px}))
    return spark.createDataFrame(pd.concat(parts))


def rows(df):
    return {(r.symbol, r.strategy, r.params): r for r in df.collect()}


@pytest.mark.parametrize("block_rows", [None, 100])
def test_block_sums_equal_the_bars(bars, block_rows):
    want = rows(B.metrics(B.simulate(B.signal_table(bars, RUNS, SERIES), series=SERIES), series=SERIES))
    got = rows(B.backtest(bars, RUNS, series=SERIES, block_rows=block_rows))
    assert set(got) == set(want) and len(got) == 12
    for k, r in got.items():
        assert r.asDict().keys() == want[k].asDict().keys()
        for name, v in r.asDict().items():
            w = want[k][name]
            assert v == w if isinstance(v, str) else v == pytest.approx(w, abs=0.0101), (k, name)
    assert max(r.total_trades for r in got.values()) > 20


def test_no_row_per_bar_and_run_is_stored(bars, monkeypatch):
    kept = []

    def noted(df):
        out = cut(df)
        kept.append(out.count())
        return out

    cut = B.cut
    monkeypatch.setattr(B, "cut", noted)
    runs = B.grid("sma_crossover", fast=[2, 3, 4], slow=[6, 8, 10])
    assert B.optimize(bars, runs, series=SERIES, block_rows=100).count() == 3
    assert kept[0] == 3 and sum(kept[1:]) <= 2 * len(runs) * 8          # two starts, nine runs, seven blocks and one over

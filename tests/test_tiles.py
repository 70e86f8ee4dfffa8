"""Symbol tiles: moments and rolling correlations against pandas, and what a task holds."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from barloom.operators import align


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    ts = pd.date_range("2024-01-01", periods=130, freq="D")
    pdf = pd.concat([pd.DataFrame({"symbol": f"s{i}", "ts": ts, "close": 100 + np.cumsum(rng.normal(0, 1, 130))}) for i in range(11)])
    pdf.loc[pdf["symbol"] == "s4", "close"] = 7.0                 # does not move
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("blocks", [None, 1, 4])
def test_pair_moments(panel, blocks):
    df, pdf = panel
    holes = pdf[(pdf["symbol"] != "s2") | (pdf["ts"].dt.day % 3 == 0)]
    twice = pd.concat([holes, holes[holes["symbol"] == "s1"].assign(close=lambda d: d["close"] - 5)])
    got = align.pair_moments(df.sparkSession.createDataFrame(twice), "close", blocks=blocks).toPandas().set_index(["a", "b"])
    wide = holes.pivot(index="ts", columns="symbol", values="close")
    assert len(got) == 66
    for (a, b), r in got.iterrows():
        both = wide[[a, b]].dropna() if a != b else wide[[a]].dropna().assign(**{"_": lambda d: d[a]})
        x, y = both.iloc[:, 0], both.iloc[:, 1]
        assert r["n"] == len(both) and a <= b
        assert r[["sa", "sb", "saa", "sbb", "sab"]].tolist() == pytest.approx([x.sum(), y.sum(), x @ x, y @ y, x @ y])


@pytest.mark.parametrize("side, block_rows, window, step", [(256, 4096, 30, 10), (3, 40, 12, 5), (4, 25, 10, 17)])
def test_rolling_correlations(panel, side, block_rows, window, step):
    df, pdf = panel
    got = align.rolling_correlation_matrix(df, window, step, block_rows, side=side).toPandas()
    rets = pdf.pivot(index="ts", columns="symbol", values="close").pct_change().dropna()
    ends = range(window, len(rets) + 1, step)
    assert len(got) == len(list(ends)) * 55 and (got["a"] < got["b"]).all()
    by = got.set_index(["ts", "a", "b"])["corr"]
    for k in ends:
        want = rets.iloc[k - window:k].corr().fillna(0)
        for a, b in (("s0", "s1"), ("s10", "s3"), ("s4", "s5")):
            a, b = sorted((a, b))
            assert by[rets.index[k - 1], a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_a_plan_for_many_symbols_keeps_tiles_small():
    for n in (1, 1_000, 100_000):
        groups, chunks = align.tile_plan(n, n * 2_500, 200)
        tiles, side = groups * (groups + 1) // 2, -(-n // groups)
        assert side <= align.TILE_SYMBOLS and 6 * 8 * side ** 2 <= 50_400_000
        assert tiles * chunks >= 200 or n == 1
        assert 2 * n * 2_500 / groups / chunks <= 2 * align.TILE_ROWS


def test_five_thousand_symbols_pass_in_tiles():
    """One tile of 20 x 21 / 2: a task that walks it holds some megabytes, not 5,000 squared."""
    symbols, groups, window, rows = 5_000, 20, 30, 60
    rng = np.random.default_rng(2)
    some = np.arange(symbols)[np.arange(symbols) % groups < 2]

    def batches():
        for rn in range(1, rows + 1):
            yield pd.DataFrame({"s": [f"s{i:05d}" for i in some], "t": pd.Timestamp("2024-01-01") + pd.Timedelta(rn, "D"),
                                "v": rng.normal(0, 0.01, len(some)), "g": some % groups, "p": 1, "_blk": 0, "_halo": False, "_rn": rn})

    tracemalloc.start()
    n = [len(w) for w in align.rolling_tiles(batches(), groups, window, 10)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == [250 * 250] * 4 and peak < 60_000_000

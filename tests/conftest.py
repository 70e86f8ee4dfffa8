import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from barloom.session import session

    s = session("tests", "4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def skewed(spark):
    """3,000 rows of one hot key and 150 of two small ones, hourly, with a tie-break."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for key, n in (("HOT", 3000), ("A", 100), ("B", 50)):
        px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 60 * 24 * 90, n)), unit="min")
        parts.append(pd.DataFrame({
            "symbol": key, "exchange": "x", "interval": "1h", "ts": ts, "seq": np.arange(n), "open": px,
            "high": px * 1.01, "low": px * 0.99, "close": px * (1 + rng.normal(0, 0.004, n)),
            "volume": rng.integers(1, 50, n).astype(float), "price": px,
            "side": rng.choice(["buy", "sell"], n)}))
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf).cache(), pdf

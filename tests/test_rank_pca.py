"""Ranks with hot ties, and components against a dense decomposition."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import factors
from barloom.plans import rank
from barloom.plans.blocks import BLOCK_ROWS


def test_ranks_of_ties_nulls_and_keys(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 3000, p=[0.6, 0.3, 0.1]), "x": rng.choice([1.0, 2.0, 5.0, np.nan], 3000),
                        "t": rng.permutation(3000)})
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = rank.ranked(df, F.col("x"), ("k",), ties=("t",), descending=True).toPandas()
    assert len(got) == 3000 and got.columns.tolist() == ["k", "x", "t", "rank", "n_ranked"]
    for _, g in got.groupby("k", dropna=False):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and (g["n_ranked"] == len(g)).all()
        keys = list(zip(g["x"].isna().map({True: 0, False: 1}), -g["x"].fillna(0), g["t"]))
        assert keys == sorted(keys)
    assert rank.ranked(df.limit(0), F.col("x")).count() == 0


def test_a_shared_value_spreads_over_tasks(spark, monkeypatch):
    """A third of 1e6 rows share value and tie; no partition holds more than two blocks."""
    seen = []

    def noted(df):
        out = rank_cut(df)
        seen.append(out.groupBy("_part").count().agg(F.max("count"), F.count("*")).first())
        return out

    rank_cut = rank.cut
    monkeypatch.setattr(rank, "cut", noted)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 1000 * 1.0).alias("x"), F.lit("same").alias("t"))
        r = rank.ranked(df, F.col("x"), ties=("t",))
        assert tuple(r.agg(F.count_distinct("rank"), F.max("rank"), F.min("rank"), F.max("n_ranked")).first()) == (10 ** 6, 10 ** 6, 1, 10 ** 6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0][0] <= 2 * BLOCK_ROWS and seen[0][1] == 16


@pytest.mark.parametrize("p, k", [(40, 3), (2, 5)])
def test_components(spark, p, k):
    rng = np.random.default_rng(p)
    x = rng.normal(0, 1, (90, p)) @ rng.normal(0, 1, (p, p)) * 0.01
    names = [f"s{i:02d}" for i in range(p)]
    wide = pd.DataFrame(x, columns=names, index=pd.date_range("2024-01-01", periods=90, freq="D"))
    df = spark.createDataFrame(wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="ret"))
    got = factors.pca(df, k).toPandas()
    val, vec = np.linalg.eigh(wide.cov().to_numpy())
    assert sorted(got["factor"].unique()) == list(range(1, min(p, k) + 1))
    for f, g in got.groupby("factor"):
        v = vec[:, -f] * np.sign(vec[np.abs(vec[:, -f]).argmax(), -f])
        assert g.set_index("symbol")["loading"][names].to_numpy() == pytest.approx(v, abs=1e-7)
        assert g["explained"].iloc[0] == pytest.approx(val[-f] / val.sum(), abs=1e-9)
    assert factors.pca(df.limit(0), k).count() == 0

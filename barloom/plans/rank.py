"""Ranks, nearest-rank percentiles and one-row joins without one-task sorts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import framed, value_series
from .lineage import cut


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (broadcast of one row)."""
    one = F.broadcast(row.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def numbered(df: DataFrame, key: tuple[str, ...], order: list[Column], name: str, total: str) -> DataFrame:
    """Rows numbered from 1 in ``order`` within each key, and the key's number of rows, whatever the ties.

    Rows are range-partitioned by key, order and a number of their own, so
    neither a hot key nor a value shared by any number of rows meets in one
    task.  A row's place is its place in the sorted partition plus the rows of
    its key in the partitions before, which is one small row per key and
    partition.  The partitions are written first, as their bounds are sampled.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("_own", F.monotonically_increasing_id())
    by = [*[F.col(k) for k in key], *order, F.col("_own")]
    laid = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % (1 << 33)}).drop("_own"))
    whole = Window.partitionBy(*key)
    past = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy(*key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c")).select(
        *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(key)], F.col("_part").alias("_k_part"),
        (F.coalesce(F.sum("_c").over(past), F.lit(0)) - F.col("_first") + 1).alias("_shift"), F.sum("_c").over(whole).alias(total))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(key)]
    met = laid.join(starts, [*same, F.col("_part") == F.col("_k_part")])
    return met.select(*[c for c in laid.columns if c not in ("_part", "_at")], (F.col("_at") + F.col("_shift")).alias(name), total)


def ranked(df: DataFrame, value: Column, key=(), ties=(), descending: bool = False,
           name: str = "rank", total: str = "n_ranked") -> DataFrame:
    """Exact 1-based rank per key (all rows when key is empty); nulls first, equal values by ``ties``, equal rows in any order."""
    v = -value if descending else value
    key = tuple(key) or ("_all",)
    src = df.withColumn("_v", v.cast("double")).withColumn("_all", F.lit(0))
    return numbered(src, key, [F.col("_v"), *[F.col(t) for t in ties]], name, total).drop("_v", "_all")


def at_ranks(df: DataFrame, key, value: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``sorted(value)[i(n)]`` per key for every pick, plus ``n``.

    Equal values are counted first, so a value shared by most rows costs one row.
    """
    key = tuple(key)
    cnt = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(
        F.count(F.lit(1)).alias("_c"))
    fr = framed(cnt, value_series(key, value), carry={"c": ("sum", F.col("_c"))})
    cum = fr.with_columns(_hi=fr.running("c", "sum", F.col("_c"))).body()
    n = cnt.groupBy(*key).agg(F.sum("_c").alias("n"))
    hit = cum.join(n, list(key))
    aggs = []
    for name, index in picks.items():
        i = index(F.col("n"))
        inside = (i >= F.col("_hi") - F.col("_c")) & (i < F.col("_hi"))
        aggs.append(F.max(F.when(inside, F.col(value))).alias(name))
    return hit.groupBy(*key, "n").agg(*aggs)


def linear_percentiles(df: DataFrame, key, value: str, ps: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between the two nearest ranks."""
    picks: dict[str, Callable[[Column], Column]] = {}
    for name, p in ps.items():
        picks[f"{name}_lo"] = lambda n, p=p: F.floor((n - 1) * p)
        picks[f"{name}_hi"] = lambda n, p=p: F.ceil((n - 1) * p)
    got = at_ranks(df, key, value, picks)
    frac = {name: (F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p) for name, p in ps.items()}
    return got.select(*key, "n", *[
        (F.col(f"{n}_lo") + frac[n] * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n) for n in ps])

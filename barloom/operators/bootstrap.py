"""Bootstrap of historical returns: tail risk, confidence intervals, drawdowns, joint scenarios.

A draw is counter-based: the first 60 bits of the MD5 of (seed, simulation,
step, key), so results do not depend on partitioning, a lost task redraws the
same rows and any engine can repeat them. Draws meet the numbered returns in an
equi join on the row number; nothing is collected. Numbered returns and one row
per simulated path are written once, so no layout is nested in another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import log_growth, sample_sd
from ..plans.blocks import Series, framed
from ..plans.lineage import cut
from ..plans.rank import at_ranks, linear_percentiles, with_row
from ..sources.views import BAR_SERIES
from .align import TS_SERIES, common_ts


def numbered(rets: DataFrame, series: Series) -> DataFrame:
    r = framed(rets.select(*series.key, *series.order, "ret"), series).body(keep_rn=True)
    return r.select(*series.key, (F.col("_rn") - 1).alias("i"), F.col("_n").alias("n"), "ret")


def counter_draw(n: Column, *counters: Column | str) -> Column:
    """A number below ``n`` from the counters, joined by ``|``."""
    digits = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in counters])
                               .cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % n


def draws(sizes: DataFrame, key, sims: int, steps: Column, seed: int) -> DataFrame:
    """(key, sim, step, i): ``sizes`` has one row per key with n."""
    d = sizes.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).withColumn(
        "step", F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long") - 1)))
    return d.withColumn("i", counter_draw(F.col("n"), F.lit(seed), "sim", "step", *key))


def sampled(rets: DataFrame, sims: int, horizon: int | None, series: Series, seed: int) -> DataFrame:
    key = list(series.key)
    nr = cut(numbered(rets, series))
    sizes = nr.groupBy(*key).agg(F.max("n").alias("n"))
    steps = F.lit(horizon) if horizon else F.col("n")
    d = draws(sizes, key, sims, steps, seed)
    return d.select(*key, "sim", "step", "i").join(nr.drop("n"), [*key, "i"]).drop("i")


def bootstrap_var(rets: DataFrame, sims: int = 1000, horizon: int = 1, levels=(95, 99), series: Series = BAR_SERIES,
                  seed: int = 42) -> DataFrame:
    """VaR and expected shortfall of the compounded horizon return per confidence level."""
    key = list(series.key)
    s = cut(sampled(rets, sims, horizon, series, seed).groupBy(*key, "sim").agg((F.product(1 + F.col("ret")) - 1).alias("r")))
    q = at_ranks(s, key, "r", {f"q{c}": (lambda n, c=c: F.floor(n * (1 - c / 100))) for c in levels}).drop("n")
    j = s.join(q, key)
    g = j.groupBy(*key).agg(*[x for c in levels for x in (
        (-F.max(f"q{c}")).alias(f"var_{c}"), (-F.avg(F.when(F.col("r") <= F.col(f"q{c}"), F.col("r")))).alias(f"cvar_{c}"))])
    return g


PATH_STEPS = 100_000            # steps of a path in one window


def path_stats(rets: DataFrame, sims: int, horizon: int | None, series: Series, seed: int) -> DataFrame:
    """Mean, deviation, Sharpe and maximum drawdown of every simulated path.

    Steps are numbered, so a path is cut in blocks without counting.  A block is
    summed up by its log growth, highest and lowest point and worst fall; a
    path's worst fall is the worst within a block or from the highest point
    before a block to the lowest in it.
    """
    key = [*series.key, "sim"]
    s = sampled(rets, sims, horizon, series, seed).withColumn("_l", log_growth(1 + F.col("ret"))) \
        .withColumn("_blk", F.floor(F.col("step") / PATH_STEPS))
    so_far = Window.partitionBy(*key, "_blk").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_p", F.sum("_l").over(so_far)).withColumn("_top", F.max("_p").over(so_far))
    g = s.groupBy(*key, "_blk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"), F.sum("_l").alias("_l"),
        F.max("_p").alias("_high"), F.min("_p").alias("_low"), F.max(F.col("_top") - F.col("_p")).alias("_fall"))
    past = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_at", F.coalesce(F.sum("_l").over(past), F.lit(0.0)))
    peak = F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("_at") + F.col("_high")).over(past), F.lit(0.0)))
    fall = F.greatest(F.col("_fall"), peak - F.col("_at") - F.col("_low"), F.lit(0.0))
    g = g.withColumn("_fall", fall).groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("_fall").alias("_fall"))
    sd = sample_sd(F.col("n"), F.col("s"), F.col("q"))
    mean = F.col("s") / F.col("n")
    return cut(g.select(*key, mean.alias("mean"), sd.alias("volatility"),
                        F.when(sd == 0, 0.0).otherwise(mean / sd * 365 ** 0.5).alias("sharpe"), (1 - F.exp(-F.col("_fall"))).alias("max_drawdown")))


def bootstrap_ci(rets: DataFrame, statistic: str = "sharpe", sims: int = 200, level: float = 0.95, series: Series = BAR_SERIES,
                 seed: int = 42) -> DataFrame:
    """Point estimate, nearest-rank interval and standard error of a statistic."""
    key, alpha = list(series.key), 1 - level
    s = path_stats(rets, sims, None, series, seed).select(*key, F.col(statistic).alias("x"))
    q = at_ranks(s, key, "x", {"lower": lambda n: F.floor(n * (alpha / 2)),
                               "upper": lambda n: F.least(F.floor(n * (1 - alpha / 2)), n - 1)}).drop("n")
    se = s.groupBy(*key).agg(F.stddev_samp("x").alias("standard_error"))
    sd = F.coalesce(F.stddev_samp("ret"), F.lit(0.0))
    point = {"mean": F.avg("ret"), "volatility": sd, "sharpe": F.when(sd == 0, 0.0).otherwise(F.avg("ret") / sd * 365 ** 0.5)}
    if statistic == "max_drawdown":
        from .stats import max_drawdown
        ser, lg = series, log_growth(1 + F.col("ret"))
        fr = framed(rets, ser, carry={"l": ("sum", lg)})
        path = fr.with_columns(v=F.exp(fr.running("l", "sum", lg))).body()
        est = max_drawdown(path, "v", ser).select(*key, F.col("max_drawdown").alias("estimate"))
    else:
        est = rets.groupBy(*key).agg(point[statistic].alias("estimate"))
    return est.join(q, key).join(se, key)


def bootstrap_drawdown(rets: DataFrame, sims: int = 200, horizon: int | None = None, ruin: float = 0.2, series: Series = BAR_SERIES,
                       seed: int = 42) -> DataFrame:
    """Expected maximum drawdown, interpolated 95 and 99 % quantiles and probability of ruin."""
    key = list(series.key)
    s = path_stats(rets, sims, horizon, series, seed)
    q = linear_percentiles(s, key, "max_drawdown", {"dd_95": 0.95, "dd_99": 0.99}).drop("n")
    g = s.groupBy(*key).agg(F.avg("max_drawdown").alias("expected_drawdown"),
                            F.avg(F.when(F.col("max_drawdown") >= ruin, 1.0).otherwise(0.0)).alias("ruin_probability"))
    return g.join(q, key)


def bootstrap_scenarios(rets: DataFrame, n: int, seed: int = 42, symbols: list[str] | None = None) -> DataFrame:
    """Joint scenarios: the returns of ``symbols`` (all by default) at a drawn common timestamp."""
    al = cut(common_ts(rets.select("symbol", "ts", "ret"), symbols=symbols))
    stamps = framed(al.select("ts").distinct().withColumn("_all", F.lit(0)), TS_SERIES).body(keep_rn=True).select(
        "ts", (F.col("_rn") - 1).alias("i"), F.col("_n").alias("n"))
    size = stamps.agg(F.max("n").alias("n"))
    d = with_row(rets.sparkSession.range(n).withColumnRenamed("id", "scenario"), size)
    d = d.withColumn("i", counter_draw(F.col("n"), F.lit(seed), "scenario")).select("scenario", "i")
    return d.join(stamps.select("i", "ts"), "i").join(al, "ts").select("scenario", "symbol", "ts", "ret")

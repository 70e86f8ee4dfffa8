"""Returns, screening, ranking and momentum over all series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_up
from ..plans.blocks import Series, framed, tail
from ..plans.rank import ranked, with_row
from ..sources.views import BAR_SERIES


def returns_series(bars: DataFrame, series: Series = BAR_SERIES, price: str = "close") -> DataFrame:
    """Simple return per row; rows without a usable previous price are dropped."""
    fr = framed(bars, series, lookback=1)
    fr = fr.with_columns(prev=F.lag(price).over(fr.w))
    fr = fr.with_columns(ret=F.when(F.col("prev") != 0, (F.col(price) - F.col("prev")) / F.col("prev")))
    return fr.body(keep_rn=True).withColumnsRenamed({"_rn": "rn", "_n": "n"}).filter(
        F.col("ret").isNotNull())


def within_lookback(bars: DataFrame, days: int, as_of=None) -> DataFrame:
    """Rows of the last ``days`` before ``as_of`` (default: the newest row of the table)."""
    span = F.expr(f"interval {days} days")
    if as_of is not None:
        t = F.lit(as_of).cast("timestamp")
        return bars.filter((F.col("ts") >= t - span) & (F.col("ts") <= t))
    newest = bars.agg(F.max("ts").alias("_now"))
    return with_row(bars, newest).filter(F.col("ts") >= F.col("_now") - span).drop("_now")


def cross_sectional_sort(bars: DataFrame, metric: str = "momentum", days: int = 365,
                         series: Series = BAR_SERIES, as_of=None) -> DataFrame:
    """Symbols ranked by a metric of the lookback period, with percentile and quintile."""
    df = within_lookback(bars, days, as_of)
    if metric == "volatility":
        r = returns_series(df, series)
        per = r.groupBy(*series.key).agg(F.stddev_samp("ret").alias("value"), F.count("ret").alias("_m"))
        per = per.filter(F.col("_m") >= 2)
    else:
        o = F.struct(*series.order)
        first, last = F.min_by("close", o), F.max_by("close", o)
        value = {"momentum": (last - first) / first, "return": (last - first) / first,
                 "volume": F.avg("volume")}[metric]
        per = df.groupBy(*series.key).agg(value.alias("value"), F.count(F.lit(1)).alias("_m"))
        per = per.filter(F.col("_m") >= 2)
    return rank_buckets(per.drop("_m"), series.key)


def rank_buckets(df: DataFrame, ties) -> DataFrame:
    """Rank by ``value`` descending; percentile from 1 to 0; quintile by ceil(rank / (n/5))."""
    r = ranked(df, F.col("value"), ties=ties, descending=True)
    n, k = F.col("n_ranked"), F.col("rank")
    return (r.withColumn("percentile", F.when(n == 1, 1.0).otherwise(1 - (k - 1) / (n - 1)))
            .withColumn("quintile", F.least(F.lit(5), F.ceil(k / (n / 5))).cast("long")))


METRICS = ("avg_volume", "volatility", "return", "sharpe")
_OPS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "=": "__eq__"}


def screen_universe(bars: DataFrame, filters: list[tuple[str, str, float, int]],
                    series: Series = BAR_SERIES, limit: int | None = None, as_of=None) -> DataFrame:
    """Symbols passing all (metric, op, value, lookback days) filters; each keeps its own lookback."""
    longest = max(f[3] for f in filters)
    df = within_lookback(bars, longest, as_of)
    fr = framed(df, series, lookback=1)
    fr = fr.with_columns(prev=F.lag("close").over(fr.w))
    r = fr.with_columns(ret=F.when(F.col("prev") != 0, (F.col("close") - F.col("prev")) / F.col("prev")),
                        ).body()
    now = bars.agg(F.max("ts").alias("_now")) if as_of is None else None
    r = with_row(r, now) if now is not None else r.withColumn("_now", F.lit(as_of).cast("timestamp"))
    o = F.struct(*series.order)
    aggs = [F.count("ret").alias("n_ret")]
    for i, (metric, _, _, days) in enumerate(filters):
        on = F.col("ts") >= F.col("_now") - F.expr(f"interval {days} days")
        ret = F.when(on, F.col("ret"))
        sd = F.stddev_samp(ret)
        expr = {"avg_volume": F.avg(F.when(on, F.col("volume"))), "volatility": sd,
                "return": F.max_by("close", F.when(on, o)) / F.min_by("close", F.when(on, o)) - 1,
                "sharpe": F.when(sd != 0, F.avg(ret) / sd * F.sqrt(F.lit(365.0)))}[metric]
        aggs.append(expr.alias(f"m{i}"))
    out = r.groupBy(*series.key).agg(*aggs).filter(F.col("n_ret") >= 2)
    for i, (_, op, value, _) in enumerate(filters):
        out = out.filter(getattr(F.col(f"m{i}"), _OPS[op])(F.lit(float(value))))
    out = out.orderBy("symbol")
    return out.limit(limit) if limit else out


def rolling_returns(bars: DataFrame, windows=(1, 5, 20), series: Series = BAR_SERIES,
                    price: str = "close") -> DataFrame:
    """Return over each window ending at each row; 0 where the base price is 0."""
    fr = framed(bars, series, lookback=max(windows))
    for w in windows:
        base = F.lag(price, w).over(fr.w)
        fr = fr.with_columns(**{f"ret_{w}": F.when(base == 0, 0.0).otherwise((F.col(price) - base) / base)})
    return fr.body()


def pct_change_windows(bars: DataFrame, windows=(1, 5, 20), series: Series = BAR_SERIES) -> DataFrame:
    """Change of the last close against the close w rows earlier; null when short or base 0."""
    t = tail(bars, series, max(windows) + 1)
    at = lambda w: F.max(F.when(F.col("_rn") == F.col("_n") - w, F.col("close")))
    return t.df.groupBy(*series.key).agg(*[
        F.when(at(w) != 0, (at(0) - at(w)) / at(w)).alias(f"chg_{w}") for w in windows])


def momentum_score(bars: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    """Weighted 1/5/10/20-bar change plus volume surge, ranked best first; needs 21 bars."""
    t = tail(bars, series, 25)
    back = F.col("_n") - F.col("_rn")
    at = lambda w: F.max(F.when(back == w, F.col("close")))
    g = t.df.groupBy(*series.key).agg(
        F.max("_n").alias("n_bars"), *[at(w).alias(f"p{w}") for w in (0, 1, 5, 10, 20)],
        F.avg(F.when(back < 5, F.col("volume"))).alias("v_now"),
        F.avg(F.when((back >= 5) & (back < 25), F.col("volume"))).alias("v_old"))
    chg = lambda w: F.when(F.col(f"p{w}") == 0, 0.0).otherwise(
        (F.col("p0") - F.col(f"p{w}")) / F.col(f"p{w}") * 100)
    g = g.filter(F.col("n_bars") >= 21)
    for w in (1, 5, 10, 20):
        g = g.withColumn(f"chg_{w}", half_up(chg(w), 2))
    g = g.withColumn("surge", F.when(F.coalesce("v_old", F.lit(0.0)) == 0, 1.0).otherwise(
        F.col("v_now") / F.col("v_old")))
    g = g.withColumn("surge", half_up(F.col("surge"), 2))
    # Weights of the four changes and of the surge.
    g = g.withColumn("score", half_up(
        0.1 * F.col("chg_1") + 0.2 * F.col("chg_5") + 0.3 * F.col("chg_10") + 0.2 * F.col("chg_20")
        + 0.2 * (F.col("surge") - 1) * 100, 2))
    return ranked(g, F.col("score"), ties=series.key, descending=True)


def spread_monitor(quotes: DataFrame, key=("venue", "symbol")) -> DataFrame:
    """Latest quote per key, tightest spread first, quotes without a two-sided price last."""
    last = quotes.groupBy(*key).agg(F.max_by(F.struct("bid", "ask"), "ts").alias("q")).select(
        *key, "q.bid", "q.ask")
    mid = (F.col("bid") + F.col("ask")) / 2
    out = last.withColumn("spread", F.col("ask") - F.col("bid")).withColumn(
        "spread_bps", F.when(mid > 0, F.col("spread") / mid * 10000))
    return out.orderBy(F.col("spread_bps").asc_nulls_last(), *key)


def downsample_series(df: DataFrame, max_points: int, series: Series = BAR_SERIES) -> DataFrame:
    """Every k-th row with k = ceil(n / max_points), plus the last row of each series."""
    fr = framed(df, series)
    step = F.ceil(F.col("_n") / F.lit(max_points))
    keep = (F.col("_n") <= max_points) | ((F.col("_rn") - 1) % step == 0) | (F.col("_rn") == F.col("_n"))
    return fr.with_columns(_keep=keep).body(keep_rn=True).filter("_keep").drop("_keep") \
        .withColumnsRenamed({"_rn": "rn", "_n": "n"})

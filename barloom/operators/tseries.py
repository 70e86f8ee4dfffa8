"""Time-series tests over every series of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import normal_cdf
from ..plans.blocks import Series, framed
from ..plans.lineage import cut
from ..sources.views import BAR_SERIES

INF = float("inf")


def centred(df: DataFrame, x: str, series: Series) -> DataFrame:
    """Keep key, order and ``_y`` = x minus the series mean, with the series size ``_k``."""
    key = list(series.key)
    m = df.groupBy(*key).agg(F.avg(x).alias("_mu"), F.count(x).alias("_k"))
    return df.select(*key, *series.order, F.col(x).cast("double").alias("_x")).join(m, key).withColumn(
        "_y", F.col("_x") - F.col("_mu"))


def acf_arrays(df: DataFrame, x: str = "ret", max_lag: int = 40, series: Series = BAR_SERIES) -> DataFrame:
    """Biased autocorrelations 0..min(n/4, max_lag) as one array per series."""
    fr = framed(centred(df, x, series), series, lookback=max_lag)
    cols = {f"p{k}": F.col("_y") * F.lag("_y", k).over(fr.w) for k in range(1, max_lag + 1)}
    rows = window_columns(fr, cols)
    g = rows.groupBy(*series.key).agg(
        F.max("_k").alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("c0"),
        F.array(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in cols]).alias("c"))
    lim = F.least(F.lit(max_lag), F.floor(F.col("n") / 4)).cast("int")
    return g.filter("n >= 3 AND c0 > 0").select(
        *series.key, "n", F.concat(F.array(F.lit(1.0)), F.transform(F.slice("c", 1, lim), lambda v: v / F.col("c0")))
        .alias("acf"), (1.96 / F.sqrt("n")).alias("band"))


def window_columns(fr, cols: dict[str, Column]) -> DataFrame:
    """Add many window columns in one projection (one window node)."""
    df = fr.df.select("*", *[c.alias(n) for n, c in cols.items()])
    return type(fr)(df, fr.series, fr.carries).body(keep_rn=True)


def acf(df: DataFrame, x: str = "ret", max_lag: int = 40, series: Series = BAR_SERIES) -> DataFrame:
    a = acf_arrays(df, x, max_lag, series)
    e = a.select(*series.key, "n", "band", F.posexplode("acf").alias("lag", "acf"))
    return e.withColumn("significant", (F.col("lag") > 0) & (F.abs("acf") > F.col("band")))


def pacf(df: DataFrame, x: str = "ret", max_lag: int = 40, series: Series = BAR_SERIES) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion on the (at most 41 long) acf array."""
    a = acf_arrays(df, x, max_lag, series).filter(F.size("acf") >= 2)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

    def step(state: Column, k: Column) -> Column:
        past = F.slice("acf", 2, k - 1)
        num = F.get("acf", k) - dot(state.phi, F.reverse(past))
        den = 1 - dot(state.phi, past)
        v = F.when(den == 0, 0.0).otherwise(num / den)
        phi = F.concat(F.zip_with(state.phi, F.reverse(state.phi), lambda p, q: p - v * q), F.array(v))
        return F.struct(phi.alias("phi"), F.concat(state.out, F.array(v)).alias("out"))

    first = F.get("acf", F.lit(1))
    init = F.struct(F.array(first).alias("phi"), F.array(F.lit(1.0), first).alias("out"))
    ks = F.when(F.size("acf") > 2, F.sequence(F.lit(2), F.size("acf") - 1)).otherwise(F.array().cast("array<int>"))
    out = F.aggregate(ks, init, step, lambda s: s.out)
    e = a.select(*series.key, "n", "band", F.posexplode(out).alias("lag", "pacf"))
    return e.withColumn("significant", (F.col("lag") > 0) & (F.abs("pacf") > F.col("band")))


def ar_moments(df: DataFrame, x: str, series: Series) -> DataFrame:
    """Regression of the change on the previous (centred) value: slope, t-statistic, n."""
    fr = framed(centred(df, x, series), series, lookback=1)
    lag = F.lag("_y").over(fr.w)
    r = fr.with_columns(_l=lag, _d=F.col("_y") - lag).body()
    g = r.groupBy(*series.key).agg(
        F.max("_k").alias("n"), F.count("_d").alias("_m"), F.regr_slope("_d", "_l").alias("slope"),
        F.regr_sxx("_d", "_l").alias("_sxx"), F.regr_syy("_d", "_l").alias("_syy"), F.regr_sxy("_d", "_l").alias("_sxy"))
    res = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    se = F.sqrt(res / F.greatest(F.lit(1), F.col("_m") - 2) / F.col("_sxx"))
    return g.withColumn("statistic", F.coalesce(F.when((F.col("_sxx") > 0) & (se > 0), F.col("slope") / se), F.lit(0.0))) \
        .drop("_m", "_sxx", "_syy", "_sxy")


def adf_lag0(df: DataFrame, x: str = "close", series: Series = BAR_SERIES) -> DataFrame:
    """Unit-root statistic without lagged differences, stepwise p-values."""
    g = ar_moments(df, x, series)
    # Asymptotic critical values and their 1/n terms.
    n = F.col("n")
    c1, c5, c10 = -3.43 - 6.0 / n, -2.86 - 2.74 / n, -2.57 - 1.67 / n
    t = F.when(n < 4, 0.0).otherwise(F.col("statistic"))
    p = F.when(n < 4, 1.0).when(t <= c1, 0.005).when(t <= c5, 0.03).when(t <= c10, 0.07).otherwise(
        F.least(F.lit(1.0), 0.1 + (t - c10) * 0.15))
    return g.withColumn("statistic", t).withColumn("p_value", p).withColumn("stationary", (n >= 4) & (t < c5))


# Limit, 1/n and 1/n^2 terms of the 1, 5 and 10 % critical values.
MACKINNON = ((-3.4336, -5.999, -29.25), (-2.8621, -2.738, -8.36), (-2.5671, -1.438, -4.48))


def mackinnon_cv(n: Column) -> list[Column]:
    return [a + b / n + c / (n * n) for a, b, c in MACKINNON]


def mackinnon_p(t: Column, n: Column) -> Column:
    c1, c5, c10 = mackinnon_cv(n)
    return (F.when(t <= c1, 0.005).when(t <= c5, 0.01 + (t - c1) / (c5 - c1) * 0.04)
            .when(t <= c10, 0.05 + (t - c5) / (c10 - c5) * 0.05)
            .otherwise(F.least(F.lit(1.0), 0.10 + (t - c10) / F.abs(c10 - c1) * 0.45)))


def adf_mackinnon(df: DataFrame, x: str = "close", series: Series = BAR_SERIES) -> DataFrame:
    g = ar_moments(df, x, series)
    n, short = F.col("n"), F.col("n") < 10
    t = F.when(short, 0.0).otherwise(F.col("statistic"))
    return (g.withColumn("statistic", t).withColumn("p_value", F.when(short, 1.0).otherwise(mackinnon_p(t, n)))
            .withColumn("cv_5", mackinnon_cv(n)[1]).withColumn("stationary", ~short & (t < F.col("cv_5"))))


def half_life_of(slope: Column) -> Column:
    return F.when((slope >= 0) | slope.isNull(), F.lit(INF)).otherwise(-F.ln(F.lit(2.0)) / F.ln(1 + slope))


def half_life(df: DataFrame, x: str = "close", series: Series = BAR_SERIES) -> DataFrame:
    g = ar_moments(df, x, series)
    return g.withColumn("half_life", half_life_of(F.col("slope"))).withColumn("mean_reverting", F.col("slope") < 0)


def cusum_breaks(df: DataFrame, x: str = "ret", threshold: float = 1.36, series: Series = BAR_SERIES) -> DataFrame:
    """Local maxima of the standardised running sum above the threshold; booked one row later."""
    key = list(series.key)
    stats = df.groupBy(*key).agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"), F.count(x).alias("_k"))
    z = df.select(*key, *series.order, F.col(x).alias("_x")).join(stats.filter("_k >= 10 AND _sd > 0"), key).withColumn(
        "_z", (F.col("_x") - F.col("_mu")) / F.col("_sd"))
    fr = framed(z, series, carry={"z": ("sum", F.col("_z"))})
    c = fr.with_columns(_c=F.abs(fr.running("z", "sum", F.col("_z")) / F.sqrt("_k"))).body()
    fr = framed(c, series, lookback=2)
    mid, old = F.lag("_c").over(fr.w), F.lag("_c", 2).over(fr.w)
    hit = (mid > threshold) & (mid >= old) & (mid >= F.col("_c"))
    out = fr.with_columns(_hit=hit, index=F.col("_rn") - 2, significance=mid / threshold,
                          break_ts=F.lag(series.order[0]).over(fr.w)).body()
    return out.filter("_hit").select(*key, "index", "break_ts", "significance")


def variance_ratio(df: DataFrame, x: str = "close", periods=(2, 5, 10, 20), series: Series = BAR_SERIES) -> DataFrame:
    """Overlapping uncentred variance ratios with z and two-sided normal p."""
    key = list(series.key)
    fr = framed(df.select(*key, *series.order, F.col(x).alias("_x")), series, lookback=max(periods))
    cols = {f"r{q}": F.pow(F.col("_x") / F.lag("_x", q).over(fr.w) - 1, 2) for q in (1, *periods)}
    rows = window_columns(fr, cols)
    g = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
    g = g.filter("n >= 5")
    e = g.select(*key, "n", "r1", F.explode(F.array(*[F.struct(F.lit(q).alias("period"), F.col(f"r{q}").alias("v"))
                                                      for q in periods])).alias("p")).select(*key, "n", "r1", "p.*")
    q, nq = F.col("period"), F.col("n") - 1
    e = e.filter(q < F.col("n")).withColumn("ratio", F.when(F.col("r1") == 0, 1.0).otherwise(F.col("v") / (q * F.col("r1"))))
    se = F.sqrt(2 * (2 * q - 1) * (q - 1) / (3 * q * nq))
    e = e.withColumn("z", (F.col("ratio") - 1) / se)
    return e.withColumn("p_value", 2 * (1 - normal_cdf(F.abs("z")))).drop("r1", "v")


def spaced(cand: DataFrame, key: list[str], pos: str, gap: str) -> DataFrame:
    """``cand`` without rows closer than ``gap`` to the last kept one of their key: greedy from the first, in ``pos`` order.

    Each row points to the first row beyond its gap.  A row whose predecessor is
    further away than the gap is always kept, so only stretches of close rows
    depend on each other; the rows kept in them follow from doubling the
    pointers, with as many joins on (key, pos) as the longest stretch has
    doublings of kept rows.  No group of rows meets in a task.
    """
    cand = cut(cand.select(*key, F.col(pos).alias("_p"), F.col(gap).alias("_g")).distinct())
    # first row behind _p + _g: the last one met before it when walking from the end
    ask = cand.select(*key, (-(F.col("_p") + F.col("_g"))).alias("_at"), F.lit(0).alias("_kind"), F.col("_p").alias("_q"))
    row = cand.select(*key, (-F.col("_p")).alias("_at"), F.lit(1).alias("_kind"), F.col("_p").alias("_q"))
    order = Series(tuple(key), ("_at", "_kind", "_q"), lambda: F.floor(F.col("_at") / 65_536))
    own = F.when(F.col("_kind") == 1, F.col("_q"))
    fr = framed(ask.unionByName(row), order, carry={"n": ("last", own)})
    hop = fr.with_columns(_to=fr.running("n", "last", own)).body().filter("_kind = 0").select(*key, F.col("_q").alias("_p"), "_to")
    fr = framed(cand, Series(tuple(key), ("_p",), lambda: F.floor(F.col("_p") / 65_536)), lookback=1)
    prev = F.lag("_p").over(fr.w)
    heads = fr.with_columns(_free=prev.isNull() | (F.col("_p") - prev > F.col("_g"))).body().select(*key, "_p", "_free")
    kept = cut(heads.filter("_free").select(*key, "_p"))
    free = kept.withColumnRenamed("_p", "_to").withColumn("_end", F.lit(True))
    # pointers to rows that are kept anyway need no following
    hop = cut(hop.filter("_to is not null").join(free, [*key, "_to"], "left").filter("_end is null").drop("_end"))
    while not hop.isEmpty():
        met = kept.join(hop, [*key, "_p"]).select(*key, F.col("_to").alias("_p"))
        kept = cut(kept.unionByName(met).distinct())
        ahead = hop.select(*key, F.col("_p").alias("_to"), F.col("_to").alias("_far"))
        hop = cut(hop.join(ahead, [*key, "_to"]).select(*key, "_p", F.col("_far").alias("_to")))
    return kept.select(*key, F.col("_p").alias(pos))


def regime_change(df: DataFrame, x: str = "close", window: int | None = None, threshold: float = 1.5,
                  series: Series = BAR_SERIES) -> DataFrame:
    """Change points of the rolling mean and deviation, spaced by half a window, with labelled regimes.

    The window may be a tenth of the series, so rolling moments are differences
    of running sums met by an equi join on the row number.  Jumps are spaced by
    ``spaced``; a running count of the kept ones numbers the segments, and a
    kept jump ends one segment and begins the next.
    """
    key = list(series.key)
    y = centred(df, x, series).withColumn("_q", F.col("_y") * F.col("_y"))
    fr = framed(y, series, lookback=2, carry={"s": ("sum", F.col("_y")), "q": ("sum", F.col("_q"))})
    d = F.col("_y") - F.lag("_y").over(fr.w)
    fr = fr.with_columns(s=fr.running("s", "sum", F.col("_y")), q=fr.running("q", "sum", F.col("_q")), d=d)
    rows = fr.with_columns(dp=F.lag("d").over(fr.w)).body(keep_rn=True).withColumnsRenamed({"_rn": "rn", "_n": "n"})
    w = F.lit(window).cast("long") if window else F.greatest(F.lit(20), F.floor(F.col("n") / 10))
    rows = cut(rows.withColumn("w", w).filter("n >= 2 * w").select(*key, "rn", "n", "w", "_y", "_mu", "s", "q", "d", "dp"))
    past = rows.select(*key, (F.col("rn") + F.col("w")).alias("rn"), F.col("s").alias("s0"), F.col("q").alias("q0"))
    roll = rows.filter("rn >= w").join(past, [*key, "rn"], "left").na.fill(0.0, ["s0", "q0"])
    m = (F.col("s") - F.col("s0")) / F.col("w")
    var = (F.col("q") - F.col("q0") - F.col("w") * m * m) / (F.col("w") - 1)
    roll = roll.select(*key, "rn", "w", m.alias("m"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("v"))
    avg = roll.groupBy(*key).agg(F.avg("v").alias("avg_v"))
    by_row = Series(series.key, ("rn",), lambda: F.floor(F.col("rn") / 4096))
    fr = framed(roll.join(avg, key), by_row, lookback=1)
    av = F.when(F.col("avg_v") == 0, 1.0).otherwise(F.col("avg_v"))
    jump = (F.abs(F.col("v") - F.lag("v").over(fr.w)) / av > threshold * 0.5) | (
        F.abs(F.col("m") - F.lag("m").over(fr.w)) / av > threshold)
    cand = fr.with_columns(_j=jump).body().filter("_j").select(*key, "rn", F.floor(F.col("w") / 2).alias("gap"))
    edges = spaced(cand, key, "rn", "gap").withColumn("_edge", F.lit(True))

    flag = F.when((F.col("rn") < F.col("n")) & (F.coalesce("_edge", F.lit(False)) | (F.col("rn") == 1)), 1).otherwise(0)
    marked = rows.join(edges, [*key, "rn"], "left").withColumn("f", flag).drop("_edge")
    begun = F.when(F.col("f") == 1, F.col("rn"))
    fr = framed(marked, by_row, carry={"seg": ("sum", F.col("f")), "start": ("last", begun)})
    past_rows = fr.w.rowsBetween(Window.unboundedPreceding, -1)
    laid = fr.with_columns(seg=fr.running("seg", "sum", F.col("f")),
                           start=F.coalesce(F.last(begun, ignorenulls=True).over(past_rows), F.col("_c_start"))).body()
    both = (F.col("f") == 1) & (F.col("rn") > 1)
    own = F.struct("seg", F.when(F.col("f") == 1, F.col("rn")).otherwise(F.col("start")).alias("start"))
    last = F.struct((F.col("seg") - 1).alias("seg"), "start")
    laid = laid.withColumn("at", F.explode(F.when(both, F.array(own, last)).otherwise(F.array(own)))) \
        .drop("seg", "start").select("*", "at.seg", "at.start")
    laid = laid.withColumn("d1", F.when(F.col("rn") > F.col("start"), F.col("d"))).withColumn(
        "dp1", F.when(F.col("rn") > F.col("start") + 1, F.col("dp")))
    md = F.avg("d1")
    k = F.count("d1")
    c0 = F.sum(F.col("d1") * F.col("d1")) - k * md * md
    has = F.col("dp1").isNotNull()
    c1 = (F.sum(F.when(has, F.col("d1") * F.col("dp1"))) - md * F.sum(F.when(has, F.col("d1")))
          - md * F.sum("dp1") + F.count("dp1") * md * md)
    g = laid.groupBy(*key, "seg").agg(
        F.min("rn").alias("start"), F.max("rn").alias("end"), (F.avg("_y") + F.max("_mu")).alias("mean"),
        F.coalesce(F.stddev_samp("_y"), F.lit(0.0)).alias("vol"), k.alias("_k1"),
        F.when(c0 > 0, c1 / c0).otherwise(0.0).alias("_r1")).join(avg, key)
    v, a = F.col("vol"), F.col("avg_v")
    return g.withColumn("label", F.when(v > 1.3 * a, "high_vol").when(v < 0.7 * a, "low_vol").when(
        F.col("_k1") < 3, "low_vol").when(F.col("_r1") > 0.1, "trending").otherwise("mean_reverting")).drop(
        "avg_v", "_k1", "_r1")

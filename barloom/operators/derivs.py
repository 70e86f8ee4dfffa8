"""Derivatives tables: basis, funding, liquidation levels and cascades, open interest, option chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clamp, half_up, safe_div
from ..plans.blocks import Series, framed, tail
from ..plans.rank import at_ranks

# Share of open interest by leverage.
LEVERAGE_SHARE = {2: 0.15, 3: 0.15, 5: 0.20, 10: 0.20, 20: 0.15, 50: 0.10, 100: 0.05}


def basis_curve(futures: DataFrame, as_of, key=("symbol",)) -> DataFrame:
    """Basis per contract, annualised by days to expiry (at least 1). Columns: key, expiry, price, spot."""
    days = F.greatest((F.unix_micros("expiry") - F.unix_micros(F.lit(as_of).cast("timestamp"))) / 86_400_000_000, F.lit(1.0))
    f = futures.withColumn("basis", F.col("price") - F.col("spot")).withColumn("days", days)
    f = f.withColumn("basis_pct", safe_div(F.col("basis"), F.col("spot"), 0.0)).withColumn(
        "annualized", F.col("basis_pct") * 365 / F.col("days"))
    g = f.groupBy(*key).agg(F.max_by("basis", "expiry").alias("_last"), F.max(F.abs("basis")).alias("max_basis"))
    return f.join(g, list(key)).withColumn("contango", F.col("_last") > 0).withColumn(
        "backwardation", F.col("_last") < 0).drop("_last")


def funding_arb(rates: DataFrame, key=("symbol", "ts")) -> DataFrame:
    """Ordered venue pairs with a positive funding spread, net of both taker fees; a market has few venues."""
    key = list(key)
    a = rates.select(*key, F.col("venue").alias("long_venue"), F.col("rate").alias("rl"), F.col("taker_fee").alias("fl"))
    b = rates.select(*key, F.col("venue").alias("short_venue"), F.col("rate").alias("rs"), F.col("taker_fee").alias("fs"))
    j = a.join(b, key).filter((F.col("long_venue") != F.col("short_venue")) & (F.col("rs") > F.col("rl")))
    s = F.col("rs") - F.col("rl")
    return j.select(*key, "long_venue", "short_venue", s.alias("spread"), (s * 3 * 365).alias("annualized"),
                    (s - F.col("fl") - F.col("fs")).alias("net"))


def funding_sentiment(rates: DataFrame, series: Series, lookback: int = 100, x: str = "rate") -> DataFrame:
    """z and share strictly below of the last rate in its lookback, crowding label."""
    t = tail(rates, series, lookback).df
    w = Window.partitionBy(*series.key)
    t = t.withColumn("_cur", F.max(F.when(F.col("_rn") == F.col("_n"), F.col(x))).over(w))
    g = t.groupBy(*series.key).agg(
        F.max("_cur").alias("rate"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"),
        F.avg(F.when(F.col(x) < F.col("_cur"), 1.0).otherwise(0.0)).alias("percentile"))
    z = safe_div(F.col("rate") - F.col("mean"), F.col("sd"), 0.0)
    return (g.withColumn("z", z).withColumn("extreme", F.least(F.lit(1.0), F.abs("z") / 3))
            .withColumn("sentiment", F.when(F.col("z") > 1.5, "crowded_long").when(F.col("z") < -1.5, "crowded_short")
                        .otherwise("neutral")).withColumn("mean_revert", F.abs("z") > 2))


def liquidation_levels(markets: DataFrame, maintenance: float = 0.005, share: dict[int, float] | None = None) -> DataFrame:
    """Long and short liquidation levels per market (symbol, price, open_interest) and leverage bucket."""
    share = share or LEVERAGE_SHARE
    lev = F.array(*[F.struct(F.lit(k).alias("leverage"), F.lit(v).alias("weight")) for k, v in share.items()
                    if 1 / k - maintenance > 0])
    e = markets.withColumn("l", F.explode(lev)).withColumn("dist", 1 / F.col("l.leverage") - maintenance)
    e = e.withColumn("side", F.explode(F.array(F.lit("long"), F.lit("short"))))
    px = F.when(F.col("side") == "long", F.col("price") * (1 - F.col("dist"))).otherwise(F.col("price") * (1 + F.col("dist")))
    return e.select("symbol", "price", F.col("l.leverage").alias("leverage"), "side", px.alias("level"),
                    (F.col("open_interest") * F.col("l.weight") / 2).alias("size"), F.col("dist").alias("distance_pct")).filter("level > 0")


def density_zones(levels: DataFrame) -> DataFrame:
    """Greedy 2 % zones of each market's levels, the five largest; a market has two levels per bucket."""
    a = levels.groupBy("symbol").agg(F.max("price").alias("price"), F.sort_array(F.collect_list(F.struct("level", "size"))).alias("a"))
    width = F.col("price") * 0.02
    zone = "array<struct<lo:double,hi:double,size:double>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        inside = (F.size(acc) > 0) & (x.level <= last.hi)
        grown = F.struct(last.lo.alias("lo"), last.hi.alias("hi"), (last["size"] + x["size"]).alias("size"))
        new = F.struct(x.level.alias("lo"), (x.level + width).alias("hi"), x["size"].alias("size"))
        return F.when(inside, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(
            F.concat(acc, F.array(new)))

    z = F.aggregate("a", F.array().cast(zone), add)
    top = F.slice(F.sort_array(F.transform(z, lambda v, i: F.struct((-v["size"]).alias("k"), i.alias("i"), v.lo.alias("lo"),
                                                                  v.hi.alias("hi"), v["size"].alias("size")))), 1, 5)
    return a.select("symbol", F.posexplode(top).alias("rank", "z")).select("symbol", "rank", "z.lo", "z.hi", "z.size")


def cascade_paths(levels: DataFrame, markets: DataFrame) -> DataFrame:
    """Stages reached down through longs and up through shorts: each level must be reached by the impact before it.

    ``levels``: symbol, price, size, side, seq. ``markets``: symbol, spot, depth.
    """
    j = levels.join(markets.select("symbol", "spot", "depth"), "symbol")
    down = F.col("side") == "long"
    j = j.filter((down & (F.col("price") < F.col("spot"))) | (~down & (F.col("price") > F.col("spot"))))
    far = F.abs(F.col("price") - F.col("spot"))
    j = j.withColumn("far", far)
    s = Series(("symbol", "side"), ("far", "seq"), lambda: F.floor(F.log2(F.col("far") + 1e-9) * 64))
    fr = framed(j, s, carry={"v": ("sum", F.col("size"))})
    j = fr.with_columns(_before=fr.running("v", "sum", F.col("size"), inclusive=False)).body(keep_rn=True)
    shift = F.col("_before") / F.when(F.col("depth") == 0, 1.0).otherwise(F.col("depth")) * 0.5
    hit = F.when(F.col("side") == "long", F.col("spot") * (1 - shift) <= F.col("price")).otherwise(
        F.col("spot") * (1 + shift) >= F.col("price"))
    j = j.withColumn("_miss", F.when((F.col("_rn") > 1) & ~hit, F.col("_rn")))
    stop = j.groupBy("symbol", "side").agg(F.min("_miss").alias("_stop"))
    ok = j.join(stop, ["symbol", "side"]).filter(F.col("_stop").isNull() | (F.col("_rn") < F.col("_stop")))
    return ok.groupBy("symbol", "side").agg(
        F.count(F.lit(1)).alias("stages"), F.sum("size").alias("liquidated"), F.min_by("price", F.struct("far", "seq")).alias("trigger"),
        (F.max("far") / F.max("spot")).alias("impact"))


def cascade(levels: DataFrame, markets: DataFrame) -> DataFrame:
    """Cascade score and risk level per market. ``markets`` also has daily_volume."""
    p = cascade_paths(levels, markets).groupBy("symbol").agg(F.max("stages").alias("depth_stages"), F.max("impact").alias("impact"))
    tot = levels.groupBy("symbol").agg(F.sum("size").alias("_t"))
    g = markets.join(tot, "symbol").join(p, "symbol", "left").na.fill(0)
    ratio = F.col("_t") / F.when(F.col("daily_volume") == 0, 1.0).otherwise(F.col("daily_volume"))
    score = F.least(F.lit(100.0), F.col("depth_stages") * 15 + ratio * 30 + F.col("impact") * 200)
    return g.select("symbol", "depth_stages", "impact", score.alias("score"), F.when(score >= 75, "critical").when(
        score >= 50, "high").when(score >= 25, "medium").otherwise("low").alias("risk"))


def leverage_heatmap(positions: DataFrame, markets: DataFrame, bands: int = 20) -> DataFrame:
    """Liquidation size per 1 % price band around spot (half-open bands, empty ones included)."""
    p = positions.join(markets.select("symbol", "spot"), "symbol")
    liq = F.when(F.col("side") == "long", F.col("price") * (1 - 1 / F.col("leverage"))).otherwise(
        F.col("price") * (1 + 1 / F.col("leverage")))
    width = F.col("spot") * 0.01
    p = p.withColumn("band", F.floor((liq - (F.col("spot") - width * bands / 2)) / width)).filter(
        (F.col("band") >= 0) & (F.col("band") < bands))
    part = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0.0))
    g = p.groupBy("symbol", "band").agg(part("long").alias("longs"), part("short").alias("shorts"))
    d = markets.select("symbol", "spot").withColumn("band", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))))
    d = d.join(g, ["symbol", "band"], "left").na.fill(0.0, ["longs", "shorts"])
    w = Window.partitionBy("symbol")
    raw = F.col("longs") + F.col("shorts")
    sl, ss = F.sum("longs").over(w), F.sum("shorts").over(w)
    return d.withColumn("intensity", raw / F.greatest(F.max(raw).over(w), F.lit(1.0))).withColumn(
        "price_from", F.col("spot") + (F.col("band") - bands / 2) * F.col("spot") * 0.01).withColumn(
        "asymmetry", F.when(sl + ss == 0, 0.0).otherwise((sl - ss) / (sl + ss)))


def liq_heatmap_book(book: DataFrame, leverages=(2, 3, 5, 10, 25, 50, 100), key=("venue", "symbol", "ts")) -> DataFrame:
    """Book volume within half a percent of each leverage's liquidation prices, per snapshot."""
    from .book import best_quotes

    key = list(key)
    q = best_quotes(book, key).filter("mid is not null").select(*key, "mid")
    lv = q.withColumn("leverage", F.explode(F.array(*[F.lit(x) for x in leverages])))
    lv = lv.withColumn("long_liq", F.col("mid") * (1 - 1 / F.col("leverage"))).withColumn(
        "short_liq", F.col("mid") * (1 + 1 / F.col("leverage")))
    tol = F.col("mid") * 0.005
    near = lambda side, col: F.sum(F.when((F.col("side") == side) & (F.abs(F.col("price") - F.col(col)) <= tol), F.col("qty"))
                                   .otherwise(0.0))
    g = lv.join(book, key).groupBy(*key, "leverage", "mid", "long_liq", "short_liq").agg(
        near("bid", "long_liq").alias("bid_volume"), near("ask", "short_liq").alias("ask_volume"))
    return g.withColumn("long_liq", half_up(F.col("long_liq"), 2)).withColumn("short_liq", half_up(F.col("short_liq"), 2))


def liq_clusters(heat: DataFrame, key=("venue", "symbol", "ts")) -> DataFrame:
    """Runs of liquidation prices with gaps of at most 2 % of mid (one row per leverage and side inside a snapshot)."""
    side = lambda s, c, v: F.struct(F.lit(s).alias("side"), F.col(c).alias("p"), F.col(v).alias("v"))
    e = heat.withColumn("e", F.explode(F.array(side("long", "long_liq", "bid_volume"), side("short", "short_liq", "ask_volume")))) \
        .select(*key, "mid", "e.*").filter("p > 0")
    w = Window.partitionBy(*key, "side").orderBy("p")
    new = F.when(F.col("p") - F.lag("p").over(w) <= F.col("mid") * 0.02, 0).otherwise(1)
    e = e.withColumn("_n", new).withColumn("cluster", F.sum("_n").over(w))
    return e.groupBy(*key, "side", "cluster").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.sum("v").alias("volume"))


def oi_analysis(oi: DataFrame, series: Series) -> DataFrame:
    """Half-on-half change, price correlation, build-up and deleveraging flags, 1/3/5-row readings."""
    key = list(series.key)
    r = framed(oi, series).body(keep_rn=True)
    half, last = F.floor(F.col("_n") / 2), F.col("_n") - F.col("_rn")
    at = lambda c, k: F.max(F.when(last == k, F.col(c)))
    aggs = [F.max("_n").alias("n"), F.avg(F.when(F.col("_rn") <= half, F.col("open_interest"))).alias("_a"),
            F.avg(F.when(F.col("_rn") > half, F.col("open_interest"))).alias("_b"),
            F.coalesce(F.corr("open_interest", "price"), F.lit(0.0)).alias("corr"),
            (F.stddev_samp("price") / F.avg("price")).alias("_pv"), F.avg("funding_rate").alias("_f"),
            F.avg(F.when(last < 3, F.col("funding_rate"))).alias("_f3")]
    aggs += [at(c, k).alias(f"_{c[0]}{k}") for c in ("open_interest", "price") for k in (0, 1, 3, 5)]
    g = r.groupBy(*key).agg(*aggs).filter("n >= 2")
    chg = F.when(F.col("_a") == 0, 0.0).otherwise((F.col("_b") - F.col("_a")) / F.col("_a"))
    g = g.withColumn("oi_change", chg)
    turn = (F.abs("_f") > 0) & (F.signum("_f3") != F.signum("_f"))
    c = F.col("oi_change")
    g = (g.withColumn("trend", F.when(c > 0.05, "increasing").when(c < -0.05, "decreasing").otherwise("stable"))
         .withColumn("build_up", (c > 0.1) & (F.col("_pv") < 0.05)).withColumn("deleveraging", (c < -0.1) | ((c < -0.05) & turn))
         .withColumn("long_ratio", 0.5 + clamp(F.col("_f") * 100, -0.4, 0.4)))
    for k in (1, 3, 5):
        d = lambda s: F.when(F.col(f"_{s}{k}") == 0, 0.0).otherwise((F.col(f"_{s}0") - F.col(f"_{s}{k}")) / F.col(f"_{s}{k}"))
        o, p = d("o"), d("p")
        g = g.withColumn(f"reading_{k}", F.when(F.col("n") > k, F.when((o > 0) & (p > 0), "new_longs").when((o > 0) & (p < 0), "new_shorts")
                         .when((o < 0) & (p < 0), "long_liquidations").when((o < 0) & (p > 0), "short_liquidations").otherwise("neutral")))
    return g.drop(*[c for c in g.columns if c.startswith("_")])


def margin_call_grid(positions: DataFrame, shocks: list[float], key=("account",)) -> DataFrame:
    """Every account under every price shock. Columns: size, entry_price, leverage, maintenance_margin, side."""
    c = F.col
    e = positions.withColumn("shock", F.explode(F.array(*[F.lit(float(s)) for s in shocks])))
    notional = c("size") * c("entry_price")
    margin = notional / c("leverage")
    pnl = F.when(c("side") == "long", notional * c("shock")).otherwise(-notional * c("shock"))
    left = margin + pnl
    out = left < notional * c("maintenance_margin")
    z = F.lit(0.0)
    return e.groupBy(*key, "shock").agg(
        F.sum(F.when(out, 1).otherwise(0)).alias("n_liquidated"),
        F.sum(F.when(out, F.greatest(z, margin - F.greatest(z, left))).otherwise(0.0)).alias("loss"),
        F.sum(F.when(out, -margin).otherwise(pnl)).alias("pnl"), F.sum(F.when(out, z).otherwise(left)).alias("surviving_margin"))


def worst_shock(grid: DataFrame, key=("account",)) -> DataFrame:
    return grid.groupBy(*key).agg(F.min_by("shock", F.struct(-F.col("loss"), F.col("shock"))).alias("shock"), F.max("loss").alias("loss"))


def effective_leverage(positions: DataFrame, equity: DataFrame, key=("account",)) -> DataFrame:
    """Gross, net and one-sided leverage. ``positions``: key, notional, margin. ``equity``: key, equity."""
    n = F.col("notional")
    g = positions.groupBy(*key).agg(F.sum(F.abs(n)).alias("_g"), F.sum("margin").alias("margin_used"),
                                    F.sum(F.when(n >= 0, n).otherwise(0.0)).alias("_l"), F.sum(F.when(n < 0, -n).otherwise(0.0)).alias("_s"))
    g = g.join(equity, list(key))
    eq = F.when(F.col("equity") == 0, 1.0).otherwise(F.col("equity"))
    inf = F.lit(float("inf"))
    free = F.greatest(F.lit(0.0), F.col("equity") - F.col("margin_used"))
    return g.select(*key, (F.col("_g") / eq).alias("gross"), (F.abs(F.col("_l") - F.col("_s")) / eq).alias("net"),
                    (F.col("_l") / eq).alias("long"), (F.col("_s") / eq).alias("short"), "margin_used", free.alias("free_margin"),
                    F.when(F.col("margin_used") == 0, inf).otherwise(F.col("equity") / F.col("margin_used")).alias("margin_level"),
                    F.when(F.col("_g") == 0, inf).otherwise(free / F.col("_g")).alias("distance"))


def liq_flow(levels: DataFrame, markets: DataFrame, direction: str, magnitude: float) -> DataFrame:
    """Size triggered by a move of the given magnitude and its cascade multiplier."""
    j = levels.join(markets.select("symbol", "spot"), "symbol")
    target = F.col("spot") * (1 - magnitude if direction == "down" else 1 + magnitude)
    hit = F.col("price").between(target, F.col("spot")) & (F.col("side") == "long") if direction == "down" else \
        F.col("price").between(F.col("spot"), target) & (F.col("side") == "short")
    g = j.groupBy("symbol").agg(F.max("spot").alias("spot"), F.sum(F.when(hit, F.col("size")).otherwise(0.0)).alias("total_flow"),
                                F.sum(F.when(hit, 1).otherwise(0)).alias("n_levels"))
    mult = F.when(F.col("n_levels") <= 1, 1.0).otherwise(1 + F.log2(F.greatest(F.col("n_levels"), F.lit(1))) * 0.3)
    return g.withColumn("multiplier", mult).withColumn("slippage", F.least(
        F.lit(0.1), F.col("total_flow") / (F.col("spot") * 1000) * 0.01)).withColumn(
        "flow", F.lit("sell" if direction == "down" else "buy")).drop("spot")


def vol_surface(chain: DataFrame, key=("underlying",)) -> DataFrame:
    """At-the-money iv per expiry (strike at index floor(n/2)) with the skew and excess kurtosis of all ivs."""
    key = list(key)
    strikes = at_ranks(chain, [*key, "expiry"], "strike", {"atm": lambda n: F.floor(n / 2)})
    atm = chain.join(strikes, [*key, "expiry"]).filter("strike = atm").groupBy(*key, "expiry", "n").agg(
        F.min_by("iv", "seq").alias("atm_iv"), F.first("atm").alias("atm_strike"))
    m = chain.groupBy(*key).agg(F.avg("iv").alias("_m"), F.stddev_samp("iv").alias("_s"), F.count("iv").alias("_n"))
    z = (F.col("iv") - F.col("_m")) / F.col("_s")
    mom = chain.join(m.filter("_s > 0 AND _n > 2"), key).groupBy(*key).agg(
        F.avg(z * z * z).alias("skew"), (F.avg(z * z * z * z) - 3).alias("kurtosis"))
    return atm.join(mom, key, "left").na.fill(0.0, ["skew", "kurtosis"])


def skew_metrics(chain: DataFrame, key=("underlying", "expiry")) -> DataFrame:
    """Risk reversal and butterfly from the ivs nearest to the 25, 50 and 75 % strikes."""
    key = list(key)
    q = at_ranks(chain, key, "strike", {"k25": lambda n: F.floor(n * 0.25), "k50": lambda n: F.floor(n * 0.5),
                                       "k75": lambda n: F.floor(n * 0.75)})
    j = chain.join(q.drop("n"), key)
    put, call = F.col("type") == "put", F.col("type") == "call"
    near = lambda cond, k: F.min_by("iv", F.when(cond, F.struct(F.abs(F.col("strike") - F.col(k)).alias("d"), F.col("strike"), F.col("seq"))))
    g = j.groupBy(*key).agg(near(put, "k25").alias("_p"), near(call, "k75").alias("_c"), near(F.lit(True), "k50").alias("_a"),
                            F.avg(F.when(put, F.col("iv"))).alias("_pi"), F.avg(F.when(call, F.col("iv"))).alias("_ci"))
    ok = F.col("_pi").isNotNull() & F.col("_ci").isNotNull()
    z = lambda c: F.when(ok, c).otherwise(0.0)
    return g.select(*key, z(F.col("_c") - F.col("_p")).alias("risk_reversal"), z((F.col("_c") + F.col("_p")) / 2 - F.col("_a")).alias("butterfly"),
                    z(F.when(F.col("_ci") > 0, F.col("_pi") / F.col("_ci") - 1).otherwise(0.0)).alias("skew_index"),
                    z(F.col("_pi") - F.col("_ci")).alias("put_call_skew"))


def greeks_exposure(positions: DataFrame, key=("underlying",)) -> DataFrame:
    return positions.groupBy(*key).agg(*[F.sum(F.col(g) * F.col("quantity")).alias(g) for g in ("delta", "gamma", "theta", "vega")])


def max_pain(chain: DataFrame, key=("underlying", "expiry")) -> DataFrame:
    """Strike with the least total intrinsic value times open interest, lowest on ties.

    Pain at a strike is a difference of running sums over the sorted strikes, so
    strikes never meet each other in pairs.
    """
    key = list(key)
    oi = lambda t: F.sum(F.when(F.col("type") == t, F.col("open_interest")).otherwise(0.0))
    s = chain.groupBy(*key, "strike").agg(oi("call").alias("c"), oi("put").alias("p"))
    k = F.col("strike")
    tot = s.groupBy(*key).agg(F.sum("p").alias("tp"), F.sum(F.col("p") * k).alias("tpk"))
    ser = Series(tuple(key), ("strike",), lambda: F.floor(F.col("strike")))
    carry = {"c": F.col("c"), "ck": F.col("c") * k, "p": F.col("p"), "pk": F.col("p") * k}
    fr = framed(s, ser, carry={n: ("sum", e) for n, e in carry.items()})
    r = fr.with_columns(**{f"r_{n}": fr.running(n, "sum", e) for n, e in carry.items()}).body().join(tot, key)
    pain = k * F.col("r_c") - F.col("r_ck") + (F.col("tpk") - F.col("r_pk")) - k * (F.col("tp") - F.col("r_p"))
    return r.withColumn("pain", pain).groupBy(*key).agg(
        F.min_by("strike", F.struct(F.round("pain", 6), "strike")).alias("max_pain"), F.min("pain").alias("pain"))

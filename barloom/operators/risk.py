"""Portfolio risk: covariance shares, exposures, limits, stress, rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import half_up, log_growth, safe_div
from ..plans.blocks import framed, time_series
from ..plans.rank import with_row
from .factors import both_triangles

# One-sided z by confidence, highest match first.
Z_TABLE = ((0.99, 2.326), (0.975, 1.960), (0.95, 1.645), (0.90, 1.282))
STABLE = ("USDT", "USD", "USDC")
# Historical shock scenarios by currency.
SCENARIOS = {
    "btc_crash_2022": {"BTC": -0.65, "ETH": -0.72, "SOL": -0.85, "AVAX": -0.80, "LINK": -0.70, "default": -0.60},
    "luna_collapse": {"BTC": -0.30, "ETH": -0.35, "SOL": -0.45, "AVAX": -0.40, "default": -0.35},
    "ftx_contagion": {"BTC": -0.25, "ETH": -0.30, "SOL": -0.60, "FTT": -0.97, "default": -0.30},
    "flash_crash": {"BTC": -0.15, "ETH": -0.20, "SOL": -0.25, "default": -0.18},
}


def z_for(confidence: float) -> float:
    return next((z for c, z in Z_TABLE if confidence >= c), 1.645)


def cov_weights(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Per symbol: weight, (Cov w), own variance and the portfolio variance. ``cov`` holds a <= b."""
    full = both_triangles(cov)
    w = weights.select("symbol", "weight")
    j = full.join(w.select(F.col("symbol").alias("b"), F.col("weight").alias("wb")), "b")
    g = j.groupBy(F.col("a").alias("symbol")).agg(
        F.sum(F.col("cov") * F.col("wb")).alias("cov_w"), F.max(F.when(F.col("a") == F.col("b"), F.col("cov"))).alias("c_ii"))
    g = w.join(g, "symbol")
    tot = g.agg(F.greatest(F.sum(F.col("weight") * F.col("cov_w")), F.lit(0.0)).alias("port_var"))
    return with_row(g, tot).withColumn("sigma", F.sqrt("port_var"))


def component_var(cov: DataFrame, weights: DataFrame, confidence: float = 0.95) -> DataFrame:
    g, z = cov_weights(cov, weights), z_for(confidence)
    return g.select("symbol", "weight", (z * F.col("sigma")).alias("portfolio_var"),
                    F.when(F.col("sigma") == 0, 0.0).otherwise(z * F.col("weight") * F.col("cov_w") / F.col("sigma"))
                    .alias("component_var"),
                    F.when(F.col("sigma") == 0, 0.0).otherwise(F.col("weight") * F.col("cov_w") / F.col("port_var"))
                    .alias("share"))


def marginal_var(cov: DataFrame, weights: DataFrame, portfolio_var: float) -> DataFrame:
    g = cov_weights(cov, weights)
    m = F.when(F.col("sigma") == 0, 0.0).otherwise(F.col("cov_w") / F.col("port_var") * portfolio_var)
    g = g.withColumn("marginal_var", m).withColumn("component_var", F.col("weight") * F.col("marginal_var"))
    return g.withColumn("share", F.lit(0.0) if portfolio_var == 0 else F.col("component_var") / portfolio_var).select(
        "symbol", "weight", "marginal_var", "component_var", "share")


def incremental_var(cov: DataFrame, weights: DataFrame, confidence: float = 0.95) -> DataFrame:
    """VaR change when a position is removed, in closed form, and its diversification benefit."""
    g, z = cov_weights(cov, weights), z_for(confidence)
    w, c = F.col("weight"), F.col("c_ii")
    rest = F.greatest(F.col("port_var") - 2 * w * F.col("cov_w") + w * w * c, F.lit(0.0))
    inc = z * (F.col("sigma") - F.sqrt(rest))
    return g.select("symbol", "weight", inc.alias("incremental_var"), (
        z * F.abs(w) * F.sqrt(F.greatest(c, F.lit(0.0))) - inc).alias("diversification"))


def risk_decomposition(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: total, systematic and diagonal risk, diversification ratio."""
    g = cov_weights(cov, weights)
    w, c = F.col("weight"), F.greatest(F.col("c_ii"), F.lit(0.0))
    s = g.agg(F.max("port_var").alias("v"), F.sum(w * w * c).alias("d"), F.sum(F.abs(w) * F.sqrt(c)).alias("u"))
    total = F.sqrt("v")
    return s.select(total.alias("total_risk"), F.sqrt(F.greatest(F.col("v") - F.col("d"), F.lit(0.0))).alias("systematic_risk"),
                    F.sqrt("d").alias("idiosyncratic_risk"),
                    F.when(total == 0, 1.0).otherwise(F.col("u") / total).alias("diversification_ratio"))


def risk_contributions(cov: DataFrame, weights: DataFrame) -> DataFrame:
    g = cov_weights(cov, weights)
    m = F.when(F.col("sigma") == 0, 0.0).otherwise(F.col("cov_w") / F.col("sigma"))
    return g.select("symbol", (F.col("weight") * m).alias("risk"), m.alias("marginal_risk"))


def sector_exposure(holdings: DataFrame, sector_returns: DataFrame, key=()) -> DataFrame:
    """Weight and return contribution by sector with concentration and Herfindahl index.

    ``holdings``: key, symbol, weight, sector. ``sector_returns``: sector, total_return.
    """
    key = list(key)
    s = holdings.groupBy(*key, "sector").agg(F.sum("weight").alias("weight"))
    s = s.join(sector_returns, "sector", "left").withColumn(
        "contribution", F.col("weight") * F.coalesce("total_return", F.lit(0.0))).drop("total_return")
    stats = [F.max(F.abs("weight")).alias("concentration"), F.sum(F.col("weight") * F.col("weight")).alias("herfindahl")]
    if key:
        return s.join(s.groupBy(*key).agg(*stats), key)
    return with_row(s, s.agg(*stats))


def resolve_price(currency: Column, last: Column, stable=STABLE) -> Column:
    return F.when(currency.isin(*stable), 1.0).otherwise(F.coalesce(last, F.lit(0.0)))


def valued(balances: DataFrame, tickers: DataFrame, stable=STABLE) -> DataFrame:
    """Balances with price and value. ``tickers`` is keyed by currency."""
    t = tickers.select("currency", "last")
    return balances.join(t, "currency", "left").withColumn("price", resolve_price(F.col("currency"), F.col("last"), stable)) \
        .withColumn("value", F.col("total") * F.col("price")).drop("last")


def portfolio_exposure(balances: DataFrame, tickers: DataFrame, stable=STABLE, key=("account",)) -> DataFrame:
    v = valued(balances, tickers, stable).filter("total <> 0")
    val = F.col("value")
    long_ = F.sum(F.when(val > 0, val).otherwise(0.0))
    short = F.sum(F.when(val <= 0, -val).otherwise(0.0))
    g = v.groupBy(*key).agg(
        F.sum(F.abs("value")).alias("total_value"), long_.alias("long_exposure"), short.alias("short_exposure"),
        (long_ - short).alias("net_exposure"), F.when(short > 0, long_ / short).alias("long_short_ratio"),
        F.sum(F.when(F.abs("value") > 1, 1).otherwise(0)).alias("n_positions"),
        F.max_by(val, F.struct(F.abs("value"), "currency")).alias("_top"))
    return g.withColumn("top_weight", F.when(F.col("total_value") > 0, F.col("_top") / F.col("total_value") * 100)
                        .otherwise(0.0)).drop("_top")


def pre_trade_check(balances: DataFrame, tickers: DataFrame, orders: DataFrame, max_position_pct: float,
                    stable=STABLE, key=("account",)) -> DataFrame:
    """GO / NO_GO per order with the names of failed checks. ``orders``: key, order_id, side, amount, price, quote."""
    key = list(key)
    v = valued(balances, tickers, stable)
    tot = v.groupBy(*key).agg(F.sum(F.abs("value")).alias("portfolio_value"))
    free = balances.select(*key, F.col("currency").alias("quote"), "free")
    o = orders.join(tot, key, "left").join(free, [*key, "quote"], "left").na.fill(0.0, ["portfolio_value", "free"])
    o = o.withColumn("order_value", F.col("amount") * F.col("price"))
    pct = F.when(F.col("portfolio_value") > 0, F.col("order_value") / F.col("portfolio_value") * 100).otherwise(100.0)
    o = o.withColumn("order_pct", pct)
    failed = F.array_compact(F.array(
        F.when(F.col("order_pct") > max_position_pct, "position_size"), F.when(F.col("order_value") <= 0, "order_value"),
        F.when(F.col("portfolio_value") <= 0, "portfolio_exists"),
        F.when((F.col("side") == "buy") & (F.col("free") < F.col("order_value")), "sufficient_balance")))
    return o.withColumn("failed", failed).withColumn("decision", F.when(F.size("failed") == 0, "GO").otherwise("NO_GO"))


def scenario_table(spark, scenarios: dict[str, dict[str, float]] = SCENARIOS) -> DataFrame:
    rows = [(s, c, float(x)) for s, m in scenarios.items() for c, x in m.items()]
    return spark.createDataFrame(rows, "scenario string, currency string, shock double")


MAX_SHOCKS = 100_000


def stress_test(balances: DataFrame, tickers: DataFrame, scenarios: DataFrame, max_drawdown_pct: float,
                stable=STABLE, key=("account",)) -> DataFrame:
    """Loss of every account in every scenario; a currency without a shock takes the default.

    The scenarios travel as one row; more than ``MAX_SHOCKS`` of them raise ValueError.
    """
    if scenarios.limit(MAX_SHOCKS + 1).count() > MAX_SHOCKS:
        raise ValueError(f"more than {MAX_SHOCKS} shocks")
    v = valued(balances, tickers, stable).filter("total <> 0")
    shocks = scenarios.groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct("currency", "shock"))).alias("m")) \
        .agg(F.collect_list(F.struct("scenario", "m")).alias("all"))
    e = with_row(v, shocks).withColumn("s", F.explode("all"))
    chg = F.coalesce(F.try_element_at("s.m", F.col("currency")), F.try_element_at("s.m", F.lit("default")), F.lit(0.0))
    g = e.groupBy(*key, F.col("s.scenario").alias("scenario")).agg(
        F.sum("value").alias("current_value"), F.sum(F.col("value") * (1 + chg)).alias("stressed_value"))
    loss = F.col("current_value") - F.col("stressed_value")
    pct = F.when(F.col("current_value") > 0, loss / F.col("current_value") * 100).otherwise(0.0)
    return g.withColumn("loss", loss).withColumn("loss_pct", pct).withColumn("survivable", pct < max_drawdown_pct)


def portfolio_returns(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted return per ts at which every weighted symbol has a return."""
    w = weights.select("symbol", "weight")
    j = rets.select("symbol", "ts", "ret").join(w, "symbol")
    g = j.groupBy("ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.count(F.lit(1)).alias("_k"))
    return with_row(g, w.agg(F.count(F.lit(1)).alias("_n"))).filter("_k = _n").select("ts", "ret")


def portfolio_risk(rets: DataFrame, weights: DataFrame, value: float, confidence: float = 0.95,
                   periods: int = 365, rf: float = 0.05) -> DataFrame:
    """One row: weighted volatility, drawdown of the compounded path, Sharpe and parametric VaR."""
    from .stats import sharpe_col

    p = portfolio_returns(rets, weights).withColumn("_all", F.lit(0))
    ser = time_series(("_all",), ("ts",), 365 * 86_400)
    fr = framed(p, ser, carry={"l": ("sum", log_growth(1 + F.col("ret")))})
    path = fr.with_columns(value=F.exp(fr.running("l", "sum", log_growth(1 + F.col("ret"))))).body()
    # the path starts at 1 before the first return
    fr = framed(path, ser, carry={"peak": ("max", F.col("value"))})
    dd = fr.with_columns(_pk=F.greatest(F.lit(1.0), fr.running("peak", "max", F.col("value")))).body()
    z = 2.326 if confidence == 0.99 else 1.645
    sd = F.coalesce(F.stddev_samp("ret"), F.lit(0.0))
    return dd.agg(F.count("ret").alias("n_obs"), F.avg("ret").alias("mean"), (sd * periods ** 0.5).alias("annual_vol"),
                  F.max((F.col("_pk") - F.col("value")) / F.col("_pk")).alias("max_drawdown"),
                  sharpe_col(F.col("ret"), rf, periods).alias("sharpe"), (sd * value * z).alias("var"))


def rebalance_trades(holdings: DataFrame, targets: DataFrame, key=("account",)) -> DataFrame:
    """Trades from holdings (key, symbol, amount, price) to target weights (key, symbol, weight, price)."""
    key = list(key)
    h = holdings.select(*key, "symbol", (F.col("amount") * F.col("price")).alias("cur"), F.col("price").alias("p1"))
    tot = h.groupBy(*key).agg(F.sum("cur").alias("portfolio_value"))
    t = targets.select(*key, "symbol", F.col("weight").alias("target"), F.col("price").alias("p2"))
    j = h.join(t, [*key, "symbol"], "full_outer").na.fill(0.0, ["cur", "target"]).join(tot, key)
    delta = F.col("portfolio_value") * F.col("target") - F.col("cur")
    price = F.coalesce("p1", "p2")
    j = j.filter("portfolio_value > 0").withColumn("delta", delta).filter((F.abs("delta") >= 1) & (price > 0))
    return j.select(*key, "symbol", F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"),
                    (F.abs("delta") / price).alias("amount"), half_up(F.abs("delta"), 2).alias("notional"),
                    (F.abs("delta") / F.col("portfolio_value") * 100).alias("turnover_pct"))


def rebalance_costed(current: DataFrame, target: DataFrame, cost: float = 0.001, min_trade: float = 0.005,
                     key=("account",)) -> DataFrame:
    """Weight changes with small or too costly trades skipped, and the weights that result."""
    key = list(key)
    c = current.select(*key, "symbol", F.col("weight").alias("cur"))
    t = target.select(*key, "symbol", F.col("weight").alias("tgt"))
    j = c.join(t, [*key, "symbol"], "full_outer").na.fill(0.0, ["cur", "tgt"])
    d = F.abs(F.col("tgt") - F.col("cur"))
    skip = (d < min_trade) | (d <= 2 * d * cost)
    return j.withColumn("skipped", skip).withColumn("trade", F.when(skip, 0.0).otherwise(F.col("tgt") - F.col("cur"))) \
        .withColumn("new_weight", F.when(skip, F.col("cur")).otherwise(F.col("tgt"))).withColumn(
        "est_cost", F.abs("trade") * cost)


def drawdown_monitor(equity: DataFrame, max_drawdown_pct: float) -> DataFrame:
    """``equity``: key, current, peak (null when unknown: 1.05 times the current value)."""
    peak = F.coalesce("peak", F.col("current") * 1.05)
    dd = (peak - F.col("current")) / peak * 100
    return equity.withColumn("drawdown_pct", dd).withColumn("recovery_pct", (peak / F.col("current") - 1) * 100).withColumn(
        "status", F.when(F.col("drawdown_pct") > max_drawdown_pct, "CRITICAL").when(
            F.col("drawdown_pct") > max_drawdown_pct * 0.7, "WARNING").otherwise("OK"))


def margin_health(balances: DataFrame, stable=STABLE, key=("account",)) -> DataFrame:
    s = F.col("currency").isin(*stable)
    part = lambda c: F.sum(F.when(s, F.col(c)).otherwise(0.0))
    g = balances.groupBy(*key).agg(part("total").alias("equity"), part("used").alias("used"))
    g = g.withColumn("margin_ratio", F.when(F.col("equity") > 0, F.col("used") / F.col("equity") * 100).otherwise(0.0))
    g = g.withColumn("health", F.greatest(F.lit(0.0), 100 - F.col("margin_ratio")))
    return g.withColumn("status", F.when(F.col("health") > 70, "HEALTHY").when(F.col("health") > 40, "CAUTION")
                        .otherwise("DANGER"))


def risk_dashboard(balances: DataFrame, tickers: DataFrame, max_pct: float = 40.0, stable=STABLE,
                   key=("account",)) -> DataFrame:
    """Top ten holdings per account with concentration and diversification lights."""
    key = list(key)
    v = valued(balances, tickers, stable).filter("total <> 0")
    tot = v.groupBy(*key).agg(F.sum(F.abs("value")).alias("portfolio_value"))
    h = v.filter(F.abs("value") > 1).join(tot, key).withColumn("pct", F.abs("value") / F.col("portfolio_value") * 100)
    g = h.groupBy(*key).agg(F.count(F.lit(1)).alias("n_positions"), F.max("pct").alias("top_pct"))
    w = Window.partitionBy(*key).orderBy(F.col("pct").desc(), "currency")
    top = h.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").join(g, key)
    p, n = F.col("top_pct"), F.col("n_positions")
    return top.withColumn("concentration", F.when(p > max_pct, "red").when(p > 0.7 * max_pct, "yellow").otherwise("green")) \
        .withColumn("diversification", F.when(n >= 5, "green").when(n >= 3, "yellow").otherwise("red"))


def equal_weight(symbols: DataFrame) -> DataFrame:
    s = symbols.select("symbol").distinct()
    return with_row(s, s.agg(F.count(F.lit(1)).alias("_n"))).select("symbol", (1 / F.col("_n")).alias("weight"))


def inverse_vol(rets: DataFrame) -> DataFrame:
    sd = F.coalesce(F.stddev_samp("ret"), F.lit(0.0))
    g = rets.groupBy("symbol").agg(F.when(sd > 0, 1 / sd).otherwise(0.0).alias("_i"))
    return with_row(g, g.agg(F.sum("_i").alias("_t"))).select("symbol", safe_div(F.col("_i"), F.col("_t"), 0.0).alias("weight"))


def risk_report(rets: DataFrame, confidence: float = 0.95, symbols: list[str] | None = None, pairwise: bool = False) -> DataFrame:
    """Per symbol of ``symbols`` (all by default) with equal weights: return statistics, component VaR and share of the portfolio VaR."""
    from .factors import covariance
    from .stats import series_stats

    rets = rets if symbols is None else rets.filter(F.col("symbol").isin(symbols))
    w = equal_weight(rets)
    s = series_stats(rets, ("symbol",)).select("symbol", "n_obs", "mean", "annualized_vol", "sharpe")
    return s.join(component_var(covariance(rets, pairwise=pairwise), w, confidence), "symbol")

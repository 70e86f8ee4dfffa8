"""Strategy signals, all-in/all-out backtests, parameter grids and walk-forward tests.

A strategy is a transform of an indicator table into a signal column (1 buy,
-1 sell, 0 hold). ``backtest`` keeps runs as columns of the blocked bars and sums
up each block for all runs at once; ``simulate`` gives a row per bar and run,
where the position is the last non-hold signal and equity a running product.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import half_up, log_growth, sample_sd
from ..plans.blocks import BLOCK_ROWS, Frame, Series, ema_lookback, framed, wilder_lookback
from ..plans.lineage import cut
from ..plans.rank import ranked
from ..sources.views import BAR_SERIES
from .indicators import add_stochastic, full, sma_col
from .recurrent import add_smoothed

# Default parameters of the nine strategies.
DEFAULTS: dict[str, dict[str, float]] = {
    "sma_crossover": {"fast": 10, "slow": 30},
    "rsi_mean_reversion": {"period": 14, "oversold": 30, "overbought": 70},
    "macd_momentum": {"fast": 12, "slow": 26, "signal": 9},
    "bollinger_breakout": {"period": 20, "sd": 2},
    "bollinger_mean_reversion": {"period": 20, "sd": 2},
    "ema_trend_following": {"period": 20},
    "stochastic_oscillator": {"k": 14, "d": 3, "oversold": 20, "overbought": 80},
    "adx_trend_strength": {"period": 14, "threshold": 25},
    "multi_indicator_confluence": {"rsi": 14, "sma": 20, "fast": 12, "slow": 26, "signal": 9, "votes": 2},
}
MS_YEAR = 365.25 * 86_400_000.0
Prepare = Callable[[Frame, dict], Frame]
Signal = Callable[[Frame, dict], Column]
STRATEGIES: dict[str, tuple[Callable[[dict], int], Prepare, Signal]] = {}


def register_strategy(name: str, lookback: Callable[[dict], int], prepare: Prepare, signal: Signal,
                      defaults: dict[str, float] | None = None) -> None:
    """Add a strategy: rows of history it needs, indicator columns it adds, and its signal column."""
    STRATEGIES[name] = (lookback, prepare, signal)
    DEFAULTS.setdefault(name, defaults or {})


def _missing(fr: Frame, **cols: Column) -> Frame:
    new = {k: v for k, v in cols.items() if k not in fr.df.columns}
    return fr.with_columns(**new) if new else fr


def _sides(buy: Column, sell: Column) -> Column:
    return F.when(buy, 1).when(sell, -1).otherwise(0)


def _crossed(fr: Frame, a: str | Column, b: str | Column) -> tuple[Column, Column]:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    pa, pb = F.lag(a).over(fr.w), F.lag(b).over(fr.w)
    return (pa <= pb) & (a > b), (pa >= pb) & (a < b)


def _smas(fr: Frame, p: dict, *names: str) -> Frame:
    return _missing(fr, **{f"sma_{int(p[n])}": sma_col(fr, "close", int(p[n])) for n in names})


def _bands(fr: Frame, p: dict) -> Frame:
    n = int(p["period"])
    fr = _smas(fr, p, "period")
    return _missing(fr, **{f"sd_{n}": full(fr, F.stddev_pop("close").over(fr.rows(-(n - 1))), n)})


def _band(p: dict, sign: int) -> Column:
    n = int(p["period"])
    return F.col(f"sma_{n}") + sign * float(p["sd"]) * F.col(f"sd_{n}")


def _smooth(names: Callable[[dict], dict[str, str]], **what) -> Prepare:
    """Smoothed indicators under names that carry their parameters, computed once per distinct set."""
    def prepare(fr: Frame, p: dict) -> Frame:
        wanted = names(p)
        if all(v in fr.df.columns for v in wanted.values()):
            return fr
        fr = add_smoothed(fr, **{k: f(p) for k, f in what.items()})
        renames = {k: v for k, v in wanted.items() if k != v}
        df = fr.df.withColumnsRenamed(renames).drop("dx")
        return Frame(df, fr.series, fr.carries)
    return prepare


def _i(p: dict, *names: str) -> tuple[int, ...]:
    return tuple(int(p[n]) for n in names)


def _tag(p: dict, *names: str) -> str:
    return "_".join(str(int(p[n])) for n in names)


_rsi_name = lambda p, key="period": f"rsi_{int(p[key])}"
_macd_names = lambda p: {c: f"{c}_{_tag(p, 'fast', 'slow', 'signal')}" for c in ("macd", "macd_signal", "macd_hist")}
_macd_prep = _smooth(_macd_names, macd=lambda p: _i(p, "fast", "slow", "signal"))

register_strategy("sma_crossover", lambda p: int(max(p["fast"], p["slow"])) + 1, lambda fr, p: _smas(fr, p, "fast", "slow"),
                  lambda fr, p: _sides(*_crossed(fr, f"sma_{int(p['fast'])}", f"sma_{int(p['slow'])}")))
register_strategy("rsi_mean_reversion", lambda p: wilder_lookback(int(p["period"])),
                  _smooth(lambda p: {"rsi": _rsi_name(p)}, rsi=lambda p: int(p["period"])),
                  lambda fr, p: _sides(F.col(_rsi_name(p)) < p["oversold"], F.col(_rsi_name(p)) > p["overbought"]))
register_strategy("macd_momentum", lambda p: ema_lookback(int(p["slow"]), int(p["signal"])) + 1, _macd_prep,
                  lambda fr, p: _sides(*_crossed(fr, _macd_names(p)["macd"], _macd_names(p)["macd_signal"])))
register_strategy("bollinger_breakout", lambda p: int(p["period"]) + 1, _bands,
                  lambda fr, p: _sides(_crossed(fr, F.col("close"), _band(p, 1))[0], _crossed(fr, F.col("close"), _band(p, -1))[1]))
register_strategy("bollinger_mean_reversion", lambda p: int(p["period"]), _bands,
                  lambda fr, p: _sides(F.col("close") <= _band(p, -1), F.col("close") >= _band(p, 1)))
register_strategy(
    "ema_trend_following", lambda p: ema_lookback(int(p["period"])) + 1,
    _smooth(lambda p: {f"ema_{int(p['period'])}": f"ema_{int(p['period'])}"}, emas=lambda p: {f"ema_{int(p['period'])}": int(p["period"])}),
    lambda fr, p: (lambda e, b: _sides((F.col("close") > e) & (e > b), (F.col("close") < e) & (e < b)))(
        F.col(f"ema_{int(p['period'])}"), F.lag(f"ema_{int(p['period'])}").over(fr.w)))


def _stoch(fr: Frame, p: dict) -> Frame:
    t = _tag(p, "k", "d")
    if f"stoch_k_{t}" in fr.df.columns:
        return fr
    fr = add_stochastic(fr, int(p["k"]), int(p["d"]))
    return Frame(fr.df.withColumnsRenamed({"stoch_k": f"stoch_k_{t}", "stoch_d": f"stoch_d_{t}"}), fr.series, fr.carries)


def _stoch_signal(fr: Frame, p: dict) -> Column:
    k = F.col(f"stoch_k_{_tag(p, 'k', 'd')}")
    up, dn = _crossed(fr, k, f"stoch_d_{_tag(p, 'k', 'd')}")
    return _sides(up & (k < p["oversold"]), dn & (k > p["overbought"]))


def _adx_signal(fr: Frame, p: dict) -> Column:
    n = int(p["period"])
    up, dn = _crossed(fr, f"plus_di_{n}", f"minus_di_{n}")
    strong = (F.col(f"adx_{n}") >= p["threshold"]) & (F.col("_rn") > 2 * n)
    return _sides(strong & up, strong & dn)


def _votes(fr: Frame, p: dict) -> Column:
    r, s, h = F.col(_rsi_name(p, "rsi")), F.col(f"sma_{int(p['sma'])}"), F.col(_macd_names(p)["macd_hist"])
    one = lambda c: F.when(c, 1).otherwise(0)
    bull = one(r < 40) + one(F.col("close") > s) + one(h > 0)
    bear = one(r > 60) + one(F.col("close") < s) + one(h < 0)
    start = max(int(p["rsi"]), int(p["sma"]) - 1, int(p["slow"]) + int(p["signal"]) - 2) + 1
    ready = F.col("_rn") > start
    return _sides(ready & (bull >= p["votes"]), ready & (bear >= p["votes"]))


register_strategy("stochastic_oscillator", lambda p: int(p["k"] + p["d"]) + 1, _stoch, _stoch_signal)
register_strategy("adx_trend_strength", lambda p: wilder_lookback(int(p["period"])) + int(p["period"]) + 1,
                  _smooth(lambda p: {c: f"{c}_{int(p['period'])}" for c in ("plus_di", "minus_di", "adx")}, adx=lambda p: int(p["period"])),
                  _adx_signal)
register_strategy("multi_indicator_confluence", lambda p: max(ema_lookback(int(p["slow"]), int(p["signal"])), wilder_lookback(int(p["rsi"]))) + 1,
                  lambda fr, p: _macd_prep(_smooth(lambda q: {"rsi": _rsi_name(q, "rsi")}, rsi=lambda q: int(q["rsi"]))(
                      _smas(fr, p, "sma"), p), p), _votes)


def grid(strategy: str, **values: list) -> list[tuple[str, dict]]:
    """Every combination of parameter values over the defaults of a strategy."""
    combos = [dict(DEFAULTS[strategy])]
    for name, vals in values.items():
        combos = [{**c, name: v} for c in combos for v in vals]
    return [(strategy, c) for c in combos]


def label(params: dict) -> str:
    return json.dumps({k: float(v) for k, v in sorted(params.items())}, separators=(",", ":"))


def signal_columns(bars: DataFrame, runs: list[tuple[str, dict]], series: Series = BAR_SERIES,
                   block_rows: int | None = None) -> tuple[Frame, list[tuple[str, dict]]]:
    """The bars in blocks with the signal of run i in column ``_sig<i>``; each distinct indicator is computed once."""
    runs = [(s, {**DEFAULTS[s], **p}) for s, p in runs]
    runs = [r for r in runs if not (r[0] == "sma_crossover" and r[1]["fast"] >= r[1]["slow"])]
    look = max(STRATEGIES[s][0](p) for s, p in runs)
    fr = framed(bars.select(*series.key, *series.order, "open", "high", "low", "close"), series, lookback=look, block_rows=block_rows)
    for s, p in runs:
        fr = STRATEGIES[s][1](fr, p)
    return fr.with_columns(**{f"_sig{i}": STRATEGIES[s][2](fr, p) for i, (s, p) in enumerate(runs)}), runs


def signal_table(bars: DataFrame, runs: list[tuple[str, dict]], series: Series = BAR_SERIES,
                 block_rows: int | None = None) -> DataFrame:
    """One row per (bar, run)."""
    fr, runs = signal_columns(bars, runs, series, block_rows)
    rows = fr.body()
    packed = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(label(p)).alias("params"), F.col(f"_sig{i}").alias("signal"))
                       for i, (s, p) in enumerate(runs)])
    return rows.select(*series.key, *series.order, "close", F.explode(packed).alias("r")).select(
        *series.key, *series.order, "close", "r.*")


def run_series(series: Series = BAR_SERIES) -> Series:
    return series.with_key("strategy", "params")


def simulate(signals: DataFrame, capital: float = 10_000.0, commission: float = 0.001, slippage: float = 0.0005,
             series: Series = BAR_SERIES, block_rows: int | None = None) -> DataFrame:
    """Position, equity, running peak and finished trades of every run, one row per bar.

    Three running aggregates build on each other; the rows are checkpointed
    between them, so the plan does not double with every pass.
    """
    signals = cut(signals)
    rs, c = run_series(series), F.col
    live = F.when(c("signal") != 0, c("signal"))
    fr = framed(signals, rs, lookback=1, carry={"s": ("last", live)}, block_rows=block_rows)
    now = F.coalesce(fr.running("s", "last", live), F.lit(-1)) == 1
    was = F.coalesce(fr.running("s", "last", live, inclusive=False), F.lit(-1)) == 1
    fr = fr.with_columns(pos=now, was=was, _p=F.lag("close").over(fr.w), last_bar=c("_rn") == c("_n"))
    move = F.when(c("was"), c("close") / c("_p")).otherwise(1.0)
    cost_in, cost_out = (1 - commission) / (1 + slippage), (1 - slippage) * (1 - commission)
    enter, leave = c("pos") & ~c("was"), (c("was") & ~c("pos")) | (c("pos") & c("last_bar"))
    rows = cut(fr.with_columns(enter=enter, leave=leave).body())
    gain = move * F.when(c("enter"), cost_in).otherwise(1.0) * F.when(c("leave"), cost_out).otherwise(1.0)
    rows = rows.withColumn("gain", gain).withColumn("_lg", log_growth(F.col("gain"))).drop("_p")
    fr = framed(rows, rs, carry={"e": ("sum", c("_lg"))}, block_rows=block_rows)
    eq = fr.running("e", "sum", c("_lg"))
    before = fr.running("e", "sum", c("_lg"), inclusive=False)
    rows = cut(fr.with_columns(equity=capital * F.exp(eq), _before=capital * F.exp(before)).body())
    ts = series.order[0]
    top = F.struct(c("equity").alias("v"), c(ts).alias("t"))
    # on the bar of entry the cash spent is the equity before it
    buy = F.when(c("enter"), F.struct(c(ts).alias("ts"), c("close").alias("px"), c("_before").alias("cash")))
    fr = framed(rows, rs, carry={"top": ("max", top), "buy": ("last", buy)}, block_rows=block_rows)
    rows = fr.with_columns(_top=fr.running("top", "max", top), _buy=fr.running("buy", "last", buy)).body()
    return (rows.withColumn("peak", F.greatest(F.lit(capital), c("_top.v")))
            .withColumn("peak_ts", F.when(c("_top.v") >= capital, c("_top.t")))
            .withColumn("entry", F.when(c("leave"), c("_buy"))).drop("_top", "_buy", "_lg", "_before"))


def trades(sim: DataFrame, commission: float = 0.001, slippage: float = 0.0005, series: Series = BAR_SERIES) -> DataFrame:
    """Closed trades: entry and exit time and executed price, pnl and holding time."""
    ts, c = series.order[0], F.col
    return sim.filter("leave").select(
        *series.key, "strategy", "params", c("entry.ts").alias("entry_ts"), (c("entry.px") * (1 + slippage)).alias("entry_price"),
        c(ts).alias("exit_ts"), (c("close") * (1 - slippage)).alias("exit_price"), (c("equity") - c("entry.cash")).alias("pnl"),
        ((F.unix_micros(ts) - F.unix_micros(c("entry.ts"))) / 1000).alias("holding_ms"))


def metrics(sim: DataFrame, capital: float = 10_000.0, series: Series = BAR_SERIES, rf: float = 0.05) -> DataFrame:
    """Seventeen figures per run, rounded to 2 or 4 digits; infinite ratios stay infinite."""
    key, c, ts = [*series.key, "strategy", "params"], F.col, series.order[0]
    ms = F.unix_micros(ts) / 1000
    span = sim.groupBy(*key).agg(F.count(F.lit(1)).alias("_bars"), (F.min(ms) - 1).alias("_t0"), F.max(ms).alias("_t1"))
    per = F.when(c("_t1") <= c("_t0"), 365.0).otherwise(half_up(MS_YEAR / ((c("_t1") - c("_t0")) / c("_bars")), 0))
    x = sim.join(span.withColumn("_per", per), key)
    r, target = c("gain") - 1, rf / c("_per")
    pnl = F.when(c("leave"), c("equity") - c("entry.cash"))
    win, loss = F.when(pnl > 0, pnl), F.when(pnl <= 0, pnl)
    under = F.when(c("equity") < c("peak"), ms - F.coalesce(F.unix_micros("peak_ts") / 1000, c("_t0")))
    hold = F.when(c("leave"), ms - F.unix_micros("entry.ts") / 1000)
    g = x.groupBy(*key).agg(
        F.max("_bars").alias("n_bars"), F.max("_per").alias("_per"), F.max("_t0").alias("_t0"), F.max("_t1").alias("_t1"),
        F.max_by("equity", ts).alias("_eq"), F.avg(r).alias("_m"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("_sd"),
        F.coalesce(F.stddev_samp(F.when(r < target, r)), F.lit(0.0)).alias("_dn"), F.sum(log_growth(F.col("gain"))).alias("_lg"),
        F.max((c("peak") - c("equity")) / c("peak")).alias("_dd"), F.coalesce(F.max(under), F.lit(0.0)).alias("_du"),
        F.count(pnl).alias("total_trades"), F.count(win).alias("_nw"), F.avg(win).alias("_aw"), F.avg(loss).alias("_al"),
        F.max(win).alias("_lw"), F.min(loss).alias("_ll"), F.sum(win).alias("_gp"),
        F.sum(F.when(pnl < 0, -pnl)).alias("_gl"), F.avg(hold).alias("_h"), F.avg(pnl).alias("_x"))
    return figures(g, key, capital, rf)


def figures(g: DataFrame, key: list[str], capital: float, rf: float) -> DataFrame:
    """The figures from a run's sums."""
    c = F.col
    total = (c("_eq") - capital) / capital
    years = (c("_t1") - c("_t0")) / MS_YEAR
    root, n, inf = F.sqrt("_per"), c("n_bars"), F.lit(float("inf"))
    z = lambda v: F.coalesce(v, F.lit(0.0))
    many = n > 1
    annual = F.exp(c("_lg") * c("_per") / n) - 1
    figures = {
        "total_return": (total, 4), "annualized_return": (F.when(years > 0, F.exp(c("_lg") / years) - 1).otherwise(total), 4),
        "sharpe": (F.when(many & (c("_sd") > 0), (c("_m") - rf / c("_per")) / c("_sd") * root).otherwise(0.0), 2),
        "sortino": (F.when(~many, 0.0).when(c("_dn") == 0, inf).otherwise((c("_m") - rf / c("_per")) / c("_dn") * root), 2),
        "max_drawdown": (c("_dd"), 4), "max_drawdown_ms": (c("_du"), 0), "win_rate": (F.when(c("total_trades") > 0, c("_nw") / c("total_trades")).otherwise(0.0), 4),
        "profit_factor": (F.when(c("total_trades") == 0, 0.0).when(z(c("_gl")) == 0, inf).otherwise(z(c("_gp")) / c("_gl")), 2),
        "avg_win": (z(c("_aw")), 2), "avg_loss": (z(c("_al")), 2), "largest_win": (z(c("_lw")), 2), "largest_loss": (z(c("_ll")), 2),
        "avg_holding_ms": (z(c("_h")), 0), "calmar": (F.when(many & (c("_dd") > 0), annual / c("_dd")).otherwise(0.0), 2),
        "expectancy": (z(c("_x")), 2), "final_equity": (c("_eq"), 2)}
    rounded = lambda v, d: F.when(v == inf, inf).otherwise(F.floor(v * float(10 ** d) + 0.5) / float(10 ** d))
    return g.select(*key, "n_bars", "total_trades", *[rounded(v, d).alias(k) for k, (v, d) in figures.items()])


RUNS_AT_ONCE = 16               # runs walked together: a block's matrices stay at 16 MB each


class Carry:
    """What a run brings into a block, an entry per run: long or not, equity, top equity and its time, the open entry."""

    def __init__(self, runs: int, capital: float, long: bool = False):
        self.long, self.equity = np.full(runs, long), np.full(runs, capital)
        self.top, self.top_ms = np.full(runs, -np.inf), np.zeros(runs)
        self.entry_ms, self.cash, self.own = np.zeros(runs), np.full(runs, capital), np.zeros(runs, bool)

    def part(self, s: slice) -> "Carry":
        out = Carry(0, 0.0)
        out.__dict__ = {k: v[s] for k, v in self.__dict__.items()}
        return out


def walk(close, before, ms, last_bar, sig, start: Carry, commission: float, slippage: float):
    """Equity and trades of some runs (columns of ``sig``) over the bars of a block, and what they bring into the next."""
    t = np.arange(len(close))[:, None]
    at = np.maximum.accumulate(np.where(sig != 0, t, -1))
    now = np.where(at >= 0, np.take_along_axis(sig, np.maximum(at, 0), 0) == 1, start.long)
    was = np.vstack([start.long[None], now[:-1]])
    enter, leave = now & ~was, (was & ~now) | (now & last_bar[:, None])
    gain = np.where(was, (close / before)[:, None], 1.0)
    gain *= np.where(enter, (1 - commission) / (1 + slippage), 1.0) * np.where(leave, (1 - slippage) * (1 - commission), 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        growth = np.cumsum(np.where(gain <= 0, -np.inf, np.log(gain)), axis=0)
    equity = start.equity * np.exp(growth)
    spent = start.equity * np.exp(np.vstack([np.zeros((1, growth.shape[1])), growth[:-1]]))
    run = np.maximum.accumulate(equity)
    peak_at = np.maximum.accumulate(np.where((equity == run) & (run >= start.top), t, -1))
    entry_at = np.maximum.accumulate(np.where(enter, t, -1))
    end = Carry(0, 0.0)
    end.long, end.equity, end.top = now[-1], equity[-1], np.maximum(run[-1], start.top)
    end.top_ms = np.where(peak_at[-1] >= 0, ms[peak_at[-1]], start.top_ms)
    end.own = entry_at[-1] >= 0
    end.entry_ms = np.where(end.own, ms[entry_at[-1]], start.entry_ms)
    end.cash = np.where(end.own, np.take_along_axis(spent, np.maximum(entry_at[-1:], 0), 0)[0], start.cash)
    return gain, leave, equity, spent, np.maximum(run, start.top), peak_at, entry_at, end


PART = ("bars", "r1", "r2", "d0", "d1", "d2", "growth", "equity", "dd", "du", "trades", "wins", "won", "lost", "best", "worst", "gross_lost", "held")


def block_sums(block: dict, start: Carry, capital: float, target: float, t0: float, commission: float, slippage: float) -> np.ndarray:
    """One row of ``PART`` sums per run of a block."""
    out = []
    for lo in range(0, block["sig"].shape[1], RUNS_AT_ONCE):
        some = slice(lo, lo + RUNS_AT_ONCE)
        begin, ms = start.part(some), block["ms"]
        gain, leave, equity, spent, top, peak_at, entry_at, end = walk(
            block["close"], block["before"], ms, block["last"], block["sig"][:, some], begin, commission, slippage)
        r, runs = gain - 1, gain.shape[1]
        low = r < target
        peak = np.maximum(top, capital)
        since = np.where(top >= capital, np.where(peak_at >= 0, ms[peak_at], begin.top_ms), t0)
        under = np.where(equity < peak, ms[:, None] - since, 0.0).max(axis=0)
        i, k = np.nonzero(leave)
        e = entry_at[i, k]
        pnl = equity[i, k] - np.where(e >= 0, spent[np.maximum(e, 0), k], begin.cash[k])
        held = ms[i] - np.where(e >= 0, ms[np.maximum(e, 0)], begin.entry_ms[k])
        add = lambda w: np.bincount(k, w, runs)
        best, worst = np.full(runs, np.nan), np.full(runs, np.nan)
        np.fmax.at(best, k[pnl > 0], pnl[pnl > 0])
        np.fmin.at(worst, k[pnl <= 0], pnl[pnl <= 0])
        with np.errstate(divide="ignore"):
            grown = np.log(np.where(gain <= 0, 0.0, gain)).sum(axis=0)
        out.append(np.array([np.full(runs, len(r)), r.sum(0), (r * r).sum(0), low.sum(0), np.where(low, r, 0).sum(0), np.where(low, r * r, 0).sum(0),
                             grown, end.equity, ((peak - equity) / peak).max(0), under, add(np.ones(len(k))), add(pnl > 0), add(np.maximum(pnl, 0)),
                             add(np.minimum(pnl, 0)), best, worst, add(np.maximum(-pnl, 0)), add(held)]).T)
    return np.vstack(out)


def _block(pdf: pd.DataFrame, runs: int) -> dict:
    """Arrays of a block's own bars, in order; ``before`` is the close one bar earlier (NaN at the first of a series)."""
    pdf = pdf.sort_values("_rn")
    own = ~pdf["_halo"].to_numpy()
    close = pdf["close"].to_numpy(float)
    before = np.append(np.nan, close[:-1])
    return {"close": close[own], "before": before[own], "ms": pdf["_ms"].to_numpy(float)[own], "last": (pdf["_rn"] == pdf["_n"]).to_numpy()[own],
            "sig": pdf[[f"_sig{i}" for i in range(runs)]].to_numpy(np.int8)[own]}


CARRY = ("run", "long", "equity", "top", "top_ms", "entry_ms", "cash", "own")


def carries(blocks: DataFrame, key: list[str], runs: int, capital: float, commission: float, slippage: float) -> DataFrame:
    """What every run brings into each block of the series in ``blocks``: per block both starts, composed in block order.

    A block's effect depends on its past only through one bit (long or not) and
    scales with the equity, so it is summed up for both bits; a series then has
    two small rows per block and run.
    """
    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        block, out = _block(pdf, runs), []
        for long in (False, True):
            start = Carry(runs, 1.0, long)
            for lo in range(0, runs, RUNS_AT_ONCE):
                some = slice(lo, lo + RUNS_AT_ONCE)
                end = walk(block["close"], block["before"], block["ms"], block["last"], block["sig"][:, some], start.part(some),
                           commission, slippage)[-1]
                out.append(pd.DataFrame({"run": np.arange(runs)[some], "start": long, **{k: getattr(end, k) for k in CARRY[1:]}}))
        got = pd.concat(out)
        return pd.concat([pd.DataFrame({k: [pdf[k].iloc[0]] * len(got) for k in [*key, "_blk"]}), got.reset_index(drop=True)], axis=1)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Carry(runs, capital), []
        for blk, part in pdf.groupby("_blk"):
            out.append(pd.DataFrame({"_blk": blk, "run": np.arange(runs), **{k: getattr(state, k) for k in CARRY[1:]}}))
            part = part.sort_values(["start", "run"])
            pick = lambda k: part[k].to_numpy().reshape(2, runs)[state.long.astype(int), np.arange(runs)]
            e, own, top = state.equity, pick("own").astype(bool), pick("top") * state.equity
            state.entry_ms, state.cash = np.where(own, pick("entry_ms"), state.entry_ms), np.where(own, pick("cash") * e, state.cash)
            state.top_ms, state.top = np.where(top >= state.top, pick("top_ms"), state.top_ms), np.maximum(top, state.top)
            state.long, state.equity = pick("long").astype(bool), pick("equity") * e
        got = pd.concat(out, ignore_index=True)
        return pd.concat([pd.DataFrame({k: [pdf[k].iloc[0]] * len(got) for k in key}), got], axis=1)

    ends = ", ".join(["run int", "long boolean", *[f"{c} double" for c in CARRY[2:7]], "own boolean"])
    ident = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in [*key, "_blk"])
    per_block = blocks.groupBy(*key, "_blk").applyInPandas(sums, f"{ident}, {ends.replace('run int', 'run int, start boolean')}")
    return cut(per_block).groupBy(*key).applyInPandas(compose, f"{ident}, {ends}")


def backtest(bars: DataFrame, runs: list[tuple[str, dict]], capital: float = 10_000.0, commission: float = 0.001,
             slippage: float = 0.0005, series: Series = BAR_SERIES, block_rows: int | None = None, rf: float = 0.05) -> DataFrame:
    """Figures of every run, from sums per block and run: no row per bar and run exists.

    Runs are columns of the blocked bars; a task walks all runs of a block as
    matrices.  Series longer than a block first get what every run brings into
    each block (``carries``), then all blocks are summed up side by side.
    """
    key, c, size = list(series.key), F.col, block_rows or BLOCK_ROWS
    ms = F.unix_micros(series.order[0]) / 1000
    span = cut(bars.groupBy(*key).agg(F.count(F.lit(1)).alias("_bars"), (F.min(ms) - 1).alias("_t0"), F.max(ms).alias("_t1")))
    per = F.when(c("_t1") <= c("_t0"), 365.0).otherwise(half_up(MS_YEAR / ((c("_t1") - c("_t0")) / c("_bars")), 0))
    fr, runs = signal_columns(bars, runs, series, block_rows)
    n = len(runs)
    sigs = [F.coalesce(c(f"_sig{i}"), F.lit(0)).cast("byte").alias(f"_sig{i}") for i in range(n)]
    real = F.max((~c("_halo")).cast("int")).over(Window.partitionBy(*key, "_blk")) == 1       # not only the end of the block before
    rows = fr.df.withColumn("_real", real).filter("_real").select(*key, "_blk", "_halo", "_rn", "_n", "close", ms.alias("_ms"), *sigs)
    times = span.select(*key, "_t0", per.alias("_per"))
    rows = rows.join(times, key)

    def sums(pdf: pd.DataFrame, carried: pd.DataFrame) -> pd.DataFrame:
        start = Carry(n, capital)
        if len(carried):
            for name in CARRY[1:]:
                setattr(start, name, carried.sort_values("run")[name].to_numpy())
        head = pdf.iloc[0]
        got = pd.DataFrame(block_sums(_block(pdf, n), start, capital, rf / head["_per"], head["_t0"], commission, slippage), columns=list(PART))
        return pd.concat([pd.DataFrame({k: [head[k]] * n for k in [*key, "_blk"]}), pd.DataFrame({"run": np.arange(n)}), got], axis=1)

    ident = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*key, "_blk"])
    schema = f"{ident}, run int, " + ", ".join(f"{p} double" for p in PART)
    blocks = rows.groupBy(*key, "_blk")
    if span.filter(c("_bars") > max(size, 1)).isEmpty():
        parts = blocks.applyInPandas(lambda pdf: sums(pdf, pdf[:0]), schema)
    else:
        long = rows.join(span.filter(c("_bars") > size).select(*key), key, "left_semi")
        brought = carries(long, key, n, capital, commission, slippage)
        parts = blocks.cogroup(brought.groupBy(*key, "_blk")).applyInPandas(sums, schema)
    g = parts.groupBy(*key, "run").agg(
        F.max_by("equity", "_blk").alias("_eq"), *[F.sum(p).alias(p) for p in PART if p not in ("equity", "dd", "du", "best", "worst")],
        F.max("dd").alias("_dd"), F.max("du").alias("_du"), F.max(F.nanvl("best", F.lit(None).cast("double"))).alias("_lw"),
        F.min(F.nanvl("worst", F.lit(None).cast("double"))).alias("_ll"))
    lit = lambda values: F.get(F.array(*[F.lit(v) for v in values]), c("run"))
    g = g.join(span, key).select(
        *key, lit([s for s, _ in runs]).alias("strategy"), lit([label(p) for _, p in runs]).alias("params"),
        c("_bars").alias("n_bars"), per.alias("_per"), "_t0", "_t1", "_eq", (c("r1") / c("bars")).alias("_m"),
        sample_sd(c("bars"), c("r1"), c("r2")).alias("_sd"), sample_sd(c("d0"), c("d1"), c("d2")).alias("_dn"), c("growth").alias("_lg"), "_dd", "_du",
        c("trades").cast("long").alias("total_trades"), c("wins").alias("_nw"), (c("won") / F.nullif("wins", F.lit(0.0))).alias("_aw"),
        (c("lost") / F.nullif(c("trades") - c("wins"), F.lit(0.0))).alias("_al"), "_lw", "_ll", c("won").alias("_gp"), c("gross_lost").alias("_gl"),
        (c("held") / F.nullif("trades", F.lit(0.0))).alias("_h"), ((c("won") + c("lost")) / F.nullif("trades", F.lit(0.0))).alias("_x"))
    return figures(g, [*key, "strategy", "params"], capital, rf)


def compare_strategies(bars: DataFrame, series: Series = BAR_SERIES, **kw) -> DataFrame:
    """All nine strategies with default parameters, ranked by Sharpe per series."""
    m = backtest(bars, [(s, {}) for s in DEFAULTS], series=series, **kw)
    return ranked(m, F.col("sharpe"), series.key, ties=("strategy",), descending=True)


def best_run(m: DataFrame, metric: str, key) -> DataFrame:
    rest = [c for c in m.columns if c not in key]
    return m.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct((-F.col(metric)).alias("m"), "params")).alias("b")).select(
        *key, "b.*")


def optimize(bars: DataFrame, runs: list[tuple[str, dict]], metric: str = "sharpe", series: Series = BAR_SERIES, **kw) -> DataFrame:
    """Best parameter set per series by a metric."""
    return best_run(backtest(bars, runs, series=series, **kw), metric, list(series.key))


def split_bars(bars: DataFrame, ratio: float, series: Series = BAR_SERIES) -> DataFrame:
    """Adds column ``segment``: in_sample for the first round(n * ratio) bars, out_of_sample after."""
    r = framed(bars, series).body(keep_rn=True)
    cut = F.floor(F.col("_n") * ratio + 0.5)
    return r.withColumn("segment", F.when(F.col("_rn") <= cut, "in_sample").otherwise("out_of_sample")).drop("_rn", "_n")


def walk_forward_split(bars: DataFrame, runs: list[tuple[str, dict]], ratio: float = 0.7, series: Series = BAR_SERIES, **kw) -> DataFrame:
    """One split; each side restarts its indicators and its capital."""
    return backtest(split_bars(bars, ratio, series), runs, series=series.with_key("segment"), **kw)


def walk_forward_rolling(bars: DataFrame, runs: list[tuple[str, dict]], window: int, step: int, metric: str = "sharpe",
                         series: Series = BAR_SERIES, **kw) -> DataFrame:
    """Rolling train and test windows: best parameters of each train window judged on the bars after it.

    A train window of under 30 bars or a step of under 5 is refused.
    """
    if window < 30 or step < 5:
        raise ValueError("window must be at least 30 bars and step at least 5")
    key = list(series.key)
    r = framed(bars, series).body(keep_rn=True).withColumnsRenamed({"_rn": "rn", "_n": "n"})
    # window k trains on rows k*step+1 .. k*step+window and tests on the next step rows
    lo = F.greatest(F.lit(0), F.ceil((F.col("rn") - window - step) / step))
    hi = F.least(F.floor((F.col("rn") - 1) / step), F.floor((F.col("n") - window - step) / step))
    e = r.withColumn("k", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).withColumn(
        "part", F.when(F.col("rn") - F.col("k") * step <= window, "train").otherwise("test"))
    m = backtest(e.drop("rn", "n"), runs, series=series.with_key("k", "part"), **kw)
    train = best_run(m.filter("part = 'train' AND total_trades > 0"), metric, [*key, "k"])
    test = m.filter("part = 'test'").select(*key, "k", "strategy", "params", F.col("sharpe").alias("oos_sharpe"),
                                            F.col("total_return").alias("oos_return"), F.col("total_trades").alias("oos_trades"))
    return train.select(*key, "k", "strategy", "params", F.col("sharpe").alias("is_sharpe"), F.col("total_return").alias("is_return"),
                        F.col("total_trades").alias("is_trades")).join(test, [*key, "k", "strategy", "params"])


def walk_forward_summary(windows: DataFrame, series: Series = BAR_SERIES) -> DataFrame:
    g = windows.groupBy(*series.key).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("is_sharpe").alias("avg_is"), F.avg("oos_sharpe").alias("avg_oos"),
        (F.product(1 + F.col("oos_return")) - 1).alias("compounded_return"))
    eff = F.when(F.col("avg_is") != 0, half_up(F.col("avg_oos") / F.col("avg_is"), 2)).otherwise(0.0)
    return g.withColumn("efficiency", eff).withColumn("overfit_risk", F.when(F.col("efficiency") > 0.75, "low").when(
        F.col("efficiency") > 0.5, "moderate").otherwise("high"))


def sma_backtest_v1(bars: DataFrame, fast: int, slow: int, capital: float = 10_000.0, fraction: float = 1.0,
                    series: Series = BAR_SERIES) -> DataFrame:
    """SMA cross without costs that risks a fraction of the capital per trade."""
    sim = simulate(signal_table(bars, [("sma_crossover", {"fast": fast, "slow": slow})], series), 1.0, 0.0, 0.0, series)
    t = trades(sim, 0.0, 0.0, series).withColumn("r", F.col("exit_price") / F.col("entry_price") - 1)
    g = t.groupBy(*series.key).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        (F.exp(F.sum(log_growth(1 + fraction * F.col("r")))) * capital).alias("final_capital"))
    return g.withColumn("total_return", F.col("final_capital") / capital - 1)

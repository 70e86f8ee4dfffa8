"""Factor returns, exposures, covariance and principal components over long return panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.columns import clamp, safe_div
from ..plans.blocks import framed, tail
from ..plans.lineage import cut
from ..plans.rank import ranked, with_row
from .align import TS_SERIES, common_ts, covar_of, pair_moments
from .pairs import SYMBOL_SERIES


def halves(chars: DataFrame, by: str, name: str) -> DataFrame:
    """Symbols split at floor(n/2) of the sorted characteristic: -1 lower half, 1 upper half."""
    r = ranked(chars.filter(F.col(by).isNotNull()), F.col(by), ties=("symbol",))
    return r.filter("n_ranked >= 2").select("symbol", F.when(
        F.col("rank") <= F.floor(F.col("n_ranked") / 2), -1).otherwise(1).alias(name))


def long_short(rets: DataFrame, side: DataFrame, name: str, high: bool, factor: str) -> DataFrame:
    """Mean return of one half minus the other per ts."""
    s = 1 if high else -1
    m = lambda v: F.coalesce(F.avg(F.when(F.col(name) == v, F.col("ret"))), F.lit(0.0))
    return rets.join(side, "symbol").groupBy("ts").agg((m(s) - m(-s)).alias(factor))


def factor_returns(rets: DataFrame, chars: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Market, SMB, HML, RMW and CMA per ts from median splits."""
    out = (market if market is not None else rets.groupBy("ts").agg(F.avg("ret").alias("market"))).select("ts", "market")
    splits = chars.select("symbol")
    # Characteristic and long side of each factor.
    table = (("smb", "market_cap", False), ("hml", "book_to_market", True), ("rmw", "profitability", True),
             ("cma", "investment", False))
    for f, by, _ in table:
        splits = splits.join(halves(chars, by, f), "symbol", "left")
    j = rets.select("symbol", "ts", "ret").join(splits, "symbol")
    m = lambda f, v: F.coalesce(F.avg(F.when(F.col(f) == v, F.col("ret"))), F.lit(0.0))
    g = j.groupBy("ts").agg(*[(m(f, 1 if hi else -1) - m(f, -1 if hi else 1)).alias(f) for f, _, hi in table])
    return out.join(g, "ts")


def factor_returns_store(rets: DataFrame, size: DataFrame, lookback: int = 20, symbols: list[str] | None = None) -> DataFrame:
    """Market, SMB and trailing-sum momentum per common ts of ``symbols`` (all by default); needs four symbols.

    ``size`` has symbol and size (market cap or mean volume); symbols not asked for do not count in its halves.
    """
    al = common_ts(rets.select("symbol", "ts", "ret"), symbols=symbols)
    size = size if symbols is None else size.filter(F.col("symbol").isin(symbols))
    n_sym = al.agg(F.count_distinct("symbol").alias("_ns"))
    al = with_row(al, n_sym).filter("_ns >= 4")
    fr = framed(al, SYMBOL_SERIES, lookback=lookback + 1)
    eff = F.least(F.lit(lookback), F.floor(F.col("_n") / 2))
    past = F.sum("ret").over(fr.rows(-lookback, -1))
    fr = fr.with_columns(trail=F.when(F.col("_rn") > eff, past), _short=F.col("_n") < 2 * lookback)
    rows = fr.body(keep_rn=True)
    side = halves(size.select("symbol", F.col("size").alias("size")), "size", "half")
    rows = rows.join(side, "symbol", "left")
    w = Window.partitionBy("ts")
    q = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 5))
    best = F.row_number().over(w.orderBy(F.col("trail").desc(), "symbol"))
    worst = F.row_number().over(w.orderBy("trail", F.col("symbol").desc()))
    rows = rows.withColumn("_q", q).withColumn("_b", best).withColumn("_w", worst)
    m = lambda c: F.avg(F.when(c, F.col("ret")))
    return rows.groupBy("ts").agg(
        F.avg("ret").alias("market"),
        (F.coalesce(m(F.col("half") == -1), F.lit(0.0)) - F.coalesce(m(F.col("half") == 1), F.lit(0.0))).alias("smb"),
        F.coalesce(m(F.col("trail").isNotNull() & (F.col("_b") <= F.col("_q")))
                   - m(F.col("trail").isNotNull() & (F.col("_w") <= F.col("_q"))), F.lit(0.0)).alias("momentum"))


def xs_momentum(rets: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Compound return of the lookback before the skipped rows; rank, quintile and z."""
    t = tail(rets, SYMBOL_SERIES, lookback + skip).df
    back = F.col("_n") - F.col("_rn")
    use = (back >= skip) & (back < skip + lookback)
    g = t.groupBy("symbol").agg((F.coalesce(F.product(F.when(use, 1 + F.col("ret"))), F.lit(1.0)) - 1).alias("cum"))
    stats = g.agg(F.avg("cum").alias("_m"), F.coalesce(F.stddev_samp("cum"), F.lit(0.0)).alias("_s"))
    r = with_row(ranked(g, F.col("cum"), ties=("symbol",), descending=True), stats)
    return (r.withColumn("quintile", F.least(F.lit(5), F.floor((F.col("rank") - 1) / F.col("n_ranked") * 5) + 1).cast("long"))
            .withColumn("z", safe_div(F.col("cum") - F.col("_m"), F.col("_s"), 0.0)).drop("_m", "_s", "n_ranked"))


def long_short_spread(scores: DataFrame) -> DataFrame:
    m = lambda q: F.coalesce(F.avg(F.when(F.col("quintile") == q, F.col("cum"))), F.lit(0.0))
    return scores.agg((m(1) - m(5)).alias("spread"))


def both_triangles(cov: DataFrame) -> DataFrame:
    return cov.select("a", "b", "cov").unionByName(
        cov.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))


def covariance(rets: DataFrame, method: str = "sample", half_life: float = 30.0,
               target: str = "identity", blocks: int | None = None, symbols: list[str] | None = None,
               pairwise: bool = False) -> DataFrame:
    """Covariance of every pair a <= b on the timestamps common to ``symbols`` (all by default): a, b, cov, n.

    ``pairwise`` (sample method only) takes each pair's own common timestamps
    instead, so a late listing shortens its own pairs and no others; n is then
    the pair's, cov is null below two rows, and the matrix need not be positive
    semidefinite.
    """
    if pairwise:
        if method != "sample":
            raise ValueError("pairwise moments are offered for the sample covariance only")
        rets = rets if symbols is None else rets.filter(F.col("symbol").isin(symbols))
        return pair_moments(rets, blocks=blocks).select("a", "b", F.when(F.col("n") > 1, covar_of()).alias("cov"), "n")
    al = cut(common_ts(rets.select("symbol", "ts", "ret"), symbols=symbols))      # read by up to six passes
    if method == "exponential":
        mu = al.groupBy("symbol").agg(F.avg("ret").alias("mu"))
        stamps = framed(al.select("ts").distinct().withColumn("_all", F.lit(0)), TS_SERIES).body(keep_rn=True)
        w = stamps.select("ts", F.pow(F.lit(0.5), (F.col("_n") - F.col("_rn")) / half_life).alias("w"))
        x = al.join(mu, "symbol").join(w, "ts").select(
            "symbol", "ts", (F.sqrt("w") * (F.col("ret") - F.col("mu"))).alias("v"))
        m = with_row(pair_moments(x, "v", blocks=blocks), w.agg(F.sum("w").alias("_w")))
        return m.select("a", "b", (F.col("sab") / F.col("_w")).alias("cov"), "n")
    s = pair_moments(al, blocks=blocks).withColumn("cov", covar_of())
    if method == "sample":
        return s.select("a", "b", "cov", "n")
    var = s.filter("a = b").select(F.col("a").alias("s"), F.col("cov").alias("var"))
    s = s.join(var.select(F.col("s").alias("a"), F.col("var").alias("va")), "a").join(
        var.select(F.col("s").alias("b"), F.col("var").alias("vb")), "b")
    if target == "identity":
        s = with_row(s, var.agg(F.avg("var").alias("_t")))
        goal = F.when(F.col("a") == F.col("b"), F.col("_t")).otherwise(0.0)
    else:
        off = s.filter("a < b AND va > 0 AND vb > 0").agg(F.coalesce(F.avg(
            F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))), F.lit(0.0)).alias("_t"))
        s = with_row(s, off)
        goal = F.when(F.col("a") == F.col("b"), F.col("va")).otherwise(F.col("_t") * F.sqrt(F.col("va") * F.col("vb")))
    mu = al.groupBy("symbol").agg(F.avg("ret").alias("mu"))
    sq = al.join(mu, "symbol").select("symbol", "ts", F.pow(F.col("ret") - F.col("mu"), 2).alias("v"))
    fourth = pair_moments(sq, "v", blocks=blocks).select("a", "b", F.col("sab").alias("q4"))
    s = s.join(fourth, ["a", "b"]).withColumn("goal", goal)
    n, c = F.col("n"), F.col("cov")
    sxy = c * (n - 1)
    pi = (F.col("q4") - 2 * c * sxy) / n + c * c
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    tot = s.agg(F.sum(twice * pi).alias("_pi"), F.sum(twice * F.pow(F.col("goal") - c, 2)).alias("_g"), F.max(n).alias("_nn"))
    k = F.when(F.col("_g") == 0, 0.0).otherwise(clamp(F.col("_pi") / (F.col("_nn") * F.col("_g"))))
    return with_row(s, tot).select("a", "b", (k * F.col("goal") + (1 - k) * c).alias("cov"), "n", k.alias("intensity"))


PCA_EXTRA = 5                   # columns of a block beyond the components asked for
PCA_STEPS = 100                 # blocks at most
PCA_TOLERANCE = 1e-11           # residual of a component, relative to the greatest eigenvalue


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as rows of numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _listed(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[:len(x) + 1] if x.shape[1]
                                    else np.zeros(len(x) + 1, np.int32), x.ravel())


def _cross(block: DataFrame, off: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Q'W and W'W of the columns ``q`` and ``w``, with ``off`` W less Q off; added up on the cluster."""
    def part(batches):
        total, shape = 0, None
        for batch in batches:
            if len(batch):
                q, w = _matrix(batch.column(0)), _matrix(batch.column(1))
                w = w if off is None else w - q @ off
                shape = (q.shape[1] + w.shape[1], w.shape[1])
                total = total + np.hstack([q, w]).T @ w
        if shape:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "x"])

    got = (block.select("q", "w").mapInArrow(part, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
           .orderBy("at").toPandas()["x"].to_numpy())          # (columns so far + block) x block numbers
    both = int(round(len(got) / (width := block.select(F.size("w")).first()[0])))
    got = got.reshape(both, width)
    return got[:both - width], got[both - width:]


def pca(rets: DataFrame, k: int = 5, symbols: list[str] | None = None) -> DataFrame:
    """Loadings and explained variance of the leading components of the aligned panel of ``symbols`` (all by default).

    Block iteration on the covariance rows: the block of vectors is a table
    with one row per symbol, the product with the covariance is a join and a
    sum, and the new block is made orthogonal to all earlier ones (block
    Lanczos, Golub and Van Loan).  Only inner products of columns, whose number
    depends on ``k`` and the blocks needed, reach the driver; symbols and
    loadings never do.  Iteration ends when the residual of every component is
    below ``PCA_TOLERANCE`` of the greatest eigenvalue.  A component's largest
    loading (the least symbol's among equals) is positive.
    """
    spark = rets.sparkSession
    schema = "factor long, symbol string, loading double, explained double"
    cov = cut(both_triangles(covariance(rets, symbols=symbols)))
    trace = cov.filter("a = b").agg(F.sum("cov")).first()[0]
    if trace is None:
        return spark.createDataFrame([], schema)
    width = k + PCA_EXTRA
    start = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.xxhash64("symbol", i) / F.lit(2.0 ** 63))
    block = cut(cov.filter("a = b").select(F.col("a").alias("symbol")).select(
        "symbol", F.array().cast("array<double>").alias("q"), start.alias("w")))
    t, last = np.zeros((0, 0)), 0
    for _ in range(PCA_STEPS):
        c, s0 = _cross(block)
        if len(c):                                             # W is the covariance times the last block
            m = len(c)
            grown = np.zeros((m, m))
            grown[:m - last, :m - last] = t
            grown[:, m - last:] = c
            grown[m - last:, :] = c.T
            t = (grown + grown.T) / 2
        off = c
        c2, s2 = _cross(block, off)
        off = off + c2
        size, turn = np.linalg.eigh(s2 - c2.T @ c2)
        size = np.maximum(size, 0)
        scale = float(np.trace(s0)) if not len(t) else max(float(np.linalg.eigvalsh(t)[-1]) ** 2, 1e-300)
        values, vectors = np.linalg.eigh(t)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        left = np.sqrt(size)[:, None] * turn.T                 # how the block leaves the space of the earlier ones
        kept = size > max(1e-9 * size.max(initial=0), 1e-26 * scale)
        if len(t) and (not kept.any() or np.linalg.norm(left @ vectors[-last:], axis=0).max() <= PCA_TOLERANCE * abs(values[0])):
            break
        last = int(kept.sum())
        mix = turn[:, kept] / np.sqrt(size[kept])

        def grow(batches, off=off, mix=mix):
            for batch in batches:
                if len(batch):
                    q, w = _matrix(batch.column(1)), _matrix(batch.column(2))
                    new = (w - q @ off) @ mix
                    yield pa.RecordBatch.from_arrays([batch.column(0), _listed(np.hstack([q, new])), _listed(new)], ["symbol", "q", "new"])

        block = cut(block.mapInArrow(grow, "symbol string, q array<double>, new array<double>"))
        times = cov.join(block.select(F.col("symbol").alias("b"), "new"), "b").groupBy(F.col("a").alias("symbol")).agg(
            F.array(*[F.sum(F.col("cov") * F.get("new", F.lit(i))) for i in range(last)]).alias("w"))
        block = cut(block.select("symbol", "q").join(times, "symbol"))
    else:
        raise ValueError(f"no convergence in {PCA_STEPS} blocks")

    def load(batches):
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1)) @ vectors
                yield pa.RecordBatch.from_arrays([batch.column(0), _listed(x)], ["symbol", "x"])

    rows = block.select("symbol", "q").mapInArrow(load, "symbol string, x array<double>").select(
        F.posexplode("x").alias("factor", "loading"), "symbol")
    sign = rows.groupBy("factor").agg(F.signum(F.min_by("loading", F.struct(-F.round(F.abs("loading"), 9), "symbol"))).alias("sign"))
    explained = F.get(F.array(*[F.lit(float(x) / trace) for x in values]), F.col("factor"))
    return rows.join(F.broadcast(sign), "factor").select(      # one row per component
        (F.col("factor") + 1).cast("long").alias("factor"), "symbol", (F.col("loading") * F.col("sign")).alias("loading"),
        explained.alias("explained"))


def factor_exposure(rets: DataFrame, factors: DataFrame, names: list[str], min_rows: int = 2, key=("symbol",)) -> DataFrame:
    """Multi-factor OLS per key: alpha, R2, residual deviation, and beta, t and mean per factor.

    Gram sums are plain aggregates; the k x k solve sees one row per key.
    """
    key = list(key)
    j = rets.select(*key, "ts", F.col("ret").alias("y")).join(factors.select("ts", *names), "ts")
    sums = [F.count("y").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    k = len(names)
    sums += [F.sum(f).alias(f"s{i}") for i, f in enumerate(names)]
    sums += [F.sum(F.col("y") * F.col(f)).alias(f"y{i}") for i, f in enumerate(names)]
    sums += [F.sum(F.col(names[i]) * F.col(names[m])).alias(f"c{i}_{m}") for i in range(k) for m in range(i, k)]
    g = j.groupBy(*key).agg(*sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                n, m = r["n"], np.zeros((k + 1, k + 1))
                m[0, 0] = n
                for i in range(k):
                    m[0, i + 1] = m[i + 1, 0] = r[f"s{i}"]
                    for q in range(i, k):
                        m[i + 1, q + 1] = m[q + 1, i + 1] = r[f"c{i}_{q}"]
                v = np.array([r["sy"]] + [r[f"y{i}"] for i in range(k)])
                coef, t, r2, sd = np.zeros(k + 1), np.zeros(k + 1), 0.0, 0.0
                if n >= min_rows and np.linalg.matrix_rank(m) == k + 1:
                    inv = np.linalg.inv(m)
                    coef = inv @ v
                    res = max(0.0, r["syy"] - coef @ v)
                    tot = r["syy"] - r["sy"] ** 2 / n
                    r2 = min(1.0, max(0.0, 1 - res / tot)) if tot > 0 else 0.0
                    sd = np.sqrt(res / (n - 1)) if n > 1 else 0.0
                    se = np.sqrt(np.maximum(res / (n - k - 1) * np.diag(inv), 0)) if n > k + 1 else np.zeros(k + 1)
                    t = np.divide(coef, se, out=np.zeros(k + 1), where=se > 0)
                row = {c: r[c] for c in key} | {"n": n, "alpha": coef[0], "r_squared": r2, "residual_vol": sd,
                                                "total_return": r["sy"]}
                for i, f in enumerate(names):
                    row |= {f"beta_{f}": coef[i + 1], f"t_{f}": t[i + 1], f"mean_{f}": r[f"s{i}"] / n}
                out.append(row)
            if out:
                yield pd.DataFrame(out)

    d = T.DoubleType()
    schema = T.StructType([rets.schema[c] for c in key] + [T.StructField("n", T.LongType())] + [
        T.StructField(c, d) for c in ("alpha", "r_squared", "residual_vol", "total_return")] + [
        T.StructField(f"{p}_{f}", d) for f in names for p in ("beta", "t", "mean")])
    return g.mapInPandas(solve, schema)


def factor_attribution(exposure: DataFrame, names: list[str], key=("symbol",)) -> DataFrame:
    """beta * mean * n per factor in long form, with the specific remainder."""
    part = lambda f: F.col(f"beta_{f}") * F.col(f"mean_{f}") * F.col("n")
    total = sum((part(f) for f in names[1:]), part(names[0]))
    rows = F.array(*[F.struct(F.lit(f).alias("factor"), part(f).alias("contribution")) for f in names],
                   F.struct(F.lit("specific").alias("factor"), (F.col("total_return") - total).alias("contribution")))
    e = exposure.select(*key, "total_return", F.explode(rows).alias("e")).select(*key, "total_return", "e.*")
    return e.withColumn("pct", safe_div(F.col("contribution"), F.col("total_return"), 0.0))


def equity_factor_model(rets: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """Named betas with the list of factors whose |t| exceeds 2; needs three rows."""
    e = factor_exposure(rets, factors, names, min_rows=3)
    sig = F.array_compact(F.array(*[F.when(F.abs(f"t_{f}") > 2, f) for f in names]))
    return e.select("symbol", "n", "alpha", "r_squared", F.col("residual_vol").alias("idiosyncratic_vol"),
                    *[f"beta_{f}" for f in names], sig.alias("significant"))


def crypto_factor_model(rets: DataFrame, benchmarks: DataFrame, first: str = "btc", second: str = "eth") -> DataFrame:
    """The second benchmark is made orthogonal to the first, then both explain each symbol."""
    fit = benchmarks.agg(F.regr_slope(second, first).alias("_b"), F.regr_intercept(second, first).alias("_a"))
    ortho = with_row(benchmarks, fit).select("ts", first, (
        F.col(second) - F.col("_a") - F.col("_b") * F.col(first)).alias("ortho"))
    e = factor_exposure(rets, ortho, [first, "ortho"], min_rows=3)
    return e.select("symbol", "n", F.col(f"beta_{first}").alias(f"{first}_beta"), F.col("beta_ortho").alias(f"{second}_beta"),
                    "alpha", "r_squared", F.col("residual_vol").alias("idiosyncratic_vol"))

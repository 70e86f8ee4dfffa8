"""Store, journal, screening and ranking queries."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from ..operators import returns as R
from ..operators import store as S
from ..sources import views as V
from .base import query
from .sql import BARS, RETS, TICKS, ctes

BAR_COLS = "symbol exchange interval ts asset_type open:2 high:2 low:2 close:2 volume:2"


@query("bars_table", BAR_COLS, "SELECT * FROM bars", BARS)
def _(spark, d):
    return V.bars(spark, d)


@query("upsert_bars", "symbol ts open:2 close:2 volume:2",
       """SELECT symbol, ts, open, CASE WHEN volume > 150 THEN close*1.01 ELSE close END AS close, volume
          FROM bars""", BARS)
def _(spark, d):
    b = V.bars(spark, d)
    new = b.filter("volume > 150").withColumn("close", F.col("close") * 1.01)
    return S.upsert_bars(b, new)


@query("query_bars", "symbol ts close:2 volume:2",
       """SELECT * FROM bars WHERE "interval"='1w' AND ts >= TIMESTAMP '1996-01-01'
          AND ts <= TIMESTAMP '1999-12-31'""", BARS)
def _(spark, d):
    return S.query_bars(V.bars(spark, d), interval="1w", start="1996-01-01", end="1999-12-31")


@query("list_symbols", "symbol exchange asset_type intervals n_bars first_ts last_ts",
       """SELECT symbol, exchange, asset_type, list_sort(list(DISTINCT "interval")) AS intervals,
          count(*) AS n_bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1,2,3""", BARS)
def _(spark, d):
    return S.list_symbols(V.bars(spark, d))


@query("last_timestamp", "symbol exchange interval last_ts",
       'SELECT symbol, exchange, "interval", max(ts) AS last_ts FROM bars GROUP BY 1,2,3', BARS)
def _(spark, d):
    return S.last_timestamp(V.bars(spark, d))


@query("sql", "symbol n close_avg:2",
       "SELECT symbol, count(*) AS n, avg(close) AS close_avg FROM bars WHERE volume > 10 GROUP BY 1", BARS)
def _(spark, d):
    V.bars(spark, d).createOrReplaceTempView("ohlcv")
    return S.sql(spark, "SELECT symbol, count(*) AS n, avg(close) AS close_avg FROM ohlcv "
                        "WHERE volume > :v GROUP BY symbol", {"v": 10}, guard=True)


@query("export_parquet", "symbol ts close:2 volume:2", "SELECT * FROM bars", BARS)
def _(spark, d):
    out = _folder(spark, "export")
    return S.export_parquet(V.bars(spark, d), out, interval="1w")


@query("import_parquet", "symbol ts close:2 volume:2",
       "SELECT symbol, ts, close, CASE WHEN volume > 150 THEN volume + 1 ELSE volume END AS volume FROM bars",
       BARS)
def _(spark, d):
    b, out = V.bars(spark, d), _folder(spark, "import")
    b.filter("volume > 150").withColumn("volume", F.col("volume") + 1).write.parquet(out)
    return S.import_parquet(b, out)


def _folder(spark, name: str) -> str:
    """A new folder for files a query writes: shared on a cluster, temporary in local runs."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set on this cluster")
        base = tempfile.mkdtemp(prefix="barloom-")
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


@query("count_bars", "n_bars", "SELECT count(*) AS n_bars FROM bars WHERE \"interval\"='1w'", BARS)
def _(spark, d):
    return S.count_bars(V.bars(spark, d), interval="1w")


@query("ingest_exchange_batch", "symbol exchange interval ts close:2 volume:2",
       """SELECT b.symbol, 'sim' AS exchange, '1w' AS "interval", b.ts, b.close, b.volume FROM bars b
          LEFT JOIN (SELECT symbol, max(ts) AS l FROM bars WHERE ts < TIMESTAMP '1998-06-01' GROUP BY 1) s
          USING (symbol) WHERE l IS NULL OR b.ts > l""", BARS)
def _(spark, d):
    b = V.bars(spark, d)
    return S.ingest_exchange_batch(b.filter("ts < '1998-06-01'"), b, "sim", "1w", "stock")


@query("ingest_report", "symbol n_new last_ts",
       """SELECT b.symbol, count(*) AS n_new, max(b.ts) AS last_ts FROM bars b LEFT JOIN (SELECT symbol, max(ts) AS l FROM bars
          WHERE ts < TIMESTAMP '1998-06-01' GROUP BY 1) s USING (symbol) WHERE l IS NULL OR b.ts > l GROUP BY 1""", BARS)
def _(spark, d):
    b = V.bars(spark, d)
    return S.ingest_report(S.ingest_exchange_batch(b.filter("ts < '1998-06-01'"), b, "sim", "1w", "stock"))


@query("ingest_quotes_file", "symbol exchange interval ts asset_type close:2 volume:2",
       """SELECT upper(symbol) AS symbol, 'file' AS exchange, '1w' AS "interval", ts, 'stock' AS asset_type,
          close, CASE WHEN volume > 20 THEN volume ELSE 0 END AS volume
          FROM bars b JOIN (SELECT symbol AS s, max(ts) - INTERVAL 5 YEAR AS lo FROM bars
            WHERE close < 90000 GROUP BY 1) f ON s = symbol
          WHERE close < 90000 AND ts >= lo""", BARS)
def _(spark, d):
    b = V.bars(spark, d)
    landing = b.withColumn("close", F.when(F.col("close") < 90000, F.col("close"))) \
        .withColumn("volume", F.when(F.col("volume") > 20, F.col("volume")))
    return S.ingest_quotes_file(b, landing, "file", "1w")


@query("detect_asset_type", "symbol kind n",
       """SELECT symbol, CASE WHEN symbol LIKE '%-USD%' THEN 'crypto' WHEN symbol = 'SPY' THEN 'etf'
          WHEN symbol LIKE '^%' THEN 'index' ELSE 'stock' END AS kind, count(*) AS n FROM (
          SELECT CASE p_size % 4 WHEN 0 THEN p_type || '-USD' WHEN 1 THEN 'SPY' WHEN 2 THEN '^' || p_type
           ELSE p_type END AS symbol FROM part) GROUP BY ALL""")
def _(spark, d):
    k = F.col("p_size") % 4
    p = V.table(spark, d, "part").select(
        F.when(k == 0, F.concat("p_type", F.lit("-USD"))).when(k == 1, "SPY")
        .when(k == 2, F.concat(F.lit("^"), "p_type")).otherwise(F.col("p_type")).alias("symbol"))
    return p.groupBy("symbol", S.detect_asset_type(F.col("symbol")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"))


@query("trades_to_1s_bars", "symbol bar_ts interval open:4 high:4 low:4 close:4 volume:2 n_trades",
       """SELECT symbol, date_trunc('second', ts) AS bar_ts, '1s' AS "interval",
          arg_min(price, ROW(ts, seq)) AS open, max(price) AS high, min(price) AS low,
          arg_max(price, ROW(ts, seq)) AS close, sum(volume) AS volume, count(*) AS n_trades
          FROM ticks GROUP BY 1,2""", TICKS)
def _(spark, d):
    return S.trades_to_1s_bars(V.ticks(spark, d))


@query("merge_cache_delta", "symbol ts close:2",
       """SELECT symbol, ts, close FROM (SELECT symbol, ts,
            CASE WHEN ts < TIMESTAMP '1999-06-01' THEN close ELSE close*2 END AS close,
            row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= 200""", BARS)
def _(spark, d):
    b = V.bars(spark, d)
    fresh = b.filter("ts >= '1999-01-01'").withColumn("close", F.col("close") * 2)
    return S.merge_cache_delta(b.filter("ts < '1999-06-01'"), fresh, 200)


FILL_COLS = "id exchange symbol side amount:2 price:2 cost:2 fee:2 ts order_id strategy"


@query("journal_table", FILL_COLS, "SELECT * FROM fills", ctes("fills"))
def _(spark, d):
    return V.fills(spark, d)


@query("journal_upsert", "id exchange cost:2 fee:2",
       """SELECT id, exchange, max(cost) AS cost, CASE WHEN max(amount) > 25 THEN 0 ELSE max(fee) END AS fee
          FROM fills GROUP BY 1,2""", ctes("fills"))
def _(spark, d):
    f = V.fills(spark, d)
    return S.journal_upsert(f, f.filter("amount > 25").withColumn("fee", F.lit(0.0)))


@query("journal_query", FILL_COLS,
       "SELECT * FROM fills WHERE side='buy' AND ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1998-12-31'",
       ctes("fills"))
def _(spark, d):
    return S.journal_query(V.fills(spark, d), start="1997-01-01", end="1998-12-31", side="buy")


@query("returns_series", "symbol ts ret:6", "SELECT symbol, ts, ret FROM rets", RETS)
def _(spark, d):
    return R.returns_series(V.bars(spark, d))


XS = """SELECT symbol, value, row_number() OVER (ORDER BY value DESC, symbol) AS rank,
   CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE
     1 - (row_number() OVER (ORDER BY value DESC, symbol) - 1) / (count(*) OVER () - 1) END AS percentile,
   CAST(least(5, ceil(row_number() OVER (ORDER BY value DESC, symbol) / (count(*) OVER () / 5))) AS BIGINT)
     AS quintile FROM ({}) v"""
LOOK = "lk AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 365 DAY)"


@query("cross_sectional_sort", "symbol value:6 rank percentile:6 quintile",
       XS.format("SELECT symbol, stddev_samp((close-p)/p) AS value FROM lk WHERE p <> 0 GROUP BY 1 "
                 "HAVING count(*) >= 2"), ctes("bars", more=LOOK))
def _(spark, d):
    return R.cross_sectional_sort(V.bars(spark, d), "volatility")


@query("cross_sectional_momentum", "symbol value:6 rank percentile:6 quintile",
       XS.format("SELECT symbol, (arg_max(close, ts)-arg_min(close, ts))/arg_min(close, ts) AS value FROM lk "
                 "GROUP BY 1 HAVING count(*) >= 2"), ctes("bars", more=LOOK))
def _(spark, d):
    return R.cross_sectional_sort(V.bars(spark, d), "momentum")


@query("rank_buckets", "symbol value:4 rank percentile:6 quintile",
       XS.format("SELECT symbol, avg(volume) AS value FROM bars GROUP BY 1"), BARS)
def _(spark, d):
    v = V.bars(spark, d).groupBy("symbol").agg(F.avg("volume").alias("value"))
    return R.rank_buckets(v, ("symbol",))


@query("screen_universe", "symbol m0:4 m1:6 m2:6",
       """SELECT symbol, avg(volume) AS m0, stddev_samp((close-p)/p) FILTER (ts >= mx - INTERVAL 180 DAY) AS m1,
          arg_max(close, ts)/arg_min(close, ts)-1 AS m2
          FROM (SELECT *, (SELECT max(ts) FROM bars) AS mx FROM lk) GROUP BY 1
          HAVING count(p) >= 2 AND avg(volume) > 100
          AND stddev_samp((close-p)/p) FILTER (ts >= mx - INTERVAL 180 DAY) > 0.2
          AND arg_max(close, ts)/arg_min(close, ts)-1 > -0.9""", ctes("bars", more=LOOK))
def _(spark, d):
    return R.screen_universe(V.bars(spark, d), [("avg_volume", ">", 100, 365), ("volatility", ">", 0.2, 180),
                                                ("return", ">", -0.9, 365)], limit=None)


@query("rolling_returns", "symbol ts ret_1:6 ret_5:6 ret_20:6",
       """SELECT symbol, ts, close/lag(close,1) OVER w - 1 AS ret_1, close/lag(close,5) OVER w - 1 AS ret_5,
          close/lag(close,20) OVER w - 1 AS ret_20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
       BARS)
def _(spark, d):
    return R.rolling_returns(V.bars(spark, d))


@query("pct_change_windows", "symbol chg_1:6 chg_5:6 chg_20:6",
       """SELECT symbol, max(close) FILTER (k=1)/max(close) FILTER (k=2)-1 AS chg_1,
          max(close) FILTER (k=1)/max(close) FILTER (k=6)-1 AS chg_5,
          max(close) FILTER (k=1)/max(close) FILTER (k=21)-1 AS chg_20 FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) GROUP BY 1""", BARS)
def _(spark, d):
    return R.pct_change_windows(V.bars(spark, d))


@query("momentum_score", "symbol chg_1:2 chg_5:2 chg_10:2 chg_20:2 surge:2 score:2 rank",
       """SELECT *, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM (
       SELECT *, floor((.1*chg_1+.2*chg_5+.3*chg_10+.2*chg_20+.2*(surge-1)*100)*100+.5)/100 AS score FROM (
       SELECT symbol, floor((c1/c2-1)*10000+.5)/100 AS chg_1, floor((c1/c6-1)*10000+.5)/100 AS chg_5,
         floor((c1/c11-1)*10000+.5)/100 AS chg_10, floor((c1/c21-1)*10000+.5)/100 AS chg_20,
         floor(v5/v20*100+.5)/100 AS surge FROM (
       SELECT symbol, max(close) FILTER (k=1) c1, max(close) FILTER (k=2) c2, max(close) FILTER (k=6) c6,
        max(close) FILTER (k=11) c11, max(close) FILTER (k=21) c21, avg(volume) FILTER (k<=5) v5,
        avg(volume) FILTER (k BETWEEN 6 AND 25) v20, count(*) n FROM (
          SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) GROUP BY 1)
       WHERE n >= 21))""", BARS)
def _(spark, d):
    return R.momentum_score(V.bars(spark, d))


@query("spread_monitor", "venue symbol bid:4 ask:4 spread:4 spread_bps:4",
       """SELECT *, ask-bid AS spread, (ask-bid)/((bid+ask)/2)*10000 AS spread_bps FROM (
          SELECT venue, symbol, arg_max(bid, ts) AS bid, arg_max(ask, ts) AS ask FROM quotes GROUP BY 1,2)""",
       ctes("quotes"))
def _(spark, d):
    return R.spread_monitor(V.quotes(spark, d))


@query("downsample_series", "symbol ts close:2 rn",
       """SELECT symbol, ts, close, rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) rn,
          count(*) OVER (PARTITION BY symbol) n FROM bars)
          WHERE n <= 50 OR (rn-1) % CAST(ceil(n/50) AS BIGINT) = 0 OR rn = n""", BARS)
def _(spark, d):
    return R.downsample_series(V.bars(spark, d), 50)

"""Shared WITH clauses of the expected-result SQL."""

from __future__ import annotations

_BARS = """bars AS MATERIALIZED (
 SELECT p_brand AS symbol, 'sim' AS exchange, '1w' AS "interval", date_trunc('week', l_shipdate) AS ts,
  'stock' AS asset_type,
  arg_min(l_extendedprice/l_quantity, ROW(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_suppkey)) AS open,
  max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
  arg_max(l_extendedprice/l_quantity, ROW(l_shipdate,l_orderkey,l_linenumber,l_partkey,l_suppkey)) AS close,
  sum(l_quantity) AS volume
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
_RETS = """b0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev,
  row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
  count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 rets AS MATERIALIZED (SELECT *, (close-prev)/prev AS ret FROM b0 WHERE prev IS NOT NULL AND prev <> 0)"""
_TICKS = """ticks AS MATERIALIZED (
 SELECT event_type AS symbol, 'v' || (user_id % 4) AS venue, ts, event_id AS seq, 100.0 + value AS price,
  1.0 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
  CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, user_id % 3 = 0 AS is_maker,
  CAST(0.0005 AS DOUBLE) * (1 + user_id % 4) AS fee FROM events)"""
_QUOTES = """quotes AS MATERIALIZED (
 SELECT venue, symbol, date_trunc('hour', ts) AS ts, min(price) AS bid, max(price) AS ask,
  sum(volume) FILTER (side='buy') AS bid_qty, sum(volume) FILTER (side='sell') AS ask_qty, min(fee) AS fee
 FROM ticks GROUP BY 1,2,3)"""
_BOOK = """bk0 AS (SELECT venue, symbol, date_trunc('hour', ts) AS ts, price, sum(volume) AS qty
  FROM ticks GROUP BY 1,2,3,4),
 bk1 AS (SELECT *, CASE WHEN price < avg(price) OVER (PARTITION BY venue, symbol, ts) THEN 'bid' ELSE 'ask' END
  AS side FROM bk0),
 book AS MATERIALIZED (SELECT venue, symbol, ts, side, row_number() OVER (PARTITION BY venue, symbol, ts, side
  ORDER BY CASE WHEN side='bid' THEN -price ELSE price END) AS level, price, qty FROM bk1)"""
_FILLS = """fills AS (
 SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS exchange,
  l_linestatus AS symbol, CASE WHEN l_linenumber % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  l_quantity AS amount, l_extendedprice/l_quantity AS price, l_extendedprice AS cost,
  l_extendedprice*l_tax AS fee, l_shipdate AS ts, CAST(l_orderkey AS VARCHAR) AS order_id,
  o_orderpriority AS strategy, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_POS = """positions AS (SELECT c_nationkey AS account, c_mktsegment AS symbol, sum(c_acctbal) AS qty,
  count(*) AS n_accounts, avg(c_acctbal) AS avg_balance FROM customer GROUP BY 1,2)"""
_CHARS = """chars AS (SELECT p_brand AS symbol, sum(p_retailprice) AS market_cap, avg(p_size) AS book_to_market,
  avg(length(p_name)) AS profitability, avg(p_retailprice/(1+p_size)) AS investment, 'S' || (count(*) % 3) AS sector
  FROM part GROUP BY 1)"""

_ALL = {"bars": [_BARS], "rets": [_BARS, _RETS], "ticks": [_TICKS], "quotes": [_TICKS, _QUOTES],
        "book": [_TICKS, _BOOK], "fills": [_FILLS], "positions": [_POS], "chars": [_CHARS]}


def ctes(*names: str, more: str = "", recursive: bool = False) -> str:
    seen: list[str] = []
    for n in names:
        for part in _ALL[n]:
            if part not in seen:
                seen.append(part)
    if more:
        seen.append(more.strip().rstrip(","))
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n ".join(seen)


BARS, RETS, TICKS = ctes("bars"), ctes("rets"), ctes("ticks")

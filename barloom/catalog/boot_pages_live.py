"""Bootstrap, page and streaming-form queries (streaming operators run here in batch over the same rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import pages as G
from ..sources import views as V
from ..streaming import live as L
from .base import query
from .sql import TICKS, ctes
from .stats import rets

NR = """nr AS MATERIALIZED (SELECT symbol, ts, ret, row_number() OVER w-1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets
   WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def _draw(counters: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {counters})), 1, 15) AS BIGINT)"


def _paths(sims: int, steps: str) -> str:
    """Drawn returns of every simulation and step."""
    return NR + f""", sp AS MATERIALIZED (SELECT d.symbol, sim, step, ret FROM (SELECT symbol, sim, step, {_draw("42, sim, step, symbol, 'sim', '1w'")} % n AS i
   FROM (SELECT symbol, sim, n, unnest(range(0, {steps})) AS step FROM (SELECT symbol, max(n) AS n FROM nr GROUP BY 1), range(0, {sims}) t(sim))) d
   JOIN nr ON nr.symbol=d.symbol AND nr.i=d.i)"""


query("bootstrap_var", "symbol var_95:6 cvar_95:6 var_99:6 cvar_99:6",
      """SELECT symbol, -q95 AS var_95, -list_avg(list_filter(l, lambda x: x<=q95)) AS cvar_95, -q99 AS var_99, -list_avg(list_filter(l, lambda x: x<=q99))
         AS cvar_99 FROM (SELECT symbol, l, l[26] AS q95, l[6] AS q99 FROM (SELECT symbol, list_sort(list(r)) AS l FROM (
          SELECT symbol, sim, product(1+ret)-1 AS r FROM sp GROUP BY 1, 2) GROUP BY 1))""", ctes("rets", more=_paths(500, "5")))(
    lambda s, d: B.bootstrap_var(rets(s, d), 500, 5))
query("bootstrap_ci", "symbol estimate:6 lower:6 upper:6 standard_error:6",
      """SELECT symbol, estimate, l[2] AS lower, l[49] AS upper, list_stddev_samp(l) AS standard_error FROM (SELECT symbol, list_sort(list(x)) AS l FROM (
          SELECT symbol, sim, avg(ret)/stddev_samp(ret)*sqrt(365) AS x FROM sp GROUP BY 1, 2) GROUP BY 1) JOIN (
         SELECT symbol, avg(ret)/stddev_samp(ret)*sqrt(365) AS estimate FROM rets GROUP BY 1) USING (symbol)""", ctes("rets", more=_paths(50, "n")))(
    lambda s, d: B.bootstrap_ci(rets(s, d), "sharpe", 50))
query("bootstrap_drawdown", "symbol expected_drawdown:6 ruin_probability:6 dd_95:6 dd_99:6",
      """SELECT symbol, avg(x) AS expected_drawdown, avg(CASE WHEN x>=.2 THEN 1.0 ELSE 0 END) AS ruin_probability, quantile_cont(x, .95) AS dd_95,
         quantile_cont(x, .99) AS dd_99 FROM (SELECT symbol, sim, max(1-v/greatest(1, pk)) AS x FROM (SELECT *, max(v) OVER (PARTITION BY symbol, sim
          ORDER BY step) AS pk FROM (SELECT *, exp(sum(ln(1+ret)) OVER (PARTITION BY symbol, sim ORDER BY step)) AS v FROM sp)) GROUP BY 1, 2) GROUP BY 1""",
      ctes("rets", more=_paths(50, "60")))(lambda s, d: B.bootstrap_drawdown(rets(s, d), 50, 60))
query("bootstrap_scenarios", "scenario symbol ts ret:6",
      f"""SELECT scenario, symbol, r.ts, ret FROM (SELECT scenario, {_draw("42, scenario")} % (SELECT count(*) FROM st) AS i FROM range(0, 200) t(scenario))
         JOIN st USING (i) JOIN rets r ON r.ts=st.ts""",
      ctes("rets", more="""st AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY ts)-1 AS i FROM (SELECT ts FROM rets GROUP BY 1 HAVING
       count(DISTINCT symbol)=(SELECT count(DISTINCT symbol) FROM rets)))"""))(lambda s, d: B.bootstrap_scenarios(rets(s, d), 200))

_RX = {k: [p.replace("'", "''") for p in v] for k, v in G.PATTERNS.items()}


def _clean(x: str) -> str:
    x = f"trim(regexp_replace({x}, '<!\\[CDATA\\[|\\]\\]>', '', 'g'))"
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _pick(name: str) -> str:
    parts = [f"CASE WHEN regexp_extract(html, '{p}', 1)<>'' THEN {_clean(f'regexp_extract(html, {chr(39)}{p}{chr(39)}, 1)')} END" for p in _RX[name]]
    return f"coalesce({', '.join(parts)}) AS {name}"


query("page_metadata", "page_id url title author published_at", f"SELECT page_id, url, {', '.join(_pick(k) for k in _RX)} FROM pages")(
    lambda s, d: G.page_metadata(V.table(s, d, "pages")))
_PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
query("page_filter", "page_id url_norm is_article",
      f"""SELECT page_id, regexp_replace(url, '#.*$', '') AS url_norm, ({' OR '.join(f"contains({_PATH}, '{h}')" for h in G.HINTS)}) AND NOT
         regexp_matches({_PATH}, '{G.DENY}') AS is_article FROM pages""")(lambda s, d: G.page_filter(V.table(s, d, "pages")))


def feeds(s, d):
    """One feed per page: its url, title and text as an RSS item (even ids) or an Atom entry (odd ids)."""
    p = G.page_metadata(V.table(s, d, "pages"))
    t = F.coalesce("title", F.lit(""))
    esc = F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    rss = F.concat(F.lit("<rss><channel><item><title>"), esc, F.lit("</title><link>"), url, F.lit("#top</link><pubDate>2024-01-0"),
                   (F.col("page_id") % 9 + 1).cast("string"), F.lit("</pubDate><dc:creator><![CDATA[desk]]></dc:creator></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>"), esc, F.lit("</title><link rel=\"self\" href=\""), url, F.lit("\"/><updated>2024-02-0"),
                    (F.col("page_id") % 9 + 1).cast("string"), F.lit("</updated><author><name>desk</name></author></entry></feed>"))
    return p.select("page_id", F.concat(F.lit("s"), F.col("page_id") % 5).alias("source"),
                    F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("xml"))


FEED = f"""pg AS (SELECT page_id, url, coalesce(title, '') AS title FROM (SELECT *, {_pick('title')} FROM pages)),
 fi AS (SELECT page_id, 's'||(page_id%5) AS source, regexp_replace(url, '#.*$', '') AS url, trim(title) AS title, CASE WHEN page_id%2=0 THEN '2024-01-0' ELSE '2024-02-0' END||(page_id%9+1)
   AS published_at, 'desk' AS author FROM pg)"""
query("feed_items", "page_id source url title author published_at", "SELECT * FROM fi", "WITH " + FEED)(
    lambda s, d: G.feed_items(feeds(s, d), 10))
query("article_dedupe", "source url seq",
      """SELECT source, url, page_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page_id) AS k FROM (SELECT * FROM fi QUALIFY
         row_number() OVER (PARTITION BY url ORDER BY page_id)=1)) WHERE k<=30""", "WITH " + FEED)(
    lambda s, d: G.article_dedupe(G.feed_items(feeds(s, d), 10).select(
        "source", "url", F.col("page_id").alias("seq"), F.to_timestamp("published_at").alias("published_ts")), 30))
query("source_counts", "source n", "SELECT source, count(*) AS n FROM fi GROUP BY 1", "WITH " + FEED)(
    lambda s, d: G.source_counts(G.feed_items(feeds(s, d), 10)))

query("live_snapshot", "symbol ts seq price:4 volume:2 side n_trades",
      """SELECT symbol, max(ts) AS ts, arg_max(seq, ROW(ts, seq)) AS seq, arg_max(price, ROW(ts, seq)) AS price, arg_max(volume, ROW(ts, seq)) AS volume,
         arg_max(side, ROW(ts, seq)) AS side, count(*) AS n_trades FROM ticks GROUP BY 1""", TICKS)(lambda s, d: L.latest_snapshot(V.ticks(s, d)))


def nested_books(s, d):
    b = V.book_levels(s, d)
    side = lambda x: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == x, F.struct("level", "price", "qty")))),
                                 lambda r: F.struct(r.price.alias("price"), r.qty.alias("size")))
    return b.groupBy("venue", "symbol", "ts").agg(side("bid").alias("bids"), side("ask").alias("asks"))


query("book_stream", "symbol ts best_bid:4 best_ask:4 mid:4 spread:4 spread_bps:2",
      """SELECT symbol, ts, b AS best_bid, a AS best_ask, (a+b)/2 AS mid, a-b AS spread, floor((a-b)/((a+b)/2)*1e6+.5)/100 AS spread_bps FROM (SELECT venue, symbol, ts,
         max(price) FILTER (side='bid') AS b, min(price) FILTER (side='ask') AS a FROM book GROUP BY 1,2,3)""", ctes("book"))(
    lambda s, d: L.book_view(nested_books(s, d)))
query("trade_stream", "symbol ts open:4 high:4 low:4 close:4 volume:2",
      """SELECT symbol, date_trunc('second', ts) AS ts, arg_min(price, ROW(ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, ROW(ts, seq)) AS
         close, sum(volume) AS volume FROM ticks GROUP BY 1, 2""", TICKS)(lambda s, d: L.second_bars(L.trade_stream(V.ticks(s, d))))
query("last_trades", "symbol ts seq price:4 volume:2 side",
      """SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC)<=100""", TICKS)(
    lambda s, d: L.last_trades(V.ticks(s, d), 100))
query("toxicity_windows", "symbol ts toxicity:6",
      """SELECT symbol, w AS ts, CASE WHEN v>0 THEN abs(2*b-v)/v ELSE 0 END AS toxicity FROM (SELECT symbol, w, sum(CASE WHEN side='buy' THEN volume
         ELSE 0 END) AS b, sum(volume) AS v FROM (SELECT *, time_bucket(INTERVAL 10 SECOND, ts)-to_seconds(10*k) AS w FROM ticks, range(0, 6) t(k))
         GROUP BY 1, 2)""", TICKS)(lambda s, d: L.toxicity_windows(L.trade_stream(V.ticks(s, d))))
query("iceberg_sessions", "symbol side price:4 fills size:2 start end_ts",
      """SELECT symbol, side, avg(price) AS price, count(*) AS fills, sum(volume) AS size, min(ts) AS start, max(ts)+INTERVAL 6 HOUR AS end_ts FROM (
          SELECT *, sum(new) OVER (PARTITION BY symbol, side, band ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN
           ts-lag(ts) OVER (PARTITION BY symbol, side, band ORDER BY ts, seq)<=INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM (
           SELECT *, floor(ln(price)/.005) AS band FROM ticks))) GROUP BY symbol, side, band, run HAVING count(*)>=3""", TICKS)(
    lambda s, d: L.iceberg_sessions(L.trade_stream(V.ticks(s, d)), 0.005, "6 hours").withColumnRenamed("end", "end_ts"))

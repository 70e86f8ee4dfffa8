"""Article pages and feeds: metadata, path filter, feed items, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_META = r"""(?i)<meta[^>]+{attr}=["']{name}["'][^>]+content=["']([^"']+)["'][^>]*>"""
# Patterns tried in this order for each field.
PATTERNS = {
    "title": (_META.format(attr="property", name="og:title"), _META.format(attr="name", name="twitter:title"),
              r"(?i)<title[^>]*>([^<]+)</title>"),
    "author": (_META.format(attr="name", name="author"), _META.format(attr="property", name="article:author"),
               r'(?i)"author"\s*:\s*\{\s*"name"\s*:\s*"([^"]+)"'),
    "published_at": (_META.format(attr="property", name="article:published_time"), _META.format(attr="name", name="date"),
                     r"""(?i)<time[^>]+datetime=["']([^"']+)["'][^>]*>"""),
}
# Path parts of articles and endings that are never articles.
HINTS = ("/what-is/", "/news/", "/blog/", "/learn/", "/academy/", "/research/", "/articles/")
DENY = r"(?i)(^|/)sitemap(-|\.|$)|\.(xml|jpg|jpeg|png|webp|gif|svg|js|css|ico)$"


def clean_text(x: Column) -> Column:
    """Drop CDATA marks, trim, decode the five basic entities."""
    x = F.trim(F.regexp_replace(x, r"<!\[CDATA\[|\]\]>", ""))
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def first_match(html: Column, patterns) -> Column:
    hit = [F.regexp_extract(html, p, 1) for p in patterns]
    return F.coalesce(*[F.when(h != "", clean_text(h)) for h in hit])


def page_metadata(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, author and publication date by the first pattern that matches the whole page."""
    return pages.withColumns({name: first_match(F.col(html), p) for name, p in PATTERNS.items()})


def normal_url(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def page_filter(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds the normalised url and whether its path looks like an article."""
    path = F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    hint = F.lit(False)
    for h in HINTS:
        hint = hint | path.contains(h)
    return pages.withColumn("url_norm", normal_url(F.col(url))).withColumn("is_article", hint & ~path.rlike(DENY))


def _tag(x: Column, tag: str) -> Column:
    m = F.regexp_extract(x, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.when(F.regexp_like(x, F.lit(rf"(?is)<{tag}[^>]*>.*?</{tag}>")), clean_text(m))


def feed_items(feeds: DataFrame, max_items: int, xml: str = "xml", source: str = "source") -> DataFrame:
    """RSS items, or Atom entries where a feed has no item, up to ``max_items`` per feed."""
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)(<item\b.*?</item>)"), 1)
    entries = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)(<entry\b.*?</entry>)"), 1)
    f = feeds.withColumn("_rss", F.size(items) > 0).withColumn("_i", F.slice(F.when(F.size(items) > 0, items).otherwise(entries), 1, max_items))
    e = f.select(*[c for c in feeds.columns if c != xml], "_rss", F.posexplode("_i").alias("pos", "x"))
    x, rss = F.col("x"), F.col("_rss")
    href = F.regexp_extract(x, r"""(?i)<link[^>]+href=["']([^"']+)["'][^>]*>""", 1)
    link = _tag(x, "link")
    url = F.when(rss, link).otherwise(F.coalesce(F.when(href != "", clean_text(href)), link))
    author = F.when(rss, F.coalesce(_tag(x, "author"), _tag(x, "dc:creator"))).otherwise(F.coalesce(_tag(x, "name"), _tag(x, "author")))
    when = F.when(rss, _tag(x, "pubDate")).otherwise(F.coalesce(_tag(x, "updated"), _tag(x, "published")))
    out = e.withColumn("url", normal_url(url)).withColumn("title", _tag(x, "title")).withColumn("author", author).withColumn(
        "published_at", when)
    return out.filter(F.col("url").isNotNull() & (F.col("url") != "")).drop("x", "_rss")


def article_dedupe(articles: DataFrame, per_source: int, limit: int | None = None, order: str = "seq") -> DataFrame:
    """First seen url wins, at most ``per_source`` per source, newest first. Columns: source, url, published_ts, order."""
    rest = [c for c in articles.columns if c != "url"]
    one = articles.groupBy("url").agg(F.min_by(F.struct(*rest), order).alias("r")).select("url", *[F.col(f"r.{c}").alias(c) for c in rest])
    w = Window.partitionBy("source").orderBy(order)
    q = one.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_source).drop("_k")
    q = q.orderBy(F.col("published_ts").desc_nulls_last(), order)
    return q.limit(limit) if limit else q


def source_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count(F.lit(1)).alias("n"))

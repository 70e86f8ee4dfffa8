"""URL rules: a blocked Bloom filter of the listed canonical keys lets possible hits through to an exact join.

Spark SQL functions only.  A rule (host, path) fits its host and all
subdomains if the path starts with the rule's; its key is host and path put
together.  A URL has one candidate key per host suffix (up to the most labels
of any rule) and per path length that some rule has, so every fitting rule's
key is among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh

FILTER_WORDS = 1 << 14          # 64-bit blocks of the filter: 128 KB whatever the list's size
_BITS = 5                       # bits set per key, all in one block


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: str, words: int) -> str:
    return f"cast(pmod(xxhash64({key}), {words}) as int)"


def _mask(key: str) -> str:
    bits = [f"shiftleft(1L, cast(shiftright(xxhash64({key}, 1), {6 * i}) & 63 as int))" for i in range(_BITS)]
    return "(" + " | ".join(bits) + ")"


def bloom(keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """One row with the filter of column ``key`` as an array of ``words`` longs."""
    blocks = keys.groupBy(F.expr(_block("key", words)).alias("block")).agg(F.expr(f"bit_or{_mask('key')}").alias("word"))
    return (blocks.agg(F.map_from_entries(F.collect_list(F.struct("block", "word"))).alias("m"))       # ``words`` entries at most
            .select(F.expr(f"transform(sequence(0, {words - 1}), i -> coalesce(m[i], 0L))").alias("filter")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", words: int = FILTER_WORDS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (input columns of these names are replaced).

    ``rules`` has ``host``, ``path``, ``verdict``; the longest fitting rule
    decides, between equally long ones the greater key, for one key listed
    both ways ``block``.  A URL without a fitting rule (a null one, one without
    ``://``) gets a null rule and ``default``.  Repeated rows stay repeated.
    Distinct URLs are judged once; only keys that the filter lets through reach
    the join with ``rules``, and false positives end there.  More rules than
    the filter has room for cost time, not correctness.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    key = F.concat(F.col("host"), F.col("path"))
    listed = (rules.select(F.lower("host").alias("host"), "path", "verdict").select("*", key.alias("key"))
              .groupBy("key").agg(F.max("verdict").alias("verdict"), F.first("path").alias("path"), F.first("host").alias("host")))
    shape = listed.agg(F.collect_set(F.length("path")).alias("lengths"),          # as many as URL lengths, at most
                       F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels")).first()
    u = fresh(pages, "judged_url")[0]
    urls = pages.select(F.col(f"`{url}`").cast("string").alias(u)).filter(F.col(u).contains("://")).distinct()
    parts = urls.select(u, host_of(F.col(u)).alias("host"), path_of(F.col(u)).alias("path"))
    labels = F.split("host", r"\.")
    tail = F.slice(labels, F.greatest(F.size(labels) - shape.labels + 1, F.lit(1)), max(shape.labels, 1))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("tail")), lambda i: F.concat_ws(".", F.slice("tail", i, F.size("tail"))))
    lengths = F.array(*[F.lit(n) for n in sorted(shape.lengths)]) if shape.lengths else F.array().cast("array<int>")
    cand = (parts.withColumn("tail", tail).select(u, "path", F.explode(suffixes).alias("suffix"))
            .select(u, "path", "suffix", F.explode(lengths).alias("n")).filter(F.col("n") <= F.length("path"))
            .select(u, F.concat("suffix", F.expr("substring(path, 1, n)")).alias("key")))
    blocks, mask = bloom(listed, words).scalar(), F.expr(_mask("key"))
    hits = cand.filter(F.element_at(blocks, F.expr(_block("key", words)) + 1).bitwiseAND(mask) == mask)
    best = (hits.join(listed.select("key", F.col("verdict").alias("v")), "key")
            .groupBy(u).agg(F.max(F.struct(F.length("key").alias("n"), "key", "v")).alias("best")))
    out = pages.withColumn(u, F.col(f"`{url}`").cast("string")).join(best, u, "left")
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], host_of(F.col(u)).alias("host"), path_of(F.col(u)).alias("path"),
                      F.col("best.key").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))

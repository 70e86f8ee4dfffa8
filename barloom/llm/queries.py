"""Registered queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (bpe, exact_dedup, language, line_dedup, packing, quality, runs, sharding, simhash, subspace, trie,
                         url_filter, wavelet)
from barloom.llm.common import documents, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_wavelet_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into wavelet-matrix shards, then read every document back from the files."""
    path = wavelet.write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read_shards(spark, path)


@query("op10_rank_queue_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents by the multilingual rank file."""
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                          public_tokenizers.PATTERN)


@query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    return exact_dedup.classes(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op5_external_shuffle")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shuffled shards with equal row counts, reported from the written files."""
    return sharding.placement(documents(spark, sf_dir))


#: The rules of the filter.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op8_url_rules", """
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')) ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT DISTINCT url, first_value(h || p) OVER w AS rule, first_value(v) OVER w AS v FROM parts JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  WINDOW w AS (PARTITION BY url ORDER BY length(h || p) DESC))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.url IS NOT DISTINCT FROM fits.url
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the fixed rules; URLs that no rule fits are not listed, hence allowed."""
    rules = spark.sql("VALUES " + ", ".join(str(r) for r in URL_RULES) + " AS t(host, path, verdict)")
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)\
        .select("page_id", "host", "path", "rule", "verdict")


@query("op4_simhash_pigeonhole")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, links at 4 or fewer differing bits."""
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op7_subspace_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return subspace.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op3_nnls_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op9_kneser_ney_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by models of the documents that are not held out."""
    docs = documents(spark, sf_dir)
    marks = language.predict(docs, language.fit_on_training_rows(docs))
    return marks.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query("op6_patience_lines")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat in aligned blocks of an earlier one: what goes and what stays."""
    out = line_dedup.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", F.size("deleted").alias("n_deleted"), "deleted",
                      F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))


@query("op11_prefix_trie", """
WITH numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx,
         sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS t, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
                                    lambda c, k: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)),
turns AS (
  SELECT c.conv_id, 0 AS part, n.idx, n.t, n.bytes FROM heads c JOIN numbered n ON n.conv_id = c.base AND n.idx < c.h
  UNION ALL
  SELECT c.conv_id, 1, n.idx, n.t, n.bytes FROM heads c JOIN numbered n ON n.conv_id = c.conv_id AND n.idx >= c.h),
lists AS (
  SELECT h.conv_id, list(t ORDER BY part, idx) FILTER (t IS NOT NULL) AS ts, list(bytes ORDER BY part, idx) FILTER (t IS NOT NULL) AS bs
  FROM heads h LEFT JOIN turns USING (conv_id) GROUP BY h.conv_id),
paths AS (
  SELECT conv_id, d, coalesce(len(ts), 0) AS n, sha256(array_to_string(ts[1:d], ',')) AS k,
         sha256(array_to_string(ts[1:d-1], ',')) AS up, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(0, coalesce(len(ts), 0) + 1)) AS d FROM (SELECT conv_id, coalesce(ts, []) AS ts, coalesce(bs, []) AS bs FROM lists))),
nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS cost,
         count(*) FILTER (n > d) = 0 AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM paths GROUP BY d, k),
below AS (
  SELECT p.d, p.k, sum(v.leaf::BIGINT) AS n_leaves, sum(v.cost) AS saved
  FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY p.d, p.k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, v.ends_sha256
FROM nodes v JOIN below b ON b.d = v.d AND b.k = v.k LEFT JOIN nodes u ON u.d = v.d - 1 AND u.k = v.up AND v.d > 0
LEFT JOIN kids c ON c.d = v.d AND c.k = v.k
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, each led by turns of the first one of its five."""
    return trie.prefix_trie(*trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query("op12_ftrl_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by weights learnt from labelled documents that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scores(docs, weights).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def tandem(text: Column, h: Column) -> Column:
    """The words of ``text``, from one on repeated with a period, as the hash ``h`` says; words joined by one space."""
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def repeat(ws: Column) -> Column:
        n = F.greatest(F.size(ws), F.lit(1)).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int"))))

    return F.concat_ws(" ", F.get(F.transform(F.array(words), repeat), F.lit(0)))


@query("op13_maximal_pair_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, of which a tenth are made to repeat first."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("text", F.when(h % 10 == 0, tandem(F.col("text"), h)).otherwise(F.col("text")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return runs.collapse(docs).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))

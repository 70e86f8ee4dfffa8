"""Two-pass external shuffle: scatter to memory-sized buckets by a seeded hash, shuffle each bucket, write shards.

Everything is a DataFrame operation: ``shuffle`` over a bucket's records is a
Fisher-Yates pass with a seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import work_path, words_of

BUCKET_BYTES = 16 << 20
_GROUP = 1024


def running_offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """``key, offset``: sums of ``n`` over smaller keys, in two levels so that no task sees all keys."""
    c = counts.withColumn("_g", F.floor(F.col(key) / _GROUP))
    groups = (c.groupBy("_g").agg(F.sum(n).alias("_n"))
              .withColumn("_before", F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)))
              .select("_g", F.coalesce("_before", F.lit(0)).alias("_before")))
    inside = F.sum(n).over(Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return (c.withColumn("_in", F.coalesce(inside, F.lit(0))).join(groups, "_g")
            .select(key, (F.col("_before") + F.col("_in")).alias("offset")))


def write_shards(docs: DataFrame, shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES,
                 doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> str:
    """Write ``docs`` in a seeded random order into ``shards`` folders whose row counts differ by at most one.

    The files hold ``slot`` (gapless from 0 per shard), ``record`` (all columns
    of the input, so no name can clash) and the folder column ``shard``.  A
    record's bucket is a seeded hash of its id and text, whatever its source or
    its copies; a bucket of about ``bucket_bytes`` of text is put in a fixed
    order, then shuffled, and its place in the whole order is the count of the
    buckets before.  Null ids and texts are values like others, repeated rows
    stay repeated; an empty table writes no file.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "shards")
    size = F.octet_length(words_of(F.col(text).cast("string")))
    total, n = docs.agg(F.coalesce(F.sum(size + 1), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-total // bucket_bytes))
    tie = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text).cast("string"))
    bucket = F.pmod(tie, F.lit(buckets))
    counts = docs.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(bucket.alias("bucket"), F.struct(tie.alias("tie"), F.col(doc_id).alias("id"),
                                                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")).alias("r"))

    def order(a, b):
        return (F.when(a["tie"] < b["tie"], -1).when(a["tie"] > b["tie"], 1).otherwise(0))

    position = F.col("offset") + F.col("pos")
    shard = F.expr(f"(offset + pos) * {shards} div {max(n, 1)}")
    placed = (rows.join(running_offsets(counts, "bucket", "n"), "bucket")
              .groupBy("bucket", "offset").agg(F.collect_list("r").alias("rs"))
              .sortWithinPartitions("bucket")
              .select("offset", F.shuffle(F.array_sort("rs", order), F.lit(seed)).alias("rs"))
              .select("offset", F.posexplode("rs").alias("pos", "r"))
              .select(shard.cast("int").alias("shard"), position.alias("at"), F.col("r.record").alias("record"))
              .select("shard", (F.col("at") - F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")).alias("slot"), "record"))
    placed.write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark, path: str, like: DataFrame) -> DataFrame:
    """``shard, slot, record`` of written shards; ``like`` gives the columns of the records (none need exist)."""
    schema = "slot long, record struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in like.schema) + ">, shard int"
    return spark.read.schema(schema).parquet(path)


def placement(docs: DataFrame, shards: int = 16, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards and report from their files where each document lies: law ``rows``."""
    path = write_shards(docs, shards, seed, bucket_bytes)
    text = words_of(F.col("record.text").cast("string"))
    return read_shards(docs.sparkSession, path, docs).select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))

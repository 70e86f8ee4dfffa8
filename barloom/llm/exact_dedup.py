"""Exact copies: groups by a 128-bit content hash whose members are compared byte by byte, in Spark SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fresh, stored, words_of


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def classes(docs: DataFrame, keep: str = "max", text: str = "text", doc_id: str = "doc_id",
            digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (clashing input columns are replaced).

    Texts are equal when all bytes are; null counts as empty.  Of equal texts
    the row with the largest (``keep="min"``: smallest) id stays; null ids stay
    only in groups without any other id.  Rows that repeat both id and text get
    equal marks; ``deduplicate`` leaves one of them.  An empty table gives none.

    Each task first reduces its rows to one per hash with count, id and the
    least and greatest text, so a group of any size reaches the shuffle as one
    row per task.  Least = greatest proves that all bytes of a group agree; a
    hash shared by different texts (never seen with the default) is regrouped
    by hash and text.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    h, body, sha = fresh(docs, "content_hash", "content", "content_sha")
    rows = docs.withColumn(body, words_of(F.col(text).cast("string"))).withColumn(h, digest(F.col(body)))
    rows = rows.withColumn(sha, F.sha2(F.col(body), 256))          # before the join: marks alone then move no text
    stays = F.max(doc_id) if keep == "max" else F.min(doc_id)
    groups = stored(rows.groupBy(h).agg(F.count(F.lit(1)).alias("group_size"), stays.alias("keep_id"),
                                        F.min(body).alias("lo"), F.max(body).alias("hi"))
                    .select(h, "group_size", "keep_id", (F.col("lo") != F.col("hi")).alias("clash")), "text-groups")
    sound = groups.filter(~F.col("clash")).drop("clash")
    out = rows.join(sound, h)
    if not groups.filter("clash").isEmpty():
        mixed = rows.join(groups.filter("clash").select(h), h, "left_semi")
        exact = mixed.groupBy(h, body).agg(F.count(F.lit(1)).alias("group_size"), stays.alias("keep_id"))
        out = out.unionByName(mixed.join(exact, [h, body]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "keep_id", "group_size",
                      F.col(doc_id).eqNullSafe(F.col("keep_id")).alias("kept"), F.col(sha).alias("text_sha256"))


def deduplicate(docs: DataFrame, keep: str = "max", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of equal texts, with the columns of ``docs``; an input column of a mark's name comes back."""
    marks = ("keep_id", "group_size", "kept", "text_sha256")
    own = {c: fresh(docs, "own_" + c)[0] for c in docs.columns if c.lower() in marks}
    marked = classes(docs.withColumnsRenamed(own), keep, text, doc_id).filter("kept")
    lone, rest = marked.filter("group_size = 1"), marked.filter("group_size > 1").dropDuplicates([doc_id, "text_sha256"])
    back = {v: k for k, v in own.items()}
    return lone.unionByName(rest).drop(*marks).withColumnsRenamed(back)

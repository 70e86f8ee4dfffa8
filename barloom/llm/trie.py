"""Prefix trie of conversations: multi-turn block digests first, single turns only where siblings part.

Every turn has a 128-bit digest of its place, role and text; a stretch of turns
has the exclusive or of its turns' digests, so prefixes, blocks and parts of
blocks compose, and a conversation of any length is worked on in pieces.
Conversations are grouped by (digest before the block, digest of the block) for
each block of ``BLOCK`` turns.  A block that all conversations with the same
beginning share is taken apart once, without any grouping by turn; where
siblings part, one representative per block class is taken apart and its turns
are grouped with the class's counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import stored, words_of

BLOCK = 4                        # turns of a block
SPAN = 4_096                     # blocks, or nodes of one conversation, in one window
PIECE = 8_192                    # ids joined to one piece of text before the pieces of a node meet
KEY = ("depth", "d1", "d2")
_POSITIONS = 1 << 33             # rows of a partition in monotonically_increasing_id


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, idx, t1, t2, bytes`` of every turn: place in its conversation (from 0), digests, UTF-8 bytes of its text.

    Turns are ordered by turn (null first), then role, then text; null role or
    text is empty; rows without conv_id belong to no conversation.  Rows are
    range-partitioned by that order, so a conversation of any length spreads
    over tasks; places come from row numbers of the sorted partitions.
    """
    src = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        words_of(F.col("role").cast("string")).alias("role"), words_of(F.col("text").cast("string")).alias("text"))
    src = src.withColumn("row", F.monotonically_increasing_id())      # equal turns spread as well
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = src.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid = stored(laid.select(
        "conv_id", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % _POSITIONS).alias("at"),
        F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second"), "text", "role").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes")), "turns")
    parts_of = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (laid.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(parts_of), F.lit(0))))
    return laid.join(starts.drop("n"), ["conv_id", "part"]).select(
        "conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "t1", "t2", "bytes")


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, for ``prefix_trie``."""
    turns = stored(numbered(conversations), "turns")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), turns.withColumnRenamed("idx", "pos")


def rebuilt(conversations: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations and turns, each conversation c led by the first h turns of c - c % group, h = crc32 of c in decimal, modulo 9.

    Its own turns follow after the first h of them; where the other one is
    shorter or absent it lends what it has.  Returns ``conv_id, n`` (0 is
    possible) and ``conv_id, pos, t1, t2, bytes``.
    """
    turns = stored(numbered(conversations), "turns")
    size = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("head")
    convs = size.select("conv_id", "own", head, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lent = size.select(F.col("conv_id").alias("base"), F.col("own").alias("lender"))
    convs = stored(convs.join(lent, "base", "left").select(
        "conv_id", "base", "head", "own", F.least("head", F.coalesce("lender", F.lit(0))).alias("led")), "convs")
    own = (turns.filter(F.col("idx") >= F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)
           .join(convs.select("conv_id", "head", "led"), "conv_id")
           .select("conv_id", (F.col("led") + F.col("idx") - F.col("head")).alias("pos"), "t1", "t2", "bytes"))
    first = turns.filter("idx < 8").withColumnRenamed("conv_id", "base")
    led = first.join(convs.select("conv_id", "base", "led"), "base").filter("idx < led")\
        .select("conv_id", F.col("idx").alias("pos"), "t1", "t2", "bytes")
    return (convs.select("conv_id", (F.col("led") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("n")),
            own.unionByName(led))


def _xor(a: str, b: str | Column) -> Column:
    return F.col(a).bitwiseXOR(F.col(b) if isinstance(b, str) else b)


def _before(name: str, window) -> Column:
    return F.coalesce(F.bit_xor(name).over(window), F.lit(0))


def block_rows(turns: DataFrame) -> DataFrame:
    """``conv_id, block, b1, b2, len, p1, p2`` per conversation and block: digest of the block and of all turns before it.

    Prefixes run over ``SPAN`` blocks and over the totals of such spans, so a
    conversation of any length needs no long window.
    """
    blocks = (turns.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block"))
              .agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.count(F.lit(1)).alias("len"))
              .withColumn("span", F.floor(F.col("block") / SPAN)))
    blocks = stored(blocks, "blocks")
    of = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = (blocks.groupBy("conv_id", "span").agg(F.bit_xor("b1").alias("s1"), F.bit_xor("b2").alias("s2"))
             .select("conv_id", "span", _before("s1", of).alias("q1"), _before("s2", of).alias("q2")))
    within = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.join(spans, ["conv_id", "span"]).select(
        "conv_id", "block", "b1", "b2", "len", _xor("q1", _before("b1", within)).alias("p1"), _xor("q2", _before("b2", within)).alias("p2"))


def ends(whole: DataFrame) -> DataFrame:
    """Per distinct whole conversation (``depth, d1, d2``): least id, number of ids, SHA-256 of all ids in order, comma-joined.

    Ids are range-partitioned and joined to pieces; the pieces of a node are
    streamed through one hash, so a node holds no list.
    """
    parts = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "depth long, d1 long, d2 long, first long, n long, ids string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def close():
            out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))

        for batch in batches:
            for *now, c in zip(*[x.to_pylist() for x in batch.columns]):
                if key != now or len(ids) >= PIECE:
                    if ids:
                        close()
                    key, ids = now, []
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
                out = []
        if ids:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, state, least, total = None, [], None, 0, 0
        for batch in batches:
            for *now, first, n, ids in zip(*[x.to_pylist() for x in batch.columns]):
                if key != now:
                    if key is not None:
                        out.append((*key, least, total, state.hexdigest()))
                    key, state, least, total = now, hashlib.sha256(), first, 0
                else:
                    state.update(b",")
                state.update(ids.encode())
                total += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "d1", "d2", "conv_id", "n_ends", "sha"])
                out = []
        if key is not None:
            out.append((*key, least, total, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "d1", "d2", "conv_id", "n_ends", "sha"])

    names = ["depth", "d1", "d2", "first", "n", "ids"]
    order = [*KEY, "conv_id"]
    some = whole.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pieces, schema)
    some = some.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first")
    return some.mapInArrow(hashes, "depth long, d1 long, d2 long, conv_id long, n_ends long, sha string")


def running_cost(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``above``: cost of the nodes with the same ``conv_id`` and less depth."""
    rows = nodes.withColumn("span", F.floor(F.col("depth") / (SPAN * BLOCK)))
    of = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = (rows.groupBy("conv_id", "span").agg(F.sum("cost").alias("s"))
             .select("conv_id", "span", F.coalesce(F.sum("s").over(of), F.lit(0)).alias("q")))
    within = Window.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(spans, ["conv_id", "span"]).withColumn(
        "above", F.col("q") + F.coalesce(F.sum("cost").over(within), F.lit(0))).drop("q", "span")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations ``conv_id, n`` with turns ``conv_id, pos, t1, t2, bytes``.

    A node is a distinct sequence of first turns; its ``conv_id`` is the least
    member's.  Returns ``conv_id, depth, parent_conv_id`` (root: null),
    ``n_convs, n_children, n_leaves, saved_tokens`` (over the subtree, members
    but one times bytes of the node's last text) and ``ends_sha256`` of the
    ids that end there.  Equal conversations count as members each but are
    taken apart once.  Without conversations there is no node, not even a root.

    A subtree's sums come without walking it: each node's cost is booked on its
    least member, whose nodes are the lower end of its path.  The members'
    totals, less what a node's own least member booked above it, are the
    subtree's sum, and members are summed per block class.
    """
    turns = stored(turns.select("conv_id", "pos", F.xxhash64("pos", "t1").alias("x1"),
                                F.xxhash64("t2", F.lit("second"), "pos").alias("x2"), "bytes"), "turns")
    blocks = stored(block_rows(turns), "prefixes")
    total = blocks.groupBy("conv_id").agg(F.bit_xor("b1").alias("d1"), F.bit_xor("b2").alias("d2"))
    whole = convs.join(total, "conv_id", "left").select(
        "conv_id", F.col("n").alias("depth"), F.coalesce("d1", F.lit(0)).alias("d1"), F.coalesce("d2", F.lit(0)).alias("d2"))
    last = stored(ends(whole), "ends")

    # Block classes of the distinct conversations, one representative each.
    members = stored(blocks.join(last.select("conv_id", "n_ends"), "conv_id"), "members")
    start = ["block", "p1", "p2"]
    kind = [*start, "b1", "b2", "len"]
    classes = stored(members.groupBy(*kind).agg(F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n")), "classes")
    alone = (classes.groupBy(*start).agg(F.count(F.lit(1)).alias("siblings"), *[F.min(c).alias(c) for c in kind[3:]])
             .filter("siblings = 1").select(*kind, F.lit(True).alias("alone")))
    classes = classes.join(alone, kind, "left").select("conv_id", "block", "p1", "p2", "n", F.coalesce("alone", F.lit(False)).alias("alone"))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos")
    parted = turns.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(classes, ["conv_id", "block"])
    for k in "12":
        own = F.bit_xor(f"x{k}").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        parted = parted.withColumn(f"d{k}", _xor(f"p{k}", own)).withColumn(f"e{k}", _xor(f"d{k}", f"x{k}"))
    parted = stored(parted.select("conv_id", "block", (F.col("pos") + 1).alias("depth"), "d1", "d2", "e1", "e2", "bytes", "n", "alone"), "parted")

    # Nodes below the root, then the root.
    same = [F.min(c).alias(c) for c in ("conv_id", "e1", "e2", "bytes")]
    nodes = parted.filter("alone").select(*KEY, "conv_id", "e1", "e2", "bytes", "n").unionByName(
        parted.filter("not alone").groupBy(*KEY).agg(*same, F.sum("n").alias("n")))
    zero = F.lit(0).cast("long")
    root = last.agg(F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n")).filter("n > 0").select(
        *[zero.alias(c) for c in KEY], "conv_id", *[F.lit(None).cast("long").alias(c) for c in ("e1", "e2")], zero.alias("bytes"), "n")
    nodes = stored(nodes.unionByName(root), "nodes")

    # Children and ends of every node, added up under its key.
    none = F.lit(None).cast("long")
    facts = nodes.withColumns({"children": zero, "n_ends": zero, "sha": F.lit(None).cast("string")})
    facts = facts.unionByName(
        nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("e1").alias("d1"), F.col("e2").alias("d2"),
                                         F.lit(1).cast("long").alias("children")), allowMissingColumns=True)
    facts = facts.unionByName(last.select(*KEY, "n_ends", "sha"), allowMissingColumns=True)
    facts = facts.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("conv_id", "e1", "e2", "bytes", "n", "n_ends", "sha")],
                                    F.sum("children").alias("children"))
    facts = stored(running_cost(facts.withColumn("cost", (F.col("n") - 1) * F.col("bytes"))), "facts")

    # What the least members booked, per block class and back to the nodes.
    booked = stored(facts.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum((F.col("children") == 0).cast("long")).alias("leaves")), "booked")
    sums = [F.sum(c).alias(c) for c in ("cost", "leaves")]
    per_class = members.join(booked, "conv_id").groupBy(*kind).agg(F.min("conv_id").alias("conv_id"), *sums)
    shares = parted.select("conv_id", "block", *KEY, "alone").join(per_class.select("conv_id", "block", "cost", "leaves"), ["conv_id", "block"])
    below = shares.filter("alone").select(*KEY, "cost", "leaves").unionByName(
        shares.filter("not alone").groupBy(*KEY).agg(*sums)).unionByName(
        booked.agg(*sums).filter("leaves is not null").select(*[zero.alias(c) for c in KEY], "cost", "leaves"))

    upper = facts.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("conv_id").alias("parent_conv_id"))
    out = facts.join(below.withColumnsRenamed({"cost": "whole"}), list(KEY)).join(upper, ["depth", "e1", "e2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("whole") - F.col("above")).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))

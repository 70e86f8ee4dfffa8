"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the node's least neighbour (itself included)."""
    sides = _both(edges)
    least = sides.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return sides.filter("b > a").join(least, "a").filter("b > m").select(F.col("m").alias("a"), "b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """``a < b`` per edge: link a node's smaller neighbours and the node itself to the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b")
    return (moved.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
            .union(least.select(F.col("m").alias("a"), "b")).distinct())


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` (least node reachable) for every node of ``edges`` (columns ``a``, ``b``; loops and repeats allowed).

    Each round is a few aggregates and joins whose hot keys are reduced per
    task or split as skewed joins; rounds grow with the logarithm of the
    longest path.  Null ends are ignored; an empty table gives none.  Each
    round's edges are written to the shared folder.
    """
    cur = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cur = stored(cur, "edges")
    seen = None
    for _ in range(rounds):
        cur = stored(_small(_large(cur)), "edges")
        now = tuple(cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return cur.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

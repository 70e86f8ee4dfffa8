"""Shared helpers: work tables in the cluster's folder, key columns, running totals of bounded tables, batches by size."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they start: once per context, as a zip of its sources."""
    sc = spark.sparkContext
    if getattr(sc, "_barloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="barloom-src-"), "barloom_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._barloom_shipped = True


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only a local session without that setting gets its own folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set on this cluster")
        base = tempfile.mkdtemp(prefix="barloom-work-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def words_of(text: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(text, F.lit(""))


def by_size(texts: list[str], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Slices of a batch with about ``limit`` characters each (a longer text is a slice of its own)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Return memory that this worker has freed to the system, so that a later stage in the same executor finds it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(texts: pa.Array, rows: int = 1000, limit: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """First position and texts (null: empty) of slices of a column, each of about ``limit`` characters and at most ``rows`` texts."""
    for at in range(0, len(texts), rows):
        part = [t or "" for t in texts.slice(at, rows).to_pylist()]
        for a, b in by_size(part, limit):
            yield at + a, part[a:b]

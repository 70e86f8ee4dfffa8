"""Tables in the shared checkpoint folder that end a lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session without one gets its own, once."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set on this cluster")
        if sc.applicationId not in _LOCAL:
            _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="barloom-ckpt-")
        folder = _LOCAL[sc.applicationId]
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the checkpoint folder and go on from there.

    The rows are computed one time (a checkpoint computes them twice), and what
    follows reads only the columns it needs.
    """
    path = os.path.join(checkpoint_folder(df.sparkSession), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

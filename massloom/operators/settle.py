"""Cutting long lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's checkpoint folder; what is built on it several times doesn't run
    it again, and lost executors don't lose it. A temporary folder serves where none is set in local mode; a cluster must
    name one, as its machines share no such folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="massloom-"))
    return df.checkpoint()

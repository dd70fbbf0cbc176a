"""Cutting lineage in the folder that executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder: later steps neither recompute nor re-plan what led here.

    The folder is the session's own (spark.checkpoint.dir). In local mode, as in tests, one is set where none is; a cluster
    without one is an error, since a folder of one machine is no use there."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints/lodegraph")
    return df.checkpoint()

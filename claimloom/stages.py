"""Cutting a plan where its result is used more than once or must not change between uses."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the reliable checkpoint folder, the session's spark.checkpoint.dir, and read from
    there. Where that is unset a local session (tests, one machine) gets a temporary folder; a cluster
    must name one that all its machines share."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="claimloom-"))
    return df.checkpoint()

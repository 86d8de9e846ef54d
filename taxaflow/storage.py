"""Where intermediate tables go."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() uses the folder the cluster names. Without one, a local session (tests) makes its own; a cluster's executors don't share local folders, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "taxaflow-checkpoints"))


def stored(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()

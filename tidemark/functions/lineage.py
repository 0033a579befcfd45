"""Cut the lineage of a frame that a loop goes on with."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the folder named by spark.checkpoint.dir and read it from there: lost executors lose nothing.

    Without that setting a local run makes a folder of its own; on a cluster, whose machines share no such
    folder, it is an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()

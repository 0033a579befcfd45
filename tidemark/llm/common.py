"""Helpers shared by the operators: checkpoints, worker caches, Arrow batch size."""

from __future__ import annotations

import sys
import tempfile
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch; texts may be long, so a batch stays at some MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to `BATCH_ROWS` rows, so that long texts don't fill a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the cluster's checkpoint folder and read it back: lost executors lose nothing.

    The folder is the session's spark.checkpoint.dir; only where none is set (tests, local runs) a
    temporary one is made.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over tasks of one or several jobs."""
    module = sys.modules.setdefault("_tidemark_worker_cache", types.ModuleType("_tidemark_worker_cache"))
    return module.__dict__.setdefault("entries", {})


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


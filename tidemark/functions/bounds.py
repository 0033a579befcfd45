"""Broadcast only what has a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest row bound that is still broadcast (the cluster-map reader stops at this many entries).
MAX_BROADCAST_ROWS = 200_000
#: Largest byte bound that is still shipped to every executor (word-vector matrices).
MAX_BROADCAST_BYTES = 512 * 1024 * 1024


def broadcast_if_bounded(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Hint a broadcast when `max_rows` proves the table small.

    Without a bound (or beyond it) the frame is returned untouched: the planner then decides from
    the sizes it sees at run time, and AQE splits skewed partitions of the shuffle join.
    """
    if max_rows is not None and max_rows <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def checked_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Run `df` once and return its rows as a broadcast table; a larger result is kept by its partitions.

    For results that are small by nature (a few rows per fold or column) and must be read
    identically by several branches of a plan.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        # Too large to ship: written once if the cluster has a checkpoint folder, else cached, and joined as it is.
        return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))

"""Array expansion that leaves the array expression evaluated once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of one slice of an Arrow batch; bounds a worker's memory whatever the batch holds.
SLICE_TOKENS = 200_000


def explode_rows(df: DataFrame, keep: list, array, name: str) -> DataFrame:
    """One row per non-null element.

    A plain explode makes the optimizer infer a `size(array) > 0` filter and push a second copy of
    the whole array expression (tokenizer included) below it. The outer form carries no such
    filter; the null row of an empty array is dropped afterwards.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def token_slices(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    """A list column as slices of whole rows with at most `SLICE_TOKENS` elements, or one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(lists) or not len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE_TOKENS, side="right")))
        yield lists.slice(lo, hi - lo)
        if not len(ends):
            return
        lo = hi

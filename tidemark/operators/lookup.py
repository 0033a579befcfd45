"""Row-local dictionary lookups on token arrays, vectorised in Arrow.

A token array keeps its row: no explode, no shuffle, no regrouping. The dictionary is shipped to
the executors once, which is only done while its row bound is proven.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.arrays import token_slices


def token_positions(tokens: Column, words: list[str], missing: int | None = None, ids: list[int] | None = None) -> Column:
    """array<string> to array<int>: position of each token in `words`, or its place in `ids`; `missing` for the others."""

    @F.arrow_udf("array<int>")
    def positions(col: pa.Array) -> pa.Array:
        return pa.concat_arrays([_looked_up(s) for s in token_slices(col.cast(pa.list_(pa.string())))])

    def _looked_up(lists: pa.ListArray) -> pa.Array:
        flat = pc.index_in(lists.flatten(), value_set=_values()).cast(pa.int32())
        if ids is not None:
            flat = pa.array(ids, pa.int32()).take(flat)
        if missing is not None:
            flat = pc.fill_null(flat, pa.scalar(missing, pa.int32()))
        counts = pc.fill_null(pc.list_value_length(lists), 0)
        return pa.ListArray.from_arrays(_offsets(counts), flat)

    cache: list[pa.Array] = []

    def _values() -> pa.Array:
        if not cache:
            cache.append(pa.array(words, pa.string()))
        return cache[0]

    return positions(tokens)


def _offsets(counts: pa.Array) -> pa.Array:
    zero = pa.array([0], pa.int32())
    return pa.concat_arrays([zero, pc.cumulative_sum(counts.cast(pa.int32()))])


def placed(ids: Column, at: Column, values: Column, gap: int, missing: int) -> Column:
    """`ids` with `values` written at the positions `at` (both may be null), and `missing` for every `gap` left."""

    @F.arrow_udf("array<int>")
    def filled(col: pa.Array, at: pa.Array, values: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(col), 0)
        offsets = _offsets(counts)
        flat = col.flatten().to_numpy(zero_copy_only=False).copy()
        starts = np.repeat(offsets.to_numpy(zero_copy_only=False)[:-1], pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
        flat[starts + at.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
        flat[flat == gap] = missing
        return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))

    return filled(ids, at, values)

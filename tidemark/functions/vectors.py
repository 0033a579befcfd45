"""Products of ML vector columns with a driver-held matrix, vectorised in Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.bounds import MAX_BROADCAST_BYTES

#: Cells of one gathered block; bounds the memory of a batch.
BLOCK_CELLS = 1_000_000


def check_matrix(matrix: np.ndarray) -> np.ndarray:
    if matrix.nbytes > MAX_BROADCAST_BYTES:
        raise ValueError(f"matrix of {matrix.nbytes} bytes is too large to ship to every executor")
    return matrix


def row_sums(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray | None, matrix: np.ndarray, n: int) -> np.ndarray:
    """Sum of matrix rows `cols` (times `weights`) per `rows`, which must be sorted."""
    out = np.zeros((n, matrix.shape[1]))
    block = max(1, BLOCK_CELLS // matrix.shape[1])
    for lo in range(0, len(rows), block):
        r = rows[lo : lo + block]
        cells = matrix[cols[lo : lo + block]]
        if weights is not None:
            cells = cells * weights[lo : lo + block, None]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[first]] += np.add.reduceat(cells, first, axis=0)
    return out


def vector_cells(vec: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, values) of the stored cells of vectors, sparse and dense mixed, in row order."""
    kinds = vec.field("type").to_numpy(zero_copy_only=False)
    values, indices = vec.field("values"), vec.field("indices")
    lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(vec)), lengths)
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, dtype=int)
    cols = np.arange(len(rows)) - np.repeat(starts, lengths)
    sparse = np.repeat(kinds == 0, lengths)
    cols[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return rows, cols, values.flatten().to_numpy(zero_copy_only=False)


def stored_cells(first: str, second: str) -> Column:
    """array<struct<i, x, y>>: the stored cells of two sparse vector columns with the same indices."""
    x, y = (F.unwrap_udt(F.col(c)) for c in (first, second))
    return F.arrays_zip(x["indices"].alias("i"), x["values"].alias("x"), y["values"].alias("y"))


def vector_times(vec: pa.Array, matrix: np.ndarray) -> np.ndarray:
    """(rows x dims) vectors, sparse and dense mixed, times (dims x k)."""
    rows, cols, values = vector_cells(vec)
    return row_sums(rows, cols, values, matrix, len(vec))


def as_lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.shape[0] * x.shape[1] + 1, x.shape[1], dtype=np.int32) if x.shape[0] else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def project(vec: Column, matrix: np.ndarray) -> Column:
    """vector to vector: v times matrix, row-local."""
    m = check_matrix(np.ascontiguousarray(matrix, dtype=np.float64))

    @F.arrow_udf("array<double>")
    def times(v: pa.Array) -> pa.Array:
        return as_lists(vector_times(v, m))

    return array_to_vector(times(vec))


def fourier_features(vec: Column, weights: np.ndarray, shift: np.ndarray) -> Column:
    """vector to sqrt(2/D) cos(v W + b)."""
    w = check_matrix(np.ascontiguousarray(weights, dtype=np.float64))
    scale = float(np.sqrt(2.0 / w.shape[1]))

    @F.arrow_udf("array<double>")
    def features(v: pa.Array) -> pa.Array:
        return as_lists(scale * np.cos(vector_times(v, w) + shift))

    return array_to_vector(features(vec))

"""Word-vector coverage, document means and chunk pooling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import explode_rows, token_slices
from tidemark.functions.bounds import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS
from tidemark.functions.vectors import row_sums
from tidemark.operators.lookup import token_positions


def embedding_coverage(vocab: DataFrame, wv: DataFrame) -> DataFrame:
    """(found, total, coverage): how much of the vocabulary has a vector."""
    known = wv.select(F.col("token").alias("_w")).distinct()
    joined = vocab.join(known, F.col("token") == F.col("_w"), "left")
    return joined.agg(F.count("_w").alias("found"), F.count(F.lit(1)).alias("total")).withColumn(
        "coverage", F.col("found") / F.greatest("total", F.lit(1))
    )


def vector_matrix(wv: DataFrame, dim: int, max_rows: int) -> tuple[list[str], np.ndarray]:
    """Words and their float matrix for shipping; refuses a table beyond the broadcast bounds."""
    if max_rows > MAX_BROADCAST_ROWS or max_rows * dim * 4 > MAX_BROADCAST_BYTES:
        raise ValueError("word vectors are too many to ship; restrict them to the vocabulary first")
    rows = wv.select("token", "vector").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} word vectors")
    words = [r["token"] for r in rows]
    return words, np.asarray([r["vector"] for r in rows], dtype=np.float64).reshape(len(words), dim)


def mean_vector(tokens: Column, words: list[str], matrix: np.ndarray) -> Column:
    """Row-local mean vector of the known tokens of an array; null when none is known."""
    dim = matrix.shape[1]

    @F.arrow_udf("array<double>")
    def mean(pos: pa.Array) -> pa.Array:
        return pa.concat_arrays([of_slice(s) for s in token_slices(pos)])

    def of_slice(pos: pa.ListArray) -> pa.Array:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(pos), 0))
        rows = np.repeat(np.arange(len(lengths)), lengths)
        flat = pos.flatten().to_numpy(zero_copy_only=False)
        known = flat >= 0
        rows, flat = rows[known], flat[known]
        n = np.bincount(rows, minlength=len(lengths))
        sums = row_sums(rows, flat, None, matrix, len(lengths))
        means = sums / np.maximum(n, 1)[:, None]
        offsets = pa.array(np.r_[0, np.cumsum(np.where(n > 0, dim, 0))].astype(np.int32))
        values = pa.array(means[n > 0].ravel())
        return pa.ListArray.from_arrays(offsets, values, mask=pa.array(n == 0))

    return mean(token_positions(tokens, words, missing=-1))


def doc_embeddings(docs: DataFrame, wv: DataFrame, doc: str, dim: int, tokens: str = "tokens", wv_max_rows: int | None = 50_000, out: str = "embedding") -> DataFrame:
    """Mean word vector of each document's known tokens.

    Bounded vectors are shipped and averaged row-locally. Otherwise token counts are joined with the
    vectors and averaged per (doc, dimension), which never puts a vector into a sort buffer.
    """
    if wv_max_rows is not None and wv_max_rows <= MAX_BROADCAST_ROWS and wv_max_rows * dim * 4 <= MAX_BROADCAST_BYTES:
        words, matrix = vector_matrix(wv, dim, wv_max_rows)
        return docs.withColumn(out, mean_vector(F.col(tokens), words, matrix))
    counts = explode_rows(docs, [doc], tokens, "token").groupBy(doc, "token").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.join(wv, "token", "inner").select(doc, "n", F.posexplode("vector").alias("d", "x"))
    dims = cells.groupBy(doc, "d").agg((F.sum(F.col("x").cast("double") * F.col("n")) / F.sum("n")).alias("m"))
    per_doc = dims.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("_s"))
    vecs = per_doc.select(doc, F.transform("_s", lambda e: e["m"]).alias(out))
    return docs.join(vecs, doc, "left")


def pool_chunks(chunks: DataFrame, key: Sequence[str], vector: str = "vector", out: str = "pooled") -> DataFrame:
    """Masked mean over a document's chunk vectors; chunks without a vector do not count."""
    known = chunks.filter(F.col(vector).isNotNull())
    pooled = known.groupBy(*key).agg(Summarizer.mean(array_to_vector(vector)).alias(out))
    return pooled.withColumn(out, vector_to_array(out))

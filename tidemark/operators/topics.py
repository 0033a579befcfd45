"""Topic shares per document from a token to cluster map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.arrays import explode_rows, token_slices
from tidemark.functions.bounds import broadcast_if_bounded
from tidemark.operators.lookup import token_positions


def topic_features(docs: DataFrame, cmap: DataFrame, doc: str, tokens: str = "tokens", cmap_max_rows: int | None = None) -> DataFrame:
    """(doc, cluster, n, share): tokens per cluster over all tokens of the document.

    Tokens are counted per (doc, cluster) with map-side combine; unmapped tokens form one null
    cluster that only feeds the denominator. `cmap_max_rows` is the map reader's cap; pass None for
    a map of unknown size.
    """
    side = broadcast_if_bounded(cmap.select(F.col("token").alias("_t"), "cluster"), cmap_max_rows)
    words = explode_rows(docs, [doc], tokens, "_w")
    counts = words.join(side, F.col("_w") == F.col("_t"), "left").groupBy(doc, "cluster").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(doc))
    shares = counts.withColumn("share", F.col("n") / total)
    return shares.filter(F.col("cluster").isNotNull())


def topic_vector(tokens: Column, words: list[str], clusters: list[int], n_clusters: int) -> Column:
    """Row-local dense share vector of length n_clusters; zero for an empty document."""
    lookup = np.asarray(clusters, dtype=np.int64)

    @F.arrow_udf("array<double>")
    def shares(pos: pa.Array) -> pa.Array:
        return pa.concat_arrays([of_slice(s) for s in token_slices(pos)])

    def of_slice(pos: pa.ListArray) -> pa.Array:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(pos), 0))
        rows = np.repeat(np.arange(len(lengths)), lengths)
        flat = pos.flatten().to_numpy(zero_copy_only=False)
        hit = flat >= 0
        out = np.zeros((len(lengths), n_clusters))
        np.add.at(out, (rows[hit], lookup[flat[hit]]), 1.0)
        out /= np.maximum(lengths, 1)[:, None]
        offsets = pa.array(np.arange(0, (len(lengths) + 1) * n_clusters, n_clusters, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return array_to_vector(shares(token_positions(tokens, words, missing=-1)))

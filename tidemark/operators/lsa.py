"""Latent semantic components: uncentred truncated SVD of TF-IDF vectors."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import project

log = logging.getLogger(__name__)

# Component counts of the sweep, 0 = off.
SVD_GRID = (0, 300, 500, 800)
#: Features up to which their products are summed in one pass: 16 MB a task.
GRAM_FEATURES = 2_000
#: Rows up to which the vectors are decomposed on the driver: 160 MB at 20,000 features.
DRIVER_ROWS = 1_000
#: Components below this share of the largest singular value are left out, as Spark's own solver does.
RANK_TOL = 1e-9


def vector_deviation(df: DataFrame, col: str) -> np.ndarray:
    """Population deviation per dimension; zero deviation counts as one."""
    row = df.select(Summarizer.metrics("std", "count").summary(F.col(col)).alias("s")).select("s.std", "s.count").first()
    n = row["count"]
    std = row["std"].toArray() * np.sqrt((n - 1) / n if n > 1 else 1.0)
    return np.where(std > 0, std, 1.0)


@dataclass(frozen=True)
class LsaModel:
    components: np.ndarray
    singular_values: np.ndarray

    @property
    def k(self) -> int:
        return self.components.shape[1]

    def transform(self, df: DataFrame, col: str, out: str = "lsa") -> DataFrame:
        return df.withColumn(out, project(F.col(col), self.components))


def fit_lsa(df: DataFrame, col: str, k: int, n_features: int, scale: bool = False, clamp: bool = True) -> LsaModel | None:
    """Distributed SVD, or None for k = 0 and (unless `clamp`) for k beyond the features.

    `scale` divides each component by its deviation. No centring: it moves all rows alike, which
    neither kernel distances nor a model with a free intercept can see.
    """
    if k <= 0:
        return None
    if k >= n_features:
        if not clamp:
            log.warning("skip k=%d: only %d features", k, n_features)
            return None
        log.warning("k=%d lowered to %d", k, n_features - 1)
        k = max(1, n_features - 1)
    rows = MLUtils.convertVectorColumnsFromML(df.select(col), col)
    if n_features <= GRAM_FEATURES:
        # One pass: the features' products are few, their eigenvectors are the components.
        values, vectors = np.linalg.eigh(RowMatrix(rows).computeGramianMatrix().toArray())
        values = np.sqrt(np.maximum(values[::-1], 0.0))
        k = min(k, int(np.count_nonzero(values > RANK_TOL * values[0])))
        v, values = vectors[:, ::-1][:, :k], values[:k]
    else:
        # One pass for each step of the solver, so the vectors are kept.
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        if 0 < rows.count() <= min(2 * k, DRIVER_ROWS):
            # Hardly more rows than components, or fewer: the solver would look for components that aren't there.
            _, values, v = np.linalg.svd(np.stack([r[0].toArray() for r in rows.collect()]), full_matrices=False)
            k = min(k, int(np.count_nonzero(values > RANK_TOL * values[0])))
            v, values = v[:k].T, values[:k]
        else:
            svd = RowMatrix(rows).computeSVD(k, computeU=False)
            v, values = svd.V.toArray(), svd.s.toArray()
        rows.unpersist()
    # Fix the sign: the largest loading of every component is positive.
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    model = LsaModel(v, values)
    if scale:
        std = vector_deviation(model.transform(df, col, "_z"), "_z")
        model = LsaModel(v / std, model.singular_values)
    return model


def components_table(model: LsaModel, spark) -> DataFrame:
    return spark.createDataFrame(
        [(i, float(s)) for i, s in enumerate(model.singular_values)], "component int, singular_value double"
    )

"""Classifiers on Spark ML behind one call: fit(spec, train) then predict."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import fourier_features
from tidemark.operators.numeric import class_weights
from tidemark.operators.splits import DEFAULT_SEED
from tidemark.plans.boosting import BOOST_GRID, BoostedTrees, fit_boosted

# The grids of the classical models and the layers of the user network.
LR_C = (10.0, 100.0, 1e3, 1e4, 1e5)
LR_L1_RATIOS = (0.1, 0.5, 0.9)
SVM_C = (10.0, 100.0, 1000.0, 10000.0, 100000.0)
LR_TEXT_NGRAMS = (1, 2, 3, 4)
TREE_TEXT_NGRAMS = (1, 2)
TEXT_MIN_DFS = (2, 3, 5)
#: Rows of a task of a fit.
TASK_ROWS = 10_000
MLP_HIDDEN = (128, 64, 32)
GBT_GRID = (
    {"max_depth": 3, "min_child": 1, "rate": 0.10, "trees": 300},
    {"max_depth": 3, "min_child": 2, "rate": 0.05, "trees": 600},
    {"max_depth": 5, "min_child": 1, "rate": 0.10, "trees": 300},
    {"max_depth": 5, "min_child": 2, "rate": 0.05, "trees": 600},
)


@dataclass(frozen=True)
class ModelSpec:
    """kind: lr, rbf_svm, gbt, boost or mlp; params as in the fit functions below."""

    kind: str
    params: dict[str, Any] = field(default_factory=dict)


def lr_grid() -> list[ModelSpec]:
    plain = [ModelSpec("lr", {"penalty": p, "C": c}) for p in ("l1", "l2") for c in LR_C]
    mixed = [ModelSpec("lr", {"penalty": "elasticnet", "C": c, "l1_ratio": r}) for c in LR_C for r in LR_L1_RATIOS]
    return plain + mixed


def svm_grid() -> list[ModelSpec]:
    return [ModelSpec("rbf_svm", {"C": c}) for c in SVM_C]


def gbt_grid() -> list[ModelSpec]:
    return [ModelSpec("gbt", dict(g)) for g in GBT_GRID]


def boost_grid() -> list[ModelSpec]:
    """Boosted trees with leaf penalties."""
    return [ModelSpec("boost", dict(g)) for g in BOOST_GRID]


class Classifier:
    """A fitted model with its input preparation."""

    def __init__(self, model, features: str, prepare=None):
        self.model, self.features, self._prepare = model, features, prepare

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the int column `y_pred`; other model outputs are dropped."""
        ready = self._prepare(df) if self._prepare else df
        out = self.model.transform(ready).withColumn("y_pred", F.col("prediction").cast("int"))
        return out.select(*df.columns, "y_pred")


def fit_lr(df: DataFrame, features: str, label: str, n: int, penalty: str = "l2", C: float = 10.0, l1_ratio: float | None = None, max_iter: int = 100, balanced: bool = True) -> Classifier:
    """Balanced logistic regression; C maps to regParam = 1 / (C n), the intercept is not penalised."""
    mix = {"l1": 1.0, "l2": 0.0}.get(penalty, l1_ratio)
    weighted = class_weights(df, "balanced", label, out="_weight") if balanced else df.withColumn("_weight", F.lit(1.0))
    lr = LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="_weight", regParam=1.0 / (C * n), elasticNetParam=float(mix),
        standardization=False, maxIter=max_iter, tol=1e-4,
    )
    return Classifier(lr.fit(weighted), features)


def scale_gamma(df: DataFrame, features: str) -> tuple[float, int]:
    """(1 / (dims x variance over all cells), dims) in one aggregate."""
    v = F.unwrap_udt(F.col(features))
    values = v["values"]
    zero = F.lit(0.0)
    dims = F.coalesce(v["size"], F.size(values))
    row = df.agg(
        F.sum(F.aggregate(values, zero, lambda a, x: a + x)).alias("s"),
        F.sum(F.aggregate(values, zero, lambda a, x: a + x * x)).alias("q"),
        F.sum(dims.cast("double")).alias("cells"),
        F.max(dims).alias("d"),
    ).first()
    var = row["q"] / row["cells"] - (row["s"] / row["cells"]) ** 2
    return 1.0 / (row["d"] * var) if var > 0 else 1.0, row["d"]


def fit_rbf_svm(df: DataFrame, features: str, label: str, n: int, C: float = 10.0, gamma: float | None = None, n_components: int = 256, max_iter: int = 20, seed: int = DEFAULT_SEED) -> Classifier:
    """RBF kernel machine by random Fourier features and a linear hinge-loss fit."""
    auto, dims = scale_gamma(df, features)
    g = auto if gamma is None else gamma
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * g), (dims, n_components))
    b = rng.uniform(0.0, 2.0 * np.pi, n_components)

    def prepare(d: DataFrame) -> DataFrame:
        return d.withColumn("_rff", fourier_features(F.col(features), w, b))

    svc = LinearSVC(featuresCol="_rff", labelCol=label, regParam=1.0 / (C * n), maxIter=max_iter, standardization=False)
    ready = prepare(df).select(label, "_rff").persist()
    try:
        model = svc.fit(ready)
    finally:
        ready.unpersist()
    return Classifier(model, features, prepare)


def fit_gbt(df: DataFrame, features: str, label: str, n: int, max_depth: int = 3, min_child: int = 1, rate: float = 0.1, trees: int = 300, seed: int = DEFAULT_SEED) -> Classifier:
    """Boosted trees with row and column sampling of 0.8 and a weighted positive class."""
    weighted = class_weights(df, "positive", label, out="_weight")
    gbt = GBTClassifier(
        featuresCol=features, labelCol=label, weightCol="_weight", maxDepth=max_depth, maxIter=trees, stepSize=rate,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=min_child, seed=seed,
    )
    return Classifier(gbt.fit(weighted), features)


def fit_mlp(df: DataFrame, features: str, label: str, n: int, hidden: tuple[int, ...] = MLP_HIDDEN, max_iter: int = 40, seed: int = DEFAULT_SEED) -> Classifier:
    """Feed-forward network over the user features."""
    dims = scale_gamma(df, features)[1]
    mlp = MultilayerPerceptronClassifier(
        featuresCol=features, labelCol=label, layers=[dims, *hidden, 2], maxIter=max_iter, seed=seed
    )
    return Classifier(mlp.fit(df), features)


def fit_boost(df: DataFrame, features: str, label: str, n: int, **params) -> BoostedTrees:
    """Boosted trees with second-order gains and leaf penalties; params as in `fit_boosted`."""
    return fit_boosted(df, features, label, **params)


_FIT = {"lr": fit_lr, "rbf_svm": fit_rbf_svm, "gbt": fit_gbt, "boost": fit_boost, "mlp": fit_mlp}


def packed(df: DataFrame, n: int) -> DataFrame:
    """`df` of n rows in no more partitions than cores or rows ask for: a fit runs them all in every iteration."""
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df


def fit(spec: ModelSpec, df: DataFrame, features: str = "features", label: str = "y_true", n: int | None = None) -> Classifier:
    """Fit on a (cached) feature table.

    The partitions of the input, or one per `TASK_ROWS` rows if there are more, are the tasks of every iteration.
    """
    n = df.count() if n is None else n
    return _FIT[spec.kind](packed(df, n), features, label, n, **spec.params)


def coef_importance(clf: Classifier, names: list[str], spark) -> DataFrame:
    """(feature, importance): absolute coefficients by feature name."""
    coef = np.abs(clf.model.coefficients.toArray())
    return _named(zip(names, coef, strict=True), spark)


def tree_importance(clf: Classifier, names: list[str], spark) -> DataFrame:
    """(feature, importance): normalised gain, or mean gain of penalised trees; features no tree uses are left out."""
    if isinstance(clf, BoostedTrees):
        return clf.gain_importance(names, spark)
    imp = clf.model.featureImportances.toArray()
    if len(imp) != len(names):
        raise ValueError("one name per feature is required")
    return _named([(n, v) for n, v in zip(names, imp) if v > 0], spark)


def _named(rows, spark) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "feature string, importance double")

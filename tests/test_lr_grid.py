import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators.metrics import macro_scores
from tidemark.plans import lr_grid as LG
from tidemark.plans import models as MO


def rows(spark, n=240, seed=3):
    """Three columns of very different size, the last mostly missing; dense and sparse vectors mixed."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 30.0, 0.2] + [0.0, 5.0, 0.0]
    x[rng.random(n) < 0.7, 2] = 0.0
    y = (x @ [1.0, 0.05, 2.0] + rng.normal(size=n) > 0.4).astype(int)
    data = [(int(b), Vectors.dense(a) if i % 2 else Vectors.sparse(3, [j for j in range(3) if a[j]], [v for v in a if v])) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, ["y_true", "features"]).repartition(3).persist()


def test_every_configuration_equals_its_single_fit(spark):
    df = rows(spark)
    specs = MO.lr_grid()
    scorers, jobs = LG.fit_lr_grid(df, specs)
    assert len(scorers) == 25 and jobs < 250
    for i in (0, 4, 5, 9, 10, 14, 24):
        params = {**specs[i].params, "max_iter": 2000}
        weighted = LG.class_weights(df, "balanced", "y_true", out="_weight")
        mix = {"l1": 1.0, "l2": 0.0}.get(params["penalty"], params.get("l1_ratio"))
        single = MO.LogisticRegression(
            featuresCol="features", labelCol="y_true", weightCol="_weight", regParam=1.0 / (params["C"] * df.count()),
            elasticNetParam=float(mix), standardization=False, maxIter=2000, tol=1e-12,
        ).fit(weighted)
        assert scorers[i].coefficients.toArray() == pytest.approx(single.coefficients.toArray(), abs=1e-4, rel=1e-4)
        assert scorers[i].intercept == pytest.approx(single.intercept, abs=1e-4, rel=1e-4)


def test_strong_penalty_leaves_columns_out(spark):
    specs = [MO.ModelSpec("lr", {"penalty": "l1", "C": c}) for c in (0.002, 0.02, 10.0)]
    scorers, _ = LG.fit_lr_grid(rows(spark), specs)
    kept = [int((s.coefficients.toArray() != 0).sum()) for s in scorers]
    assert kept == sorted(kept) and kept[0] < 3 and kept[-1] == 3


def test_sweep_equals_scores_of_each(spark):
    df, specs = rows(spark), MO.lr_grid()[:3]
    scorers, _ = LG.fit_lr_grid(df, specs)
    got = {r.config: r.F1 for r in LG.sweep(scorers, specs, df).collect()}
    for i, s in enumerate(scorers):
        assert got[i] == pytest.approx(macro_scores(s.predict(df)).first()["F1"])


def test_tree_of_sums_and_odd_inputs(spark, monkeypatch):
    df, specs = rows(spark), [MO.ModelSpec("lr", {"C": 10.0})]
    flat, _ = LG.fit_lr_grid(df.repartition(9), specs)
    monkeypatch.setattr(LG, "TREE_WIDTH", 2)
    deep, _ = LG.fit_lr_grid(df.repartition(9), specs)
    assert deep[0].coefficients.toArray() == pytest.approx(flat[0].coefficients.toArray(), abs=1e-5)
    one, _ = LG.fit_lr_grid(df.filter("y_true = 1"), specs)
    assert one[0].predict(df.limit(3)).filter("y_pred = 1").count() == 3
    empty, jobs = LG.fit_lr_grid(df.filter(F.lit(False)), specs)
    assert jobs == 0 and empty[0].intercept == 0.0
    with pytest.raises(ValueError):
        LG.fit_lr_grid(df, [MO.ModelSpec("gbt")])

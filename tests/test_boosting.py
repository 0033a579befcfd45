import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidemark.operators.metrics import macro_scores
from tidemark.plans import boosting as B


def matrix(n=160, seed=4):
    """A dense, a sparse, a signed and a constant column, and a label that needs two of them."""
    rng = np.random.default_rng(seed)
    x = np.c_[rng.integers(1, 9, n), np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5, n)), rng.integers(-3, 4, n), np.full(n, 2)].astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] < 0) | (rng.random(n) < 0.1)).astype(int)
    return x, y


def frame(spark, x, y):
    data = [(i, int(b), Vectors.dense(a) if i % 2 else Vectors.sparse(4, [j for j in range(4) if a[j]], [v for v in a if v])) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, ["id", "y_true", "features"]).repartition(5)


CUTS = [[float(v) for v in range(1, 9)], [0.0, 1.0, 2.0, 3.0], [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0], [0.0, 2.0]]


def plain(x, y, trees, max_depth, min_child, rate, lam, alpha):
    """The same trees by trying every cut on every node: margins of all rows, and (feature, cut, gain) of all splits."""
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    margin, splits = np.zeros(len(y)), []
    soft = lambda g: math.copysign(max(abs(g) - alpha, 0.0), g)
    score = lambda g, h: soft(g) ** 2 / (h + lam)

    def grow(rows, depth):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        for f, cuts in enumerate(CUTS) if depth < max_depth else ():
            for c in cuts:
                left = rows[x[rows, f] <= c]
                gl, hl = g[left].sum(), h[left].sum()
                if len(left) in (0, len(rows)) or min(hl, hs - hl) < min_child:
                    continue
                gain = score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)
                if gain > B.LEAST_GAIN and (best is None or gain > best[0] + 1e-9):
                    best = gain, f, c
        if best is None:
            step[rows] = -rate * soft(gs) / (hs + lam)
            return
        splits.append((best[1], best[2], best[0]))
        go = x[rows, best[1]] <= best[2]
        grow(rows[go], depth + 1)
        grow(rows[~go], depth + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, step = w * (p - y), w * p * (1 - p), np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        margin += step
    return margin, splits


@pytest.mark.parametrize("depth, min_child, rate, lam, alpha", [(1, 1.0, 0.1, 1.0, 0.0), (3, 1.0, 0.3, 1.0, 0.0), (3, 2.0, 0.2, 2.0, 0.5), (5, 2.0, 0.5, 0.0, 3.0)])
def test_trees_equal_plain_search(spark, depth, min_child, rate, lam, alpha):
    x, y = matrix()
    df = frame(spark, x, y)
    model = B.fit_boosted(df, max_depth=depth, min_child=min_child, rate=rate, trees=3, reg_lambda=lam, reg_alpha=alpha, row_share=1, column_share=1, bins=B.fixed_bins(CUTS))
    margin, splits = plain(x, y, 3, depth, min_child, rate, lam, alpha)
    got = {r.id: r.margin for r in model.with_margin(df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(margin, abs=1e-8)
    own = [s for t in model.trees for s in t.splits()]
    assert sorted(s.gain for s in own) == pytest.approx(sorted(s[2] for s in splits), abs=1e-7)
    assert {(s.feature, model.bins.threshold(s)) for s in own} == {s[:2] for s in splits}
    names = [r.feature for r in model.gain_importance(["a", "b", "c", "d"], spark).collect()]
    assert set(names) == {"abcd"[s[0]] for s in splits}


def test_deal_of_rows_changes_nothing(spark):
    x, y = matrix(seed=9)
    df = frame(spark, x, y)
    same = [B.fit_boosted(d, trees=2, key="id", bins=B.fixed_bins(CUTS)) for d in (df, df.repartition(1))]
    assert [[n.value for t in m.trees for n in t.leaves()] for m in same[1:]] == [[n.value for t in same[0].trees for n in t.leaves()]]


@pytest.mark.parametrize("config", range(4))
def test_every_configuration_learns(spark, config, monkeypatch):
    monkeypatch.setattr(B, "TREES_PER_CUT", 2)
    x, y = matrix(300)
    df = frame(spark, x, y).persist()
    model = B.fit_boosted(df, **{**B.BOOST_GRID[config], "trees": 3, "rate": 0.5})
    assert macro_scores(model.predict(df)).first()["F1"] > 0.75


def test_bins_and_odd_rows(spark):
    bins = B.fixed_bins([[-1.0, 0.0, 2.0], [], [5.0]])
    value = np.array([-2.0, -1.0, 0.0, 0.1, 2.0, 3.0, np.nan, 9.0, 5.0, 6.0])
    assert bins.of(np.array([0] * 7 + [1, 2, 2]), value).tolist() == [-1, -1, 0, 1, 1, 2, 0, 0, 0, 1]
    rows = [(0, Vectors.dense([1.0, float("nan")])), (1, Vectors.sparse(2, [], [])), (None, Vectors.dense([2.0, 0.0])), (1, None), (1, Vectors.dense([1.0, 3.0]))]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import IntegerType, StructField, StructType

    df = spark.createDataFrame(rows, StructType([StructField("y_true", IntegerType()), StructField("features", VectorUDT())]))
    model = B.fit_boosted(df, trees=2, min_child=0.1, row_share=1, column_share=1)
    assert model.with_margin(df).filter("margin is null").count() == 0
    one = B.fit_boosted(df.filter("y_true = 1"), trees=2)
    assert all(t.feature is None for t in one.trees) and one.predict(df).filter("y_pred = 1").count() == 5
    empty = B.fit_boosted(df.filter(F.lit(False)), trees=2)
    assert [t.value for t in empty.trees] == [0.0, 0.0]
    with pytest.raises(ValueError):
        B.quantile_bins(df, "features", 2, 300)

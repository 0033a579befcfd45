import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diagnostics as D
from tidemark.operators import metrics as M
from tidemark.operators import numeric as NU
from tidemark.operators import splits as SP
from tidemark.plans import families as FA
from tidemark.plans import models as MO
from tidemark.sources.models import load_fold_model, save_fold_model


def test_exact_medians(spark):
    rng = np.random.default_rng(1)
    skew = np.where(rng.random(3001) < 0.4, 7.0, rng.normal(size=3001) * 100)
    data = [(float(a), float(b) if i % 3 else None, None) for i, (a, b) in enumerate(zip(skew, rng.integers(0, 5, 3001)))]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = NU.exact_medians(df, ["a", "b", "c"])
    assert got["a"] == np.median(skew)
    assert got["b"] == np.median([b for _, b, _ in data if b is not None]) and got["c"] is None


def test_imputer_and_scaler_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (None, 5.0, None), (float("nan"), 5.0, None), (4.0, 5.0, None)], "a double, k double, e double")
    prep = NU.fit_numeric(df, ["a", "k", "e"])
    assert prep.fill["a"] == 2.5 and prep.fill["e"] == 0.0
    new = prep.apply(spark.createDataFrame([(2.5, 6.0, 1.0)], "a double, k double, e double")).first()
    assert new["k"] == 1.0 and new["e"] == 1.0 and new["a"] == pytest.approx(0.0)


def test_folds_holdout_permutation(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(97)] + [(1000, 2), (1001, 2)], "k long, label int")
    f = SP.stratified_folds(df, k=5, key="k").collect()
    assert len(f) == 99 and {r["fold"] for r in f} == {1, 2, 3, 4, 5}
    for lab in (0, 1, 2):
        n = [sum(r["label"] == lab and r["fold"] == i for r in f) for i in range(1, 6)]
        assert max(n) - min(n) <= 1
    dev = SP.stratified_holdout(df.filter("label < 2"), frac=0.125, key="k").collect()
    assert sum(r["is_dev"] for r in dev if r["label"] == 0) == 11 and sum(r["is_dev"] for r in dev if r["label"] == 1) == 1
    p = SP.permute_column(df.withColumn("v", F.col("k") * 2), "v", ["k"], ["label"]).collect()
    for lab in (0, 1, 2):
        assert sorted(r["v"] for r in p if r["label"] == lab) == sorted(r["k"] * 2 for r in p if r["label"] == lab)
    assert any(r["v"] != r["k"] * 2 for r in p)


def test_macro_edges(spark):
    rows = [("never", 0, 0), ("never", 1, 0), ("only", 0, 0), ("only", 0, 1), ("wrong", 0, 1), ("wrong", 1, 0), ("right", 1, 1)]
    got = {r["g"]: r for r in M.macro_scores(spark.createDataFrame(rows, "g string, y_true int, y_pred int"), ["g"]).collect()}
    assert got["never"]["P"] == 0.25 and got["never"]["R"] == 0.5 and got["never"]["F1"] == pytest.approx(1 / 3)
    assert got["only"]["R"] == 0.25 and got["wrong"]["F1"] == 0 and got["right"]["F1"] == 1


def test_stability_example(spark):
    a = [(f, "a", d) for f, d in enumerate([0.2, 0.1, 0.0, 0.3, -0.1], 1)]
    df = spark.createDataFrame(a + [(1, "b", 0.1), (2, "b", -0.1)], "fold int, feature string, drop double")
    st = {r["feature"]: r for r in D.stability(df).collect()}
    assert st["a"]["sign_consistency"] == 0.8 and st["a"]["score"] == pytest.approx(0.112) and st["a"]["majority_sign"] == 1
    assert st["b"]["selected_frac"] == 0.4 and st["b"]["score"] == pytest.approx(0.02) and st["b"]["majority_sign"] == 1
    assert [r["feature"] for r in D.stable_only(D.stability(df)).collect()] == ["a"]
    edge = spark.createDataFrame([(1, "e", 0.1), (2, "e", 0.1), (3, "e", 0.1)], "fold int, feature string, drop double")
    assert D.stable_only(D.stability(edge)).count() == 1


def test_importance_single_fold(spark):
    df = spark.createDataFrame([("x", 2.0), ("y", 1.0), ("y", 3.0)], "feature string, importance double")
    got = {r["feature"]: r["std_importance"] for r in D.aggregate_importance(df).collect()}
    assert got["x"] == 0.0 and got["y"] == pytest.approx(2**0.5)


def test_wilcoxon(spark):
    pairs = spark.createDataFrame(
        [("zero", 1.0, 1.0), ("one", 2.0, 1.0), *[("five", float(i), 0.0) for i in range(1, 6)], ("tie", 1.0, 0.0), ("tie", 0.0, 1.0), ("tie", 3.0, 0.0)],
        "g string, a double, b double",
    )
    got = {r["g"]: r for r in D.wilcoxon_signed_rank(pairs, "a", "b", ["g"]).collect()}
    assert got["zero"]["W"] is None and got["zero"]["p"] is None
    assert got["one"]["W"] == 0 and got["one"]["p"] == 1.0
    assert got["five"]["p"] == pytest.approx(0.0625)
    assert got["tie"]["w_plus"] == 4.5 and got["tie"]["W"] == 1.5


def sample(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        y = i % 2
        text = " ".join(("alpha beta" if y else "gamma delta").split() + [f"w{i % 7}"])
        rows.append((f"u{i}", y, text, float(y + rng.normal() * 0.2), float(rng.normal()), float(rng.normal())))
    df = spark.createDataFrame(rows, "username string, y_true int, aggr_text string, good double, noise double, m double")
    return SP.stratified_folds(df, "y_true", key="username")


def test_families_end_to_end(spark, tmp_path):
    cmap = spark.createDataFrame([("alpha", 0), ("gamma", 1)], "token string, cluster int")
    setup = FA.Setup(("good", "noise"), ("m",), FA.Lexicon.load(cmap, 2), min_df=2)
    df = FA.keep(FA.tokenized(sample(spark), setup))
    specs = [MO.ModelSpec("lr", {"penalty": p, "C": 10.0, "max_iter": 15}) for p in ("l1", "l2")]
    spec, _, dev, clf, blocks, pred = FA.run_family(df, FA.FAMILIES["Fusion"], specs, [setup], 1)
    assert dev > 0.9 and FA.f1_of(pred) > 0.9 and spec is specs[0]
    names = blocks.names_of(FA.FAMILIES["Fusion"])
    assert len(names) == clf.model.numFeatures and names[-2:] == ["user:good", "user:noise"]
    imp = {r["feature"]: r["importance"] for r in MO.coef_importance(clf, names, spark).collect()}
    assert len(imp) == len(names)
    path = save_fold_model(clf.model, str(tmp_path), 1, "Fusion")
    assert path.endswith("fold=1/family=Fusion")
    again = load_fold_model(str(tmp_path), 1, "Fusion").stages[0]
    assert np.allclose(again.coefficients.toArray(), clf.model.coefficients.toArray())
    lofo = {r["feature"]: r["delta_F1"] for r in FA.lofo_refit(df, specs[1], setup, 1).collect()}
    assert lofo["good"] < -0.2 and lofo["noise"] > -0.2
    assert {r["block"] for r in FA.block_ablation(df, specs[1], setup, 1).collect()} == {"no_bow", "no_topics", "no_msg_numeric"}
    train, test = FA.split_fold(df, 1)
    users, _, _ = FA.refit_score(specs[1], setup, ("users",), train, test)
    scaled = FA.scaled_users(test, setup, train).select("username", "fold", "y_true", "good", "noise")
    scorer = FA.user_scorer(users, ["good", "noise"])
    perm = {r["feature"]: r["drop_mean"] for r in D.permutation_importance(scorer, scaled, ["good", "noise"], ["username"], repeats=3).collect()}
    assert perm["good"] > 0.2 > abs(perm["noise"])
    zero = {r["feature"]: r["drop_F1"] for r in D.lofo_zero(scorer, scaled, ["good", "noise"]).collect()}
    assert zero["good"] > 0.2


def test_block_ablation_at_the_best_component_count_and_without_components(spark, monkeypatch):
    cmap = spark.createDataFrame([("alpha", 0), ("gamma", 1)], "token string, cluster int")
    setup = FA.Setup(("good", "noise"), ("m",), FA.Lexicon.load(cmap, 2), min_df=2)
    df = FA.keep(FA.tokenized(sample(spark), setup))
    spec, blocks = MO.ModelSpec("lr", {"penalty": "l2", "C": 10.0, "max_iter": 10}), ("bow", "mnum")
    sweep = []
    rows = FA.svd_ablation(df, spec, setup, 1, grid=(2, 0, 3, 500), blocks=blocks, sweep=sweep).collect()
    assert [(fold, k) for fold, k, _ in sweep] == [(1, 2), (1, 0), (1, 3)]  # 500 is beyond the terms
    best = max(sweep, key=lambda s: s[2])[1]
    assert best == 2 and {(r["fold"], r["svd_k"], r["block"]) for r in rows} == {(1, k, b) for k in (2, 0) for b in ("no_bow", "no_msg_numeric")}
    trainval, _ = FA.split_fold(df, 1)
    marked = FA.SP.stratified_holdout(trainval, "y_true", 0.125, FA.SP.DEFAULT_SEED, setup.key)
    for _, k, f1 in sweep:
        alone = FA.refit_score(spec, FA.replace(setup, svd_k=k), blocks, marked.filter("not is_dev"), marked.filter("is_dev"))[2]
        assert FA.f1_of(alone) == pytest.approx(f1)
    for r in rows:
        if r["svd_k"] == 0:
            want = {x["block"]: x["delta_F1"] for x in FA.block_ablation(df, spec, setup, 1, blocks).collect()}
            assert r["delta_F1"] == pytest.approx(want[r["block"]])
    only = FA.svd_ablation(df, spec, setup, 1, grid=(0,), blocks=blocks).collect()
    assert {r["svd_k"] for r in only} == {0} and len(only) == 2


def test_the_block_ablation_query_sweeps_components(spark, monkeypatch):
    from catalog import modelling

    seen = []
    monkeypatch.setattr(FA, "svd_sweep", lambda train, dev, spec, setup, grid, blocks: seen.append(tuple(grid)) or dict.fromkeys(grid, 0.5))
    monkeypatch.setattr(FA, "_ablated", lambda train, test, spec, setup, fold, blocks, *a: [(fold, setup.svd_k, b, 0.0) for b in blocks])
    assert modelling.block_ablation(spark, "/root/testdata/sf0.001").count() == 3
    monkeypatch.setattr(FA, "svd_sweep", lambda train, dev, spec, setup, grid, blocks: {0: 0.5, 300: 0.6})
    assert {r["svd_k"] for r in modelling.block_ablation(spark, "/root/testdata/sf0.001").collect()} == {0, 300}
    assert seen == [(0, 300, 500, 800)]


@pytest.mark.parametrize("kind,params", [("rbf_svm", {"n_components": 64, "max_iter": 10}), ("gbt", {"trees": 3}), ("mlp", {"max_iter": 30, "hidden": (8,)})])
def test_other_models_separate(spark, kind, params):
    setup = FA.Setup(("good", "noise"))
    _, _, pred = FA.refit_score(MO.ModelSpec(kind, params), setup, ("users",), *FA.split_fold(FA.keep(sample(spark)), 1))
    assert FA.f1_of(pred) > 0.85


def test_grids():
    assert len(MO.lr_grid()) == 25 and len(MO.svm_grid()) == 5 and len(MO.gbt_grid()) == 4

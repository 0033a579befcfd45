"""Fitted-model queries. Most fits have no SQL form and are checked by rows and by unit tests.

One configuration each: grids belong to the user's own runs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.evaluation import folded
from catalog.folds import FOLD_SQL
from catalog.payloads import LABELED_SQL
from tidemark.operators import diagnostics as D
from tidemark.operators import embeddings as EM
from tidemark.operators import lsa as LS
from tidemark.operators import tfidf as TF
from tidemark.operators.metrics import macro_scores
from tidemark.operators.sequences import MAX_VOCAB
from tidemark.plans import boosting as BO
from tidemark.plans import families as FA
from tidemark.plans import lr_grid as LG
from tidemark.plans import models as MO
from tidemark.plans import views as V

LR = MO.ModelSpec("lr", {"penalty": "l2", "C": 10.0})
SVM = MO.ModelSpec("rbf_svm", {"C": 10.0, "n_components": 64, "max_iter": 10})
GBT = MO.ModelSpec("gbt", {"max_depth": 3, "trees": 5})
MLP = MO.ModelSpec("mlp", {"max_iter": 15})
USERS = ("n_chars", "n_words", "toxic")
MESSAGE = ("word_len", "n_lines")
TEST_FOLD = 1


def _setup(spark, sf, text=True, vectors=False, **over):
    lex = FA.Lexicon.load(V.cluster_map(spark, sf), V.N_CLUSTERS) if text else None
    wv = FA.WordVectors(*EM.vector_matrix(V.word_vectors(spark, sf), V.DIM, MAX_VOCAB)) if vectors else None
    return FA.Setup(USERS, MESSAGE, lex, wv, key="doc_id", **over)


def _data(spark, sf, setup):
    df = FA.tokenized(folded(spark, sf).withColumnRenamed("label", "y_true"), setup)
    return FA.keep(df.select("doc_id", "fold", "y_true", "tokens", *USERS, *MESSAGE))


def _fold_scores(spark, sf, blocks, spec, **over):
    setup = _setup(spark, sf, text="topics" in blocks, vectors="embedding" in blocks, **over)
    pred = FA.run_family(_data(spark, sf, setup), blocks, [spec], [setup], TEST_FOLD)[-1]
    return macro_scores(pred.withColumn("fold", F.lit(TEST_FOLD)), ["fold"])


def lr_scores(spark, sf):
    """All five folds of the Users family."""
    setup = _setup(spark, sf, text=False)
    return FA.cross_validate(_data(spark, sf, setup), {"Users": FA.FAMILIES["Users"]}, [LR], [setup])[1]


def message_scores(spark, sf):
    return _fold_scores(spark, sf, FA.FAMILIES["Message"], LR)


def fusion_scores(spark, sf):
    return _fold_scores(spark, sf, FA.FAMILIES["Fusion"], LR)


def embedding_fusion_scores(spark, sf):
    return _fold_scores(spark, sf, FA.EMBEDDING_FUSION, LR)


def rbf_svm_scores(spark, sf):
    return _fold_scores(spark, sf, FA.FAMILIES["Users"], SVM)


def gbt_scores(spark, sf):
    return _fold_scores(spark, sf, FA.FAMILIES["Users"], GBT)


def mlp_scores(spark, sf):
    return _fold_scores(spark, sf, FA.FAMILIES["Users"], MLP)


def lsa(spark, sf):
    docs = FA.keep(TF.with_terms(V.documents(spark, sf), 1).select("doc_id", "terms"))
    model = TF.fit_tfidf(docs, "doc_id", max_features=500)
    vecs = model.vectorizer().transform(docs)
    return LS.components_table(LS.fit_lsa(vecs, "bow", 10, 500), spark)


def coef_importance(spark, sf):
    setup = _setup(spark, sf)
    _, _, _, clf, blocks, _ = FA.run_family(_data(spark, sf, setup), FA.FAMILIES["Message"], [LR], [setup], TEST_FOLD)
    return MO.coef_importance(clf, blocks.names_of(FA.FAMILIES["Message"]), spark)


def tree_importance(spark, sf):
    setup = _setup(spark, sf, text=False)
    _, _, _, clf, blocks, _ = FA.run_family(_data(spark, sf, setup), FA.FAMILIES["Users"], [GBT], [setup], TEST_FOLD)
    return MO.tree_importance(clf, blocks.names_of(FA.FAMILIES["Users"]), spark)


def lofo_refit(spark, sf):
    setup = _setup(spark, sf, text=False)
    return FA.lofo_refit(_data(spark, sf, setup), LR, setup, TEST_FOLD)


def block_ablation(spark, sf):
    """Blocks left out at the component count that is best on dev, and without components."""
    setup = _setup(spark, sf)
    return FA.svd_ablation(_data(spark, sf, setup), LR, setup, TEST_FOLD)


def permutation_importance_fitted(spark, sf):
    """User columns permuted inside a fitted embedding fusion."""
    setup = _setup(spark, sf, text=False, vectors=True)
    df = _data(spark, sf, setup)
    clf, blocks, _ = FA.refit_score(LR, setup, FA.EMBEDDING_FUSION, *FA.split_fold(df, TEST_FOLD))
    train, test = FA.split_fold(df, TEST_FOLD)
    ready = blocks.transform(FA.scaled_users(test, setup, train)).select("doc_id", "fold", "y_true", "embedding", *USERS)
    scorer = FA.user_scorer(clf, USERS, extra=["embedding"])
    return D.permutation_importance(scorer, ready, USERS, ["doc_id"], repeats=20)


def lr_log_odds(spark, sf):
    """Almost unpenalised fits on one binary column, per fold: intercept and coefficient are weighted log-odds."""
    specs = [MO.ModelSpec("lr", {"penalty": p, "C": 1e12}) for p in ("l1", "l2")]
    df = folded(spark, sf).select("fold", F.col("label").alias("y_true"), (F.col("n_chars") > 1000).cast("double").alias("long"))
    df = FA.keep(FA.VectorAssembler(inputCols=["long"], outputCol="features").transform(df))
    out = []
    for fold in range(1, 6):
        scorers, _ = LG.fit_lr_grid(df.filter(F.col("fold") != fold), specs)
        out += [(fold, m.params["penalty"], round(s.intercept, 3) + 0.0, round(float(s.coefficients[0]), 3) + 0.0) for m, s in zip(specs, scorers)]
    df.unpersist()
    return spark.createDataFrame(out, "fold int, penalty string, intercept double, coefficient double")


#: Cuts of the columns of `boosted_stumps`, and its (least curvature of a side, squared penalty, absolute penalty).
STUMP_CUTS = {"n_chars": (0, 200, 400, 800, 1600, 3200, 6400), "n_words": (0, 50, 100, 200, 400, 800), "n_lines": (0, 1, 2, 4, 8), "toxic": (0,)}
STUMP_PENALTIES = ((1.0, 1.0, 0.0), (2.0, 2.0, 0.5))


def boosted_stumps(spark, sf):
    """The first split of boosted trees, per left-out fold and penalties: column, cut, gain and both leaf values."""
    df = FA.VectorAssembler(inputCols=list(STUMP_CUTS), outputCol="features").transform(folded(spark, sf).withColumnRenamed("label", "y_true"))
    df = FA.keep(df.select("fold", "y_true", "features"))
    bins, out = BO.fixed_bins([[float(c) for c in cuts] for cuts in STUMP_CUTS.values()]), []
    for fold in range(1, 6):
        for i, (least, square, absolute) in enumerate(STUMP_PENALTIES):
            model = BO.fit_boosted(
                df.filter(F.col("fold") != fold), max_depth=1, trees=1, min_child=least, reg_lambda=square, reg_alpha=absolute,
                row_share=1, column_share=1, bins=bins,
            )
            for s in model.trees[0].splits():
                values = (round(x, 6) + 0.0 for x in (s.gain, s.left.value, s.right.value))
                out.append((fold, i, list(STUMP_CUTS)[s.feature], bins.threshold(s), *values))
    df.unpersist()
    return spark.createDataFrame(out, "fold int, penalties int, feature string, cut double, gain double, left_value double, right_value double")


QUERIES = {
    f.__name__: f
    for f in (
        lr_scores, message_scores, fusion_scores, embedding_fusion_scores, rbf_svm_scores, gbt_scores, mlp_scores, lsa,
        coef_importance, tree_importance, lofo_refit, block_ablation, permutation_importance_fitted, lr_log_odds,
        boosted_stumps,
    )
}

_STUMP_CUTS = " UNION ALL ".join(
    f"SELECT {f} AS f, '{name}' AS feature, {float(c)} AS cut, {float(cuts[i + 1]) if i + 1 < len(cuts) else 1e18} AS following"
    for f, (name, cuts) in enumerate(STUMP_CUTS.items())
    for i, c in enumerate(cuts)
)
_STUMP_VALUES = " UNION ALL ".join(f"SELECT fold, y, {f} AS f, {name} AS v FROM folds" for f, name in enumerate(STUMP_CUTS))
_PENALTIES = ", ".join(f"({i}, {float(a)}, {float(b)}, {float(c)})" for i, (a, b, c) in enumerate(STUMP_PENALTIES))


def _drawn(g: str) -> str:
    return f"sign({g}) * greatest(abs({g}) - alpha, 0.0)"


#: Most fits are checked by rows and unit tests only; a single column or a single split has a closed form.
SQL: dict[str, str] = {
    "lr_log_odds": f"""WITH {LABELED_SQL}, {FOLD_SQL},
        t AS (SELECT unnest([1, 2, 3, 4, 5]) AS out),
        c AS (SELECT out, n_chars > 1000 AS long, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
              FROM t, folds WHERE fold <> out GROUP BY ALL),
        w AS (SELECT out, sum(neg) / CAST(sum(pos) AS DOUBLE) AS r FROM c GROUP BY out),
        o AS (SELECT out, max(ln(pos * r / neg)) FILTER (WHERE NOT long) AS a, max(ln(pos * r / neg)) FILTER (WHERE long) AS b
              FROM c JOIN w USING (out) GROUP BY out)
        SELECT CAST(out AS INTEGER) AS fold, penalty, round(a, 3) + 0.0 AS intercept, round(b - a, 3) + 0.0 AS coefficient
        FROM o, (SELECT unnest(['l1', 'l2']) AS penalty)""",
    # Gradients are w * (1/2 - y), curvatures w / 4: counts of both labels on either side of a cut give all sums.
    "boosted_stumps": f"""WITH {LABELED_SQL}, {FOLD_SQL}, cuts AS ({_STUMP_CUTS}), vals AS ({_STUMP_VALUES}),
        n AS (SELECT out, f, feature, cut, count(*) FILTER (WHERE y = 1 AND v <= cut) AS lp, count(*) FILTER (WHERE y = 0 AND v <= cut) AS ln,
                     count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n, count(*) FILTER (WHERE v > cut AND v <= following) AS beside
              FROM (SELECT unnest([1, 2, 3, 4, 5]) AS out) t, vals JOIN cuts USING (f) WHERE fold <> out GROUP BY out, f, feature, cut),
        w AS (SELECT *, greatest(n, 1) / CAST(greatest(p, 1) AS DOUBLE) AS w FROM n),
        s AS (SELECT *, 0.5 * (ln - w * lp) AS gl, 0.25 * (ln + w * lp) AS hl, 0.5 * (n - w * p) AS g, 0.25 * (n + w * p) AS h FROM w),
        q AS (SELECT *, g - gl AS gr, h - hl AS hr FROM s, (VALUES {_PENALTIES}) AS c(penalties, least, square, alpha) WHERE beside > 0),
        d AS (SELECT *, {_drawn("gl")} AS dl, {_drawn("gr")} AS dr, {_drawn("g")} AS da FROM q WHERE hl >= least AND hr >= least),
        r AS (SELECT *, dl * dl / (hl + square) + dr * dr / (hr + square) - da * da / (h + square) AS gain FROM d)
        SELECT CAST(out AS INTEGER) AS fold, CAST(penalties AS INTEGER) AS penalties, feature, CAST(cut AS DOUBLE) AS cut, round(gain, 6) + 0.0 AS gain,
               round(-0.1 * dl / (hl + square), 6) + 0.0 AS left_value, round(-0.1 * dr / (hr + square), 6) + 0.0 AS right_value
        FROM r WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY out, penalties ORDER BY round(gain, 9) DESC, f, cut) = 1""",
}

"""Users, Message and Fusion families: blocks, grid search, refit, folds, ablations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import ENGLISH_STOPWORDS, normalize_tokens
from tidemark.functions.vectors import project
from tidemark.operators import lsa as LS
from tidemark.operators import numeric as NU
from tidemark.operators import parts as PT
from tidemark.operators import splits as SP
from tidemark.operators import tfidf as TF
from tidemark.operators.columns import prefixed, union_all
from tidemark.operators.embeddings import mean_vector
from tidemark.operators.metrics import macro_scores
from tidemark.operators.topics import topic_vector
from tidemark.plans import lr_grid as LG
from tidemark.plans import models as MO

FAMILIES = {"Users": ("users",), "Message": ("bow", "topics", "mnum"), "Fusion": ("bow", "topics", "mnum", "users")}
#: Late fusion of a text embedding with the user block.
EMBEDDING_FUSION = ("embedding", "users")
MESSAGE_BLOCKS = ("bow", "topics", "mnum")
ABLATION = "fold int, svd_k int, block string, delta_F1 double"


@dataclass(frozen=True)
class Lexicon:
    """A token to cluster map on the driver, at most the reader's cap of entries."""

    words: list[str]
    clusters: list[int]
    n_clusters: int

    @classmethod
    def load(cls, cmap: DataFrame, n_clusters: int, max_rows: int = 200_000) -> Lexicon:
        rows = cmap.select("token", "cluster").limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"more than {max_rows} cluster entries")
        return cls([r["token"] for r in rows], [int(r["cluster"]) for r in rows], n_clusters)


@dataclass(frozen=True)
class WordVectors:
    """Word vectors on the driver, bounded by the vocabulary cap."""

    words: list[str]
    matrix: np.ndarray


@dataclass(frozen=True)
class Setup:
    """What the blocks are built from; every block is fitted on training rows only."""

    user_cols: tuple[str, ...] = ()
    message_cols: tuple[str, ...] = ()
    lexicon: Lexicon | None = None
    vectors: WordVectors | None = None
    max_n: int = 1
    min_df: int = 5
    max_features: int = TF.MAX_FEATURES
    svd_k: int = 0
    scale_svd: bool = True
    scale_numeric: bool = True
    scale_topics: bool = True
    fill: str = "median"
    key: str = "username"
    #: Column that numbers the text parts of one key; its other columns are the same on all parts.
    part: str | None = None
    stopwords: tuple[str, ...] = ENGLISH_STOPWORDS


def tokenized(df: DataFrame, setup: Setup, text: str = "aggr_text") -> DataFrame:
    """Add tokens once; fold and grid loops reuse them."""
    return df.withColumn("tokens", normalize_tokens(F.col(text), setup.stopwords))


def text_terms(df: DataFrame, setup: Setup) -> DataFrame:
    """Add the terms of each row; those over the borders of text parts belong to the later part."""
    return PT.with_part_terms(df, setup.max_n, setup.key, setup.part) if setup.part else TF.with_terms(df, setup.max_n)


class FoldVocabularies:
    """The vocabularies that leave out one fold each, from one pass per text setup over all rows."""

    def __init__(self, df: DataFrame, k: int):
        self.df, self.k, self._fitted = df, k, {}

    def model(self, setup: Setup, fold: int) -> TF.TfidfModel:
        key = (setup.max_n, setup.min_df, setup.max_features)
        if key not in self._fitted:
            fitted = TF.fit_tfidf_folds(
                text_terms(self.df, setup), setup.key, "fold", range(1, self.k + 1), setup.max_n, setup.min_df, TF.MAX_DF, setup.max_features, unique_docs=not setup.part
            )
            self._fitted[key] = replace(fitted, vocab=keep(fitted.vocab))
        return self._fitted[key].model(fold)

    def release(self) -> None:
        for fitted in self._fitted.values():
            fitted.vocab.unpersist()
        self._fitted.clear()


class Blocks:
    """Fitted feature blocks; `transform` adds one vector column per block, row-locally."""

    def __init__(self, setup: Setup, names: Sequence[str], train: DataFrame, vocabulary: TF.TfidfModel | None = None):
        self.setup, self.names, self.vocabulary = setup, tuple(names), vocabulary
        if setup.part and (setup.svd_k or not {"users", "mnum", "bow"}.issuperset(names)):
            raise ValueError("histories in parts have users, mnum and bow blocks")
        self.feature_names: dict[str, list[str]] = {}
        self._steps = [getattr(self, "_fit_" + n)(train) for n in self.names]

    def _numeric(self, train, cols, out, block):
        prep = NU.fit_numeric(self._units(train), cols, fill=self.setup.fill, scale=self.setup.scale_numeric)
        tmp = [f"_{out}_{i}" for i in range(len(cols))]
        asm = VectorAssembler(inputCols=tmp, outputCol=out, handleInvalid="error")
        self.feature_names[out] = prefixed(cols, block)

        def step(df):
            e = prep.expressions(df)
            return asm.transform(df.withColumns(dict(zip(tmp, (e[c] for c in cols))))).drop(*tmp)

        return step

    def _fit_users(self, train):
        return self._numeric(train, self.setup.user_cols, "users", "user")

    def _fit_mnum(self, train):
        return self._numeric(train, self.setup.message_cols, "mnum", "mnum")

    def _fit_topics(self, train):
        lex = self.setup.lexicon
        self.feature_names["topics"] = prefixed(map(str, range(lex.n_clusters)), "topic")

        def raw(df):
            return df.withColumn("topics", topic_vector(F.col("tokens"), lex.words, lex.clusters, lex.n_clusters))

        if not self.setup.scale_topics:
            return raw
        # Scaling without centring: the shift goes into the free intercept.
        shrink = np.diag(1.0 / LS.vector_deviation(raw(train), "topics"))
        return lambda df: raw(df).withColumn("topics", project(F.col("topics"), shrink))

    def _units(self, df):
        """One row per key."""
        return PT.one_row(df, self.setup.key, self.setup.part) if self.setup.part else df

    def _fit_bow(self, train):
        s = self.setup
        model = self.vocabulary or TF.fit_tfidf(text_terms(train, s), s.key, s.max_n, s.min_df, TF.MAX_DF, s.max_features, unique_docs=not s.part)
        if s.part:
            names = [r["term"] for r in model.terms_in_order()]
            self.feature_names["bow"] = prefixed(names, "bow")
            return lambda units, parts: PT.with_unit_vectors(units, model.long(text_terms(parts, s), s.key), len(names), s.key)
        vectorizer: PipelineModel = model.vectorizer()
        names = vectorizer.stages[0].vocabulary
        self.n_terms = len(names)

        def bow(df):
            return vectorizer.transform(TF.with_terms(df, s.max_n)).drop("terms", "_tf", "_tfidf")

        lsa = LS.fit_lsa(bow(train), "bow", s.svd_k, len(names), scale=s.scale_svd) if s.svd_k else None
        if lsa is None:
            self.feature_names["bow"] = prefixed(names, "bow")
            return bow
        self.feature_names["bow"] = [f"svd:{i}" for i in range(lsa.k)]
        return lambda df: lsa.transform(bow(df), "bow", "bow")

    def _fit_embedding(self, train):
        wv = self.setup.vectors
        dim = wv.matrix.shape[1]
        self.feature_names["embedding"] = [f"emb:{i}" for i in range(dim)]
        from pyspark.ml.functions import array_to_vector

        zero = F.array_repeat(F.lit(0.0), dim)
        return lambda df: df.withColumn(
            "embedding", array_to_vector(F.coalesce(mean_vector(F.col("tokens"), wv.words, wv.matrix), zero))
        )

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._units(df)
        for name, step in zip(self.names, self._steps):
            out = step(out, df) if self.setup.part and name == "bow" else step(out)
        return out

    def names_of(self, blocks: Sequence[str]) -> list[str]:
        return [n for b in blocks for n in self.feature_names[b]]


def assemble_blocks(df: DataFrame, blocks: Sequence[str], out: str = "features") -> DataFrame:
    """Concatenate block vectors of a row, in order; a missing block is an error."""
    return VectorAssembler(inputCols=list(blocks), outputCol=out, handleInvalid="error").transform(df)


def keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def f1_of(pred: DataFrame) -> float:
    return macro_scores(pred).first()["F1"]


def grid_scores(specs: Sequence[MO.ModelSpec], train: DataFrame, dev: DataFrame) -> list[float]:
    """Dev macro F1 of every configuration. Logistic regressions are fitted together, one job per iteration."""
    if len(specs) > 1 and all(s.kind == "lr" for s in specs):
        scorers, _ = LG.fit_lr_grid(train, specs)
        f1 = {r["config"]: r["F1"] for r in LG.sweep(scorers, specs, dev).collect()}
        return [f1[i] or 0.0 for i in range(len(specs))]
    n = train.count()
    return [f1_of(MO.fit(spec, train, n=n).predict(dev)) for spec in specs]


def split_fold(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def refit_score(spec: MO.ModelSpec, setup: Setup, blocks: Sequence[str], train: DataFrame, test: DataFrame, vocabulary: TF.TfidfModel | None = None) -> tuple[MO.Classifier, Blocks, DataFrame]:
    """Fit blocks and model on `train`, score `test`: (classifier, blocks, (key, y_true, y_pred))."""
    fitted = Blocks(setup, blocks, train, vocabulary)
    ready = keep(assemble_blocks(fitted.transform(train), blocks).select("y_true", "features"))
    try:
        clf = MO.fit(spec, ready)
    finally:
        ready.unpersist()
    pred = clf.predict(assemble_blocks(fitted.transform(test), blocks))
    return clf, fitted, pred


def run_family(
    df: DataFrame,
    blocks: Sequence[str],
    specs: Sequence[MO.ModelSpec],
    setups: Sequence[Setup],
    fold: int,
    dev_frac: float = 0.125,
    seed: int = SP.DEFAULT_SEED,
    vocabularies: FoldVocabularies | None = None,
    sweep: list | None = None,
):
    """One fold of one family: choose text setup and model on dev, refit on train + dev, score test.

    `sweep` gets (fold, spec, setup, dev F1) of every configuration tried, the first of equals is chosen.

    Text features depend on the setup only, so they are built once per setup and the model grid
    runs over the cached table. Returns (spec, setup, dev F1, classifier, blocks, predictions).
    """
    trainval, test = split_fold(df, fold)
    best = (specs[0], setups[0], -1.0)
    if len(specs) * len(setups) > 1:
        part, key = setups[0].part, setups[0].key
        marked = keep(PT.user_holdout(trainval, "y_true", dev_frac, seed, key, part) if part else SP.stratified_holdout(trainval, "y_true", dev_frac, seed, key))
        train, dev = marked.filter(~F.col("is_dev")), marked.filter("is_dev")
        for setup in setups:
            fitted = Blocks(setup, blocks, train)
            tr = keep(assemble_blocks(fitted.transform(train), blocks).select("y_true", "features"))
            dv = keep(assemble_blocks(fitted.transform(dev), blocks).select("y_true", "features"))
            for spec, f1 in zip(specs, grid_scores(specs, tr, dv)):
                if sweep is not None:
                    sweep.append((fold, spec, setup, f1))
                if f1 > best[2]:
                    best = (spec, setup, f1)
            tr.unpersist()
            dv.unpersist()
        marked.unpersist()
    shared = vocabularies.model(best[1], fold) if vocabularies and "bow" in blocks else None
    clf, fitted, pred = refit_score(best[0], best[1], blocks, trainval, test, shared)
    return (*best, clf, fitted, pred)


def cross_validate(df: DataFrame, families: dict[str, Sequence[str]], specs: Sequence[MO.ModelSpec], setups: Sequence[Setup], k: int = 5, dev_frac: float = 0.125) -> tuple[DataFrame, DataFrame]:
    """(predictions (fold, family, key, y_true, y_pred), metrics (fold, family, P, R, F1)).

    `df` holds `fold`, `y_true`, `tokens` and the numeric columns, and is best cached. The driver
    only loops over folds and families; scores of all of them come from one pass at the end. Refits of
    all folds share one pass of term counts; a fold's vocabulary is what the other folds leave. With
    `Setup.part`, `df` has one row per text part and predictions one per key.
    """
    key = setups[0].key
    parts, vocabularies = [], FoldVocabularies(df, k)
    for fold in range(1, k + 1):
        for family, blocks in families.items():
            pred = run_family(df, blocks, specs, setups, fold, dev_frac, vocabularies=vocabularies)[-1]
            parts.append(
                pred.select(F.lit(fold).alias("fold"), F.lit(family).alias("family"), key, "y_true", "y_pred")
            )
    vocabularies.release()
    predictions = union_all(*parts)
    return predictions, macro_scores(predictions, ["fold", "family"])


def block_ablation(df: DataFrame, spec: MO.ModelSpec, setup: Setup, fold: int, blocks: Sequence[str] = MESSAGE_BLOCKS) -> DataFrame:
    """(fold, svd_k, block, delta_F1): refit without one block, negative means the block helps."""
    return df.sparkSession.createDataFrame(_ablated(*split_fold(df, fold), spec, setup, fold, blocks), ABLATION)


def svd_ablation(
    df: DataFrame,
    spec: MO.ModelSpec,
    setup: Setup,
    fold: int,
    grid: Sequence[int] = LS.SVD_GRID,
    blocks: Sequence[str] = MESSAGE_BLOCKS,
    dev_frac: float = 0.125,
    seed: int = SP.DEFAULT_SEED,
    sweep: list | None = None,
) -> DataFrame:
    """`block_ablation` with as many components of the terms as score best on dev, and with the terms themselves (svd_k = 0).

    `sweep` gets (fold, k, dev F1) of every k of `grid` below the number of terms; the first of equals is chosen.
    """
    trainval, test = split_fold(df, fold)
    marked = keep(SP.stratified_holdout(trainval, "y_true", dev_frac, seed, setup.key))
    scores = svd_sweep(marked.filter(~F.col("is_dev")), marked.filter("is_dev"), spec, setup, grid, blocks)
    marked.unpersist()
    if sweep is not None:
        sweep += [(fold, k, f1) for k, f1 in scores.items()]
    best = max(scores, key=scores.get) if scores else 0
    model = _vocabulary(trainval, setup)
    rows = [r for k in dict.fromkeys((best, 0)) for r in _ablated(trainval, test, spec, replace(setup, svd_k=k), fold, blocks, model)]
    model.vocab.unpersist()
    return df.sparkSession.createDataFrame(rows, ABLATION)


def svd_sweep(train: DataFrame, dev: DataFrame, spec: MO.ModelSpec, setup: Setup, grid: Sequence[int] = LS.SVD_GRID, blocks: Sequence[str] = MESSAGE_BLOCKS) -> dict[int, float]:
    """Dev macro F1 for each number of components below the number of terms; 0 stands for the terms themselves.

    The components of a smaller k are the first ones of a larger k, so one decomposition serves all.
    """
    model, out = _vocabulary(train, setup), {}
    terms = len(model.terms_in_order())

    def ready(fitted, rows):
        return keep(fitted.transform(rows).select("y_true", *blocks))

    for some in ([k for k in grid if k == 0], [k for k in grid if 0 < k < terms]):
        if not some:
            continue
        fitted = Blocks(replace(setup, svd_k=max(some)), blocks, train, model)
        tr, dv, width = ready(fitted, train), ready(fitted, dev), len(fitted.feature_names["bow"])
        by_width: dict[int, float] = {}
        for k in some:
            n = min(k or width, width)
            if n not in by_width:
                clf = MO.fit(spec, assemble_blocks(_first(tr, "bow", n, width), blocks).select("y_true", "features"))
                by_width[n] = f1_of(clf.predict(assemble_blocks(_first(dv, "bow", n, width), blocks))) or 0.0
            out[k] = by_width[n]
        tr.unpersist()
        dv.unpersist()
    model.vocab.unpersist()
    return {k: out[k] for k in grid if k in out}


def _first(df: DataFrame, col: str, n: int, width: int) -> DataFrame:
    """The first n of `width` elements of a vector column."""
    if n == width:
        return df
    return VectorSlicer(inputCol=col, outputCol="_first", indices=list(range(n))).transform(df).drop(col).withColumnRenamed("_first", col)


def _vocabulary(train: DataFrame, s: Setup) -> TF.TfidfModel:
    """The vocabulary of `Blocks`, kept for several of them."""
    model = TF.fit_tfidf(text_terms(train, s), s.key, s.max_n, s.min_df, TF.MAX_DF, s.max_features, unique_docs=not s.part)
    return replace(model, vocab=keep(model.vocab))


def _ablated(train: DataFrame, test: DataFrame, spec: MO.ModelSpec, setup: Setup, fold: int, blocks: Sequence[str], vocabulary: TF.TfidfModel | None = None) -> list[tuple]:
    fitted = Blocks(setup, blocks, train, vocabulary)
    svd_k = min(setup.svd_k, max(1, fitted.n_terms - 1)) if setup.svd_k and "bow" in blocks else setup.svd_k
    cols = ["y_true", *blocks]
    tr, te = keep(fitted.transform(train).select(*cols)), keep(fitted.transform(test).select(*cols))
    label = {"bow": "no_bow", "topics": "no_topics", "mnum": "no_msg_numeric"}

    def score(used):
        clf = MO.fit(spec, assemble_blocks(tr, used).select("y_true", "features"))
        return f1_of(clf.predict(assemble_blocks(te, used)))

    base = score(blocks)
    rows = [(fold, svd_k, label[b], score([x for x in blocks if x != b]) - base) for b in blocks]
    tr.unpersist()
    te.unpersist()
    return rows


def lofo_refit(df: DataFrame, spec: MO.ModelSpec, setup: Setup, fold: int) -> DataFrame:
    """(fold, feature, delta_F1): drop one user column and refit; base and ablations share the fit set."""
    train, test = split_fold(df, fold)
    train, test = keep(train), keep(test)

    def score(cols):
        _, _, pred = refit_score(spec, replace(setup, user_cols=tuple(cols)), ("users",), train, test)
        return f1_of(pred)

    base = score(setup.user_cols)
    rows = [(fold, c, score([x for x in setup.user_cols if x != c]) - base) for c in setup.user_cols]
    train.unpersist()
    test.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, feature string, delta_F1 double")


def scaled_users(df: DataFrame, setup: Setup, train: DataFrame) -> DataFrame:
    """User columns filled and scaled by the training rows, as plain columns for permutation and zeroing."""
    return NU.fit_numeric(train, setup.user_cols, fill=setup.fill).apply(df)


def user_scorer(clf: MO.Classifier, cols: Sequence[str], extra: Sequence[str] = ()):
    """Scorer over plain scaled user columns (plus ready block vectors, in front) for the diagnostics."""
    asm = VectorAssembler(inputCols=[*extra, *cols], outputCol="features", handleInvalid="error")
    return lambda d: clf.predict(asm.transform(d))

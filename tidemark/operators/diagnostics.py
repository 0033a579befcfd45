"""Importance, ablation, saliency, occlusion and stability tables across folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.bounds import broadcast_if_bounded, checked_small
from tidemark.operators.metrics import confusion, macro_from_confusion, macro_scores
from tidemark.operators.splits import DEFAULT_SEED, with_donors

# Repeats, report size, stability thresholds and occlusion breadth.
PERM_REPEATS = 20
TOP_FEATURES = 100
MIN_SELECTED_FRAC = 0.60
MIN_SIGN_CONSISTENCY = 0.80
OCCLUDE_TOPK = 20

#: Adds `y_pred` to a frame that holds the feature columns.
Scorer = Callable[[DataFrame], DataFrame]


# ---- aggregates over per-fold rows -------------------------------------------------------------


def aggregate_importance(rows: DataFrame, key: str = "feature", value: str = "importance") -> DataFrame:
    """Mean and sample deviation over the folds in which the feature occurs; one fold gives 0."""
    return rows.groupBy(key).agg(
        F.avg(value).alias("mean_importance"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_importance"),
        F.count(value).alias("n_folds"),
    )


def aggregate_rows(rows: DataFrame, key: str, val: str, extra_means: Sequence[str] = (), prefix: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample deviation and count by key, plus plain means of extra columns, in one pass."""
    p = prefix or val
    return rows.groupBy(*by, key).agg(
        F.avg(val).alias(f"{p}_mean"),
        F.stddev_samp(val).alias(f"{p}_std"),
        F.count(val).alias("n_folds"),
        *[F.avg(c).alias(c) for c in extra_means],
    )


def aggregate_saliency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster").agg(
        F.avg("saliency").alias("saliency_mean"),
        F.stddev_samp("saliency").alias("saliency_std"),
        F.count("saliency").alias("n_folds"),
        F.sum("saliency").alias("saliency_sum"),
    )


def aggregate_occlusion(rows: DataFrame) -> DataFrame:
    return aggregate_rows(rows, "cluster", "drop_F1")


def stability(rows: DataFrame, k: int = 5, feature: str = "feature", drop: str = "drop") -> DataFrame:
    """How often, how consistently and how strongly a feature matters across folds."""
    pos = F.col(drop) >= 0
    g = rows.groupBy(feature).agg(
        F.count_distinct("fold").alias("n_folds"),
        F.count_distinct(F.when(pos, F.col("fold"))).alias("_p"),
        F.count_distinct(F.when(~pos, F.col("fold"))).alias("_n"),
        F.avg(F.abs(drop)).alias("mean_abs_drop"),
        F.avg(drop).alias("mean_drop"),
    )
    frac = F.col("n_folds") / F.lit(float(k))
    cons = F.coalesce(F.try_divide(F.greatest("_p", "_n").cast("double"), (F.col("_p") + F.col("_n")).cast("double")), F.lit(0.0))
    return g.select(
        feature,
        "n_folds",
        frac.alias("selected_frac"),
        cons.alias("sign_consistency"),
        "mean_abs_drop",
        "mean_drop",
        F.when(F.col("_p") >= F.col("_n"), 1).otherwise(-1).alias("majority_sign"),
        (frac * cons * F.col("mean_abs_drop")).alias("score"),
    )


def stable_only(stable: DataFrame, min_freq: float = MIN_SELECTED_FRAC, min_sign: float = MIN_SIGN_CONSISTENCY, topk: int = 0, feature: str = "feature") -> DataFrame:
    """Features over both thresholds, best score first; `topk` > 0 makes it a top-k report."""
    kept = stable.filter((F.col("selected_frac") >= min_freq) & (F.col("sign_consistency") >= min_sign))
    ordered = kept.orderBy(F.desc("score"), F.desc("selected_frac"), F.desc("mean_abs_drop"), F.asc(feature))
    return ordered.limit(topk) if topk > 0 else ordered


def sweep_summary(rows: DataFrame) -> DataFrame:
    """Dev score by number of components: mean, sample deviation, folds."""
    return rows.groupBy("k").agg(
        F.avg("dev_F1").alias("dev_F1_mean"), F.stddev_samp("dev_F1").alias("dev_F1_std"), F.count("dev_F1").alias("n_folds")
    )


def selected_pairs(sweep: DataFrame, test: DataFrame) -> DataFrame:
    """(fold, k_selected, F1_selected, F1_k0): the best dev k against k = 0 on the test fold.

    The smallest k wins a tie, as the first best does in an ascending sweep. k = 0 is required.
    """
    best = sweep.groupBy("fold").agg(F.max_by("k", F.struct(F.col("dev_F1"), -F.col("k"))).alias("k_selected"))
    per_fold = test.join(best, "fold", "inner").groupBy("fold", "k_selected").agg(
        F.max(F.when(F.col("k") == F.col("k_selected"), F.col("F1"))).alias("F1_selected"),
        F.max(F.when(F.col("k") == 0, F.col("F1"))).alias("F1_k0"),
    )
    return per_fold


def block_means(rows: DataFrame, by: Sequence[str] = ("block",)) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg("delta_F1").alias("delta_F1_mean"))


# ---- permutation importance and zeroing --------------------------------------------------------


def _swap(scored_input: DataFrame, cols: Sequence[str], value_of: Callable[[str], Column]) -> DataFrame:
    """One row per feature, with only that feature's column replaced; expanded inside the task."""
    names = F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature")
    rows = scored_input.select("*", names)
    return rows.withColumns({c: F.when(F.col("feature") == c, value_of(c)).otherwise(F.col(c)) for c in cols})


def permuted_scores(scorer: Scorer, test: DataFrame, cols: Sequence[str], key: Sequence[str], by: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """Macro F1 per (by..., feature, repeat) with that feature permuted inside its group.

    Rows are shuffled once per repeat, not once per feature: each row meets one donor row, the
    features are expanded after the join and folded into confusion counts before the next shuffle.
    Columns the scorer does not read are pruned; hand it a precomputed message score rather than a
    wide text vector when only user columns are permuted.
    """
    spread = test.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    paired = with_donors(spread, cols, key, [seed, F.col("repeat")], within=[*by, "repeat"])
    swapped = _swap(paired, cols, lambda c: F.col(c + "_donor"))
    groups = [*by, "feature", "repeat"]
    return macro_from_confusion(confusion(scorer(swapped), groups), groups)


def permutation_importance(
    scorer: Scorer,
    test: DataFrame,
    cols: Sequence[str],
    key: Sequence[str],
    by: Sequence[str] = ("fold",),
    repeats: int = PERM_REPEATS,
    seed: int = DEFAULT_SEED,
    population_std: bool = False,
) -> DataFrame:
    """(by..., feature, drop_mean, drop_std): fall of macro F1 when a feature is permuted."""
    base = macro_scores(scorer(test), by).select(*by, F.col("F1").alias("base_F1"))
    perm = permuted_scores(scorer, test, cols, key, by, repeats, seed).join(base, list(by), "inner")
    drop = F.col("base_F1") - F.col("F1")
    std = F.stddev_pop(drop) if population_std else F.coalesce(F.stddev_samp(drop), F.lit(0.0))
    return perm.groupBy(*by, "feature").agg(F.avg(drop).alias("drop_mean"), std.alias("drop_std"))


def lofo_zero(scorer: Scorer, test: DataFrame, cols: Sequence[str], by: Sequence[str] = ("fold",)) -> DataFrame:
    """Zero one scaled column at a time: drop_F1 = base - ablated, positive means useful."""
    base = macro_scores(scorer(test), by).select(*by, F.col("F1").alias("base_F1"))
    zeroed = _swap(test, cols, lambda c: F.lit(0.0))
    groups = [*by, "feature"]
    abl = macro_from_confusion(confusion(scorer(zeroed), groups), groups).select(*groups, F.col("F1").alias("abl_F1"))
    return abl.join(base, list(by), "inner").select(
        *groups, (F.col("base_F1") - F.col("abl_F1")).alias("drop_F1"), "base_F1", "abl_F1"
    )


# ---- cluster saliency and occlusion on additive scorers ----------------------------------------


def cluster_contributions(tokens: DataFrame, cmap: DataFrame, doc: Sequence[str], cmap_max_rows: int | None = None) -> DataFrame:
    """(doc..., cluster, contrib, saliency) from (doc..., token, contrib); unmapped cluster is null.

    Saliency adds absolute contributions, contrib keeps the sign.
    """
    side = broadcast_if_bounded(cmap.select(F.col("token").alias("_t"), "cluster"), cmap_max_rows)
    return (
        tokens.join(side, F.col("token") == F.col("_t"), "left")
        .groupBy(*doc, "cluster")
        .agg(F.sum("contrib").alias("contrib"), F.sum(F.abs("contrib")).alias("saliency"))
    )


def cluster_saliency(contributions: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Total absolute contribution of each cluster per fold."""
    return contributions.filter(F.col("cluster").isNotNull()).groupBy(*by, "cluster").agg(F.sum("saliency").alias("saliency"))


def cluster_occlusion(
    docs: DataFrame,
    contributions: DataFrame,
    doc: str,
    by: Sequence[str] = ("fold",),
    topk: int = OCCLUDE_TOPK,
    threshold: float = 0.0,
    intercept: float = 0.0,
) -> DataFrame:
    """(by..., cluster, drop_F1): fall of macro F1 when a cluster's tokens are removed.

    Only documents that contain a cluster can change, so the base confusion is corrected by those
    documents instead of rescoring every document for every cluster. `docs` holds (by..., doc,
    y_true); a document without any token scores the intercept.
    """
    by = list(by)
    sal = cluster_saliency(contributions, by)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("saliency"), F.asc("cluster")))
    tested = checked_small(sal.withColumn("_rk", rank).filter(F.col("_rk") <= topk).select(*by, "cluster"))

    score = contributions.groupBy(*by, doc).agg(F.sum("contrib").alias("_s"))
    scored = docs.select(*by, doc, "y_true").join(score, [*by, doc], "left")
    total = F.coalesce("_s", F.lit(0.0)) + F.lit(float(intercept))
    scored = scored.select(*by, doc, "y_true", total.alias("_s"))
    predicted = scored.withColumn("y_pred", (F.col("_s") > threshold).cast("int"))
    base_conf = confusion(predicted, by)

    part = contributions.filter(F.col("cluster").isNotNull()).join(tested, [*by, "cluster"], "inner")
    touched = part.select(*by, doc, "cluster", "contrib").join(predicted, [*by, doc], "inner")
    after = (F.col("_s") - F.col("contrib") > threshold).cast("int")
    moves = F.array(
        F.struct(F.col("y_pred").alias("p"), F.lit(-1).alias("c")), F.struct(after.alias("p"), F.lit(1).alias("c"))
    )
    # Documents whose prediction stays cancel out at once.
    delta = (
        touched.filter(after != F.col("y_pred"))
        .select(*by, "cluster", F.col("y_true").cast("int").alias("t"), F.explode(moves).alias("m"))
        .select(*by, "cluster", "t", "m.p", F.col("m.c").cast("long").alias("c"))
    )
    start = tested.join(base_conf, by, "inner").select(*by, "cluster", "t", "p", "c")
    conf = start.unionByName(delta).groupBy(*by, "cluster", "t", "p").agg(F.sum("c").alias("c")).filter(F.col("c") > 0)
    base = macro_from_confusion(base_conf, by).select(*by, F.col("F1").alias("base_F1"))
    occl = macro_from_confusion(conf, [*by, "cluster"]).join(base, by, "inner")
    return occl.select(*by, "cluster", (F.col("base_F1") - F.col("F1")).alias("drop_F1"), "base_F1")


# ---- paired signed-rank test -------------------------------------------------------------------

#: Untied pairs up to which the required statistics library takes the exact distribution.
EXACT_LIMIT = 50


def _exact_p(n: int, w: float) -> float:
    """Two-sided exact p of the smaller rank sum for n untied pairs."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[: len(ways) - r]
    return float(min(1.0, 2.0 * ways[: int(np.floor(w)) + 1].sum() / 2.0**n))


def _normal_p(n: int, w: float, ties: float) -> float:
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    if var <= 0:
        return 1.0
    from math import erfc, sqrt

    return float(min(1.0, erfc(abs(w - mean) / sqrt(2.0 * var))))


def wilcoxon_signed_rank(pairs: DataFrame, a: str, b: str, by: Sequence[str] = (), with_p: bool = True, exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """(by..., n, w_plus, w_minus, W, p, p_method): zero differences dropped, tied ranks averaged, two-sided.

    W and p are null when no pair differs. Pairs are first counted by absolute difference, so the
    ranking runs over distinct values. p is exact up to `exact_limit` untied pairs, normal
    otherwise, as p_method says.
    """
    by = list(by)
    keys = by or ["_all"]
    d = pairs if by else pairs.withColumn("_all", F.lit(0))
    d = d.select(*keys, (F.col(a) - F.col(b)).alias("d")).filter(F.col("d").isNotNull())
    sizes = d.groupBy(*keys, F.abs("d").alias("m")).agg(
        F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down")
    )
    t = F.col("up") + F.col("down")
    upto = W.partitionBy(*keys).orderBy("m").rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("t", t).withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))
    mid = F.col("before") + (F.col("t") + 1) / 2.0
    stats = ranked.groupBy(*keys).agg(
        F.sum("t").alias("n"),
        F.sum(mid * F.col("up")).alias("w_plus"),
        F.sum(mid * F.col("down")).alias("w_minus"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"),
    )
    some = F.col("n") > 0
    out = stats.withColumn("W", F.when(some, F.least("w_plus", "w_minus")))
    if with_p:

        @F.pandas_udf("double")
        def p_value(n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
            def one(n_, w_, t_):
                if n_ == 0 or pd.isna(w_):
                    return None
                exact = n_ <= exact_limit and t_ == 0
                return _exact_p(int(n_), float(w_)) if exact else _normal_p(int(n_), float(w_), float(t_))

            return pd.Series([one(*x) for x in zip(n, w, ties)], dtype="float64")

        exact = (F.col("n") <= exact_limit) & (F.col("ties") == 0)
        method = F.when(some, F.when(exact, F.lit("exact")).otherwise(F.lit("normal")))
        out = out.withColumn("p", p_value("n", "W", "ties")).withColumn("p_method", method)
    return out.drop("ties", *([] if by else ["_all"]))

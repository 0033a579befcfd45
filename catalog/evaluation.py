"""Metric, importance, stability, occlusion and paired-test queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from catalog.behaviour import rounded
from catalog.folds import FOLD_SQL, encoded
from catalog.payloads import LABELED_SQL
from catalog.texts import ALL_CMAP_SQL, DOCS_SQL, VOCAB_SQL
from tidemark.functions.arrays import explode_rows
from tidemark.functions.text import normalize_tokens
from tidemark.operators import diagnostics as D
from tidemark.operators import grams as GR
from tidemark.operators import metrics as M
from tidemark.operators import splits as SP
from tidemark.operators.ranking import top_features as top_features_of
from tidemark.plans import views as V

REPEATS = 20
KS = (0, 300, 500, 800)


def folded(spark, sf):
    return SP.stratified_folds(encoded(spark, sf), key="doc_id")


def predictions(spark, sf):
    """Three fixed classifiers as families: by length, by toxicity, by either."""
    f = folded(spark, sf)
    long, bad = F.col("n_chars") > 1000, F.col("toxic") == 1
    calls = F.array(
        F.struct(F.lit("Users").alias("family"), long.cast("int").alias("y_pred")),
        F.struct(F.lit("Message").alias("family"), bad.cast("int").alias("y_pred")),
        F.struct(F.lit("Fusion").alias("family"), (long & ~bad).cast("int").alias("y_pred")),
    )
    return f.select("fold", "doc_id", F.col("label").alias("y_true"), F.explode(calls).alias("e")).select(
        "fold", "doc_id", "y_true", "e.*"
    )


def macro_scores(spark, sf):
    return rounded(M.macro_scores(predictions(spark, sf), ["fold", "family"]))


def classification_report(spark, sf):
    return rounded(M.classification_report(predictions(spark, sf), ["family"]))


def _summary(spark, sf):
    return M.cv_summary(M.macro_scores(predictions(spark, sf), ["fold", "family"]))


def cv_summary(spark, sf):
    return rounded(_summary(spark, sf))


def cv_summary_formatted(spark, sf):
    return M.cv_summary_formatted(rounded(_summary(spark, sf), 9))


def _drops(spark, sf):
    """Per fold and source: how far the unreliable share is from one in seven."""
    f = folded(spark, sf)
    g = f.groupBy("fold", F.concat(F.lit("user:"), "source").alias("feature"))
    return g.agg(
        F.round(F.avg("label") - F.lit(1.0) / F.lit(7.0), 9).alias("drop"),
        F.avg("toxic").alias("base_F1"),
        F.avg("word_len").alias("importance"),
    )


def aggregate_importance(spark, sf):
    return rounded(D.aggregate_importance(_drops(spark, sf)))


def aggregate_rows(spark, sf):
    return rounded(D.aggregate_rows(_drops(spark, sf), "feature", "drop", extra_means=["base_F1"]))


def stability(spark, sf):
    return rounded(D.stability(_drops(spark, sf)))


def stability_filtered(spark, sf):
    return rounded(D.stable_only(D.stability(_drops(spark, sf))))


def top_features(spark, sf):
    imp = _drops(spark, sf).withColumn("importance", F.round("importance", 6)).select("fold", "feature", "importance")
    return top_features_of(imp, "importance", 5)


def _linear(df):
    """A fixed linear form over the five numerics as scorer."""
    z = (
        F.col("n_chars") * 0.001 - F.col("n_words") * 0.004 + F.col("word_len") * 0.5 - F.col("n_lines") * 0.05
        + F.col("toxic") * 0.5 - 3.2
    )
    return df.withColumn("y_pred", (z > 0).cast("int"))


def _scored_input(spark, sf):
    return folded(spark, sf).select("doc_id", "fold", F.col("label").alias("y_true"), *V.NUMERIC)


def permutation_importance_fixed(spark, sf):
    t = _scored_input(spark, sf)
    return rounded(D.permutation_importance(_linear, t, V.NUMERIC, ["doc_id"], repeats=REPEATS))


def permutation_importance_single(spark, sf):
    """One repeat, as used for message numerics and topics."""
    t = _scored_input(spark, sf)
    out = D.permutation_importance(_linear, t, V.NUMERIC[1:4], ["doc_id"], repeats=1, population_std=True)
    return rounded(out)


def lofo_zero_fixed(spark, sf):
    return rounded(D.lofo_zero(_linear, _scored_input(spark, sf), V.NUMERIC))


def _contributions(spark, sf):
    f = folded(spark, sf).select("fold", "doc_id", normalize_tokens(F.col("aggr_text")).alias("tokens"))
    # Counted inside the row; only the join with the cluster map moves rows.
    counts = explode_rows(f, ["fold", "doc_id"], GR.term_counts(F.col("tokens"), 1), "e")
    tf = counts.select("fold", "doc_id", F.col("e.term").alias("token"), F.col("e.n").alias("tf"))
    weight = (F.ascii("token") * 7 + F.length("token")) % 11 - 5
    rows = tf.select("fold", "doc_id", "token", (F.col("tf") * weight).cast("double").alias("contrib"))
    out = D.cluster_contributions(rows, V.token_clusters(spark, sf), ["fold", "doc_id"])
    # At most one row per document and cluster, read by several branches.
    return out.persist(StorageLevel.MEMORY_AND_DISK)


def cluster_saliency_agg(spark, sf):
    return rounded(D.aggregate_saliency(D.cluster_saliency(_contributions(spark, sf))))


def cluster_occlusion_fixed(spark, sf):
    docs = folded(spark, sf).select("fold", "doc_id", F.col("label").alias("y_true"))
    return rounded(D.cluster_occlusion(docs, _contributions(spark, sf), "doc_id"))


def cluster_occlusion_agg(spark, sf):
    docs = folded(spark, sf).select("fold", "doc_id", F.col("label").alias("y_true"))
    return rounded(D.aggregate_occlusion(D.cluster_occlusion(docs, _contributions(spark, sf), "doc_id")))


def _sweep(spark, sf):
    """Macro F1 per fold and k: predict positive above k characters; dev looks at words instead."""
    f = folded(spark, sf)
    ks = F.explode(F.array(*[F.lit(k) for k in KS])).alias("k")
    t = f.select("fold", F.col("label").alias("y_true"), "n_chars", "n_words", ks)
    test = M.macro_scores(t.withColumn("y_pred", (F.col("n_chars") > F.col("k")).cast("int")), ["fold", "k"])
    dev = M.macro_scores(t.withColumn("y_pred", (F.col("n_words") > F.col("k")).cast("int")), ["fold", "k"])
    return dev.select("fold", "k", F.round("F1", 9).alias("dev_F1")), test.select("fold", "k", F.round("F1", 9).alias("F1"))


def sweep_summary(spark, sf):
    return rounded(D.sweep_summary(_sweep(spark, sf)[0]))


def selected_pairs(spark, sf):
    return rounded(D.selected_pairs(*_sweep(spark, sf)))


def block_means(spark, sf):
    """Families stand for ablated blocks: F1 of the ablation minus F1 of the full model."""
    m = M.macro_scores(predictions(spark, sf), ["fold", "family"])
    base = m.filter(F.col("family") == "Fusion").select("fold", F.col("F1").alias("base"))
    rows = m.filter(F.col("family") != "Fusion").join(base, "fold").select(
        "fold",
        F.when(F.col("family") == "Users", "no_bow").otherwise("no_topics").alias("block"),
        (F.col("F1") - F.col("base")).alias("delta_F1"),
    )
    return rounded(D.block_means(rows))


def wilcoxon_w(spark, sf):
    """Signed ranks of words against a constant by language: many ties and some zero differences."""
    u = V.labeled_users(spark, sf).select("lang", "n_lines", F.lit(4.0).alias("other"))
    return rounded(D.wilcoxon_signed_rank(u, "n_lines", "other", ["lang"], with_p=False))


QUERIES = {
    f.__name__: f
    for f in (
        macro_scores, classification_report, cv_summary, cv_summary_formatted, aggregate_importance, aggregate_rows,
        stability, stability_filtered, top_features, permutation_importance_fixed, permutation_importance_single,
        lofo_zero_fixed, cluster_saliency_agg, cluster_occlusion_fixed, cluster_occlusion_agg, sweep_summary,
        selected_pairs, block_means, wilcoxon_w,
    )
}


def _scores(src: str, by: str, name: str = "sc") -> str:
    """Per-class and macro scores of table `src` (by..., y, p), with the class union spelled out."""
    keys = by.replace(" ", "").split(",")
    on = " AND ".join(f"c.{k} = s.{k}" for k in keys)
    cby = ", ".join(f"c.{k}" for k in keys)
    return f"""
    {name}_cls AS (SELECT DISTINCT {by}, y AS cls FROM {src} UNION SELECT DISTINCT {by}, p FROM {src}),
    {name}_pc AS (
      SELECT {cby}, cls, count(*) FILTER (WHERE y = cls AND p = cls) AS tp, count(*) FILTER (WHERE y <> cls AND p = cls) AS fp,
             count(*) FILTER (WHERE y = cls AND p <> cls) AS fn
      FROM {name}_cls c JOIN {src} s ON {on} GROUP BY {cby}, cls),
    {name}_prf AS (
      SELECT {by}, cls, tp, fp, fn, tp + fn AS support, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS "P",
             coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS "R",
             coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS "F1" FROM {name}_pc),
    {name} AS (SELECT {by}, avg("P") AS "P", avg("R") AS "R", avg("F1") AS "F1" FROM {name}_prf GROUP BY {by})
    """


PRED_SQL = f"""{LABELED_SQL}, {FOLD_SQL},
pred AS (
  SELECT fold, doc_id, 'Users' AS family, y, (n_chars > 1000)::INT AS p FROM folds
  UNION ALL SELECT fold, doc_id, 'Message', y, (toxic = 1)::INT FROM folds
  UNION ALL SELECT fold, doc_id, 'Fusion', y, (n_chars > 1000 AND toxic <> 1)::INT FROM folds)
"""
_SUM = """s AS (SELECT family, avg("P") AS pm, stddev_samp("P") AS ps, avg("R") AS rm, stddev_samp("R") AS rs,
          avg("F1") AS fm, stddev_samp("F1") AS fs, count(DISTINCT fold) AS n FROM sc GROUP BY family)"""
DROPS_SQL = f"""{LABELED_SQL}, {FOLD_SQL},
drops AS (SELECT fold, 'user:' || source AS feature, round(avg(y) - 1.0::DOUBLE / 7.0::DOUBLE, 9) AS d, avg(toxic) AS base_F1, avg(word_len) AS imp
          FROM folds GROUP BY fold, source)
"""
STAB_SQL = """st AS (
  SELECT feature, count(DISTINCT fold) AS n_folds, count(DISTINCT fold) / 5.0::DOUBLE AS sf,
         CAST(greatest(count(DISTINCT fold) FILTER (WHERE d >= 0), count(DISTINCT fold) FILTER (WHERE d < 0)) AS DOUBLE) / count(DISTINCT fold) AS sc,
         avg(abs(d)) AS mad, avg(d) AS md,
         CASE WHEN count(DISTINCT fold) FILTER (WHERE d >= 0) >= count(DISTINCT fold) FILTER (WHERE d < 0) THEN 1 ELSE -1 END AS ms
  FROM drops GROUP BY feature)"""
STAB_SELECT = """SELECT feature, n_folds, round(sf, 6) AS selected_frac, round(sc, 6) AS sign_consistency, round(mad, 6) AS mean_abs_drop,
  round(md, 6) AS mean_drop, ms AS majority_sign, round(sf * sc * mad, 6) AS score FROM st"""


def _z(**over):
    c = {k: over.get(k, k) for k in V.NUMERIC}
    return (
        f"({c['n_chars']} * 0.001::DOUBLE - {c['n_words']} * 0.004::DOUBLE + {c['word_len']} * 0.5::DOUBLE"
        f" - {c['n_lines']} * 0.05::DOUBLE + {c['toxic']} * 0.5::DOUBLE - 3.2::DOUBLE > 0)::INT"
    )


def _perm_sql(cols, repeats, std):
    variants = " UNION ALL ".join(
        f"SELECT a.fold, '{c}' AS feature, a.rep, a.y, {_z(**{k: ('b.' if k == c else 'a.') + k for k in V.NUMERIC})} AS p "
        "FROM pa a JOIN pb b ON a.fold = b.fold AND a.rep = b.rep AND a.pos = b.pos"
        for c in cols
    )
    return f"""
    WITH {LABELED_SQL}, {FOLD_SQL}, reps AS (SELECT unnest(range(1, {repeats + 1})) AS rep),
    pa AS (SELECT *, row_number() OVER (PARTITION BY fold, rep ORDER BY md5('555:' || rep || ':row:' || doc_id), doc_id) AS pos FROM folds, reps),
    pb AS (SELECT *, row_number() OVER (PARTITION BY fold, rep ORDER BY md5('555:' || rep || ':donor:' || doc_id), doc_id) AS pos FROM folds, reps),
    base AS (SELECT fold, y, {_z()} AS p FROM folds), perm AS ({variants}),
    {_scores('base', 'fold', 'sb')}, {_scores('perm', 'fold, feature, rep', 'sp')}
    SELECT CAST(fold AS INTEGER) AS fold, feature, round(avg(sb."F1" - sp."F1"), 6) AS drop_mean, round(coalesce({std}(sb."F1" - sp."F1"), 0), 6) AS drop_std
    FROM sp JOIN sb USING (fold) GROUP BY fold, feature"""


def _zero_sql():
    variants = " UNION ALL ".join(f"SELECT fold, '{c}' AS feature, y, {_z(**{c: '0.0'})} AS p FROM folds" for c in V.NUMERIC)
    return f"""
    WITH {LABELED_SQL}, {FOLD_SQL}, base AS (SELECT fold, y, {_z()} AS p FROM folds), abl AS ({variants}),
    {_scores('base', 'fold', 'sb')}, {_scores('abl', 'fold, feature', 'sa')}
    SELECT CAST(fold AS INTEGER) AS fold, feature, round(sb."F1" - sa."F1", 6) AS "drop_F1", round(sb."F1", 6) AS "base_F1", round(sa."F1", 6) AS "abl_F1"
    FROM sa JOIN sb USING (fold)"""


CONTRIB_SQL = f"""{DOCS_SQL}, {VOCAB_SQL}, {ALL_CMAP_SQL}, {LABELED_SQL}, {FOLD_SQL},
tok AS (SELECT fold, docs.doc_id, unnest(toks) AS w FROM docs JOIN folds ON docs.doc_id = folds.doc_id),
con AS (SELECT fold, doc_id, cluster, CAST(((ascii(w) * 7 + length(w)) % 11 - 5) AS DOUBLE) AS c FROM tok LEFT JOIN cmap ON w = token),
sal AS (SELECT fold, cluster, sum(abs(c)) AS saliency FROM con WHERE cluster IS NOT NULL GROUP BY fold, cluster)
"""
OCC_SQL = f"""{CONTRIB_SQL},
tested AS (SELECT fold, cluster FROM sal QUALIFY row_number() OVER (PARTITION BY fold ORDER BY saliency DESC, cluster) <= {D.OCCLUDE_TOPK}),
base AS (SELECT f.fold, f.y, (coalesce(sum(c), 0) > 0)::INT AS p FROM folds f LEFT JOIN con ON f.fold = con.fold AND f.doc_id = con.doc_id GROUP BY f.fold, f.doc_id, f.y),
occ AS (SELECT t.fold, t.cluster, f.y, (coalesce(sum(c) FILTER (WHERE con.cluster IS DISTINCT FROM t.cluster), 0) > 0)::INT AS p
        FROM tested t JOIN folds f ON t.fold = f.fold LEFT JOIN con ON f.fold = con.fold AND f.doc_id = con.doc_id
        GROUP BY t.fold, t.cluster, f.doc_id, f.y),
{_scores('base', 'fold', 'sb')}, {_scores('occ', 'fold, cluster', 'so')},
drops AS (SELECT fold, cluster, sb."F1" - so."F1" AS d, sb."F1" AS b FROM so JOIN sb USING (fold))
"""
SWEEP_SQL = f"""{LABELED_SQL}, {FOLD_SQL}, ks AS (SELECT unnest({list(KS)}) AS k),
ptest AS (SELECT fold, k, y, (n_chars > k)::INT AS p FROM folds, ks), pdev AS (SELECT fold, k, y, (n_words > k)::INT AS p FROM folds, ks),
{_scores('ptest', 'fold, k', 'st')}, {_scores('pdev', 'fold, k', 'sd')}
"""

SQL = {
    "macro_scores": f"""WITH {PRED_SQL}, {_scores('pred', 'fold, family')}
        SELECT CAST(fold AS INTEGER) AS fold, family, round("P", 6) AS "P", round("R", 6) AS "R", round("F1", 6) AS "F1" FROM sc""",
    "classification_report": f"""WITH {PRED_SQL}, {_scores('pred', 'family')}
        SELECT family, CAST(cls AS VARCHAR) AS "row", round("P", 6) AS "P", round("R", 6) AS "R", round("F1", 6) AS "F1", support FROM sc_prf
        UNION ALL SELECT family, 'accuracy', NULL, NULL, round(avg((y = p)::INT), 6), count(*) FROM pred GROUP BY family
        UNION ALL SELECT family, 'macro avg', round(avg("P"), 6), round(avg("R"), 6), round(avg("F1"), 6), CAST(sum(support) AS BIGINT) FROM sc_prf GROUP BY family
        UNION ALL SELECT family, 'weighted avg', round(sum("P" * support) / sum(support), 6), round(sum("R" * support) / sum(support), 6),
                         round(sum("F1" * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM sc_prf GROUP BY family""",
    "cv_summary": f"""WITH {PRED_SQL}, {_scores('pred', 'fold, family')}, {_SUM}
        SELECT family, round(pm, 6) AS "P_mean", round(ps, 6) AS "P_std", round(rm, 6) AS "R_mean", round(rs, 6) AS "R_std",
               round(fm, 6) AS "F1_mean", round(fs, 6) AS "F1_std", n AS n_folds FROM s""",
    "cv_summary_formatted": f"""WITH {PRED_SQL}, {_scores('pred', 'fold, family')}, {_SUM}
        SELECT family, n AS n_folds, printf('%.1f%% ± %.3f', round(pm, 9) * 100, round(ps, 9)) AS "P",
               printf('%.1f%% ± %.3f', round(rm, 9) * 100, round(rs, 9)) AS "R", printf('%.1f%% ± %.3f', round(fm, 9) * 100, round(fs, 9)) AS "F1" FROM s""",
    "aggregate_importance": f"""WITH {DROPS_SQL} SELECT feature, round(avg(imp), 6) AS mean_importance,
        round(coalesce(stddev_samp(imp), 0), 6) AS std_importance, count(*) AS n_folds FROM drops GROUP BY feature""",
    "aggregate_rows": f"""WITH {DROPS_SQL} SELECT feature, round(avg(d), 6) AS drop_mean, round(stddev_samp(d), 6) AS drop_std, count(*) AS n_folds,
        round(avg(base_F1), 6) AS "base_F1" FROM drops GROUP BY feature""",
    "stability": f"WITH {DROPS_SQL}, {STAB_SQL} {STAB_SELECT}",
    "stability_filtered": f"WITH {DROPS_SQL}, {STAB_SQL} {STAB_SELECT} WHERE sf >= 0.60 AND sc >= 0.80",
    "top_features": f"""WITH {DROPS_SQL}, r AS (SELECT fold, feature, round(imp, 6) AS importance FROM drops)
        SELECT CAST(fold AS INTEGER) AS fold, feature, importance, CAST(row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS INTEGER) AS rank FROM r
        QUALIFY rank <= 5""",
    "permutation_importance_fixed": _perm_sql(V.NUMERIC, REPEATS, "stddev_samp"),
    "permutation_importance_single": _perm_sql(V.NUMERIC[1:4], 1, "stddev_pop"),
    "lofo_zero_fixed": _zero_sql(),
    "cluster_saliency_agg": f"""WITH {CONTRIB_SQL} SELECT CAST(cluster AS INTEGER) AS cluster, round(avg(saliency), 6) AS saliency_mean,
        round(stddev_samp(saliency), 6) AS saliency_std, count(*) AS n_folds, round(sum(saliency), 6) AS saliency_sum FROM sal GROUP BY cluster""",
    "cluster_occlusion_fixed": f"""WITH {OCC_SQL} SELECT CAST(fold AS INTEGER) AS fold, CAST(cluster AS INTEGER) AS cluster, round(d, 6) AS "drop_F1", round(b, 6) AS "base_F1" FROM drops""",
    "cluster_occlusion_agg": f"""WITH {OCC_SQL} SELECT CAST(cluster AS INTEGER) AS cluster, round(avg(d), 6) AS "drop_F1_mean",
        round(stddev_samp(d), 6) AS "drop_F1_std", count(*) AS n_folds FROM drops GROUP BY cluster""",
    "sweep_summary": f"""WITH {SWEEP_SQL} SELECT k, round(avg(round("F1", 9)), 6) AS "dev_F1_mean", round(stddev_samp(round("F1", 9)), 6) AS "dev_F1_std", count(*) AS n_folds
        FROM sd GROUP BY k""",
    "selected_pairs": f"""WITH {SWEEP_SQL},
        best AS (SELECT fold, k FROM sd QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round("F1", 9) DESC, k) = 1)
        SELECT CAST(best.fold AS INTEGER) AS fold, best.k AS k_selected, round(a."F1", 6) AS "F1_selected", round(z."F1", 6) AS "F1_k0"
        FROM best JOIN st a ON a.fold = best.fold AND a.k = best.k JOIN st z ON z.fold = best.fold AND z.k = 0""",
    "block_means": f"""WITH {PRED_SQL}, {_scores('pred', 'fold, family')}
        SELECT CASE a.family WHEN 'Users' THEN 'no_bow' ELSE 'no_topics' END AS block, round(avg(a."F1" - b."F1"), 6) AS "delta_F1_mean"
        FROM sc a JOIN sc b ON a.fold = b.fold AND b.family = 'Fusion' WHERE a.family <> 'Fusion' GROUP BY 1""",
    "wilcoxon_w": f"""WITH {LABELED_SQL}, x AS (SELECT lang, n_lines - 4.0::DOUBLE AS d FROM lab),
        r AS (SELECT lang, d, rank() OVER (PARTITION BY lang ORDER BY abs(d)) + (count(*) OVER (PARTITION BY lang, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM x WHERE d <> 0)
        SELECT lang, count(*) AS n, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (WHERE d < 0), 0) AS w_minus,
               least(coalesce(sum(rk) FILTER (WHERE d > 0), 0), coalesce(sum(rk) FILTER (WHERE d < 0), 0)) AS "W" FROM r GROUP BY lang""",
}

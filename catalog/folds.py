"""Split, imputing and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.behaviour import rounded
from catalog.payloads import LABELED_SQL
from tidemark.operators import columns as C
from tidemark.operators import numeric as NU
from tidemark.operators import splits as SP
from tidemark.plans import views as V

COLS = ("n_chars", "n_words", "word_len", "n_lines")


def encoded(spark, sf):
    return C.encode_label(V.labeled_users(spark, sf))


def _gappy(spark, sf):
    """Numerics with gaps: a value is missing where the key hits its column number modulo 7."""
    u = V.labeled_users(spark, sf)
    holes = {c: F.when(F.col("doc_id") % 7 != i, F.col(c)) for i, c in enumerate(COLS)}
    return u.select("doc_id", *[e.alias(c) for c, e in holes.items()])


def stratified_folds(spark, sf):
    return SP.stratified_folds(encoded(spark, sf), key="doc_id").select("doc_id", "label", "fold")


def stratified_holdout(spark, sf):
    return SP.stratified_holdout(encoded(spark, sf), key="doc_id").select("doc_id", "label", "is_dev")


def permute_column(spark, sf):
    u = encoded(spark, sf).select("doc_id", "label", "n_chars")
    return SP.permute_column(u, "n_chars", ["doc_id"], ["label"])


def median_impute(spark, sf):
    g = _gappy(spark, sf)
    return rounded(NU.fit_median_imputer(g, COLS).apply(g))


def order_medians(spark, sf):
    """Exact medians over the larger tables, with many ties in one column."""
    li = V.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    t = NU.median_table(li, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])
    return rounded(t)


def standardize(spark, sf):
    g = _gappy(spark, sf)
    return rounded(NU.fit_numeric(g, COLS).apply(g))


def zero_fill_scale(spark, sf):
    g = _gappy(spark, sf)
    return rounded(NU.fit_numeric(g, COLS, fill="zero").apply(g))


def log1p_features(spark, sf):
    u = V.labeled_users(spark, sf).select("doc_id", "n_chars", (F.col("word_len") - 6).alias("word_len"))
    return rounded(NU.log1p_columns(u, ["n_chars", "word_len"]))


QUERIES = {
    f.__name__: f
    for f in (
        stratified_folds, stratified_holdout, permute_column, median_impute, order_medians, standardize, zero_fill_scale,
        log1p_features,
    )
}

FOLD_SQL = """
folds AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5('555:' || doc_id), doc_id) - 1) % 5 + 1 AS fold FROM lab)
"""
_GAPPY = "g AS (SELECT doc_id, " + ", ".join(f"CASE WHEN doc_id % 7 <> {i} THEN {c} END AS {c}" for i, c in enumerate(COLS)) + " FROM lab)"
_MED = "m AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in COLS) + " FROM g)"
_FILL = "f AS (SELECT doc_id, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in COLS) + " FROM g, m)"
_ZERO = "f AS (SELECT doc_id, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in COLS) + " FROM g)"
_STAT = "s AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS d_{c}" for c in COLS) + " FROM f)"
_Z = "SELECT doc_id, " + ", ".join(f"round(({c} - a_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END, 6) AS {c}" for c in COLS) + " FROM f, s"

SQL = {
    "stratified_folds": f"WITH {LABELED_SQL}, {FOLD_SQL} SELECT doc_id, y AS label, CAST(fold AS INTEGER) AS fold FROM folds",
    "stratified_holdout": f"""WITH {LABELED_SQL}
        SELECT doc_id, y AS label, row_number() OVER (PARTITION BY y ORDER BY md5('555:dev:' || doc_id), doc_id)
               <= round(0.125 * count(*) OVER (PARTITION BY y)) AS is_dev FROM lab""",
    "permute_column": f"""WITH {LABELED_SQL},
        a AS (SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('555:row:' || doc_id), doc_id) AS p FROM lab),
        b AS (SELECT n_chars, y, row_number() OVER (PARTITION BY y ORDER BY md5('555:donor:' || doc_id), doc_id) AS p FROM lab)
        SELECT a.doc_id, a.y AS label, b.n_chars FROM a JOIN b ON a.y = b.y AND a.p = b.p""",
    "median_impute": f"WITH {LABELED_SQL}, {_GAPPY}, {_MED}, {_FILL} SELECT doc_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in COLS) + " FROM f",
    "order_medians": " UNION ALL ".join(
        f"SELECT l_returnflag, {i} AS cid, round(median({c}), 6) AS median FROM lineitem GROUP BY l_returnflag"
        for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount"))
    ),
    "standardize": f"WITH {LABELED_SQL}, {_GAPPY}, {_MED}, {_FILL}, {_STAT} {_Z}",
    "zero_fill_scale": f"WITH {LABELED_SQL}, {_GAPPY}, {_ZERO}, {_STAT} {_Z}",
    "log1p_features": f"""WITH {LABELED_SQL} SELECT doc_id, round(ln(1 + greatest(n_chars, 0)), 6) AS n_chars,
        round(ln(1 + greatest(word_len - 6, 0)), 6) AS word_len FROM lab""",
}

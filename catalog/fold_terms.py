"""Terms by fold, and histories in several text parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.behaviour import rounded
from catalog.evaluation import folded
from catalog.folds import FOLD_SQL
from catalog.payloads import LABELED_SQL
from catalog.texts import LONG_SQL, _clean_sql
from tidemark.functions.text import ENGLISH_STOPWORDS, normalize_tokens
from tidemark.operators import parts as PT
from tidemark.operators import tfidf as TF
from tidemark.operators import timeline as TL
from tidemark.plans import views as V

MIN_DF, PART_POSTS, GRAMS = 5, 20, 2


def _docs(spark, sf):
    tokens = normalize_tokens(F.col("aggr_text"))
    return TF.with_terms(folded(spark, sf).select("doc_id", "fold", tokens.alias("tokens")), 1)


def fold_vocabularies(spark, sf):
    """The vocabulary of every fold's training rows, from one pass."""
    fitted = TF.fit_tfidf_folds(_docs(spark, sf), "doc_id", min_df=MIN_DF)
    return rounded(fitted.vocab.select("fold", "term", "idx", "df", "cf", "idf"))


def tfidf_folds(spark, sf):
    """Every document weighted by the vocabulary that hasn't seen its fold."""
    docs = _docs(spark, sf)
    weights = TF.fit_tfidf_folds(docs, "doc_id", min_df=MIN_DF).held_out(docs, "doc_id", unique_docs=True)
    return rounded(weights.select("fold", "doc_id", "term", "tf", "weight"))


def _parts(spark, sf):
    """Histories in parts of 20 posts, so that most users have several."""
    text = TL.aggregate_text(V.posts(spark, sf), max_posts=PART_POSTS)
    label = (F.col("user") % 2).cast("int")
    return text.select("user", "part", label.alias("label"), normalize_tokens(F.col("aggr_text")).alias("tokens"))


def part_folds(spark, sf):
    """Folds of users whose history has several parts."""
    return PT.user_folds(_parts(spark, sf)).select("user", "part", "label", "fold")


def part_tfidf(spark, sf):
    """Bigram weights of whole histories, counted over the borders of their parts."""
    docs = PT.with_part_terms(_parts(spark, sf), GRAMS)
    model = TF.fit_tfidf(docs, "user", GRAMS, MIN_DF, 0.9, unique_docs=False)
    return rounded(model.long(docs, "user").select("user", "term", "tf", "weight"))


QUERIES = {f.__name__: f for f in (fold_vocabularies, tfidf_folds, part_folds, part_tfidf)}

_TRAIN_SQL = f"""
{LABELED_SQL}, {FOLD_SQL},
docs AS (SELECT doc_id, fold, {_clean_sql("text", ENGLISH_STOPWORDS)} AS toks FROM folds),
tf AS (SELECT doc_id, fold, w AS term, count(*) AS tf FROM (SELECT doc_id, fold, unnest(toks) AS w FROM docs) WHERE length(w) >= 2 GROUP BY ALL),
held AS (SELECT unnest([1, 2, 3, 4, 5]) AS out),
n AS (SELECT out, count(*) AS n FROM held, docs WHERE fold <> out GROUP BY out),
v AS (SELECT out, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM held, tf WHERE fold <> out GROUP BY out, term),
kept AS (
  SELECT out, term, df, cf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM v JOIN n USING (out)
  WHERE df >= {MIN_DF} AND df <= 0.4::DOUBLE * n
  QUALIFY row_number() OVER (PARTITION BY out ORDER BY cf DESC, term) <= {TF.MAX_FEATURES})
"""
_HISTORY_SQL = """
posts AS (
  SELECT user_id AS "user", event_id AS id, ts, event_type || ' ' || coalesce(json_extract_string(props, '$.k'), '') AS text FROM events),
hist AS (SELECT "user", string_agg(trim(text), ' ' ORDER BY ts, id) AS text FROM posts GROUP BY "user")
"""

SQL = {
    "fold_vocabularies": f"""WITH {_TRAIN_SQL}
        SELECT CAST(out AS INTEGER) AS fold, term, CAST(row_number() OVER (PARTITION BY out ORDER BY term) - 1 AS INTEGER) AS idx,
               df, cf, round(idf, 6) AS idf FROM kept""",
    "tfidf_folds": f"""WITH {_TRAIN_SQL},
        w AS (SELECT fold, doc_id, term, tf, tf * CAST(idf AS DOUBLE) AS w FROM tf JOIN kept USING (term) WHERE fold = out)
        SELECT CAST(fold AS INTEGER) AS fold, doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
    "part_folds": f"""WITH p AS (
          SELECT user_id AS "user", (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // {PART_POSTS} AS part FROM events),
        u AS (SELECT DISTINCT "user", "user" % 2 AS label FROM p),
        f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5('555:' || "user"), "user") - 1) % 5 + 1 AS fold FROM u)
        SELECT DISTINCT p."user", CAST(part AS INTEGER) AS part, CAST(label AS INTEGER) AS label, CAST(fold AS INTEGER) AS fold FROM p JOIN f ON p."user" = f."user" """,
    "part_tfidf": f"""WITH {_HISTORY_SQL},
        docs AS (SELECT "user" AS doc_id, {_clean_sql("text", ENGLISH_STOPWORDS)} AS toks FROM hist), {LONG_SQL},
        t AS (SELECT doc_id, w AS term FROM words UNION ALL SELECT doc_id, w || ' ' || w1 FROM words WHERE w1 IS NOT NULL),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
        n AS (SELECT count(*) AS n FROM docs),
        v AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
        kept AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM v, n WHERE df >= {MIN_DF} AND df <= 0.9::DOUBLE * n
                 ORDER BY cf DESC, term LIMIT {TF.MAX_FEATURES}),
        w AS (SELECT doc_id, term, tf, tf * CAST(idf AS DOUBLE) AS w FROM tf JOIN kept USING (term))
        SELECT doc_id AS "user", term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""",
}

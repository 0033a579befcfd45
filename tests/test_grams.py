"""N-gram counts inside rows and over a corpus, against brute force."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import arrays as AR
from tidemark.operators import grams as GR
from tidemark.operators import tfidf as TF


def brute(words, n_max):
    return Counter(" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1))


def corpus(spark):
    rng = random.Random(5)
    rows = [[rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randrange(12))] for _ in range(40)] + [[], ["zz"], None]
    return rows, spark.createDataFrame(list(enumerate(rows)), "doc int, tokens array<string>").repartition(3)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_gram_stats_counts_documents_and_occurrences_in_one_shuffle(spark):
    rows, df = corpus(spark)
    df_, cf = Counter(), Counter()
    for r in rows:
        c = brute(r or [], 4)
        cf += c
        df_ += Counter(c.keys())
    stats = GR.gram_stats(df, 4)
    assert {r["term"]: (r["df"], r["cf"]) for r in stats.collect()} == {t: (df_[t], cf[t]) for t in cf}
    assert len(stats.collect()) == len(cf)
    assert shuffles(GR.gram_stats(spark.createDataFrame(rows[:3], "array<string>").toDF("tokens"), 4)) == 1


def test_terms_are_counted_in_the_row(spark, monkeypatch):
    rows, df = corpus(spark)
    monkeypatch.setattr(AR, "SLICE_TOKENS", 7)
    got = df.select("doc", GR.term_counts(F.col("tokens"), 2).alias("c"))
    assert shuffles(got) == shuffles(df)
    for r in got.collect():
        cells = [tuple(c) for c in r["c"]]
        assert dict(cells) == brute(rows[r["doc"]] or [], 2) and len(dict(cells)) == len(cells)


def test_slices_are_whole_rows_of_bounded_length(monkeypatch):
    monkeypatch.setattr(AR, "SLICE_TOKENS", 4)
    col = pa.array([["a"] * 3, ["b"] * 3, [], None, ["c"] * 9, ["d"]], pa.list_(pa.string()))
    parts = [s.to_pylist() for s in AR.token_slices(col)]
    assert sum(parts, []) == col.to_pylist()
    assert [sum(len(r or []) for r in p) for p in parts] == [3, 3, 9, 1]
    assert [len(s) for s in AR.token_slices(col.slice(0, 0))] == [0]


def test_long_weights_of_whole_documents_need_no_shuffle(spark):
    _, df = corpus(spark)
    docs = TF.with_terms(df.filter("tokens IS NOT NULL"), 2)
    by_position = TF.fit_tfidf(docs, "doc", 2, 2, 0.9, 50, tokens="tokens")
    model = TF.fit_tfidf(docs, "doc", 2, 2, 0.9, 50)
    assert sorted(by_position.vocab.collect()) == sorted(model.vocab.collect())
    local = model.long(docs, "doc", unique_docs=True)
    assert shuffles(local) == shuffles(docs)
    cells = [F.col(c) for c in ("doc", "term", "idx", "tf")] + [F.round("weight", 9)]
    assert sorted(local.select(*cells).collect()) == sorted(model.long(docs, "doc").select(*cells).collect())
    empty = TF.fit_tfidf(docs, "doc", 2, 99, 0.9, 50)
    assert empty.long(docs, "doc", unique_docs=True).count() == 0


def test_held_out_weights_of_whole_documents_need_no_shuffle(spark):
    _, df = corpus(spark)
    fold = F.when(F.col("doc") % 7 < 5, F.col("doc") % 7 + 1).when(F.col("doc") % 7 == 5, 9).cast("int")
    docs = TF.with_terms(df.withColumn("fold", fold), 2)
    fitted = TF.fit_tfidf_folds(docs, "doc", max_n=2, min_df=2, max_df=0.9, max_features=12)
    local = fitted.held_out(docs, "doc", unique_docs=True)
    assert shuffles(local) == shuffles(docs)
    cells = ["fold", "doc", "term", "idx", "tf", F.round("weight", 9)]
    want = sorted(map(tuple, fitted.held_out(docs, "doc").select(*cells).collect()))
    assert sorted(map(tuple, local.select(*cells).collect())) == want and {r[0] for r in want} == {1, 2, 3, 4, 5}
    whole = TF.fit_tfidf(docs, "doc", 2, 2, 0.9, 50)
    assert sorted(whole.long(docs, "doc", unique_docs=True).select(*cells[1:]).collect()) == sorted(whole.long(docs, "doc").select(*cells[1:]).collect())
    # A vocabulary that differs from fold to fold: each document meets only its own.
    assert len({tuple(r["term"] for r in fitted.model(f).terms_in_order()) for f in range(1, 6)}) > 1
    empty = TF.fit_tfidf_folds(docs, "doc", min_df=99)
    assert empty.held_out(docs, "doc", unique_docs=True).count() == 0

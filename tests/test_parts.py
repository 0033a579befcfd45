import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import parts as PT
from tidemark.operators import splits as SP
from tidemark.operators import tfidf as TF
from tidemark.plans import families as FA
from tidemark.plans import models as MO

SCHEMA = "user long, part int, y_true int, v double, tokens array<string>"


def histories(seed=1, users=60):
    rnd = random.Random(seed)
    for u in range(users):
        y = u % 2
        words = [rnd.choice(["aa", "bb", "cc", "x", "good" if y else "bad", "dd", "ee"]) for _ in range(rnd.randrange(0, 40))]
        yield u, y, float(rnd.randrange(9) + 2 * y), words


def whole(spark):
    return spark.createDataFrame([(u, 0, y, v, w) for u, y, v, w in histories()], SCHEMA)


def in_parts(spark, size=3):
    rows = []
    for u, y, v, w in histories():
        rows += [(u, p, y, v, w[i : i + size]) for p, i in enumerate(range(0, max(len(w), 1), size))]
        rows.append((u, 99, y, v, []))
    return spark.createDataFrame(rows, SCHEMA)


def test_folds_and_holdouts_are_those_of_users(spark):
    got = PT.user_folds(in_parts(spark), "y_true", user="user").select("user", "fold").distinct()
    want = SP.stratified_folds(whole(spark), "y_true", key="user").select("user", "fold")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    dev = PT.user_holdout(in_parts(spark), "y_true").select("user", "is_dev").distinct()
    want = SP.stratified_holdout(whole(spark), "y_true", key="user").select("user", "is_dev")
    assert sorted(map(tuple, dev.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("size", [1, 2, 3, 7])
@pytest.mark.parametrize("n", [1, 2, 4])
def test_terms_go_on_over_borders(spark, size, n):
    count = lambda d: sorted(map(tuple, d.select("user", F.explode("terms").alias("t")).groupBy("user", "t").count().collect()))
    assert count(PT.with_part_terms(in_parts(spark, size), n)) == count(TF.with_terms(whole(spark), n))


def test_odd_parts(spark):
    rows = [(None, 0, 0, 1.0, ["aa", "bb"]), (None, 1, 0, 1.0, ["cc"]), (1, 0, 1, 1.0, None), (2, 5, 1, 1.0, ["aa"] * 2)]
    out = PT.with_part_terms(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert {(r.user, r.part): r.terms for r in out} == {(None, 0): ["aa", "bb", "aa bb"], (None, 1): ["cc", "bb cc"], (1, 0): [], (2, 5): ["aa", "aa", "aa aa"]}
    assert PT.with_part_terms(spark.createDataFrame([], SCHEMA), 3).collect() == []


def test_weights_and_vectors_equal_the_whole_text(spark):
    a = TF.with_terms(whole(spark), 2)
    b = PT.with_part_terms(in_parts(spark), 2)
    one = TF.fit_tfidf(a, "user", 2, 2, 0.9, 50)
    many = TF.fit_tfidf(b, "user", 2, 2, 0.9, 50, unique_docs=False)
    table = lambda d: sorted(map(tuple, d.collect()))
    assert table(one.vocab) == table(many.vocab)
    dense = one.vectorizer().transform(a).select("user", vector_to_array("bow")).collect()
    units = PT.one_row(in_parts(spark))
    got = PT.with_unit_vectors(units, many.long(b, "user"), 50).select("user", vector_to_array("bow")).collect()
    assert len(got) == len(dense) == 60
    want = dict(map(tuple, dense))
    assert all(v == pytest.approx(want[u], abs=1e-12) for u, v in map(tuple, got))


def test_family_runs_predict_the_same_users(spark):
    specs = [MO.ModelSpec("lr", {"C": 1.0, "max_iter": 10})]
    found = {}
    for part, df in ((None, SP.stratified_folds(whole(spark), "y_true", 2, key="user")), ("part", PT.user_folds(in_parts(spark), "y_true", 2))):
        setup = FA.Setup(("v",), (), max_n=2, min_df=2, max_features=50, key="user", part=part)
        pred, _ = FA.cross_validate(FA.keep(df), {"x": ("bow", "users")}, specs, [setup], k=2)
        found[part] = sorted(map(tuple, pred.select("fold", "user", "y_true", "y_pred").collect()))
    assert found[None] == found["part"] and len(found[None]) == 60
    with pytest.raises(ValueError):
        FA.Blocks(FA.Setup(part="part"), ("topics",), in_parts(spark))


def test_fold_vocabularies_equal_separate_fits(spark):
    docs = TF.with_terms(SP.stratified_folds(whole(spark), "y_true", 5, key="user"), 2).persist()
    parts = PT.with_part_terms(PT.user_folds(in_parts(spark), "y_true", 5), 2).persist()
    for source, unique in ((docs, True), (parts, False)):
        fitted = TF.fit_tfidf_folds(source, "user", max_n=2, min_df=2, max_df=0.9, max_features=30, unique_docs=unique)
        exchanges = fitted.vocab._jdf.queryExecution().executedPlan().toString()
        assert exchanges.count("Exchange hashpartitioning(term") == 1
        for f in range(1, 6) if unique else (4,):
            alone = TF.fit_tfidf(docs.filter(F.col("fold") != f), "user", 2, 2, 0.9, 30)
            got, want = (sorted(map(tuple, m.vocab.select("term", "idx", "df", "cf", "idf").collect())) for m in (fitted.model(f), alone))
            assert got == want and fitted.n_docs[f] == alone.n_docs
        held = sorted(map(tuple, fitted.held_out(source, "user").filter("fold = 2").select("user", "term", "tf", F.round("weight", 9)).collect()))
        own = docs.filter("fold = 2")
        assert held == sorted(map(tuple, fitted.model(2).long(own, "user").select("user", "term", "tf", F.round("weight", 9)).collect()))

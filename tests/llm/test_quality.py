import math
import zlib

import pytest

from tests.llm import edge_rows
from tidemark.llm import quality, queries

GOOD = [f"The plain words of text number {i} go on, and on; they end here. Then another line\nfollows it." for i in range(60)]
BAD = [("SHOUT " * (i + 3) + "!! ") * 3 if i % 2 else "a | b | c | " * (i + 5) for i in range(40)]


@pytest.fixture(scope="module")
def taught(spark):
    docs = edge_rows.documents(spark, GOOD + BAD)
    labels = spark.createDataFrame([(100 + i, 1 if i < 60 else 0, "x") for i in range(100)] + [(999_999, 1, "x"), (None, 0, "x"), (101, None, "x")], "doc_id long, quality int, text string")
    return docs, labels, quality.fit(docs, labels)


def test_separates_and_scores_equal_the_rules_by_hand(spark, taught):
    docs, _, model = taught
    out = quality.with_features(docs).withColumn("score", model.score("_f_")).collect()
    assert len(out) == docs.count() and model.weights
    for r in out:
        f = {n: r["_f_" + n] for n in quality.features()}
        logit = model.intercept + sum(w * all((f[n] <= t) if low else (f[n] > t) for n, low, t in rule.bounds) for rule, w in model.weights)
        assert math.isclose(r.score, 1 / (1 + math.exp(-logit)), rel_tol=1e-9)
    held = [r for r in out if r.doc_id and r.doc_id >= 100 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.score >= 0.3) == (r.doc_id < 160) for r in held)


def test_columns_and_edges(spark, taught):
    docs, labels, model = taught
    out = quality.with_scores(docs.withColumn("score", quality.F.lit("clash")), model)
    assert set(out.columns) == {*docs.columns, "score", "predicted"}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.collect())
    assert quality.with_scores(edge_rows.empty(spark), model).count() == 0
    none = quality.fit(docs, labels.filter("1 = 0"))
    assert none.weights == () and none.intercept == 0.0
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert one.weights == () and one.intercept > 0


def test_rules_of_printed_trees():
    text = "Tree 0 (weight 1.0):\n If (feature 0 <= 1.5)\n  If (feature 0 <= 0.5)\n   Predict: 0\n  Else (feature 0 > 0.5)\n   Predict: 1\n Else (feature 0 > 1.5)\n  Predict: 1\n"
    got = [r.bounds for r in quality.tree_rules(text, ["a"])]
    assert got == [(("a", True, 1.5),), (("a", True, 0.5),), (("a", False, 0.5), ("a", True, 1.5)), (("a", False, 1.5),)]


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    out = queries.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    right = sum(r.predicted == r.quality for r in held) / len(held)
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    print("held-out accuracy", right, "AUC", auc, len(held))
    assert right > 0.97 and auc > 0.97

"""Steps whose work must not grow with a batch, a partition count or a vocabulary."""

import random

import numpy as np
from pyspark.ml.linalg import Vectors

from tidemark.operators import lsa as LS
from tidemark.operators import sequences as SQ
from tidemark.plans import models as MO


def encoded(spark, docs, vocab, **kw):
    return {r["n"]: r["ids"] for r in SQ.encode_tokens(docs, vocab, **kw).collect()}


def test_unbounded_vocabulary_joins_only_what_the_shipped_part_leaves_open(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.choice("abcdefghij") for _ in range(rng.randrange(9))]) for i in range(30)] + [(30, [])]
    docs = spark.createDataFrame(rows, "n int, tokens array<string>")
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(["<pad>", "<unk>", *"abcdefg"])], "id int, token string")
    want = encoded(spark, docs, vocab)
    small = SQ.encode_tokens(docs, vocab, vocab_max_rows=None, key=["n"])
    assert "hashpartitioning" not in small._jdf.queryExecution().executedPlan().toString()
    assert {r["n"]: r["ids"] for r in small.collect()} == want
    monkeypatch.setattr(SQ, "MAX_BROADCAST_ROWS", 4)
    assert encoded(spark, docs, vocab, vocab_max_rows=None, key=["n"]) == want


def test_contributions_count_tokens_in_the_row(spark):
    """A count by document and token would hold all pairs of a partition in one task's memory."""
    from catalog import evaluation as EV

    rows = EV._contributions(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().logical().toString()
    assert "contrib" in plan and "tf#" in plan and "count(1) AS tf" not in plan
    rows.unpersist()


def test_mean_vectors_gather_few_cells_at_a_time():
    import tracemalloc

    from tidemark.functions.vectors import row_sums

    matrix, cols = np.ones((50, 64)), np.zeros(300_000, dtype=int)
    tracemalloc.start()
    out = row_sums(np.sort(cols), cols, None, matrix, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0, 0] == 300_000 and peak < 20e6


def test_components_of_few_features_come_from_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((40, 6))
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x], ["v"]).repartition(3)
    seen = []
    product = LS.RowMatrix.computeSVD
    monkeypatch.setattr(LS.RowMatrix, "computeSVD", lambda *a, **k: seen.append(1) or product(*a, **k))
    one = LS.fit_lsa(df, "v", 2, 6)
    assert not seen
    assert np.allclose(one.singular_values, np.linalg.svd(x)[1][:2])
    monkeypatch.setattr(LS, "GRAM_FEATURES", 0)
    many = LS.fit_lsa(df, "v", 2, 6)
    assert seen and np.allclose(one.components, many.components) and np.allclose(one.singular_values, many.singular_values)


def test_fits_run_few_tasks_on_few_rows(spark):
    df = spark.range(300).repartition(200)
    assert MO.packed(df, 300).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert MO.packed(df, 200 * MO.TASK_ROWS).rdd.getNumPartitions() == 200


def test_components_of_few_rows_are_those_of_the_solver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.random((12, 150)) * (rng.random((12, 150)) < 0.4)
    df = spark.createDataFrame([(Vectors.dense(r),) for r in x], ["v"]).repartition(3)
    monkeypatch.setattr(LS, "GRAM_FEATURES", 100)
    few = LS.fit_lsa(df, "v", 7, 150)
    monkeypatch.setattr(LS, "DRIVER_ROWS", 5)
    many = LS.fit_lsa(df, "v", 7, 150)
    assert np.allclose(few.singular_values, many.singular_values) and np.allclose(few.components, many.components, atol=1e-6)
    monkeypatch.setattr(LS, "DRIVER_ROWS", 100)
    assert LS.fit_lsa(df, "v", 140, 150).k == 12  # no more than the rank

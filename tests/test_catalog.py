"""Registered queries against their SQL; TIDEMARK_ALL_QUERIES=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = ["user_features", "type1_history_own", "match_handles", "tfidf_unigram", "stratified_folds", "macro_scores", "stability"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TIDEMARK_ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_names_line_up():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    ok, message = compare(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])
    assert ok, message

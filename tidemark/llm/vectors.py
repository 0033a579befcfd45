"""What both vector searches share: which rows take part, copies of one vector, top lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranking import newest_per_key

#: Rows of one side that meet in one task at once.
BLOCK = 4096


def usable(df: DataFrame, key: str, vector: str, nonzero: bool) -> DataFrame:
    """(id, v array<double>): distinct rows with an id and a vector of finite components.

    Null vectors, vectors with null or non-finite components, those of another than the most common
    dimension, rows without an id and, if `nonzero`, zero vectors take no part.
    """
    v = F.col(vector).cast("array<double>")
    t = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    t = t.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if nonzero:
        t = t.filter(F.exists("v", lambda x: x != 0))
    dims = t.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    t = t.filter(F.size("v") == (dims["n"] if dims else 0))
    return t.dropDuplicates(["id", "v"])


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Without copies of a vector beyond the k + 1 smallest ids.

    Copies tie in every search and ties go to smaller ids, so with the query itself left out no later copy can
    be among the k: the rest of a group of copies, however large, is answered by these.
    """
    return newest_per_key(rows, ["v"], [F.col("id")], k + 1)


def matrix(column) -> np.ndarray:
    """Rows of doubles from a column of arrays."""
    return np.array([np.asarray(x, dtype=np.float64) for x in column], dtype=np.float64)


def from_bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def plain_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products, each added up in the order of the components, so equal vectors get equal sums."""
    out = np.zeros((len(q), len(v)))
    for j in range(q.shape[1]):
        out += q[:, j, None] * v[None, :, j]
    return out


def best(query_ids, queries: list, scores: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of every query by score, then smaller id, its own row left out."""
    out = []
    for i, (qid, q) in enumerate(zip(query_ids, queries)):
        s = np.where(ids == qid, -np.inf, scores[i])
        least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
        near = np.flatnonzero((s >= least) & (ids != qid))
        near = near[np.lexsort((ids[near], -s[near]))][:k]
        out += [(qid, q, int(ids[n]), float(s[n])) for n in near]
    return pd.DataFrame(out, columns=["query_id", "qv", "vec_id", "score"])


BEST = "query_id long, qv binary, vec_id long, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from the lists of all blocks; k rows a query and task are shuffled."""
    top = newest_per_key(found, ["query_id", "qv"], [F.desc("score"), F.col("vec_id")], k)
    order = W.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id")
    return top.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id", "score")

"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample, every row is put into a leaf. A query walks the tree through a
priority queue, nearest centre first, and visits as many leaves as a calibration asks for, and more until they
hold k rows of other ids: for a bounded set
of queries the true neighbours are found by brute force over all rows, and visits are widened until the
share of true neighbours in visited leaves reaches the wanted recall. Leaves with neighbouring numbers, most
of them siblings, form groups. A query goes once to each group in which it visits a leaf, with the list of those
leaves; groups and queries meet by an equi-join of (group, block of rows, block of queries), so a group of any
size is many small tasks, and only rows of visited leaves are compared.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.llm.vectors import BEST, BLOCK, best, candidates, from_bytes, matrix, plain_products, ranked, usable
from tidemark.operators.ranking import newest_per_key

#: Bounds of the fit: sampled rows, branches of a node, sampled rows of a leaf, rounds of k-means; queries of the calibration.
SAMPLE_ROWS, BRANCHES, LEAF_ROWS, ROUNDS, CALIBRATION = 20_000, 16, 64, 8, 200
RECALL, WIDEN = 0.97, 1.2
#: A child with less than this share of a full leaf's rows goes to its siblings.
LEAST_SHARE = 0.25
#: Leaves of a group, and bytes of query vectors in one Arrow batch on the way to their groups.
GROUP, BATCH_BYTES = 16, 4 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first: squares of very large or small components leave the range of doubles.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Inner nodes: centres of the children and their nodes; leaves have numbers.

    `state` holds it in arrays and dictionaries alone, which workers can read without this package.
    """

    def __init__(self, centres: dict[int, np.ndarray], children: dict[int, list[int]], leaf_of: dict[int, int]):
        self.centres, self.children, self.leaf_of = self.state = centres, children, leaf_of

    @classmethod
    def fit(cls, sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> Tree:
        self, nodes = cls({}, {}, {}), 1
        rng = np.random.default_rng(11)
        stack = [(0, sample)]
        while stack:
            node, rows = stack.pop()
            parts = self._split(rows, min(branches, -(-len(rows) // leaf_rows)), LEAST_SHARE * leaf_rows, rng) if len(rows) > leaf_rows else None
            if parts is None:
                self.leaf_of[node] = len(self.leaf_of)
                continue
            centres, owner = parts
            self.centres[node] = centres
            self.children[node] = list(range(nodes, nodes + len(centres)))
            nodes += len(centres)
            stack += [(c, rows[owner == i]) for i, c in enumerate(self.children[node])]
        return self

    @staticmethod
    def _split(rows, branches, least, rng):
        centres = np.unique(rows[rng.choice(len(rows), min(branches, len(rows)), replace=False)], axis=0)
        for _ in range(ROUNDS):
            owner = (rows @ centres.T).argmax(axis=1)
            live = np.unique(owner)
            centres = np.stack([rows[owner == i].mean(axis=0) for i in live])
            norms = np.linalg.norm(centres, axis=1)
            centres = centres[norms > 0] / norms[norms > 0, None]
        if len(centres) < 2:
            return None
        while True:
            owner = (rows @ centres.T).argmax(axis=1)
            held = np.bincount(owner, minlength=len(centres))
            if len(centres) < 2:
                return None  # rows that are all alike, or but for a few, stay one leaf
            if held.min() >= least:
                return centres, owner
            centres = np.delete(centres, held.argmin(), axis=0)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            if node in self.leaf_of:
                out[at] = self.leaf_of[node]
            elif len(at):
                owner = (rows[at] @ self.centres[node].T).argmax(axis=1)
                stack += [(c, at[owner == i]) for i, c in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, most: int, sizes: dict[int, int] | None = None, rows: int = 0) -> list[int]:
        """The first `most` leaves of the best-bin-first walk, and more until they hold `rows` rows by `sizes`."""
        queue, out, held = [(-1.0, 0)], [], 0
        while queue and (len(out) < most or held < rows):
            _, node = heapq.heappop(queue)
            if node in self.leaf_of:
                out.append(self.leaf_of[node])
                held += sizes.get(out[-1], 0) if sizes else rows
            else:
                for near, child in zip(self.centres[node] @ query, self.children[node]):
                    heapq.heappush(queue, (-float(near), child))
        return out


def _calibrated(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float, most: int) -> int:
    """Leaf visits at which the calibration queries reach the recall; their true neighbours come from all rows."""
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(most).toPandas()
    if not len(asked):
        return 1
    q, qids = _unit(matrix(asked["v"])), asked["id"].to_numpy()
    marks = [b""] * len(q)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), _unit(from_bytes(batch.column(2).to_pylist()))
            for a in range(0, len(q), 64):
                part = best(qids[a : a + 64], marks[a : a + 64], q[a : a + 64] @ v.T, ids, k)
                part["leaf"] = part["vec_id"].map(dict(zip(ids.tolist(), batch.column(1).to_pylist())))
                kept = part if kept is None else pd.concat([kept, part])
            kept = kept.sort_values(["query_id", "score"], ascending=[True, False]).groupby("query_id").head(k)
        if kept is not None:
            yield pa.RecordBatch.from_pandas(kept[["query_id", "qv", "vec_id", "score", "leaf"]], preserve_index=False)

    near = rows.select("id", "leaf", "vec").mapInArrow(nearest, BEST + ", leaf long")
    near = newest_per_key(near, ["query_id"], [F.desc("score"), F.col("vec_id")], k).toPandas()  # k rows a query
    place = []
    for qid, x in zip(qids, q):
        order = {leaf: i for i, leaf in enumerate(tree.visits(x, len(tree.leaf_of)))}
        place += [order[leaf] for leaf in near.loc[near["query_id"] == qid, "leaf"]]
    place = np.array(place)
    visits = 1
    while len(place) and (place < visits).mean() < recall:
        visits = max(visits + 1, int(visits * WIDEN))
    return min(visits, len(tree.leaf_of))


VISITS = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))


def nearest(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine found for every query, ties to smaller ids.

    `is_query`: boolean column of `df` over `key`. `recall` is that of the calibration (`CALIBRATION` queries
    against all rows). Rows that take no part are named in `usable`; rows equal in id and vector count once,
    rows of one id with several vectors are several candidates, and several queries. With k candidates or
    fewer all are returned. Scores are cosines in double precision on the original vectors.
    """
    spark = df.sparkSession
    rows = checkpointed(usable(df, key, vector, nonzero=True))
    indexed = candidates(rows, k)
    sample = indexed.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toPandas()
    tree = Tree.fit(_unit(matrix(sample["v"])) if len(sample) else np.zeros((0, 1)))
    shared = spark.sparkContext.broadcast(tree.state)  # at most SAMPLE_ROWS / LEAF_ROWS * BRANCHES centres

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*shared.value)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1).to_pylist())
                vec = pa.array([x.tobytes() for x in v], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tree.leaves(_unit(v))), vec], ["id", "leaf", "vec"])

    index = checkpointed(indexed.mapInArrow(placed, "id long, leaf long, vec binary"))
    queries = rows.filter(is_query(F.col("id")))
    visits = _calibrated(index, queries, tree, k, recall, CALIBRATION)

    # One number per leaf of the tree. A query leaves out all rows of its id, so it needs as many more than k.
    held = spark.sparkContext.broadcast({r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()})
    several = queries.groupBy("id").agg(F.count(F.lit(1)).alias("own")).filter("own > 1")
    asking = queries.join(several, "id", "left").select("id", "v", F.coalesce("own", F.lit(1)).alias("own"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, names = Tree(*shared.value), ["query_id", "qv", "grp", "leaves"]
        for batch in batches:
            out, size = [], 0
            for i, v, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                v = np.asarray(v, np.float64)
                seen, vec = np.sort(tree.visits(_unit(v[None])[0], visits, held.value, k + own)), v.tobytes()
                groups, begin = np.unique(seen // GROUP, return_index=True)
                out += [(i, vec, int(g), leaves.tolist()) for g, leaves in zip(groups, np.split(seen, begin[1:]))]
                size += len(groups) * len(vec) + 8 * len(seen)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), VISITS)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), VISITS)], names)

    visiting = checkpointed(asking.mapInArrow(walked, "query_id long, qv binary, grp long, leaves array<long>"))
    grouped = index.withColumn("grp", F.floor(F.col("leaf") / GROUP))
    parts = grouped.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_rows"))
    asked = visiting.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_asks"))
    sizes = F.broadcast(checkpointed(parts.join(asked, "grp")))  # one row per group of leaves of the tree
    own, other = F.pmod(F.xxhash64("id"), F.col("_rows")), F.explode(F.expr("sequence(0, _asks - 1)"))
    left = grouped.join(sizes, "grp").select("grp", own.alias("rb"), other.alias("qb"), "id", "vec", "leaf")
    own, other = F.pmod(F.xxhash64("query_id"), F.col("_asks")), F.explode(F.expr("sequence(0, _rows - 1)"))
    right = visiting.join(sizes, "grp").select("grp", other.alias("rb"), own.cast("int").alias("qb"), "query_id", "qv", "leaves")

    def met(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame([], columns=["query_id", "qv", "vec_id", "score"])]
        if len(own) and len(asking):
            v, ids = _unit(from_bytes(own["vec"].tolist())), own["id"].to_numpy()
            places = {leaf: at.to_numpy() for leaf, at in pd.Series(np.arange(len(own))).groupby(own["leaf"].to_numpy())}
            for a in range(0, len(asking), 256):
                some = asking.iloc[a : a + 256]
                q, scores = _unit(from_bytes(some["qv"].tolist())), np.full((len(some), len(own)), -np.inf)
                for leaf, at in places.items():
                    going = np.flatnonzero([leaf in x for x in some["leaves"]])
                    if len(going):
                        scores[np.ix_(going, at)] = plain_products(q[going], v[at])
                found = best(some["query_id"], list(some["qv"]), scores, ids, k)
                out.append(found[found["score"] > -np.inf])
        return pd.concat(out[1:] or out)

    cell = ["grp", "rb", "qb"]
    left, right = (t.withColumns({"rb": F.col("rb").cast("int"), "qb": F.col("qb").cast("int")}) for t in (left, right))
    return ranked(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(met, BEST), k)

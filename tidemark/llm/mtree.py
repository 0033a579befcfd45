"""Exact top-k inner products by M-trees, searched best first.

Inner products become distances: with M the largest norm, a row v gets one more component sqrt(M^2 - |v|^2) and
a query a zero, and then d^2 = |q|^2 + M^2 - 2 <q, v>, so the nearest row has the largest product. Rows go to the
nearest of a bounded number of routing objects; each routing object's rows are cut into blocks, and each block
is written as pages: a centre, its distance to the routing object, a covering radius, the rows and their
distances to the centre.

A query first searches one block of its nearest routing object, which bounds its k-th distance, then all
blocks of those routing objects that the bound doesn't exclude. In a block pages come off a priority queue by
least possible distance. Stored distances to the parent exclude pages and rows by the triangle inequality
before any distance to them is computed. Bounds are loosened by a margin above rounding, scores are integers,
so the result is exact.
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
from tidemark.llm.vectors import BLOCK, candidates, from_bytes, matrix, ranked, usable

#: Routing objects at most, and rows of a page.
ROUTES, PAGE = 256, 256
SLACK = 1e-9
FOUND = "query_id long, qv binary, vec_id long, score long"


def whole(v: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(v * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles while no sum can leave their 53 bits, else 64-bit integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    return (a @ b.T).astype(np.int64) if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that gives all of them the same norm."""
    return np.concatenate([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0.0))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def pages_of(ids: np.ndarray, v: np.ndarray, route: np.ndarray, top: float, page: int) -> list[tuple]:
    """(centre, distance to the routing object, radius, distances, ids, rows) of one block."""
    out, stack, x = [], [np.arange(len(ids))], lifted(v, top)
    while stack:
        at = stack.pop()
        if len(at) > page:
            # Two far rows part the rest; rows that can't be parted are cut by position.
            a = distances(x[at[:1]], x[at])[0].argmax()
            near = distances(x[at[[a]]], x[at])[0]
            b = near.argmax()
            other = near > distances(x[at[[b]]], x[at])[0]
            if 0 < other.sum() < len(at) and min(other.sum(), (~other).sum()) * 16 >= len(at):
                stack += [at[other], at[~other]]
            else:
                order = np.argsort(near, kind="stable")
                stack += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
            continue
        centre = at[distances(x[at].mean(axis=0, keepdims=True), x[at])[0].argmin()]
        own = distances(x[[centre]], x[at])[0]
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        out.append((x[centre], float(distances(x[[centre]], route[None])[0, 0]), float(own[-1]), own, ids[at], v[at]))
    return out


class Best:
    """The k best (score, smaller id) so far of one query and the distance that a better row must not exceed."""

    def __init__(self, k: int, square: float, bound: float):
        self.k, self.square, self.bound, self.rows = k, square, bound, []

    def add(self, scores: np.ndarray, ids: np.ndarray, slack: float) -> None:
        if len(scores) > self.k:
            least = np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        self.rows = sorted([*self.rows, *((-int(s), int(i)) for s, i in zip(scores, ids))])[: self.k]
        if len(self.rows) == self.k:
            self.bound = min(self.bound, np.sqrt(max(self.square + 2.0 * self.rows[-1][0], 0.0)) + slack)


def search(pages: list[tuple], route: np.ndarray, q: np.ndarray, qid: int, top: float, k: int, bound: float, counts: list | None = None) -> Best:
    """Best-first search of one block."""
    x = np.append(q, 0.0)
    square = float(q @ q) + top
    slack = SLACK * (np.sqrt(square) + np.sqrt(top)) + 1e-6
    state = Best(k, square, bound)
    to_route = np.linalg.norm(x - route)
    # By the stored distance to the parent alone; a page's own distance is only computed when it comes up.
    queue = [(abs(to_route - p[1]) - p[2] - slack, i, False, 0.0) for i, p in enumerate(pages)]
    heapq.heapify(queue)
    while queue:
        least, i, known, near = heapq.heappop(queue)
        if least > state.bound:
            break
        centre, _, radius, own, ids, v = pages[i]
        if not known:
            near = float(np.linalg.norm(x - centre))
            heapq.heappush(queue, (max(least, near - radius - slack), i, True, near))
            continue
        a, b = np.searchsorted(own, [near - state.bound - slack, near + state.bound + slack]) if state.bound < np.inf else (0, len(own))
        if a < b:
            if counts is not None:
                counts.append(b - a)
            scores, rows = products(q[None], v[a:b])[0], ids[a:b]
            keep = rows != qid
            state.add(scores[keep], rows[keep], slack)
    return state


def top_products(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * component), ties to smaller ids.

    `is_query`: function from the key column to a boolean column. Rows that take no part are named in
    `usable` (zero vectors do); rows equal in id and vector count once. With k candidates or fewer all are
    returned. Scores must fit 64 bits.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector, nonzero=False)
    rows = checkpointed(rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("double"))).dropDuplicates(["id", "v"]))
    indexed = candidates(rows, k)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, top = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(square), F.lit(0.0))).first()
    chosen = indexed.orderBy(F.xxhash64("id"), "id").limit(max(1, min(ROUTES, -(-n // block)))).toPandas()
    routes = lifted(matrix(chosen["v"]), top) if len(chosen) else np.zeros((1, 1))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1).to_pylist())
                d = distances(lifted(v, top), routes)
                near = d.argmin(axis=1)
                arrays = [batch.column(0), pa.array(near, pa.int64()), pa.array(d[np.arange(len(v)), near]), pa.array([x.tobytes() for x in v], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "route", "dist", "vec"])

    placed = checkpointed(indexed.mapInArrow(routed, "id long, route long, dist double, vec binary"))
    summary = placed.groupBy("route").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"), F.max("dist").alias("radius"), F.min("dist").alias("least"))
    summary = summary.orderBy("route").toPandas()  # one row per routing object
    blocks = dict(zip(summary["route"].tolist(), summary["_blocks"].tolist()))
    live = summary["route"].to_numpy()
    outer, inner = summary["radius"].to_numpy(), summary["least"].to_numpy()

    def paged(pdf: pd.DataFrame) -> pd.DataFrame:
        route = int(pdf["route"].iloc[0])
        built = pages_of(pdf["id"].to_numpy(), from_bytes(pdf["vec"].tolist()), routes[route], top, page)
        cols = ["centre", "to_route", "radius", "dists", "ids", "rows"]
        out = pd.DataFrame([[c.tobytes(), t, r, o.tobytes(), i.tobytes(), v.tobytes()] for c, t, r, o, i, v in built], columns=cols)
        return out.assign(route=route, block=int(pdf["block"].iloc[0]))[["route", "block", *cols]]

    per_route = F.broadcast(spark.createDataFrame([(int(r), int(b)) for r, b in blocks.items()], "route long, _blocks int"))
    cut = placed.join(per_route, "route").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")).drop("_blocks", "dist")
    schema = "route long, block int, centre binary, to_route double, radius double, dists binary, ids binary, rows binary"
    index = checkpointed(cut.groupBy("route", "block").applyInPandas(paged, schema))

    def searched(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own):
            numbers = lambda b: np.frombuffer(b, np.float64)
            pages = [(numbers(p.centre), p.to_route, p.radius, numbers(p.dists), np.frombuffer(p.ids, np.int64), numbers(p.rows).reshape(-1, len(numbers(p.centre)) - 1)) for p in own.itertuples()]
            for a in asking.itertuples():
                got = search(pages, routes[a.route], numbers(a.qv), a.query_id, top, k, a.bound)
                out += [(a.query_id, a.qv, i, -s) for s, i in got.rows]
        return pd.DataFrame(out, columns=["query_id", "qv", "vec_id", "score"])

    def bounds_of(v: np.ndarray) -> np.ndarray:
        d = distances(np.concatenate([v, np.zeros((len(v), 1))], axis=1), routes[live])
        return np.maximum(np.maximum(d - outer, inner - d), 0.0), d

    def first_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(1).to_pylist())
                near = live[bounds_of(v)[1].argmin(axis=1)] if len(live) else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array(near, pa.int64())], ["query_id", "qv", "route"])

    asked = rows.filter(is_query(F.col("id"))).mapInArrow(first_visits, "query_id long, qv binary, route long")
    asked = asked.join(per_route, "route").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    asked = checkpointed(asked)
    cell = ["route", "block"]

    def visited(visits: DataFrame) -> DataFrame:
        return index.groupBy(*cell).cogroup(visits.select(*cell, "query_id", "qv", "bound").groupBy(*cell)).applyInPandas(searched, FOUND)

    first = checkpointed(visited(asked.withColumn("bound", F.lit(float("inf")))))
    full = F.when(F.count(F.lit(1)) >= k, F.min("score"))
    kth = first.groupBy("query_id", "qv").agg(full.alias("kth"))
    later = asked.join(kth, ["query_id", "qv"], "left")

    def next_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_out: list[tuple] = []
            if batch.num_rows and len(live):
                v = from_bytes(batch.column(1).to_pylist())
                least, _ = bounds_of(v)
                for i, (qid, qv, route, blk, kth_) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                    sq = float(v[i] @ v[i]) + top
                    slack = SLACK * (np.sqrt(sq) + np.sqrt(top)) + 1e-6
                    bound = np.inf if kth_ is None else np.sqrt(max(sq - 2.0 * kth_, 0.0)) + slack
                    for r in live[least[i] <= bound + slack].tolist():
                        rows_out += [(qid, qv, r, b, bound) for b in range(blocks[r]) if (r, b) != (route, blk)]
            kinds = [("query_id", pa.int64()), ("qv", pa.binary()), ("route", pa.int64()), ("block", pa.int32()), ("bound", pa.float64())]
            columns = list(zip(*rows_out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])

    visits = later.select("query_id", "qv", "route", "block", "kth").mapInArrow(next_visits, "query_id long, qv binary, route long, block int, bound double")
    return ranked(first.unionByName(visited(visits)), k)

"""A whole grid of logistic regressions in one fit: every iteration is one job for all configurations.

The coefficients of all configurations stand side by side in one matrix. A job multiplies each row by the
matrix, and sums losses and gradients of all configurations in tasks and then in a tree of tasks, so the driver
receives one small matrix however many partitions there are. On the driver each configuration is an optimiser of
its own (orthant-wise limited-memory quasi-Newton, which covers elastic net) that asks for the loss at one
point at a time; those still running share the next job.

The objective is that of `models.fit_lr`: weighted mean log-loss + 1 / (C n) x elastic-net penalty, the intercept
free. Columns are divided by their root mean square inside the optimiser; penalties are those of the
columns as they are.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import check_matrix, row_sums, vector_cells, vector_times
from tidemark.operators.numeric import class_weights
from tidemark.plans.models import ModelSpec

MEMORY, BACKTRACKS, TREE_WIDTH = 10, 20, 32
#: Relative gain of a step below which a fit has settled.
LEAST_GAIN = 1e-11
Asks = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two-loop recursion over the last (step, gradient change) pairs."""
    q, kept = grad.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(kept)):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def minimised(dims: int, l1: np.ndarray, l2: np.ndarray, max_iter: int, tol: float) -> Asks:
    """Asks for (loss, gradient) at points and returns the minimiser of loss + l1 |x| + l2 x^2 / 2."""

    def whole(x, answer):
        return answer[0] + 0.5 * float(l2 @ (x * x)), answer[1] + l2 * x

    x, steps = np.zeros(dims), []
    f, g = whole(x, (yield x))
    for _ in range(max_iter):
        low, high = g - l1, g + l1
        slope = np.where(x > 0, high, np.where(x < 0, low, np.where(low > 0, low, np.where(high < 0, high, 0.0))))
        if np.abs(slope).max(initial=0.0) <= tol:
            break
        move = _direction(slope, steps)
        move[(move * slope >= 0) & (l1 > 0)] = 0.0
        if move @ slope >= 0:
            steps, move = [], -slope
        side = np.where(x != 0, np.sign(x), -np.sign(slope))
        before, t = f + float(l1 @ np.abs(x)), 1.0 if steps else 1.0 / max(1.0, float(np.linalg.norm(slope)))
        for _ in range(BACKTRACKS):
            new = x + t * move
            new[(l1 > 0) & (new * side < 0)] = 0.0  # no coefficient crosses zero in one step
            nf, ng = whole(new, (yield new))
            if nf + float(l1 @ np.abs(new)) <= before + 1e-4 * float(slope @ (new - x)):
                break
            t *= 0.5
        else:
            break
        settled = before - nf - float(l1 @ np.abs(new)) <= LEAST_GAIN * max(1.0, abs(before))
        s, y = new - x, ng - g
        if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            steps = [*steps, (s, y)][-MEMORY:]
        x, f, g = new, nf, ng
        if settled:
            break
    return x


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            part = np.frombuffer(blob)
            total = part.copy() if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _tree_total(parts: DataFrame, n: int) -> np.ndarray | None:
    """Sum of one array per partition of `parts`; at most `TREE_WIDTH` arrays reach the driver."""
    while n > TREE_WIDTH:
        n = math.ceil(n / TREE_WIDTH)
        parts = parts.repartition(n).mapInArrow(_summed, "sums binary")
    arrays = [np.frombuffer(r[0]) for r in parts.collect()]
    return np.sum(arrays, axis=0) if arrays else None


def _losses(rows: DataFrame, n: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss, gradient) sums of all points: columns of coefficients, the intercept last."""
    dims, m = points.shape[0] - 1, points.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(check_matrix(points))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = shared.value, np.zeros((dims + 2, m))
        for batch in batches:
            y, w, vec = batch.column(0).to_numpy(), batch.column(1).to_numpy()[:, None], batch.column(2)
            sign = np.where(y == 1, 1.0, -1.0)[:, None]
            margin = sign * (vector_times(vec, at[:-1]) + at[-1])
            total[-1] += (w * np.logaddexp(0.0, -margin)).sum(axis=0)
            pull = -w * sign * np.exp(-np.logaddexp(0.0, margin))
            r, c, v = vector_cells(vec)
            order = np.argsort(c, kind="stable")
            total[:dims] += row_sums(c[order], r[order], v[order], pull, dims)
            total[dims] += pull.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    try:
        total = _tree_total(rows.mapInArrow(partial, "sums binary"), n)
    finally:
        shared.unpersist()
    total = np.zeros((dims + 2, m)) if total is None else total.reshape(dims + 2, m)
    return total[-1], total[:-1]


def _squares(rows: DataFrame, n: int, dims: int) -> np.ndarray:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1)
        for batch in batches:
            _, c, v = vector_cells(batch.column(2))
            total[:dims] += np.bincount(c, v * v, minlength=dims)
            total[dims] += batch.column(1).to_numpy().sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    total = _tree_total(rows.mapInArrow(partial, "sums binary"), n)
    return np.zeros(dims + 1) if total is None else total


class LinearScorer:
    """Coefficients and intercept of one configuration; `predict` as the other classifiers have it."""

    def __init__(self, coefficients: np.ndarray, intercept: float, features: str):
        self.coefficients, self.intercept, self.features = DenseVector(coefficients), intercept, features
        self.model = self  # where fitted Spark models keep `coefficients`

    def predict(self, df: DataFrame) -> DataFrame:
        own = np.append(self.coefficients.toArray(), self.intercept)[:, None]
        return df.withColumn("y_pred", (_margins(df, self.features, own)[0] > 0).cast("int"))


def _margins(df: DataFrame, features: str, points: np.ndarray):
    m = check_matrix(points)

    @F.arrow_udf("array<double>")
    def margins(vec: pa.Array) -> pa.Array:
        out = vector_times(vec, m[:-1]) + m[-1]
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), pa.array(out.ravel()))

    return margins(F.unwrap_udt(F.col(features)))


def fit_lr_grid(df: DataFrame, specs: Sequence[ModelSpec], features: str = "features", label: str = "y_true", tol: float = 1e-7) -> tuple[list[LinearScorer], int]:
    """(scorers in the order of `specs`, jobs run): all "lr" specs fitted together on one feature table.

    Rows with a null label or vector are an error in the fit, as in Spark's. Without rows all coefficients are 0.
    The table is kept while the fit runs (memory, then disk).
    """
    if any(s.kind != "lr" for s in specs):
        raise ValueError("logistic regressions only")
    if len({s.params.get("balanced", True) for s in specs}) > 1:
        raise ValueError("one class weighting for the whole grid")
    balanced = specs[0].params.get("balanced", True)
    weighted = class_weights(df, "balanced", label, out="_w") if balanced else df.withColumn("_w", F.lit(1.0))
    rows = weighted.select(F.col(label).cast("int").alias("y"), F.col("_w").cast("double").alias("w"), F.unwrap_udt(F.col(features)).alias("v"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        shape = rows.agg(F.max(F.coalesce("v.size", F.size("v.values"))).alias("d"), F.count(F.lit(1)).alias("n")).first()
        dims, n, parts = shape["d"] or 0, shape["n"], rows.rdd.getNumPartitions()
        squares = _squares(rows, parts, dims)
        total = squares[-1]
        scale = np.append(np.sqrt(squares[:-1] / total) if total else np.ones(dims), 1.0)
        scale[scale == 0] = 1.0
        asks: dict[int, Asks] = {}
        for i, spec in enumerate(specs):
            p = {"penalty": "l2", "C": 10.0, "l1_ratio": None, "max_iter": 100, **spec.params}
            mix, reg = {"l1": 1.0, "l2": 0.0}.get(p["penalty"], p["l1_ratio"]), 1.0 / (p["C"] * max(n, 1))
            free = np.append(np.ones(dims), 0.0)
            asks[i] = minimised(dims + 1, free * reg * mix / scale, free * reg * (1 - mix) / scale**2, p["max_iter"], tol)
        found, points, jobs = {}, {i: next(a) for i, a in asks.items()}, 0
        while points and total:
            names = list(points)
            loss, grad = _losses(rows, parts, np.stack([points[i] / scale for i in names], axis=1))
            jobs += 1
            for k, i in enumerate(names):
                try:
                    points[i] = asks[i].send((float(loss[k] / total), grad[:, k] / total / scale))
                except StopIteration as end:
                    found[i] = end.value / scale
                    del points[i]
    finally:
        rows.unpersist()
    none = np.zeros(dims + 1)
    return [LinearScorer(found.get(i, none)[:-1], float(found.get(i, none)[-1]), features) for i in range(len(specs))], jobs


def sweep(scorers: Sequence[LinearScorer], specs: Sequence[ModelSpec], df: DataFrame, label: str = "y_true") -> DataFrame:
    """(config, penalty, C, l1_ratio, F1): macro F1 of every configuration, all scored in one pass."""
    points = np.stack([np.append(s.coefficients.toArray(), s.intercept) for s in scorers], axis=1)
    margins = df.select(F.col(label).alias("y"), F.posexplode(_margins(df, scorers[0].features, points)).alias("config", "margin"))
    y, yes = F.col("y") == 1, F.col("margin") > 0
    counts = margins.groupBy("config").agg(*[F.count_if(c).alias(n) for n, c in (("tp", y & yes), ("fp", ~y & yes), ("fn", y & ~yes), ("tn", ~y & ~yes))])

    def f1(tp):
        wrong = F.col("fp") + F.col("fn")
        return F.when(F.col(tp) + wrong > 0, 2 * F.col(tp) / (2 * F.col(tp) + wrong)).otherwise(F.lit(0.0))

    names = [(i, s.params.get("penalty", "l2"), float(s.params.get("C", 10.0)), s.params.get("l1_ratio")) for i, s in enumerate(specs)]
    table = df.sparkSession.createDataFrame(names, "config int, penalty string, C double, l1_ratio double")
    return table.join(counts.select("config", ((f1("tp") + f1("tn")) / 2).alias("F1")), "config", "left").select("config", "penalty", "C", "l1_ratio", "F1")

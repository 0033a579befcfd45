"""Boosted trees with second-order gains and leaf penalties, grown by aggregates over binned features.

Feature values become bins once. A level of a tree is one aggregate of gradient and curvature sums by (node,
feature, bin); windows over the bins turn them into gains, and only the best split of each node comes to the
driver. Bins are counted from that of zero, which is never stored or summed: what a node has there is its total
less the other bins, so sparse term columns cost their non-zero entries alone.

Gradients are summed as whole numbers (fixed point), so sums, splits and ties don't depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut_lineage
from tidemark.operators.splits import DEFAULT_SEED

#: Bins on either side of zero; a code holds the feature and the bin.
HALF = 128
CODES = 2 * HALF
#: Trees after which the margins are written and read back.
TREES_PER_CUT = 20
#: A split must gain more than this.
LEAST_GAIN = 1e-6
_SHARES = 1_000_000

# The grid of the boosted trees.
BOOST_GRID = (
    {"max_depth": 3, "min_child": 1.0, "rate": 0.10, "trees": 300, "reg_lambda": 1.0, "reg_alpha": 0.0},
    {"max_depth": 3, "min_child": 2.0, "rate": 0.05, "trees": 600, "reg_lambda": 2.0, "reg_alpha": 0.5},
    {"max_depth": 5, "min_child": 1.0, "rate": 0.10, "trees": 300, "reg_lambda": 1.0, "reg_alpha": 0.0},
    {"max_depth": 5, "min_child": 2.0, "rate": 0.05, "trees": 600, "reg_lambda": 2.0, "reg_alpha": 0.5},
)


@dataclass
class Node:
    """A leaf (`feature` is None) or a split: bins >= `bin` go right if it is positive, bins <= `bin` left if negative."""

    gradient: float
    curvature: float
    value: float
    feature: int | None = None
    bin: int = 0
    gain: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None

    def leaves(self) -> list["Node"]:
        return [self] if self.feature is None else self.left.leaves() + self.right.leaves()

    def splits(self) -> list["Node"]:
        return [] if self.feature is None else [self, *self.left.splits(), *self.right.splits()]


@dataclass
class Bins:
    """Ascending cuts of every feature, one after another; a value up to a cut is left of it."""

    cuts: np.ndarray
    starts: np.ndarray
    zero: np.ndarray = field(init=False)

    def __post_init__(self):
        self.zero = np.zeros(len(self.starts) - 1, np.int64)
        every = np.arange(len(self.zero))
        self.zero = self.of(every, np.zeros(len(every)))

    def of(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Cuts below each value, less those below zero; a missing value counts as zero."""
        low, high = self.starts[feature].copy(), self.starts[feature + 1].copy()
        first = low.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            above = open_ & (self.cuts[np.minimum(mid, max(len(self.cuts) - 1, 0))] < value)
            low, high = np.where(above, mid + 1, low), np.where(open_ & ~above, mid, high)
        return np.where(np.isnan(value), 0, low - first - self.zero[feature])

    def threshold(self, split: Node) -> float:
        """The largest value that goes left at a split."""
        at = self.starts[split.feature] + self.zero[split.feature] + split.bin
        return float(self.cuts[at - 1 if split.bin > 0 else at])


def _entries(features: str) -> tuple[Column, Column]:
    """Indices and values of a vector column; null vectors have none."""
    v = F.unwrap_udt(F.col(features))
    values = F.coalesce(v["values"], F.array().cast("array<double>"))
    places = F.coalesce(v["indices"], F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)), F.array().cast("array<int>"))
    return places, values


def dims_of(df: DataFrame, features: str) -> int:
    v = F.unwrap_udt(F.col(features))
    return df.agg(F.max(F.coalesce(v["size"], F.size(v["values"])))).first()[0] or 0


def quantile_bins(df: DataFrame, features: str, dims: int, max_bins: int = 64) -> Bins:
    """Cuts at zero and at quantiles of the other values of every feature: at most dims x max_bins numbers."""
    if not 2 <= max_bins < HALF:
        raise ValueError(f"max_bins must be from 2 to {HALF - 1}")
    places, values = _entries(features)
    entries = df.select(F.explode(F.arrays_zip(places.alias("f"), values.alias("v"))).alias("e")).select("e.f", "e.v")
    entries = entries.filter((F.col("v") != 0) & ~F.isnan("v"))
    at = F.percentile_approx("v", [i / max_bins for i in range(1, max_bins)], 100 * max_bins)
    found = {r.f: r.cuts for r in entries.groupBy("f").agg(at.alias("cuts")).toLocalIterator()}
    return fixed_bins([sorted({0.0, *found.get(f, ())}) for f in range(dims)])


def fixed_bins(cuts: list[list[float]]) -> Bins:
    """Bins from given ascending cuts of each feature."""
    starts = np.cumsum([0, *(len(c) for c in cuts)]).astype(np.int64)
    return Bins(np.array([x for c in cuts for x in c], dtype=np.float64), starts)


def _flat(places: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all entries of a batch."""
    rows = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
    return rows, places.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.flatten().to_numpy(zero_copy_only=False)


def codes_of(spark: SparkSession, bins: Bins, features: str) -> Column:
    """array<int>: feature x CODES + HALF + bin of the entries in another bin than that of zero."""
    shared = spark.sparkContext.broadcast((bins.cuts, bins.starts))

    def coded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = Bins(*shared.value)
        for places, values in batches:
            rows, f, v = _flat(places, values)
            b = own.of(f, v)
            kept = b != 0
            ends = np.searchsorted(rows[kept], np.arange(len(places) + 1))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((f * CODES + HALF + b)[kept], pa.int32()))

    coded.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(coded, "array<int>")(*_entries(features))


def _goes_right(split: Node) -> Column:
    base = split.feature * CODES
    low, high = (base + HALF + split.bin, base + CODES - 1) if split.bin > 0 else (base, base + HALF + split.bin)
    hit = F.exists("_codes", lambda c: (c >= low) & (c <= high))
    return hit if split.bin > 0 else ~hit


def _by_leaf(node: Node, value) -> Column:
    """`value(leaf)` of the leaf that a row falls into."""
    if node.feature is None:
        return value(node)
    return F.when(_goes_right(node), _by_leaf(node.right, value)).otherwise(_by_leaf(node.left, value))


def _soft(g, alpha: float):
    """Gradient sums, drawn towards zero by the absolute penalty; numbers and columns alike."""
    if isinstance(g, Column):
        return F.signum(g) * F.greatest(F.abs(g) - alpha, F.lit(0.0))
    return math.copysign(max(abs(g) - alpha, 0.0), g)


@dataclass
class BoostedTrees:
    """A fitted model: trees over bins, margins start at zero."""

    trees: list[Node]
    bins: Bins
    features: str

    def with_margin(self, df: DataFrame, out: str = "margin") -> DataFrame:
        """`df` and the log-odds of label 1; the whole model runs over Arrow batches."""
        splits = [_table(t) for t in self.trees]
        shared = df.sparkSession.sparkContext.broadcast((splits, self.bins.cuts, self.bins.starts))

        def margins(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            tables, *parts = shared.value
            own = Bins(*parts)
            used = np.unique(np.concatenate([np.empty(0, np.int64), *(t[0][t[0] >= 0] for t in tables)]))
            for places, values in batches:
                rows, f, v = _flat(places, values)
                kept = np.isin(f, used)
                seen = np.zeros((len(places), len(used)), np.int16)
                seen[rows[kept], np.searchsorted(used, f[kept])] = own.of(f[kept], v[kept])
                total = np.zeros(len(places))
                for feature, cut, left, right, value in tables:
                    node = np.zeros(len(places), np.int64)
                    while len(inner := np.flatnonzero(feature[node] >= 0)):
                        at = node[inner]
                        b = seen[inner, np.searchsorted(used, feature[at])]
                        over = np.where(cut[at] > 0, b >= cut[at], b > cut[at])
                        node[inner] = np.where(over, right[at], left[at])
                    total += value[node]
                yield pa.array(total)

        margins.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
        return df.withColumn(out, F.arrow_udf(margins, "double")(*_entries(self.features)))

    def predict(self, df: DataFrame) -> DataFrame:
        """Add the int column `y_pred`."""
        scored = self.with_margin(df, "_margin")
        return scored.withColumn("y_pred", (F.col("_margin") > 0).cast("int")).select(*df.columns, "y_pred")

    def gain_importance(self, names: list[str], spark: SparkSession) -> DataFrame:
        """(feature, importance): mean gain of a feature's splits; features no tree uses are left out."""
        gains: dict[int, list[float]] = {}
        for split in (s for t in self.trees for s in t.splits()):
            gains.setdefault(split.feature, []).append(split.gain)
        rows = [(names[f], float(np.mean(g))) for f, g in gains.items()]
        return spark.createDataFrame(rows, "feature string, importance double")


def _table(tree: Node) -> tuple[np.ndarray, ...]:
    """feature (-1: leaf), bin, left, right and value of the nodes of a tree, the root first."""
    nodes = [tree]
    for n in nodes:
        nodes += [] if n.feature is None else [n.left, n.right]
    place = {id(n): i for i, n in enumerate(nodes)}
    whole = [(-1, 0, 0, 0) if n.feature is None else (n.feature, n.bin, place[id(n.left)], place[id(n.right)]) for n in nodes]
    return *np.array(whole, dtype=np.int64).T, np.array([n.value for n in nodes])


class _Grower:
    """Grows trees on a frame with _codes, _g and _h (fixed point) by the settings of one fit."""

    def __init__(self, scale, max_depth, min_child, rate, reg_lambda, reg_alpha, column_share, seed):
        self.scale, self.max_depth, self.min_child, self.rate = scale, max_depth, min_child, rate
        self.reg_lambda, self.reg_alpha, self.column_share, self.seed = reg_lambda, reg_alpha, column_share, seed

    def node(self, g: int, h: int) -> Node:
        gradient, curvature = g / self.scale, h / self.scale
        below = curvature + self.reg_lambda
        return Node(gradient, curvature, -self.rate * _soft(gradient, self.reg_alpha) / below if below > 0 else 0.0)

    def best_splits(self, rows: DataFrame, nodes: dict[int, Node], sums: dict[int, tuple[int, int]], number: int) -> list:
        """The best split of each open node: _node, gain, feature, bin and the sums of the side away from zero."""
        entries = rows.select("_node", "_g", "_h", F.explode("_codes").alias("_code"))
        f = F.floor(F.col("_code") / CODES).cast("int")
        if self.column_share < 1:
            drawn = F.pmod(F.xxhash64(f, F.lit(self.seed), F.lit(number)), F.lit(_SHARES)) < int(self.column_share * _SHARES)
            entries = entries.filter(drawn)
        summed = entries.groupBy("_node", "_code").agg(F.sum("_g").alias("_g"), F.sum("_h").alias("_h"))
        b = F.col("_code") % CODES - HALF
        summed = summed.select("_node", f.alias("f"), b.alias("b"), "_g", "_h")
        outward = Window.partitionBy("_node", "f", F.signum("b")).orderBy(F.abs("b").desc()).rowsBetween(Window.unboundedPreceding, 0)
        far = summed.select("_node", "f", "b", F.sum("_g").over(outward).alias("far_g"), F.sum("_h").over(outward).alias("far_h"))
        known = rows.sparkSession.createDataFrame([(k, *sums[k]) for k in nodes], "_node int, all_g long, all_h long")
        both = far.join(F.broadcast(known), "_node")

        def score(g: Column, h: Column) -> Column:
            g, h = g / self.scale, h / self.scale
            return F.pow(_soft(g, self.reg_alpha), 2) / (h + self.reg_lambda)

        near_g, near_h = F.col("all_g") - F.col("far_g"), F.col("all_h") - F.col("far_h")
        least = max(self.min_child * self.scale, 1.0)
        gain = score(F.col("far_g"), F.col("far_h")) + score(near_g, near_h) - score(F.col("all_g"), F.col("all_h"))
        allowed = both.filter((F.col("far_h") >= least) & (near_h >= least)).withColumn("gain", gain).filter(F.col("gain") > LEAST_GAIN)
        order = F.struct("gain", (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "far_g", "far_h")
        return allowed.groupBy("_node").agg(F.max(order).alias("best")).select("_node", "best.*").collect()

    def grow(self, rows: DataFrame, g: int, h: int, number: int) -> Node:
        root = self.node(g, h)
        open_, sums = {0: root}, {0: (g, h)}
        for _ in range(self.max_depth):
            place = {id(n): k for k, n in open_.items()}
            here = rows.withColumn("_node", _by_leaf(root, lambda n, place=place: F.lit(place.get(id(n))).cast("int"))).filter("_node is not null")
            following, following_sums = {}, {}
            for s in self.best_splits(here, open_, sums, number):
                n, (all_g, all_h) = open_[s._node], sums[s._node]
                n.feature, n.bin, n.gain = -s.f, -s.b, s.gain
                far, near = (s.far_g, s.far_h), (all_g - s.far_g, all_h - s.far_h)
                sides = (near, far) if n.bin > 0 else (far, near)
                n.left, n.right = (self.node(*x) for x in sides)
                for child, x in zip((n.left, n.right), sides):
                    k = len(following)
                    following[k], following_sums[k] = child, x
            open_, sums = following, following_sums
            if not open_:
                break
        return root


def fit_boosted(
    df: DataFrame, features: str = "features", label: str = "y_true", max_depth: int = 3, min_child: float = 1.0, rate: float = 0.1, trees: int = 300,
    reg_lambda: float = 1.0, reg_alpha: float = 0.0, row_share: float = 0.8, column_share: float = 0.8, key: str | None = None, bins: Bins | None = None,
    max_bins: int = 64, seed: int = DEFAULT_SEED,
) -> BoostedTrees:
    """Boosted trees for a 0/1 label, label 1 weighted by negatives over positives.

    A leaf's value is -rate x (gradient sum drawn towards 0 by `reg_alpha`) / (curvature sum + `reg_lambda`); a
    side of a split has curvature `min_child` or more. Every tree sees the rows and the features that a hash of
    `key` (by default the features and the label) and the tree's number picks. Rows with a null label take no
    part, missing values count as 0. Ties go to the smaller feature, then the lower bin. An empty table or one
    of a single class gives trees of one leaf.
    """
    spark = df.sparkSession
    y = F.col(label).cast("int")
    df = df.filter(y.isin(0, 1))
    counts = df.agg(F.coalesce(F.sum(y), F.lit(0)), F.count(F.lit(1))).first()
    positive, rows = int(counts[0]), int(counts[1])
    weight = max(rows - positive, 1) / max(positive, 1)
    bins = bins or quantile_bins(df, features, dims_of(df, features), max_bins)
    # Sums of all weights stay below 2 ** 62 as whole numbers.
    scale = 2.0 ** min(40, 62 - math.ceil(math.log2(1 + weight * positive + rows)))
    own = F.xxhash64(key) if key else F.xxhash64(*_entries(features), y)
    state = df.select(codes_of(spark, bins, features).alias("_codes"), y.alias("_y"), own.alias("_key"), F.lit(0.0).alias("_margin"))
    state = cut_lineage(state)
    grower = _Grower(scale, max_depth, min_child, rate, reg_lambda, reg_alpha, column_share, seed)
    grown: list[Node] = []
    held = None
    for number in range(trees):
        state = state.persist()
        p, w = 1.0 / (1.0 + F.exp(-F.col("_margin"))), F.when(F.col("_y") == 1, F.lit(weight)).otherwise(1.0)
        drawn = state if row_share >= 1 else state.filter(F.pmod(F.xxhash64("_key", F.lit(seed), F.lit(number)), F.lit(_SHARES)) < int(row_share * _SHARES))
        ready = drawn.select("_codes", F.round(w * (p - F.col("_y")) * scale).cast("long").alias("_g"), F.round(w * p * (1 - p) * scale).cast("long").alias("_h"))
        # This pass also fills the cache, from that of the tree before.
        g, h = ready.agg(F.coalesce(F.sum("_g"), F.lit(0)), F.coalesce(F.sum("_h"), F.lit(0))).first()
        if held is not None:
            held.unpersist()
        held = state
        grown.append(grower.grow(ready, g, h, number))
        state = state.withColumn("_margin", F.col("_margin") + _by_leaf(grown[-1], lambda n: F.lit(n.value)))
        if (number + 1) % TREES_PER_CUT == 0:
            state = cut_lineage(state)
    if held is not None:
        held.unpersist()
    return BoostedTrees(grown, bins, features)

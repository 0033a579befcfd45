"""Exact medians at scale, imputing, scaling and class weights."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S
from tidemark.functions.bounds import checked_small
from tidemark.operators.ranking import safe_keys

log = logging.getLogger(__name__)

#: Cut points for the sketch; they only decide how few values are left to rank, never the result.
_CUTS = (0.05, 0.25, 0.4, 0.45, 0.49, 0.499, 0.5, 0.501, 0.51, 0.55, 0.6, 0.75, 0.95)


def numeric(df: DataFrame, name: str) -> Column:
    return S.to_num(F.col(f"`{name}`"), df.schema[name].dataType)


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("cid"), numeric(df, c).alias("v")) for i, c in enumerate(cols)])
    return df.select(*by, F.explode(cells).alias("e")).select(*by, "e.cid", "e.v").filter(F.col("v").isNotNull())


def median_table(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact median per column (and per `by` group) as rows (by..., cid, median).

    The built-in exact median keeps every distinct value of a group in one buffer. Here a quantile
    sketch splits the value range, exact bucket counts show which bucket holds the middle rank, and
    only that bucket's distinct values are ranked. The counts make the result exact whatever the
    sketch's error. The sketch rows, one per column and group, are read to the driver and broadcast.
    """
    by = list(by)
    # A null group is a group: joins go by stand-ins that are never null.
    x, safe = safe_keys(_long(df, cols, by), by)
    joined = [*safe, "cid"]
    keys = [*by, *joined]
    sketch = x.groupBy(*keys).agg(F.percentile_approx("v", list(_CUTS), 2000).alias("cuts"))
    # Read once: both uses below must see the same cut points, and a sketch may differ when re-run.
    cuts = checked_small(sketch.drop(*by))
    b = x.join(cuts, joined, "inner").select(
        *keys, "v", F.size(F.filter("cuts", lambda q: q < F.col("v"))).alias("bucket")
    )
    per_value = b.groupBy(*keys, "bucket")
    w = W.partitionBy(*keys)
    upto = w.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = per_value.agg(F.count(F.lit(1)).alias("c")).withColumns(
        {"before": F.coalesce(F.sum("c").over(upto), F.lit(0)), "n": F.sum("c").over(w)}
    )
    lo = F.floor((F.col("n") + 1) / 2)
    hi = F.floor(F.col("n") / 2) + 1
    inside = (hi > F.col("before")) & (lo <= F.col("before") + F.col("c"))
    wanted = sizes.filter(inside).select(*joined, "bucket", "before", lo.alias("lo"), hi.alias("hi"))
    values = b.join(wanted, [*joined, "bucket"], "inner").groupBy(*keys, "bucket", "before", "lo", "hi", "v").agg(
        F.count(F.lit(1)).alias("c")
    )
    run = W.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = values.withColumn("last", F.col("before") + F.sum("c").over(run))

    def at(rank):
        # The bucket that holds this rank has its first value whose running count reaches it.
        hit = (F.col("last") >= F.col(rank)) & (F.col("last") - F.col("c") < F.col(rank))
        return F.max(F.when(hit, F.col("v")))

    return ranked.groupBy(*keys).agg(((at("lo") + at("hi")) / 2).alias("median")).drop(*safe)


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column; a column without any value maps to None."""
    found = {r["cid"]: r["median"] for r in median_table(df, cols).collect()}  # one row per column
    return {c: found.get(i) for i, c in enumerate(cols)}


@dataclass(frozen=True)
class NumericPrep:
    """Fitted fill values, means and deviations per column; applied as plain expressions."""

    cols: tuple[str, ...]
    fill: Mapping[str, float]
    mean: Mapping[str, float] | None = None
    std: Mapping[str, float] | None = None
    log1p: frozenset[str] = frozenset()

    def expressions(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for c in self.cols:
            e = F.coalesce(numeric(df, c), F.lit(float(self.fill[c])))
            if c in self.log1p:
                e = S.heavy_tail(e)
            if self.mean is not None:
                scale = self.std[c] if self.std[c] else 1.0
                e = (e - F.lit(float(self.mean[c]))) / F.lit(float(scale))
            out[c] = e
        return out

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c + suffix: e for c, e in self.expressions(df).items()})


def fit_median_imputer(df: DataFrame, cols: Sequence[str]) -> NumericPrep:
    """Median fill per column. A column without values stays and is filled with 0 (and reported)."""
    medians = exact_medians(df, cols)
    empty = [c for c, m in medians.items() if m is None]
    if empty:
        log.warning("columns without any value are filled with 0: %s", empty)
    return NumericPrep(tuple(cols), {c: 0.0 if m is None else m for c, m in medians.items()})


def fit_zero_filler(cols: Sequence[str]) -> NumericPrep:
    return NumericPrep(tuple(cols), {c: 0.0 for c in cols})


def fit_standardizer(df: DataFrame, prep: NumericPrep, log1p_cols: Sequence[str] = ()) -> NumericPrep:
    """Mean and population deviation of the filled columns; zero deviation divides by one."""
    base = NumericPrep(prep.cols, prep.fill, log1p=frozenset(log1p_cols) & frozenset(prep.cols))
    if not base.cols:
        return base
    e = base.expressions(df)
    row = df.agg(
        *[F.avg(e[c]).alias(f"m{i}") for i, c in enumerate(base.cols)],
        *[F.stddev_pop(e[c]).alias(f"s{i}") for i, c in enumerate(base.cols)],
    ).first()
    mean = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(base.cols)}
    std = {c: row[f"s{i}"] or 0.0 for i, c in enumerate(base.cols)}
    return NumericPrep(base.cols, base.fill, mean, std, base.log1p)


def fit_numeric(df: DataFrame, cols: Sequence[str], fill: str = "median", scale: bool = True, log1p_cols: Sequence[str] = ()) -> NumericPrep:
    """Imputer plus optional standardizer in one go; `fill` is median or zero."""
    prep = fit_median_imputer(df, cols) if fill == "median" else fit_zero_filler(cols)
    return fit_standardizer(df, prep, log1p_cols) if scale else prep


def log1p_columns(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    return df.withColumns({c + suffix: S.heavy_tail(numeric(df, c)) for c in cols})


def class_counts(df: DataFrame, label: str = "label") -> dict[int, int]:
    return {int(r[0]): int(r[1]) for r in df.groupBy(label).count().collect()}  # two labels


def positive_weight(df: DataFrame, label: str = "label") -> float:
    """max(negatives, 1) / max(positives, 1)."""
    n = class_counts(df, label)
    return max(n.get(0, 0), 1) / max(n.get(1, 0), 1)


def class_weights(df: DataFrame, kind: str = "balanced", label: str = "label", out: str = "weight") -> DataFrame:
    """Row weights: n / (classes x class count), or the positive-class ratio on positives."""
    if kind == "positive":
        return df.withColumn(out, F.when(F.col(label) == 1, F.lit(positive_weight(df, label))).otherwise(F.lit(1.0)))
    if kind != "balanced":
        raise ValueError("kind must be 'balanced' or 'positive'")
    counts = class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(None).cast(T.DoubleType())
    for c, nc in counts.items():
        weight = F.when(F.col(label) == c, F.lit(n / (k * nc))).otherwise(weight)
    return df.withColumn(out, weight)

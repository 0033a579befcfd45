"""Top-n per key, exact global ranks in hash order, and small report rankings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fan-in of one step of the large-n reduction tree.
TREE_FAN_IN = 1024


def _keep(df: DataFrame, keys: list, order: Sequence[Column], n: int) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Exactly the first `n` rows of every key in the given total order.

    For `n` up to the planner's window group limit every task keeps only `n` rows per key before
    the shuffle, so a key with a third of all rows sends `n` rows per task. Beyond that limit the
    planner sends whole groups; rows are then cut in a tree (per input partition, per group of
    partitions, per key), so no task ever holds a whole hot key.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        df = df.withColumn("_part", F.spark_partition_id())
        df = _keep(df, [*keys, "_part"], order, n)
        df = df.withColumn("_part", F.col("_part") % TREE_FAN_IN)
        df = _keep(df, [*keys, "_part"], order, n).drop("_part")
    return _keep(df, list(keys), order, n)


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality over paired key columns (`left[i] <=> right[i]`)."""
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def safe_keys(df: DataFrame, cols: Sequence[str], prefix: str = "_k") -> tuple[DataFrame, list[str]]:
    """Add never-null stand-ins for key columns: the value as text and a null mark.

    A null-safe join rewrites its keys and so cannot reuse a window's partitioning; plain equality
    on these columns means the same and can.
    """
    names: dict[str, Column] = {}
    for i, c in enumerate(cols):
        names[f"{prefix}{i}"] = F.coalesce(F.col(c).cast("string"), F.lit(""))
        names[f"{prefix}n{i}"] = F.col(c).isNull()
    return (df.withColumns(names) if names else df), list(names)


def hash_of(seed: Sequence[Column | str | int], key: Sequence[str]) -> Column:
    parts = [s if isinstance(s, Column) else F.lit(str(s)) for s in seed]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], *[F.col(k).cast("string") for k in key]))


def hash_rank(
    df: DataFrame,
    key: Sequence[str],
    seed: Sequence[Column | str | int],
    within: Sequence[str] = (),
    rank: str = "hash_rank",
    total: str | None = None,
    prefix_digits: int = 3,
) -> DataFrame:
    """1-based rank of each row in md5 order inside its group, equal to a plain `row_number`.

    A plain window would sort each group (say, one of two labels) in one task. Hash prefixes are
    uniform and keep the order, so rows are ranked inside 16**prefix_digits even buckets per group
    and shifted by the bucket counts before them.
    """
    if within:
        t, group_cols = safe_keys(df, within, "_g")
    else:
        t, group_cols = df.withColumn("_g", F.lit(0)), ["_g"]
    t = t.withColumn("_h", hash_of(seed, key)).withColumn("_b", F.substring("_h", 1, prefix_digits))
    bucket = [*group_cols, "_b"]
    sizes = t.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_c"))
    group = W.partitionBy(*group_cols)
    before = group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *bucket, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), F.sum("_c").over(group).alias("_total")
    )
    # The join reuses the partitioning of this window, so rows are shuffled once.
    ranked = t.withColumn("_in", F.row_number().over(W.partitionBy(*bucket).orderBy("_h", *key)))
    out = ranked.join(offsets, bucket, "inner").withColumn(rank, F.col("_in") + F.col("_off"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_h", "_in", "_off", "_total", *bucket)


def top_features(imp: DataFrame, value: str, k: int = 100, by: Sequence[str] = ("fold",), name: str = "feature") -> DataFrame:
    """The k most important features of every fold, name as tiebreak, with their rank."""
    w = W.partitionBy(*by).orderBy(F.desc(value), F.asc(name))
    return imp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_clusters(rows: DataFrame, k: int, value: str, cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """Clusters with the largest sums; sums are combined map-side, only cluster totals are ranked."""
    totals = rows.groupBy(*by, cluster).agg(F.sum(value).alias(value))
    if not by:
        return totals.orderBy(F.desc(value), F.asc(cluster)).limit(k)
    w = W.partitionBy(*by).orderBy(F.desc(value), F.asc(cluster))
    return totals.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")

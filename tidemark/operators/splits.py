"""Reproducible stratified folds, holdouts and permutations, decided by key hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import hash_rank, same_keys

DEFAULT_SEED = 555


def stratified_folds(df: DataFrame, label: str = "label", k: int = 5, seed: int = DEFAULT_SEED, key: str = "username", out: str = "fold") -> DataFrame:
    """Add a fold 1..k: per label, rows go round-robin in hash order, so counts differ by at most one."""
    ranked = hash_rank(df, [key], [seed], within=[label], rank="_hr")
    return ranked.withColumn(out, ((F.col("_hr") - 1) % k + 1).cast("int")).drop("_hr")


def stratified_holdout(df: DataFrame, label: str = "label", frac: float = 0.125, seed: int = DEFAULT_SEED, key: str = "username", within: Sequence[str] = (), out: str = "is_dev") -> DataFrame:
    """Mark round(frac x count) rows of every label (and `within` group) as the dev split."""
    ranked = hash_rank(df, [key], [seed, "dev"], within=[*within, label], rank="_hr", total="_n")
    take = F.round(F.lit(float(frac)) * F.col("_n"))
    return ranked.withColumn(out, F.col("_hr") <= take).drop("_hr", "_n")


def with_donors(df: DataFrame, cols: Sequence[str], key: Sequence[str], seed: Sequence, within: Sequence[str] = (), suffix: str = "_donor") -> DataFrame:
    """Give every row the `cols` values of another row of its group, by a seeded permutation.

    Row and donor are paired by their positions in two hash orders; both ranks are computed in even
    hash buckets and the pairing is an equi-join, so a huge group is spread over all tasks.
    """
    own = hash_rank(df, key, [*seed, "row"], within=within, rank="_pos")
    donor = hash_rank(df, key, [*seed, "donor"], within=within, rank="_dpos").select(
        *[F.col(c).alias("_w_" + c) for c in within],
        "_dpos",
        *[F.col(c).alias(c + suffix) for c in cols],
    )
    pairs = same_keys([*within, "_pos"], ["_w_" + c for c in within] + ["_dpos"])
    return own.join(donor, pairs, "inner").drop("_pos", "_dpos", *["_w_" + c for c in within])


def permute_column(df: DataFrame, col: str, key: Sequence[str], group: Sequence[str] = (), seed: int = DEFAULT_SEED) -> DataFrame:
    """Seeded permutation of one column inside each group; the multiset of values is kept."""
    out = with_donors(df, [col], key, [seed], within=group, suffix="_donor")
    return out.withColumn(col, F.col(col + "_donor")).drop(col + "_donor")

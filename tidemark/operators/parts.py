"""Histories in several text parts: the user stays one unit in folds, terms and vectors.

A history longer than one text value holds is several rows (user, part). Folds are assigned to users,
n-grams go on over the borders of parts, and counts are summed over a user's parts before anything is
weighted, so every result equals that of the history in one piece.
"""

from __future__ import annotations

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import gram_at, long_tokens
from tidemark.operators.splits import DEFAULT_SEED, stratified_folds, stratified_holdout


def one_row(parts: DataFrame, user: str = "user", part: str = "part") -> DataFrame:
    """The row of each user's first part; what is stored per user is the same on all of them."""
    first = parts.groupBy(user).agg(F.min(part).alias(part))
    same = parts[user].eqNullSafe(first[user]) & parts[part].eqNullSafe(first[part])
    return parts.join(first, same, "left_semi")


def user_folds(parts: DataFrame, label: str = "label", k: int = 5, seed: int = DEFAULT_SEED, user: str = "user", part: str = "part", out: str = "fold") -> DataFrame:
    """Add a fold 1..k that all parts of a user share, balanced over users per label."""
    return _shared(parts, stratified_folds(one_row(parts, user, part).select(user, label), label, k, seed, user, out), user, out)


def user_holdout(parts: DataFrame, label: str = "label", frac: float = 0.125, seed: int = DEFAULT_SEED, user: str = "user", part: str = "part", out: str = "is_dev") -> DataFrame:
    """Mark round(frac x users) users of every label, with all their parts."""
    return _shared(parts, stratified_holdout(one_row(parts, user, part).select(user, label), label, frac, seed, user, (), out), user, out)


def _shared(parts: DataFrame, units: DataFrame, user: str, out: str) -> DataFrame:
    units = units.select(F.col(user).alias("_unit"), out)
    return parts.drop(out).join(units, F.col(user).eqNullSafe(F.col("_unit")), "inner").drop("_unit")


def with_carry(parts: DataFrame, n: int, user: str = "user", part: str = "part", tokens: str = "tokens") -> DataFrame:
    """Add `_kept`, the tokens n-grams are built from, and `_carry`, the last n - 1 of them in earlier parts.

    The window runs over slim rows, the last tokens of each part; parts without tokens are not among
    them, so the n - 1 parts before always hold enough.
    """
    kept = parts.withColumn("_kept", long_tokens(F.coalesce(tokens, F.array().cast("array<string>"))))
    if n == 1:
        return kept.withColumn("_carry", F.array().cast("array<string>"))
    size = F.size("_kept")
    tails = kept.filter(size > 0).select(F.col(user).alias("_u"), F.col(part).alias("_p"), F.slice("_kept", -F.least(size, F.lit(n - 1)), F.least(size, F.lit(n - 1))).alias("_tail"))
    order = W.partitionBy("_u").orderBy("_p")
    none = F.array().cast("array<string>")
    before = F.concat(*[F.coalesce(F.lag("_tail", k).over(order), none) for k in range(n - 1, 0, -1)])
    last = F.least(F.size("_before"), F.lit(n - 1))
    carried = tails.withColumn("_before", before).select("_u", "_p", F.when(last > 0, F.slice("_before", -last, last)).otherwise(none).alias("_carry"))
    same = F.col(user).eqNullSafe(F.col("_u")) & F.col(part).eqNullSafe(F.col("_p"))
    return kept.join(carried, same, "left").drop("_u", "_p").withColumn("_carry", F.coalesce("_carry", none))


def _ending_here(carry: str, kept: str, max_n: int) -> Column:
    """All 1..max_n grams of carry + kept (the column `_all`) whose last token is in kept."""
    grams = [F.col(kept)]
    for n in range(2, max_n + 1):
        first = F.greatest(F.size(carry) - (n - 1), F.lit(0))
        last = F.size(carry) + F.size(kept) - n
        at = F.transform(F.sequence(first, last), gram_at(F.col("_all"), n))
        grams.append(F.when((F.size(kept) > 0) & (last >= first), at).otherwise(F.array().cast("array<string>")))
    return F.concat(*grams) if len(grams) > 1 else grams[0]


def with_part_terms(parts: DataFrame, max_n: int, user: str = "user", part: str = "part", tokens: str = "tokens", out: str = "terms") -> DataFrame:
    """Add the 1..max_n grams that end in each part; over a user's parts they are those of the whole text."""
    carried = with_carry(parts, max_n, user, part, tokens).withColumn("_all", F.concat("_carry", "_kept"))
    return carried.withColumn(out, _ending_here("_carry", "_kept", max_n)).drop("_kept", "_carry", "_all")


def unit_vectors(weights: DataFrame, size: int, user: str = "user", out: str = "bow") -> DataFrame:
    """(user, sparse vector) of long rows (user, idx, weight); a user holds at most `size` of them."""
    sparse = F.udf(lambda cells: Vectors.sparse(size, [c["idx"] for c in cells], [c["weight"] for c in cells]), VectorUDT())
    cells = F.array_sort(F.collect_list(F.struct("idx", "weight")))
    return weights.groupBy(user).agg(cells.alias("_cells")).select(user, sparse("_cells").alias(out))


def with_unit_vectors(units: DataFrame, weights: DataFrame, size: int, user: str = "user", out: str = "bow") -> DataFrame:
    """One-row-per-user table with its vector; a user without known terms has zeros."""
    vectors = unit_vectors(weights, size, user, "_v").withColumnRenamed(user, "_u")
    empty = F.udf(lambda: Vectors.sparse(size, [], []), VectorUDT())
    joined = units.drop(out).join(vectors, F.col(user).eqNullSafe(F.col("_u")), "left")
    return joined.withColumn(out, F.coalesce("_v", empty())).drop("_u", "_v")


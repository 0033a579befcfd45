"""History cuts, newest-post windows, capped takes and per-user text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.bounds import broadcast_if_bounded
from tidemark.operators.numeric import exact_medians
from tidemark.operators.ranking import newest_per_key, safe_keys

# Crawl limits per user, over all users and per page.
TIMELINE_MAX = 3200
QUOTA = 25_000
PAGE = 100
#: Buckets that a user's posts without a time are ranked in, before all others.
UNTIMED_BUCKETS = 1024


def found_users(roster: DataFrame) -> DataFrame:
    return roster.filter(F.col("user_found") == F.lit(True))


def user_keys(df: DataFrame, user: str = "user") -> DataFrame:
    return df.select(F.col(user).cast("string").alias(user)).distinct().orderBy(user)


def last_n(posts: DataFrame, n: int = 100, user: str = "user", ts: str = "ts", tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    """The n newest posts of every user; null times are the oldest, later input wins a tie."""
    order = [F.desc_nulls_last(ts), *[F.desc_nulls_last(c) for c in tiebreak]]
    return newest_per_key(posts, [user], order, n)


def _is_original(posts: DataFrame) -> Column:
    return ~(F.col("is_retweet") | F.col("is_quote") | F.col("is_reply"))


def type1_history(
    posts: DataFrame,
    trigger: Column,
    fallback: str | None = "median_span",
    equivalent_point_for: Column | None = None,
    user: str = "user",
    ts: str = "ts",
) -> DataFrame:
    """Early-detection cut: originals strictly before the user's first trigger post.

    Users who never trigger, and by `equivalent_point_for` any others (say, the reliable class),
    are cut at their first post plus the median first-post-to-trigger span of the triggering users;
    with `fallback=None` they are dropped. If no user triggers there is no such point, and all
    originals with a time stay. The cut is one map-side-combined aggregate joined back,
    so no user's history is gathered in one task.
    """
    if fallback not in (None, "median_span"):
        raise ValueError("fallback must be None or 'median_span'")
    us = F.unix_micros(F.col(ts))
    moved = F.coalesce(equivalent_point_for, F.lit(False)) if equivalent_point_for is not None else F.lit(False)
    cuts = posts.groupBy(F.col(user).alias("_u")).agg(
        F.min(us).alias("_first"),
        F.min(F.when(trigger, us)).alias("_trigger"),
        F.max(moved).alias("_moved"),
    )
    own = F.when(~F.col("_moved"), F.col("_trigger"))
    if fallback is None:
        cuts = cuts.select("_u", own.alias("_cut")).filter(F.col("_cut").isNotNull())
    else:
        # One row per user; the median reads it more than once.
        spans = cuts.select((own - F.col("_first")).cast("double").alias("span")).persist(StorageLevel.MEMORY_AND_DISK)
        span = exact_medians(spans, ["span"])["span"]
        spans.unpersist()
        cuts = cuts.select("_u", F.coalesce(own, F.col("_first") + F.lit(span)).alias("_cut"))
    kept = posts.filter(_is_original(posts))
    if fallback is not None and span is None:
        # Whoever triggers is moved, or nobody does: there is no point to cut at.
        return kept.filter(us.isNotNull())
    return kept.join(cuts, F.col(user).eqNullSafe(F.col("_u")), "inner").filter(us < F.col("_cut")).drop("_u", "_cut")


def type2_history(posts: DataFrame, cutoff: Column, direct_repost: Column | None = None, ts: str = "ts") -> DataFrame:
    """Full history up to a collection date without retweets and direct reposts."""
    keep = ~F.col("is_retweet") & (F.col(ts) <= cutoff)
    if direct_repost is not None:
        keep = keep & ~F.coalesce(direct_repost, F.lit(False))
    return posts.filter(keep)


def capped_take(
    posts: DataFrame,
    roster: DataFrame,
    per_user: int = TIMELINE_MAX,
    quota: int = QUOTA,
    page: int = PAGE,
    user: str = "user",
    ts: str = "ts",
    tiebreak: Sequence[str] = ("id",),
) -> DataFrame:
    """What a quota-bound crawl would bring in: newest posts, users in roster order.

    Each user offers min(total_posts, per_user, posts at hand); pages of `page` are taken while the
    running total is below `quota`. At most `quota` users with any post can be reached, so the
    running total is computed over that many rows and the winners are broadcast.
    """
    have = posts.groupBy(F.col(user).alias("_u")).agg(F.count(F.lit(1)).alias("_have"))
    offer = (
        roster.select(F.col(user).alias("_r"), "roster_order", F.least(F.col("total_posts"), F.lit(per_user)).alias("_cap"))
        .join(have, F.col("_r") == F.col("_u"), "inner")
        .select("_u", "roster_order", F.least("_cap", "_have").cast("long").alias("_offer"))
        .filter(F.col("_offer") > 0)
        .orderBy("roster_order")
        .limit(quota)
    )
    running = W.orderBy("roster_order").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_offer").over(running), F.lit(0))
    pages = F.ceil((F.lit(quota) - F.col("_before")) / F.lit(page))
    takes = (
        offer.withColumn("_before", before)
        .filter(F.col("_before") < quota)
        .select("_u", F.least(F.col("_offer"), pages * page).alias("_take"))
    )
    mine = posts.join(broadcast_if_bounded(takes, quota), F.col(user) == F.col("_u"), "inner")
    order = [F.desc_nulls_last(ts), *[F.desc_nulls_last(c) for c in tiebreak]]
    mine = newest_per_key(mine, [user], order, per_user)
    rn = F.row_number().over(W.partitionBy(user).orderBy(*order))
    return (
        mine.withColumn("_rn", rn)
        .filter(F.col("_rn") <= F.col("_take"))
        .withColumn("page", F.ceil(F.col("_rn") / F.lit(page)).cast("int"))
        .drop("_u", "_take", "_rn")
    )


def ordered_parts(
    posts: DataFrame,
    max_posts: int = TIMELINE_MAX,
    user: str = "user",
    ts: str = "ts",
    tiebreak: Sequence[str] = ("id",),
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Add `part`: consecutive time-ordered slices of at most `max_posts` posts per user.

    The rank of a post is the count of the user's earlier hours plus its rank inside its hour, so
    a user with a third of all posts is ranked by many tasks. Every post gets a part.
    """
    # Posts without a time have no order to keep but a stable one, so hashes of their tie-break split them.
    untimed = F.pmod(F.xxhash64(*tiebreak), F.lit(UNTIMED_BUCKETS)) - 2**62 if tiebreak else F.lit(-(2**62))
    bucket = F.coalesce(F.floor(F.unix_micros(ts) / F.lit(bucket_seconds * 1_000_000)), untimed)
    t, who = safe_keys(posts.withColumn("_b", bucket), [user], "_u")
    hour = [*who, "_b"]
    sizes = t.groupBy(*hour).agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*who).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*hour, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*hour).orderBy(F.asc_nulls_first(ts), *[F.asc_nulls_first(c) for c in tiebreak])
    # The join reuses the partitioning of this window.
    joined = t.withColumn("_in", F.row_number().over(inside)).join(offsets, hour, "inner")
    rank = F.col("_off") + F.col("_in") - 1
    return joined.withColumn("part", F.floor(rank / F.lit(max_posts)).cast("int")).drop("_off", "_in", *hour)


def aggregate_text(
    posts: DataFrame,
    max_posts: int = TIMELINE_MAX,
    user: str = "user",
    ts: str = "ts",
    text: str = "text",
    tiebreak: Sequence[str] = ("id",),
) -> DataFrame:
    """`aggr_text`: a user's posts joined by a space in time order.

    One row per user up to `max_posts` (the longest timeline the feed returns); longer histories
    continue in further rows (part 1, 2, ...) instead of one unbounded string, nothing is dropped.
    """
    parts = ordered_parts(posts, max_posts, user, ts, tiebreak)
    entry = F.struct(
        F.unix_micros(ts).alias("t"),
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(tiebreak)],
        F.coalesce(F.col(text), F.lit("")).alias("x"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]), " ")
    return parts.groupBy(user, "part").agg(joined.alias("aggr_text"), F.count(F.lit(1)).alias("n_posts"))

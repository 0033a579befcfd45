"""Per-user behaviour features over the newest posts, and user ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.columns import resolve_columns
from tidemark.operators.timeline import last_n

# Output columns of the behaviour table.
HU_COLUMNS = (
    "user", "HU_R_TweetNum", "HU_R_TweetPercent_Original", "HU_R_TweetPercent_Retweet",
    "HU_R_TweetPercent_Quote", "HU_R_TweetPercent_Reply", "HU_R_RetweetPercent", "HU_R_QuotePercent",
    "HU_R_ReplyPercent", "HU_R_InteractivePer", "HU_R_AverageInterval_days", "HU_R_RetweetedRate",
    "HU_R_QuotedRate", "HU_R_RepliedRate",
)
DEFAULT_WINDOW = 100


def canonical_posts(
    df: DataFrame,
    overrides: Mapping[str, str | None] | None = None,
    tiebreak: Sequence[str] = ("id",),
    strict_reference: bool = False,
) -> DataFrame:
    """Any post table to (user, ts, flags, counts, text, tiebreak), reading only the columns it needs."""
    roles = resolve_columns(df, overrides)
    types = {f.name: f.dataType for f in df.schema.fields}

    def col(role):
        return F.col(f"`{roles[role]}`")

    def flag(role, expr):
        return F.lit(False) if roles[role] is None else expr(col(role), types[roles[role]])

    def count(role):
        return F.lit(None).cast("double") if roles[role] is None else S.to_num(col(role), types[roles[role]])

    if roles["rt"] is not None:
        rt = S.as_flag(col("rt"), types[roles["rt"]], strict_reference)
    elif roles["text"] is not None:
        rt = S.retweet_from_text(col("text"))
    else:
        rt = F.lit(False)
    quote = flag("quote", lambda c, t: S.quote_flag(c, t, strict_reference))
    reply = flag("reply", lambda c, t: S.reply_flag(c, t, roles["reply"], strict_reference))
    out = df.select(
        col("user").alias("user"),
        S.instant(col("ts"), types[roles["ts"]]).alias("ts"),
        rt.alias("is_retweet"),
        quote.alias("is_quote"),
        reply.alias("is_reply"),
        count("rt_count").alias("retweet_count"),
        count("qt_count").alias("quote_count"),
        count("rp_count").alias("reply_count"),
        (col("text").cast("string") if roles["text"] else F.lit(None).cast("string")).alias("text"),
        *[F.col(f"`{c}`") for c in tiebreak],
    )
    return out.withColumn("is_original", ~(F.col("is_retweet") | F.col("is_quote") | F.col("is_reply")))


def hu_features(posts: DataFrame, n: int = DEFAULT_WINDOW, rates_on_originals: bool = False, tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    """Counts, shares, mean interval and mean engagement over each user's n newest posts.

    One shuffle by user: the window's partitioning also serves the aggregate. The mean gap between
    sorted posts telescopes to (last - first) / (posts - 1), so no second sort is needed.
    """
    win = last_n(posts, n, tiebreak=tiebreak)

    def hits(c):
        return F.count_if(F.col(c))

    def rate(c):
        v = S.nan_to_null(F.col(c))
        return F.avg(F.when(F.col("is_original"), v) if rates_on_originals else v)

    us = F.unix_micros("ts")
    agg = win.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"),
        hits("is_original").alias("o"),
        hits("is_retweet").alias("rt"),
        hits("is_quote").alias("q"),
        hits("is_reply").alias("rp"),
        F.count("ts").alias("nts"),
        (F.max(us) - F.min(us)).alias("span"),
        rate("retweet_count").alias("HU_R_RetweetedRate"),
        rate("quote_count").alias("HU_R_QuotedRate"),
        rate("reply_count").alias("HU_R_RepliedRate"),
    )
    n_ = F.col("n")
    shares = {c: S.safe_div(F.col(c), n_) for c in ("o", "rt", "q", "rp")}
    return agg.select(
        "user",
        n_.alias("HU_R_TweetNum"),
        shares["o"].alias("HU_R_TweetPercent_Original"),
        shares["rt"].alias("HU_R_TweetPercent_Retweet"),
        shares["q"].alias("HU_R_TweetPercent_Quote"),
        shares["rp"].alias("HU_R_TweetPercent_Reply"),
        shares["rt"].alias("HU_R_RetweetPercent"),
        shares["q"].alias("HU_R_QuotePercent"),
        shares["rp"].alias("HU_R_ReplyPercent"),
        S.safe_div(F.col("rt") + F.col("q") + F.col("rp"), n_).alias("HU_R_InteractivePer"),
        S.safe_div(F.col("span") / F.lit(S.DAY_US), F.col("nts") - 1).alias("HU_R_AverageInterval_days"),
        "HU_R_RetweetedRate",
        "HU_R_QuotedRate",
        "HU_R_RepliedRate",
    )


def user_ratios(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """follower_to_followee_ratio, retweet_ratio and mean retweet_count per user."""
    per_user = posts.groupBy("user").agg(
        S.safe_div(F.count_if(F.col("is_retweet")), F.count(F.lit(1))).alias("retweet_ratio"),
        F.avg(S.nan_to_null(F.col("retweet_count"))).alias("retweet_count"),
    )
    prof = profiles.select(
        F.col("user").alias("_p"),
        S.safe_div(F.col("followers_count"), F.col("following_count")).alias("follower_to_followee_ratio"),
    )
    return per_user.join(prof, F.col("user").eqNullSafe(F.col("_p")), "left").drop("_p")

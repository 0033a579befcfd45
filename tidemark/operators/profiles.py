"""Profile features, their fallback from post columns, and the final user table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S
from tidemark.operators.behaviour import HU_COLUMNS
from tidemark.operators.columns import conform, resolve_columns

# Output columns of the final user table.
PROFILE_COLUMNS = (
    "U_R_AccountAge_days", "U_R_ListedNum", "U_R_ProfileUrl", "U_R_FollowerNumDay", "U_R_FolloweeNumDay",
    "U_R_TweetNumDay", "U_R_ListedNumDay", "followers_count", "following_count", "tweet_count",
)
FINAL_COLUMNS = (*HU_COLUMNS, *PROFILE_COLUMNS, "username", "id")


def _num(df: DataFrame, name: str) -> Column:
    return S.to_num(F.col(f"`{name}`"), df.schema[name].dataType)


def _per_day(age: Column, followers: Column, following: Column, tweets: Column, listed: Column) -> list[Column]:
    return [
        S.safe_div(followers, age).alias("U_R_FollowerNumDay"),
        S.safe_div(following, age).alias("U_R_FolloweeNumDay"),
        S.safe_div(tweets, age).alias("U_R_TweetNumDay"),
        S.safe_div(listed, age).alias("U_R_ListedNumDay"),
        followers.alias("followers_count"),
        following.alias("following_count"),
        tweets.alias("tweet_count"),
    ]


def profile_features(profiles: DataFrame, now_ts: Column, key: str = "key") -> DataFrame:
    """Age in fractional days, listed count, url flag and per-day rates from profile snapshots."""
    created = S.instant(F.col("created_at"), profiles.schema["created_at"].dataType)
    base = profiles.select(
        F.col(key).alias("user"),
        F.col("username").cast("string").alias("username"),
        F.col("id").cast("string").alias("id"),
        S.account_age_days(created, now_ts).alias("age"),
        _num(profiles, "listed_count").alias("listed"),
        F.coalesce(_num(profiles, "has_profile_url"), F.lit(0.0)).cast("int").alias("url"),
        _num(profiles, "followers_count").alias("fr"),
        _num(profiles, "following_count").alias("fg"),
        _num(profiles, "tweet_count").alias("tw"),
    )
    age, listed = F.col("age"), F.col("listed")
    return base.select(
        "user", "username", "id",
        age.alias("U_R_AccountAge_days"), listed.alias("U_R_ListedNum"), F.col("url").alias("U_R_ProfileUrl"),
        *_per_day(age, F.col("fr"), F.col("fg"), F.col("tw"), listed),
    )


def profile_fallback(posts: DataFrame, overrides: Mapping[str, str | None] | None = None, tiebreak: Sequence[str] = ("id",)) -> DataFrame:
    """Profile features from profile columns repeated on every post: each user's newest values.

    Age comes from a day column, else from years x 365.25. The url flag is unknown.
    """
    roles = resolve_columns(posts, overrides)

    def num(role):
        return _num(posts, roles[role]) if roles[role] else F.lit(None).cast("double")

    if roles["csv_age_days"]:
        age = num("csv_age_days")
    elif roles["csv_age_years"]:
        age = S.years_to_days(num("csv_age_years"))
    else:
        age = F.lit(None).cast("double")
    ts = S.instant(F.col(f"`{roles['ts']}`"), posts.schema[roles["ts"]].dataType)
    # A struct orders nulls first, so posts without a time lose to dated ones.
    order = F.struct(F.unix_micros(ts).alias("t"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(tiebreak)])
    newest = F.struct(
        age.alias("age"), num("csv_listed").alias("listed"), num("csv_followers").alias("fr"),
        num("csv_following").alias("fg"), num("csv_tweet_total").alias("tw"),
    )
    last = posts.groupBy(F.col(f"`{roles['user']}`").alias("user")).agg(F.max_by(newest, order).alias("v"))
    age, listed = F.col("v.age"), F.col("v.listed")
    return last.select(
        "user",
        F.lit(None).cast("string").alias("username"),
        F.lit(None).cast("string").alias("id"),
        age.alias("U_R_AccountAge_days"),
        listed.alias("U_R_ListedNum"),
        F.lit(None).cast("int").alias("U_R_ProfileUrl"),
        *_per_day(age, F.col("v.fr"), F.col("v.fg"), F.col("v.tw"), listed),
    )


def join_profiles(hu: DataFrame, profiles: DataFrame) -> DataFrame:
    """Left join on user; a null user matches a null user."""
    prof = profiles.withColumnRenamed("user", "_p")
    return hu.join(prof, F.col("user").eqNullSafe(F.col("_p")), "left").drop("_p")


def user_features(hu: DataFrame, profiles: DataFrame) -> DataFrame:
    """The final 26-column user table."""
    joined = join_profiles(hu, profiles)
    types = {"user": hu.schema["user"].dataType, "HU_R_TweetNum": T.LongType(), "U_R_ProfileUrl": T.IntegerType(),
             "username": T.StringType(), "id": T.StringType()}
    schema = T.StructType([T.StructField(c, types.get(c, T.DoubleType())) for c in FINAL_COLUMNS])
    return conform(joined, schema)


def crawl_profile_stats(profiles: DataFrame, now_ts: Column) -> DataFrame:
    """Snapshot columns of the crawl: whole-day age in years and posts per year."""
    created = S.instant(F.col("created_at"), profiles.schema["created_at"].dataType)
    tweets = _num(profiles, "tweet_count")
    return profiles.withColumns(
        {
            "account_age_years": S.account_age_years_whole(created, now_ts),
            "posting_frequency": S.posting_frequency(tweets, created, now_ts),
        }
    )


def attach_profile(roster: DataFrame, profiles: DataFrame, on: str = "username") -> DataFrame:
    """Roster rows with a profile; users whose profile is missing drop out."""
    return roster.join(profiles, on, "inner")

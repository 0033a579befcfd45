"""Column roles, checks and shapes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names under which each role may appear, in order of preference.
ROLE_ALIASES: dict[str, tuple[str, ...]] = {
    "user": ("username", "user_name", "user", "screen_name", "user_id"),
    "ts": ("tweet_created_at", "created_at", "timestamp", "time"),
    "rt": ("is_retweet", "retweeted", "is_rt", "retweeted_status"),
    "quote": ("is_quote", "is_quote_status", "quoted", "is_quoted", "referenced_tweets.type_quoted"),
    "reply": ("is_reply", "replied", "in_reply_to_user_id", "in_reply_to_status_id", "referenced_tweets.type_replied_to"),
    "rt_count": ("retweet_count", "retweets_count", "public_metrics.retweet_count"),
    "rp_count": ("reply_count", "replies_count", "public_metrics.reply_count"),
    "qt_count": ("quote_count", "quotes_count", "public_metrics.quote_count"),
    "text": ("tweet_text", "text", "full_text"),
    "csv_followers": ("followers_count", "follower_count", "followers"),
    "csv_following": ("following_count", "friends_count", "followees"),
    "csv_tweet_total": ("tweet_count", "statuses_count", "total_posts"),
    "csv_listed": ("listed_count", "listed_num"),
    "csv_age_years": ("account_age_years", "age_years"),
    "csv_age_days": ("account_age_days", "age_days"),
}
REQUIRED_ROLES = ("user", "ts")
OVERRIDABLE_ROLES = ("user", "ts", "rt", "quote", "reply", "rt_count", "rp_count", "qt_count", "text")

# The model-ready user columns, the subset the tree models use, and the columns that
# never count as message numerics.
USER_COLUMNS = (
    "HU_TweetNum", "HU_TweetPercent_Original", "HU_TweetPercent_Retweet", "HU_AverageInterval_days",
    "U_AccountAge_days", "U_ListedNum", "U_ProfileUrl", "U_FollowerNumDay", "U_FolloweeNumDay",
    "U_TweetNumDay", "U_ListedNumDay", "total_posts", "followers_count", "following_count",
    "verified", "posting_frequency", "retweet_count", "follower_to_followee_ratio", "retweet_ratio",
)
TREE_USER_COLUMNS = (
    "HU_TweetNum", "HU_TweetPercent_Retweet", "HU_AverageInterval_days", "U_AccountAge_days",
    "U_FolloweeNumDay", "followers_count", "following_count", "posting_frequency", "retweet_count",
    "retweet_ratio",
)
NEVER_NUMERIC = ("label", "username", "user", "user_id", "screen_name", "aggr_text")
HEAVY_TAILED = ("followers_count", "following_count", "retweet_count", "HU_TweetNum")
LABELS = {"reliable": 0, "unreliable": 1}


def resolve_columns(df: DataFrame, overrides: Mapping[str, str | None] | None = None) -> dict[str, str | None]:
    """Role to column name: an override wins, else the first alias present; user and ts must exist."""
    overrides = overrides or {}
    unknown = set(overrides) - set(OVERRIDABLE_ROLES)
    if unknown:
        raise ValueError(f"unknown roles: {sorted(unknown)}")
    present = set(df.columns)
    roles = {
        role: overrides.get(role) or next((a for a in aliases if a in present), None)
        for role, aliases in ROLE_ALIASES.items()
    }
    for role in REQUIRED_ROLES:
        if roles[role] is None:
            raise ValueError(f"no {role} column; name one or provide any of {list(ROLE_ALIASES[role])}")
    return roles


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def complement_columns(df: DataFrame, users: Iterable[str] = USER_COLUMNS, exclude: Iterable[str] = NEVER_NUMERIC) -> list[str]:
    """Message numerics: every column that is neither a user feature nor excluded, input order kept."""
    taken = {*users, *exclude}
    return [c for c in df.columns if c not in taken]


def conform(df: DataFrame, schema: T.StructType | Sequence[str]) -> DataFrame:
    """Fixed column order; absent columns come back as null."""
    if isinstance(schema, T.StructType):
        types = {f.name: f.dataType for f in schema.fields}
    else:
        types = {c: T.DoubleType() for c in schema}
    present = set(df.columns)
    return df.select(
        *[F.col(f"`{c}`") if c in present else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    )


def encode_label(df: DataFrame, col: str = "label", out: str | None = None) -> DataFrame:
    """reliable to 0, unreliable to 1; anything else, null included, stops the job."""
    c = F.col(col)
    code = F.when(c == "reliable", 0).when(c == "unreliable", 1).otherwise(
        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(c.cast("string"), F.lit("null")))).cast("int")
    )
    return df.withColumn(out or col, code)


def prefixed(names: Iterable[str], block: str) -> list[str]:
    """Feature names of one block: bow:, topic:, mnum: or user:."""
    return [f"{block}:{n}" for n in names]


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by column name, missing columns null."""
    head, *rest = dfs
    for d in rest:
        head = head.unionByName(d, allowMissingColumns=True)
    return head

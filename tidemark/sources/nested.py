"""Flatten nested post and profile payloads into the long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.schemas import RAW_POST, RAW_PROFILE


def parse_payload(df: DataFrame, col: str, kind: str) -> DataFrame:
    """JSON text column to payload columns; `kind` is post or profile."""
    schema = {"post": RAW_POST, "profile": RAW_PROFILE}[kind]
    return df.withColumn("_p", F.from_json(col, schema)).select(*[c for c in df.columns if c != col], "_p.*")


def _field_list(entries: Column, field: str) -> Column:
    """Values of one field over an entity array, entries without the field skipped."""
    values = F.transform(entries, lambda e: e[field])
    return F.coalesce(F.filter(values, lambda v: v.isNotNull()), F.array().cast("array<string>"))


def flatten_posts(raw: DataFrame) -> DataFrame:
    """One row per post: comma-joined urls, mentions and hashtags, media and repost flags.

    Any reference to another post counts as a repost. Reply and quote flags and engagement counts
    are kept where the payload has them.
    """
    refs = F.col("referenced_tweets")
    ent = F.col("entities")
    present = set(raw.columns)
    used = {"text", "created_at", "referenced_tweets", "attachments", "entities", "public_metrics"}
    keep = [c for c in raw.columns if c not in used]
    cols = [
        F.col("text").alias("tweet_text"),
        F.col("created_at").alias("tweet_created_at"),
        (F.coalesce(F.size(refs), F.lit(0)) > 0).alias("is_retweet"),
        F.exists(F.coalesce(refs["type"], F.array().cast("array<string>")), lambda t: F.coalesce(t == "quoted", F.lit(False))).alias("is_quote"),
        F.exists(F.coalesce(refs["type"], F.array().cast("array<string>")), lambda t: F.coalesce(t == "replied_to", F.lit(False))).alias("is_reply"),
        F.coalesce(F.to_json("attachments") != "{}", F.lit(False)).alias("has_media"),
        F.array_join(_field_list(ent["urls"], "expanded_url"), ",").alias("urls"),
        F.array_join(_field_list(ent["mentions"], "username"), ",").alias("mentions"),
        F.array_join(_field_list(ent["hashtags"], "tag"), ",").alias("hashtags"),
    ]
    if "public_metrics" in present:
        cols += [F.col(f"public_metrics.{c}").alias(c) for c in ("retweet_count", "reply_count", "quote_count")]
    return raw.select(*keep, *cols)


def flatten_profiles(raw: DataFrame, id_type: str = "username") -> DataFrame:
    """Profile rows keyed by name or id, with the four public counts and `has_profile_url`."""
    key = F.col("username") if id_type == "username" else F.col("id").cast("string")
    urls = F.coalesce(F.size(F.col("entities.url.urls")), F.lit(0)) > 0
    has_url = (F.length(F.coalesce(F.col("url"), F.lit(""))) > 0) | urls
    return raw.select(
        key.alias("key"),
        "username",
        F.col("id").cast("string").alias("id"),
        "created_at",
        *[F.col(f"public_metrics.{c}").alias(c) for c in ("followers_count", "following_count", "tweet_count", "listed_count")],
        has_url.cast("int").alias("has_profile_url"),
    )

"""Declared schemas (DDL text) of the inputs, so that no reader has to infer one."""

from __future__ import annotations

SEED_USERS = "username string, user_found boolean, Labels string, total_posts int"

RAW_POST = """id string, author_id string, text string, created_at string,
    referenced_tweets array<struct<type: string, id: string>>,
    attachments struct<media_keys: array<string>>,
    entities struct<urls: array<struct<expanded_url: string>>,
                    mentions: array<struct<username: string>>,
                    hashtags: array<struct<tag: string>>>,
    public_metrics struct<retweet_count: long, reply_count: long, quote_count: long>"""

RAW_PROFILE = """id string, username string, created_at string, url string,
    verified boolean, verified_type string,
    public_metrics struct<followers_count: long, following_count: long, tweet_count: long, listed_count: long>,
    entities struct<url: struct<urls: array<struct<expanded_url: string>>>>"""

POSTS = """username string, LABEL string, created_at string, user_id string, account_age_years double,
    total_posts int, followers_count int, following_count int, verified boolean, verified_type string,
    statuses_count int, posting_frequency double, tweet_text string, tweet_created_at string,
    is_retweet boolean, has_media boolean, urls string, mentions string, hashtags string,
    matched_handler string, matched_condition string"""

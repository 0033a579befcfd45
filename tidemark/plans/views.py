"""Canonical tables of the domain over the star-schema test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_tokens
from tidemark.operators.behaviour import canonical_posts
from tidemark.operators.sequences import SPECIALS, build_vocab

NOW = "2024-02-01 00:00:00"
N_CLUSTERS = 16
DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a small input: repartition only when the scan has fewer tasks than cores.

    A large table has far more scan tasks than cores and is left alone, so no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan_partitions(spark: SparkSession, sf: str, name: str) -> int:
    """Tasks that read a table, a measure of its size."""
    return table(spark, sf, name).rdd.getNumPartitions()


def now_ts():
    return F.from_utc_timestamp(F.lit(NOW).cast("timestamp"), F.current_timezone())


def raw_posts(spark: SparkSession, sf: str) -> DataFrame:
    """events as a post table under the column names a crawl would use."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "user_id",
        F.col("event_id").alias("id"),
        F.col("ts").alias("tweet_created_at"),
        (kind == "click").alias("is_retweet"),
        (kind == "signup").alias("is_quote"),
        (kind == "view").alias("is_reply"),
        (kind == "purchase").alias("is_trigger"),
        F.col("value").alias("retweet_count"),
        k.cast("double").alias("reply_count"),
        F.concat_ws(" ", kind, k).alias("tweet_text"),
    )


def posts(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_posts(raw_posts(spark, sf))


def trigger_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with the news-repost trigger flag kept."""
    raw = raw_posts(spark, sf)
    return canonical_posts(raw, tiebreak=("id", "is_trigger"))


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """customer and orders as profile snapshots; every seventh user has none."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("created_at"),
        F.count(F.lit(1)).alias("tweet_count"),
        F.count_if(F.col("o_orderstatus") == "F").alias("listed_count"),
        F.count_if(F.col("o_orderstatus") == "O").alias("following_count"),
    )
    c = table(spark, sf, "customer").filter(F.col("c_custkey") % 7 != 0)
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "inner").select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("username"),
        F.col("c_custkey").cast("string").alias("id"),
        "created_at",
        F.col("c_acctbal").alias("followers_count"),
        "following_count",
        "tweet_count",
        "listed_count",
        F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey") % 2).alias("has_profile_url"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents with normalised tokens."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", normalize_tokens(F.col("text")).alias("tokens"))


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return build_vocab(documents(spark, sf))


def cluster_map(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary tokens (at most the vocabulary cap) to one of 16 clusters."""
    v = vocabulary(spark, sf).filter(F.col("id") >= len(SPECIALS))
    return v.select("token", ((F.length("token") * 31 + F.ascii("token")) % N_CLUSTERS).cast("int").alias("cluster"))


def token_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every token of the documents, without the special ones, to one of 16 clusters."""
    t = documents(spark, sf).select(F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull() & ~F.col("token").isin(*SPECIALS)).distinct()
    return t.select("token", ((F.length("token") * 31 + F.ascii("token")) % N_CLUSTERS).cast("int").alias("cluster"))


def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings keyed by vocabulary rank: the most frequent token has vector 0, and so on."""
    v = vocabulary(spark, sf).filter(F.col("id") >= len(SPECIALS))
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return v.join(e, (F.col("id") - len(SPECIALS)).cast("long") == F.col("vec_id"), "inner").select("token", "vector")


NUMERIC = ("n_chars", "n_words", "word_len", "n_lines", "toxic")


def labeled_users(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as the model-ready table: key, label, text and five numerics."""
    d = spread(table(spark, sf, "documents"))
    lab = table(spark, sf, "labels")
    words = F.size(F.split("text", r"\s+"))
    return d.join(lab, "doc_id", "inner").select(
        F.col("doc_id"),
        F.when(F.col("quality") == 1, "reliable").otherwise("unreliable").alias("label"),
        F.col("text").alias("aggr_text"),
        "source",
        "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        words.cast("double").alias("n_words"),
        (F.col("n_chars") / words).alias("word_len"),
        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
        F.col("toxic").cast("double").alias("toxic"),
    )

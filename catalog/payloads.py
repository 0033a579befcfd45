"""Nested payload, handle and column-shape queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.behaviour import PROF_SQL
from tidemark.functions.scalars import clean_handle
from tidemark.operators import columns as C
from tidemark.operators.handles import NEWS_HANDLES, match_handles
from tidemark.operators.numeric import class_weights
from tidemark.plans import views as V
from tidemark.sources import nested as NS

_HANDLES = [h for hs in NEWS_HANDLES.values() for h in hs]


def _payload(spark, sf):
    """conversations as JSON posts: links from pages, mentions from the handle list, role as type."""
    c = V.table(spark, sf, "conversations")
    p = V.table(spark, sf, "pages")
    pid = (F.col("conv_id") * 8 + F.col("turn")).alias("pid")
    page = F.col("pid") % p.agg(F.max("page_id") + 1).scalar()
    j = c.withColumn("pid", pid).withColumn("page", page).join(p, F.col("page") == F.col("page_id"), "left")
    handle = F.get(F.array(*[F.lit(h) for h in _HANDLES]), (F.col("pid") % 40).cast("int"))
    odd = F.col("pid") % 2 == 1

    def some(cond, value):
        return F.when(cond, value)

    body = F.struct(
        F.col("pid").cast("string").alias("id"),
        F.col("text"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        some(F.col("role") != "user", F.array(F.struct(
            F.when(F.col("role") == "system", "quoted").otherwise("retweeted").alias("type"), F.lit("1").alias("id")
        ))).alias("referenced_tweets"),
        some(F.col("turn") == 0, F.struct(F.array(F.lit("m")).alias("media_keys"))).alias("attachments"),
        some(F.col("pid") % 5 != 0, F.struct(
            F.array(F.struct(F.col("url").alias("expanded_url")), F.struct(some(odd, F.lit("http://x.example")).alias("expanded_url"))).alias("urls"),
            F.array(F.struct(handle.alias("username")), F.struct(F.col("role").alias("username"))).alias("mentions"),
            some(odd, F.array(F.struct(F.col("role").alias("tag")))).alias("hashtags"),
        )).alias("entities"),
    )
    return j.select(F.col("pid").alias("post_id"), F.to_json(body).alias("payload"))


def _flat(spark, sf):
    return NS.flatten_posts(NS.parse_payload(_payload(spark, sf), "payload", "post"))


def flatten_posts(spark, sf):
    return _flat(spark, sf).select("post_id", "tweet_text", "is_retweet", "is_quote", "is_reply", "has_media", "urls", "mentions", "hashtags")


def match_handles_query(spark, sf):
    posts = _flat(spark, sf).withColumn("label", F.when(F.col("post_id") % 3 == 0, "reliable").otherwise("unreliable"))
    return match_handles(posts, NEWS_HANDLES).select("post_id", "label", "matched_handler", "matched_condition")


def flatten_profiles(spark, sf):
    p = V.profiles(spark, sf)
    k = F.col("key")
    link = F.array(F.struct(F.lit("http://x.example").alias("expanded_url")))
    none = F.array().cast("array<struct<expanded_url:string>>")
    body = F.struct(
        F.col("id"), F.col("username"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, "http://y.example").alias("url"),
        F.struct(F.floor("followers_count").alias("followers_count"), "following_count", "tweet_count", "listed_count").alias("public_metrics"),
        F.when(k % 3 != 0, F.struct(F.struct(F.when(k % 3 == 1, link).otherwise(none).alias("urls")).alias("url"))).alias("entities"),
    )
    raw = NS.parse_payload(p.select(F.to_json(body).alias("payload")), "payload", "profile")
    return NS.flatten_profiles(raw, id_type="user_id")


def clean_handles(spark, sf):
    c = V.table(spark, sf, "customer")
    at = F.repeat(F.lit("@"), (F.col("c_custkey") % 3).cast("int"))
    return c.select("c_custkey", clean_handle(F.concat(at, F.col("c_name"))).alias("handle"))


def complement_columns(spark, sf):
    """Message numerics by complement: names follow input order, values come along."""
    u = V.labeled_users(spark, sf)
    cols = C.complement_columns(u, users=("n_chars",), exclude=("label", "doc_id", "aggr_text", "source", "lang"))
    return u.select("doc_id", *[F.round(c, 6).alias(n) for c, n in zip(cols, (f"mnum_{i}_{c}" for i, c in enumerate(cols)))])


def conform_columns(spark, sf):
    u = V.labeled_users(spark, sf)
    schema = T.StructType.fromDDL("doc_id long, toxic double, posting_frequency double, source string")
    return C.conform(u, schema)


def encode_labels(spark, sf):
    return C.encode_label(V.labeled_users(spark, sf)).select("doc_id", "label")


def feature_names(spark, sf):
    """Long form of named features: one prefixed name per numeric column."""
    u = V.labeled_users(spark, sf)
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).alias("value")) for c, n in zip(V.NUMERIC, C.prefixed(V.NUMERIC, "mnum"))])
    long = u.select(F.explode(cells).alias("e")).select("e.*")
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def class_weights_query(spark, sf):
    u = C.encode_label(V.labeled_users(spark, sf))
    both = class_weights(class_weights(u, "balanced", out="balanced"), "positive", out="positive")
    return both.select("doc_id", "label", F.round("balanced", 6).alias("balanced"), F.round("positive", 6).alias("positive"))


QUERIES = {
    "flatten_posts": flatten_posts,
    "match_handles": match_handles_query,
    "flatten_profiles": flatten_profiles,
    "clean_handles": clean_handles,
    "complement_columns": complement_columns,
    "conform_columns": conform_columns,
    "encode_labels": encode_labels,
    "feature_names": feature_names,
    "class_weights": class_weights_query,
}

_H = "[" + ", ".join(f"'{h}'" for h in _HANDLES) + "]"
FLAT_SQL = f"""
flat AS (
  SELECT conv_id * 8 + turn AS pid, text, role, turn, url, (conv_id * 8 + turn) % 2 = 1 AS odd, (conv_id * 8 + turn) % 5 <> 0 AS ent,
         {_H}[(conv_id * 8 + turn) % 40 + 1] AS handle
  FROM (SELECT *, (conv_id * 8 + turn) % (SELECT max(page_id) + 1 FROM pages) AS page FROM conversations)
  LEFT JOIN pages ON page = page_id)
"""
LABELED_SQL = r"""
lab AS (
  SELECT d.doc_id, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS y, text, source, lang, CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(len(regexp_split_to_array(text, '\s+')) AS DOUBLE) AS n_words,
         d.n_chars / CAST(len(regexp_split_to_array(text, '\s+')) AS DOUBLE) AS word_len,
         CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines, CAST(toxic AS DOUBLE) AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""
_UNPIVOT = " UNION ALL ".join(f"SELECT 'mnum:{c}' AS feature, {c} AS v FROM lab" for c in V.NUMERIC)

SQL = {
    "flatten_posts": f"""WITH {FLAT_SQL}
        SELECT pid AS post_id, text AS tweet_text, role <> 'user' AS is_retweet, role = 'system' AS is_quote, false AS is_reply,
               turn = 0 AS has_media,
               CASE WHEN NOT ent THEN '' ELSE concat_ws(',', url, CASE WHEN odd THEN 'http://x.example' END) END AS urls,
               CASE WHEN NOT ent THEN '' ELSE concat_ws(',', handle, role) END AS mentions,
               CASE WHEN ent AND odd THEN role ELSE '' END AS hashtags FROM flat""",
    "match_handles": f"""WITH {FLAT_SQL},
        h AS (SELECT 'reliable' AS l, lower(unnest([{", ".join(f"'{h}'" for h in NEWS_HANDLES["reliable"])}])) AS h
              UNION ALL SELECT 'unreliable', lower(unnest([{", ".join(f"'{h}'" for h in NEWS_HANDLES["unreliable"])}]))),
        f AS (SELECT pid, CASE WHEN pid % 3 = 0 THEN 'reliable' ELSE 'unreliable' END AS label,
                     CASE WHEN role <> 'user' AND ent THEN lower(coalesce(handle, role)) END AS first FROM flat)
        SELECT pid AS post_id, label, coalesce(h.h, 'nil') AS matched_handler, CASE WHEN h.h IS NULL THEN 'no' ELSE 'yes' END AS matched_condition
        FROM f LEFT JOIN h ON label = l AND first = h.h""",
    "flatten_profiles": f"""WITH {PROF_SQL}
        SELECT id AS key, username, id, strftime(created, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
               CAST(floor(fr) AS BIGINT) AS followers_count, fg AS following_count, tw AS tweet_count, listed AS listed_count,
               CASE WHEN k % 4 = 1 OR k % 3 = 1 THEN 1 ELSE 0 END AS has_profile_url FROM prof""",
    "clean_handles": "SELECT c_custkey, c_name AS handle FROM customer",
    "complement_columns": f"""WITH {LABELED_SQL} SELECT doc_id, n_words AS mnum_0_n_words, round(word_len, 6) AS mnum_1_word_len,
        n_lines AS mnum_2_n_lines, toxic AS mnum_3_toxic FROM lab""",
    "conform_columns": f"WITH {LABELED_SQL} SELECT doc_id, toxic, CAST(NULL AS DOUBLE) AS posting_frequency, source FROM lab",
    "encode_labels": f"WITH {LABELED_SQL} SELECT doc_id, y AS label FROM lab",
    "feature_names": f"WITH {LABELED_SQL} SELECT feature, count(v) AS n, round(avg(v), 6) AS mean FROM ({_UNPIVOT}) GROUP BY feature",
    "class_weights": f"""WITH {LABELED_SQL}, c AS (SELECT y, count(*) AS n FROM lab GROUP BY y),
        t AS (SELECT sum(n) AS n, count(*) AS k, greatest(coalesce(sum(n) FILTER (WHERE y = 0), 0), 1) / CAST(greatest(coalesce(sum(n) FILTER (WHERE y = 1), 0), 1) AS DOUBLE) AS pw FROM c)
        SELECT doc_id, lab.y AS label, round(t.n / (t.k * CAST(c.n AS DOUBLE)), 6) AS balanced,
               round(CASE WHEN lab.y = 1 THEN pw ELSE 1.0 END, 6) AS positive FROM lab JOIN c ON lab.y = c.y, t""",
}

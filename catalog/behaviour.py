"""Timeline, behaviour and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import behaviour as B
from tidemark.operators import columns as C
from tidemark.operators import profiles as P
from tidemark.operators import timeline as TL
from tidemark.plans import views as V

N = 100
RAW_SQL = """
raw AS (
  SELECT user_id, event_id AS id, ts, epoch_us(ts) AS us,
         event_type = 'click' AS rt, event_type = 'signup' AS q, event_type = 'view' AS rp,
         event_type NOT IN ('click', 'signup', 'view') AS orig,
         event_type = 'purchase' AS trig, value AS rtc,
         CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE) AS rpc,
         event_type || ' ' || regexp_extract(props, '-?[0-9]+') AS txt
  FROM events)
"""
PROF_SQL = """
prof AS (
  SELECT c_custkey AS k, c_name AS username, CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS fr, o.*,
         CASE WHEN c_nationkey % 3 <> 0 THEN c_nationkey % 2 END AS url,
         (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(created)) / 86400000000.0 AS age
  FROM customer JOIN (
    SELECT o_custkey, min(o_orderdate) AS created, count(*) AS tw,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS listed,
           count(*) FILTER (WHERE o_orderstatus = 'O') AS fg
    FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
  WHERE c_custkey % 7 <> 0)
"""
HU_ROUND = ("HU_R_AverageInterval_days", "HU_R_RetweetedRate", "HU_R_QuotedRate", "HU_R_RepliedRate")


def rounded(df, digits=6, keep=()):
    """Round floating columns so that sums in another order compare equal."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if f.dataType.typeName() in ("double", "float") and f.name not in keep
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def last_n(spark, sf):
    return TL.last_n(V.posts(spark, sf), N).select("user", "id")


def hu_features(spark, sf):
    return rounded(B.hu_features(V.posts(spark, sf), N))


def hu_features_originals(spark, sf):
    return rounded(B.hu_features(V.posts(spark, sf), N, rates_on_originals=True))


def _hu_sql(select: str, rate=lambda c: f"avg({c})", tail=""):
    # Independent form: the mean gap comes from lag differences.
    return f"""
    WITH {RAW_SQL},
    win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM raw) WHERE rn <= {N}),
    gaps AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, id) AS gap FROM win),
    hu AS (
      SELECT user_id AS "user", count(*) AS n, avg(orig::INT) AS o, avg(rt::INT) AS r, avg(q::INT) AS q, avg(rp::INT) AS p,
             avg(rt::INT + q::INT + rp::INT) AS ip, avg(gap) / 86400000000.0 AS iv,
             {rate('rtc')} AS rr, CAST(NULL AS DOUBLE) AS qr, {rate('rpc')} AS pr
      FROM gaps GROUP BY user_id)
    {select} {tail}"""


HU_SELECT = """SELECT "user", n AS HU_R_TweetNum, round(o, 6) AS HU_R_TweetPercent_Original,
    round(r, 6) AS HU_R_TweetPercent_Retweet, round(q, 6) AS HU_R_TweetPercent_Quote, round(p, 6) AS HU_R_TweetPercent_Reply,
    round(r, 6) AS HU_R_RetweetPercent, round(q, 6) AS HU_R_QuotePercent, round(p, 6) AS HU_R_ReplyPercent,
    round(ip, 6) AS HU_R_InteractivePer, round(iv, 6) AS HU_R_AverageInterval_days, round(rr, 6) AS HU_R_RetweetedRate,
    qr AS HU_R_QuotedRate, round(pr, 6) AS HU_R_RepliedRate"""
PROF_SELECT = """round(age, 6) AS U_R_AccountAge_days, CAST(listed AS DOUBLE) AS U_R_ListedNum,
    round(fr / nullif(age, 0), 6) AS U_R_FollowerNumDay, round(fg / nullif(age, 0), 6) AS U_R_FolloweeNumDay,
    round(tw / nullif(age, 0), 6) AS U_R_TweetNumDay, round(listed / nullif(age, 0), 6) AS U_R_ListedNumDay,
    fr AS followers_count, CAST(fg AS DOUBLE) AS following_count, CAST(tw AS DOUBLE) AS tweet_count"""


# Text renderings of the event time: three ISO forms, the feed form and an unreadable value.
def parse_timestamps(spark, sf):
    e = V.table(spark, sf, "events")
    pick = F.col("event_id") % 5
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(pick == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(pick == 1, F.concat(iso, F.lit("Z")))
        .when(pick == 2, F.concat(iso, F.lit("+02:00")))
        .when(pick == 3, F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy")))
        .otherwise(F.concat(F.lit("on "), iso))
    )
    return e.select("event_id", text.alias("text")).select(
        "event_id", "text", F.unix_seconds(S.parse_ts(F.col("text"))).alias("epoch")
    )


_FLAG_WORDS = ["True", "false", "1", "", "no", None, "1.0", "quoted"]


def coerce_flags(spark, sf):
    e = V.table(spark, sf, "events")
    words = F.array(*[F.lit(w) for w in _FLAG_WORDS])
    t = e.select(
        "event_id",
        F.get(words, (F.col("event_id") % 8).cast("int")).alias("s"),
        F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("int") % 2).alias("n"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_type") == "click").alias("b"),
        F.concat(F.when(F.col("event_type") == "click", "RT @").otherwise(""), "event_type").alias("x"),
    )
    s, n, b = (t.schema[c].dataType for c in "snb")
    return t.select(
        "event_id",
        S.as_flag(F.col("s"), s).alias("flag_text"),
        S.as_flag(F.col("s"), s, strict_reference=True).alias("flag_text_strict"),
        S.as_flag(F.col("n"), n).alias("flag_num"),
        S.as_flag(F.col("b"), b).alias("flag_bool"),
        S.quote_flag(F.col("s"), s).alias("quote_text"),
        S.quote_flag(F.col("n"), n).alias("quote_num"),
        S.reply_flag(F.col("s"), s, "in_reply_to_user_id").alias("reply_id"),
        S.reply_flag(F.col("s"), s, "is_reply").alias("reply_text"),
        S.retweet_from_text(F.col("x")).alias("retweet_text"),
        (~(S.as_flag(F.col("b"), b) | S.quote_flag(F.col("n"), n))).alias("original"),
    )


def coerce_numbers(spark, sf):
    e = V.table(spark, sf, "events")
    v = F.col("value").cast("string")
    pick = F.col("event_id") % 5
    t = e.select(
        "event_id",
        F.when(pick == 0, F.concat(F.lit("  "), v, F.lit(" ")))
        .when(pick == 1, F.concat(v, F.lit(" USD")))
        .when(pick == 2, F.lit("1e3"))
        .when(pick == 3, v)
        .alias("s"),
        "value",
    )
    num = S.to_num(F.col("s"), t.schema["s"].dataType)
    part = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.lit(0.0))
    return t.select("event_id", num.alias("num"), F.round(S.safe_div(num, part), 6).alias("ratio"))


def profile_features(spark, sf):
    return rounded(P.profile_features(V.profiles(spark, sf), V.now_ts()), keep=("followers_count",))


def _fallback(spark, sf):
    o = V.table(spark, sf, "orders")
    day = F.dayofyear("o_orderdate").cast("double")
    posts = o.select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("followers_count"),
        F.when(F.col("o_orderkey") % 5 != 0, day).alias("friends_count"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.round(day, 0).cast("string")).alias("statuses_count"),
        (day / 365.0).alias("account_age_years"),
    )
    return P.profile_fallback(posts)


def profile_fallback(spark, sf):
    df = rounded(_fallback(spark, sf), keep=("followers_count",))
    return df.drop("username", "id", "U_R_ProfileUrl", "U_R_ListedNum", "U_R_ListedNumDay")


def user_features(spark, sf):
    hu = B.hu_features(V.posts(spark, sf), N)
    return rounded(P.user_features(hu, P.profile_features(V.profiles(spark, sf), V.now_ts())), keep=("followers_count",))


def crawl_profile_stats(spark, sf):
    df = P.crawl_profile_stats(V.profiles(spark, sf), V.now_ts())
    return rounded(df.select("key", "account_age_years", "posting_frequency"))


def _roster(spark, sf):
    c = V.table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("user"),
        F.col("c_name").alias("username"),
        (F.col("c_nationkey") % 5 != 0).alias("user_found"),
        F.when(F.col("c_mktsegment") == "BUILDING", "reliable").otherwise("unreliable").alias("Labels"),
        (F.abs(F.col("c_acctbal")).cast("int") % 100).alias("total_posts"),
        F.col("c_custkey").alias("roster_order"),
    )


def roster_join(spark, sf):
    prof = V.profiles(spark, sf).select("username", "tweet_count", "listed_count")
    found = TL.found_users(_roster(spark, sf))
    return P.attach_profile(found, prof).select("user", "username", "Labels", "total_posts", "tweet_count", "listed_count")


def capped_take(spark, sf):
    roster = TL.found_users(_roster(spark, sf))
    taken = TL.capped_take(V.posts(spark, sf), roster, per_user=60, quota=4000, page=25)
    return taken.select("user", "id", "page")


def capped_take_timeline(spark, sf):
    """The shipped limits: 3,200 posts per user, 25,000 in all, pages of 100."""
    roster = TL.found_users(_roster(spark, sf)).withColumn("total_posts", F.col("total_posts") * 100)
    return TL.capped_take(V.posts(spark, sf), roster).select("user", "id", "page")


def type1_history(spark, sf):
    p = V.trigger_posts(spark, sf)
    return TL.type1_history(p, F.col("is_trigger") & (F.col("id") % 20 == 0)).select("user", "id")


def type1_history_own(spark, sf):
    p = V.trigger_posts(spark, sf)
    return TL.type1_history(p, F.col("is_trigger"), fallback=None).select("user", "id")


def type2_history(spark, sf):
    p = V.trigger_posts(spark, sf)
    cutoff = F.from_utc_timestamp(F.lit("2024-01-20 00:00:00").cast("timestamp"), F.current_timezone())
    return TL.type2_history(p, cutoff, direct_repost=F.col("is_quote")).select("user", "id")


def aggregate_text(spark, sf):
    return TL.aggregate_text(V.posts(spark, sf))


def user_ratios(spark, sf):
    prof = P.profile_features(V.profiles(spark, sf), V.now_ts())
    return rounded(B.user_ratios(V.posts(spark, sf), prof))


def user_keys(spark, sf):
    return TL.user_keys(V.posts(spark, sf))


def union_posts(spark, sf):
    raw = V.raw_posts(spark, sf)
    a = raw.filter("is_retweet").select("user_id", "id", "retweet_count")
    b = raw.filter("NOT is_retweet").select("id", "user_id", "reply_count")
    return C.union_all(a, b)


QUERIES = {
    f.__name__: f
    for f in (
        hu_features, hu_features_originals, last_n, parse_timestamps, coerce_flags, coerce_numbers, profile_features,
        profile_fallback, user_features, crawl_profile_stats, roster_join, capped_take, capped_take_timeline,
        type1_history, type1_history_own, type2_history, aggregate_text, user_ratios, user_keys, union_posts,
    )
}

_WORDS_SQL = "[" + ", ".join("NULL" if w is None else f"'{w}'" for w in _FLAG_WORDS) + "]"


def _capped_sql(per_user, quota, page, total):
    return f"""
    WITH {RAW_SQL},
    have AS (SELECT user_id, count(*) AS n FROM raw GROUP BY user_id),
    offer AS (
      SELECT c_custkey AS u, least({total}, {per_user}, n) AS o
      FROM customer JOIN have ON c_custkey = user_id WHERE c_nationkey % 5 <> 0),
    run AS (SELECT u, o, coalesce(sum(o) OVER (ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM offer),
    take AS (SELECT u, least(o, ceil(({quota} - b) / {page}.0) * {page}) AS t FROM run WHERE b < {quota}),
    rn AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM raw)
    SELECT user_id AS "user", id, CAST(ceil(r / {page}.0) AS INTEGER) AS page FROM rn JOIN take ON u = user_id WHERE r <= t"""


SQL = {
    "hu_features": _hu_sql(HU_SELECT, tail="FROM hu"),
    "hu_features_originals": _hu_sql(HU_SELECT, rate=lambda c: f"avg({c}) FILTER (WHERE orig)", tail="FROM hu"),
    "last_n": f"""WITH {RAW_SQL} SELECT user_id AS "user", id FROM raw
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) <= {N}""",
    "parse_timestamps": """
        WITH t AS (
          SELECT event_id, event_id % 5 AS pick, CASE event_id % 5
            WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
            WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
            WHEN 3 THEN strftime(ts, '%a %b %d %H:%M:%S') || ' +0000 ' || strftime(ts, '%Y')
            ELSE 'on ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS text FROM events)
        SELECT event_id, text, CAST(epoch(CASE
          WHEN pick = 3 THEN strptime(replace(text, '+0000 ', ''), '%a %b %d %H:%M:%S %Y')
          WHEN pick = 2 THEN CAST(replace(text, '+02:00', '') AS TIMESTAMP) - INTERVAL 2 HOUR
          ELSE TRY_CAST(replace(text, 'Z', '') AS TIMESTAMP) END) AS BIGINT) AS epoch FROM t""",
    "coerce_flags": f"""
        WITH t AS (
          SELECT event_id, {_WORDS_SQL}[event_id % 8 + 1] AS s,
                 CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value) AS INT) % 2 END AS n,
                 CASE WHEN event_id % 4 <> 0 THEN event_type = 'click' END AS b,
                 event_type = 'click' AS x FROM events)
        SELECT event_id, coalesce(s IN ('True', '1', '1.0'), false) AS flag_text,
               CASE WHEN s IS NULL THEN true WHEN s IN ('', 'false') THEN false ELSE true END AS flag_text_strict,
               coalesce(n <> 0, false) AS flag_num, coalesce(b, false) AS flag_bool,
               coalesce(s IN ('True', '1', 'quoted'), false) AS quote_text, coalesce(n <> 0, false) AS quote_num,
               s IS NOT NULL AS reply_id, coalesce(s IN ('True', '1', '1.0'), false) AS reply_text, x AS retweet_text,
               NOT (coalesce(b, false) OR coalesce(n <> 0, false)) AS original FROM t""",
    "coerce_numbers": """
        WITH t AS (SELECT event_id, value, CASE event_id % 5 WHEN 0 THEN value WHEN 2 THEN 1000.0 WHEN 3 THEN value END AS num FROM events)
        SELECT event_id, CAST(num AS DOUBLE) AS num,
               round(CASE WHEN event_id % 2 = 0 AND value <> 0 THEN num / value END, 6) AS ratio FROM t""",
    "profile_features": f"""WITH {PROF_SQL} SELECT k AS "user", username, id, coalesce(url, 0) AS U_R_ProfileUrl, {PROF_SELECT} FROM prof""",
    "profile_fallback": """
        WITH t AS (
          SELECT o_custkey AS u, o_totalprice AS fr, CAST(dayofyear(o_orderdate) AS DOUBLE) AS d,
                 o_orderkey % 5 <> 0 AS hasfg, o_orderpriority <> '5-LOW' AS hastw,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
        v AS (SELECT u, fr, CASE WHEN hasfg THEN d END AS fg, CASE WHEN hastw THEN d END AS tw, d / 365.0 * 365.25 AS age FROM t WHERE rn = 1)
        SELECT u AS "user", round(age, 6) AS U_R_AccountAge_days, round(fr / age, 6) AS U_R_FollowerNumDay,
               round(fg / age, 6) AS U_R_FolloweeNumDay, round(tw / age, 6) AS U_R_TweetNumDay,
               fr AS followers_count, fg AS following_count, tw AS tweet_count FROM v""",
    "user_features": _hu_sql(
        HU_SELECT + f", username, id, CASE WHEN k IS NOT NULL THEN coalesce(url, 0) END AS U_R_ProfileUrl, {PROF_SELECT}",
        tail='FROM hu LEFT JOIN prof ON "user" = k',
    ).replace("WITH ", f"WITH {PROF_SQL}, ", 1),
    "crawl_profile_stats": f"""WITH {PROF_SQL}
        SELECT k AS key, round(CASE WHEN floor(age) > 0 THEN floor(age) / 365.0 END, 6) AS account_age_years,
               round(CASE WHEN floor(age) > 0 THEN tw / (floor(age) / 365.0) END, 6) AS posting_frequency FROM prof""",
    "roster_join": f"""WITH {PROF_SQL}
        SELECT c_custkey AS "user", c_name AS username, CASE WHEN c_mktsegment = 'BUILDING' THEN 'reliable' ELSE 'unreliable' END AS "Labels",
               CAST(trunc(abs(c_acctbal)) AS INT) % 100 AS total_posts, tw AS tweet_count, listed AS listed_count
        FROM customer JOIN prof ON c_name = username WHERE c_nationkey % 5 <> 0""",
    "capped_take": _capped_sql(60, 4000, 25, "CAST(trunc(abs(c_acctbal)) AS INT) % 100"),
    "capped_take_timeline": _capped_sql(3200, 25000, 100, "CAST(trunc(abs(c_acctbal)) AS INT) % 100 * 100"),
    "type1_history": f"""
        WITH {RAW_SQL},
        c AS (SELECT user_id, min(us) AS f, min(us) FILTER (WHERE trig AND id % 20 = 0) AS t FROM raw GROUP BY user_id),
        m AS (SELECT median(t - f) AS span FROM c WHERE t IS NOT NULL)
        SELECT r.user_id AS "user", id FROM raw r JOIN c ON r.user_id = c.user_id, m
        WHERE orig AND us < coalesce(t, f + span)""",
    "type1_history_own": f"""
        WITH {RAW_SQL}, c AS (SELECT user_id, min(us) AS t FROM raw WHERE trig GROUP BY user_id)
        SELECT r.user_id AS "user", id FROM raw r JOIN c ON r.user_id = c.user_id WHERE orig AND us < t""",
    "type2_history": f"""
        WITH {RAW_SQL} SELECT user_id AS "user", id FROM raw
        WHERE NOT rt AND NOT q AND ts <= TIMESTAMP '2024-01-20 00:00:00'""",
    "aggregate_text": f"""
        WITH {RAW_SQL}, p AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, id) - 1) // {TL.TIMELINE_MAX} AS part FROM raw)
        SELECT user_id AS "user", CAST(part AS INTEGER) AS part, string_agg(txt, ' ' ORDER BY ts, id) AS aggr_text, count(*) AS n_posts
        FROM p GROUP BY user_id, part""",
    "user_ratios": f"""
        WITH {RAW_SQL}, {PROF_SQL},
        u AS (SELECT user_id, avg(rt::INT) AS rr, avg(rtc) AS rc FROM raw GROUP BY user_id)
        SELECT user_id AS "user", round(rr, 6) AS retweet_ratio, round(rc, 6) AS retweet_count,
               round(fr / nullif(CAST(fg AS DOUBLE), 0), 6) AS follower_to_followee_ratio
        FROM u LEFT JOIN prof ON user_id = k""",
    "user_keys": """SELECT DISTINCT CAST(user_id AS VARCHAR) AS "user" FROM events""",
    "union_posts": f"""
        WITH {RAW_SQL}
        SELECT user_id, id, rtc AS retweet_count, CAST(NULL AS DOUBLE) AS reply_count FROM raw WHERE rt
        UNION ALL SELECT user_id, id, NULL, rpc FROM raw WHERE NOT rt""",
}

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import behaviour as B
from tidemark.operators import columns as C
from tidemark.operators import profiles as P
from tidemark.operators import timeline as TL
from tidemark.operators.handles import match_handles
from tidemark.operators.ranking import newest_per_key


def at(day, sec=0):
    return dt.datetime(2024, 1, day, 0, 0, sec)


POST = "username string, id long, tweet_created_at timestamp, is_retweet boolean, is_quote boolean, is_reply boolean, retweet_count double"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def one(df, name):
    return df.collect()[0][name]


def test_hu_features_edges(spark):
    data = [
        (None, 1, at(1), False, False, False, 1.0),
        ("one", 2, at(1), True, True, False, None),  # two flags on one post
        ("nots", 3, None, False, False, True, 2.0),
        ("nots", 4, None, False, False, False, float("nan")),
        ("tie", 5, at(2), True, False, False, 5.0),
        ("tie", 6, at(2), False, False, False, 7.0),
        ("tie", 7, None, False, False, False, 9.0),
        *[("many", 100 + i, at(1 + i), i == 0, False, False, float(i)) for i in range(6)],
    ]
    posts = B.canonical_posts(spark.createDataFrame(data, POST))
    got = {r["user"]: r for r in B.hu_features(posts, n=4).collect()}
    assert set(got) == {None, "one", "nots", "tie", "many"}
    assert got["one"]["HU_R_InteractivePer"] == 2.0 and got["one"]["HU_R_AverageInterval_days"] is None
    assert got["one"]["HU_R_RetweetedRate"] is None
    assert got["nots"]["HU_R_AverageInterval_days"] is None and got["nots"]["HU_R_RetweetedRate"] == 2.0
    assert got["tie"]["HU_R_AverageInterval_days"] == 0.0
    assert got["many"]["HU_R_TweetNum"] == 4 and got["many"]["HU_R_AverageInterval_days"] == 1.0
    assert got["many"]["HU_R_RetweetedRate"] == pytest.approx(3.5)
    # Among equal times the later input stays; null times go first.
    assert rows(TL.last_n(posts.filter("user = 'tie'"), 1), "id") == [(6,)]
    orig = {r["user"]: r for r in B.hu_features(posts, n=4, rates_on_originals=True).collect()}
    assert orig["tie"]["HU_R_RetweetedRate"] == 8.0 and orig["one"]["HU_R_RetweetedRate"] is None


def test_large_n_uses_the_tree_and_agrees(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    order = [F.desc("v")]
    want = rows(newest_per_key(df, ["k"], order, 900), "k", "v")
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        assert rows(newest_per_key(df, ["k"], order, 900), "k", "v") == want
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)
    assert len(want) == 2700


def test_parse_ts_and_numbers(spark):
    df = spark.createDataFrame(
        [("2024-01-01T00:00:00Z",), ("2024-01-01 02:00:00+02:00",), ("2024-01-01",), ("Mon Jan 01 00:00:00 +0000 2024",), ("bad",), (None,)],
        "s string",
    )
    epoch = 1704067200
    assert [r[0] for r in df.select(F.unix_seconds(S.parse_ts(F.col("s")))).collect()] == [epoch] * 4 + [None] * 2
    more = ["1704067200", "1704067200000", "1704067200000000", "1704067200000000000", "2024/01/01 00:00:00", "2024/1/1", "01/01/2024", "1/1/2024 00:00", "Jan 1 2024 00:00", "Jan 1, 2024", "Jan 1 2024 00:00:00"]
    forms = spark.createDataFrame([(i, s) for i, s in enumerate([*more, "17", "13/45/2024", "Foo 1 2024"])], "i int, s string")
    got = forms.select("i", F.unix_seconds(S.parse_ts(F.col("s")))).orderBy("i").collect()
    assert [r[1] for r in got] == [epoch] * len(more) + [None] * 3
    long = spark.createDataFrame([(1704067200,), (None,)], "t long")
    assert [r[0] for r in long.select(F.unix_seconds(S.instant(F.col("t"), long.schema["t"].dataType))).collect()] == [epoch, None]
    nums = spark.createDataFrame([(" 12 ",), ("1e3",), ("x1",), ("",), (None,)], "s string")
    assert [r[0] for r in nums.select(S.to_num(F.col("s"))).collect()] == [12.0, 1000.0, None, None, None]


def test_parse_ts_ignores_session_zone(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",)], "s string")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert df.select(F.unix_seconds(S.parse_ts(F.col("s"))).alias("e")).first()["e"] == 1704067200
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "screen_name int, username int, created_at int")
    roles = C.resolve_columns(df, {"rt": "flag"})
    assert roles["user"] == "username" and roles["ts"] == "created_at" and roles["rt"] == "flag" and roles["quote"] is None
    with pytest.raises(ValueError, match="no ts column"):
        C.resolve_columns(df.drop("created_at"))
    with pytest.raises(ValueError, match="missing columns"):
        C.require_columns(df, ["username", "nope"])


def test_encode_label_rejects_unknown(spark):
    good = spark.createDataFrame([("reliable",), ("unreliable",)], "label string")
    assert [r[0] for r in C.encode_label(good).collect()] == [0, 1]
    with pytest.raises(Exception, match="unknown label"):
        C.encode_label(spark.createDataFrame([(None,)], "label string")).collect()


def test_profile_edges(spark):
    prof = spark.createDataFrame(
        [("a", "a", 1, "2024-01-31T00:00:00Z", "10", 5, 3, None, None), (None, None, 2, "2024-01-01T00:00:00Z", "x", 1, 1, 1, 1)],
        "key string, username string, id long, created_at string, followers_count string, following_count int, tweet_count int, listed_count int, has_profile_url int",
    )
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    out = P.profile_features(prof, now)
    got = {r["user"]: r for r in out.collect()}
    assert got["a"]["U_R_AccountAge_days"] == 0 and got["a"]["U_R_FollowerNumDay"] is None and got["a"]["U_R_ProfileUrl"] == 0
    assert got[None]["followers_count"] is None and got[None]["U_R_FolloweeNumDay"] == pytest.approx(1 / 30)
    hu = spark.createDataFrame([(None, 1), ("b", 2)], "user string, HU_R_TweetNum long")
    joined = {r["user"]: r for r in P.user_features(hu, out).collect()}
    assert joined[None]["id"] == "2" and joined["b"]["id"] is None
    assert len(joined["b"]) == 26


def test_profile_fallback_takes_newest(spark):
    posts = spark.createDataFrame(
        [("u", 1, at(2), 5.0, 2.0), ("u", 2, at(3), 7.0, 1.0), ("u", 3, None, 9.0, 1.0)],
        "username string, id long, tweet_created_at timestamp, followers_count double, account_age_years double",
    )
    r = P.profile_fallback(posts).first()
    assert r["followers_count"] == 7.0 and r["U_R_AccountAge_days"] == 365.25 and r["U_R_ProfileUrl"] is None


def test_handles(spark):
    df = spark.createDataFrame(
        [(1, "reliable", True, "cnn,x"), (2, "reliable", True, "x,cnn"), (3, "unreliable", True, "CNN"), (4, "unreliable", True, "InfoWars"), (5, "reliable", False, "cnn"), (6, "reliable", True, "")],
        "id int, label string, is_retweet boolean, mentions string",
    )
    got = match_handles(df, {"reliable": ["CNN"], "unreliable": ["infowars"]})
    assert rows(got, "id", "matched_handler", "matched_condition") == [
        (1, "cnn", "yes"), (2, "nil", "no"), (3, "nil", "no"), (4, "infowars", "yes"), (5, "nil", "no"), (6, "nil", "no"),
    ]


def test_type1_moves_chosen_users_to_the_median_point(spark):
    data = [("a", i, at(1 + i), False, False, False, 0.0) for i in range(5)] + [("b", 10 + i, at(1 + i), False, False, False, 0.0) for i in range(5)]
    posts = B.canonical_posts(spark.createDataFrame(data, POST))
    trig = ((F.col("user") == "a") & (F.col("id") == 3)) | ((F.col("user") == "b") & (F.col("id") == 11))
    got = TL.type1_history(posts, trig, equivalent_point_for=F.col("user") == "b")
    # Only a's span (three days) counts, and b is cut there instead of at its own trigger.
    assert rows(got, "id") == [(0,), (1,), (10,), (11,), (12,), (2,)]


def test_type1_without_any_trigger_keeps_originals(spark):
    data = [("a", i, at(1 + i), i == 2, False, False, 0.0) for i in range(4)] + [("a", 9, None, False, False, False, 0.0)]
    posts = B.canonical_posts(spark.createDataFrame(data, POST))
    assert rows(TL.type1_history(posts, F.lit(False)), "id") == [(0,), (1,), (3,)]
    assert rows(TL.type1_history(posts, F.lit(False), fallback=None), "id") == []


def test_posts_without_time_are_split(spark):
    data = [("u", i, None, False, False, False, 0.0) for i in range(50)] + [("u", 99, at(1), False, False, False, 0.0)]
    posts = B.canonical_posts(spark.createDataFrame(data, POST)).withColumn("text", F.concat(F.lit("t"), "id"))
    parts = sorted(TL.aggregate_text(posts, max_posts=20).collect(), key=lambda r: r["part"])
    assert [r["n_posts"] for r in parts] == [20, 20, 11]
    words = " ".join(r["aggr_text"] for r in parts).split()
    assert words[-1] == "t99" and sorted(words) == sorted(f"t{i}" for i in [*range(50), 99])


def test_capped_take_pages(spark):
    posts = B.canonical_posts(spark.createDataFrame([(u, i, at(1, i % 60), False, False, False, 0.0) for u, base in (("a", 0), ("b", 1000), ("c", 2000)) for i in range(base, base + 30)], POST))
    roster = spark.createDataFrame([("a", 0, 25), ("b", 1, 99), ("c", 2, 99)], "user string, roster_order int, total_posts int")
    got = {r["user"]: r["n"] for r in TL.capped_take(posts, roster, per_user=28, quota=30, page=10).groupBy("user").agg(F.count("*").alias("n")).collect()}
    # a gives 25, b still gets one whole page although only 5 are missing, c is never asked.
    assert got == {"a": 25, "b": 10}


def test_aggregate_text_keeps_every_post(spark):
    data = [("u", i, at(1 + i % 3), False, False, False, 0.0) for i in range(10)] + [("u", 99, None, False, False, False, 0.0)]
    posts = B.canonical_posts(spark.createDataFrame(data, POST)).withColumn("text", F.concat(F.lit("t"), "id"))
    parts = sorted(TL.aggregate_text(posts, max_posts=4).collect(), key=lambda r: r["part"])
    assert [r["n_posts"] for r in parts] == [4, 4, 3]
    assert " ".join(r["aggr_text"] for r in parts) == "t99 t0 t3 t6 t9 t1 t4 t7 t2 t5 t8"

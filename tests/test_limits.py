"""Sizes and values at which earlier versions cut data off, failed or changed behaviour."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.functions import bounds
from tidemark.operators import numeric, sequences
from tidemark.plans import models
from tidemark.sources import lexicons, nested


def test_cluster_map_reads_every_entry(spark, tmp_path):
    path = tmp_path / "map.txt"
    path.write_text("\n".join(f"w{i} {i % 7}" for i in range(200_500)))
    cmap, n = lexicons.read_cluster_map(spark, str(path))
    assert (cmap.count(), n) == (200_500, 7)
    assert lexicons.read_cluster_map(spark, str(path), cap=10)[0].count() == 10


def test_small_results_beyond_the_bound_are_kept(spark):
    df = spark.range(50)
    assert bounds.checked_small(df, max_rows=10).count() == bounds.checked_small(df, max_rows=100).count() == 50


def test_medians_keep_the_null_group_at_any_number_of_groups(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0), ("", 2.0)], "g string, x double")
    want = {("a", 2.0), (None, 7.0), ("", 2.0)}
    assert {(r.g, r["median"]) for r in numeric.median_table(df, ["x"], ["g"]).collect()} == want
    monkeypatch.setattr(numeric, "checked_small", lambda d: bounds.checked_small(d, max_rows=1))
    assert {(r.g, r["median"]) for r in numeric.median_table(df, ["x"], ["g"]).collect()} == want


def test_all_chunks_of_a_long_sequence(spark):
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(1999)).alias("ids"))
    chunks = sequences.chunk_sequences(df, "ids", 64, 16)
    assert chunks.count() == 42 and chunks.agg(F.max(F.array_max("chunk_ids"))).first()[0] == 1999
    assert sequences.chunk_sequences(df, "ids", 64, 16, max_chunks=12).count() == 12


def test_fit_leaves_the_partitions_alone(spark, monkeypatch):
    seen = []
    monkeypatch.setitem(models._FIT, "lr", lambda df, *a, **k: seen.append(df.rdd.getNumPartitions()))
    rows = spark.range(100, numPartitions=6).select((F.col("id") % 2).alias("y_true"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    models.fit(models.ModelSpec("lr", {}), rows)
    assert seen == [6]


def test_empty_attachments_are_no_media(spark):
    kind = "id string, text string, created_at string, referenced_tweets array<struct<type:string,id:string>>, attachments struct<media_keys:array<string>>, entities struct<urls:array<struct<expanded_url:string>>,mentions:array<struct<username:string>>,hashtags:array<struct<tag:string>>>"
    rows = [("1", "t", None, None, (None,), None), ("2", "t", None, None, (["m"],), None), ("3", "t", None, None, None, None)]
    out = nested.flatten_posts(spark.createDataFrame(rows, kind))
    assert {r["id"]: r.has_media for r in out.collect()} == {"1": False, "2": True, "3": False}

"""Readers for token files: cluster maps and word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an order key that follows the file: block start, then position in the block."""
    return spark.read.text(path).select(
        F.trim("value").alias("line"),
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ).alias("at"),
    )


def read_cluster_map(spark: SparkSession, path: str, cap: int | None = None) -> tuple[DataFrame, int]:
    """((token, cluster) table, n_clusters = max + 1) from `token ... <int id>` lines.

    Blank and one-field lines are skipped, a last field that is no integer stops the job, and of
    repeated tokens the last line wins. All entries are read unless a `cap` asks for the first ones.
    """
    f = F.split(F.col("line"), r"\s+")
    entries = (
        _numbered_lines(spark, path)
        .withColumn("f", f)
        .filter((F.col("line") != "") & (F.size("f") >= 2))
    )
    if cap is not None:
        entries = entries.orderBy("at").limit(cap)
    last = F.element_at("f", -1)
    cluster = F.when(last.rlike(r"^[+-]?\d+$"), last.try_cast("int"))
    checked = F.coalesce(
        cluster, F.raise_error(F.concat(F.lit("cluster id is not an integer: "), "line")).cast("int")
    )
    cmap = (
        entries.select(F.get("f", F.lit(0)).alias("token"), checked.alias("cluster"), "at")
        .groupBy("token")
        .agg(F.max_by("cluster", "at").alias("cluster"))
    )
    top = cmap.agg(F.max("cluster")).first()[0]
    if top is None:
        raise ValueError("no cluster entries")
    return cmap, top + 1


def read_word_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(token, vector) from `token f1 ... f<dim>` lines; other lengths are skipped, last one wins."""
    lines = spark.read.text(path).select(
        F.split(F.rtrim("value"), " ").alias("f"),
        F.struct(
            F.col("_metadata.file_path").alias("f"),
            F.col("_metadata.file_block_start").alias("b"),
            F.monotonically_increasing_id().alias("i"),
        ).alias("at"),
    )
    rows = lines.filter(F.size("f") == dim + 1).select(
        F.get("f", F.lit(0)).alias("token"),
        F.transform(F.slice("f", 2, dim), lambda x: x.cast("float")).alias("vector"),
        "at",
    )
    return rows.groupBy("token").agg(F.max_by("vector", "at").alias("vector"))

"""Table readers and the result sink."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.columns import USER_COLUMNS, require_columns, union_all


def _read(spark: SparkSession, paths: Sequence[str], fmt: str, schema: T.StructType | str | None, multi_line: bool = True) -> DataFrame:
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", multi_line).option("escape", '"')
        reader = reader.schema(schema).option("enforceSchema", False) if schema else reader.option("inferSchema", True)
    elif schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(list(paths))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN to null: averages and counts must skip missing values."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def read_posts(spark: SparkSession, paths: str | Iterable[str], schema: T.StructType | str | None = None, fmt: str | None = None, multi_line: bool = True, merge_schema: bool = True) -> DataFrame:
    """Post tables unioned by column name; a column missing in one source is null there.

    `paths` is one path or glob, or several; several sources with one declared schema become a
    single scan. Format follows the suffix unless given. CSV texts may hold line feeds, which makes
    each file one task; `multi_line=False` splits files whose texts don't. Without a schema the columns of
    Parquet sources are merged from all footers; `merge_schema=False` spares that where all files agree.
    """
    paths = [paths] if isinstance(paths, str) else sorted(paths)
    if not paths:
        raise ValueError("no input path")
    kinds: dict[str, list[str]] = {}
    for p in paths:
        kinds.setdefault(fmt or os.path.splitext(p)[1].lstrip(".") or "parquet", []).append(p)
    parts = []
    for kind, ps in sorted(kinds.items()):
        if schema is not None:
            parts.append(_read(spark, ps, kind, schema, multi_line))
        elif kind == "csv":
            parts += [_read(spark, [p], kind, None, multi_line) for p in ps]
        elif kind == "parquet":
            parts.append(spark.read.option("mergeSchema", merge_schema).parquet(*ps))
        else:
            parts.append(_read(spark, ps, kind, None))
    return nan_to_null(union_all(*parts))


def read_labeled_users(
    spark: SparkSession,
    path: str,
    required: Sequence[str] = (*USER_COLUMNS, "label", "aggr_text"),
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """The model-ready user table; missing required columns are an error before any work."""
    return require_columns(read_posts(spark, path, schema), required)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | str | None = None, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a result table, per-fold tables partitioned by fold."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path

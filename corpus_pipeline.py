"""A training corpus from `documents`: quality, near duplicates, secrets, mixture, token ids.

Every stage works on all that the one before kept; between them documents are written as Parquet into the
cluster's shared folder (spark.checkpoint.dir) and read again.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, neardup, quality, secrets
from tidemark.llm.common import table

TOKENIZER = "word_bpe_49k.json"
LEAST_QUALITY = 0.3
WEIGHTS, MOST_COPIES = (5, 2, 1), 3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_scores(docs, model, least=LEAST_QUALITY)
    return scored.filter("predicted = 1").select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mask and the length set anew."""
    found = docs.withColumn("_found", secrets.secret_spans(docs))
    masked = found.withColumn("text", secrets.masked(F.col("text"), F.col("_found")))
    length = F.when(F.size("_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*docs.columns)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources takes it."""
    return mixing.mixed_rows(docs, weights=WEIGHTS, cap=MOST_COPIES)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the hash of what the ids decode to."""
    path = public_tokenizers.path(TOKENIZER)
    ids = bpe.encode(docs.select("doc_id", "source", "text"), path).drop("text")
    decoded = ids.withColumn("decoded_sha256", F.sha2(bpe.decode(ids, path), 256))
    return decoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", distinct_documents),
    ("secret scans", clean_documents),
    ("source mixture", mixed_documents),
    ("BPE encoding", encoded_documents),
]
#: Classifier, minhash and tokenizer have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
    folder = f"{shared}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

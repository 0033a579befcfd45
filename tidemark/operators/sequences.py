"""Vocabulary, id sequences, padding and sliding chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.arrays import explode_rows
from tidemark.functions.bounds import MAX_BROADCAST_ROWS
from tidemark.operators.lookup import placed, token_positions

# Reserved tokens with ids 0..3, and the sequence limits.
SPECIALS = ("<pad>", "<unk>", "url", "usr")
PAD_ID, UNK_ID = 0, 1
#: Stands for a token that the shipped part of a vocabulary doesn't hold; never in a result.
OPEN_ID = -1
MAX_VOCAB = 50_000
MAX_SEQ_LEN = 3000
OVERLAP = 128
MAX_CHUNKS = 12


def build_vocab(docs: DataFrame, tokens: str = "tokens", max_size: int | None = MAX_VOCAB, min_freq: int = 1, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """(token, id): specials first, then by count (descending) and token, cut at max_size in all.

    Counts are combined map-side; only the `max_size` survivors reach the numbering window. Without
    a max_size the numbering is over all distinct tokens.
    """
    counts = (
        explode_rows(docs, [], tokens, "token")
        .filter(~F.col("token").isin(*specials))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_freq)
    )
    ordered = counts.orderBy(F.desc("n"), F.asc("token"))
    if max_size is not None:
        ordered = ordered.limit(max(0, max_size - len(specials)))
    rank = F.row_number().over(W.orderBy(F.desc("n"), F.asc("token")))
    body = ordered.select("token", (rank + len(specials) - 1).cast("int").alias("id"), "n")
    head = docs.sparkSession.createDataFrame(
        [(t, i, None) for i, t in enumerate(specials)], "token string, id int, n long"
    )
    return head.unionByName(body)


def encode_tokens(docs: DataFrame, vocab: DataFrame, tokens: str = "tokens", out: str = "ids", vocab_max_rows: int | None = MAX_VOCAB, key: Sequence[str] = ()) -> DataFrame:
    """Add the id array of a token array, unknown tokens as <unk>.

    A bounded vocabulary is shipped once and looked up row-locally, so no token is shuffled. Of an
    unbounded one the smallest ids, its most frequent tokens, are shipped as far as the broadcast
    bound goes; only what they leave open is joined, and `key` names the row key to regroup by.
    """
    if vocab_max_rows is not None and vocab_max_rows <= MAX_BROADCAST_ROWS:
        rows = vocab.select("id", "token").orderBy("id").collect()  # at most vocab_max_rows
        if [r["id"] for r in rows] != list(range(len(rows))):
            raise ValueError("vocabulary ids must be 0..n-1")
        return docs.withColumn(out, token_positions(F.col(tokens), [r["token"] for r in rows], missing=UNK_ID))
    if not key:
        raise ValueError("an unbounded vocabulary needs the row key")
    head = vocab.select("id", "token").orderBy("id").limit(MAX_BROADCAST_ROWS + 1).collect()
    words, numbers = [r["token"] for r in head[:MAX_BROADCAST_ROWS]], [r["id"] for r in head[:MAX_BROADCAST_ROWS]]
    if len(head) <= MAX_BROADCAST_ROWS:
        return docs.withColumn(out, token_positions(F.col(tokens), words, missing=UNK_ID, ids=numbers))
    known = docs.withColumn(out, token_positions(F.col(tokens), words, missing=OPEN_ID, ids=numbers))
    tail = vocab.filter(F.col("id") > numbers[-1]).select(F.col("token").alias("_tok"), "id")
    cells = known.select(*key, F.posexplode_outer(F.arrays_zip(F.col(tokens).alias("t"), F.col(out).alias("i"))).alias("_pos", "_e"))
    rare = cells.filter(F.col("_e.i") == OPEN_ID).select(*key, "_pos", F.col("_e.t").alias("_tok"))
    found = rare.join(tail, "_tok").groupBy(*key).agg(F.collect_list("_pos").alias("_at"), F.collect_list("id").alias("_id"))
    back = known.join(found, list(key), "left")
    return back.withColumn(out, placed(F.col(out), F.col("_at"), F.col("_id"), OPEN_ID, UNK_ID)).drop("_at", "_id")


def pad_sequences(ids: Column, length: int = MAX_SEQ_LEN) -> tuple[Column, Column]:
    """(padded ids, mask): cut to `length`, filled with <pad>; mask is 1 on real tokens."""
    n = F.least(F.size(ids), F.lit(length))
    padded = F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(PAD_ID), F.lit(length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))
    return padded, mask


def chunk_sequences(df: DataFrame, ids: str = "ids", length: int = MAX_SEQ_LEN, overlap: int = OVERLAP, max_chunks: int | None = None, empty_id: int | str = 3) -> DataFrame:
    """One row per chunk (chunk, chunk_ids): windows of `length` every length - overlap tokens.

    All of a sequence, or its first `max_chunks` when asked for; an empty sequence gives one chunk with the `usr` id. The step runs to the
    end of the sequence, so the last chunk may lie inside the one before it.
    """
    step = max(1, length - overlap)
    n = F.size(ids)
    starts = F.sequence(F.lit(0), n - 1, F.lit(step))
    if max_chunks is not None:
        starts = F.slice(starts, 1, max_chunks)
    chunks = F.when(n > 0, F.transform(starts, lambda s: F.slice(F.col(ids), s + 1, length))).otherwise(
        F.array(F.array(F.lit(empty_id)))
    )
    return df.select("*", F.posexplode_outer(chunks).alias("chunk", "chunk_ids"))

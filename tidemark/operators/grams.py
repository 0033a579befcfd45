"""N-grams counted from token positions, vectorised in Arrow.

A document's grams are counted where its row is, so a pair (document, term) is never shuffled. Texts of
grams are only made for what leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import token_slices

#: Shuffle partitions for each scan partition in a count by gram; keeps a task's terms at some hundred MB.
PARTS_PER_SCAN = 24


class _Slice:
    """Token codes of some rows and dense ids of their n-grams."""

    def __init__(self, lists: pa.ListArray, max_n: int):
        self.size = len(lists)
        self.flat = lists.flatten()
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        self.rows = np.repeat(np.arange(self.size), lengths)
        self.last = np.repeat(np.cumsum(lengths), lengths)
        coded = self.flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts, self.ids = [np.arange(len(codes))], [codes]
        for n in range(2, max_n + 1):
            before = self.starts[-1]
            stays = before + n <= self.last[before] if len(before) else np.zeros(0, dtype=bool)
            starts = before[stays]
            keys = self.ids[-1][stays] * max(1, len(coded.dictionary)) + codes[starts + n - 1]
            self.starts.append(starts)
            self.ids.append(np.unique(keys, return_inverse=True)[1].astype(np.int64))

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into the n-gram starts, count) of each row's distinct n-grams at their first place."""
        ids = self.ids[n - 1]
        keys = self.rows[self.starts[n - 1]] * (ids.max(initial=0) + 1) + ids
        _, at, counts = np.unique(keys, return_index=True, return_counts=True)
        return at, counts

    def text(self, starts: np.ndarray, n: int) -> pa.Array:
        words = [self.flat.take(pa.array(starts + i)) for i in range(n)]
        return pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]


def term_counts(tokens: Column, max_n: int) -> Column:
    """array<struct<term, n>>: the distinct 1..max_n grams of a row's tokens and how often each occurs."""

    @F.arrow_udf("array<struct<term:string,n:bigint>>")
    def counted(col: pa.Array) -> pa.Array:
        return pa.concat_arrays([_row_counts(_Slice(s, max_n), max_n) for s in token_slices(col.cast(pa.list_(pa.string())))])

    return counted(tokens)


def _row_counts(part: _Slice, max_n: int) -> pa.Array:
    rows, terms, counts = [], [], []
    for n in range(1, max_n + 1):
        at, c = part.first(n)
        starts = part.starts[n - 1][at]
        rows.append(part.rows[starts])
        terms.append(part.text(starts, n))
        counts.append(c)
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    cells = pa.StructArray.from_arrays(
        [pa.concat_arrays(terms).take(pa.array(order)), pa.array(np.concatenate(counts)[order], pa.int64())], ["term", "n"]
    )
    offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=part.size))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)


def _start_rows(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lists in token_slices(batch.column(0).cast(pa.list_(pa.string()))):
            part = _Slice(lists, max_n)
            # Words: summed over the slice.
            at, counts = part.first(1)
            ids = part.ids[0][at]
            _, one = np.unique(ids, return_index=True)
            df, cf = np.bincount(ids), np.bincount(ids, weights=counts).astype(np.int64)
            words = part.text(part.starts[0][at][one], 1)
            zeros = np.ones(len(one), dtype=np.int32)
            yield _batch(words, zeros, df[ids[one]], cf[ids[one]])
            # Longer grams: one row for each start, its longest gram and the lengths that are new in the text.
            new = np.zeros(len(part.flat), dtype=np.int64)
            for n in range(2, max_n + 1):
                new[part.starts[n - 1][part.first(n)[0]]] |= 1 << n
            for n in range(2, max_n + 1):
                starts = part.starts[n - 1]
                longest = starts if n == max_n else np.setdiff1d(starts, part.starts[n], assume_unique=True)
                yield _batch(part.text(longest, n), np.full(len(longest), n, dtype=np.int32), new[longest], np.ones(len(longest), dtype=np.int64))


def _batch(term: pa.Array, words: np.ndarray, df: np.ndarray, cf: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([term, pa.array(words, pa.int32()), pa.array(df, pa.int64()), pa.array(cf, pa.int64())], ["term", "words", "df", "cf"])


def gram_stats(docs: DataFrame, max_n: int, tokens: str = "tokens", scan_partitions: int = 1) -> DataFrame:
    """(term, df, cf) of all 1..max_n grams; one row per document, tokens without blanks.

    Almost every longer gram is rare, so a map-side count would hold them all and save nothing. One row
    for each start of a gram goes to the task of its first two words, where every gram that starts
    there is counted: a third of the rows that one row per gram would take. Words are summed per batch.
    """
    starts = docs.select(tokens).mapInArrow(lambda batches: _start_rows(batches, max_n), "term string, words int, df bigint, cf bigint")
    keyed = starts.withColumn("_h", F.hash(F.substring_index("term", " ", 2)))
    parts = PARTS_PER_SCAN * scan_partitions
    wide = parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = keyed.repartition(parts, "_h") if wide else keyed.repartition("_h")
    word = F.array(F.struct("term", "df", "cf"))
    grams = [
        F.struct(F.substring_index("term", " ", n).alias("term"), F.getbit("df", F.lit(n)).cast("long").alias("df"), "cf") for n in range(2, max_n + 1)
    ]
    cells = F.when(F.col("words") == 1, word).otherwise(F.slice(F.array(*grams), 1, F.col("words") - 1)) if grams else word
    # Grouped within the partitions that the key already has: no second shuffle.
    return moved.select("_h", F.explode(cells).alias("e")).groupBy("_h", "e.term").agg(F.sum("e.df").alias("df"), F.sum("e.cf").alias("cf")).drop("_h")

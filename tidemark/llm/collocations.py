"""Collocations of each language by best-first branch-and-bound growth over prefixes.

A phrase of two to four words scores 2,000,000 a / (l + r) at its worst cut, a being its count, l and r those
of its parts. Every phrase that begins with p has a count of at most f(p) and, cut after its first word w,
parts that come f(w) and at least a times; so no score below p exceeds 2,000,000 f(p) / (f(w) + f(p)), and at
that score no count exceeds f(p). Growth goes from the best bound downwards: all words of one round's frontier
are followed in one pass over the corpus, to the left too, since a longer phrase on either side decides whether
a phrase stands. It ends when each language's last reported phrase, by score and count, is above every
bound left; phrases that equal it in both are grown too, so that ties fall by name.

What a task is told is bounded: a bitmap of pairs that may come often enough (hashed pair counts in
`PAIR_BITS` cells; a cell may hold several pairs, so it lets some rare ones pass but holds back no frequent
one) and a bitmap of the frontier of 2^24 bits for each length. Both only save work: counts are taken by
phrase, exactly, and a phrase is counted either at all of its places or at none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small_batches

LONGEST = 4
#: Hashed pair counts: 2^27 cells, dealt out in segments of 2^16.
PAIR_BITS, SEGMENT_BITS = 27, 16
#: Bits of a frontier bitmap for one length, dealt out in segments of 2^15.
FRONTIER_BITS, FRONTIER_SEGMENT = 24, 15
#: Text looked at together; how many candidates per reported phrase the first frontier reaches down to, and
#: how many times as many the next ones.
CHUNK_BYTES, AHEAD, WIDER = 8 << 20, 4, 4
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: What each byte is: 0 part of a word, 1 blank, 2 end of a piece; and its lower case.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Chunk:
    """Words of some texts: number, language and hash of each, and whether it continues the piece before."""

    def __init__(self, batch: pa.RecordBatch):
        texts, langs = (batch.column(n) for n in ("text", "lang"))
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = KIND[data]
        word = kind == 0
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] |= word[heads]
        at = np.flatnonzero(first)
        inside = np.cumsum(word, dtype=np.int32)
        bounds = np.append(inside[at] - 1, inside[-1] if len(inside) else 0).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(LOWER[data[word]])))
        coded = words.dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        row = np.searchsorted(offsets, at, side="right") - 1
        named = langs.dictionary_encode()
        self.langs, self.lang = named.dictionary, named.indices.to_numpy()[row].astype(np.int64)
        piece = np.cumsum(kind == 2, dtype=np.int32)[at]
        self.continues = np.zeros(len(at) + LONGEST, bool)
        self.continues[1 : len(at)] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        self.hashes, self.lang_hashes = hashed(self.words)[self.codes], hashed(self.langs)[self.lang]

    def places(self, size: int) -> np.ndarray:
        """Whether a phrase of `size` words begins at each word."""
        n = len(self.codes)
        return np.logical_and.reduce([self.continues[k : n + k] for k in range(1, size)]) if size > 1 else np.ones(n, bool)

    def phrase_hashes(self, size: int) -> np.ndarray:
        """Of the phrase that begins at each word; where none does, a value without meaning."""
        h, n = self.lang_hashes, len(self.codes)
        padded = np.append(self.hashes, np.zeros(size, np.uint64))
        for k in range(size):
            h = mixed(h, padded[k : n + k])
        return h

    def counted(self, at: np.ndarray, size: int) -> pa.RecordBatch:
        """The phrases of `size` words that begin at the words `at`, each with its number of places."""
        key, base = self.lang[at], len(self.words)
        for k in range(size):
            key = key * base + self.codes[at + k]
            if 1 < k + 1 < size:
                key = np.unique(key, return_inverse=True)[1]  # stays below 2^63
        _, one, count = np.unique(key, return_index=True, return_counts=True)
        at = at[one]
        parts = [self.words.take(pa.array(self.codes[at + k])) for k in range(size)]
        phrases = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[at])), phrases, pa.array(count.astype(np.int64))], ["lang", "phrase", "f"])


def hashed(strings: pa.StringArray) -> np.ndarray:
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * GOLDEN
    return h ^ (h >> np.uint64(32))


def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= CHUNK_BYTES:
            yield Chunk(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, size = [], 0
    if held:
        yield Chunk(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _followed(docs: DataFrame, out: str, per_chunk: Callable[[Chunk], Iterator[pa.RecordBatch]]) -> DataFrame:
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            if len(chunk.codes):
                yield from per_chunk(chunk)

    return docs.mapInArrow(follow, out)


PHRASES = "lang string, phrase string, f long"


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (one word), f of all words."""
    return _summed(_followed(docs, PHRASES, lambda c: iter([c.counted(np.arange(len(c.codes)), 1)])))


def frequent_cells(docs: DataFrame, least: int) -> np.ndarray:
    """Bitmap of the cells in which pairs of words come `least` times or more, all pairs of a cell together."""
    most = 255

    def cells(c: Chunk) -> Iterator[pa.RecordBatch]:
        cell = np.sort((c.phrase_hashes(2)[c.places(2)] >> np.uint64(64 - PAIR_BITS)).astype(np.uint32))
        if not len(cell):
            return
        edge = np.flatnonzero(np.diff(cell, prepend=cell[0] + 1))
        kinds, count = cell[edge], np.minimum(np.diff(edge, append=len(cell)), most).astype(np.uint8)
        segments, begin = np.unique(kinds >> SEGMENT_BITS, return_index=True)
        begin = np.append(begin, len(kinds))
        low = (kinds & (2**SEGMENT_BITS - 1)).astype(np.uint16)

        def binary(values: np.ndarray) -> pa.Array:
            return pa.BinaryArray.from_buffers(pa.binary(), len(segments), [None, pa.py_buffer((begin * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

        yield pa.RecordBatch.from_arrays([pa.array(segments.astype(np.int32)), binary(low), binary(count)], ["segment", "cells", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for segment, low, count in zip(*(b.column(i).to_pylist() for i in range(3))):
                total = sums.setdefault(segment, np.zeros(2**SEGMENT_BITS, np.uint8))
                at, more = np.frombuffer(low, np.uint16), np.frombuffer(count, np.uint8)
                total[at] = np.minimum(total[at].astype(np.uint16) + more, most)
        for segment, total in sums.items():
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([bits], pa.binary())], ["segment", "bits"])

    if least > most:
        raise ValueError(f"counts of at most {most}")
    parts = _followed(docs, "segment int, cells binary, counts binary", cells).repartition("segment")
    return _bitmap(parts.mapInArrow(added, "segment int, bits binary"), PAIR_BITS, SEGMENT_BITS)


def _bitmap(parts: DataFrame, bits: int, segment_bits: int) -> np.ndarray:
    """One array of the parts of a bitmap; 2^bits / 8 bytes, whatever the input."""
    out, size = np.zeros(2**bits // 8, np.uint8), 2**segment_bits // 8
    for segment, part in parts.toLocalIterator():
        out[segment * size : (segment + 1) * size] = np.frombuffer(bytes(part), np.uint8)
    return out


def frontier_bitmaps(phrases: DataFrame) -> dict[int, np.ndarray]:
    """For lengths 2 and 3, the bitmap of the hashes of `phrases` (lang, phrase)."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, lists = hashed(b.column("lang")), pc.split_pattern(b.column("phrase"), " ")
            sizes = pc.list_value_length(lists).to_numpy()
            words = hashed(lists.flatten())
            begin = np.cumsum(sizes) - sizes
            for k in range(3):
                rows = np.flatnonzero(sizes > k)
                h[rows] = mixed(h[rows], words[begin[rows] + k])
            at = (h >> np.uint64(64 - FRONTIER_BITS)).astype(np.int64) + (sizes.astype(np.int64) - 2 << FRONTIER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    at = phrases.select("lang", "phrase").mapInArrow(positions, "at long")
    segment = F.shiftright("at", FRONTIER_SEGMENT).cast("int").alias("segment")
    parts = at.groupBy(segment).agg(F.bitmap_construct_agg(F.col("at") % 2**FRONTIER_SEGMENT))
    both = _bitmap(parts, FRONTIER_BITS + 1, FRONTIER_SEGMENT)
    half = len(both) // 2
    return {2: both[:half], 3: both[half:]}


def _frequent_pairs(c: Chunk, cells: np.ndarray) -> np.ndarray:
    return c.places(2) & holds(cells, c.phrase_hashes(2) >> np.uint64(64 - PAIR_BITS))


def pair_counts(docs: DataFrame, cells, least: int) -> DataFrame:
    def pairs(c: Chunk) -> Iterator[pa.RecordBatch]:
        yield c.counted(np.flatnonzero(_frequent_pairs(c, cells.value)), 2)

    return _summed(_followed(docs, PHRASES, pairs)).filter(F.col("f") >= least)


def grown(docs: DataFrame, frontier: DataFrame, cells, least: int) -> DataFrame:
    """Counts of the phrases one word longer, to the right or left, than a phrase of the frontier."""
    shared = docs.sparkSession.sparkContext.broadcast(frontier_bitmaps(frontier))

    def longer(c: Chunk) -> Iterator[pa.RecordBatch]:
        frequent, n = _frequent_pairs(c, cells.value), len(c.codes)
        padded = np.append(frequent, np.zeros(LONGEST, bool))
        for size in (2, 3):
            inside = c.places(size) & holds(shared.value[size], c.phrase_hashes(size) >> np.uint64(64 - FRONTIER_BITS))
            grow = c.places(size + 1) & (inside | np.append(inside[1:], False))
            for k in range(size):
                grow &= padded[k : n + k]
            yield c.counted(np.flatnonzero(grow), size + 1)

    return _summed(_followed(docs, PHRASES, longer)).filter(F.col("f") >= least)


def n_words(phrase: str = "phrase") -> Column:
    return F.size(F.split(phrase, " "))


def _score(a: str, parts: str) -> Column:
    return F.expr(f"cast({a} as decimal(20,0)) * 2000000 div ({parts})")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, bound, l, r, score of the phrases all of whose parts are counted.

    The lowest-scoring cut counts, of equal ones the first. `bound` is the highest score that a phrase
    with this one in front can have.
    """
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), words.alias("words"), F.size(words).alias("size"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    # Counts are one row per (lang, phrase); a frequent first word makes a hot key of the join, which AQE splits.
    for side, f in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f)), ["lang", side])
    cuts = cuts.withColumn("score", _score("a", "cast(l as decimal(20,0)) + r"))
    first = F.max(F.when(F.col("k") == 1, F.col("l")))
    worst = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.count("*").alias("cuts"), first.alias("first"))
    known = worst.filter(F.col("cuts") == F.col("size") - 1)
    return known.select("lang", "phrase", "size", "a", _score("a", "cast(first as decimal(20,0)) + a").alias("bound"), "cut.l", "cut.r", "cut.score")


BEST_FIRST = [F.desc, F.desc, F.asc]


def _ranked(phrases: DataFrame) -> DataFrame:
    order = [by(c) for by, c in zip(BEST_FIRST, ("score", "a", "phrase"))]
    return phrases.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))


def _line(phrases: DataFrame, rank: int) -> DataFrame:
    """lang, line (score, a): where the phrase of that rank stands; no row for a language with fewer."""
    return _ranked(phrases).filter(F.col("rank") <= rank).filter(F.col("rank") == rank).select("lang", F.struct(F.col("score").alias("s"), F.col("a").alias("a")).alias("line"))


def _above(phrases: DataFrame, line: DataFrame) -> DataFrame:
    """Phrases below which, by their bound, a phrase on the line or above can stand; all where there is no line."""
    reach = F.struct(F.col("bound").alias("s"), F.col("a").alias("a"))
    return phrases.join(line, "lang", "left").filter(F.col("line").isNull() | (reach >= F.col("line"))).drop("line")


def _standing(phrases: DataFrame) -> DataFrame:
    """Without the phrases inside a longer one that comes at least four fifths as often.

    One more word decides: what lies inside an even longer phrase lies inside the phrase between, which
    comes at least as often as that.
    """
    words = F.split("phrase", " ")
    longer = phrases.filter("size > 2").select("lang", "a", F.explode(F.array(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1))).alias("inner"))
    around = longer.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("longer"))
    joined = phrases.join(around, ["lang", "phrase"], "left")
    inside = F.expr("cast(longer as decimal(20,0)) * 5 >= cast(a as decimal(20,0)) * 4")
    return joined.filter(F.col("longer").isNull() | ~inside).drop("longer")


def _lowered(line: DataFrame, reach: DataFrame, lowest: DataFrame) -> DataFrame:
    """The next line: down to `reach`, not below `lowest`, never above `line`; without one where all is followed."""
    both = reach.withColumnRenamed("line", "reach").join(lowest.withColumnRenamed("line", "lowest"), "lang", "full")
    return both.join(line, "lang").select("lang", F.least("line", F.greatest("reach", "lowest")).alias("line"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two to four words.

    Texts (null: empty) are lower-cased from A to Z, cut at `.,;:!?` and line ends into pieces and those at
    blanks and tabs into words; a null language is `und`. f counts all places inside pieces, overlaps
    included; n all words. Phrases with a = f >= `least` (255 at most) are candidates; those inside a longer
    one that comes at least four fifths as often go. Order: score, a, then the phrase in byte order. Repeated
    rows count as often as they stand there, other columns don't matter, an empty table gives no rows.
    Every pass goes over all texts, whole; tables grow with the distinct phrases, per language only the
    reported number is ranked.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    words = checkpointed(word_counts(docs))
    cells = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, least))
    pairs = checkpointed(pair_counts(docs, cells, least))
    frequent = words.filter(F.col("f") >= least).unionByName(pairs)
    known = checkpointed(scored(pairs, frequent))
    ahead = AHEAD * top
    line = _line(known, ahead)
    while True:
        frontier = _above(known.filter("size < 4"), line).select("lang", "phrase")
        tails = frontier.filter(n_words() == 3).select("lang", F.substring_index("phrase", " ", -2).alias("phrase"))
        frontier = checkpointed(frontier.unionByName(tails).distinct())
        longer = checkpointed(grown(docs, frontier, cells, least))
        known = checkpointed(scored(pairs.unionByName(longer), frequent.unionByName(longer)))
        followed = known.join(frontier.withColumn("followed", F.lit(True)), ["lang", "phrase"], "left")
        settled = checkpointed(_standing(followed).filter("size = 4 or followed").drop("followed", "bound"))
        lowest = _line(settled, top)
        left = _above(followed.filter("size < 4 and followed is null"), lowest)
        if left.isEmpty():
            break
        ahead *= WIDER
        line = checkpointed(_lowered(line, _line(known, ahead), lowest))
    best = _ranked(settled).filter(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

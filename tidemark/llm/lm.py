"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are taken from all training texts, quantised to levels
1 + floor(log(count) / log(BASE)), and put into a Bloom filter under every level up to their own. A query
probes level after level until one is missing; the last hit is the quantised count. The filter is cut into
segments by key, each built by one group from the counts that fall into it; its size is BITS_PER_TOKEN times
the training tokens at every size of the corpus. A filter of at most `max_filter_bytes` is broadcast. A larger
one stays distributed, in more segments: texts are dealt into chunks of bounded size, the distinct keys of a
chunk go to their groups of segments, and one byte for each, its level, comes back to the chunk.

Pair probabilities are smoothed with a Dirichlet prior on the word probabilities:
(c(u v) + MU * p(v)) / (c(u) + MU), p(v) = (c(v) + 1) / (N + V + 1).

The base score needs exact counts of single words: the most frequent ones, a bounded table, are looked up in
the task, all others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small_batches, text_or_empty, worker_cache

BASE, MU = 1.5, 2000.0
HASHES, BITS_PER_TOKEN, MAX_FILTER_BYTES, SEGMENTS = 4, 5, 256 << 20, 1024
#: A distributed filter has segments of at most so many bytes.
SEGMENT_BYTES = 256 << 10
#: Neighbouring segments of so many bytes in all answer together.
GROUP_BYTES = 4 << 20
#: Keys probed at once.
PROBED = 1 << 16
#: Slots for keys whose levels a worker remembers.
REMEMBERED = 1 << 20
#: Size of the table of frequent words that every worker holds.
FREQUENT = 200_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
#: The end of a text as a word: white space, so no word of a text equals it.
END = b"\n"
FLUSH, PAIR_TOKENS, CHUNK_TOKENS = 300_000, 2_000_000, 500_000
_U = np.uint64


def words_of(text: str) -> list[bytes]:
    """Words in lower case (A-Z only) as UTF-8; bytes.split() cuts at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, dtype=np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    return _hashes(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))


def array_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of a binary array without nulls and empty words."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return _hashes(data, np.diff(offsets).astype(np.int64))


def _hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words of `lengths` bytes that lie end to end in `data`."""
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(data)) - np.repeat(starts, lengths)
    values = (data.astype(np.uint64) + _U(1) + (at >> 16).astype(np.uint64) * _U(257)) * _POWERS[at & 0xFFFF]
    return mixed(np.add.reduceat(values, starts)) if len(starts) else np.empty(0, np.uint64)


class Words:
    """Where the words of the texts of one batch start and end."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.is_word = WORD_BYTE[self.data]
        first = self.is_word.copy()
        first[1:] &= ~self.is_word[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] |= self.is_word[heads]
        self.at = np.flatnonzero(first)
        cuts = np.searchsorted(self.at, offsets)
        self.starts, self.lengths = cuts[:-1], np.diff(cuts)


class Coded(Words):
    """Words of the texts of one batch, each distinct word once: `codes` point into `words`."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        inside = np.cumsum(self.is_word, dtype=np.int32)
        bounds = np.append(inside[self.at] - 1, inside[-1] if len(inside) else 0).astype(np.int32)
        lower = np.frombuffer(LOWER, np.uint8)[self.data[self.is_word]]
        words = pa.Array.from_buffers(pa.binary(), len(self.at), [None, pa.py_buffer(bounds), pa.py_buffer(lower)])
        coded = words.dictionary_encode()
        self.codes, self.words = coded.indices.to_numpy(), coded.dictionary
        self.hashes = array_hashes(self.words)


def single_keys(h: np.ndarray) -> np.ndarray:
    return mixed(h + _U(0x51ED270B))


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _U(0x2545F4914F6CDD1D) + b)


START_HASH, END_HASH = word_hashes([b"\t"])[0], word_hashes([END])[0]


def pair_sequence(values: np.ndarray, lengths, start=START_HASH, end=END_HASH) -> tuple[np.ndarray, np.ndarray]:
    """Left and right value (the hash) of every pair of consecutive words, with `start` before and `end` after each text."""
    n = np.array(lengths, dtype=np.int64)
    ends = np.cumsum(n + 1) - 1
    right = np.empty(len(values) + len(n), values.dtype)
    is_end = np.zeros(len(right), bool)
    is_end[ends] = True
    right[is_end], right[~is_end] = end, values
    left = np.empty_like(right)
    left[1:] = right[:-1]
    left[np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)] = start
    return left, right


def packed(keys: np.ndarray, counts: np.ndarray, segments: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Rows (segment, 40-bit keys, sparse counts above one) of sorted keys."""
    shift = _U(64 - int(math.log2(segments)))
    seg = (keys >> shift).astype(np.int64)
    low = ((keys << _U(64) - shift) >> _U(24)).astype("<u8") if segments > 1 else (keys >> _U(24)).astype("<u8")
    cuts = np.searchsorted(seg, np.arange(segments + 1))
    five = low.view(np.uint8).reshape(-1, 8)[:, :5]
    for s in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[s], cuts[s + 1]
        more = np.flatnonzero(counts[a:b] > 1)
        extra = np.stack([more, counts[a:b][more]], 1).astype("<i8")
        yield int(s), np.ascontiguousarray(five[a:b]).tobytes(), extra.tobytes()


def unpacked(keys: bytes, extra: bytes) -> tuple[np.ndarray, np.ndarray]:
    five = np.frombuffer(keys, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(five), 8), np.uint8)
    wide[:, :5] = five
    counts = np.ones(len(five), np.int64)
    more = np.frombuffer(extra, "<i8").reshape(-1, 2)
    counts[more[:, 0]] = more[:, 1]
    return wide.reshape(-1).view("<u8"), counts


def levels(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9)).astype(np.int64)


def level_counts(most: int = 120) -> np.ndarray:
    """The mean of the whole counts of each level; 0 for level 0."""
    j = np.arange(1, most)
    low, high = np.ceil(BASE ** (j - 1) - 1e-9), np.ceil(BASE**j - 1e-9) - 1
    return np.concatenate([[0.0], (low + np.maximum(high, low)) / 2])


def _bits(low: np.ndarray, level: int, i: int, seg_bits: int) -> np.ndarray:
    x = mixed(low + _U(0xD6E8FEB86659FD93 * (level * HASHES + i) % (1 << 64)))
    # The remainder; numpy divides by one number faster than it takes remainders.
    return x - x // _U(seg_bits) * _U(seg_bits)


def segment_filter(low: np.ndarray, counts: np.ndarray, seg_bits: int) -> bytes:
    low, counts = _summed(low, counts)
    top = levels(counts)
    bits, j = np.zeros(seg_bits, bool), 1
    while len(low):
        for i in range(HASHES):
            bits[_bits(low, j, i, seg_bits).view(np.int64)] = True
        j += 1
        keep = top >= j
        low, top = low[keep], top[keep]
    return np.packbits(bits, bitorder="little").tobytes()


def probed(filter_: np.ndarray, keys: np.ndarray, segments: int, seg_bits: int) -> np.ndarray:
    """The quantised count of every key: probes level after level until one is missing."""
    return level_counts()[probed_levels(filter_, keys, segments, seg_bits)]


def probed_levels(filter_: np.ndarray, keys: np.ndarray, segments: int, seg_bits: int, first: int = 0) -> np.ndarray:
    """The last level of every key in the filter, one byte each; `filter_` starts at segment `first`."""
    shift, found = _U(64 - int(math.log2(segments))), np.zeros(len(keys), np.uint8)
    for start in range(0, len(keys), PROBED):
        part = keys[start : start + PROBED]
        base = ((part >> shift).astype(np.int64) - first) * (seg_bits // 8) if segments > 1 else np.zeros(len(part), np.int64)
        low = (part << (_U(64) - shift)) >> _U(24) if segments > 1 else part >> _U(24)
        at, j = np.arange(start, start + len(part)), 1
        while len(at) and j < 119:
            for i in range(HASHES):
                bit = _bits(low, j, i, seg_bits)
                byte = filter_[(bit >> _U(3)).view(np.int64) + base]
                hit = ((byte >> (bit & _U(7)).astype(np.uint8)) & 1).view(bool)
                if not hit.all():
                    low, base, at = low[hit], base[hit], at[hit]
            found[at] = j
            j += 1
    return found


class Remembered:
    """Levels of keys probed before: a slot keeps its key of the highest level, as that takes most probes."""

    def __init__(self, slots: int = REMEMBERED):
        self.keys, self.levels = np.zeros(slots, np.uint64), np.zeros(slots, np.uint8)
        self.keys[0] = 1  # belongs elsewhere, so no slot seems to hold a key at first

    def of(self, keys: np.ndarray, probe) -> np.ndarray:
        """Levels of distinct keys; `probe` gives those of keys that aren't held."""
        slot = (keys & _U(len(self.keys) - 1)).view(np.int64)
        found, new = self.levels[slot], np.flatnonzero(self.keys[slot] != keys)
        got = probe(keys[new])
        higher = got >= found[new]
        found[new] = got
        new, got = new[higher], got[higher]
        self.keys[slot[new]], self.levels[slot[new]] = keys[new], got
        return found


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """(token, c) over all training texts, the end of a text included; counted in the task, then summed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(words_of(t))
            counts[END] += batch.num_rows
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
        if counts:
            yield out()

    rows = train.select(text_or_empty(text).alias("t")).mapInArrow(counted, "token binary, n long")
    return rows.groupBy("token").agg(F.sum("n").alias("c"))


def _packed_batch(keys: np.ndarray, counts: np.ndarray, segments: int) -> pa.RecordBatch:
    rows = list(packed(keys, counts, segments))
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], ["seg", "keys", "extra"])


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def filter_shape(tokens: int, segments: int, max_bytes: int, segment_bytes: int = SEGMENT_BYTES) -> tuple[int, int, bool]:
    """Segments, bits of one, and whether the filter is small enough for a broadcast."""
    shape = lambda n: 8 * max(64, math.ceil(BITS_PER_TOKEN * max(tokens, 1) / n / 8))
    if segments * shape(segments) // 8 <= max_bytes:
        return segments, shape(segments), True
    while shape(segments) > 8 * max(64, segment_bytes):
        segments *= 2
    return segments, shape(segments), False


def bloom_filter(train: DataFrame, vocabulary: DataFrame, text: str, segments: int, seg_bits: int) -> DataFrame:
    """(seg, bits): the filter over single words and pairs of all training texts, `seg_bits` bits a segment."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                coded = Coded(batch.column(0))
                held.append(pair_keys(*pair_sequence(coded.hashes[coded.codes], coded.lengths)))
            if sum(map(len, held)) > PAIR_TOKENS:
                yield _packed_batch(*_summed(np.concatenate(held)), segments)
                held.clear()
        if held:
            yield _packed_batch(*_summed(np.concatenate(held)), segments)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append((single_keys(array_hashes(batch.column(0))), batch.column(1).to_numpy().copy()))
            if sum(len(k) for k, _ in held) > PAIR_TOKENS:
                yield _packed_batch(*_summed(*map(np.concatenate, zip(*held))), segments)
                held.clear()
        if held:
            yield _packed_batch(*_summed(*map(np.concatenate, zip(*held))), segments)

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(k, e) for k, e in zip(pdf["keys"], pdf["extra"])]
        low, counts = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"seg": [pdf["seg"].iloc[0]], "bits": [segment_filter(low, counts, seg_bits)]})

    schema = "seg int, keys binary, extra binary"
    start = vocabulary.filter(F.col("token") == F.lit(END)).select(F.lit(b"\t").alias("token"), "c")
    rows = train.select(text_or_empty(text).alias("t")).mapInArrow(pairs, schema)
    rows = rows.unionByName(vocabulary.select("token", "c").unionByName(start).mapInArrow(singles, schema))
    return rows.groupBy("seg").applyInPandas(built, "seg int, bits binary")


def _gathered(filter_: DataFrame, segments: int, seg_bits: int) -> np.ndarray:
    """The whole filter; it passes through the driver on its way to the broadcast, as Arrow buffers."""
    whole = np.zeros((segments, seg_bits // 8), np.uint8)
    for batch in filter_.toArrow().to_batches():
        for seg, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
            whole[seg] = np.frombuffer(bits.as_buffer(), np.uint8)
    return whole.reshape(-1)


def _keys_of(coded: Coded) -> np.ndarray:
    """The distinct keys that the score of texts looks up, in order."""
    single = single_keys(np.append(coded.hashes, [START_HASH, END_HASH]))
    # With counts: without, numpy goes through a hash table, which takes several times as long as a sort.
    return np.unique(np.concatenate([single, pair_keys(*pair_sequence(coded.hashes[coded.codes], coded.lengths))]), return_counts=True)[0]


def _chunked(rows: DataFrame, chunk_tokens: int) -> DataFrame:
    """`rows` (_row, _t) with `_chunk`: neighbours of some `chunk_tokens` words, or one longer text."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            names = []
            for n in (Words(batch.column(1)).lengths + 1).tolist():
                if held and held + n > chunk_tokens:
                    chunk, held = chunk + 1, 0
                held += n
                names.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64())], ["_row", "_t", "_chunk"])

    kind = rows.schema["_row"].dataType.simpleString()
    return checkpointed(rows.mapInArrow(dealt, f"_row {kind}, _t string, _chunk long"))


def _blobs(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array of values of `lengths` bytes that lie end to end in `data`."""
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def _answers(chunks: DataFrame, filter_: DataFrame, segments: int, seg_bits: int) -> DataFrame:
    """(_chunk, part, levels): what a distributed filter holds for the keys of every chunk, cut by groups of segments.

    The levels of a chunk in the order of `part` are those of its keys in order.
    """
    each = max(1, min(segments, 1 << int(math.log2(max(1, 8 * GROUP_BYTES // seg_bits)))))
    parts = segments // each

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts = None, []

        def out():
            keys = _keys_of(Coded(pa.concat_arrays(texts)))
            part = (keys >> _U(64 - int(math.log2(parts)))).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(keys)]])
            names = part[cuts[:-1]]
            columns = [pa.array(names, pa.int32()), pa.array([chunk] * len(names), pa.int64()), _blobs(keys.astype("<u8"), 8 * np.diff(cuts))]
            return pa.RecordBatch.from_arrays(columns, ["part", "_chunk", "keys"])

        for batch in batches:
            names = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if names[a] != chunk and texts:
                    yield out()
                    texts.clear()
                chunk = int(names[a])
                texts.append(batch.column(0).slice(a, b - a))
        if texts:
            yield out()

    def answered(asks: pa.Table, own: pa.Table) -> pa.Table:
        names, found = ["_chunk", "part", "levels"], []
        if not len(asks):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], names)
        first = asks.column("part")[0].as_py() * each
        # A segment without counts has no row.
        bits = np.zeros((each, seg_bits // 8), np.uint8)
        for batch in own.to_batches():
            for seg, blob in zip(batch.column("seg").to_pylist(), batch.column("bits")):
                bits[seg - first] = np.frombuffer(blob.as_buffer(), np.uint8)
        bits = bits.reshape(-1)
        for batch in asks.to_batches():
            blobs = batch.column("keys")
            bounds = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
            keys = np.frombuffer(blobs.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view("<u8")
            levels_ = _blobs(probed_levels(bits, keys, segments, seg_bits, first), np.diff(bounds) // 8)
            found.append(pa.RecordBatch.from_arrays([batch.column("_chunk"), batch.column("part"), levels_], names))
        return pa.Table.from_batches(found)

    asks = chunks.select("_t", "_chunk").mapInArrow(asked, "part int, _chunk long, keys binary")
    own = filter_.withColumn("part", F.floor(F.col("seg") / each).cast("int"))
    return asks.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(answered, "_chunk long, part int, levels binary")


def score(
    docs: DataFrame,
    train_rows,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    segments: int = SEGMENTS,
    max_filter_bytes: int = MAX_FILTER_BYTES,
    frequent: int = FREQUENT,
    chunk_tokens: int = CHUNK_TOKENS,
) -> DataFrame:
    """One row per document: `keep` columns, n_tokens, n_known, train_tokens, base_score, score.

    `train_rows`: boolean column, true for the documents to learn from. A null text counts as empty: its only
    token is the end. Without training rows all counts are 0 and the base score is 0. Repeated rows are
    counted, learnt and returned as often as they come.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train = docs.filter(train_rows)
    vocabulary = checkpointed(word_counts(train, text))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    segments, seg_bits, small = filter_shape(total, segments, max_filter_bytes)
    filter_ = bloom_filter(train, vocabulary, text, segments, seg_bits)
    bloom = spark.sparkContext.broadcast(_gathered(filter_, segments, seg_bits)) if small else None
    top = vocabulary.orderBy(F.desc("c"), "token").limit(frequent).toArrow()
    table = spark.sparkContext.broadcast((top.column("token").to_pylist(), np.array(top.column("c"), dtype=np.int64)))
    del top
    norm = math.log10(total + distinct + 1)

    def tabled() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words of the table in the order of their hashes, the hashes, log counts; made once by every worker."""
        cache = worker_cache()
        if cache.get("lm_table") is not table.value:
            words = pa.array(table.value[0], pa.binary())
            hashes = array_hashes(words)
            order = np.argsort(hashes, kind="stable")
            cache["lm_levels"] = Remembered()
            cache["lm_table"], cache["lm_logs"] = table.value, (words.take(pa.array(order)), hashes[order], np.log10(table.value[1] + 1.0)[order])
        return cache["lm_logs"]

    def logs_of(words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Log counts of words, NaN for those not in the table. A word is compared itself, so equal hashes do no harm."""
        held, known, logs = tabled()
        if not len(held) or not len(words):
            return np.full(len(words), np.nan)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        same = known[at] == hashes
        same[same] = pc.equal(held.take(pa.array(at[same])), words.filter(pa.array(same))).to_numpy(zero_copy_only=False)
        return np.where(same, logs[at], np.nan)

    def of_rows(ids, coded: Coded, counts) -> pa.RecordBatch:
        codes, lengths, rows = coded.codes, coded.lengths, len(coded.lengths)
        end = logs_of(pa.array([END], pa.binary()), np.array([END_HASH]))[0]
        value = logs_of(coded.words, coded.hashes)[codes]
        known = ~np.isnan(value)
        row, ends = np.repeat(np.arange(rows), lengths), [] if np.isnan(end) else [float(end)]
        good = np.where(known, value, 0.0).tolist()
        base = [math.fsum(good[a : a + n] + ends) for a, n in zip(coded.starts.tolist(), lengths.tolist())]
        sure = np.bincount(row[known], minlength=rows) + len(ends)
        # Unknown words, each once a row; the end of a text follows the words of the batch.
        kinds = len(coded.words) + 1
        unknown = row[~known] * kinds + codes[~known]
        if not ends:
            unknown = np.append(unknown, np.arange(rows) * kinds + kinds - 1)
        unknown, often = np.unique(unknown, return_counts=True)
        words = pa.concat_arrays([coded.words, pa.array([END], pa.binary())]).take(pa.array(unknown % kinds))
        cuts = pa.array(np.searchsorted(unknown, np.arange(rows + 1) * kinds), pa.int32())
        left, right = pair_sequence(coded.hashes[codes], lengths)
        single = counts(single_keys(np.append(coded.hashes, [START_HASH, END_HASH])))
        before, own = pair_sequence(single[:-2][codes], lengths, single[-2], single[-1])
        pair = counts(pair_keys(left, right))
        p = (pair + MU * (own + 1.0) / (total + distinct + 1.0)) / (np.maximum(before, pair) + MU)
        starts = np.cumsum(lengths + 1) - lengths - 1
        sums = np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts) if len(p) else np.empty(0)
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(lengths.astype(np.int64) + 1),
                pa.array(sure, pa.int64()),
                pa.array(base, pa.float64()),
                pa.array(sums, pa.float64()),
                pa.ListArray.from_arrays(cuts, words),
                pa.ListArray.from_arrays(cuts, pa.array(often, pa.int64())),
            ],
            ["_row", "n_tokens", "_sure", "_base", "score", "_rare", "_times"],
        )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tabled()
        bits, remembered = bloom.value, worker_cache()["lm_levels"]

        def counts(keys: np.ndarray) -> np.ndarray:
            keys, at = np.unique(keys, return_inverse=True)
            return level_counts()[remembered.of(keys, lambda new: probed_levels(bits, new, segments, seg_bits))][at]

        for batch in batches:
            yield of_rows(batch.column(0), Coded(batch.column(1)), counts)

    def scored_chunk(rows: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        found = level_counts()[np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)]
        coded = Coded(rows.column("_t").combine_chunks())
        keys = _keys_of(coded)
        ids = rows.column("_row").combine_chunks()

        def counts(wanted: np.ndarray) -> np.ndarray:
            wanted, at = np.unique(wanted, return_inverse=True)
            return found[np.searchsorted(keys, wanted)][at]

        return pa.Table.from_batches([of_rows(ids, coded, counts)])

    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    kept = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    # Row numbers only have to last from here to the checkpoint, which fixes them together with the kept columns.
    packed_row = F.struct(F.col("_row"), *kept).alias("_row")
    kind = numbered.select(packed_row).schema["_row"].dataType.simpleString()
    schema = f"_row {kind}, n_tokens long, _sure long, _base double, score double, _rare array<binary>, _times array<long>"
    texts = numbered.select(packed_row, text_or_empty(text).alias("_t"))
    if small:
        rows = checkpointed(texts.mapInArrow(scored, schema))
    else:
        chunks = _chunked(texts, chunk_tokens)
        answers = _answers(chunks, filter_, segments, seg_bits)
        rows = checkpointed(chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(scored_chunk, schema))
    rare = rows.select(F.col("_row._row").alias("_id"), F.explode(F.arrays_zip("_rare", "_times")).alias("_z"))
    rare = rare.select("_id", F.col("_z._rare").alias("token"), F.col("_z._times").alias("_times"))
    met = rare.join(vocabulary, "token", "left").groupBy("_id").agg(
        F.sum(F.col("_times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("_more"), F.sum(F.when(F.col("c") > 0, F.col("_times"))).alias("_met")
    )
    out = rows.withColumn("_id", F.col("_row._row")).join(met, "_id", "left")
    return out.select(
        *[F.col(f"_row._keep_{i}").alias(c) for i, c in enumerate(keep)],
        "n_tokens",
        (F.col("_sure") + F.coalesce("_met", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )

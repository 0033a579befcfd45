"""Periodic runs of words by string synchronising sets.

The words of many texts stand as numbers in one array, texts parted by numbers of their own. At the
scale t = 1, 2, 4, ... a position is *selected* if, of the stretches of t words that begin in its window of
t + 1 positions, one with the smallest hash begins at the window's first or last position; stretches with a
period of t / 3 or less don't count. Selection depends on the 2 t words from the position on (its *context*)
alone, so equal contexts are selected alike, and any t positions in a row hold a selected one unless all
that is around them has a period of t / 3 or less.

A run of smallest period q in [2t, 4t) holds a selected position i in its first q words (else the run
would have a shorter period), and i + q is selected with the same context. Contexts have no period of t / 3 or
less, so fewer than 12 equal ones begin between them: each selected position proposes its distances in
[2t, 4t) to the next 12 of equal context, and every proposal is extended word by word as far as the period
holds. The stretches that selection leaves out lie in runs of periods up to t / 3, which smaller scales have
found; the smallest period of all, 1, is read off equal neighbours. Nothing is guessed: every run is found
and every proposal is verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, text_or_empty

#: Repeats that make a run, and equal contexts that can begin within one period (see above).
REPEATS, PARTNERS = 3, 12
#: Words of texts looked at together; a longer text is looked at alone.
GROUP_WORDS = 400_000
FOUND = "runs array<struct<start:long,length:long,period:long>>, kept array<struct<start:long,length:long>>"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _hashed(names: np.ndarray, scale: int) -> np.ndarray:
    h = (names.astype(np.uint64) + np.uint64(scale + 1)) * GOLDEN
    h ^= h >> np.uint64(29)
    return h * GOLDEN


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of `width` positions that lies inside the array."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _named(names: np.ndarray, step: int) -> np.ndarray:
    """Names of stretches twice as long: equal names for equal stretches.

    A stretch can only come again if both its halves do; all others get a name without comparison.
    """
    again = _again(names)
    both = again[: len(names) - step] & again[step:]
    at = np.flatnonzero(both)
    pairs = names[at] * (int(names.max(initial=0)) + 1) + names[at + step]
    kinds, same = np.unique(pairs, return_inverse=True)
    out = np.empty(len(both), np.int64)
    out[at] = same
    out[~both] = np.arange(len(kinds), len(kinds) + len(both) - len(at))
    return out


def _again(names: np.ndarray) -> np.ndarray:
    """Whether the name of a position stands at another position, too."""
    return (np.bincount(names) > 1)[names]


def _extended(words: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """The longest stretch around i, i + q whose words q apart are identical."""
    end, grow = i + q, 32
    while end < len(words):
        a, b = words[end : end + grow], words[end - q : end - q + grow]
        differ = np.flatnonzero(a != b[: len(a)])
        if len(differ):
            end += int(differ[0])
            break
        end += len(a)
        grow *= 2
    start, grow = i, 32
    while start > 0:
        low = max(0, start - grow)
        differ = np.flatnonzero(words[low:start] != words[low + q : start + q])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start = low
        grow *= 2
    return start, end


def _ones(words: np.ndarray) -> dict[tuple[int, int], int]:
    """Stretches of equal words."""
    edge = np.flatnonzero(np.diff(words, prepend=-1, append=-1) != 0)
    long = np.flatnonzero(np.diff(edge) >= REPEATS)
    return {(int(edge[k]), int(edge[k + 1])): 1 for k in long}


def _proposals(context: np.ndarray, chosen: np.ndarray, t: int) -> np.ndarray:
    """(position, distance) of selected positions and the next ones of equal context, 2t to 4t - 1 further on."""
    order = np.lexsort((chosen, context[chosen]))
    at = chosen[order]
    name = context[at]
    found = []
    for k in range(1, PARTNERS + 1):
        if k >= len(at):
            break
        away = at[k:] - at[:-k]
        near = (name[k:] == name[:-k]) & (away < 4 * t)
        if not near.any():
            break
        hit = np.flatnonzero(near & (away >= 2 * t))
        found.append(np.stack([at[hit], away[hit]], 1))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all maximal stretches of three periods or more in an array of numbers >= 0."""
    runs = _ones(words)
    names, t = np.unique(words, return_inverse=True)[1], 1  # names of stretches of t words
    while 2 * t * REPEATS <= len(words):
        context = _named(names, t)
        hashes = _hashed(names, t)
        for (start, end), q in runs.items():
            if REPEATS * q <= t <= end - start:
                hashes[start : end - t + 1] = np.iinfo(np.uint64).max
        least = _window_min(hashes, t + 1)[: len(context)]
        own, last = hashes[: len(least)], hashes[t : t + len(least)]
        none = np.iinfo(np.uint64).max
        repeated = _again(context)
        chosen = np.flatnonzero((least < none) & ((own == least) | (last == least)) & repeated[: len(least)])
        proposed = _proposals(context, chosen, t)
        done: dict[int, int] = {}
        for i, q in proposed[np.lexsort((proposed[:, 0], proposed[:, 1]))].tolist():
            if i + q <= done.get(q, -1):
                continue  # inside the stretch found last for this period
            start, end = _extended(words, i, q)
            done[q] = end
            if end - start >= REPEATS * q:
                runs.setdefault((start, end), q)  # of equal stretches the smallest period came first
        if not repeated.any():
            break
        names, t = context, 2 * t
    return [(start, end, q) for (start, end), q in runs.items()]


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, each text with its own and closed by a further one, and where the texts begin."""
    codes = lists.flatten().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    ends = np.cumsum(sizes)
    top = int(codes.max(initial=-1)) + 1
    codes += np.repeat(np.arange(len(sizes)) * top, sizes)
    joined = np.insert(codes, ends, np.arange(len(sizes) * top, len(sizes) * (top + 1)))
    return joined, np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])


def _kept(found: list[tuple[int, int, int]], words: int) -> list[tuple[int, int]]:
    """(start, length) of the spans of words that no run (start, length, period; by start) drops."""
    spans, at = [], 0
    for a, b in sorted((start + q, start + length) for start, length, q in found):
        if a > at:
            spans.append((at, a - at))
        at = max(at, b)
    return [*spans, (at, words - at)] if at < words else spans


def _of_lists(lists: pa.ListArray, least: int) -> pa.Array:
    words, begins = _coded(lists)
    found = [r for r in find_runs(words) if r[1] - r[0] >= least]
    owner = np.searchsorted(begins, [r[0] for r in found], side="right") - 1
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(len(lists))]
    for k, (start, end, q) in zip(owner.tolist(), found):
        rows[k].append((start - int(begins[k]), end - start, q))
    for row in rows:
        row.sort(key=lambda r: (r[0], r[2]))
    kept = [_kept(row, n) for row, n in zip(rows, (np.diff(begins) - 1).tolist())]
    return pa.StructArray.from_arrays([_structs(rows, ("start", "length", "period")), _structs(kept, ("start", "length"))], ["runs", "kept"])


def _structs(rows: list[list[tuple[int, ...]]], names: tuple[str, ...]) -> pa.ListArray:
    flat = np.array([x for row in rows for x in row], np.int64).reshape(-1, len(names))
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in flat.T], list(names)))


def _groups(lists: pa.ListArray) -> Iterator[pa.ListArray]:
    sizes, at, held = np.diff(lists.offsets.to_numpy()), 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > GROUP_WORDS:
            yield lists[at:k]
            at, held = k, 0
        held += n + 1
    yield lists[at:]


def words_of(text: str = "text") -> Column:
    """Array of the words of a text: what stands between white space; empty for a null text."""
    return F.array_remove(F.split(text_or_empty(text), r"[\x20\x09-\x0D]+"), "")


def with_runs(docs: DataFrame, words: str = "words", least: int = 24) -> DataFrame:
    """`docs` and, of the array column `words`, runs (start, length, period) and kept (start, length).

    A run is a stretch of consecutive words with smallest period q and a length of at least `least` and 3 q
    words that no neighbouring word extends keeping the period; runs are ordered by start and period. Word
    numbers begin at 0. `kept` are the spans of words that no run holds after its first q words, in order.
    A null or empty array has none of either, null words equal one another and nothing else, repeated rows
    keep their own; columns `runs` and `kept` are replaced, others stay. Every text is looked at whole, in
    the task of its row, in memory linear in it.
    """
    small_batches(docs.sparkSession)

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.concat_arrays([_of_lists(g, least) for g in _groups(batch)])

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    column = F.arrow_udf(found, FOUND)(F.coalesce(F.col(words), F.array().cast("array<string>")))
    return docs.withColumn("_found", column).withColumns({"runs": F.col("_found.runs"), "kept": F.col("_found.kept")}).drop("_found")


def kept_words(words: str = "words", kept: str = "kept") -> Column:
    """Array of the words in the spans `kept`."""
    return F.flatten(F.transform(kept, lambda s: F.slice(F.col(words), (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def greatest_run(runs: str = "runs") -> Column:
    """The run with the greatest exact length / period (ties: the first in order); null where there is none."""
    def larger(a: Column, b: Column) -> Column:
        return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)

    return F.when(F.size(runs) > 0, F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), larger))

"""Near duplicates by ProbMinHash, banding, verification and components.

Texts are weighted sets of shingles (five words, weighted by how often they come). Every shingle is a Poisson
process with its weight as rate; its arrivals fall on random slots, each slot keeps the first arrival, and a
shingle stops once it is later than all slots. Two texts agree in a slot with the probability Jaccard
similarity of their weights; with all weights 1, with the Jaccard of their sets. A text in which a shingle
repeats has both sketches, for any other they are the same one. Texts that agree in all slots of a band share
a bucket, and candidates agree in enough slots of either sketch.

Neither all pairs of a bucket are written, nor is a bucket cut off. First every text proposes its nearest
partner of each of its buckets, judged by the slots; proposals are verified on the shingles and tie most classes
together. Buckets that still hold several classes are then gone through with the shingles at hand: every
candidate pair of different classes is verified inside the task, classes merge as links are found, and only the
links that merged something are written, fewer than the bucket has texts. Large buckets are compared block by
block in tasks of their own, and a pair is only looked at in the first band that it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small_batches, text_or_empty
from tidemark.llm.lm import mixed, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no bucket with probability (1 - 0.8 ** 5) ** 25 < 5e-5.
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Candidates agree in this share of slots or more: 4.5 standard deviations below 0.8.
LEAST_SHARE = 0.64
BLOCK = 2048
_U = np.uint64
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, weight), sorted by both, each pair once. Fewer than five words are one shingle."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    h = word_hashes([w for ws in words for w in ws])
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.float64)
    starts = np.cumsum(lengths) - lengths
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    inside = np.arange(len(h)) - np.repeat(starts, lengths)
    n = np.repeat(lengths, lengths)
    s = np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        s += np.where(inside + k < n, padded[k : len(h) + k], _U(0)) * _C[k]
    keep = (inside + WORDS <= n) | ((n < WORDS) & (inside == 0))
    doc, s = np.repeat(np.arange(len(texts)), lengths)[keep], mixed(s[keep])
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])]))
    return doc[first], s[first], np.diff(np.append(first, len(s))).astype(np.float64)


def signatures(n: int, doc: np.ndarray, s: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """n x slots of shingle hashes: the first arrival of every slot (0 for texts without shingles)."""
    first, owner = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    x, active, i = np.zeros(len(s)), np.arange(len(s)), 0
    while len(active):
        # Several arrivals at once when few shingles are left; later ones than needed change nothing.
        ahead = int(np.clip(200_000 // len(active), 1, 64)) if i else 1
        r = mixed(s[active, None] + (np.arange(i + 1, i + ahead + 1, dtype=np.uint64) * _C[0])[None])
        gaps = -np.log(((r >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[active, None]
        times = x[active, None] + np.cumsum(gaps, axis=1)
        at = (doc[active, None] * slots + (mixed(r + _C[1]) % _U(slots)).astype(np.int64)).ravel()
        flat = times.ravel()
        useful = flat < first[at]
        at, flat, ids = at[useful], flat[useful], np.repeat(s[active], ahead)[useful]
        np.minimum.at(first, at, flat)
        won = first[at] == flat
        owner[at[won]] = ids[won]
        x[active] = times[:, -1]
        latest = first.reshape(n, slots).max(axis=1)
        active = active[x[active] < latest[doc[active]]]
        i += ahead
    return owner.reshape(n, slots)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    return mixed((parts * _C).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard of the weights, and Jaccard of the sets, of two sorted (hashes, weights)."""
    union = np.union1d(a[0], b[0])
    if not len(union):
        return 1.0, 1.0
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])], y[np.searchsorted(union, b[0])] = a[1], b[1]
    both = (x > 0) & (y > 0)
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ratio, x, y, both = ratio[order], x[order], y[order], both[order]
    # Above a shingle's own ratio the first text has the larger share, below it the second.
    at = np.searchsorted(ratio, ratio[both])
    above = np.append(np.cumsum(x[::-1])[::-1], 0.0)[at]
    below = np.append(0.0, np.cumsum(y))[at]
    return float((1.0 / (above / x[both] + below / y[both])).sum()), float(both.mean())


def _low(sig: np.ndarray) -> np.ndarray:
    return (sig & _U(0xFFFF)).astype("<u2")


def _text_key(text: str):
    return F.unhex(F.md5(text_or_empty(text)))


def _sketches(docs: DataFrame, text: str) -> DataFrame:
    """(h, bands, sig): BANDS keys of the weighted sketch, BANDS of the set sketch (null where they are the same), slots of both."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            doc, s, w = shingles(texts)
            sig = signatures(len(texts), doc, s, w)
            some = np.isin(np.arange(len(texts)), doc)
            repeats = np.unique(doc[w > 1])
            part = np.isin(doc, repeats)
            plain = signatures(len(repeats), np.searchsorted(repeats, doc[part]), s[part], np.ones(int(part.sum())))
            # A text without words has no bands and no partner but its exact copies.
            bands = [b.tolist() if ok else [] for b, ok in zip(band_keys(sig), some)]
            low = [x.tobytes() for x in _low(sig)]
            for k, own, slots in zip(repeats, band_keys(plain), _low(plain)):
                bands[k] += [None if a == b else b for a, b in zip(bands[k], own.tolist())]
                low[k] += slots.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["h", "bands", "sig"])

    return docs.select(_text_key(text).alias("h"), text_or_empty(text).alias("t")).mapInArrow(sketched, "h binary, bands array<long>, sig binary")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """(cell, columns) of rows sorted by their first four columns, key, band, i, j."""
    cell, held = None, []
    for batch in batches:
        for row in zip(*(col.to_pylist() for col in batch.columns)):
            if row[:4] != cell:
                if cell is not None:
                    yield cell, [list(c) for c in zip(*held)]
                cell, held = row[:4], []
            held.append(row[4:])
    if cell is not None:
        yield cell, [list(c) for c in zip(*held)]


def _near(sig: list[bytes], cls: np.ndarray, block: np.ndarray, square: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(row, partners, slots they share, slots of all by sketch) for every row with candidates of other classes.

    The share is the larger of that of the weighted and that of the set sketches; without repeats there is one.
    """
    size = 2 * SLOTS
    rows = [np.frombuffer(b"".join(x[:size] for x in sig), "<u2").reshape(len(sig), SLOTS)]
    if any(len(x) > size for x in sig):
        rows.append(np.frombuffer(b"".join(x[-size:] for x in sig), "<u2").reshape(len(sig), SLOTS))
    least = int(np.ceil(LEAST_SHARE * SLOTS))
    for a in range(0, len(sig), 32):
        part = slice(a, min(a + 32, len(sig)))
        same = (rows[0][part, None, :] == rows[0][None]).sum(axis=2, dtype=np.int16)
        for r in rows[1:]:
            same = np.maximum(same, (r[part, None, :] == r[None]).sum(axis=2, dtype=np.int16))
        same[cls[part, None] == cls[None]] = -1
        if not square:
            same[block[part, None] == block[None]] = -1
        for k in np.flatnonzero((same >= least).any(axis=1)):
            near = np.flatnonzero(same[k] >= least)
            yield a + k, near, same[k][near], rows


def _proposals(cells: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: every text and its nearest candidate in each of its buckets.

    `cells`: key, band, i, j, block, h, sig; a cell is one bucket, or two blocks of a large one.
    """

    def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, i, j), (block, h, sig) in _by_cell(batches):
            out = set()
            for a, near, share, _ in _near(sig, np.arange(len(h)), np.array(block), i == j):
                best = min((h[b] for b in near[share == share.max()]))
                out.add((min(h[a], best), max(h[a], best)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["a", "b"])

    return _dealt(cells, "block", "h", "sig").mapInArrow(proposed, "a binary, b binary").distinct()


def _dealt(cells: DataFrame, *columns: str) -> DataFrame:
    by = ["key", "band", "i", "j"]
    return cells.repartition(*by).sortWithinPartitions(*by).select(*by, *columns)


def _common(sets: list[tuple[np.ndarray, np.ndarray]], a: int, others: np.ndarray) -> np.ndarray:
    """Whether a set may reach the similarity with each of others: by the weight and the number of common shingles."""
    s, w = sets[a]
    lengths = np.array([len(sets[b][0]) for b in others])
    every, weights = np.concatenate([sets[b][0] for b in others]), np.concatenate([sets[b][1] for b in others])
    at = np.minimum(np.searchsorted(s, every), max(len(s) - 1, 0))
    hit = s[at] == every if len(s) else np.zeros(len(every), bool)
    starts = np.cumsum(lengths) - lengths
    add = lambda x: np.add.reduceat(x, starts)
    share = np.minimum(add(w[at] * hit) / w.sum(), add(weights * hit) / add(weights))
    return np.maximum(share, add(hit.astype(np.float64)) / np.maximum(lengths, len(s)))


def _links(cells: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) that merge classes, of buckets with several: `cells` also has c and set."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, band, i, j), (block, h, c, sig, blobs) in _by_cell(batches):
            names = {x: k for k, x in enumerate(sorted(set(c)))}
            if len(names) < 2:
                continue
            root = list(range(len(names)))

            def find(k, root=root):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            own = np.array([names[x] for x in c])
            sets, out = [_unpacked(x) for x in blobs], []
            for a, near, _, rows in _near(sig, own, np.array(block), i == j):
                near = near[near > a]
                # Pairs that agree in an earlier band are looked at there. Any two sketches may have met in a bucket.
                met = [(x[near].reshape(-1, BANDS, ROWS) == y[a].reshape(BANDS, ROWS)).all(axis=2) for x in rows for y in rows]
                near = near[np.logical_or.reduce(met).argmax(axis=1) == band]
                near = np.array([b for b in near if find(own[b]) != find(own[a])], dtype=np.int64)
                if not len(near):
                    continue
                for b in near[_common(sets, a, near) >= least - 1e-9]:
                    if find(own[b]) != find(own[a]) and max(similarity(sets[a], sets[b])) >= least - 1e-12:
                        root[find(own[b])] = find(own[a])
                        out.append((min(h[a], h[b]), max(h[a], h[b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["a", "b"])

    return _dealt(cells, "block", "h", "c", "sig", "set").mapInArrow(linked, "a binary, b binary").distinct()


def _packed(s: np.ndarray, w: np.ndarray) -> bytes:
    """Sorted hashes, and their weights if any is above one."""
    return np.array([len(s)], "<u8").tobytes() + s.astype("<u8").tobytes() + (w.astype("<u4").tobytes() if (w > 1).any() else b"")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    s = np.frombuffer(blob, "<u8", n, 8)
    return s, np.frombuffer(blob, "<u4", n, 8 + 8 * n).astype(np.float64) if len(blob) > 8 + 8 * n else np.ones(n)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ok = pa.array([max(similarity(_unpacked(x), _unpacked(y))) >= least - 1e-12 for x, y in blobs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    left, right = (sets.select(F.col("h").alias(k), F.col("set").alias("set_" + k)) for k in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(checked, "a binary, b binary")


def _sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(h, set): hashes and weights of the wanted texts, each text once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            doc, s, w = shingles(texts)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            blobs = [_packed(s[a:b], w[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["h", "set"])

    texts = docs.select(_text_key(text).alias("h"), text_or_empty(text).alias("t"))
    texts = texts.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("t").alias("t"))
    return texts.mapInArrow(made, "h binary, set binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of edges (a, b), by hooking and pointer jumps."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hooked = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "r").alias("mid"))
        above = roots.select(F.col("node").alias("mid"), F.col("root").alias("jump"))
        moved = checkpointed(hooked.join(above, "mid").select("node", "old", F.least("mid", "jump").alias("root")))
        done = not moved.filter(F.col("old") != F.col("root")).take(1)
        roots = moved.select("node", "root")
        if done:
            return roots


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Rows of buckets as rows of cells: one per bucket, or one per pair of blocks of a large bucket."""
    parts = F.ceil(F.col("n") / block).cast("int")
    cells = rows.withColumn("block", F.pmod(F.xxhash64("h"), parts).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cells.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})


def _text_classes(docs: DataFrame, text: str, least: float, block: int) -> DataFrame:
    """(h, c) of the distinct texts that have a near duplicate."""
    sketches = checkpointed(_sketches(docs, text).dropDuplicates(["h"]))
    rows = sketches.select("h", F.posexplode("bands").alias("band", "key")).filter("key is not null")
    rows = rows.withColumn("band", F.col("band") % BANDS)
    shared = rows.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = checkpointed(rows.join(shared, ["key", "band"]))
    wanted = checkpointed(members.select("h").distinct())
    sets = checkpointed(_sets(docs, text, wanted))
    slots = checkpointed(sketches.select("h", "sig").join(wanted, "h", "left_semi"))
    first = checkpointed(_verified(_proposals(_cells(members.join(slots, "h"), block)), sets, least))
    classes = components(first).select(F.col("node").alias("h"), F.col("root").alias("c"))
    open_ = members.join(classes, "h", "left").withColumn("c", F.coalesce("c", "h"))
    several = open_.groupBy("key", "band").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).filter("_low != _high")
    open_ = open_.join(several.select("key", "band"), ["key", "band"], "left_semi")
    second = checkpointed(_links(_cells(open_.join(slots, "h").join(sets, "h"), block), least))
    return components(first.union(second)).select(F.col("node").alias("h"), F.col("root").alias("c"))


def text_hash(text: str = "text"):
    return F.hex(_text_key(text))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The document with the smallest key of every class (a null key comes last), all its columns unchanged.

    Rows are told apart by key and text: of rows equal in both one stays.
    """
    rows = near_duplicates(docs, key, text, least)
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "text_hash")).alias("_kept")
    kept = rows.groupBy("class_hash").agg(first).select(
        F.col("_kept.none").alias("_none"), F.coalesce("_kept.key", F.lit(0)).alias("_key"), F.col("_kept.text_hash").alias("_hash")
    )
    named = docs.withColumns({"_none": F.col(key).isNull(), "_key": F.coalesce(key, F.lit(0)), "_hash": text_hash(text)})
    # Key and text together: copies of one text under many keys are spread over all tasks.
    by = ["_none", "_key", "_hash"]
    return named.join(kept, by).dropDuplicates(by).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per document: `key`, text_hash, class_id (smallest key of the class), class_hash, class_size (documents).

    text_hash is the md5 of the text; class_hash, that of one of its texts, names a class even if all its keys are null.

    Two texts are linked if the probability Jaccard of their five-word shingles, weighted by count, or the
    Jaccard of their sets is `least` or more; classes are the components. A null text counts as empty; texts
    without words are in one class per text, as exact copies are. Texts of fewer than five words have one
    shingle. Repeated rows and equal keys stay rows of their own; a null key is never the smallest of a class
    unless it is alone.
    """
    small_batches(docs.sparkSession)
    classes = _text_classes(docs, text, least, block)
    rows = docs.select(F.col(key).alias("_key"), _text_key(text).alias("h")).join(classes, "h", "left")
    rows = checkpointed(rows.select("_key", "h", F.coalesce("c", "h").alias("c")))
    named = rows.groupBy("c").agg(F.min("_key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(named, "c").select(F.col("_key").alias(key), F.hex("h").alias("text_hash"), "class_id", F.hex("c").alias("class_hash"), "class_size")

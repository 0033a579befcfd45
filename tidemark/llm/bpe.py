"""BPE encoding and decoding by tree concatenation.

Texts up to `LEAF` characters are encoded where they stand. A longer one is cut into leaves at fixed character
positions, and leaves are encoded in parallel, as rows of their own. White space closes what it ends, so only the
unfinished chunks at a leaf's edges go on: those that meet (the end of a leaf, leaves without white space, the
beginning of the next) are a seam, and the open chunks of a seam are joined pairwise up a tree, every round a
shuffle by (text, seam, pair). What lies inside a leaf is not moved until the ids of a text are put together.

Two chunks are joined by encoding a growing window around the join anew until it agrees with both sides: it
shares a token (same id, same characters) with the left side and one with the right side, each `MARGIN`
characters or more away from the window's edges and the join.

Why that is exact: a token sequence is the encoding of its text if every adjacent pair of tokens is, and
every pair of the result stands in the left encoding, in the window's or in the right one; where words
and special strings begin is decided by fewer than `MARGIN` characters around.

Of files that keep white space, byte-level ones with the usual pattern have nothing that is decided from afar
either: their long texts are one seam. Any other such file encodes a long text whole, in one task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small_batches, text_or_empty, worker_cache

LEAF = 32_768
MARGIN, WINDOW = 32, 128
CHUNK, BLANK = r"[^ \t\n\r]+", re.compile(r"[ \t\n\r]")
#: Characters of the leaves of one Arrow batch.
BATCH_CHARS = 4_000_000
LEAVES = "_text_hash string, seam int, place int, closed boolean, part string"
OPENS = "_text_hash string, seam int, place int, part string, ids array<int>, starts array<int>, ends array<int>"
REMEMBERED, REMEMBERED_CHARS = 600_000, 64


def closes_at_space(model: dict) -> bool:
    """Whether white space is dropped, so that chunks between blanks are encoded on their own."""
    norm = json.dumps(model.get("normalizer") or {})
    pre = model.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [{}])[0]
    dropped = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" not in re.sub(r"\[\^[^\]]*\]", "", json.dumps(first.get("pattern")).replace("\\\\", "\\"))
    plain = not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in model.get("added_tokens", []))
    return bool(dropped and plain and "Prepend" not in norm)


def joins_locally(model: dict) -> bool:
    """Whether a file that keeps white space cuts words by the plain byte-level pattern, and nothing else."""
    pre, bpe = model.get("pre_tokenizer") or {}, model.get("model") or {}
    plain = not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in model.get("added_tokens", []))
    whole = bpe.get("ignore_merges") or bpe.get("dropout") or bpe.get("type", "BPE") != "BPE"
    return bool(pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer") and plain and not whole)


@dataclass
class Open:
    """A chunk that may go on beyond its edge: characters, token ids, and the characters of each token."""

    text: str
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _encode_open(tok, text: str, shift: int = 0) -> Open:
    e = tok.encode(text, add_special_tokens=False) if text else None
    at = np.array(e.offsets if e else [], dtype=np.int64).reshape(-1, 2) + shift
    return Open(text, np.array(e.ids if e else [], dtype=np.int32), at[:, 0], at[:, 1])


def _own(o: Open) -> np.ndarray:
    """Tokens that share no character with a neighbour (bytes of one character may be several tokens)."""
    free = np.ones(len(o.ids), dtype=bool)
    if len(o.ids) > 1:
        apart = o.start[1:] >= o.end[:-1]
        free[1:] &= apart
        free[:-1] &= apart
    return free


def _shared(w: Open, side: Open, low: int, high: int) -> tuple[int, int] | None:
    """Positions in `w` and `side` of a token that both have between the characters low and high."""
    a, b = np.searchsorted(side.start, [low, high])
    near = slice(max(0, a - 1), b + 1)
    there = Open("", side.ids[near], side.start[near], side.end[near])
    index = {(s, e, i): k for k, (s, e, i, f) in enumerate(zip(there.start, there.end, there.ids, _own(there))) if f and s >= low and e <= high}
    free = _own(w)
    for k in range(len(w.ids)):
        if free[k] and (q := index.get((w.start[k], w.end[k], w.ids[k]))) is not None:
            return k, near.start + q
    return None


def join_open(tok, u: Open, v: Open) -> Open:
    """The encoding of u.text + v.text, from both encodings and a window around their join."""
    if not u.text or not v.text:
        return v if not u.text else u
    at, text = len(u.text), u.text + v.text
    size = WINDOW
    right = Open(v.text, v.ids, v.start + at, v.end + at)
    while True:
        a, b = max(0, at - size), min(len(text), at + size)
        w = _encode_open(tok, text[a:b], a)
        left_at = (0, 0) if a == 0 else _shared(w, u, a + MARGIN, at - MARGIN)
        right_at = (len(w.ids), len(v.ids)) if b == len(text) else _shared(w, right, at + MARGIN, b - MARGIN)
        if left_at and right_at:
            # Before the shared token from the left, between both from the window, then from the right.
            parts = [(u, slice(0, left_at[1])), (w, slice(left_at[0], right_at[0])), (right, slice(right_at[1], None))]
            return Open(text, *(np.concatenate([getattr(o, f)[s] for o, s in parts]) for f in ("ids", "start", "end")))
        size *= 2


def cut_leaves(text: str, size: int, closing: bool) -> Iterator[tuple[int, int, bool, str]]:
    """(seam, place in the seam, closed, text) of the leaves of a text; a closed leaf ends one seam and begins the next."""
    seam, place = 0, 0
    for at in range(0, len(text), size):
        part = text[at : at + size]
        closed = closing and BLANK.search(part) is not None
        yield seam, place, closed, part
        seam, place = (seam + 1, 1) if closed else (seam, place + 1)


def closed_leaf(tok, text: str, chunk_ids) -> tuple[Open, bytes, Open]:
    """The open chunks at both edges of a leaf with white space, and the ids between, of `chunk_ids(chunks)`."""
    first, last = BLANK.search(text).start(), max(map(text.rfind, " \t\n\r"))
    inner = re.findall(CHUNK, text[first : last + 1])
    return _encode_open(tok, text[:first]), chunk_ids(inner), _encode_open(tok, text[last + 1 :])


class Encoder:
    """The tokenizer of one worker and the ids of the chunks that it has met."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_str(model)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.known: dict[str, bytes] = {}
        n = self.tok.get_vocab_size(with_added_tokens=True)
        self.closing = closes_at_space(json.loads(model))
        self.strings = np.array([self.tok.id_to_token(i) for i in range(n)], dtype=object)
        self.joins_by_blank = json.loads(model).get("decoder") is None

    def chunk_ids(self, chunks: list[str]) -> bytes:
        known = self.known
        new = set(chunks).difference(known)
        self.learn(new)
        out = b"".join(map(known.__getitem__, chunks))
        self.forget(new)
        return out

    def learn(self, new: set[str]) -> None:
        # One text of many chunks costs far less than many texts; blanks keep the chunks apart.
        for part in np.array_split(np.array(list(new), dtype=object), 1 + sum(map(len, new)) // 65_536):
            if not len(part):
                continue
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids, at = np.array(e.ids, np.int32), np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            begins = np.cumsum([0, *(len(c) + 1 for c in part[:-1])])
            cuts = np.searchsorted(at, [*begins, begins[-1] + len(part[-1])])
            self.known.update((c, ids[a:b].tobytes()) for c, a, b in zip(part, cuts[:-1], cuts[1:]))

    def forget(self, new: set[str]) -> None:
        for c in new:
            if len(c) > REMEMBERED_CHARS:
                del self.known[c]
        if len(self.known) > REMEMBERED:
            self.known.clear()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.closing:
            return [np.array(e.ids, np.int32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        chunks = [re.findall(CHUNK, t) for t in texts]
        new = set().union(*chunks).difference(self.known)
        self.learn(new)
        out = [b"".join(map(self.known.__getitem__, c)) for c in chunks]
        self.forget(new)
        return out

    def decode(self, ids: np.ndarray) -> str:
        if self.joins_by_blank:
            return " ".join(self.strings[ids].tolist())
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


def worker_encoder(key: str, shared) -> Encoder:
    cache = worker_cache()
    return cache.get(("bpe", key)) or cache.setdefault(("bpe", key), Encoder(shared.value))


def _list_array(parts: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _shared_model(docs: DataFrame, model_path: str):
    """The vocabulary file (some MB, read once on the driver) as a broadcast string."""
    small_batches(docs.sparkSession)
    with open(model_path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _leaves(texts: DataFrame, size: int, closing: bool) -> DataFrame:
    """Rows of leaves of (_text_hash, _t), dealt over all tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, chars = [], 0
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in cut_leaves(text.as_py(), size, closing):
                    held.append((h, *row))
                    chars += len(row[3])
                    if chars > BATCH_CHARS:
                        yield _batch(held)
                        held, chars = [], 0
            if held:
                yield _batch(held)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["_text_hash", "seam", "place", "closed", "part"])

    # With a number, since small partitions would be put together again: leaves are little data but much work.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.mapInArrow(cut, LEAVES).repartition(tasks, "_text_hash", "seam", "place")


def _open_row(h: str, seam: int, place: int, o: Open) -> tuple:
    return h, seam, place, o.text, o.ids, o.start.astype(np.int32), o.end.astype(np.int32)


def _joined_seams(opens: DataFrame, key: str, shared) -> DataFrame:
    """(_text_hash, seam, ids): the open chunks of every seam joined, two at a time."""

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place")
        parts = [Open(t, *(np.asarray(a, d) for a, d in zip(x, (np.int32, np.int64, np.int64)))) for t, *x in zip(rows["part"], rows["ids"], rows["starts"], rows["ends"])]
        whole = parts[0] if len(parts) == 1 else join_open(worker_encoder(key, shared).tok, *parts)
        h, seam, place = rows.iloc[0][["_text_hash", "seam", "place"]]
        return pd.DataFrame([_open_row(h, seam, place // 2, whole)], columns=list(pdf.columns))

    most = opens.agg(F.max("place")).first()[0] or 0
    while most:
        opens = opens.groupBy("_text_hash", "seam", F.expr("place div 2")).applyInPandas(pair, OPENS)
        most //= 2
    return opens.select("_text_hash", "seam", "ids")


def _long_ids(texts: DataFrame, key: str, shared, leaf_chars: int) -> DataFrame:
    """(_text_hash, _ids) of distinct long texts (_text_hash, _t)."""
    model = json.loads(shared.value)
    closing = closes_at_space(model)
    size = leaf_chars if closing or joins_locally(model) else 2**31 - 1

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(key, shared)
        for batch in batches:
            for h, seam, place, closed, part in zip(*(c.to_pylist() for c in batch.columns)):
                if closed:
                    left, middle, right = closed_leaf(enc.tok, part, enc.chunk_ids)
                    inner = Open("", np.frombuffer(middle, np.int32), *[np.empty(0, np.int64)] * 2)
                    rows = [_open_row(h, seam, place, left), _open_row(h, seam, -1, inner), _open_row(h, seam + 1, 0, right)]
                else:
                    rows = [_open_row(h, seam, place, _encode_open(enc.tok, part))]
                types = [pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3]
                names = ["_text_hash", "seam", "place", "part", "ids", "starts", "ends"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    # Written once: the number of rounds is read from it, and no leaf is encoded again for it.
    made = checkpointed(_leaves(texts, size, closing).mapInArrow(encoded, OPENS))
    seams = _joined_seams(made.filter("place >= 0"), key, shared).select("_text_hash", F.expr("2 * seam").alias("at"), "ids")
    inner = made.filter("place < 0").select("_text_hash", F.expr("2 * seam + 1").alias("at"), "ids")
    parts = F.sort_array(F.collect_list(F.struct("at", "ids")))
    return seams.unionByName(inner).groupBy("_text_hash").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("_ids"))


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids", leaf_chars: int = LEAF) -> DataFrame:
    """`docs` and `out` array<int>: the ids of the whole text, special tokens not added.

    A null text counts as empty and gives an empty array. Texts of more than `leaf_chars` characters
    are encoded once per distinct text, leaf by leaf as rows; of `docs` only their other columns and a
    hash take part in that join. A column named `out` is replaced, all others stay.
    """
    shared, key = _shared_model(docs, model_path), model_path

    def short_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = worker_encoder(key, shared)
        for batch in batches:
            yield _list_array(enc.encode_all(batch.to_pylist()))

    short_ids.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    docs = docs.drop(out)
    t = text_or_empty(text)
    is_long = F.length(t) > leaf_chars
    short = docs.filter(~is_long).withColumn(out, F.arrow_udf(short_ids, "array<int>")(t))
    hashed = F.sha2(F.col(text), 256)
    long = docs.filter(is_long)
    texts = long.select(hashed.alias("_text_hash"), F.col(text).alias("_t")).groupBy("_text_hash").agg(F.first("_t").alias("_t"))
    whole = _long_ids(texts, key, shared, leaf_chars)
    rest = long.withColumn("_text_hash", hashed).join(whole, "_text_hash").withColumn(out, F.col("_ids")).drop("_text_hash", "_ids")
    return short.unionByName(rest)


def decode(docs: DataFrame, model_path: str, ids: str = "ids") -> Column:
    """Column of the text of token ids as the library decodes them, special tokens kept; null counts as empty."""
    shared, key = _shared_model(docs, model_path), model_path

    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = worker_encoder(key, shared)
        for batch in batches:
            flat, ends = batch.flatten().to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            base = ends[0]
            yield pa.array([enc.decode(flat[a - base : b - base]) for a, b in zip(ends[:-1], ends[1:])], pa.string())

    text_of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(text_of, "string")(F.coalesce(F.col(ids), F.array().cast("array<int>")))

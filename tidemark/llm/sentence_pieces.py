"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

The ids of a merge-type (BPE) model are the only way of writing a text as pieces in which every two
neighbours are compatible: merging their joined characters anew, best score first, gives the same two
pieces back. So nothing has to be merged over a whole text. An Aho-Corasick automaton gives the longest
piece at every position; from the left the longest piece is taken that is compatible with the one before;
a piece that isn't gives way to its longest proper prefix in the vocabulary; where none is left the
position is marked in a bitfield of failed positions and the last piece is taken back.

Pieces with equal scores merge from left to right, which compatibility of neighbours can't tell; stretches
that hold two characters of such pieces in a row (runs of blanks) are merged directly.

Texts are cut before blanks and between characters that no piece holds side by side, not even by way of
others; no merge goes over such a border. Equal stretches are encoded once per worker and remembered up to
a bound.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, text_or_empty, worker_cache

BLANK = "▁"
NEVER = float("inf")
#: Up to so many characters merging looks through all neighbours, beyond that it keeps a queue.
SHORT = 40
#: Bounds of what a worker remembers: words and stretches (of so many characters at most), pairs of pieces.
WORDS, REMEMBERED, REMEMBERED_CHARS, PAIRS = 400_000, 600_000, 40, 500_000


class Vocabulary:
    """Pieces of a merge-type model with byte fallback, read from the bytes of its file; ▁ stands as a blank."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        p = SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model).normalizer_spec
        self.opens_with_blank = spec.add_dummy_prefix
        unchanged = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self.normalize = self._marked if unchanged else lambda text: p.normalize(text).replace(BLANK, " ")
        every = range(p.get_piece_size())
        kinds = {"bytes": p.is_byte, "control": p.is_control, "unknown": p.is_unknown}
        self.special = {name: {i for i in every if test(i)} for name, test in kinds.items()}
        odd = set().union(*self.special.values())
        self.names = [p.id_to_piece(i).replace(BLANK, " ") for i in every]
        self.ids = {self.names[i]: i for i in every if i not in odd}
        self.ranks = {self.names[i]: -p.get_score(i) for i in every if i not in odd}
        if len(self.special["bytes"]) != 256 or any(p.is_unused(i) for i in every):
            raise ValueError("needs a merge-type model with byte fallback and without unused pieces")
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in self.special["bytes"]}
        ties = Counter(r for name, r in self.ranks.items() if len(name) > 1)
        tied = {c for name, r in self.ranks.items() if len(name) > 1 and ties[r] > 1 for c in name}
        if len(tied) > 1:
            raise ValueError("pieces of several characters share a score")
        self.tied = "".join(tied) * 2
        words, stretches = _borders(self.ids)
        self.words, self.stretches = re.compile(words, re.DOTALL).findall, re.compile(stretches, re.DOTALL).findall

    def _marked(self, text: str) -> str:
        return (" " * self.opens_with_blank + text.replace(BLANK, " ")) if text else ""


def _borders(pieces: Iterable[str]) -> tuple[str, str]:
    """Patterns of words (blanks, then others) and, inside them, of stretches that no piece goes beyond.

    A stretch holds characters that pieces can chain together: they stand side by side in some piece.
    """
    if any(" " in name.lstrip(" ") for name in pieces):
        return ".+", ".+"
    root: dict[str, str] = {}

    def top(c: str) -> str:
        while (up := root.setdefault(c, c)) != c:
            root[c] = c = root[up]
        return c

    for name in pieces:
        for a, b in pairwise(name.lstrip(" ")):
            root[top(a)] = top(b)
    groups = defaultdict(list)
    for c in root:
        groups[top(c)].append(c)
    classes = [f"[{re.escape(''.join(sorted(g)))}]+" for g in sorted(groups.values(), key=len, reverse=True)]
    return " *[^ ]+| +", f" *(?:{'|'.join([*classes, '[^ ]'])})| +"


def merged(text: str, ranks: dict[str, float]) -> list[str]:
    """The pieces that merging gives: the neighbours whose joint piece ranks first, ties from the left."""
    if len(text) > SHORT:
        return _merged_by_queue(text, ranks)
    part, rank = list(text), ranks.get
    joints = [rank(text[i : i + 2], NEVER) for i in range(len(part) - 1)]
    while joints and (best := min(joints)) < NEVER:
        i = joints.index(best)
        part[i : i + 2] = [part[i] + part[i + 1]]
        del joints[i]
        if i:
            joints[i - 1] = rank(part[i - 1] + part[i], NEVER)
        if i < len(joints):
            joints[i] = rank(part[i] + part[i + 1], NEVER)
    return part


def _merged_by_queue(text: str, ranks: dict[str, float]) -> list[str]:
    part: list[str | None] = list(text)
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    queue = [(ranks[ab], i, ab) for i in range(len(part) - 1) if (ab := text[i : i + 2]) in ranks]
    heapq.heapify(queue)
    while queue:
        _, i, ab = heapq.heappop(queue)
        j = after[i]
        if part[i] is None or j >= len(part) or part[i] + part[j] != ab:
            continue
        part[i], part[j] = ab, None
        after[i] = k = after[j]
        if k < len(part):
            before[k] = i
            if (joint := ab + part[k]) in ranks:
                heapq.heappush(queue, (ranks[joint], i, joint))
        if (h := before[i]) >= 0 and (joint := part[h] + ab) in ranks:
            heapq.heappush(queue, (ranks[joint], h, joint))
    return [x for x in part if x is not None]


def reachable(vocabulary: Vocabulary) -> list[str]:
    """The pieces that encoding can give at all: those which their own characters merge to."""
    return [name for name in vocabulary.ids if len(name) == 1 or merged(name, vocabulary.ranks) == [name]]


class Encoder:
    """Ids of texts; `pieces` are the reachable pieces of the vocabulary."""

    def __init__(self, vocabulary: Vocabulary, pieces: list[str]):
        import ahocorasick

        self.v, known = vocabulary, set(pieces)
        self.automaton = ahocorasick.Automaton()
        for name in pieces:
            if len(name) > 1:
                self.automaton.add_word(name, (len(name) - 1, name))
        self.automaton.make_automaton()
        self.shorter = {name: next((name[:n] for n in range(len(name) - 1, 0, -1) if name[:n] in known), None) for name in pieces}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.stretches: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: str, b: str) -> bool:
        fits = self.pairs.get((a, b))
        if fits is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            fits = self.pairs[a, b] = len(m := merged(a + b, self.v.ranks)) == 2 and m[0] == a
        return fits

    def backtracked(self, text: str) -> list[str]:
        """The pieces of `text`; a character outside the vocabulary is a piece of its own."""
        longest = list(text)
        for end, (back, name) in self.automaton.iter(text):
            longest[end - back] = name  # a later end is a longer piece
        failed, n, at = bytearray((len(text) >> 3) + 1), len(text), 0
        taken: list[str] = []
        piece: str | None = longest[0]
        pairs, shorter = self.pairs, self.shorter
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = not taken or pairs.get((taken[-1], piece))
                if fits is None:
                    fits = self.compatible(taken[-1], piece)
                if fits:
                    taken.append(piece)
                    if end == n:
                        return taken
                    at, piece = end, longest[end]
                    continue
            piece = shorter.get(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)

    def stretch_ids(self, text: str) -> tuple[int, ...]:
        ids = self.v.ids
        if text in self.shorter:
            return (ids[text],)
        pieces = merged(text, self.v.ranks) if self.v.tied and self.v.tied in text else self.backtracked(text)
        try:
            return tuple([ids[x] for x in pieces])
        except KeyError:
            return tuple(chain.from_iterable((ids[x],) if x in ids else [self.v.byte_ids[b] for b in x.encode()] for x in pieces))

    def word_ids(self, word: str) -> tuple[int, ...]:
        known, out = self.stretches, []
        for s in self.v.stretches(word):
            if (ids := known.get(s)) is None:
                ids = self.stretch_ids(s)
                if len(s) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[s] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        known, words = self.words, self.v.words(self.v.normalize(text))
        if len(known) >= WORDS:
            known.clear()
        new = set(words).difference(known)
        for w in new:
            known[w] = self.word_ids(w)
        ids = np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int32)
        for w in new:
            if len(w) > REMEMBERED_CHARS:  # hardly comes again and would fill the memory
                del known[w]
        return ids


def replaced(run: bytes) -> str:
    """The characters of a run of byte pieces; every byte that belongs to none becomes U+FFFD."""
    out, at = [], 0
    while at < len(run):
        size = next((n for n in (1, 2, 3, 4) if _is_character(run[at : at + n])), 0)
        out.append(run[at : at + size].decode() if size else "�")
        at += size or 1
    return "".join(out)


def _is_character(some: bytes) -> bool:
    try:
        return len(some.decode()) == 1
    except UnicodeDecodeError:
        return False


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        v, self.unknown = vocabulary, " ⁇ "
        self.bytes, self.control, self.opens_with_blank = v.special["bytes"], v.special["control"], v.opens_with_blank
        self.table = list(v.names)
        for i in v.special["control"]:
            self.table[i] = ""
        for i in v.special["unknown"]:
            self.table[i] = self.unknown
        self.blank = [name.startswith(" ") for name in v.names]
        self.raw = [s.encode() for s in self.table]
        for b, i in v.byte_ids.items():
            self.raw[i] = bytes([b])

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.tolist()
        first = next((i for i in ids if i not in self.control), None)
        opens = first is not None and self.opens_with_blank and self.blank[first]
        try:
            text = self._by_runs(ids) if self.control.intersection(ids) else b"".join(map(self.raw.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = self._by_runs(ids)
        return text[1:] if opens else text

    def _by_runs(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run += self.raw[i]
                continue
            out += [replaced(bytes(run)), self.table[i]]
            run.clear()
        return "".join([*out, replaced(bytes(run))])


def _shared(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        model = f.read()
    v = Vocabulary(model)
    return docs.sparkSession.sparkContext.broadcast((model, reachable(v)))


def _worker(shared, path: str) -> tuple[Encoder, Decoder]:
    cache, key = worker_cache(), ("pieces", path)
    if key not in cache:
        model, pieces = shared.value
        v = Vocabulary(model)
        cache[key] = (Encoder(v, pieces), Decoder(v))
    return cache[key]


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """`docs` and ids (array of int): the pieces of `text` as the sentencepiece library numbers them.

    No begin or end ids, no sampling. A null text counts as empty and an empty text has no ids; repeated
    rows keep their own; a column `ids` is replaced, others stay. Whole texts are encoded in the task of
    their row, in memory linear in the text. The model file (`model_path`, on the driver; merge type with
    byte fallback, ValueError otherwise) and its pieces are broadcast; they are as large as the file.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs, model_path)

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _worker(shared, model_path)[0]
        for batch in batches:
            rows = [encoder.encode(t) for t in batch.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
            yield pa.ListArray.from_arrays(offsets, np.concatenate(rows) if rows else np.empty(0, np.int32))

    encoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("ids", F.arrow_udf(encoded, "array<int>")(text_or_empty(text)))


def decode(docs: DataFrame, model_path: str, ids: str = "ids") -> Column:
    """Text column of the pieces in `ids` as the sentencepiece library decodes them (null: empty).

    The blank that encoding puts before a text goes again, bytes that form no character become U+FFFD.
    """
    shared = _shared(docs, model_path)

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _worker(shared, model_path)[1]
        for batch in batches:
            flat, offsets = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            yield pa.array([decoder.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])], pa.string())

    decoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decoded, "string")(F.coalesce(F.col(ids), F.array().cast("array<int>")))

"""Token counts: lengths only, from Arrow batches, long texts cut at safe boundaries.

A byte-level BPE file splits text before its merges so that a run of white space starts a new
piece: no piece goes over a border from a character that isn't white space to one of blank, tab,
line feed or carriage return. So a text may be cut at every such border, and the token count of the
text is the sum over its cuts. Equal cuts are encoded once per worker. Other white space (no-break
space and the like) next to a border could move it; texts with such characters are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, text_or_empty, worker_cache

#: White space other than blank, tab, line feed, carriage return, in any of the usual definitions.
RARE_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]"
CUTS = r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+"
#: Bytes of text counted together, and cuts remembered by a worker before it starts anew.
BATCH_BYTES, REMEMBERED = 4 << 20, 400_000


def _json_lengths(model: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_str(model)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def _piece_lengths(model: bytes):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_proto=model)
    return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]


def _may_be_cut(model: dict) -> bool:
    """Byte-level BPE with the usual pattern, nothing before it and no mark of word ends."""
    pre, bpe = model.get("pre_tokenizer") or {}, model["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    alone = not any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in model.get("added_tokens", []))
    return bool(plain and alone and model.get("normalizer") is None and bpe.get("type") == "BPE" and not bpe.get("end_of_word_suffix"))


def _by_bytes(texts: list[str], most: int) -> Iterator[list[str]]:
    """Consecutive texts in groups of about `most` characters; a longer text is a group of its own."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _counts(texts: list[str], lengths, known: dict[str, int], cut, rare) -> list[int]:
    out: list[int] = []
    for group in _by_bytes(texts, BATCH_BYTES):
        cuts = [[t] if rare is None or rare(t) else cut(t) for t in group]
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set().union(*cuts).difference(known))
        for part in _by_bytes(new, BATCH_BYTES // 4):
            known.update(zip(part, lengths(part)))
        out += [sum(map(known.__getitem__, c)) for c in cuts]
        # A long cut is not worth remembering: it hardly comes again and would fill the memory.
        for k in new:
            if len(k) > 64:
                del known[k]
    return out


def token_count(docs: DataFrame, model_path: str, text: str = "text") -> Column:
    """Column of the number of tokens of `text` as the library for the vocabulary file gives it.

    `model_path` names a tokenizers .json or a sentencepiece .model file on the driver; its bytes
    (some MB, the size of the file) are broadcast. No special tokens are added, nothing is cut off;
    a null text counts as empty and an empty text has no tokens. Cutting is only used for byte-level
    files; others are encoded whole, grouped by bytes.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    kind = "json" if model_path.endswith(".json") else "piece"
    safe = kind == "json" and _may_be_cut(json.loads(model))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = worker_cache()
        key = ("lengths", model_path)
        if key not in cache:
            cache[key] = (_json_lengths(shared.value.decode()) if kind == "json" else _piece_lengths(shared.value), {})
        lengths, known = cache[key]
        cut, rare = re.compile(CUTS).findall, (re.compile(RARE_SPACE).search if safe else None)
        for batch in batches:
            yield pa.array(_counts(batch.to_pylist(), lengths, known, cut, rare), pa.int64())

    counted.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(counted, "long")(text_or_empty(text))


def with_token_counts(docs: DataFrame, model_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """`docs` and n_bytes (UTF-8), n_tokens, over_limit; columns of these names are replaced, others stay."""
    counted = docs.withColumn("n_tokens", token_count(docs, model_path, text))
    return counted.withColumns({"n_bytes": F.octet_length(text_or_empty(text)).cast("long"), "over_limit": F.col("n_tokens") > limit})

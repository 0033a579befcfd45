"""Secret scans: keyword automaton first, anchored patterns at its hits, checksums last.

Everything runs on the UTF-8 bytes of a text, lower-cased in ASCII only for the automaton, so offsets
hold; they are turned into code points at the end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, text_or_empty, worker_cache

#: The base kinds, in their order of listing, then the kinds with a checksum inside.
KINDS = ("assign", "access", "hex", "checked")
ASSIGN = rb"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{24,}"
CHECKED = rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})"
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked",
}
MIN_VALUE, MIN_ACCESS = 6, 20
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _checksum_holds(body: bytes, check: bytes) -> bool:
    n = zlib.crc32(body)
    digits = bytearray()
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(BASE62[d])
    return bytes(reversed(digits)) == check


def _scanner():
    import ahocorasick

    words = ahocorasick.Automaton()
    for w, kind in KEYWORDS.items():
        words.add_word(w, (len(w), kind))
    words.make_automaton()
    anchored = {"assign": re.compile(ASSIGN).match, "access": re.compile(ACCESS).match, "checked": re.compile(CHECKED).match}
    holds = {
        "assign": lambda m: len(m[1]) >= MIN_VALUE,
        "access": lambda m: len(m[0]) >= MIN_ACCESS,
        "checked": lambda m: _checksum_holds(m[1], m[2]),
    }
    long_hex = re.compile(HEX).finditer

    def scan(text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points by start, then kind in listed order."""
        raw = text.encode("utf-8", "surrogatepass")
        spans = [(m.start(), m.end(), "hex") for m in long_hex(raw)]
        over = dict.fromkeys(anchored, 0)
        hits = [(end - n + 1, kind) for end, (n, kind) in words.iter(raw.lower().decode("latin-1"))]
        # A hit inside an earlier match of its kind, or where the pattern fails, starts nothing: the same
        # leftmost matches without overlap as a scan of the whole text, at the cost of the hits alone.
        for at, kind in sorted(hits):
            if at >= over[kind] and (m := anchored[kind](raw, at)):
                if kind != "checked" or holds[kind](m):
                    over[kind] = m.end()
                if holds[kind](m):
                    spans.append((at, m.end(), kind))
        if len(raw) != len(text) and spans:
            points, seen, byte = {}, 0, 0
            for p in sorted({p for s in spans for p in s[:2]}):
                seen += len(raw[byte:p].decode("utf-8", "surrogatepass"))
                byte, points[p] = p, seen
            spans = [(points[a], points[b], k) for a, b, k in spans]
        return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))

    return scan


def secret_spans(docs: DataFrame, text: str = "text") -> Column:
    """Column array<struct<start, end, kind>> of the secrets in `text`, in code points, end exclusive.

    Kinds: assign (a credential word, a separator, a value of 6 and more), access (an access key id of
    20 and more), hex (a run of 24 and more), checked (a platform token whose last six characters are
    the base-62 CRC-32 of its body). Null and empty texts have no spans; very long texts are scanned
    whole, at bounded memory per batch.
    """
    small_batches(docs.sparkSession)

    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = worker_cache()
        scan = cache.get("secrets") or cache.setdefault("secrets", _scanner())
        for batch in batches:
            yield batch.map(lambda t: [{"start": a, "end": b, "kind": k} for a, b, k in scan(t)])

    spans.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(spans, "array<struct<start:long,end:long,kind:string>>")(text_or_empty(text))


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """`text` with every span replaced by `mask`; spans that overlap are masked once."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done, s):
        piece = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(s["start"] >= done["at"], F.concat(done["parts"], F.array(piece, F.lit(mask)))).otherwise(done["parts"]).alias("parts"),
        )

    def finish(done):
        return F.concat(F.array_join(done["parts"], ""), F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, finish)).otherwise(text)

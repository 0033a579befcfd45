import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tests.llm import edge_rows
from tidemark.llm import queries, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24):
    """(start, length, smallest period) of every run, period by period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def samples(rnd):
    for _ in range(600):
        n = rnd.choice([3, 30, 90, 200])
        yield [rnd.randrange(rnd.choice([1, 2, 3])) for _ in range(n)]
        block = [rnd.randrange(2) for _ in range(rnd.randrange(1, 20))]
        yield (block * rnd.randrange(1, 6) + [rnd.randrange(3)] * rnd.randrange(9)) * rnd.randrange(1, 4)
        yield ([0] * rnd.randrange(1, 30) + [1]) * rnd.randrange(2, 6)
        inner = [0, 1] * rnd.randrange(1, 9) + [0] * rnd.randrange(3)
        yield (inner * rnd.randrange(1, 4) + [2]) * rnd.randrange(1, 6)
    yield [ord(c) for c in fibonacci(400)]


def test_all_runs_of_hard_arrays():
    count = 0
    for words in samples(random.Random(2)):
        got = sorted((s, e - s, q) for s, e, q in runs.find_runs(np.array(words, np.int64)))
        want = brute(words, 0)
        assert got == want
        count += len(want)
    assert count > 10_000


def collapsed(words, found):
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in dropped]


def test_operator_on_edge_rows(spark):
    rnd = random.Random(4)
    texts = ["la " * 40, "a b c d e f g h " * 3, " ".join(fibonacci(300)), "x " * 23, " ".join(rnd.choice("ab") for _ in range(500))]
    docs = edge_rows.documents(spark, texts).withColumn("words", runs.words_of()).withColumn("runs", F.lit("clash"))
    rows = runs.with_runs(docs).withColumn("left", runs.kept_words()).withColumn("top", runs.greatest_run()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = WORDS.findall(r.text or "")
        want = brute(words) if len(words) < 5_000 else [(0, 18_000, 2)]
        assert r.words == words and [tuple(x) for x in r.runs] == want and r.left == collapsed(words, want)
        assert (r.top and tuple(r.top)) == (min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if want else None)
    empty = edge_rows.empty(spark).withColumn("words", runs.words_of())
    assert runs.with_runs(empty).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [None] * 30), (3, ["a", None] * 20), (4, [])], "id long, words array<string>")
    got = {r.id: [tuple(x) for x in r.runs] for r in runs.with_runs(odd).collect()}
    assert got == {1: [], 2: [(0, 30, 1)], 3: [(0, 40, 2)], 4: []}


def test_texts_are_grouped_without_runs_across(spark, monkeypatch):
    lists = runs.pa.array([["a"] * 20, ["a"] * 30, [], ["b", "a"] * 12, ["b", "a"] * 12], runs.pa.list_(runs.pa.string()))
    for size in (1, 40, 1_000):
        monkeypatch.setattr(runs, "GROUP_WORDS", size)
        parts = [runs._of_lists(g, 24).to_pylist() for g in runs._groups(lists)]
        found = [[tuple(x.values()) for x in r["runs"]] for p in parts for r in p]
        assert found == [[], [(0, 30, 1)], [], [(0, 24, 2)], [(0, 24, 2)]]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha, seen = (lambda s: hashlib.sha256(s.encode()).hexdigest()), 0
    rows = queries.op11_periodic_runs(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = WORDS.findall(texts[r.doc_id])
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3_000 and h % 10:
            continue  # brute force takes the square of the length
        want = brute(words)
        seen += len(want)
        assert (r.n_runs, r.runs_sha256) == (len(want), sha("".join(f"{s},{m},{q}\n" for s, m, q in want)))
        assert r.collapsed_sha256 == sha(" ".join(collapsed(words, want)))
        top = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if want else (None,) * 3
        assert (r.start, r.length, r.period) == top
        assert r.exponent_milli == (1000 * top[1] // top[2] if want else None)
    assert seen > 10

import math
import re
import string
import zlib
from collections import Counter

import numpy as np

from tests.llm import edge_rows
from tidemark.llm import lm, queries

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
FIELDS = ("n_tokens", "n_known", "train_tokens")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + ["\n"]


def base(docs):
    c = Counter(t for text, train in docs if train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for text, _ in docs:
        ts = tokens(text)
        out.append((len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)))
    return sorted(out), c


def same(rows, want):
    got = sorted((*[r[f] for f in FIELDS], r.base_score) for r in rows)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9)


def test_base_scores_of_edge_rows(spark):
    docs = edge_rows.documents(spark, [f"Common Word{i % 7} rare{i} end" for i in range(80)])
    train = lm.F.coalesce(docs.doc_id % 3 != 0, lm.F.lit(True))
    rows = [(r.text, r.doc_id is None or r.doc_id % 3 != 0) for r in docs.collect()]
    for frequent in (0, 5, 10_000):
        out = lm.score(docs, train, keep=("doc_id", "size"), frequent=frequent, segments=16).collect()
        same(out, base(rows)[0])
        assert all(r.score < 0 and r["size"] == 7 for r in out)
    assert lm.score(edge_rows.empty(spark), lm.F.lit(True), segments=2).collect() == []
    untaught = lm.score(docs, lm.F.lit(False), segments=2).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in untaught)


def test_filter_gives_quantised_counts():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 40_000, dtype=np.uint64) * np.uint64(2))
    counts = np.maximum(1, rng.pareto(0.7, len(keys))).astype(np.int64)
    segments, seg_bits = 8, 8 * 12_000
    whole = bytearray(seg_bits // 8 * segments)
    for s, low, extra in lm.packed(keys, counts, segments):
        whole[s * seg_bits // 8 : (s + 1) * seg_bits // 8] = lm.segment_filter(*lm.unpacked(low, extra), seg_bits)
    bits = np.frombuffer(bytes(whole), np.uint8)
    got, want = lm.probed(bits, keys, segments, seg_bits), lm.level_counts()[lm.levels(counts)]
    assert (got >= want).all() and (got == want).mean() > 0.85  # never below, seldom above
    assert (want / counts).max() <= 1.5 and (want / counts).min() >= 0.66
    absent = lm.probed(bits, keys + np.uint64(1 << 30), segments, seg_bits)
    assert (absent == 0).mean() > 0.85


def test_score_equals_the_model_by_hand_when_the_filter_is_roomy(spark):
    texts = ["a b a b a b c", "a b c d", "b a", "d d d d", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train = docs.doc_id != 1
    out = {r.doc_id: r.score for r in lm.score(docs, train, segments=16).collect()}
    kept = [tokens(t) for i, t in enumerate(texts) if i != 1]
    single, pair = Counter(t for ts in kept for t in ts), Counter(p for ts in kept for p in zip(["\t", *ts], ts))
    single["\t"] = len(kept)
    q = lambda c: float(lm.level_counts()[lm.levels(np.array([c]))[0]]) if c else 0.0
    norm = sum(c for t, c in single.items() if t != "\t") + len(single) - 1 + 1
    for i, t in enumerate(texts):
        ts = tokens(t)
        want = 0.0
        for u, v in zip(["\t", *ts], ts):
            want += math.log10((q(pair[u, v]) + lm.MU * (q(single[v]) + 1) / norm) / (max(q(single[u]), q(pair[u, v])) + lm.MU))
        assert math.isclose(out[i], want, rel_tol=1e-9)


def test_a_filter_beyond_the_bound_scores_as_a_broadcast_one(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.3, 60) % 5000) for _ in range(300)]
    docs = edge_rows.documents(spark, texts)
    train = lm.F.coalesce(docs.doc_id % 3 != 0, lm.F.lit(True))
    fields = ("doc_id", "size", *FIELDS, "base_score", "score")
    rows = lambda **more: sorted((tuple(r[f] for f in fields) for r in lm.score(docs, train, keep=("doc_id", "size"), segments=16, **more).collect()), key=str)
    want = rows()
    assert rows(max_filter_bytes=1024, chunk_tokens=2000) == want
    bits = lambda tokens: math.prod(lm.filter_shape(tokens, lm.SEGMENTS, lm.MAX_FILTER_BYTES)[:2])
    for tokens in (10**6, 4 * 10**8, 5 * 10**8, 4 * 10**9, 10**12):
        assert bits(tokens) >= lm.BITS_PER_TOKEN * tokens
        assert lm.filter_shape(tokens, lm.SEGMENTS, lm.MAX_FILTER_BYTES)[1] <= 8 * lm.SEGMENT_BYTES


def test_query_equals_plain_counts(spark):
    sf = "/root/testdata/sf0.01"
    texts = [(r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.op5_lm_scores(spark, sf).collect()
    same(rows, base(texts)[0])
    held = [r for r in rows if r.held_out]
    print("held-out log10 a token", sum(r.score for r in held) / sum(r.n_tokens for r in held), sum(r.base_score for r in held) / sum(r.n_tokens for r in held))
    assert sum(r.score for r in held) > 1.02 * sum(r.base_score for r in held)


def test_a_distributed_filter_answers_each_chunk_by_groups_of_segments(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 997}" for j in range(50))) for i in range(60)], "_row long, _t string").repartition(2)
    segments, seg_bits = 64, 8 * 64
    filter_ = lm.bloom_filter(docs, lm.word_counts(docs, "_t"), "_t", segments, seg_bits)
    chunks = lm._chunked(docs, 600)
    texts = {}
    for r in chunks.collect():
        texts.setdefault(r["_chunk"], []).append(r["_t"])
    assert len(texts) > 3
    rows = lm._answers(chunks, filter_, segments, seg_bits).collect()
    assert len(rows) == len(texts)  # all segments together are far smaller than a group; before, a row for each chunk and segment
    whole = lm._gathered(filter_, segments, seg_bits)
    for r in rows:
        keys = lm._keys_of(lm.Coded(lm.pa.array(texts[r["_chunk"]], lm.pa.string())))
        assert (np.diff(keys) > 0).all()
        assert (lm.level_counts()[np.frombuffer(r["levels"], np.uint8)] == lm.probed(whole, keys, segments, seg_bits)).all()


def test_remembered_levels_are_those_of_the_filter():
    rng = np.random.default_rng(2)
    level = {int(k): int(j) for k, j in zip(rng.integers(0, 64, 40), rng.integers(0, 9, 40))}
    held, probes = lm.Remembered(8), []

    def probe(keys):
        probes.append(len(keys))
        return np.array([level.get(int(k), 0) for k in keys], np.uint8)

    for _ in range(50):
        keys = np.unique(rng.integers(0, 64, 20, dtype=np.uint64))
        assert held.of(keys, probe).tolist() == [level.get(int(k), 0) for k in keys]
    assert held.of(np.empty(0, np.uint64), probe).tolist() == []
    best = np.uint64(max(level, key=level.get))
    held.of(np.array([best]), probe)
    assert held.of(np.array([best]), probe).tolist() == [level[int(best)]] and probes[-1] == 0

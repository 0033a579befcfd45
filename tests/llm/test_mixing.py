import re
from collections import defaultdict

from tests.llm import edge_rows
from tidemark.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes, weights=(5, 2, 1), cap=3):
    """Share, stop, reshare the excess until no source is above its stop."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def holds(rows, docs, tolerance):
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in docs:
        sizes[d.source] += size(d.text)
    want = reshared(sizes)
    assert sorted((str(r.doc_id), r.size) for r in rows) == sorted((str(d.doc_id), size(d.text)) for d in docs)
    source_of = {d.doc_id: d.source for d in docs}
    for r in rows:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance * want[s] + 1, (s, taken[s], want[s])


def test_edge_rows(spark):
    docs = edge_rows.documents(spark, [f"{'word ' * (i % 40 + 1)}" for i in range(300)])
    rows = mixing.mix(docs).collect()
    holds(rows, docs.collect(), 0.6)
    assert mixing.mix(edge_rows.empty(spark)).collect() == []
    nothing = docs.filter("doc_id in (2, 3)")
    assert [r.taken for r in mixing.mix(nothing).collect()] == [0, 0]


def test_small_sources_reach_their_stop(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else "a tiny one", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    out = mixing.mix(docs).collect()
    holds(out, docs.collect(), 0.02)
    assert {r.copies for r in out if r.source == "a tiny one"} == {3}


def test_query_meets_targets_and_reruns_agree(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    first, second = (queries.op1_mixing(spark, sf).collect() for _ in range(2))
    holds(first, docs, 0.02)
    assert sorted(first) == sorted(second)

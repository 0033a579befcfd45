import random
from collections import Counter, defaultdict

import numpy as np

from tests.llm import edge_rows
from tidemark.llm import neardup, queries


def weighted(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def by_hand(x, y):
    """Probability Jaccard from its definition, and Jaccard of the sets."""
    union = set(x) | set(y)
    if not union:
        return 1.0, 1.0
    p = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in union) for d in set(x) & set(y))
    return p, len(set(x) & set(y)) / len(union)


def classes_by_hand(rows, near=None):
    texts = sorted({t or "" for _, t in rows})
    sets = [weighted(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for e in s:
            holders[e].append(i)
    pairs = Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    for (a, b), n in pairs.items():
        if n >= 0.3 * max(len(sets[a]), len(sets[b])) and max(by_hand(sets[a], sets[b])) >= 0.8:
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i, t in rows:
        groups[find(texts.index(t or ""))].append(i)
    return sorted((sorted(g, key=str) for g in groups.values()), key=str)


def grouped(out):
    groups = defaultdict(list)
    for r in out:
        groups[r.class_id].append(r.doc_id)
        assert r.class_size >= 1
    return sorted((sorted(g, key=str) for g in groups.values()), key=str)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, big=120):
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    hot, passage, texts = fresh(120), fresh(60), []
    texts += [edited(rnd, hot, rnd.randrange(0, 5)) for _ in range(big)] + [" ".join(hot)] * 50
    texts += [" ".join(fresh(80) + passage + fresh(80)) for _ in range(60)]
    for _ in range(40):
        base = fresh(rnd.choice([7, 40, 200]))
        texts += [" ".join(base), edited(rnd, base, rnd.randrange(4))]
    return [(i, t) for i, t in enumerate(texts)]


def test_similarity_equals_its_definition():
    rnd = random.Random(1)
    for _ in range(40):
        a = " ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 60)))
        b = a + " " + " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 20)))
        doc, s, w = neardup.shingles([a, b])
        got = neardup.similarity(*((s[doc == i], w[doc == i]) for i in (0, 1)))
        assert np.allclose(got, by_hand(weighted(a), weighted(b)))


def test_slots_agree_with_the_probability_jaccard():
    rnd = random.Random(2)
    base = [f"w{i % 150}" for i in range(400)]
    texts = [" ".join(base), edited(rnd, base, 12), "one two", "one two", ""]
    doc, s, w = neardup.shingles(texts)
    sig = neardup.signatures(5, doc, s, w, slots=4000)
    want = by_hand(weighted(texts[0]), weighted(texts[1]))[0]
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (sig[2] == sig[3]).all() and (sig[4] == 0).all() and (sig[:4] != 0).all()


def test_classes_equal_brute_force(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, class_id int")
    want = classes_by_hand(rows)
    assert grouped(neardup.near_duplicates(docs).collect()) == want
    assert grouped(neardup.near_duplicates(docs, block=25).collect()) == want


def repeated(seed, n=25):
    """Texts that share their shingle sets up to a few, while passages come up to 60 times."""
    rnd, texts = random.Random(seed), []
    fresh = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    for _ in range(n):
        head, one, two = fresh(150), fresh(12), fresh(12)
        texts += [head + one + two, head + one * 40 + two, head + one + two * 60]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_texts_with_unevenly_repeated_passages_equal_brute_force(spark):
    rows = repeated(5)
    sets = [weighted(t) for _, t in rows[:3]]
    assert by_hand(sets[0], sets[1])[0] < 0.5 and by_hand(sets[1], sets[2])[0] < 0.5
    want = classes_by_hand(rows)
    assert len(want) == 25
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert grouped(neardup.near_duplicates(docs).collect()) == want
    rows = [*rows, *((1000 + i, t) for i, t in corpus(6, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert grouped(neardup.near_duplicates(docs, block=9).collect()) == classes_by_hand(rows)


def test_edge_rows(spark):
    docs = edge_rows.documents(spark)
    out = neardup.near_duplicates(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.text_hash].append(r)
    assert len(out) == docs.count()
    assert {r.class_id for r in out if r.doc_id in (2, 3)} == {2}
    assert [r.class_size for r in out if r.doc_id == 4] == [2, 2]
    assert [(r.class_id, r.class_size) for r in out if r.doc_id is None] == [(None, 1)]
    assert neardup.near_duplicates(edge_rows.empty(spark)).collect() == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert grouped(queries.op4_near_duplicates(spark, sf).collect()) == classes_by_hand(rows)

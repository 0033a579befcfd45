import math

import numpy as np
import pytest

from tidemark.llm import ann, mtree, queries

BAD = [(900_000, None), (900_050, [1.0, None]), (900_100, [float("nan"), 1.0]), (900_150, [float("inf"), 0.0]), (None, [1.0, 2.0]), (900_200, [])]
FEW = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (7, [0.0, 0.0]), (8, [2.0, 0.0]), (9, [2.0, 0.0]), *BAD]
SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "clash") for i, v in rows], SCHEMA)


def brute(rows, score, nonzero):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not nonzero):
            ok[i, tuple(v)] = np.array(v, dtype=np.float64)
    out = {}
    for (i, _), q in ok.items():
        if i % 50 == 0:
            scored = sorted((-score(q, v), j) for (j, _), v in ok.items() if j != i)[:5]
            out[i] = [(j, -s) for s, j in scored]
    return out


def cosine(a, b):
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def product(a, b):
    return int(np.floor(a * 256).astype(int) @ np.floor(b * 256).astype(int))


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def copies(n=1500, dims=16, seed=2):
    """Clusters, and one vector that a third of all rows share."""
    rng = np.random.default_rng(seed)
    centres, same = rng.normal(size=(6, dims)), rng.normal(size=dims).round(3).tolist()
    return [(i, same if i % 3 == 0 else (centres[i % 6] + 0.4 * rng.normal(size=dims)).tolist()) for i in range(n)]


def every_50(i):
    return i % 50 == 0


def test_nearest_on_few_rows(spark):
    got = by_query(ann.nearest(frame(spark, FEW), every_50))
    want = brute(FEW, cosine, True)
    assert {q: [v for v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in want.items()}
    assert ann.nearest(frame(spark, []), every_50).collect() == [] and ann.nearest(frame(spark, BAD), every_50).collect() == []


def test_nearest_recall_with_copies(spark):
    rows = copies()
    got, want = by_query(ann.nearest(frame(spark, rows), every_50, block=100)), brute(rows, cosine, True)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]
    assert sum(hits) / (5 * len(want)) >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert all(abs(s - cosine(vectors[q], vectors[v])) < 1e-12 for v, s in found)
    assert [v for v, _ in got[0]] == [3, 6, 9, 12, 15]  # ties among the copies go to smaller ids


def test_nearest_gives_full_lists_at_one_visit(spark):
    """Groups of copies and single vectors, many in leaves of a few rows; recall 0 calibrates to one leaf."""
    rng = np.random.default_rng(8)
    groups, lone = rng.normal(size=(40, 8)), rng.normal(size=(900, 8))
    rows = [(g * 10 + c, v.tolist()) for g, v in enumerate(groups) for c in range(6)]
    rows += [(50_000 + i, v.tolist()) for i, v in enumerate(lone)] + [(50_000, (-lone[0]).tolist())]
    got = {}
    for r in ann.nearest(frame(spark, rows), lambda i: (i % 10 == 0) | (i >= 50_000), recall=0.0).collect():
        got.setdefault(r.query_id, []).append(r["rank"])
    assert len(got) == 940 and all(len(r) == 5 * (2 if q == 50_000 else 1) for q, r in got.items())


def test_leaves_are_neither_large_nor_tiny():
    rng = np.random.default_rng(5)
    for sample in (rng.normal(size=(4000, 32)), np.concatenate([rng.normal(size=(3000, 8)), np.ones((900, 8))])):
        unit = ann._unit(sample)
        tree = ann.Tree.fit(unit)
        held = np.bincount(tree.leaves(unit), minlength=len(tree.leaf_of))
        assert held.min() >= ann.LEAST_SHARE * ann.LEAF_ROWS and len(held) < 3 * len(sample) / ann.LEAF_ROWS
        whole = tree.visits(unit[0], len(held))
        assert sorted(whole) == list(range(len(held))) and whole[0] == tree.leaves(unit[:1])[0]
        assert not any(isinstance(x, ann.Tree) for x in tree.state)


def test_products_on_few_rows(spark):
    assert by_query(mtree.top_products(frame(spark, FEW), every_50)) == brute(FEW, product, False)
    assert mtree.top_products(frame(spark, []), every_50).collect() == []


@pytest.mark.parametrize(("block", "page"), [(4096, 256), (150, 16)])
def test_products_are_exact(spark, block, page):
    rows = copies()
    assert by_query(mtree.top_products(frame(spark, rows), every_50, block=block, page=page)) == brute(rows, product, False)


def test_search_computes_fewer_products_than_rows():
    rng = np.random.default_rng(4)
    v = np.floor(256 * (rng.normal(size=(40, 1, 3)) * 5 + rng.normal(size=(40, 100, 3)) * 0.1).reshape(-1, 3))
    top = float((v * v).sum(axis=1).max())
    route, counts = mtree.lifted(v[:1], top)[0], []
    pages = mtree.pages_of(np.arange(len(v)), v, route, top, 64)
    for q in range(0, 4000, 100):
        got = mtree.search(pages, route, v[q], q, top, 5, np.inf, counts)
        want = sorted((-int(s), i) for i, s in enumerate(mtree.products(v[[q]], v)[0]) if i != q)[:5]
        assert got.rows == want
    assert sum(counts) < 0.25 * 40 * len(v)


def test_queries_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = by_query(queries.op3_ann(spark, sf)), brute(rows, cosine, True)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]
    assert len(got) == len(want) and sum(hits) / (5 * len(want)) >= 0.9
    assert by_query(queries.op9_top_products(spark, sf)) == brute(rows, product, False)

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import edge_rows
from tidemark.llm import collocations, queries

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, top, least):
    """Each language's rows (lang, rank, phrase, a, l, r, n, score), from (text, lang) pairs."""
    f, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if (q := p[i : i + k]) in found and 100 * a >= 80 * found[q]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(rnd, n):
    """Texts with a common stock of words, set phrases inside others, and copies of a passage."""
    stock = [f"w{k}" for k in range(30)] + ["É", "ß", "a\x00b"]
    sets = [[f"s{k}{j}" for j in range(rnd.randrange(2, 7))] for k in range(25)]
    passage = " ".join(f"p{k}" for k in range(40))
    for k in range(n):
        words = []
        for _ in range(60):
            if rnd.random() < 0.3:
                words += [w.upper() if rnd.random() < 0.2 else w for w in rnd.choice(sets)]
            else:
                words.append(rnd.choice(stock) + rnd.choice(["", "", "", ".", "\n", ",x"]))
        yield rnd.choice([" ", "\t", "  "]).join(words) + (". " + passage if k % 4 == 0 else ""), rnd.choice(["en", "en", "fr", None])


@pytest.mark.parametrize("top,least,ahead", [(5, 2, 1), (40, 3, 2), (2000, 2, 4)])
def test_growth_equals_counting_everything(spark, monkeypatch, top, least, ahead):
    monkeypatch.setattr(collocations, "AHEAD", ahead)
    docs = list(made(random.Random(top), 120))
    got = rows_of(collocations.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(5), top=top, least=least))
    assert got == brute(docs, top, least) and len(got) > 10


def test_bounds_hold_back_what_is_settled(spark, monkeypatch):
    """With few phrases asked for, most pairs are never followed."""
    followed = []
    grown = collocations.grown
    monkeypatch.setattr(collocations, "grown", lambda d, frontier, *a: followed.append(frontier.count()) or grown(d, frontier, *a))
    monkeypatch.setattr(collocations, "AHEAD", 1)
    docs = list(made(random.Random(1), 120))
    got = rows_of(collocations.collocations(spark.createDataFrame(docs, "text string, lang string"), top=3, least=2))
    assert got == brute(docs, 3, 2)
    candidates = len({(r[0], r[2]) for r in brute(docs, 10**6, 2)})
    assert len(followed) > 2 and max(followed) < 0.2 * candidates


def test_edge_rows(spark):
    docs = edge_rows.documents(spark, ["Same old Words; same old words"] * 3 + [",,;", "x"])
    want = brute([(r.text, r.lang) for r in docs.collect()], 2000, 3)
    assert rows_of(collocations.collocations(docs, least=3)) == want and want
    assert collocations.collocations(edge_rows.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        collocations.collocations(docs, least=300).collect()


def test_scores_do_not_pass_64_bits(spark):
    big = 4 * 10**18
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7), ("en", "a b", big - 1)], "lang string, phrase string, f long")
    row = collocations.scored(counts.filter("phrase = 'a b'"), counts).first()
    assert row.score == 2_000_000 * (big - 1) // (2 * big + 7) and row.bound == 2_000_000 * (big - 1) // (2 * big - 1)


def test_pieces_and_words_of_a_chunk():
    texts = ["One two,three\tfour", "", "five", " six\x0bseven ..EIGHT nine"]
    chunk = collocations.Chunk(pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["x"] * 4)], ["text", "lang"]))
    assert [chunk.words[c].as_py() for c in chunk.codes] == "one two three four five six seven eight nine".split()
    assert np.flatnonzero(chunk.places(2)).tolist() == [0, 2, 7] and not chunk.places(3).any()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op13_collocations(spark, sf)) == brute(docs, 2000, 30)

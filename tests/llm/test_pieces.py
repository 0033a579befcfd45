import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tests.llm import edge_rows
from tidemark.llm import queries, sentence_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = ["abcde", "ab", "aé́ñ", " ", "   ", "▁", "0123", "the and tion ", "日本語テ", "🎉\x00", "<s></s>", "ing er", "─l", " \n\t", "ééß"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def mixed(rnd, names, n):
    return "".join(rnd.choice(rnd.choice(ALPHABETS)) if rnd.random() < 0.7 else rnd.choice(names) for _ in range(n))


def test_random_texts_and_ids_equal_the_library(library):
    v = sentence_pieces.Vocabulary(open(MODEL, "rb").read())
    encoder, decoder = sentence_pieces.Encoder(v, sentence_pieces.reachable(v)), sentence_pieces.Decoder(v)
    rnd = random.Random(3)
    for k in range(3_000):
        text = mixed(rnd, v.names[259:], rnd.choice([1, 5, 20, 80]))
        text = text.replace(" ", "").replace("▁", "") if k % 3 == 0 else text
        assert encoder.encode(text).tolist() == library.encode(text)
        ids = [rnd.choice([rnd.randrange(32_000), rnd.randrange(259), 28705, 264, 0, 1, 2]) for _ in range(rnd.randrange(8))]
        assert decoder.decode(sentence_pieces.np.array(ids, dtype=int)) == library.decode(ids)


def test_a_failed_position_is_taken_back():
    """Greedy `ab` + `c` can't stand: merging gives a, bc; the walk must return over `ab`."""
    ranks = {"a": 0.0, "b": 0.0, "c": 0.0, "bc": 1.0, "ab": 2.0}

    class Tiny:
        pass

    v = Tiny()
    v.ranks, v.ids, v.tied = ranks, {n: i for i, n in enumerate(ranks)}, ""
    encoder = sentence_pieces.Encoder(v, list(ranks))
    assert encoder.backtracked("abc") == ["a", "bc"] == sentence_pieces.merged("abc", ranks)
    for text in ("abcab", "aabbcc", "bcabcbabc"):
        assert encoder.backtracked(text) == sentence_pieces.merged(text, ranks)


@pytest.mark.parametrize("text", ["x" * 60_000, " " * 9_000, "ab" * 30_000, "日" * 9_000])
def test_long_unbroken_texts(library, text):
    v = sentence_pieces.Vocabulary(open(MODEL, "rb").read())
    encoder = sentence_pieces.Encoder(v, sentence_pieces.reachable(v))
    assert encoder.encode(text).tolist() == library.encode(text)
    assert not any(len(s) > sentence_pieces.REMEMBERED_CHARS for s in encoder.words)


def test_operator_on_edge_rows(spark, library):
    docs = edge_rows.documents(spark, ["▁▁x", "  two  blanks  ", "日本語 \x00"])
    out = sentence_pieces.encode(docs, MODEL)
    rows = out.withColumn("back", sentence_pieces.decode(out, MODEL)).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {*docs.columns, "back"}
    for r in rows:
        want = library.encode(r.text or "")
        assert r.ids == want and r.back == library.decode(want)
    assert sentence_pieces.encode(edge_rows.empty(spark), MODEL).collect() == []
    nothing = docs.limit(1).select(F.lit(None).cast("array<int>").alias("ids"))
    assert nothing.select(sentence_pieces.decode(nothing, MODEL)).first()[0] == ""


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op12_sentence_pieces(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))

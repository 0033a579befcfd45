import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import edge_rows
from tidemark.llm import bpe, queries, token_counts

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ALPHABETS = ["abcde", "ab", "aé́ñ", "'sve!.", "<|endoftext|>", "🎉日本", "0123", "İßſ  \x1c\x0b", "the and tion ", "á̧", " \n\t"]


def mixed(rnd, n):
    return "".join(rnd.choice(rnd.choice(ALPHABETS)) if rnd.random() < 0.9 else rnd.choice(ALPHABETS) for _ in range(n))


@pytest.mark.parametrize("path, size", [(WORD, 97), (BYTE, 97), (WORD, 200), (BYTE, 333)])
def test_tree_joins_equal_the_library(spark, path, size):
    rnd, tok = random.Random(size), Tokenizer.from_file(path)
    texts = [mixed(rnd, rnd.choice([40, 98, 600, 2500])) for _ in range(30)]
    texts = [t.replace(" ", "") if k % 2 else t for k, t in enumerate(texts)] + [" " * 1500, "a" * 1500, "1" * 700 + "'" * 300 + "s" * 400, "\n " * 400 + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.encode(docs, path, leaf_chars=size).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r.ids == tok.encode(r.text, add_special_tokens=False).ids


def test_leaves_of_a_long_unsplit_text_are_spread(spark):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdeé日'x1") for _ in range(700_000))
    texts = spark.createDataFrame([("h", text)], "_text_hash string, _t string")
    leaves = bpe._leaves(texts, 20_000, True)
    spread = leaves.groupBy(bpe.F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in spread) == 35 and max(r["count"] for r in spread) < 30 and len(spread) > 1
    docs = texts.select(bpe.F.col("_t").alias("text"))
    assert bpe.encode(docs, WORD, leaf_chars=20_000).first().ids == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids


def test_encode_and_decode_equal_the_library(spark):
    rnd = random.Random(6)
    docs = edge_rows.documents(spark, [mixed(rnd, 400) for _ in range(60)] + ["x" * 70_000, mixed(rnd, 80_000)])
    tok = Tokenizer.from_file(WORD)
    out = bpe.encode(docs, WORD, leaf_chars=20_000)
    out = out.withColumn("back", bpe.decode(out, WORD)).collect()
    assert len(out) == docs.count() and set(out[0].asDict()) == {*docs.columns, "back"}
    for r in out:
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.back == tok.decode(want, skip_special_tokens=False)
    assert bpe.encode(edge_rows.empty(spark), WORD).collect() == []


def test_encode_of_a_byte_level_file_keeps_white_space(spark):
    docs, tok = edge_rows.documents(spark), Tokenizer.from_file(BYTE)
    out = bpe.encode(docs, BYTE)
    for r in out.withColumn("back", bpe.decode(out, BYTE)).collect():
        assert r.ids == tok.encode(r.text or "", add_special_tokens=False).ids and r.back == (r.text or "")


@pytest.mark.parametrize("path", [BYTE, WORD, public_tokenizers.path("piece_bpe_32k.model")])
def test_counts_equal_the_library(spark, path):
    rnd = random.Random(7)
    docs = edge_rows.documents(spark, [mixed(rnd, 300) for _ in range(80)])
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        lengths = SentencePieceProcessor(model_file=path)
        want = lambda t: len(lengths.encode(t))
    else:
        tok = Tokenizer.from_file(path)
        want = lambda t: len(tok.encode(t, add_special_tokens=False))
    out = token_counts.with_token_counts(docs, path).collect()
    assert len(out) == docs.count()
    for r in out:
        assert (r.n_tokens, r.n_bytes) == (want(r.text or ""), len((r.text or "").encode()))
        assert r.over_limit == (r.n_tokens > 512)
    assert token_counts.with_token_counts(edge_rows.empty(spark), path).count() == 0


def test_queries_equal_the_library_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op2_bpe(spark, sf).collect():
        ids = word.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert r.decoded_sha256 == sha(word.decode(ids, skip_special_tokens=False))
    for r in queries.op7_token_counts(spark, sf).collect():
        assert r.n_tokens == len(byte.encode(texts[r.doc_id], add_special_tokens=False))


def test_join_of_two_words_with_agreement_far_away():
    enc = bpe.Encoder(open(WORD, encoding="utf-8").read())
    for left, right in (("a" * 5000, "a" * 5000), ("<|endof", "text|>" * 400), ("", "abc"), ("x" * 3000 + "'", "s" * 3000)):
        u, v = bpe._encode_open(enc.tok, left), bpe._encode_open(enc.tok, right)
        assert bpe.join_open(enc.tok, u, v).ids.tolist() == enc.tok.encode(left + right, add_special_tokens=False).ids

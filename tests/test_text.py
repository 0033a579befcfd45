import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.functions import text as TX
from tidemark.functions.scalars import clean_token
from tidemark.operators import embeddings as EM
from tidemark.operators import lsa as LS
from tidemark.operators import sequences as SQ
from tidemark.operators import tfidf as TF
from tidemark.operators import topics as TP
from tidemark.plans.families import Lexicon
from tidemark.sources import lexicons as LX
from tidemark.sources import tables as TB


def values(df):
    return [r[0] for r in df.collect()]


def test_normalisers(spark):
    df = spark.createDataFrame([(None,), ("",), ("the AND of",), ("see http://a.b/c?d",), ("hi @jösé! ok",), ("x httpfoo y",)], "t string")
    assert values(df.select(TX.normalize_text(F.col("t")))) == ["", "", "", "see url", "hi usr ok", "x url"]
    soc = spark.createDataFrame([(None,), ("the",), ("Soooo COOL :D www.x.y #Tag don't it's 😀",)], "t string")
    assert values(soc.select(TX.normalize_social(F.col("t")))) == ["usr", "usr", "sooo cool :D url #tag 😀"]
    assert values(df.select(TX.token_count(TX.normalize_text(F.col("t"))))) == [0, 0, 0, 2, 3, 2]
    assert values(spark.createDataFrame([("##Ing!",), ("É_a",)], "t string").select(clean_token(F.col("t")))) == ["ing", "_a"]


def test_stopword_lists():
    assert len(TX.SHORT_STOPWORDS) == 40 and len(TX.ENGLISH_STOPWORDS) == 179


DOCS = [(1, ["aa", "bb", "aa", "c"]), (2, ["aa", "dd"]), (3, ["bb", "dd", "bb"]), (4, []), (5, ["zz"])]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc long, tokens array<string>")


def test_ngrams_skip_short_tokens(spark):
    t = TF.with_terms(docs(spark), 3)
    assert {r["doc"]: r["terms"] for r in t.collect()}[1] == ["aa", "bb", "aa", "aa bb", "bb aa", "aa bb aa"]


def test_tfidf_bounds_norm_and_vector_form(spark):
    d = TF.with_terms(docs(spark), 1)
    m = TF.fit_tfidf(d, "doc", min_df=2, max_df=0.4)
    assert {r["term"]: (r["df"], r["cf"]) for r in m.vocab.collect()} == {"aa": (2, 3), "bb": (2, 3), "dd": (2, 2)}
    long = {(r["doc"], r["term"]): r["weight"] for r in m.long(d, "doc").collect()}
    assert sum(v * v for (k, _), v in long.items() if k == 1) == pytest.approx(1.0)
    vec = m.vectorizer().transform(d).select("doc", vector_to_array("bow").alias("v")).collect()
    names = [r["term"] for r in m.terms_in_order()]
    flat = {(r["doc"], n): x for r in vec for n, x in zip(names, r["v"]) if x}
    assert flat.keys() == long.keys() and all(flat[k] == pytest.approx(long[k]) for k in flat)
    # Documents spread over rows give the same statistics.
    split = d.select("doc", F.explode("terms").alias("t")).select("doc", F.array("t").alias("terms"))
    a = {tuple(r) for r in TF.term_stats(d, "doc").collect()}
    assert {tuple(r) for r in TF.term_stats(split, "doc", unique_docs=False).select("term", "df", "cf").collect()} == a


def test_topics(spark):
    cmap = spark.createDataFrame([("aa", 0), ("dd", 2)], "token string, cluster int")
    got = {(r["doc"], r["cluster"]): r["share"] for r in TP.topic_features(docs(spark), cmap, "doc").collect()}
    assert got == {(1, 0): 0.5, (2, 0): 0.5, (2, 2): 0.5, (3, 2): pytest.approx(1 / 3)}
    lex = Lexicon.load(cmap, 3)
    vec = docs(spark).select("doc", vector_to_array(TP.topic_vector(F.col("tokens"), lex.words, lex.clusters, 3)).alias("v"))
    dense = {r["doc"]: list(r["v"]) for r in vec.collect()}
    assert dense[1] == [0.5, 0, 0] and dense[4] == [0, 0, 0] and dense[2] == [0.5, 0, 0.5]


def test_vocab_encode_both_ways(spark):
    v = SQ.build_vocab(docs(spark), max_size=6)
    assert [tuple(r)[:2] for r in v.orderBy("id").collect()] == [("<pad>", 0), ("<unk>", 1), ("url", 2), ("usr", 3), ("aa", 4), ("bb", 5)]
    a = {r["doc"]: r["ids"] for r in SQ.encode_tokens(docs(spark), v).collect()}
    b = {r["doc"]: r["ids"] for r in SQ.encode_tokens(docs(spark), v, vocab_max_rows=None, key=["doc"]).collect()}
    assert a == b and a[1] == [4, 5, 4, 1] and a[4] == []


@pytest.mark.parametrize("overlap", [0, 2])
def test_chunks_and_padding(spark, overlap):
    lens = [0, 1, 4, 5, 6, 10, 40]
    df = spark.createDataFrame([(n, list(range(10, 10 + n))) for n in lens], "n int, ids array<int>")
    got = {}
    for r in sorted(SQ.chunk_sequences(df, "ids", 5, overlap, 4).collect(), key=lambda r: (r["n"], r["chunk"])):
        got.setdefault(r["n"], []).append(r["chunk_ids"])
    step = 5 - overlap
    for n in lens:
        ids = list(range(10, 10 + n))
        assert got[n] == ([ids[i : i + 5] for i in range(0, n, step)][:4] or [[3]])
    p, m = SQ.pad_sequences(F.col("ids"), 5)
    for r in df.select("ids", p.alias("p"), m.alias("m")).collect():
        want = r["ids"][:5]
        assert r["p"] == want + [0] * (5 - len(want)) and r["m"] == [1] * len(want) + [0] * (5 - len(want))


def test_embeddings_both_ways_and_pooling(spark):
    wv = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [0.0, 3.0])], "token string, vector array<float>")
    a = {r["doc"]: r["embedding"] for r in EM.doc_embeddings(docs(spark), wv, "doc", 2).collect()}
    b = {r["doc"]: r["embedding"] for r in EM.doc_embeddings(docs(spark), wv, "doc", 2, wv_max_rows=None).collect()}
    assert a[1] == pytest.approx([2 / 3, 1.0]) and a[4] is None and a[5] is None
    assert a[1] == pytest.approx(b[1]) and b[5] is None
    with pytest.raises(ValueError, match="more than 1"):
        EM.vector_matrix(wv, 2, 1)
    ch = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (1, None)], "doc int, vector array<double>")
    assert list(EM.pool_chunks(ch, ["doc"]).first()["pooled"]) == [2.0, 3.0]


def test_lsa_matches_numpy(spark):
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(0).normal(size=(40, 6)) + 1.0
    df = spark.createDataFrame([(i, Vectors.dense(r) if i % 2 else Vectors.sparse(6, range(6), r)) for i, r in enumerate(x)], ["i", "v"])
    m = LS.fit_lsa(df, "v", 3, 6)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(m.singular_values, s[:3])
    z = np.array([r["z"].toArray() for r in m.transform(df, "v", "z").orderBy("i").collect()])
    assert np.allclose(np.abs(z), np.abs(x @ vt[:3].T))
    assert LS.fit_lsa(df, "v", 6, 6, clamp=False) is None and LS.fit_lsa(df, "v", 9, 6).k == 5
    scaled = LS.fit_lsa(df, "v", 2, 6, scale=True).transform(df, "v", "z")
    assert np.allclose(np.std([r["z"].toArray() for r in scaled.collect()], axis=0), 1.0)


def test_cluster_map_file(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("aa 0.1 3\n\nlonely\nbb 7\naa 5\ncc 9\n")
    cmap, n = LX.read_cluster_map(spark, str(p))
    assert {tuple(r) for r in cmap.collect()} == {("aa", 5), ("bb", 7), ("cc", 9)} and n == 10
    assert LX.read_cluster_map(spark, str(p), cap=2)[1] == 8
    p.write_text("aa x\n")
    with pytest.raises(Exception, match="not an integer"):
        LX.read_cluster_map(spark, str(p))


def test_word_vectors_file(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_text("aa 1 2\nbb 1\naa 3 4\ncc 1 2 3\n")
    assert {r["token"]: r["vector"] for r in LX.read_word_vectors(spark, str(p), 2).collect()} == {"aa": [3.0, 4.0]}


def test_tables_round_trip(spark, tmp_path):
    a = spark.createDataFrame([(1, float("nan"))], "user_id int, x double")
    TB.write_table(a, str(tmp_path / "a.parquet"))
    TB.write_table(spark.createDataFrame([(2, 7)], "user_id int, y int"), str(tmp_path / "b.csv"), fmt="csv")
    both = TB.read_posts(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.parquet")])
    assert {(r["user_id"], r["x"], r["y"]) for r in both.collect()} == {(1, None, None), (2, None, 7)}
    with pytest.raises(ValueError, match="missing columns"):
        TB.read_labeled_users(spark, str(tmp_path / "a.parquet"), required=["label"])
    TB.write_table(spark.createDataFrame([(1, 2), (2, 3)], "fold int, v int"), str(tmp_path / "f"), partition_by="fold")
    assert (tmp_path / "f" / "fold=1").is_dir()

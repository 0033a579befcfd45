"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, collocations, html_main, lm, mixing, mtree, neardup, quality, runs, secrets, sentence_pieces, token_counts
from tidemark.llm.common import table

WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_mixing(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source"), weights=(5, 2, 1), cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_bpe(spark, sf):
    path = public_tokenizers.path(WORD_BPE)
    ids = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    decoded = ids.withColumn("decoded", bpe.decode(ids, path))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_ann(spark, sf):
    return ann.nearest(table(spark, sf, "embeddings"), lambda i: i % 50 == 0, k=5)


def op4_near_duplicates(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op5_lm_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("held_out", quality.held_out("doc_id", 7, 2))
    scored = lm.score(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_html(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return pages.select("page_id", "url", html_main.main_text_of(pages).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path(BYTE_BPE), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_secrets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secrets.secret_spans(docs).alias("found"))

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] != "checked")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("found")).alias("spans"),
    )


def op9_top_products(spark, sf):
    return mtree.top_products(table(spark, sf, "embeddings"), lambda i: i % 50 == 0, k=5, scale=256.0)


def op10_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf, "labels"))
    scored = quality.with_scores(docs, model, least=0.3)
    return scored.select("doc_id", quality.held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def periodic_tail(words, doc_id="doc_id"):
    """Where op11's contract makes the words of a tenth of the documents periodic, and the period; else null."""
    h, n = F.crc32(F.col(doc_id).cast("string")), F.size(words)
    g = F.floor(h / 10)
    tail = g % n
    period = F.floor((n - tail) / (3 + g % 8)) + 1
    return F.when((h % 10 == 0) & (n > 0), F.struct(tail.alias("tail"), period.alias("period")))


def op11_periodic_runs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("words", runs.words_of()).drop("text")
    shape = docs.withColumn("shape", periodic_tail("words"))
    place = lambda i: (F.col("shape.tail") + (i - F.col("shape.tail")) % F.col("shape.period")).cast("int")
    tailed = F.transform("words", lambda w, i: F.when(i < F.col("shape.tail"), w).otherwise(F.get("words", place(i))))
    docs = shape.withColumn("words", F.when(F.col("shape").isNotNull(), tailed).otherwise(F.col("words"))).drop("shape")
    found = runs.with_runs(docs).withColumn("top", runs.greatest_run())
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.array_join(runs.kept_words(), " "), 256).alias("collapsed_sha256"),
    )


def op12_sentence_pieces(spark, sf):
    path = public_tokenizers.path(PIECE_BPE)
    ids = sentence_pieces.encode(table(spark, sf, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    decoded = ids.withColumn("decoded", sentence_pieces.decode(ids, path))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents").select("text", "lang"), top=2000, least=30)


QUERIES = {"op1_mixing": op1_mixing, "op2_bpe": op2_bpe, "op3_ann": op3_ann, "op4_near_duplicates": op4_near_duplicates, "op5_lm_scores": op5_lm_scores, "op6_html": op6_html, "op7_token_counts": op7_token_counts, "op8_secrets": op8_secrets, "op9_top_products": op9_top_products, "op10_quality": op10_quality, "op11_periodic_runs": op11_periodic_runs, "op12_sentence_pieces": op12_sentence_pieces, "op13_collocations": op13_collocations}
OP13_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (
  SELECT doc, lang, generate_subscripts(parts, 1) AS piece, unnest(parts) AS part
  FROM (SELECT doc, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS parts FROM texts)),
words AS (
  SELECT doc, lang, piece, generate_subscripts(list, 1) AS place, unnest(list) AS w1
  FROM (SELECT doc, lang, piece, regexp_extract_all(part, '[^\x20\x09]+') AS list FROM pieces)),
places AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
  FROM words WINDOW p AS (PARTITION BY doc, piece ORDER BY place)),
counts AS (
  SELECT lang, 1 AS size, w1 AS phrase, count(*) AS f FROM places GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM places WHERE w4 IS NOT NULL GROUP BY ALL),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS list, f AS a FROM counts WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT lang, size, phrase, a, k, row(lang, array_to_string(list[:k], ' ')) AS head, row(lang, array_to_string(list[k + 1:], ' ')) AS tail
  FROM candidates, (VALUES (1), (2), (3)) AS c(k) WHERE k < size),
keyed AS (SELECT row(lang, phrase) AS key, f FROM counts WHERE f >= 30),
scores AS (
  SELECT c.*, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM cuts c JOIN keyed l ON l.key = c.head JOIN keyed r ON r.key = c.tail),
worst AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scores) WHERE nth = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(list[i:j], ' ') AS phrase
  FROM candidates, (VALUES (1, 2), (2, 3), (3, 4), (1, 3), (2, 4)) AS s(i, j) WHERE j <= size AND j - i + 1 < size),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, score
  FROM worst w LEFT JOIN longest g ON g.lang = w.lang AND g.phrase = w.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score
FROM ranked k JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang) t ON t.lang = k.lang
WHERE k.rank <= 2000
"""
#: None of the others has a SQL form; tests/llm holds their brute-force versions.
SQL: dict[str, str] = {"op13_collocations": OP13_SQL}

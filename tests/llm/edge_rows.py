"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, _row string"
LONG = "the quick " * 9_000 + "unbroken" * 6_000 + " end."


def rows(texts=()):
    plain = [
        (1, "A plain text, of ten words or so, for the tests."),
        (2, ""),
        (3, None),
        (None, "no id at all"),
        (4, LONG),
        (4, LONG),
        (5, "  \n\t "),
        (6, "It's <|endoftext|>café ñ ééé 12   x　y !!'s\x0b\x1c"),
        *((100 + i, t) for i, t in enumerate(texts)),
    ]
    return [(i, t, None if i == 1 else "en", None if i in (2, 3) else f"s{(i or 0) % 3}", len(t or ""), 7, "clash", "x") for i, t in plain]


def documents(spark, texts=()):
    return spark.createDataFrame(rows(texts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

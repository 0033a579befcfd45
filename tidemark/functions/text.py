"""Text normalisers, tokens and n-grams as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two stopword lists the normalisers are defined with.
SHORT_STOPWORDS: tuple[str, ...] = tuple(
    """
    the a an and or but if while is are was were be to of in on for with as at by this that it its
    from we you i me my our your they their he she his her
    """.split()
)
ENGLISH_STOPWORDS: tuple[str, ...] = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
    yourselves he him his himself she she's her hers herself it it's its itself they them their
    theirs themselves what which who whom this that that'll these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at
    by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don
    don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn
    doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
    needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# Character classes spelled out so that they mean the same in Java and in RE2: Unicode letters,
# numbers and underscore for a handle, and everything but Unicode white space for a link.
WORD = r"[\p{L}\p{N}_]"
NON_SPACE = r"[^\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
URL_LOWER = "http" + NON_SPACE + "+"
MENTION = "@" + WORD + "+"
URL_FORMS = "https?://" + NON_SPACE + r"+|www\." + NON_SPACE + "+|http" + NON_SPACE + "+"
PLAIN_TOKEN = "([a-z0-9_]+)"

EMOTICON = r"<3|[<>]?[:;=8][\-o*']?[)\](\[dDpP/}{@|\\]"
SOCIAL_TOKEN = "|".join(
    [
        EMOTICON,
        "#+" + WORD + "+",
        r"\p{L}[\p{L}'_\-]+\p{L}",
        r"[+\-]?[0-9]+[,/.:\-][0-9]+[+\-]?",
        WORD + "+",
        r"\.\.+",
        NON_SPACE,
    ]
)


def _drop_words(tokens: Column, stopwords: Sequence[str]) -> Column:
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(*stopwords))


def normalize_tokens(c: Column, stopwords: Sequence[str] = ENGLISH_STOPWORDS) -> Column:
    """Normaliser A: lower, links to `url`, mentions to `usr`, ASCII word tokens, stopwords out."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, URL_LOWER, " url ")
    t = F.regexp_replace(t, MENTION, " usr ")
    return _drop_words(F.regexp_extract_all(t, F.lit(PLAIN_TOKEN), F.lit(1)), stopwords)


def normalize_text(c: Column, stopwords: Sequence[str] = ENGLISH_STOPWORDS) -> Column:
    return F.array_join(normalize_tokens(c, stopwords), " ")


def social_tokens(c: Column, stopwords: Sequence[str] = ENGLISH_STOPWORDS) -> Column:
    """Normaliser B: social-media tokens, lower-cased except emoticons, long runs cut to three.

    One regular expression stands in for a social tokenizer: emoticons, hashtags, words with inner
    apostrophes or dashes, numbers, dot runs and single symbols. Never empty: `usr` stands in.
    """
    t = F.coalesce(c, F.lit(""))
    t = F.regexp_replace(t, URL_FORMS, " url ")
    t = F.regexp_replace(t, MENTION, " usr ")
    t = F.regexp_replace(t, r"(.)\1{2,}", "$1$1$1")
    toks = F.regexp_extract_all(t, F.lit("(" + SOCIAL_TOKEN + ")"), F.lit(1))
    toks = F.transform(toks, lambda w: F.when(w.rlike("^(?:" + EMOTICON + ")$"), w).otherwise(F.lower(w)))
    kept = _drop_words(toks, stopwords)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("usr")))


def normalize_social(c: Column, stopwords: Sequence[str] = ENGLISH_STOPWORDS) -> Column:
    return F.array_join(social_tokens(c, stopwords), " ")


def token_count(c: Column) -> Column:
    """White-space token count of a normalised string; empty and null count as zero."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def long_tokens(tokens: Column) -> Column:
    """Tokens of at least two characters, the ones n-grams are built from."""
    return F.filter(tokens, lambda w: F.length(w) >= 2)


def gram_at(tokens: Column, n: int):
    # Element access is constant time; a slice would copy the whole array for every gram.
    return lambda start: F.concat_ws(" ", *[F.get(tokens, start + i) for i in range(n)])


def ngrams(tokens: Column, max_n: int) -> Column:
    """All 1..max_n grams of an already materialised token array."""
    parts = [tokens]
    for n in range(2, max_n + 1):
        starts = F.sequence(F.lit(0), F.size(tokens) - n)
        grams = F.transform(starts, gram_at(tokens, n))
        parts.append(F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]

"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees over the statistics propose rules (every path from a root is a conjunction of bounds), a
lasso logistic fit gives most of them weight zero, and the rest is compiled into one column expression, so
scoring is a projection of the scan. Only the fit reads labels, from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, checkpointed, text_or_empty

#: Rows of the labelled sample that the fit may use, the first by hash of the key.
MAX_TRAIN_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 12, 3, 2e-4, 17


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def statistics(text: str = "text") -> dict[str, Column]:
    """Raw counts of a whole text; null counts as empty."""
    t = text_or_empty(text)
    words = F.split(t, r"[\x20\x09-\x0D]+")
    return {
        "chars": F.length(t).cast("double"),
        "words": _count(t, WORD),
        "distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "upper": _count(t, r"\p{Lu}"),
        "symbols": _count(t, r"[^\p{L}\p{N}\s.,;:!?'\"()-]"),
        "stops": _count(t, r"[.!?]"),
        "shouts": _count(t, r"!!+"),
        "digits": _count(t, r"\p{N}"),
        "lines": _count(t, r"\n") + 1,
        "distinct_lines": F.size(F.array_distinct(F.split(t, "\n"))).cast("double"),
    }


def features() -> dict[str, Column]:
    """What the rules look at, from the columns of `statistics`; a text without words has zeros."""

    def per(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col("_s_" + a), F.col("_s_" + b)), F.lit(0.0))

    return {
        "log_words": F.log1p(F.col("_s_words")),
        "word_length": per("chars", "words"),
        "distinct_share": per("distinct_words", "words"),
        "upper_share": per("upper", "chars"),
        "symbol_share": per("symbols", "words"),
        "stop_share": per("stops", "words"),
        "shout_share": per("shouts", "words"),
        "digit_share": per("digits", "chars"),
        "line_words": per("words", "lines"),
        "distinct_lines": per("distinct_lines", "lines"),
    }


@dataclass(frozen=True)
class Rule:
    """All of `bounds`: (feature, whether at most, threshold)."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self, prefix: str = "") -> Column:
        tests = [(F.col(prefix + f) <= t) if low else (F.col(prefix + f) > t) for f, low, t in self.bounds]
        return reduce(lambda a, b: a & b, tests).cast("double")


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, prefix: str = "") -> Column:
        logit = F.lit(self.intercept)
        for rule, w in self.weights:
            logit = logit + rule.column(prefix) * F.lit(w)
        return 1.0 / (1.0 + F.exp(-logit))


def tree_rules(debug: str, names: list[str]) -> list[Rule]:
    """Every path of the printed trees, as a conjunction; the tightest bound of a feature and side stays."""
    found: dict[Rule, None] = {}
    path: list[tuple[int, str, bool, float]] = []
    for line in debug.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, names[int(m[2])], m[3] == "<=", float(m[4])))
        tight: dict[tuple[str, bool], float] = {}
        for _, f, low, t in path:
            tight[f, low] = (min if low else max)(t, tight.get((f, low), t))
        found[Rule(tuple(sorted((f, low, t) for (f, low), t in tight.items())))] = None
    return list(found)


def held_out(key: str, folds: int, fold: int) -> Column:
    """crc32 of the key as text, in a residue class; a null key is in none."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` and a column _f_<name> for each feature.

    The statistics leave a generator of one row: neither a rule nor a filter on the score can be rewritten
    to hold them, so a text is counted through once, whatever is done with the score.
    """
    names = list(statistics(text))
    counted = docs.select("*", F.inline_outer(F.array(F.struct(*[c.alias("_s_" + n) for n, c in statistics(text).items()]))))
    return counted.withColumns({"_f_" + n: c for n, c in features().items()}).drop(*["_s_" + n for n in names])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold, at most `max_rows` of them (the documented bound).

    Without labelled rows, or with one class only, the model is the smoothed share of label 1.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("double").alias("label"))
    known = known.filter(~held_out("_k", folds, 0) & F.col("_k").isNotNull() & F.col("label").isin(0.0, 1.0))
    known = known.orderBy(F.xxhash64("_k"), "_k", "label").limit(max_rows)
    names = list(features())
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(known), "_k")
    rows = checkpointed(with_features(rows, "_t").select("label", *["_f_" + n for n in names]))
    rows = rows.withColumn("features", array_to_vector(F.array(*["_f_" + n for n in names]))).persist()
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        import math

        ones, n = counts.get(1.0, 0), sum(counts.values())
        return Model(math.log((ones + 1) / (n - ones + 1)), ())
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, bootstrap=False, featureSubsetStrategy="onethird", minInstancesPerNode=5, maxBins=64, seed=SEED
    ).fit(rows)
    rules = tree_rules(forest.toDebugString, names)
    values = rows.select("label", array_to_vector(F.array(*[r.column("_f_") for r in rules])).alias("features")).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=100).fit(values)
    values.unpersist()
    rows.unpersist()
    return Model(lasso.intercept, tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients) if abs(w) > 1e-6))


def with_scores(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """`docs` and score (0..1), predicted (1 from `least` on); columns of these names are replaced, others stay.

    Null and empty texts have all-zero statistics and get the score of the rules that these meet.
    """
    scored = with_features(docs, text).withColumn("score", model.score("_f_")).drop(*["_f_" + n for n in features()])
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))

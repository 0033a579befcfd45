"""Macro scores, reports and fold summaries from one confusion count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import format_mean_std


def confusion(pred: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """(by..., t, p, c): the only pass over the predictions; everything after it is tiny."""
    return pred.groupBy(*by, F.col(y_true).cast("int").alias("t"), F.col(y_pred).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("c")
    )


def class_stats(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class of the union of true and predicted labels: P, R, F1, support (0 when undefined)."""
    zero = F.lit(0).cast("long")
    right = F.col("t") == F.col("p")

    def cell(cls, tp, fp, fn):
        return F.struct(cls.alias("cls"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    c = F.col("c")
    hit = F.array(cell(F.col("t"), c, zero, zero))
    miss = F.array(cell(F.col("t"), zero, zero, c), cell(F.col("p"), zero, c, zero))
    cells = conf.select(*by, F.explode(F.when(right, hit).otherwise(miss)).alias("e"))
    sums = cells.groupBy(*by, F.col("e.cls").alias("cls")).agg(
        F.sum("e.tp").alias("tp"), F.sum("e.fp").alias("fp"), F.sum("e.fn").alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(n: Column, d: Column) -> Column:
        return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))

    return sums.select(
        *by, "cls", "tp", "fp", "fn",
        ratio(tp, tp + fp).alias("P"), ratio(tp, tp + fn).alias("R"), ratio(2 * tp, 2 * tp + fp + fn).alias("F1"),
        (tp + fn).alias("support"),
    )


def macro_from_confusion(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return class_stats(conf, by).groupBy(*by).agg(
        F.avg("P").alias("P"), F.avg("R").alias("R"), F.avg("F1").alias("F1")
    )


def macro_scores(pred: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Macro precision, recall and F1 (mean of class F1s) for any number of groups in one pass."""
    return macro_from_confusion(confusion(pred, by, y_true, y_pred), by)


def classification_report(pred: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Rows per class plus accuracy, macro avg and weighted avg.

    All rows come out of one expansion of the class table, so the predictions are read once.
    """
    stats = class_stats(confusion(pred, by, y_true, y_pred), by)
    sup = F.col("support")
    rows = stats.groupBy(*by).agg(
        F.collect_list(F.struct(F.col("cls").cast("string").alias("row"), "P", "R", "F1", "support")).alias("classes"),
        F.sum("tp").alias("tp"),
        F.sum(sup).alias("n"),
        *[F.avg(m).alias("m" + m) for m in ("P", "R", "F1")],
        *[(F.sum(F.col(m) * sup) / F.sum(sup)).alias("w" + m) for m in ("P", "R", "F1")],
    )
    acc = F.col("tp") / F.col("n")

    def line(name, p, r, f1):
        return F.struct(F.lit(name).alias("row"), p.alias("P"), r.alias("R"), f1.alias("F1"), F.col("n").alias("support"))

    none = F.lit(None).cast("double")
    extra = F.array(
        line("accuracy", none, none, acc),
        line("macro avg", F.col("mP"), F.col("mR"), F.col("mF1")),
        line("weighted avg", F.col("wP"), F.col("wR"), F.col("wF1")),
    )
    return rows.select(*by, F.explode(F.concat("classes", extra)).alias("e")).select(*by, "e.*")


def cv_summary(metrics: DataFrame, by: Sequence[str] = ("family",), fold: str = "fold") -> DataFrame:
    """Mean and sample deviation of P, R and F1 over folds, and the number of folds."""
    cols = []
    for m in ("P", "R", "F1"):
        cols += [F.avg(m).alias(m + "_mean"), F.stddev_samp(m).alias(m + "_std")]
    return metrics.groupBy(*by).agg(*cols, F.count_distinct(fold).alias("n_folds"))


def cv_summary_formatted(summary: DataFrame, by: Sequence[str] = ("family",)) -> DataFrame:
    shown = [format_mean_std(F.col(m + "_mean"), F.col(m + "_std")).alias(m) for m in ("P", "R", "F1")]
    return summary.select(*by, "n_folds", *shown)


"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates r in (0, cap] with sum(r * size) = target in every source, the mix takes those
nearest to one copy of each document in relative entropy. Their dual has one multiplier per source and is
convex; its solution tilts rates exponentially, r = min(cap, exp(lambda * size / mean size)). Rates depend on
(source, size) alone, so Newton steps run over counts per (source, size), as one aggregate by source each,
kept inside a bracket. Sums are exact integers (rates in steps of 2**-20), so a rerun takes the same steps.

Rates become copies in two exact steps: every (source, size) class gets a whole number of copies by rounding
the running total over the classes of its source, a remainder against the target is settled on the
smallest sizes, and inside a class copies are spread evenly over the documents in hash order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, checkpointed
from tidemark.operators.ranking import hash_rank

#: Rates are whole multiples of 1 / ONE.
ONE = 1 << 20
#: Newton steps in one Spark job, and the most jobs; a bracket halves at worst, so 60 steps would do.
STEPS, JOBS = 4, 20
SOURCE = ["_source", "_no_source"]


def _sized(docs: DataFrame, text: str, source: str) -> DataFrame:
    count = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_size": count, "_source": F.coalesce(F.col(source), F.lit("")), "_no_source": F.col(source).isNull()})


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Targets by weight, stopped at `cap` times a source's size, the excess reshared by weight.

    `sizes`: one row per source with _size, the sum over its documents. All targets that aren't stopped
    are one level times their weight; the level follows from the sources in order of cap / weight. Both
    windows run over one row per source, after the aggregate.
    """
    by_code_point = W.orderBy("_no_source", "_source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("_sid", F.row_number().over(by_code_point))
    t = t.withColumn("_w", F.element_at(cycle, ((F.col("_sid") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_stop", F.col("_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_stop") / F.col("_w"))
    order = W.orderBy("_ratio", "_sid")
    before = F.coalesce(F.sum("_stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    t = t.withColumn("_all", F.sum("_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    t = t.withColumn("_level", (F.col("_all") - before) / rest)
    level = F.min_by(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), F.when(F.col("_level") <= F.col("_ratio"), F.col("_ratio")))
    t = t.withColumn("_found", level.over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("_stop"), F.coalesce(F.col("_found") * F.col("_w"), F.col("_stop")))
    return t.select(*SOURCE, "_sid", F.col("_size").alias("_source_size"), target.alias("_target"))


def _rate(lam, x, cap: float):
    """Whole number of steps of the tilted rate, at most cap * ONE."""
    return F.round(F.exp(F.least(F.lit(math.log(cap)), lam * x)) * ONE).cast("long")


def _newton(classes: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    c = classes.join(state.select("_sid", "_lam"), "_sid").withColumn("_q", _rate(F.col("_lam"), F.col("_x"), cap))
    words = (F.col("_n") * F.col("_size")).cast("decimal(38,0)") * F.col("_q").cast("decimal(20,0)")
    free = F.when(F.col("_lam") * F.col("_x") < math.log(cap), words * F.col("_size").cast("decimal(18,0)"))
    sums = c.groupBy("_sid").agg(F.sum(words.cast("decimal(38,0)")).alias("_got"), F.sum(free.cast("decimal(38,0)")).alias("_free"))
    t = state.join(sums, "_sid")
    gap = F.col("_got").cast("double") / ONE - F.col("_target")
    slope = F.coalesce(F.col("_free").cast("double") / ONE / F.col("_mean"), F.lit(0.0))
    t = t.withColumns({"_gap": gap, "_slope": slope})
    t = t.withColumns({"_lo": F.when(F.col("_gap") <= 0, F.col("_lam")).otherwise(F.col("_lo")), "_hi": F.when(F.col("_gap") > 0, F.col("_lam")).otherwise(F.col("_hi"))})
    step = F.when(F.col("_slope") > 0, F.col("_lam") - F.col("_gap") / F.col("_slope"))
    inside = step.isNotNull() & (step > F.col("_lo")) & (step < F.col("_hi"))
    done = F.col("_done") | (F.abs("_gap") <= F.greatest(F.lit(0.5), F.col("_target") * 1e-6)) | (F.col("_hi") - F.col("_lo") < 1e-12)
    moved = F.when(done, F.col("_lam")).when(inside, step).otherwise((F.col("_lo") + F.col("_hi")) / 2)
    return t.select("_sid", "_target", "_mean", "_lo", "_hi", moved.alias("_lam"), done.alias("_done"))


def tilts(classes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """The multiplier of every source, from the classes (source, size, count) and the targets."""
    bounds = classes.groupBy("_sid").agg(F.min("_x").alias("_least"))
    own = F.col("_source_size")
    t = sources.filter(own > 0).join(bounds, "_sid")
    state = t.select(
        "_sid",
        "_target",
        "_mean",
        F.least(F.log(F.greatest(F.col("_target"), F.lit(1e-9)) / own) / F.col("_least"), F.lit(0.0)).alias("_lo"),
        (F.lit(math.log(cap)) / F.col("_least")).alias("_hi"),
        # At its stop a source takes `cap` copies of everything.
        F.when(F.col("_target") >= own * cap, F.lit(math.log(cap)) / F.col("_least")).otherwise(0.0).alias("_lam"),
        (F.col("_target") >= own * cap).alias("_done"),
    )
    for _ in range(JOBS):
        for _ in range(STEPS):
            state = _newton(classes, state, cap)
        state = checkpointed(state)
        if not state.filter("not _done").take(1):
            break
    return state.select("_sid", "_lam")


def _class_copies(classes: DataFrame, cap: float) -> DataFrame:
    """Whole copies per class. The windows run over the distinct sizes of a source, which text lengths bound."""
    cap = int(cap)
    falling = W.partitionBy("_sid").orderBy(F.desc("_size")).rowsBetween(W.unboundedPreceding, 0)
    rising = W.partitionBy("_sid").orderBy("_size").rowsBetween(W.unboundedPreceding, -1)
    c = classes.withColumn("_run", F.sum(F.col("_n") * F.col("_q")).over(falling))
    c = c.withColumn("_copies", F.expr(f"(_run + {ONE // 2}) div {ONE} - (_run - _n * _q + {ONE // 2}) div {ONE}"))
    c = c.withColumn("_copies", F.least(F.greatest(F.col("_copies"), F.lit(0)), F.col("_n") * cap))
    c = c.withColumn("_rest", F.col("_target") - F.sum(F.col("_copies") * F.col("_size")).over(W.partitionBy("_sid")))
    c = c.withColumn("_room", F.when(F.col("_rest") > 0, F.col("_n") * cap - F.col("_copies")).otherwise(F.col("_copies")))
    used = F.coalesce(F.sum(F.col("_room") * F.col("_size")).over(rising), F.lit(0))
    more = F.floor((F.abs("_rest") - used) / F.col("_size"))
    more = F.least(F.greatest(more, F.lit(0)), F.col("_room")).cast("long")
    return c.withColumn("_copies", F.col("_copies") + F.when(F.col("_rest") > 0, more).otherwise(-more))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per document: key, source, _row columns below, and the copies that the mix takes of it.

    Columns: `key`, `source`, size, source_size, target (of the source), copies (0..cap), taken = copies * size.
    Size counts the words of a text; null and empty texts have size 0 and keep one copy. A null source is a
    source of its own, the last one. Repeated rows and ties in `key` share the copies of their class.
    """
    base = checkpointed(_sized(docs, text, source).select(F.col(key).alias("_key"), F.col(source).alias("_named"), *SOURCE, "_size"))
    counts = base.groupBy(*SOURCE, "_size").agg(F.count(F.lit(1)).alias("_n"))
    counts = checkpointed(counts)
    sizes = counts.groupBy(*SOURCE).agg(F.sum(F.col("_n") * F.col("_size")).alias("_size"), F.sum(F.when(F.col("_size") > 0, F.col("_n"))).alias("_docs"))
    sources = source_targets(sizes, weights, cap).join(sizes.select(*SOURCE, "_docs"), SOURCE)
    sources = checkpointed(sources.withColumn("_mean", F.col("_source_size") / F.col("_docs")))
    classes = counts.filter("_size > 0").join(sources, SOURCE)
    classes = checkpointed(classes.select(*SOURCE, "_sid", "_size", "_n", "_target", (F.col("_size") / F.col("_mean")).alias("_x")))
    rated = classes.join(tilts(classes, sources, cap), "_sid").withColumn("_q", _rate(F.col("_lam"), F.col("_x"), cap))
    copies = _class_copies(rated, cap).select(*SOURCE, "_size", F.col("_n").alias("_of"), "_copies")
    with_class = base.withColumn("_class", F.concat_ws(":", F.col("_no_source").cast("string"), F.col("_size").cast("string"), "_source"))
    ranked = hash_rank(with_class, ["_key"], ["mix"], within=["_class"], rank="_rank", prefix_digits=1)
    out = ranked.join(copies, [*SOURCE, "_size"], "left").join(sources.select(*SOURCE, "_source_size", "_target"), SOURCE)
    taken = F.expr("(_rank * _copies) div _of - ((_rank - 1) * _copies) div _of")
    return out.select(
        F.col("_key").alias(key),
        F.col("_named").alias(source),
        F.col("_size").alias("size"),
        F.col("_source_size").cast("long").alias("source_size"),
        F.col("_target").alias("target"),
        F.coalesce(taken, F.lit(1)).cast("int").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, all columns unchanged.

    Rows are told apart by all their values; equal rows are interchangeable and share their copies.
    """
    values = [F.md5(F.coalesce(text, F.lit(""))).alias("text") if c == text else F.col(f"`{c}`") for c in docs.columns]
    named = docs.withColumn("_row_key", F.md5(F.to_json(F.struct(*values, F.col(text).isNull().alias("_none")))))
    copies = mix(named, "_row_key", text, source, weights, cap).groupBy("_row_key").agg(F.sum("copies").alias("_copies"))
    rows = named.join(copies.filter("_copies > 0"), "_row_key").dropDuplicates(["_row_key"])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Label-dependent matching of reposted news handles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.bounds import broadcast_if_bounded

# News handles whose reposts mark a user of the given label.
NEWS_HANDLES: dict[str, tuple[str, ...]] = {
    "reliable": (
        "USATODAY", "BBC", "CNN", "Reuters", "MoonofA", "PressTV", "Independent", "AP", "VDARE", "Business",
        "BuzzFeedNews", "nytimes",
    ),
    "unreliable": (
        "ActivistPost", "infowars", "RT_com", "Antiwarcom", "Consortiumnews", "CorbettReport", "LibertyBlitz",
        "MintPressNews", "Ruptly", "RussiaInsider", "RussiaBeyond", "SputnikInt", "wikileaks", "TheRussophile",
        "HealthRanger", "YahooNews", "JoinGaia", "TheDCGazette", "ChroniclesU", "LewRockwell", "21WIRE",
        "TheBlaze", "anonews_co", "DiscloseTV",
    ),
}


def handle_table(spark, handles: Mapping[str, Sequence[str]] = NEWS_HANDLES) -> DataFrame:
    """(label, handle) with handles in lower case."""
    rows = [(label, h.lower()) for label, hs in handles.items() for h in hs]
    return spark.createDataFrame(rows, "label string, handle string").distinct()


def match_handles(
    posts: DataFrame,
    handles: DataFrame | Mapping[str, Sequence[str]],
    label: str = "label",
    mentions: str = "mentions",
    handles_max_rows: int | None = None,
) -> DataFrame:
    """A repost whose first mention is a handle of the user's label gets (handle, yes), else (nil, no).

    `mentions` is the comma-joined list or an array. Any label other than reliable is matched
    against the unreliable set. A handle dictionary is broadcast (its length is known); a handle
    table is only broadcast when `handles_max_rows` bounds it.
    """
    if isinstance(handles, Mapping):
        handles_max_rows = sum(len(v) for v in handles.values())
        handles = handle_table(posts.sparkSession, handles)
    side = broadcast_if_bounded(
        handles.select(F.col("label").alias("_l"), F.col("handle").alias("_h")).distinct(), handles_max_rows
    )
    is_array = posts.schema[mentions].dataType.typeName() == "array"
    names = F.col(mentions) if is_array else F.split(F.col(mentions), ",")
    first = F.lower(F.get(names, F.lit(0)))
    group = F.when(F.col(label) == "reliable", F.lit("reliable")).otherwise(F.lit("unreliable"))
    keyed = posts.withColumns(
        {"_first": F.when(F.col("is_retweet") & (F.length(first) > 0), first), "_group": group}
    )
    out = keyed.join(side, (F.col("_group") == F.col("_l")) & (F.col("_first") == F.col("_h")), "left")
    return out.withColumns(
        {
            "matched_handler": F.coalesce(F.col("_h"), F.lit("nil")),
            "matched_condition": F.when(F.col("_h").isNotNull(), "yes").otherwise("no"),
        }
    ).drop("_first", "_group", "_l", "_h")

"""Scalar expressions: timestamps, flags, safe numerics, ages, display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000.0

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_HAS_ZONE = r"(?i)\d(Z|UTC|\s?[+-]\d{2}:?\d{2})\s*$"
_HAS_TIME = r"\d{2}:\d{2}"
#: Digits of an epoch number in seconds, milli-, micro- and nanoseconds, and its microseconds per unit.
_EPOCHS = {10: 1e6, 13: 1e3, 16: 1.0, 19: 1e-3}


def instant(c: Column, dtype: T.DataType) -> Column:
    """A timestamp column as an instant; zone-less values are read as UTC in any session zone."""
    if isinstance(dtype, T.TimestampType):
        return c
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    if isinstance(dtype, T.NumericType):
        return parse_ts(c.cast("decimal(20,0)"))
    return parse_ts(c)


def parse_ts(c: Column) -> Column:
    """Text to UTC instant, unreadable text to null.

    ISO forms with or without a zone, also with slashes; month/day/year; `Jan 5 2024 10:00`; the feed
    form `Wed Oct 10 20:19:24 +0000 2018`; epoch numbers by their digits (10, 13, 16 or 19).
    """
    s = F.trim(c.cast("string"))
    number = s.try_cast("decimal(20,0)")
    epoch = F.lit(None).cast("timestamp")
    for digits, us in _EPOCHS.items():
        at = F.timestamp_micros((number * us if us >= 1 else F.floor(number / 1000)).cast("long"))
        epoch = F.when(F.length(s) == digits, at).otherwise(epoch)
    us_date = F.regexp_replace(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    named = F.try_to_timestamp(F.regexp_replace(s, ",", ""), F.lit("MMM d yyyy[ HH:mm[:ss]]"))
    written = s
    s = F.regexp_replace(us_date, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    zoned = s.rlike(_HAS_TIME) & s.rlike(_HAS_ZONE)
    iso = F.when(zoned, s.try_cast("timestamp")).otherwise(
        F.from_utc_timestamp(s.try_cast("timestamp"), F.current_timezone())
    )
    feed = F.try_to_timestamp(F.regexp_replace(s, r"^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
    out = F.when(s.rlike(r"^\d{4}-"), iso).when(written.rlike(r"^\d+$"), epoch)
    out = out.when(s.rlike(r"^[A-Za-z]{3} \d{1,2},? \d{4}"), F.from_utc_timestamp(named, F.current_timezone()))
    return out.when(s.rlike(r"^[A-Za-z]{3} "), feed)


def _truth(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(F.trim(c)).isin(*words)


def as_flag(c: Column, dtype: T.DataType, strict_reference: bool = False) -> Column:
    """Coerce any column to a boolean that is never null.

    Default: null and unknown words are false. `strict_reference=True` keeps the dataframe-library
    rule instead: null and every unknown non-empty word are true.
    """
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(strict_reference))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c != F.lit(0), F.lit(strict_reference))
    s = c.cast("string")
    if strict_reference:
        return F.coalesce(~s.isin("False", "false", "0", ""), F.lit(True))
    return F.coalesce(_truth(s, ("true", "1", "1.0")), F.lit(False))


def quote_flag(c: Column, dtype: T.DataType, strict_reference: bool = False) -> Column:
    """Boolean as is; numeric by non-zero; text by membership in {1, true, quoted}."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.NumericType) and not strict_reference:
        return F.coalesce(c != F.lit(0), F.lit(False))
    return F.coalesce(F.lower(c.cast("string")).isin("1", "true", "quoted"), F.lit(False))


#: Reply columns that carry a flag rather than the id of the answered post or user.
REPLY_FLAG_NAMES = ("is_reply", "replied")


def reply_flag(c: Column, dtype: T.DataType, name: str = "", strict_reference: bool = False) -> Column:
    """Boolean as is; numeric by non-zero; id text by presence; flag text by its meaning."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, T.NumericType):
        return F.coalesce(c != F.lit(0), F.lit(False))
    if name in REPLY_FLAG_NAMES and not strict_reference:
        return F.coalesce(_truth(c.cast("string"), ("true", "1", "1.0", "replied_to")), F.lit(False))
    return c.isNotNull()


def retweet_from_text(c: Column) -> Column:
    return F.coalesce(c.startswith("RT @"), F.lit(False))


def safe_div(n: Column, d: Column) -> Column:
    """Quotient as double; null when the denominator is null or zero."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def to_num(c: Column, dtype: T.DataType | None = None) -> Column:
    """Number as double; unreadable text and NaN become null."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    s = c.cast("string")
    return F.when(s.rlike(_NUMBER), F.trim(s).try_cast("double"))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(DAY_US)


def account_age_days(created: Column, now: Column) -> Column:
    """Exact fractional days (profile features)."""
    return days_between(now, created)


def account_age_years_whole(created: Column, now: Column) -> Column:
    """Whole days / 365 (crawl snapshot); null when no full day has passed."""
    whole = F.floor(days_between(now, created))
    return F.when(whole > 0, whole / F.lit(365.0))


def years_to_days(years: Column) -> Column:
    """Fallback conversion used when only an age in years is at hand."""
    return years * F.lit(365.25)


def posting_frequency(tweets: Column, created: Column, now: Column) -> Column:
    """Posts per 365-day year; null when no full day has passed."""
    return safe_div(tweets, account_age_years_whole(created, now))


def clean_token(c: Column) -> Column:
    """Sub-word piece to plain token: drop `##`, lower-case, keep [a-z0-9_]."""
    return F.regexp_replace(F.lower(F.replace(c, F.lit("##"), F.lit(""))), "[^a-z0-9_]", "")


def clean_handle(c: Column) -> Column:
    return F.regexp_replace(c, "^@+", "")


def format_mean_std(mean: Column, std: Column) -> Column:
    """`65.4% ± 0.133`; a missing standard deviation (single fold) prints as nan."""
    left = F.format_string("%.1f%%", mean * 100)
    right = F.when(std.isNull(), F.lit("nan")).otherwise(F.format_string("%.3f", std))
    return F.concat(left, F.lit(" ± "), right)


def heavy_tail(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))

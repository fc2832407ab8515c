"""Dates of postings, as Column expressions. ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postline.config import DAY

RELATIVE = r"(?i)posted\s+(today|yesterday|(\d+)\s+days?\s+ago)\s*$"
AT_LEAST = r"(?i)posted\s+(\d+)\+\s+days?\s+ago\s*$"


def iso_epoch(text: Column) -> Column:
    """Seconds of an ISO timestamp (UTC where it names no zone); null if it isn't one."""
    return F.unix_seconds(F.try_to_timestamp(text))


def utc_epoch(text: Column) -> Column:
    """Seconds of ``2026-01-31 10:00:00 UTC``, or of an ISO timestamp."""
    plain = F.regexp_replace(text, r"\s*UTC$", "")
    return F.unix_seconds(F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(plain)))


def posted_from_relative(text: Column, now: int) -> Column:
    """The time of "Posted today", "yesterday" or "N days ago"; null for anything without an exact number of days."""
    word, days = F.lower(F.regexp_extract(F.trim(text), RELATIVE, 1)), F.regexp_extract(F.trim(text), RELATIVE, 2)
    n = F.when(word == "today", 0).when(word == "yesterday", 1).otherwise(F.expr("try_cast(null as int)"))
    return F.lit(now) - F.coalesce(n.cast("bigint"), days.try_cast("bigint")) * DAY


def newest_possible(text: Column, now: int) -> Column:
    """The latest time a posting may have: exact, or the bound of "N+ days ago"."""
    return F.coalesce(posted_from_relative(text, now), F.lit(now) - F.regexp_extract(F.trim(text), AT_LEAST, 1).try_cast("bigint") * DAY)


def location_from_path(path: Column) -> Column:
    """The place in ``/job/<place>/``; null if it is a number or a single character."""
    text = F.trim(F.replace(F.regexp_extract(path, r"/job/([^/]+)/", 1), F.lit("-"), F.lit(" ")))
    return F.when((F.char_length(text) >= 2) & ~text.rlike(r"^\d+$"), text)


def day_floor(seconds: Column) -> Column:
    return seconds - F.pmod(seconds, F.lit(DAY))


def age(seconds: Column, now: int) -> Column:
    """Minutes, hours, days or months since, as a short label."""
    gap = F.greatest(F.lit(now) - seconds, F.lit(0))
    unit = lambda n, label: F.concat(F.floor(gap / n).cast("string"), F.lit(label))
    return F.when(gap < 3_600, unit(60, "m")).when(gap < DAY, unit(3_600, "h")).when(gap < 30 * DAY, unit(DAY, "d")).when(gap.isNotNull(), unit(30 * DAY, "mo"))

"""Record identity, tolerant casts and date parsing as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def stable_id(*parts) -> Column:
    """First 24 hex digits of the SHA-1 over the parts joined by a pipe; null counts as empty."""
    texts = [F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *texts).cast("binary")), 1, 24)


def tolerant_int(value) -> Column:
    """Whole part of a number written as text, null when it is not a number."""
    return F.trim(as_column(value).cast("string")).try_cast("double").try_cast("int")


def tolerant_double(value) -> Column:
    return F.trim(as_column(value).cast("string")).try_cast("double")


def zero_as_null(value) -> Column:
    return F.nullif(as_column(value), F.lit(0.0))


def in_window(day: Column, since, until, keep_undated: bool = False) -> Column:
    """Inclusive date window, open where a bound is None; undated rows pass only when asked for."""
    inside = day.isNotNull() if since is None else day >= F.lit(since).cast("date")
    if until is not None:
        inside = inside & (day <= F.lit(until).cast("date"))
    inside = F.when(day.isNotNull(), inside)
    return F.coalesce(inside, F.lit(keep_undated))


# Accepted date layouts, as (whole-text shape, part to read, Spark pattern).
DATE_LAYOUTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^(.*)$", "yyyy-M-d"),
    (r"^\d{1,2}\s+[A-Za-z]+\s+\d{4}$", r"^(.*)$", "d MMMM yyyy"),
    (r"^[A-Za-z]+\s+\d{1,2},\s+\d{4}$", r"^(.*)$", "MMMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", r"^(.*)$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", r"^(.*)$", "yyyy/M/d"),
    (
        r"^(?i:mon|tue|wed|thu|fri|sat|sun),\s+\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{1,2}:\d{1,2}\s+([+-]\d{2}:?\d{2}|Z)$",
        r",\s+(\d{1,2}\s+[A-Za-z]{3}\s+\d{4})\s",
        "d MMM yyyy",
    ),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}([+-]\d{2}:?\d{2}|Z)$", r"^([^T]*)T", "yyyy-M-d"),
)


def parse_date(text) -> Column:
    """Calendar date of a text in any accepted layout; the first layout that fits wins.

    Layouts with a clock time keep the date as written, without moving it to UTC.
    """
    raw = F.trim(as_column(text))
    tries = []
    for shape, part, pattern in DATE_LAYOUTS:
        written = F.regexp_replace(F.regexp_extract(raw, part, 1), r"\s+", " ")
        tries.append(F.when(raw.rlike(shape), F.try_to_timestamp(written, F.lit(pattern)).cast("date")))
    return F.coalesce(*tries)


def week_start(day) -> Column:
    """Monday of the week of a date."""
    return F.date_trunc("week", as_column(day)).cast("date")


def wkt_point(lon, lat) -> Column:
    """POINT text, null when either coordinate is missing."""
    return F.concat(F.lit("POINT ("), as_column(lon).cast("string"), F.lit(" "), as_column(lat).cast("string"), F.lit(")"))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)

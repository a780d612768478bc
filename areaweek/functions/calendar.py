"""Holiday arithmetic and seasonal flags as integer column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day number of 1 Muharram 1 AH, the Julian day of 1970-01-01,
# the three moon-calendar festivals (month, day) and the dated holidays (month, day).
ISLAMIC_EPOCH_DAY = 1948439
UNIX_EPOCH_DAY = 2440588
MOON_FESTIVALS = (("Eid al-Fitr", 10, 1), ("Eid al-Adha", 12, 10), ("Eid al-Mawlid", 3, 12))
DATED_HOLIDAYS = (
    ("New Year", 1, 1), ("Workers Day", 5, 1), ("Independence Day", 10, 1),
    ("Christmas", 12, 25), ("Boxing Day", 12, 26),
)
DEMOCRACY_DAY_MOVED_IN = 2019
MEAN_HIJRI_YEAR_DAYS = 354.367


def idiv(a, b) -> Column:
    """Floor division for whole numbers."""
    return F.floor(a / b).cast("int")


def easter_sunday(year: Column) -> Column:
    """Western Easter by Gauss's method with the century corrections."""
    golden = year % 19
    century = idiv(year, 100)
    skipped_leaps = idiv(century, 4)
    moon_shift = idiv(8 * century + 13, 25)
    epact_base = (15 - moon_shift + century - skipped_leaps) % 30
    weekday_base = (4 + century - skipped_leaps) % 7
    full_moon = (19 * golden + epact_base) % 30
    to_sunday = (2 * (year % 4) + 4 * (year % 7) + 6 * full_moon + weekday_base) % 7
    march_day = 22 + full_moon + to_sunday
    adjusted = (
        F.when((full_moon == 29) & (to_sunday == 6), march_day - 7)
        .when((full_moon == 28) & (to_sunday == 6) & (((11 * epact_base + 11) % 30) < 19), march_day - 7)
        .otherwise(march_day)
    )
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), (adjusted - 1).cast("int"))


def islamic_date(hijri_year: Column, month: int, day: int) -> Column:
    """Civil date of a day in the tabular Islamic calendar (30-year cycle)."""
    days_before_month = 29 * (month - 1) + month // 2
    leap_days = idiv(3 + 11 * hijri_year, 30)
    number = (hijri_year - 1) * 354 + leap_days + (days_before_month + day - 1 + ISLAMIC_EPOCH_DAY - UNIX_EPOCH_DAY)
    return F.date_add(F.lit("1970-01-01").cast("date"), number.cast("int"))


def hijri_year_near(year: Column) -> Column:
    start = F.datediff(F.make_date(year, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")) + UNIX_EPOCH_DAY
    return ((start - ISLAMIC_EPOCH_DAY) / MEAN_HIJRI_YEAR_DAYS).cast("int") + 1


def dry_season(day: Column) -> Column:
    """November to March."""
    return F.month(day).isin(11, 12, 1, 2, 3).cast("int")


def school_in_session(day: Column) -> Column:
    """0 in the fixed break windows, else 1."""
    month, dom = F.month(day), F.dayofmonth(day)
    holiday = (
        (month == 8)
        | ((month == 7) & (dom > 20))
        | ((month == 12) & (dom > 15))
        | ((month == 1) & (dom < 8))
        | ((month == 4) & (dom <= 14))
    )
    return F.when(holiday, 0).otherwise(1)

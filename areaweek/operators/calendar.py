"""Holiday table, festival flags and the weekly calendar dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal


def easter_by_year(years: DataFrame) -> DataFrame:
    return years.select("year", cal.easter_sunday(F.col("year")).alias("easter"))


def moon_festivals(years: DataFrame) -> DataFrame:
    """Festivals of the three hijri years that can touch each civil year."""
    candidates = years.select(
        "year",
        F.explode(F.sequence(cal.hijri_year_near(F.col("year")) - 1, cal.hijri_year_near(F.col("year")) + 1)).alias("hijri_year"),
    )
    entries = [
        F.struct(
            cal.islamic_date(F.col("hijri_year"), month, day).alias("holiday"),
            F.lit(name).alias("holiday_name"),
            F.lit(rank).alias("priority"),
        )
        for rank, (name, month, day) in enumerate(cal.MOON_FESTIVALS, start=20)
    ]
    return (
        candidates.select("year", "hijri_year", F.explode(F.array(*entries)).alias("e"))
        .select("year", "e.holiday", "e.holiday_name", (F.col("e.priority") + 100 * F.col("hijri_year")).alias("priority"))
        .where(F.year("holiday") == F.col("year"))
    )


def holiday_table(years: DataFrame) -> DataFrame:
    """(year, holiday, holiday_name): one name per date, the later rule wins."""
    y = F.col("year")
    easter = cal.easter_sunday(y)
    democracy = F.when(y >= cal.DEMOCRACY_DAY_MOVED_IN, F.make_date(y, F.lit(6), F.lit(12))).otherwise(
        F.make_date(y, F.lit(5), F.lit(29))
    )
    dated = [(name, F.make_date(y, F.lit(m), F.lit(d))) for name, m, d in cal.DATED_HOLIDAYS]
    fixed = [*dated, ("Good Friday", F.date_sub(easter, 2)), ("Easter Monday", F.date_add(easter, 1)), ("Democracy Day", democracy)]
    civil = years.select(
        "year",
        F.explode(
            F.array(
                *[
                    F.struct(day.alias("holiday"), F.lit(name).alias("holiday_name"), F.lit(rank).alias("priority"))
                    for rank, (name, day) in enumerate(fixed)
                ]
            )
        ).alias("e"),
    ).select("year", "e.*")
    return (
        civil.unionByName(moon_festivals(years))
        .groupBy("year", "holiday")
        .agg(F.max_by("holiday_name", "priority").alias("holiday_name"))
    )


def years_of(dates: DataFrame, column: str, margin: int = 1) -> DataFrame:
    """Every civil year from the first to the last date, with a margin."""
    return dates.agg(F.min(F.year(column)).alias("a"), F.max(F.year(column)).alias("b")).select(
        F.explode(F.sequence(F.col("a") - margin, F.col("b") + margin)).alias("year")
    )


def festival_flags(days: DataFrame, holidays: DataFrame, column: str = "week_start", horizon_days: int = 7) -> DataFrame:
    """Flag and first festival inside [day - 1, day + horizon + 1].

    Each holiday is fanned out to the few days it covers, so the lookup is an
    equi-join on the day.
    """
    covered = holidays.select(
        F.explode(F.sequence(F.date_sub("holiday", horizon_days + 1), F.date_add("holiday", 1))).alias(column),
        "holiday",
        "holiday_name",
    ).groupBy(column).agg(F.min_by("holiday_name", F.struct("holiday", "holiday_name")).alias("cal_festival_name"))
    return days.join(covered, column, "left").withColumn(
        "cal_festival_within_horizon", F.col("cal_festival_name").isNotNull().cast("int")
    )


def calendar_dimension(weeks: DataFrame, horizon_days: int = 7) -> DataFrame:
    """One row per week with every calendar signal; sized by the week range only."""
    day = F.col("week_start")
    holidays = holiday_table(years_of(weeks, "week_start"))
    return festival_flags(weeks.select("week_start"), holidays, "week_start", horizon_days).select(
        "week_start",
        "cal_festival_within_horizon",
        "cal_festival_name",
        cal.dry_season(day).alias("cal_dry_season"),
        cal.school_in_session(day).alias("cal_school_in_session"),
        F.weekofyear(day).alias("cal_week_of_year"),
        F.month(day).alias("cal_month"),
    )

"""Holiday calendar and day classes."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Colombian public holidays (Law 51 of 1983).
FIXED_DAYS = ((1, 1), (5, 1), (7, 20), (8, 7), (12, 8), (12, 25))
MOVED_TO_MONDAY = ((1, 6), (3, 19), (6, 29), (8, 15), (10, 12), (11, 1), (11, 11))
EASTER_OFFSETS = (-3, -2, 43, 64, 71)

# Day classes, parts of the day and their hours.
WEEKDAY, SATURDAY, SUNDAY = "LABORAL", "SABADO", "DOMINGO"
HOLIDAY, MONDAY_HOLIDAY = "FESTIVO", "FESTIVO_PUENTE"
DAY_TYPES = (WEEKDAY, SATURDAY, SUNDAY, HOLIDAY, MONDAY_HOLIDAY)
RARE_DAY_TYPES = (HOLIDAY, MONDAY_HOLIDAY)
DAY_PARTS = {
    "MADRUGADA": (0, 5),
    "MANANA": (6, 11),
    "MEDIODIA": (12, 13),
    "TARDE": (14, 18),
    "NOCHE": (19, 23),
}


def easter(year: int) -> date:
    """Easter Sunday: first Sunday after the paschal full moon (Butcher, 1876)."""
    golden = year % 19
    century, rest = divmod(year, 100)
    moon = (19 * golden + century - century // 4
            - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    to_sunday = (32 + 2 * (century % 4) + 2 * (rest // 4) - moon - rest % 4) % 7
    shift = (golden + 11 * moon + 22 * to_sunday) // 451
    month, day = divmod(moon + to_sunday - 7 * shift + 114, 31)
    return date(year, month, day + 1)


def holidays(first_year: int, last_year: int) -> list[date]:
    days: set[date] = set()
    for year in range(first_year, last_year + 1):
        days |= {date(year, m, d) for m, d in FIXED_DAYS}
        for m, d in MOVED_TO_MONDAY:
            day = date(year, m, d)
            days.add(day + timedelta(days=-day.weekday() % 7))
        days |= {easter(year) + timedelta(days=k) for k in EASTER_OFFSETS}
    return sorted(days)


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """At most 18 rows per year, so it stays small for any data volume."""
    schema = T.StructType([T.StructField("holiday_date", T.DateType(), False)])
    return spark.createDataFrame([(d,) for d in holidays(first_year, last_year)], schema)


def easter_day(year: Column) -> Column:
    """Easter Sunday of each year, by the same rule as ``easter``."""
    def div(x: Column, n: int) -> Column:
        return F.floor(x / F.lit(n))

    golden, century, rest = year % 19, div(year, 100), year % 100
    moon = (19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    to_sunday = (32 + 2 * (century % 4) + 2 * div(rest, 4) - moon - rest % 4) % 7
    number = moon + to_sunday - 7 * div(golden + 11 * moon + 22 * to_sunday, 451) + 114
    return F.make_date(year, div(number, 31).cast("int"), (number % 31 + 1).cast("int"))


def is_holiday(day: Column) -> Column:
    """Whether a date of any year is a public holiday, worked out from the date: no join and no range of years."""
    year = F.year(day)
    fixed = F.lit(False)
    for m, d in FIXED_DAYS:
        fixed = fixed | ((F.month(day) == m) & (F.dayofmonth(day) == d))
    moved = F.lit(False)
    for m, d in MOVED_TO_MONDAY:
        moved = moved | F.datediff(day, F.make_date(year, F.lit(m), F.lit(d))).between(0, 6)
    since = F.datediff(day, easter_day(year))
    return F.coalesce(fixed | (moved & (F.weekday(day) == 0)) | since.isin(*EASTER_OFFSETS), F.lit(False))


def day_type(weekday: Column, holiday: Column) -> Column:
    """First match wins; weekday counts from Monday = 0."""
    return (
        F.when(holiday & (weekday == 0), MONDAY_HOLIDAY)
        .when(holiday, HOLIDAY)
        .when(weekday == 5, SATURDAY)
        .when(weekday == 6, SUNDAY)
        .otherwise(WEEKDAY)
    )


def day_part(hour: Column) -> Column:
    result = F
    for name, (low, high) in DAY_PARTS.items():
        result = result.when(hour.between(low, high), name)
    return result.otherwise("NOCHE")


def regime(day_type_col: Column, other: str = "otro") -> Column:
    """Fixed values: ``ordinario`` for plain days, ``raro`` for holidays."""
    return (
        F.when(day_type_col.isin(WEEKDAY, SATURDAY, SUNDAY), "ordinario")
        .when(day_type_col.isin(*RARE_DAY_TYPES), "raro")
        .otherwise(other)
    )

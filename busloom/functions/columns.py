"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean Earth radius in metres, clock pattern, texts read as missing.
EARTH_RADIUS_M = 6371000.0
CLOCK_PATTERN = r"(\d{2}:\d{2}:\d{2})"
BLANK_TEXTS = ("", "nan", "none", "null")

MINUTES_PER_DAY = 24 * 60


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(1e6)


def minutes_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(6e7)


def plus_minutes(ts: str | Column, minutes: str | Column | int) -> Column:
    mins = F.lit(minutes) if isinstance(minutes, int) else col(minutes)
    return col(ts) + F.make_dt_interval(F.lit(0), F.lit(0), mins.cast("int"))


def day_of(ts: str | Column) -> Column:
    return F.to_date(col(ts))


def midnight(ts: str | Column) -> Column:
    return day_of(ts).cast("timestamp_ntz")


def minute_of_day(ts: str | Column) -> Column:
    return F.hour(col(ts)) * 60 + F.minute(col(ts))


def hour_fraction(ts: str | Column) -> Column:
    return F.hour(col(ts)) + F.minute(col(ts)) / F.lit(60.0)


def floor_to_minutes(ts: str | Column, width: str | Column | int) -> Column:
    """Start of the ``width``-minute slot of the day that holds ``ts``."""
    w = F.lit(width) if isinstance(width, int) else col(width)
    m = minute_of_day(ts)
    return plus_minutes(midnight(ts), (m - m % w))


def service_day(ts: str | Column, start_hour: int = 4) -> Column:
    """Calendar day of the service day that starts at ``start_hour``."""
    return F.to_date(plus_minutes(ts, -60 * start_hour))


def time_label(ts: str | Column) -> Column:
    return F.format_string("%02d:%02d", F.hour(col(ts)), F.minute(col(ts)))


def month_start(ts: str | Column) -> Column:
    return F.trunc(day_of(ts), "MONTH")


def week_start(ts: str | Column) -> Column:
    """Monday of the week."""
    return F.trunc(day_of(ts), "WEEK")


def is_blank(text: str | Column) -> Column:
    c = col(text)
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*BLANK_TEXTS)


def true_or_false(cond: Column) -> Column:
    """A condition with null read as false."""
    return F.coalesce(cond, F.lit(False))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def share(cond: Column) -> Column:
    """Share of rows where the condition holds, null counting as not."""
    return F.avg(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``scale * num / den``, null where the denominator is null or zero."""
    return F.when(den != 0, F.lit(scale) * num / den)


def percent(num: Column, den: Column) -> Column:
    return ratio(num, den, 100.0)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_dp = F.radians(col(lat2) - col(lat1)) / 2
    half_dl = F.radians(col(lon2) - col(lon1)) / 2
    chord = F.pow(F.sin(half_dp), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_dl), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def struct_of(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def unpivot_counts(row: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    """Turn one wide row of measures into (key, value) rows."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names
    ])
    return row.select(F.inline(pairs))

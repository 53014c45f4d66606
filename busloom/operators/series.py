"""Demand series: time bins, gap-free grid, calendar and service-hours context."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.calendar import day_part, day_type, is_holiday
from busloom.functions.columns import (
    count_if,
    floor_to_minutes,
    minute_of_day,
    percent,
    plus_minutes,
    require_columns,
)

# Bin widths in minutes, minimum span in days, gap classes.
GRANULARITIES = (15, 30, 60)
MIN_SPAN_DAYS = 30
OPERATING, ODD_GAP, OUT_OF_SERVICE = "operativo", "gap_anomalo", "fuera_operacion"

MEASURES = ("passengers_sum", "trips", "passengers_mean", "passengers_p95")
SERIES = ("route_id", "gran_min")


def fine_counts(trips: DataFrame, width: int, *, route: str | None = "route_id", ts: str = "actual_start", passengers: str = "boardings",
                key: str = "trip_id", by: dict[str, Column] | None = None) -> DataFrame:
    """Trips counted per (route, bin of ``width`` minutes, passengers): what all wider bins, exact percentiles included, follow from.

    ``by`` adds further columns to count by.
    """
    require_columns(trips, [ts, passengers, key])
    rows = trips.filter(F.col(ts).isNotNull() & F.col(passengers).isNotNull())
    if route is not None:
        rows = rows.filter(F.col(route).isNotNull())
    route_col = F.col(route) if route is not None else F.lit(None).cast("string")
    return rows.groupBy(
        route_col.alias("route_id"), floor_to_minutes(ts, width).alias("_fine"),
        F.col(passengers).alias("_pax"), *(c.alias(n) for n, c in (by or {}).items()),
    ).agg(F.count(F.lit(1)).alias("_n"), F.count(key).alias("_keys"))


def bins_of(fine: DataFrame, granularities: Sequence[int] = GRANULARITIES) -> DataFrame:
    """Sum, trip count, mean and exact p95 per (route, width, bin), from ``fine_counts`` of a common divisor of the widths."""
    widths = F.explode(F.array(*[F.lit(g) for g in granularities]))
    wide = fine.withColumn("gran_min", widths).withColumn("timestamp", floor_to_minutes("_fine", "gran_min"))
    return wide.groupBy("route_id", "gran_min", "timestamp").agg(
        F.sum(F.col("_pax") * F.col("_n")).cast("double").alias("passengers_sum"),
        F.sum("_keys").alias("trips"),
        (F.sum(F.col("_pax") * F.col("_n")) / F.sum("_n")).cast("double").alias("passengers_mean"),
        F.percentile("_pax", 0.95, F.col("_n")).alias("passengers_p95"),
    )


def demand_bins(
    trips: DataFrame,
    granularities: Sequence[int] = GRANULARITIES,
    *,
    route: str | None = "route_id",
    ts: str = "actual_start",
    passengers: str = "boardings",
    key: str = "trip_id",
) -> DataFrame:
    """Sum, trip count, mean and exact p95 per (route, width, bin).

    All widths come from one pass: trips are first counted per (route, finest bin,
    passengers), which collapses a hot route before the shuffle and keeps few rows per
    bin; only these counts are then copied to each width.  ``route=None`` puts all
    routes in one series with a null route.
    """
    return bins_of(fine_counts(trips, gcd(*granularities), route=route, ts=ts, passengers=passengers, key=key), granularities)


def complete_grid(bins: DataFrame) -> DataFrame:
    """Every slot from the first to the last bin of each series; ``is_gap`` where none was."""
    spans = bins.groupBy(*SERIES).agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.col("gran_min").cast("int"))
    slots = spans.select(*SERIES, F.explode(F.sequence("_first", "_last", step)).alias("timestamp"))
    marked = bins.withColumn("_seen", F.lit(True))
    same = (
        slots["route_id"].eqNullSafe(marked["route_id"])
        & (slots["gran_min"] == marked["gran_min"]) & (slots["timestamp"] == marked["timestamp"])
    )
    return slots.join(marked, same, "left").select(
        slots["route_id"], slots["gran_min"], slots["timestamp"], *MEASURES,
        F.col("_seen").isNull().alias("is_gap"))


def fill_gaps(grid: DataFrame, how: str = "mark") -> DataFrame:
    """``zero``, ``ffill`` or ``mark`` (leave null).

    The forward fill walks one series of slots, whose length is set by the time span and
    not by the number of trips.
    """
    if how == "mark":
        return grid
    if how == "zero":
        return grid.fillna(0, subset=list(MEASURES))
    if how == "ffill":
        past = Window.partitionBy(*SERIES).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
        return grid.withColumns({m: F.last(m, ignorenulls=True).over(past) for m in MEASURES})
    raise ValueError(f"unknown gap filling: {how}")


def add_calendar(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    c = F.col(ts)
    out = df.withColumns({
        "hour": F.hour(c), "weekday": F.weekday(c), "month": F.month(c),
        "iso_week": F.weekofyear(c), "quarter": F.quarter(c),
        "is_holiday": is_holiday(F.to_date(c)),
    })
    return out.withColumns({
        "is_weekend": F.col("weekday") >= 5,
        "day_part": day_part(F.col("hour")),
        "day_type": day_type(F.col("weekday"), F.col("is_holiday")),
    })


def add_service_hours(series: DataFrame, hours: DataFrame) -> DataFrame:
    """In-hours flag and gap class.

    ``hours`` has one row per (route, width, day type); series that have no usable row
    there have no in-hours slot.
    """
    usable = hours.filter(F.col("start_min") >= 0).select(*SERIES, "day_type", "start_min", "end_min")
    minute = minute_of_day("timestamp")
    inside = F.coalesce(minute.between(F.col("start_min"), F.col("end_min")), F.lit(False))
    return (
        series.join(usable, [*SERIES, "day_type"], "left")
        .withColumn("in_hours", inside)
        .withColumn("gap_type", F.when(~F.col("is_gap"), OPERATING)
                    .when(F.col("in_hours"), ODD_GAP).otherwise(OUT_OF_SERVICE))
        .drop("start_min", "end_min")
    )


def calendar_series(trips: DataFrame, granularities: Sequence[int] = GRANULARITIES, *,
                    fill: str = "mark", **bin_options) -> DataFrame:
    """Bins, grid, gap filling and calendar in one plan."""
    return series_of(demand_bins(trips, granularities, **bin_options), fill)


def series_of(bins: DataFrame, fill: str = "mark") -> DataFrame:
    """Grid, gap filling and calendar of bins that are there already."""
    return add_calendar(fill_gaps(complete_grid(bins), fill))


def validate_series(series: DataFrame, min_span_days: int = MIN_SPAN_DAYS) -> DataFrame:
    """One row per series: jumps, gaps, negatives, nulls, span, and whether it is valid."""
    before = F.lag("timestamp").over(Window.partitionBy(*SERIES).orderBy("timestamp"))
    checked = series.withColumn("_jump", plus_minutes(before, "gran_min") < F.col("timestamp"))
    negative = sum((count_if(F.col(m) < 0) for m in MEASURES), F.lit(0))
    nulls = sum((count_if(F.col(m).isNull()) for m in MEASURES), F.lit(0))
    out = checked.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        count_if(F.col("_jump")).alias("jumps"),
        count_if(F.col("is_gap")).alias("gaps"),
        negative.alias("negatives"),
        nulls.alias("nulls"),
        sum(((count_if(F.col(m) < 0) > 0).cast("int") for m in MEASURES), F.lit(0)).alias("_bad_measures"),
        sum(((count_if(F.col(m).isNull()) > 0).cast("int") for m in MEASURES), F.lit(0)).alias("_null_measures"),
    )
    span = F.floor(F.timestamp_diff("SECOND", F.col("first_ts"), F.col("last_ts")) / 86400) + 1
    out = out.withColumn("span_days", span).withColumn("span_ok", F.col("span_days") >= min_span_days)
    return out.withColumns({
        "errors": F.col("_bad_measures") + (~F.col("span_ok")).cast("int"),
        "warnings": F.col("_null_measures") + (F.col("jumps") > 0).cast("int"),
    }).withColumn("is_valid", F.col("errors") == 0).drop("_bad_measures", "_null_measures")


def run_summary(series: DataFrame, min_span_days: int = MIN_SPAN_DAYS) -> DataFrame:
    totals = series.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("slots"),
        count_if(F.col("is_gap")).alias("gap_slots"),
        F.coalesce(F.sum("passengers_sum"), F.lit(0.0)).alias("passengers"),
    )
    checks = validate_series(series, min_span_days).select(*SERIES, "is_valid")
    return (
        totals.withColumn("gap_pct", percent(F.col("gap_slots"), F.col("slots")))
        .join(checks, list(SERIES))
    )

"""Service KPIs: headway regularity, load, productivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.calendar import WEEKDAY, day_type, is_holiday
from busloom.functions.columns import (
    minutes_between,
    percent,
    ratio,
    share,
    time_label,
    week_start,
)
from busloom.functions.ordered import with_neighbour
from busloom.functions.stats import exact_percentiles
from busloom.operators.diagnostics import share_within

# Hours and headways looked at, limits of bunching and long waits,
# hour bands, regularity limits, vehicle capacity, load limits, seats.
SERVICE_HOURS = (4, 19)
HEADWAY_RANGE = (0.1, 120)
BUNCHING_MIN = 3
LONG_WAIT_MIN = 30
HOUR_BANDS = (
    (4, 9, "PICO_MANANA"),
    (9, 12, "MEDIODIA"),
    (12, 15, "PICO_TARDE"),
    (15, 19, "TARDE_VALLE"),
)
NO_BAND = "SIN_FRANJA"
REGULAR_CV, MODERATE_CV = 0.37, 0.68
CAPACITY = 80
OVERLOAD, UNDERLOAD = 0.85, 0.40
SEATS = 28
WEEKS_PER_MONTH = 4.33

ALL = "*"


def hour_band(hour: Column) -> Column:
    """Left-open bands, so the first hour of service lies in none."""
    result = F
    for low, high, name in HOUR_BANDS:
        result = result.when((hour > low) & (hour <= high), name)
    return result.otherwise(NO_BAND)


def all_headways(ready: DataFrame, keys: Sequence[str] = ("route_id", "service_date")) -> DataFrame:
    """Minutes since the previous start of the same route and day; null for the first."""
    known = ready.filter(F.col("actual_start").isNotNull() & F.col("route_id").isNotNull())
    out = with_neighbour(known, list(keys), "actual_start", "trip_id", {"_previous": "actual_start"})
    return out.withColumn("headway_min", minutes_between("_previous", "actual_start")).drop("_previous")


def headways(ready: DataFrame, *, hours: tuple[int, int] = SERVICE_HOURS,
             holidays: bool = False) -> DataFrame:
    """Plausible headways in service hours.

    Day types come from the weekday alone unless ``holidays`` asks for the calendar.
    """
    in_hours = ready.filter(F.col("start_hour").between(*hours)).select(
        "trip_id", "route_id", "service_date", "actual_start", "start_hour", "weekday")
    holiday = is_holiday(F.col("service_date")) if holidays else F.lit(False)
    return all_headways(in_hours).filter(F.col("headway_min").between(*HEADWAY_RANGE)).withColumns({
        "day_type": day_type(F.col("weekday"), holiday),
        "hour_band": hour_band(F.col("start_hour")),
    })


def headway_stats(rows: DataFrame) -> DataFrame:
    """Statistics by route, by route x band x day type and by route x hour x day type.

    All three levels are one pass; unused keys hold ``*`` (hour -1).  Percentiles are
    exact and never gather a route in one task.
    """
    def level(name: str, band: Column, day: Column, hour: Column) -> Column:
        return F.struct(F.lit(name).alias("level"), band.alias("band"), day.alias("day"), hour.alias("hour"))

    star, none = F.lit(ALL), F.lit(-1)
    levels = F.array(
        level("route", star, star, none),
        level("band", F.col("hour_band"), F.col("day_type"), none),
        level("hour", star, F.col("day_type"), F.col("start_hour")),
    )
    long = rows.select("route_id", "headway_min", F.inline(levels))
    keys = ["level", "route_id", "band", "day", "hour"]
    h = F.col("headway_min")
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(h).alias("mean"), F.stddev_samp(h).alias("std"),
        (100 * share(h < BUNCHING_MIN)).alias("bunching_pct"),
        (100 * share(h > LONG_WAIT_MIN)).alias("long_wait_pct"),
    ).withColumn("cv", ratio(F.col("std"), F.col("mean")))
    return base.join(exact_percentiles(long, keys, "headway_min", {"p50": 0.5, "p95": 0.95}), keys)


def regularity(cv: Column) -> Column:
    """REGULAR / MODERADO / IRREGULAR."""
    return F.when(cv > MODERATE_CV, "IRREGULAR").when(cv > REGULAR_CV, "MODERADO").when(cv.isNotNull(), "REGULAR")


# ---------------------------------------------------------------- load

def load_factors(series: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Load of in-hours bins that had trips."""
    factor = F.col("load_factor")
    return (
        series.filter(F.col("in_hours") & ~F.col("is_gap") & (F.col("trips") > 0))
        .withColumn("capacity", F.col("trips") * capacity)
        .withColumn("load_factor", F.col("passengers_sum") / F.col("capacity"))
        .withColumns({
            "load_state": F.when(factor > OVERLOAD, "SOBRECARGA").when(factor < UNDERLOAD, "SUBCARGA").otherwise("OPTIMO"),
            "mismatch": F.abs(F.col("passengers_sum") - F.col("capacity")),
        })
    )


def load_stats(loads: DataFrame) -> DataFrame:
    """By route, and by route x part of day x day type (``*`` where not grouped)."""
    star = F.lit(ALL)
    levels = F.array(
        F.struct(star.alias("part"), star.alias("day")),
        F.struct(F.col("day_part").alias("part"), F.col("day_type").alias("day")))
    f = F.col("load_factor")
    return loads.select("route_id", "load_factor", "mismatch", F.inline(levels)).groupBy("route_id", "part", "day").agg(
        F.count(F.lit(1)).alias("n"), F.avg(f).alias("mean"),
        F.median(f).alias("p50"), F.percentile(f, 0.95).alias("p95"),
        (100 * share(f > OVERLOAD)).alias("over_pct"), (100 * share(f < UNDERLOAD)).alias("under_pct"),
        (100 * share(f.between(UNDERLOAD, OVERLOAD))).alias("optimal_pct"), F.avg("mismatch").alias("mismatch_mean"))


def load_distribution(loads: DataFrame) -> DataFrame:
    counts = loads.groupBy("route_id", "load_state").agg(F.count(F.lit(1)).alias("n"))
    return share_within(counts, ["route_id"])


def supply_demand_dissimilarity(series: DataFrame) -> DataFrame:
    """Half the summed difference of trip and passenger shares over weekday slots in hours."""
    profile = (
        series.filter(F.col("in_hours") & (F.col("day_type") == WEEKDAY))
        .groupBy("route_id", time_label("timestamp").alias("slot"))
        .agg(F.avg(F.coalesce("trips", F.lit(0))).alias("supply"),
             F.avg(F.coalesce("passengers_sum", F.lit(0.0))).alias("demand"))
    )
    route = Window.partitionBy("route_id")
    gap = F.abs(F.col("supply") / F.sum("supply").over(route) - F.col("demand") / F.sum("demand").over(route))
    return profile.withColumn("_gap", gap).groupBy("route_id").agg(
        (F.sum("_gap") / 2).alias("dissimilarity"), (F.sum("_gap") * 50).alias("relocate_pct"),
        F.avg("_gap").alias("mean_abs_diff"), F.count(F.lit(1)).alias("slots"))


# ---------------------------------------------------------------- productivity

def weekly_productivity(ready: DataFrame, passengers: str = "boardings") -> DataFrame:
    """Passengers per trip by route and Monday week; border weeks marked incomplete."""
    weekly = (
        ready.filter(F.col(passengers).isNotNull() & F.col("route_id").isNotNull())
        .groupBy("route_id", week_start("service_date").alias("week"))
        .agg(F.sum(passengers).alias("passengers"), F.count(F.lit(1)).alias("trips"))
        .withColumn("productivity", F.col("passengers") / F.col("trips"))
    )
    route = Window.partitionBy("route_id")
    border = (F.col("week") == F.min("week").over(route)) | (F.col("week") == F.max("week").over(route))
    return weekly.withColumn("is_complete", ~(border & (F.count(F.lit(1)).over(route) > 2)))


def detrended_productivity(weekly: DataFrame) -> DataFrame:
    """Complete weeks with their linear trend, and productivity with the trend taken out."""
    route = Window.partitionBy("route_id")
    full = weekly.filter("is_complete").withColumn(
        "t", F.row_number().over(route.orderBy("week")) - 1)
    fit = full.groupBy("route_id").agg(
        F.regr_slope("productivity", "t").alias("slope"),
        F.regr_intercept("productivity", "t").alias("intercept"),
        F.avg("productivity").alias("_mean"))
    return (
        full.join(fit, "route_id")
        .withColumn("trend", F.col("intercept") + F.col("slope") * F.col("t"))
        .withColumn("adjusted", F.col("productivity") - F.col("trend") + F.col("_mean"))
        .drop("_mean")
    )


def productivity_summary(detrended: DataFrame) -> DataFrame:
    first, last = F.min_by("trend", "week"), F.max_by("trend", "week")
    return detrended.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("weeks"), F.avg("productivity").alias("mean"),
        F.median("productivity").alias("p50"), F.stddev_samp("productivity").alias("std"),
        F.max("slope").alias("slope_week"), (F.max("slope") * WEEKS_PER_MONTH).alias("slope_month"),
        first.alias("first_fitted"), last.alias("last_fitted"), (first - last).alias("fall"))


def seat_turnover(ready: DataFrame, raw: DataFrame, passengers: str = "boardings", seats: int = SEATS) -> DataFrame:
    """Boardings per seat, and how many of the raw trips were kept."""
    raw_rows = raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ready.agg(
        F.count(F.lit(1)).alias("trips"), F.sum(passengers).alias("passengers"),
        (F.avg(passengers) / seats).alias("seat_turnover"), F.avg("duration_min").alias("duration_mean"),
    ).withColumn("retention_pct", percent(F.col("trips"), raw_rows))


def recoverable_demand(recommended: DataFrame, productivity: DataFrame) -> DataFrame:
    """(recommended - actual trips) x passengers per trip, per row of recommendations."""
    return recommended.join(productivity.select("route_id", "productivity"), "route_id").withColumn(
        "recoverable", (F.col("recommended_trips") - F.col("trips")) * F.col("productivity"))


def kpi_table(headway: DataFrame, productivity: DataFrame | None = None, fleet: DataFrame | None = None,
              months: DataFrame | None = None) -> DataFrame:
    """Consolidated (section, indicator, route, value); parts not given are left out."""
    def long(df: DataFrame, section: str, names: Sequence[str], route: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), route.cast("string").alias("route_id"), F.inline(F.array(*[
            F.struct(F.lit(n).alias("indicator"), F.col(n).cast("double").alias("value")) for n in names])))

    by_route, overall = F.col("route_id"), F.lit(None)
    out = long(headway.filter(F.col("level") == "route"), "headway",
               ("mean", "std", "cv", "p95", "bunching_pct", "long_wait_pct"), by_route)
    if months is not None:
        out = out.unionByName(months.select(
            F.lit("fleet_change").alias("section"), overall.cast("string").alias("route_id"), "indicator",
            F.col("change_pct").alias("value")))
    if productivity is not None:
        out = out.unionByName(long(productivity, "productivity", ("mean", "std", "slope_month"), by_route))
    if fleet is not None:
        out = out.unionByName(long(fleet, "availability", (
            "days", "empty_pct_morning", "empty_pct_afternoon", "empty_pct_closing",
            "long_pct_morning", "long_pct_other"), overall))
    return out



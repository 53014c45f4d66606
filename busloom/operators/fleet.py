"""Vehicles: yard availability, rotation, fleet size over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.columns import (
    count_if,
    hour_fraction,
    minutes_between,
    month_start,
    percent,
    plus_minutes,
    share,
    unpivot_counts,
)
from busloom.functions.ordered import with_neighbour
from busloom.operators.service import all_headways

# States, bands in hours, limits in minutes, sampling of a day.
ON_ROUTE, IN_YARD = "EN_RUTA", "EN_PATIO"
BANDS = {"morning": (5, 9), "afternoon": (14, 16), "closing": (16.5, 17.5)}
LONG_HEADWAY_MIN = 15.0
CHECKED_HEADWAY_MIN = 20.0
TICK_MIN = 5
FIRST_TICK_HOUR, LAST_TICK_HOUR = 4, 20
TICKS = (LAST_TICK_HOUR - FIRST_TICK_HOUR) * 60 // TICK_MIN + 1
MIN_TRIPS_PER_DAY = 150
RETIRED_MONTHS = 2
DAYS_PER_MONTH = 30.44


def next_trips(ready: DataFrame) -> DataFrame:
    """Each trip with the next start and route of its vehicle on the same day."""
    known = ready.filter(F.col("vehicle_id").isNotNull())
    return with_neighbour(known, ["vehicle_id", "service_date"], "actual_start", "trip_id",
                          {"next_start": "actual_start", "next_route": "route_id"}, following=True)


def vehicle_timeline(ready: DataFrame) -> DataFrame:
    """Intervals on the route and in the yard; empty or negative ones are dropped."""
    def interval(state: str, start: str, end: str) -> Column:
        return F.struct(F.lit(state).alias("state"), F.col(start).alias("start_ts"), F.col(end).alias("end_ts"))

    return (
        next_trips(ready)
        .select("vehicle_id", "service_date", F.inline(F.array(
            interval(ON_ROUTE, "actual_start", "final_end"), interval(IN_YARD, "final_end", "next_start"))))
        .filter(F.col("start_ts") < F.col("end_ts"))
    )


def _tick(ts: str, day: str = "service_date") -> Column:
    """Number of the first tick at or after ``ts``, counted from the first of the day."""
    opening = plus_minutes(F.col(day).cast("timestamp_ntz"), 60 * FIRST_TICK_HOUR)
    return F.ceil(F.timestamp_diff("MICROSECOND", opening, F.col(ts)) / F.lit(TICK_MIN * 6e7))


def _tick_ts(tick: Column) -> Column:
    return plus_minutes(F.col("service_date").cast("timestamp_ntz"), (tick * TICK_MIN + 60 * FIRST_TICK_HOUR))


def yard_occupancy(timeline: DataFrame, days: DataFrame) -> DataFrame:
    """Vehicles in the yard at each tick of the given days; an interval holds its start,
    not its end.

    An interval adds one at its first tick and takes one off after its last; the sums of
    these steps are tiny (ticks per day) before they are accumulated.
    """
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(TICKS))
    spans = timeline.filter(F.col("state") == IN_YARD).select(
        "service_date", clamp(_tick("start_ts")).alias("_from"), clamp(_tick("end_ts")).alias("_to"))
    steps = spans.filter("_from < _to").select("service_date", F.inline(F.array(
        F.struct(F.col("_from").alias("tick"), F.lit(1).alias("_step")),
        F.struct(F.col("_to").alias("tick"), F.lit(-1).alias("_step")))))
    steps = steps.groupBy("service_date", "tick").agg(F.sum("_step").alias("_step"))
    grid = days.select("service_date").distinct().select(
        "service_date", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TICKS - 1).cast("long"))).alias("tick"))
    so_far = Window.partitionBy("service_date").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.join(steps, ["service_date", "tick"], "left")
        .withColumn("in_yard", F.sum(F.coalesce("_step", F.lit(0))).over(so_far))
        .select("service_date", "tick", _tick_ts(F.col("tick")).alias("tick_ts"), "in_yard")
    )


def _in(hour: Column, band: tuple[float, float]) -> Column:
    return (hour >= band[0]) & (hour < band[1])


def band_availability(occupancy: DataFrame) -> DataFrame:
    """Mean vehicles and share of empty ticks per band and day."""
    hour = hour_fraction("tick_ts")
    aggs = []
    for name, band in BANDS.items():
        inside = _in(hour, band)
        aggs.append(F.avg(F.when(inside, F.col("in_yard"))).alias(f"available_{name}"))
        aggs.append((100 * F.avg(F.when(inside, (F.col("in_yard") == 0).cast("int")))).alias(f"empty_pct_{name}"))
    return occupancy.groupBy("service_date").agg(*aggs)


def long_headways_by_band(ready: DataFrame) -> DataFrame:
    """Long headways per day and band, all hours, measured within each route."""
    rows = all_headways(ready.select("trip_id", "route_id", "service_date", "actual_start"))
    hour = hour_fraction("actual_start")
    is_long = F.col("headway_min") > LONG_HEADWAY_MIN
    in_any = F.lit(False)
    aggs = []
    for name, band in BANDS.items():
        in_any = in_any | _in(hour, band)
        aggs.append(count_if(is_long & _in(hour, band)).alias(f"long_{name}"))
    aggs.append(count_if(is_long & ~in_any).alias("long_other"))
    return rows.groupBy("service_date").agg(*aggs)


def working_days(ready: DataFrame, min_trips: int = MIN_TRIPS_PER_DAY) -> DataFrame:
    """Mondays to Fridays with enough trips."""
    return (
        ready.groupBy("service_date").agg(F.count(F.lit(1)).alias("trips"))
        .filter((F.weekday("service_date") < 5) & (F.col("trips") >= min_trips))
    )


def spaced_days(days: DataFrame, n: int) -> DataFrame:
    """``n`` days spread evenly from first to last.  The input is one row per day."""
    numbered = days.withColumns({
        "_r": F.row_number().over(Window.orderBy("service_date")) - 1,
        "_n": F.count(F.lit(1)).over(Window.partitionBy()),
    })
    step = (F.col("_n") - 1) / F.lit(max(n - 1, 1))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * step, 0).cast("int"))
    return numbered.filter(F.array_contains(picks, F.col("_r"))).drop("_r", "_n")


def every_kth_day(days: DataFrame, n: int) -> DataFrame:
    """At most ``n`` days in equal strides from the first."""
    numbered = days.withColumns({
        "_r": F.row_number().over(Window.orderBy("service_date")) - 1,
        "_n": F.count(F.lit(1)).over(Window.partitionBy()),
    })
    stride = F.greatest(F.floor(F.col("_n") / n), F.lit(1))
    return numbered.filter((F.col("_r") % stride == 0) & (F.col("_r") < stride * n)).drop("_r", "_n")


def availability_by_day(ready: DataFrame, days: DataFrame) -> DataFrame:
    """One row per chosen day: bands, long headways, trips and vehicles."""
    # The day list has one row per calendar day.
    chosen = ready.join(days.select("service_date"), "service_date", "left_semi")
    bands = band_availability(yard_occupancy(vehicle_timeline(chosen), days))
    size = chosen.groupBy("service_date").agg(
        F.count(F.lit(1)).alias("trips"), F.count_distinct("vehicle_id").alias("vehicles"))
    return bands.join(long_headways_by_band(chosen), "service_date").join(size, "service_date")


def availability_summary(by_day: DataFrame) -> DataFrame:
    names = [*BANDS, "other"]
    row = by_day.agg(
        F.count(F.lit(1)).alias("days"),
        *[F.sum(f"long_{n}").alias(f"_long_{n}") for n in names],
        *[F.avg(f"available_{n}").alias(f"available_{n}") for n in BANDS],
        *[F.avg(f"empty_pct_{n}").alias(f"empty_pct_{n}") for n in BANDS],
    ).withColumn("long_total", sum((F.col(f"_long_{n}") for n in names), F.lit(0)))
    row = row.withColumns({f"long_pct_{n}": percent(F.col(f"_long_{n}"), F.col("long_total")) for n in names})
    return row.drop(*[f"_long_{n}" for n in names])


def availability_before_gaps(ready: DataFrame, occupancy: DataFrame,
                             limit_min: float = CHECKED_HEADWAY_MIN) -> DataFrame:
    """Mean yard occupancy 5 to 15 minutes before each start that follows a long headway.

    The two or three ticks in that span are known from the start time, so this is an
    equality join on (day, tick).
    """
    gaps = all_headways(ready.select("trip_id", "route_id", "service_date", "actual_start")).filter(
        F.col("headway_min") > limit_min)
    spans = gaps.withColumns({"_lo": plus_minutes("actual_start", -15), "_hi": plus_minutes("actual_start", -5)})
    late = F.when(F.col("_hi") == _tick_ts(_tick("_hi")), _tick("_hi")).otherwise(_tick("_hi") - 1)
    ticks = spans.withColumns({"_first": _tick("_lo"), "_last": late})
    wanted = ticks.filter("_first <= _last").withColumn("tick", F.explode(F.sequence("_first", "_last")))
    seen = wanted.join(occupancy.select("service_date", "tick", "in_yard"), ["service_date", "tick"])
    means = seen.groupBy("service_date", "trip_id").agg(F.avg("in_yard").alias("in_yard_before"))
    return gaps.select("service_date", "trip_id", "route_id", "headway_min").join(
        means, ["service_date", "trip_id"], "left")


# ---------------------------------------------------------------- rotation

def turnarounds(ready: DataFrame) -> DataFrame:
    """Minutes from a trip's end to the next start of its vehicle that day."""
    return next_trips(ready).filter(F.col("next_start").isNotNull()).withColumn(
        "turnaround_min", minutes_between("final_end", "next_start"))


def turnaround_summary(rows: DataFrame) -> DataFrame:
    g = F.col("turnaround_min")
    kept = F.when(g >= 0, g)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), count_if(g < 0).alias("negative"), (100 * share(g < 0)).alias("negative_pct"),
        count_if(g.between(0, 1)).alias("within_minute"), F.avg(kept).alias("mean"),
        F.stddev_samp(kept).alias("std"), F.min(kept).alias("min"), F.max(kept).alias("max"))


def trips_per_vehicle_day(ready: DataFrame) -> DataFrame:
    return ready.groupBy("vehicle_id", "service_date").agg(F.count(F.lit(1)).alias("n_trips"))


def vehicle_day_distribution(per_day: DataFrame) -> DataFrame:
    n = F.col("n_trips")
    return per_day.agg(
        F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"),
        F.min(n).alias("min"), F.max(n).alias("max"), F.percentile(n, 0.25).alias("p25"),
        F.percentile(n, 0.5).alias("p50"), F.percentile(n, 0.75).alias("p75"),
        F.mode(n, True).alias("mode"))


def vehicle_day_histogram(per_day: DataFrame, top: int = 10) -> DataFrame:
    return per_day.groupBy("n_trips").agg(F.count(F.lit(1)).alias("n")).orderBy("n_trips").limit(top)


def route_changes(ready: DataFrame) -> DataFrame:
    pairs = next_trips(ready).filter(F.col("next_route").isNotNull() & F.col("route_id").isNotNull())
    changed = F.col("route_id") != F.col("next_route")
    return pairs.agg(F.count(F.lit(1)).alias("n"), count_if(changed).alias("changed"),
                     (100 * share(changed)).alias("changed_pct"), (100 * share(~changed)).alias("kept_pct"))


def busiest_vehicles(ready: DataFrame, top: int = 5) -> DataFrame:
    """Vehicles with most trips, each with its busiest day (earliest on a tie)."""
    per_day = trips_per_vehicle_day(ready)
    best = F.max_by(F.struct("service_date", "n_trips"), F.struct("n_trips", -F.unix_date("service_date")))
    return (
        per_day.groupBy("vehicle_id").agg(F.sum("n_trips").alias("trips"), best.alias("_best"))
        .select("vehicle_id", "trips", F.col("_best.service_date").alias("busiest_day"),
                F.col("_best.n_trips").alias("busiest_day_trips"))
        .orderBy(F.col("trips").desc(), "vehicle_id").limit(top)
    )


# ---------------------------------------------------------------- fleet size

MONTH_INDICATORS = ("vehicles", "trips", "passengers", "passengers_per_trip", "trips_per_vehicle")


def monthly_fleet(ready: DataFrame, passengers: str = "boardings") -> DataFrame:
    return (
        ready.groupBy(month_start("service_date").alias("month"))
        .agg(F.count_distinct("vehicle_id").alias("vehicles"), F.count(passengers).alias("trips"),
             F.sum(passengers).alias("passengers"))
        .withColumn("passengers_per_trip", F.col("passengers") / F.col("trips"))
        .withColumn("trips_per_vehicle", F.col("trips") / F.col("vehicles"))
    )


def first_last_month(monthly: DataFrame) -> DataFrame:
    """First and last complete month side by side; the border months are left out.

    The input is one row per month.
    """
    edge = monthly.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    inner = monthly.filter((F.col("month") > edge.select("a").scalar()) & (F.col("month") < edge.select("b").scalar()))
    row = inner.agg(*[
        F.struct(F.min_by(c, "month").cast("double").alias("first"), F.max_by(c, "month").cast("double").alias("last")).alias(c)
        for c in MONTH_INDICATORS])
    long = unpivot_counts(row, MONTH_INDICATORS, "indicator", "v")
    return long.select(
        "indicator", F.col("v.first").alias("first_month"), F.col("v.last").alias("last_month"),
        (F.col("v.last") - F.col("v.first")).alias("change"),
        percent(F.col("v.last") - F.col("v.first"), F.col("v.first")).alias("change_pct"))


def vehicle_activity(ready: DataFrame) -> DataFrame:
    """Last active month of each vehicle and whether it has left service."""
    last = ready.groupBy("vehicle_id").agg(F.max(month_start("service_date")).alias("last_month"))
    newest = ready.agg(month_start(F.max("service_date")).alias("m")).scalar()
    months = F.round(F.date_diff(newest, "last_month") / DAYS_PER_MONTH, 1)
    return last.withColumn("months_since", months).withColumn("is_retired", F.col("months_since") >= RETIRED_MONTHS)


def retirements_by_month(activity: DataFrame) -> DataFrame:
    return activity.filter("is_retired").groupBy("last_month").agg(F.count(F.lit(1)).alias("retired"))



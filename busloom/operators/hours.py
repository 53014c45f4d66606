"""Service hours estimated from the activity of slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.functions.calendar import DAY_TYPES, WEEKDAY
from busloom.functions.columns import count_if, minute_of_day, percent
from busloom.functions.reuse import written_once
from busloom.operators.series import SERIES

# Activity that counts as service, activity below which a slot is odd,
# days needed before a day type stands on its own.
ACTIVE_SHARE = 0.10
ODD_SHARE = 0.30
MIN_SAMPLE_DAYS = 10


def slot_activity(series: DataFrame) -> DataFrame:
    """Share of days with a trip, per day type and minute of day.

    A series has one row per slot, so rows of a minute are distinct days.
    """
    return (
        series.groupBy(*SERIES, "day_type", minute_of_day("timestamp").alias("minute"))
        .agg(count_if(~F.col("is_gap")).alias("active_days"), F.count(F.lit(1)).alias("days"))
        .withColumn("active_share", F.col("active_days") / F.col("days"))
    )


def sample_days(series: DataFrame) -> DataFrame:
    return series.groupBy(*SERIES, "day_type").agg(
        F.count_distinct(F.to_date("timestamp")).alias("sample_days"))


def _clock(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))


def estimate_hours(
    series: DataFrame,
    *,
    active_share: float = ACTIVE_SHARE,
    odd_share: float = ODD_SHARE,
    min_sample_days: int = MIN_SAMPLE_DAYS,
    day_types=DAY_TYPES,
) -> DataFrame:
    """One row per series and day type.

    A day type with too few days borrows the weekday slots when there are any; with no
    active slot the row carries the sentinel -1.  The activity and the days are written once, as
    every step below reads them.
    """
    series = written_once(series.select(*SERIES, "timestamp", "day_type", "is_gap"), "slots")
    activity = slot_activity(series)
    days = sample_days(series)
    wanted = days.select(*SERIES).distinct().withColumn(
        "day_type", F.explode(F.array(*[F.lit(t) for t in day_types])))
    weekday_days = days.filter(F.col("day_type") == WEEKDAY).select(
        *SERIES, F.col("sample_days").alias("_weekday_days"))
    plan = (
        wanted.join(days, [*SERIES, "day_type"], "left").fillna(0, ["sample_days"])
        .join(weekday_days, list(SERIES), "left")
        .withColumn("borrowed", (F.col("sample_days") < min_sample_days)
                    & (F.col("day_type") != WEEKDAY) & F.col("_weekday_days").isNotNull())
        .withColumn("_source", F.when(F.col("borrowed"), WEEKDAY).otherwise(F.col("day_type")))
        .withColumn("used_days", F.when(F.col("borrowed"), F.col("_weekday_days")).otherwise(F.col("sample_days")))
        .drop("_weekday_days")
    )
    slots = activity.withColumnRenamed("day_type", "_source")
    joined = plan.join(slots, [*SERIES, "_source"], "left")
    is_active = F.col("active_share") >= active_share
    keys = [*SERIES, "day_type", "borrowed", "sample_days", "used_days"]
    limits = joined.groupBy(*keys).agg(
        F.min(F.when(is_active, F.col("minute"))).alias("_start"),
        F.max(F.when(is_active, F.col("minute"))).alias("_end"),
        F.collect_list(F.when(F.col("minute").isNotNull(), F.struct("minute", "active_share"))).alias("_slots"),
    )
    # At most one entry per slot of a day.
    inside = F.filter("_slots", lambda s: s["minute"].between(F.col("_start"), F.col("_end")))
    found = F.col("_start").isNotNull()
    return limits.withColumn("_in", inside).select(
        *SERIES, "day_type",
        F.coalesce("_start", F.lit(-1)).alias("start_min"),
        F.coalesce("_end", F.lit(-1)).alias("end_min"),
        F.when(found, _clock(F.col("_start"))).otherwise("").alias("start_clock"),
        F.when(found, _clock(F.col("_end"))).otherwise("").alias("end_clock"),
        F.when(found, (F.col("_end") - F.col("_start") + F.col("gran_min")) / 60.0).otherwise(0.0).alias("service_h"),
        "sample_days",
        F.when(found, F.col("used_days")).otherwise(0).alias("used_days"),
        (F.col("borrowed") & found).alias("borrowed"),
        F.when(found, F.size(F.filter("_in", lambda s: s["active_share"] < odd_share))).otherwise(0).alias("odd_slots"),
        F.when(found, F.size(F.filter("_in", lambda s: s["active_share"] >= active_share)) / F.size("_in"))
        .otherwise(0.0).alias("coverage"),
    )


def activity_matrix(series: DataFrame) -> DataFrame:
    """Minute of day by day type; a day type without days has null."""
    return slot_activity(series).groupBy(*SERIES, "minute").pivot("day_type", list(DAY_TYPES)).agg(
        F.max("active_share"))


def gap_comparison(series: DataFrame) -> DataFrame:
    """Gap share over 24 h and inside the service hours, per series and day type.

    ``series`` carries ``in_hours``; day types without hours get a null share inside.
    """
    return (
        series.groupBy(*SERIES, "day_type")
        .agg(
            F.count(F.lit(1)).alias("slots"),
            count_if(F.col("is_gap")).alias("gaps"),
            count_if(F.col("in_hours")).alias("hours_slots"),
            count_if(F.col("in_hours") & F.col("is_gap")).alias("hours_gaps"),
        )
        .withColumn("gap_pct", percent(F.col("gaps"), F.col("slots")))
        .withColumn("hours_gap_pct", percent(F.col("hours_gaps"), F.col("hours_slots")))
    )


def gap_rollup(comparison: DataFrame) -> DataFrame:
    """Slot-weighted shares per series over the day types that have hours, and the
    reduction in percentage points."""
    sums = comparison.filter(F.col("hours_slots") > 0).groupBy(*SERIES).agg(*[F.sum(c).alias(c) for c in ("slots", "gaps", "hours_slots", "hours_gaps")])
    return (
        sums.withColumn("gap_pct", percent(F.col("gaps"), F.col("slots")))
        .withColumn("hours_gap_pct", percent(F.col("hours_gaps"), F.col("hours_slots")))
        .withColumn("reduction_points", F.col("gap_pct") - F.col("hours_gap_pct"))
    )


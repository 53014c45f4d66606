"""Normalisation of trip records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.columns import (
    CLOCK_PATTERN,
    col,
    count_if,
    day_of,
    is_blank,
    minutes_between,
    percent,
    require_columns,
    true_or_false,
    unpivot_counts,
)
from busloom.functions.ordered import keep_first

# Accepted trip length in minutes, status code of a cancelled trip.
READY_MINUTES = (5, 480)
CANCELLED_STATUS = 4


def combine_date_clock(date_col: str, clock_col: str) -> Column:
    """Timestamp from a date and the first clock time in a text; null if unreadable."""
    clock = F.nullif(F.regexp_extract(F.col(clock_col).cast("string"), CLOCK_PATTERN, 1), F.lit(""))
    text = F.concat(F.col(date_col).cast("string"), F.lit(" "), clock)
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def corrected_boardings(raw: str | Column, alarms: str | Column) -> Column:
    """Door alarms taken off, never below zero; an unknown count stays unknown."""
    r = col(raw).try_cast("double")
    a = F.coalesce(col(alarms).try_cast("double").cast("long"), F.lit(0))
    return F.when(r.isNotNull(), F.greatest(r - a, F.lit(0.0)))


def only_routes(df: DataFrame, routes: Sequence, route_col: str = "route_id") -> DataFrame:
    return df.filter(F.col(route_col).isin(*routes))


def missing_share(df: DataFrame, columns: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    names = list(columns or df.columns)
    row = df.agg(*[(100 * F.avg(F.col(c).isNull().cast("int"))).alias(c) for c in names])
    return (unpivot_counts(row, names, "column_name", "missing_pct")
            .orderBy(F.col("missing_pct").desc(), "column_name").limit(top))


def clean_positions(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Coordinates as numbers; rows that have none in range are dropped."""
    def number(name: str) -> Column:
        return F.replace(F.trim(F.col(name).cast("string")), F.lit(","), F.lit(".")).try_cast("double")

    return (df.withColumns({lat: number(lat), lon: number(lon)})
            .filter(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)))


def label_trips(df: DataFrame, start: str = "actual_start", end: str = "actual_end") -> DataFrame:
    """REAL / SIN_FIN, COMPLETO / TRUNCADO_SIN_FIN."""
    done = F.col(end).isNotNull()
    return df.withColumns({
        "is_complete": done.cast("int"),
        "end_source": F.when(done, "REAL").otherwise("SIN_FIN"),
        "end_reason": F.when(done, "COMPLETO").otherwise("TRUNCADO_SIN_FIN"),
        "order_invalid": true_or_false(F.col(end) <= F.col(start)),
    })


def demand_subset(df: DataFrame) -> DataFrame:
    """Trips not cancelled and with a start; an unknown status counts as not cancelled."""
    return df.filter(~F.col("trip_status").eqNullSafe(CANCELLED_STATUS) & F.col("actual_start").isNotNull())


def timing_subset(df: DataFrame) -> DataFrame:
    labelled = df if "order_invalid" in df.columns else label_trips(df)
    return labelled.filter(~F.col("trip_status").eqNullSafe(CANCELLED_STATUS)
                           & (F.col("is_complete") == 1) & ~F.col("order_invalid"))


def model_ready(df: DataFrame, *, keep_all: bool = False) -> DataFrame:
    """Final end, duration and clock parts; only usable trips unless ``keep_all``."""
    require_columns(df, ["actual_start", "actual_end"])
    end = F.col("actual_end")
    if "estimated_end" in df.columns:
        end = F.coalesce(end, F.col("estimated_end"))
    hard = F.coalesce(F.col("qc_hard_fail"), F.lit(False)) if "qc_hard_fail" in df.columns else F.lit(False)
    start = F.col("actual_start")
    out = df.withColumn("final_end", end).withColumns({
        "duration_min": minutes_between("actual_start", "final_end"),
        "start_hour": F.hour(start),
        "end_hour": F.hour("final_end"),
        "weekday": F.weekday(start),
        "month": F.month(start),
        "day": F.dayofmonth(start),
        "service_date": day_of(start),
    })
    ok = true_or_false(F.col("duration_min").between(*READY_MINUTES) & ~hard)
    out = out.withColumn("is_ready", ok)
    return out if keep_all else out.filter("is_ready")


def final_integrity(df: DataFrame, key: str = "trip_id", order: Sequence[str] = ("actual_start",),
                    end: str = "final_end") -> DataFrame:
    """Key, start and end known, duration unknown or positive, one row per key (first by ``order``)."""
    kept = df.filter(
        F.col(key).isNotNull() & F.col("actual_start").isNotNull() & F.col(end).isNotNull()
        & (F.col("duration_min").isNull() | (F.col("duration_min") > 0))
    )
    return keep_first(kept, [key], list(order))


def final_quality_report(df: DataFrame, key: str = "trip_id", vehicle: str = "vehicle_id") -> DataFrame:
    """Counts and shares of duplicate keys, blank vehicles and non-positive durations."""
    copies = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        count_if(is_blank(vehicle)).alias("blank"),
        count_if(F.col("duration_min") <= 0).alias("bad_duration"),
    )
    row = copies.agg(
        F.sum("n").alias("_total"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_key"),
        F.sum("blank").alias("blank_vehicle"),
        F.sum("bad_duration").alias("non_positive_duration"),
    )
    rules = ["duplicate_key", "blank_vehicle", "non_positive_duration"]
    return (row.select("_total", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])))
        .select("rule", "n", F.coalesce(percent(F.col("n"), F.col("_total")), F.lit(0.0)).alias("pct")))


def boardings_column(df: DataFrame, preferred: str = "boardings", fallback: str = "boardings_raw") -> str | None:
    """The corrected count if the table has it, else the raw one."""
    return next((c for c in (preferred, fallback) if c in df.columns), None)


def date_slice(df: DataFrame, first: str, last: str, ts: str = "timestamp") -> DataFrame:
    """Rows of the given days, both included, as a range the scan can prune on."""
    c = F.col(ts)
    low = F.lit(first).cast("date").cast("timestamp_ntz")
    high = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")
    return df.filter((c >= low) & (c < high))


def consecutive_number(partition: Sequence[str], *order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))

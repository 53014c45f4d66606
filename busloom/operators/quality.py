"""Quality flags of trip records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from busloom.functions.columns import (
    count_if,
    is_blank,
    minutes_between,
    percent,
    true_or_false,
)
from busloom.functions.reuse import written_once
from busloom.functions.stats import describe_by, exact_percentiles

# Which flags exclude a trip, which only mark it, and the hard weight.
HARD_FLAGS = (
    "flag_key_null",
    "flag_key_duplicated",
    "flag_vehicle_blank",
    "flag_start_null",
    "flag_end_before_start",
    "flag_duration_negative",
    "flag_distance_negative",
    "flag_boardings_negative",
)
SOFT_FLAGS = (
    "flag_end_null",
    "flag_duration_excess",
    "flag_boardings_excess",
    "flag_frequency_out",
)
OTHER_FLAGS = ("flag_status_invalid",)
ALL_FLAGS = HARD_FLAGS + SOFT_FLAGS + OTHER_FLAGS
ROLLUPS = ("qc_any_flag", "qc_hard_fail", "qc_soft_fail")
HARD_WEIGHT = 5

# Routes that are looked up in place, in so many buckets; copies of the limits where they are joined.
MOST_MAPPED_ROUTES = 100_000
LIMIT_BUCKETS = 1024
ROUTE_SALTS = 64


@dataclass(frozen=True)
class QualityLimits:
    """Default percentiles and ranges.

    The absolute caps feed the *soft* excess flags, whatever their name suggests
    elsewhere.
    """

    duration_percentile: float = 0.99
    duration_cap: float | None = None
    boardings_percentile: float = 0.995
    boardings_cap: float | None = None
    frequency_range: tuple[float, float] = (1.0, 60.0)
    valid_status: Sequence[int] | None = None


def structural_flags(df: DataFrame, key: str = "trip_id") -> DataFrame:
    """Null keys, duplicated keys (every copy; null keys are copies of each other), blank
    vehicle, missing times.

    Duplicates come from a pre-aggregated count.  Rows without a key are handled apart,
    so that they never meet in one join partition.
    """
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    keyed = (
        df.filter(F.col(key).isNotNull())
        .join(repeated.filter(F.col(key).isNotNull()), key, "left")
        .withColumn("flag_key_duplicated", F.col("_copies").isNotNull())
        .drop("_copies")
    )
    many_nulls = df.filter(F.col(key).isNull()).agg((F.count(F.lit(1)) > 1).alias("x")).scalar()
    keyless = df.filter(F.col(key).isNull()).withColumn("flag_key_duplicated", many_nulls)
    out = keyed.select(*df.columns, "flag_key_duplicated").unionByName(keyless)
    return out.withColumns({
        "flag_key_null": F.col(key).isNull(),
        "flag_vehicle_blank": is_blank("vehicle_id"),
        "flag_start_null": F.col("actual_start").isNull(),
        "flag_end_null": F.col("actual_end").isNull(),
    })


def temporal_flags(df: DataFrame) -> DataFrame:
    out = df.withColumn("duration_min", minutes_between("actual_start", "actual_end"))
    return out.withColumns({
        "flag_end_before_start": true_or_false(F.col("actual_end") < F.col("actual_start")),
        "flag_duration_negative": true_or_false(F.col("duration_min") < 0),
    })


def percentile_limits(df: DataFrame, measures: dict[str, tuple[float, float]], route: str = "route_id") -> DataFrame:
    """Exact percentile of the non-negative values per route, for several measures at once.

    ``measures`` maps a column to (probability, band width); the result has one column
    per measure.  All measures share one histogram pass over the table.
    """
    long = df.filter(F.col(route).isNotNull()).select(route, F.inline(F.array(*[
        F.struct(F.lit(m).alias("_measure"), F.col(m).cast("double").alias("_v"), F.lit(w).alias("_w"))
        for m, (_, w) in measures.items()]))).filter(F.col("_v") >= 0)
    probs = {f"_p{i}": p for i, (p, _) in enumerate(measures.values())}
    found = exact_percentiles(long.withColumn("_scaled", F.col("_v") / F.col("_w")), [route, "_measure"],
                              "_scaled", probs, width=1.0)
    return found.groupBy(route).agg(*[
        F.max(F.when(F.col("_measure") == m, F.col(f"_p{i}") * F.lit(w))).alias(m)
        for i, (m, (_, w)) in enumerate(measures.items())])


def percentile_flag(
    df: DataFrame,
    value: str,
    flag: str,
    probability: float,
    *,
    route: str | None = "route_id",
    cap: float | None = None,
    width: float = 1 / 64,
) -> DataFrame:
    """Flag values above the exact percentile of their route's non-negative values.

    Trips without a route get no limit.  Without a route column one limit holds for all
    values, negative ones included.
    """
    v = F.col(value)
    over_cap = true_or_false(v > cap) if cap is not None else F.lit(False)
    if route is None:
        limit = exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, {"limit": probability},
                                  width=width).select("limit").scalar()
        return df.withColumn(flag, true_or_false(v > limit) | over_cap)
    known = with_limits(df, percentile_limits(df, {value: (probability, width)}, route), [value], route)
    return known.withColumn(flag, true_or_false(v > F.col("_limit")[value]) | over_cap).drop("_limit")


def with_limits(df: DataFrame, limits: DataFrame, measures: Sequence[str], route: str) -> DataFrame:
    """``df`` with its route's limits as a struct ``_limit``, null if there are none.

    The limits are written once and counted.  Up to ``MOST_MAPPED_ROUTES`` of them are looked up in place, so that trips are
    not moved by their route: a scalar subquery holds them by hash, and a look-up meets the few routes of one bucket.  A
    route column with more values than a network has lines is joined instead, salted, so that a hot route is many tasks' work.
    """
    known = written_once(limits.select(route, F.struct(*measures).alias("_limit")), "limits")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(LIMIT_BUCKETS)).cast("int")
    if known.count() <= MOST_MAPPED_ROUTES:
        maps = known.groupBy(bucket(F.col(route)).alias("_b")).agg(F.map_from_entries(F.collect_list(F.struct(route, "_limit"))).alias("_m"))
        every = known.sparkSession.range(LIMIT_BUCKETS).withColumnRenamed("id", "_b").join(maps, "_b", "left")
        ordered = F.sort_array(F.collect_list(F.struct(F.col("_b").cast("int").alias("b"), F.map_entries("_m").alias("m"))))
        held = every.agg(F.transform(ordered, lambda x: F.map_from_entries(F.coalesce(x["m"], F.array().cast(_entries(known, route))))).alias("_all")).scalar()
        return df.withColumn("_limit", F.try_element_at(F.element_at(held, bucket(F.col(route)) + 1), F.col(route)))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(ROUTE_SALTS)).cast("int")
    spread = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ROUTE_SALTS - 1))))
    return df.withColumn("_salt", salt).join(spread, [route, "_salt"], "left").select(*df.columns, "_limit")


def _entries(known: DataFrame, route: str) -> ArrayType:
    return ArrayType(StructType([StructField("key", known.schema[route].dataType), StructField("value", known.schema["_limit"].dataType)]))


def operational_flags(df: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    low, high = limits.frequency_range
    freq = F.col("frequency_min") if "frequency_min" in df.columns else F.lit(None).cast("double")
    if limits.valid_status is None:
        status = F.lit(False)
    else:
        status = true_or_false(~F.col("trip_status").isin(*limits.valid_status))
    return df.withColumns({
        "flag_boardings_negative": true_or_false(F.col("boardings_raw") < 0),
        "flag_distance_negative": true_or_false(F.col("distance") < 0),
        "flag_frequency_out": true_or_false((freq < low) | (freq > high)),
        "flag_status_invalid": status,
    })


def _any(names: Sequence[str]) -> Column:
    cond = F.lit(False)
    for n in names:
        cond = cond | F.col(n)
    return cond


def _reasons(names: Sequence[str], when: Column) -> Column:
    active = F.concat_ws(",", *[F.when(F.col(n), F.lit(n)) for n in names])
    return F.when(when, active).otherwise("")


def roll_up_flags(df: DataFrame) -> DataFrame:
    hard = F.col("qc_hard_fail")
    return (
        df.withColumns({"qc_any_flag": _any(ALL_FLAGS), "qc_hard_fail": _any(HARD_FLAGS)})
        .withColumn("qc_soft_fail", ~hard & _any(SOFT_FLAGS))
        .withColumns({
            "qc_reason_hard": _reasons(HARD_FLAGS, hard),
            "qc_reason_soft": _reasons(SOFT_FLAGS, F.col("qc_soft_fail")),
            "qc_score": sum((F.col(n).cast("int") for n in ALL_FLAGS), F.lit(0))
            + HARD_WEIGHT * hard.cast("int"),
        })
    )


def flag_trips(df: DataFrame, limits: QualityLimits = QualityLimits(), *, key: str = "trip_id",
               route: str | None = "route_id") -> DataFrame:
    """All flags, their roll-ups, reasons and score.

    The percentile limits come from an aggregate of the same scan, are written once and looked up in a map,
    so no trip is shuffled by its route.
    """
    rows = operational_flags(temporal_flags(df), limits)
    checks = {
        "duration_min": ("flag_duration_excess", limits.duration_percentile, limits.duration_cap, 1 / 64),
        "boardings_raw": ("flag_boardings_excess", limits.boardings_percentile, limits.boardings_cap, 1.0),
    }
    if route is None:
        for value, (flag, p, cap, width) in checks.items():
            rows = percentile_flag(rows, value, flag, p, route=None, cap=cap, width=width)
        return roll_up_flags(structural_flags(rows, key))
    found = percentile_limits(rows, {v: (p, w) for v, (_, p, _, w) in checks.items()}, route)
    out = with_limits(structural_flags(rows, key), found, list(checks), route)
    limit = F.col("_limit")
    for value, (flag, _, cap, _) in checks.items():
        over = true_or_false(F.col(value) > limit[value])
        out = out.withColumn(flag, over | true_or_false(F.col(value) > cap) if cap is not None else over)
    return roll_up_flags(out.drop("_limit"))


def flag_summary(flagged: DataFrame) -> DataFrame:
    """Count and share per flag and roll-up, largest first, name as tie-break."""
    names = [c for c in (*ALL_FLAGS, *ROLLUPS) if c in flagged.columns]
    row = flagged.agg(F.count(F.lit(1)).alias("_rows"), *[count_if(F.col(c)).alias(c) for c in names])
    return (
        row.select("_rows", F.inline(F.array(*[
            F.struct(F.lit(c).alias("flag"), F.col(c).alias("n")) for c in names])))
        .select("flag", "n", F.coalesce(percent(F.col("n"), F.col("_rows")), F.lit(0.0)).alias("pct"))
        .orderBy(F.col("n").desc(), "flag")
    )


def top_offenders(flagged: DataFrame, by: str, top: int = 15) -> DataFrame:
    return (
        flagged.filter(F.col(by).isNotNull()).groupBy(by)
        .agg(*[count_if(F.col(c)).alias(c) for c in ROLLUPS])
        .orderBy(F.col("qc_hard_fail").desc(), F.col("qc_any_flag").desc(), by)
        .limit(top)
    )


def describe(df: DataFrame, value: str, keys: Sequence[str] = (), *, width: float = 1 / 64,
             probs: dict[str, float] | None = None) -> DataFrame:
    """n, mean, std, min, max, p50, p90, p95, p99; one row if no keys are given."""
    probs = probs or {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    if keys:
        return describe_by(df, list(keys), value, probs, width=width)
    # Without keys both sides are one row: the percentiles come in as a scalar, not by a join.
    found = exact_percentiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, width=width)
    row = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                 F.min(value).alias("min"), F.max(value).alias("max"))
    return row.withColumn("_p", found.select(F.struct(*probs).alias("p")).scalar()).select(
        "n", "mean", "std", "min", "max", *[F.col("_p").getField(p).alias(p) for p in probs])


def negative_durations(flagged: DataFrame, tie: str, top: int = 20) -> DataFrame:
    return flagged.filter(F.col("duration_min") < 0).orderBy(tie).limit(top)

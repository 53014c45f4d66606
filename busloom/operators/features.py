"""Model features of the slot series.

Windows run per series.  A series has one row per slot of the time span, so its length
does not grow with the number of trips.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.calendar import DAY_TYPES
from busloom.functions.columns import minute_of_day, plus_minutes, require_columns, time_label
from busloom.operators.series import SERIES

# Lag steps and window lengths in slots, names a predictor may not have.
LAGS = (1, 2, 3, 48, 96, 336)
TRIP_LAGS = (1, 2, 3, 48, 336)
MEAN_WINDOWS = (3, 6, 12)
STD_WINDOWS = (6, 12)
FORBIDDEN = ("passengers_mean", "passengers_p95", "final_end", "duration_min", "end_type", "end_source", "is_complete")
CALENDAR_FEATURES = ("hour", "weekday", "month", "iso_week", "is_weekend", "is_holiday", "day_type", "day_part", "route_id")
CYCLIC_FEATURES = ("hour_sin", "hour_cos", "weekday_sin", "weekday_cos")
NOT_YET_KNOWN = ("_lag_1", "_lag_2", "_lag_3", "_mean_3", "_mean_6", "_mean_12", "_std_6", "_std_12")

DEMAND, PER_TRIP, TRIPS = "passengers_sum", "passengers_per_trip", "trips"
DEMAND_SET = "demand_lags"
DEMAND_TRIPS_SET = "demand_and_trip_lags"
ALL_SET = "productivity_demand_and_trip_lags"


@dataclass(frozen=True)
class Scenario:
    name: str
    target: str
    feature_set: str


# Forecasting scenarios.
SCENARIOS = (
    Scenario("sin_oferta", DEMAND, DEMAND_SET),
    Scenario("oferta_historica_rezagada", DEMAND, DEMAND_TRIPS_SET),
    Scenario("productividad_por_despacho", PER_TRIP, ALL_SET),
)


def add_targets(series: DataFrame) -> DataFrame:
    """Passengers per trip and the observed flags of both targets."""
    trips = F.col("trips")
    out = series.withColumn(PER_TRIP, F.when(trips > 0, F.col(DEMAND) / trips))
    return out.withColumns({
        "demand_observed": F.col(DEMAND).isNotNull() & ~F.col("is_gap"),
        "per_trip_observed": F.col(PER_TRIP).isNotNull() & F.coalesce(trips > 0, F.lit(False)) & ~F.col("is_gap"),
    })


def lag_columns(measure: str, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    return {f"{measure}_lag_{k}": F.lag(measure, k).over(w) for k in lags}


def rolling_columns(measure: str, means: Sequence[int] = MEAN_WINDOWS,
                    stds: Sequence[int] = STD_WINDOWS) -> dict[str, Column]:
    """Over the previous rows only; missing values are skipped."""
    w = Window.partitionBy(*SERIES).orderBy("timestamp")
    out = {f"{measure}_mean_{k}": F.avg(measure).over(w.rowsBetween(-k, -1)) for k in means}
    return out | {f"{measure}_std_{k}": F.stddev_samp(measure).over(w.rowsBetween(-k, -1)) for k in stds}


def add_lags(series: DataFrame) -> DataFrame:
    """Lags and rolling statistics of the three measures, on the complete grid."""
    require_columns(series, [*SERIES, "timestamp", DEMAND, PER_TRIP, TRIPS])
    return series.withColumns(
        lag_columns(DEMAND) | rolling_columns(DEMAND) | lag_columns(PER_TRIP) | rolling_columns(PER_TRIP)
        | lag_columns(TRIPS, TRIP_LAGS) | rolling_columns(TRIPS, stds=()))


def add_cycles(df: DataFrame) -> DataFrame:
    day, week = 2 * pi * minute_of_day("timestamp") / 1440.0, 2 * pi * F.col("weekday") / 7.0
    return df.withColumns({
        "slot_label": time_label("timestamp"),
        "hour_sin": F.sin(day), "hour_cos": F.cos(day), "weekday_sin": F.sin(week), "weekday_cos": F.cos(week),
    })


def add_interval(df: DataFrame, horizon: int = 1) -> DataFrame:
    """Start and end of the target slot, and the moment features must be known."""
    if horizon != 1:
        raise ValueError("only the next slot can be forecast")
    return df.withColumns({
        "interval_start": F.col("timestamp"), "interval_end": plus_minutes("timestamp", "gran_min"),
        "cutoff_ts": F.col("timestamp")})


def feature_names(feature_set: str = DEMAND_SET) -> list[str]:
    """Approved predictors of a feature set."""
    def columns(m: str, lags=LAGS, stds=STD_WINDOWS) -> list[str]:
        return ([f"{m}_lag_{k}" for k in lags] + [f"{m}_mean_{k}" for k in MEAN_WINDOWS] + [f"{m}_std_{k}" for k in stds])

    demand, trips = columns(DEMAND), columns(TRIPS, TRIP_LAGS, ())
    extra = {DEMAND_SET: demand, DEMAND_TRIPS_SET: demand + trips, ALL_SET: columns(PER_TRIP) + demand + trips}
    if feature_set not in extra:
        raise ValueError(f"unknown feature set: {feature_set}")
    names = [*CALENDAR_FEATURES, *CYCLIC_FEATURES, *extra[feature_set]]
    check_predictors(names)
    return names


def check_predictors(names: Sequence[str]) -> None:
    bad = sorted({n.lower() for n in names} & {n.lower() for n in FORBIDDEN})
    if bad:
        raise ValueError(f"predictors that know the future: {', '.join(bad)}")


def numeric_features(df: DataFrame, excluded: Sequence[str], *, without_supply: bool = True,
                     without_yearly: bool = True, without_unknown: bool = True) -> list[str]:
    """Numeric columns left after the exclusion rules."""
    numeric = {"int", "bigint", "double", "float", "smallint", "boolean"}
    names = [n for n, t in df.dtypes if t in numeric and n not in excluded and n not in FORBIDDEN]
    if without_supply:
        names = [n for n in names if not n.startswith(TRIPS)]
    if without_yearly:
        names = [n for n in names if n not in ("iso_week", "month")]
    if without_unknown:
        names = [n for n in names if not n.endswith(NOT_YET_KNOWN)]
    return names


def modeling_table(series: DataFrame, *, in_hours_only: bool = True, first_days: int | None = None) -> DataFrame:
    """Features on the whole grid, then the in-hours rows (of the first days, if asked)."""
    out = add_interval(add_cycles(add_lags(add_targets(series))))
    if in_hours_only:
        out = out.filter("in_hours")
    if first_days is not None:
        first = out.agg(F.min("timestamp").alias("t")).scalar()
        out = out.filter(F.col("timestamp") < plus_minutes(first, 1440 * first_days))
    return out


def leakage_check(featured: DataFrame, measure: str = DEMAND, lags: Sequence[int] = LAGS,
                  means: Sequence[int] = MEAN_WINDOWS, stds: Sequence[int] = STD_WINDOWS) -> DataFrame:
    """Mismatches per feature against values recomputed by row number instead of windows.

    Works on the complete grid; one row per feature, ``mismatches`` must be 0.
    """
    numbered = featured.withColumn("_i", F.row_number().over(Window.partitionBy(*SERIES).orderBy("timestamp")))
    names = ([f"{measure}_lag_{k}" for k in lags] + [f"{measure}_mean_{k}" for k in means]
             + [f"{measure}_std_{k}" for k in stds])
    actual = numbered.select(*SERIES, "_i", F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("actual")) for n in names])))
    widest = max([*means, *stds, 0])
    source = numbered.select(*SERIES, "_i", F.col(measure).cast("double").alias("_v"))
    shifted = source.select(*SERIES, "_v", F.inline(F.array(*[
        F.struct(F.lit(f"{measure}_lag_{k}").alias("feature"), (F.col("_i") + k).alias("_i")) for k in lags])))
    expected = shifted.groupBy(*SERIES, "_i", "feature").agg(F.max("_v").alias("expected"))
    near = source.select(*SERIES, "_v", F.explode(F.sequence(F.lit(1), F.lit(widest))).alias("_k"), "_i").withColumn(
        "_i", F.col("_i") + F.col("_k"))
    within = lambda k: F.when(F.col("_k") <= k, F.col("_v"))
    stats = near.groupBy(*SERIES, "_i").agg(
        *[F.avg(within(k)).alias(f"{measure}_mean_{k}") for k in means],
        *[F.stddev_samp(within(k)).alias(f"{measure}_std_{k}") for k in stds])
    rolled = stats.select(*SERIES, "_i", F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("expected")) for n in names if "_lag_" not in n])))
    both = actual.join(expected.unionByName(rolled), [*SERIES, "_i", "feature"], "left")
    a, e = F.col("actual"), F.col("expected")
    same = (a.isNull() & e.isNull()) | F.coalesce(F.abs(a - e) <= 1e-8 + 1e-5 * F.abs(e), F.lit(False))
    return both.groupBy("feature").agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(~same, 1)).alias("mismatches"))


def require_no_leakage(check: DataFrame) -> None:
    bad = [r["feature"] for r in check.filter("mismatches > 0").select("feature").collect()]
    if bad:
        raise ValueError(f"features that do not match the past: {', '.join(sorted(bad))}")


def scenario_rows(table: DataFrame, scenarios: Sequence[Scenario] = SCENARIOS) -> DataFrame:
    """All scenarios in one long frame: target value, its lags and observed flag stamped."""
    structs = []
    for s in scenarios:
        observed = "per_trip_observed" if s.target == PER_TRIP else "demand_observed"
        structs.append(F.struct(
            F.lit(s.name).alias("scenario"), F.lit(s.target).alias("target"), F.lit(s.feature_set).alias("feature_set"),
            F.col(s.target).alias("y"), F.col(observed).alias("observed"),
            *[F.col(f"{s.target}_lag_{k}").alias(f"y_lag_{k}") for k in (1, 48, 336)]))
    return table.select(*table.columns, F.inline(F.array(*structs)))


def usable_snapshot(ready: DataFrame, routes: Sequence, required: Sequence[str]) -> DataFrame:
    """Ready trips of the given routes, with the columns a model needs."""
    require_columns(ready, required)
    rows = ready.filter(F.col("route_id").isin(*routes))
    return rows.filter("is_ready") if "is_ready" in ready.columns else rows


def one_hot_day_types(df: DataFrame) -> DataFrame:
    return df.withColumns({f"is_{t.lower()}": (F.col("day_type") == t).cast("int") for t in DAY_TYPES})


def holiday_days(table: DataFrame) -> DataFrame:
    """Distinct service days of a holiday type."""
    return table.filter(F.col("day_type").isin("FESTIVO", "FESTIVO_PUENTE")).select("day_type", "service_day").distinct()

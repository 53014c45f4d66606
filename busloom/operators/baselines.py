"""Forecasting baselines over all folds at once.

Training aggregates are made per cell and first training fold, then accumulated over the
folds: rows are never copied per fold.  Cells are route x day type x slot, so the tables
joined here are small and do not grow with the trips.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.calendar import RARE_DAY_TYPES, regime
from busloom.functions.columns import day_of, minute_of_day
from busloom.functions.reuse import written_once
from busloom.operators.splits import assign_folds, spread_over_folds

# Lags of the naive models, observations a cell needs, window multiplier,
# slots per day.
NAIVE_LAGS = {"naive": 1, "seasonal_naive_daily": 48, "seasonal_naive_weekly": 336}
HISTORICAL = "historical_average_route_day_type_slot"
MIN_CELL = 3
WIDE = 2
SLOTS = 48
SLOT_MIN = 30

CELL = ("scenario", "route_id", "day_type", "slot")


def with_slot(table: DataFrame) -> DataFrame:
    return table.withColumn("slot", F.floor(minute_of_day("timestamp") / SLOT_MIN).cast("int"))


def _mean() -> Column:
    return F.sum("_sum") / F.sum("_n")


def naive_predictions(rows: DataFrame) -> DataFrame:
    """(row, model, prediction) of the lag models."""
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"y_lag_{k}").cast("double").alias("y_pred")) for m, k in NAIVE_LAGS.items()])
    return rows.select("*", F.inline(models))


def historical_average(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Mean per route x day type x slot of the fold's past, else route x slot, else route,
    else all.  ``rows`` come from ``assign_folds``; returns the evaluation rows."""
    train = rows.filter(F.col("first_fold").isNotNull() & F.col("observed") & F.col("y").isNotNull())
    cells = train.groupBy(*CELL, "first_fold").agg(F.sum("y").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    cells = spread_over_folds(cells, folds).groupBy(*CELL, "fold_no").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    cells = written_once(cells, "cells")  # the coarser levels roll these up
    held = rows.filter("fold_no is not null")
    for i, keys in enumerate((list(CELL), ["scenario", "route_id", "slot"], ["scenario", "route_id"], ["scenario"])):
        held = held.join(cells.groupBy(*keys, "fold_no").agg(_mean().alias(f"_p{i}")), [*keys, "fold_no"], "left")
    return held.withColumn("model", F.lit(HISTORICAL)).withColumn(
        "y_pred", F.coalesce(*[f"_p{i}" for i in range(4)])).drop(*[f"_p{i}" for i in range(4)])


def _window_days(folds: DataFrame, windows: Sequence[int]) -> DataFrame:
    """(window, fold, service day, near): days of the window and of its wider double."""
    wide = folds.select("fold_no", "train_start", "train_end", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_days"))
    end = day_of("train_end")
    first = F.greatest(F.date_sub(end, F.col("window_days") * WIDE), day_of("train_start"))
    days = wide.withColumn("service_day", F.explode(F.sequence(first, F.date_sub(end, 1))))
    return days.select("window_days", "fold_no", "service_day",
                       (F.col("service_day") >= F.date_sub(end, F.col("window_days"))).alias("_near"))


def rolling_average(rows: DataFrame, folds: DataFrame, windows: Sequence[int],
                    min_cell: int = MIN_CELL) -> DataFrame:
    """Mean of the last ``W`` days with a recorded fallback level.

    1 cell in W, 2 cell in 2W, 3 neighbouring slots in W, 4 route x slot in W, 5 route
    mean in W (else 2W, else all routes).  Levels 1-4 need ``min_cell`` observations.
    """
    key = ["window_days", "fold_no"]
    observed = rows.filter(F.col("observed") & F.col("y").isNotNull())
    daily = observed.groupBy(*CELL, "service_day").agg(F.sum("y").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    near = lambda c: F.sum(F.when(F.col("_near"), F.col(c)))
    cells = daily.join(_window_days(folds, windows), "service_day").groupBy(*CELL, *key).agg(
        near("_sum").alias("_s1"), near("_n").alias("_n1"), F.sum("_sum").alias("_s2"), F.sum("_n").alias("_n2"))
    cells = written_once(cells, "cells")  # the five levels roll these up

    def mean(s: Column, n: Column, least: int = 1) -> Column:
        return F.when(n >= least, s / n)

    own = cells.select(*CELL, *key, mean(F.col("_s1"), F.col("_n1"), min_cell).alias("_v1"),
                       mean(F.col("_s2"), F.col("_n2"), min_cell).alias("_v2"))
    sides = cells.select(*[c for c in CELL if c != "slot"], *key, "_s1", "_n1", F.explode(F.array(
        (F.col("slot") + 1) % SLOTS, (F.col("slot") + SLOTS - 1) % SLOTS)).alias("slot"))
    sides = sides.groupBy(*CELL, *key).agg(mean(F.sum("_s1"), F.sum("_n1"), min_cell).alias("_v3"))
    slot_keys = ["scenario", "route_id", "slot", *key]
    by_slot = cells.groupBy(*slot_keys).agg(mean(F.sum("_s1"), F.sum("_n1"), min_cell).alias("_v4"))
    either = F.coalesce(mean(F.sum("_s1"), F.sum("_n1")), mean(F.sum("_s2"), F.sum("_n2")))
    by_route = cells.groupBy("scenario", "route_id", *key).agg(either.alias("_v5"))
    overall = cells.groupBy("scenario", *key).agg(either.alias("_v6"))

    held = rows.filter("fold_no is not null").withColumn(
        "window_days", F.explode(F.array(*[F.lit(w) for w in windows])))
    held = (held.join(own, [*CELL, *key], "left").join(sides, [*CELL, *key], "left").join(by_slot, slot_keys, "left")
            .join(by_route, ["scenario", "route_id", *key], "left").join(overall, ["scenario", *key], "left"))
    level = F
    for i in range(1, 5):
        level = level.when(F.col(f"_v{i}").isNotNull(), str(i))
    return held.withColumns({
        "model": F.format_string("rolling_average_%dd", F.col("window_days")),
        "y_pred": F.coalesce(*[f"_v{i}" for i in range(1, 7)]),
        "fallback_level": level.otherwise("5"),
    }).drop("window_days", *[f"_v{i}" for i in range(1, 7)])


def with_history_level(rows: DataFrame, folds: DataFrame, history: str = "trips_lag_48") -> DataFrame:
    """Evaluation rows classed by tertiles of the fold's training history; other rows get no class.

    Fixed values: bajo / medio / alto.  The history is a small whole number, so each fold
    keeps few distinct values.
    """
    train = rows.filter(F.col("first_fold").isNotNull() & F.col("observed") & F.col(history).isNotNull())
    counts = train.groupBy("scenario", "first_fold", history).agg(F.count(F.lit(1)).alias("_n"))
    limits = spread_over_folds(counts, folds).groupBy("scenario", "fold_no").agg(
        F.percentile(history, F.array(F.lit(1 / 3), F.lit(2 / 3)), F.col("_n")).alias("_q"))
    v, low, high = F.col(history), F.col("_q")[0], F.col("_q")[1]
    return rows.join(limits, ["scenario", "fold_no"], "left").withColumn(
        "history_level", F.when(v <= low, "bajo").when(v <= high, "medio").when(v > high, "alto")).drop("_q")


def history_level(rows: DataFrame, folds: DataFrame, history: str = "trips_lag_48") -> DataFrame:
    return with_history_level(rows, folds, history).filter("fold_no is not null")


PREDICTION_COLUMNS = ("scenario", "target", "feature_set", "model", "split", "fold", "fold_no", "route_id", "gran_min", "timestamp",
                      "day_type", "hour", "is_gap", "gap_type", "observed", "trips", "history_level", "fallback_level",
                      "y_real", "y_pred")


def with_errors(predictions: DataFrame) -> DataFrame:
    error = F.col("y_pred") - F.col("y_real")
    return predictions.withColumns({"error": error, "error_abs": F.abs(error), "error_squared": error * error})


def backtest(table: DataFrame, folds: DataFrame, windows: Sequence[int] = (28, 56, 84, 182)) -> DataFrame:
    """Long predictions of every baseline, scenario and fold.

    ``table`` holds scenario rows; the fold is a column, so there is no loop over folds.  Folds,
    assigned rows and their history class are written once, as every model reads them.
    """
    folds = written_once(folds, "folds")
    rows = written_once(assign_folds(with_slot(table), folds), "assigned")
    rows = written_once(with_history_level(rows, folds), "assigned")
    held = rows.filter("fold_no is not null")
    parts = [naive_predictions(held), historical_average(rows, folds)]
    out = [p.withColumn("fallback_level", F.lit(None).cast("string")) for p in parts]
    if windows:
        out.append(rolling_average(rows, folds, windows))
    keep = [c for c in PREDICTION_COLUMNS if c != "y_real"]
    all_models = out[0].select(*keep, F.col("y").alias("y_real"))
    for p in out[1:]:
        all_models = all_models.unionByName(p.select(*keep, F.col("y").alias("y_real")))
    return with_errors(all_models)


# ---------------------------------------------------------------- walk-forward and sweeps

def walk_forward(table: DataFrame, days_back: int = 182, value: str = "passengers_sum") -> DataFrame:
    """Each slot against the mean of its day type and slot over the previous days.

    One range frame over day numbers per cell; a cell without a past takes the route's
    mean over the same days.
    """
    seen = with_slot(table).filter(F.col(value).isNotNull()).withColumn("_d", F.unix_date("service_day"))
    cell = ["route_id", "day_type", "slot"]
    past = Window.partitionBy(*cell).orderBy("_d").rangeBetween(-days_back, -1)
    daily = seen.groupBy("route_id", "_d").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    route_past = Window.partitionBy("route_id").orderBy("_d").rangeBetween(-days_back, -1)
    daily = daily.select("route_id", "_d", (F.sum("_s").over(route_past) / F.sum("_n").over(route_past)).alias("_route"))
    out = seen.withColumn("_cell", F.avg(value).over(past)).join(daily, ["route_id", "_d"])
    return out.withColumns({"no_precedent": F.col("_cell").isNull(), "y_pred": F.coalesce("_cell", "_route")}).select(
        "route_id", "timestamp", "service_day", "day_type", "slot", F.col(value).alias("y_real"), "y_pred", "no_precedent")


def walk_forward_days(predicted: DataFrame, min_slots: int = 8) -> DataFrame:
    """Per route and day: error, bias, amplitudes and cells without precedent."""
    p, y = F.col("y_pred"), F.col("y_real")
    return predicted.filter(p.isNotNull()).groupBy("route_id", "service_day").agg(
        F.min_by("day_type", "timestamp").alias("day_type"), F.count(F.lit(1)).alias("n"), F.avg(y).alias("demand_mean"),
        F.avg(F.abs(p - y)).alias("mae"), F.avg(p - y).alias("bias"), (F.max(p) - F.min(p)).alias("range_pred"),
        (F.max(y) - F.min(y)).alias("range_real"), F.count(F.when(F.col("no_precedent"), 1)).alias("no_precedent"),
    ).filter(F.col("n") >= min_slots)


def window_sweep(table: DataFrame, cuts: Sequence[str], windows: Sequence[int | None], eval_days: int = 14,
                 value: str = "passengers_sum") -> DataFrame:
    """Error and bias of the day-type x slot mean, per cut, training window and regime.

    Cut x window pairs are numbered, expanded to days and joined by day.  A window longer than
    the data is left out; None uses all history and has a null window.
    """
    rows = with_slot(table).filter(F.col(value).isNotNull())
    spark = table.sparkSession
    pairs = spark.createDataFrame([(i, c, w) for i, (c, w) in enumerate((c, w) for c in cuts for w in windows)], "_pair int, cut string, window_days int")
    pairs = pairs.withColumn("cut", F.to_date("cut")).withColumn("_first", rows.agg(F.min("service_day").alias("d")).scalar())
    start = F.when(F.col("window_days").isNull(), F.col("_first")).otherwise(F.date_sub("cut", F.col("window_days")))
    pairs = pairs.withColumn("_start", start).filter("_start >= _first")
    key, cell = ["_pair"], ["route_id", "day_type", "slot"]

    def days(first: Column, last: Column) -> DataFrame:
        return pairs.select(*key, F.explode(F.sequence(first, last)).alias("service_day"))

    cells = rows.groupBy(*cell, "service_day").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c"))
    train = cells.join(days(F.col("_start"), F.date_sub("cut", 1)), "service_day")
    total = lambda *k: train.groupBy(*key, *k).agg(F.sum("_s").alias("_a"), F.sum("_c").alias("_b"))
    means = total(*cell).select(*key, *cell, (F.col("_a") / F.col("_b")).alias("_cell"))
    route = total("route_id").select(*key, "route_id", (F.col("_a") / F.col("_b")).alias("_route"))
    held = rows.join(days(F.col("cut"), F.date_add("cut", eval_days - 1)), "service_day")
    scored = held.join(means, [*key, *cell], "left").join(route, [*key, "route_id"], "left")
    error = F.coalesce("_cell", "_route") - F.col(value)
    found = scored.withColumn("_e", error).groupBy(*key, regime(F.col("day_type")).alias("regime")).agg(
        F.count("_e").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.avg("_e").alias("bias"))
    return pairs.select(*key, "cut", "window_days").join(found, key).drop(*key)  # one row per pair and regime


def sweep_summary(sweep: DataFrame) -> DataFrame:
    """Mean and deviation across cuts, one row per window, a column set per regime."""
    return sweep.groupBy("window_days").pivot("regime", ["ordinario", "raro"]).agg(
        F.count(F.lit(1)).alias("cuts"), F.avg("mae").alias("mae"), F.avg("bias").alias("bias"), F.stddev_samp("bias").alias("bias_std"))


def regime_hybrid(predictions: DataFrame, ordinary: str = "y_pred", rare: str = "y_pred_average") -> Column:
    """One model on plain days, averages on holidays."""
    return F.when(F.col("day_type").isin(*RARE_DAY_TYPES), F.col(rare)).otherwise(F.col(ordinary))

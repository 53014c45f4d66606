"""Whole-day time splits for back-testing.

Service days start at 04:00.  All borders lie on that hour, so a row's place in any fold
follows from its service day alone: folds are joined by day equality, not by time range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.columns import day_of, plus_minutes, service_day

# Start of the service day, names of splits and of the last fold.
DAY_START_HOUR = 4
VALIDATION, FINAL = "validation", "test_final"
FINAL_FOLD = "test_final"


@dataclass(frozen=True)
class SplitPlan:
    """Lengths in days (26, 2, 2 and 10 weeks)."""

    min_train_days: int = 182
    validation_days: int = 14
    step_days: int = 14
    test_days: int = 70
    gran_min: int = 30


def _boundary(ts: Column) -> Column:
    return plus_minutes(day_of(ts).cast("timestamp_ntz"), 60 * DAY_START_HOUR)


def align_start(ts: Column) -> Column:
    """The first service-day start at or after ``ts``."""
    b = _boundary(ts)
    return F.when(ts <= b, b).otherwise(plus_minutes(b, 1440))


def align_end(ts: Column) -> Column:
    """The last service-day start at or before ``ts``."""
    b = _boundary(ts)
    return F.when(ts >= b, b).otherwise(plus_minutes(b, -1440))


def bounds(table: DataFrame, plan: SplitPlan) -> DataFrame:
    """One row: raw and aligned limits of the data and of the final test."""
    first, last = F.min("timestamp"), F.max("timestamp")
    row = table.agg(first.alias("start_raw"), plus_minutes(last, plan.gran_min).alias("end_raw"),
                    plus_minutes(last, -1440 * plan.test_days).alias("test_raw"))
    return row.withColumns({
        "start": align_start(F.col("start_raw")), "end": align_end(F.col("end_raw")),
        "test_start": align_start(F.col("test_raw"))})


def alignment_summary(table: DataFrame, plan: SplitPlan) -> DataFrame:
    """Rows and service days cut off at each border, for the data and the final test."""
    c = F.col
    borders = bounds(table, plan).select(F.inline(F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.lit(border).alias("boundary"), c(raw).alias("original_ts"),
                 c(aligned).alias("aligned_ts"),
                 F.least(raw, aligned).alias("cut_from"), F.greatest(raw, aligned).alias("cut_to"))
        for scope, border, raw, aligned in (
            ("dataset", "start", "start_raw", "start"), ("dataset", "end", "end_raw", "end"),
            ("final_test", "start", "test_raw", "test_start"), ("final_test", "end", "end_raw", "end"))])))
    # A cut is shorter than a day, so it meets at most two calendar days of rows.
    days = borders.withColumn("_day", F.explode(F.sequence(day_of("cut_from"), day_of("cut_to"))))
    per_slot = table.groupBy("timestamp").agg(F.count(F.lit(1)).alias("_n")).withColumn("_day", day_of("timestamp"))
    inside = (F.col("timestamp") >= F.col("cut_from")) & (F.col("timestamp") < F.col("cut_to"))
    cut = days.join(per_slot, "_day").filter(inside).groupBy("scope", "boundary").agg(
        F.sum("_n").alias("rows_cut"), F.count_distinct(service_day("timestamp")).alias("days_cut"))
    return borders.drop("cut_from", "cut_to").join(cut, ["scope", "boundary"], "left").fillna(0, ["rows_cut", "days_cut"])


def final_test_window(table: DataFrame, plan: SplitPlan) -> DataFrame:
    return bounds(table, plan).select(
        F.lit(FINAL).alias("split"), F.lit(FINAL_FOLD).alias("fold"), F.col("start").alias("train_start"),
        F.col("test_start").alias("train_end"), F.col("test_start").alias("eval_start"), F.col("end").alias("eval_end"))


def make_folds(table: DataFrame, plan: SplitPlan) -> DataFrame:
    """Expanding folds before the final test, then the final test itself, numbered from 1."""
    b = bounds(table, plan)
    room = F.date_diff(day_of("test_start"), day_of("start")) - plan.min_train_days - plan.validation_days
    last = F.floor(room / plan.step_days)
    steps = F.when(room >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    cut = plus_minutes(F.col("start"), (F.lit(plan.min_train_days) + F.col("_k") * plan.step_days) * 1440)
    folds = b.withColumn("_k", F.explode(steps)).select(
        (F.col("_k") + 1).cast("int").alias("fold_no"), F.lit(VALIDATION).alias("split"),
        (F.col("_k") + 1).cast("string").alias("fold"), F.col("start").alias("train_start"), cut.alias("train_end"),
        cut.alias("eval_start"), plus_minutes(cut, 1440 * plan.validation_days).alias("eval_end"))
    final = b.select(
        F.when(room >= 0, last + 2).otherwise(1).cast("int").alias("fold_no"), F.lit(FINAL).alias("split"),
        F.lit(FINAL_FOLD).alias("fold"), F.col("start").alias("train_start"), F.col("test_start").alias("train_end"),
        F.col("test_start").alias("eval_start"), F.col("end").alias("eval_end"))
    return folds.unionByName(final)


def validate_folds(folds: DataFrame) -> DataFrame:
    """One row of violation counts; all must be 0.  Folds are a few dozen rows."""
    by_time = Window.partitionBy("split").orderBy("eval_start")
    hour = lambda c: F.hour(c) * 60 + F.minute(c)
    start = 60 * DAY_START_HOUR
    test_start = folds.filter(F.col("split") == FINAL).agg(F.min("eval_start").alias("t")).scalar()
    order = ((F.col("train_start") < F.col("train_end")) & (F.col("train_end") <= F.col("eval_start"))
             & (F.col("eval_start") < F.col("eval_end")))
    whole = (hour("train_start") == start) & (hour("train_end") == start) & (hour("eval_start") == start) & (hour("eval_end") == start)
    checked = folds.withColumn("_before", F.lag("eval_end").over(by_time))
    return checked.agg(
        F.count(F.lit(1)).alias("folds"), F.count(F.when(~order, 1)).alias("bad_order"),
        F.count(F.when(F.col("_before") > F.col("eval_start"), 1)).alias("overlaps"),
        F.count(F.when((F.col("split") == VALIDATION) & (F.col("eval_end") > test_start), 1)).alias("reach_test"),
        F.count(F.when(~whole, 1)).alias("partial_days"))


def _days(start: str, end: str) -> Column:
    return F.explode(F.sequence(day_of(start), F.date_sub(day_of(end), 1)))


def eval_days(folds: DataFrame) -> DataFrame:
    """(fold, service day) of the evaluation windows: one row per day."""
    return folds.select("fold_no", "split", "fold", _days("eval_start", "eval_end").alias("service_day"))


def train_entry(folds: DataFrame) -> DataFrame:
    """For each service day, the first fold that trains on it; later folds all do too."""
    days = folds.select("fold_no", _days("train_start", "train_end").alias("service_day"))
    return days.groupBy("service_day").agg(F.min("fold_no").alias("first_fold"))


def assign_folds(table: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row with the fold it is evaluated in and the first fold that trains on it.

    Expanding training sets are thus told by one number, without copying rows per fold.
    """
    named = table if "service_day" in table.columns else table.withColumn("service_day", service_day("timestamp"))
    return named.join(eval_days(folds), "service_day", "left").join(train_entry(folds), "service_day", "left")


def spread_over_folds(counts: DataFrame, folds: DataFrame) -> DataFrame:
    """Copy pre-aggregated training rows to every fold from ``first_fold`` on."""
    last = folds.agg(F.max("fold_no").alias("m")).scalar()
    return counts.withColumn("_last", last).withColumn(
        "fold_no", F.explode(F.sequence("first_fold", "_last"))).drop("first_fold", "_last")


def fold_sizes(assigned: DataFrame, folds: DataFrame) -> DataFrame:
    train = assigned.filter("first_fold is not null").groupBy("first_fold").agg(F.count(F.lit(1)).alias("_n"))
    train = spread_over_folds(train, folds).groupBy("fold_no").agg(F.sum("_n").alias("train_rows"))
    held = assigned.filter("fold_no is not null").groupBy("fold_no").agg(F.count(F.lit(1)).alias("eval_rows"))
    return folds.join(train, "fold_no", "left").join(held, "fold_no", "left")


def three_blocks(table: DataFrame, cut: str, *, train_days: int | None, stop_days: int = 14,
                 eval_days: int = 14, value: str = "passengers_sum") -> DataFrame:
    """Rows labelled fit / stop / eval around a cut; unobserved rows are left out.

    A window that starts before the data raises when the rows are read.
    """
    t, c = F.col("timestamp"), F.lit(cut).cast("timestamp_ntz")
    rows = table.filter(F.col(value).isNotNull())
    start = None if train_days is None else plus_minutes(c, -1440 * train_days)
    block = (
        F.when((t >= plus_minutes(c, -1440 * stop_days)) & (t < c), "stop")
        .when((t >= c) & (t < plus_minutes(c, 1440 * eval_days)), "eval")
        .when((t < c) if start is None else ((t < c) & (t >= start)), "fit")
    )
    out = rows.withColumn("block", block).filter("block is not null")
    if start is None:
        return out
    first = table.agg(F.min("timestamp").alias("t")).scalar()
    too_long = F.raise_error(F.lit("the training window starts before the data"))
    return out.withColumn("block", F.when(start < first, too_long).otherwise(F.col("block")))

"""Where bias comes from: level or spread, distance in time, fleet size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.functions.columns import month_start, share
from busloom.functions.stats import average_rank
from busloom.operators.metrics import evaluable

# Normal quantile of a 95 % interval, points a correlation needs.
Z_95 = 1.959963984540054
MIN_FOLDS = 3
MIN_MONTHS = 4

GROUP = ("scenario", "target", "model", "route_id")


def scored(predictions: DataFrame) -> DataFrame:
    return predictions.filter(evaluable()).withColumn("error", F.col("y_pred") - F.col("y_real"))


def bias_decomposition(predictions: DataFrame, keys: Sequence[str] = (*GROUP, "split")) -> DataFrame:
    """Level part (share of MAE a constant shift would remove) and the dispersion that stays.

    Prediction frames hold one row per slot, model and fold, so a group's size is set by
    the time span.
    """
    e = F.col("error")
    out = scored(predictions).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias_mean"), F.median(e).alias("bias_median"),
        F.stddev_samp(e).alias("error_std"), (100 * share(e > 0)).alias("over_pct"), F.avg(F.abs(e)).alias("mae"))
    ratio = F.when(F.col("mae") > 0, F.abs("bias_mean") / F.col("mae"))
    return out.withColumn("bias_to_mae_ratio", ratio).withColumn(
        "dispersion_fraction", F.when(F.col("bias_to_mae_ratio").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("bias_to_mae_ratio"))))


def fold_distance(folds: DataFrame) -> DataFrame:
    """Days from the middle of the training window to the middle of the evaluated one."""
    def middle(a: str, b: str) -> Column:
        return F.unix_micros(F.col(a).cast("timestamp")) / 2e6 + F.unix_micros(F.col(b).cast("timestamp")) / 2e6

    return folds.withColumn("distance_days", (middle("eval_start", "eval_end") - middle("train_start", "train_end")) / 86400).select(
        "split", "fold", "distance_days")


def bias_by_fold(predictions: DataFrame, folds: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    means = scored(predictions).groupBy(*keys, "split", "fold").agg(F.avg("error").alias("bias_mean"), F.count(F.lit(1)).alias("n"))
    return means.join(fold_distance(folds), ["split", "fold"], "left")


def _correlations(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rows with the average ranks of both sides, for Pearson and Spearman together."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.withColumns({"_rx": average_rank(keys, x), "_ry": average_rank(keys, y)})


def distance_bias_correlation(by_fold: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    ok = (F.count(F.lit(1)) >= MIN_FOLDS) & (F.count_distinct("distance_days") > 1)
    ranked = _correlations(by_fold, keys, "distance_days", "bias_mean")
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.when(ok, F.corr("distance_days", "bias_mean")).alias("pearson"),
        F.when(ok, F.corr("_rx", "_ry")).alias("spearman"))


def monthly_bias(predictions: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    return scored(predictions).groupBy(*keys, month_start("timestamp").alias("month")).agg(
        F.avg("error").alias("bias_mean"), F.count(F.lit(1)).alias("n"))


def bias_by_slot(predictions: DataFrame, keys: Sequence[str] = (*GROUP, "day_type", "hour")) -> DataFrame:
    return scored(predictions).groupBy(*keys).agg(F.avg("error").alias("bias_mean"), F.count(F.lit(1)).alias("n"))


def weighted_hourly_bias(by_slot: DataFrame) -> DataFrame:
    """Hourly bias over day types, weighted by their rows."""
    return by_slot.groupBy(*GROUP, "hour").agg(
        (F.sum(F.col("bias_mean") * F.col("n")) / F.sum("n")).alias("bias_weighted"), F.sum("n").alias("n"))


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a correlation; null below four points or at +-1."""
    usable = (n >= MIN_MONTHS) & (F.abs(r) < 1)
    z, half = F.atanh(r), F.lit(Z_95) / F.sqrt(n - 3)
    return F.when(usable, F.tanh(z - half)), F.when(usable, F.tanh(z + half))


def bias_against_fleet(monthly: DataFrame, fleet: DataFrame, keys: Sequence[str] = GROUP,
                       measures: Sequence[str] = ("vehicles", "trips")) -> DataFrame:
    """Correlation of monthly bias with fleet size and trips, with intervals."""
    rows = monthly.join(fleet.select("month", *measures), "month")
    long = rows.select(*keys, "month", "bias_mean", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in measures])))
    group = [*keys, "measure"]
    ok = (F.count(F.lit(1)) >= MIN_MONTHS) & (F.count_distinct("x") > 1) & (F.count_distinct("bias_mean") > 1)
    out = _correlations(long, group, "x", "bias_mean").groupBy(*group).agg(
        F.count(F.lit(1)).alias("months"), F.when(ok, F.corr("x", "bias_mean")).alias("pearson"),
        F.when(ok, F.corr("_rx", "_ry")).alias("spearman"))
    low, high = fisher_interval(F.col("pearson"), F.col("months"))
    return out.withColumns({"ci_low": low, "ci_high": high})



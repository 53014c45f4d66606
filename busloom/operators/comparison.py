"""Models against each other: by regime, by fold, by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.functions.calendar import RARE_DAY_TYPES, WEEKDAY, regime
from busloom.functions.columns import percent, service_day, share
from busloom.operators.bias import scored

# Smallest demand a relative error is taken on, rows an hour needs.
MAPE_FLOOR = 10
MIN_HOUR_ROWS = 60

REGIME_KEYS = ("scenario", "target", "model", "route_id", "regime")


def regime_by_fold(predictions: DataFrame) -> DataFrame:
    rows = scored(predictions).withColumn("regime", regime(F.col("day_type")))
    return rows.groupBy(*REGIME_KEYS, "split", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y_real").alias("demand_mean"), F.avg(F.abs("error")).alias("mae"),
        F.avg("error").alias("bias"))


def regime_across_folds(by_fold: DataFrame) -> DataFrame:
    """Mean and deviation across folds, and the errors relative to demand."""
    out = by_fold.groupBy(*REGIME_KEYS).agg(
        F.count_distinct("fold").alias("folds"), F.sum("n").alias("n_total"), F.avg("demand_mean").alias("demand_mean"),
        F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"),
        F.avg("bias").alias("bias_mean"), F.stddev_samp("bias").alias("bias_std"))
    return out.withColumns({
        "mae_pct": percent(F.col("mae_mean"), F.col("demand_mean")),
        "bias_pct": percent(F.col("bias_mean"), F.col("demand_mean")),
        "bias_fraction": F.when(F.col("mae_mean") > 0, F.abs("bias_mean") / F.col("mae_mean")),
    })


def paired_models(by_fold: DataFrame, which: str = "ordinario") -> DataFrame:
    """Every pair of models fold by fold; bias is compared in size.

    The input has one row per model and fold: the join key (route, fold) matches as many
    rows as there are models.
    """
    rows = by_fold.filter(F.col("regime") == which).select(
        "scenario", "route_id", "fold", "model", F.inline(F.array(
            F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")),
            F.struct(F.lit("bias").alias("metric"), F.abs("bias").alias("value")))))
    other = rows.select("scenario", "route_id", "fold", "metric", F.col("model").alias("model_b"), F.col("value").alias("_b"))
    pairs = rows.withColumnsRenamed({"model": "model_a", "value": "_a"}).join(
        other, ["scenario", "route_id", "fold", "metric"]).filter("model_a < model_b")
    d = F.col("_a") - F.col("_b")
    return pairs.groupBy("scenario", "metric", "model_a", "model_b", "route_id").agg(
        F.count(F.lit(1)).alias("folds"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"),
        (100 * share(d < 0)).alias("a_wins_pct"))


def reference_table(across: DataFrame, weak: str, honest: str) -> DataFrame:
    """referencia_debil / referencia_honesta."""
    role = F.when(F.col("model") == weak, "referencia_debil").when(F.col("model") == honest, "referencia_honesta")
    return across.withColumn("role", role).filter(F.col("role").isNotNull()).select(
        "role", *REGIME_KEYS, "folds", "n_total", "mae_mean", "mae_pct", "bias_mean", "bias_fraction")


def objective_pairs(metrics: DataFrame, squared: str, absolute: str) -> DataFrame:
    """Two objectives side by side per fold and route, with the winner (or ``empate``)."""
    keys = ["scenario", "target", "fold", "route_id"]

    def side(model: str, tag: str) -> DataFrame:
        return metrics.filter((F.col("model") == model) & (F.col("split") == "validation")).select(
            *keys, F.col("mae").alias(f"mae_{tag}"), F.col("bias_mean").alias(f"bias_{tag}"))

    d = F.col("mae_l1") - F.col("mae_l2")
    return side(squared, "l2").join(side(absolute, "l1"), keys).withColumns({
        "mae_diff": d, "bias_abs_diff": F.abs("bias_l1") - F.abs("bias_l2"),
        "winner": F.when(d > 0, squared).when(d < 0, absolute).otherwise("empate")})


# ---------------------------------------------------------------- methods on shared days

def shared_days(predictions: DataFrame) -> DataFrame:
    """Scored rows of the (route, day) pairs that every model has."""
    rows = scored(predictions).withColumn("service_day", service_day("timestamp"))
    models = rows.agg(F.count_distinct("model").alias("m")).scalar()
    full = rows.groupBy("route_id", "service_day").agg(F.count_distinct("model").alias("_m")).withColumn("_all", models)
    return rows.join(full.filter("_m = _all").select("route_id", "service_day"), ["route_id", "service_day"], "left_semi")


def method_metrics(rows: DataFrame) -> DataFrame:
    """Per model and route: over all days, by regime and by day type, in one pass."""
    y, e = F.col("y_real"), F.col("error")
    big = y >= MAPE_FLOOR
    data = rows.withColumn("regime", F.when(F.col("day_type").isin(*RARE_DAY_TYPES), "raro").otherwise("ordinario"))
    model, route, reg, day = (F.col(c) for c in ("model", "route_id", "regime", "day_type"))
    return data.groupingSets([[model, route], [model, route, reg], [model, route, day]], "model", "route_id", "regime", "day_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("demand_mean"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.sum(y) != 0, 100 * F.sum(F.abs(e)) / F.sum(y)).alias("wape"), F.avg(e).alias("bias"),
        (100 * F.avg(F.when(big, F.abs(e) / y))).alias("mape_partial"), F.count(F.when(big, 1)).alias("n_mape"))


def by_day(predictions: DataFrame) -> DataFrame:
    """Per model, route and service day: error, bias and the day's amplitudes."""
    p, y = F.col("y_pred"), F.col("y_real")
    return scored(predictions).withColumn("service_day", service_day("timestamp")).groupBy("model", "route_id", "service_day").agg(
        F.min_by("day_type", "timestamp").alias("day_type"), F.count(F.lit(1)).alias("n"), F.avg(y).alias("demand_mean"),
        F.avg(F.abs("error")).alias("mae"), F.avg("error").alias("bias"), (F.max(p) - F.min(p)).alias("range_pred"),
        (F.max(y) - F.min(y)).alias("range_real"))


def two_methods(days: DataFrame, a: str, b: str) -> DataFrame:
    """Days both models have, side by side."""
    key = ["route_id", "service_day"]
    right = days.filter(F.col("model") == b).select(*key, F.col("mae").alias("mae_b"), F.col("bias").alias("bias_b"))
    return days.filter(F.col("model") == a).drop("model").withColumnsRenamed({"mae": "mae_a", "bias": "bias_a"}).join(right, key)


def two_method_means(pairs: DataFrame) -> DataFrame:
    """By route, and by route x day type (null day type = all)."""
    route, day = F.col("route_id"), F.col("day_type")
    return pairs.groupingSets([[route], [route, day]], "route_id", "day_type").agg(
        F.count(F.lit(1)).alias("days"), F.avg("demand_mean").alias("demand_mean"), F.avg("mae_a").alias("mae_a"),
        F.avg("mae_b").alias("mae_b"), F.avg("bias_a").alias("bias_a"), F.avg("bias_b").alias("bias_b"),
        (100 * share(F.col("mae_a") < F.col("mae_b"))).alias("a_wins_pct"))


def amplitude(days: DataFrame) -> DataFrame:
    """Mean daily range predicted and observed, and their ratio."""
    return days.groupBy("model", "route_id").agg(
        F.avg("range_pred").alias("range_pred"), F.avg("range_real").alias("range_real"),
        (F.avg("range_pred") / F.avg("range_real")).alias("ratio"))


def weekday_errors(days: DataFrame, model: str, routes: Sequence[str]) -> DataFrame:
    """Mean error by weekday on plain weekdays, one column per route."""
    return days.filter((F.col("model") == model) & (F.col("day_type") == WEEKDAY)).groupBy(
        F.weekday("service_day").alias("weekday")).pivot("route_id", list(routes)).agg(F.avg("mae"))


def worst_days(days: DataFrame, measure: str = "mae", top: int = 10) -> DataFrame:
    return days.orderBy(F.col(measure).desc(), "model", "route_id", "service_day").limit(top)


def holiday_detail(days: DataFrame) -> DataFrame:
    return days.filter(F.col("day_type").isin(*RARE_DAY_TYPES))


def _summary(e: Column, y: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg(y).alias("demand_mean"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
            F.when(F.avg(y) != 0, 100 * F.avg(e) / F.avg(y)).alias("bias_pct"), (100 * share(e > 0)).alias("over_pct")]


def final_test_summary(predictions: DataFrame) -> DataFrame:
    """Final test by regime and by day type, per model and route."""
    rows = scored(predictions.filter(F.col("split") == "test_final")).withColumn("regime", regime(F.col("day_type")))
    model, route, reg, day = (F.col(c) for c in ("model", "route_id", "regime", "day_type"))
    return rows.groupingSets([[model, route, reg], [model, route, day]], "model", "route_id", "regime", "day_type").agg(
        *_summary(F.col("error"), F.col("y_real")))


def hourly_bias_pivot(predictions: DataFrame, routes: Sequence[str]) -> DataFrame:
    return scored(predictions).groupBy("model", "hour").pivot("route_id", list(routes)).agg(F.avg("error"))


def weighted_comparison(days: DataFrame, a: str, b: str) -> DataFrame:
    """Row-weighted errors of two models by route and over all (GLOBAL), change and days won."""
    pairs = two_methods(days, a, b)
    n = F.col("n")
    out = pairs.rollup("route_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum(n).alias("observations"),
        (F.sum(F.col("mae_a") * n) / F.sum(n)).alias("mae_a"), (F.sum(F.col("mae_b") * n) / F.sum(n)).alias("mae_b"),
        F.count(F.when(F.col("mae_a") < F.col("mae_b"), 1)).alias("days_a_wins"))
    return out.withColumns({
        "route_id": F.coalesce("route_id", F.lit("GLOBAL")),
        "change_pct": F.when(F.col("mae_b") != 0, 100 * (F.col("mae_a") / F.col("mae_b") - 1))})


def shared_hours_bias(predictions: DataFrame, min_rows: int = MIN_HOUR_ROWS) -> DataFrame:
    """Hourly bias on hours that every route covers with enough rows."""
    hours = scored(predictions).groupBy("model", "route_id", "hour").agg(
        F.avg("error").alias("bias"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    routes = hours.groupBy("model").agg(F.count_distinct("route_id").alias("_all"))
    full = hours.groupBy("model", "hour").agg(F.count(F.lit(1)).alias("_n")).join(routes, "model").filter("_n = _all")
    return hours.join(full.select("model", "hour"), ["model", "hour"], "left_semi")


def day_balanced_mae(days: DataFrame) -> DataFrame:
    """Mean of the daily errors: each day counts once, whatever its length."""
    return days.groupBy("model", "route_id").agg(F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("days"))



"""Error metrics of long prediction frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.columns import count_if, percent

# Limits of the bias level.
HIGH_BIAS, MODERATE_BIAS = 0.5, 0.2

SUPPORT_KEYS = ("scenario", "target", "split", "fold", "route_id", "timestamp")

# Keys of the error tables.
TABLES = {
    "fold": ("fold", "model", "route_id"),
    "split": ("split", "model", "route_id"),
    "hour": ("hour", "model", "route_id"),
    "day_type": ("day_type", "model", "route_id"),
    "target": ("target", "model"),
    "scenario": ("scenario", "model"),
    "history_level": ("history_level", "model", "route_id"),
}


def evaluable() -> Column:
    return F.col("y_real").isNotNull() & F.col("y_pred").isNotNull()


def metric_columns() -> list[Column]:
    """Conditional aggregates; they combine map-side, whatever the keys."""
    y, p = F.col("y_real"), F.col("y_pred")
    ok = evaluable()
    e = F.when(ok, p - y)
    size = F.abs(y) + F.abs(p)
    smape = F.when(ok, F.when(size > 0, 2 * F.abs(p - y) / size).otherwise(0.0))
    total = F.sum(F.when(ok, F.abs(y)))
    mae, bias = F.avg(F.abs(e)), F.avg(e)
    return [
        count_if(ok).alias("n"), F.count(F.lit(1)).alias("n_total"), count_if(y.isNull()).alias("missing_y"),
        count_if(p.isNull()).alias("missing_pred"), mae.alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(smape)).alias("smape"), F.when(total > 0, 100 * F.sum(F.abs(e)) / total).alias("wape"),
        bias.alias("bias_mean"), F.abs(bias).alias("bias_abs"), F.when(mae > 0, F.abs(bias) / mae).alias("bias_to_mae_ratio"),
    ]


def metrics_by(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(*metric_columns())


def error_tables(predictions: DataFrame, tables: dict[str, Sequence[str]] = TABLES) -> DataFrame:
    """All error tables in one grouping-sets pass; ``table`` names each row's table."""
    names = list(dict.fromkeys(k for keys in tables.values() for k in keys))
    sets = [[F.col(k) for k in keys] for keys in tables.values()]
    out = predictions.groupingSets(sets, *names).agg(*metric_columns(), F.grouping_id(*names).alias("_id"))
    label = F
    for table, keys in tables.items():
        code = sum(0 if n in keys else 1 << (len(names) - 1 - i) for i, n in enumerate(names))
        label = label.when(F.col("_id") == code, table)
    return out.withColumn("table", label).drop("_id")


def common_support(predictions: DataFrame, keys: Sequence[str] = SUPPORT_KEYS) -> DataFrame:
    """Rows that every model can score; models are told apart by name."""
    models = predictions.agg(F.count_distinct("model").alias("m")).scalar()
    full = predictions.groupBy(*keys).agg(
        F.count_distinct("model").alias("_models"), count_if(evaluable()).alias("_n"))
    full = full.withColumn("_all", models).filter("_models = _all and _n = _all").select(*keys)
    return predictions.join(full, list(keys), "left_semi")


def common_support_metrics(predictions: DataFrame) -> DataFrame:
    return metrics_by(common_support(predictions), ["scenario", "target", "split", "model", "route_id"])


def bias_labels(metrics: DataFrame) -> DataFrame:
    """Sobreestima / subestima / sin_sesgo and alto / moderado / bajo."""
    b, ratio = F.col("bias_mean"), F.abs("bias_mean") / F.col("mae")
    return metrics.withColumns({
        "bias_direction": F.when(b > 0, "sobreestima").when(b < 0, "subestima").otherwise("sin_sesgo"),
        "bias_level": F.when(F.coalesce("mae", F.lit(0.0)) == 0, "No disponible").when(ratio >= HIGH_BIAS, "alto")
        .when(ratio >= MODERATE_BIAS, "moderado").otherwise("bajo"),
    })


def final_bias_summary(metrics: DataFrame) -> DataFrame:
    return bias_labels(metrics.filter(F.col("split") == "test_final"))


def coverage(predictions: DataFrame, keys: Sequence[str] = ("target", "scenario", "split", "route_id")) -> DataFrame:
    n = F.count(F.lit(1))
    return predictions.groupBy(*keys).agg(
        n.alias("n_rows"), F.count("y_real").alias("real_present"), F.count("y_pred").alias("pred_present"),
        count_if(evaluable()).alias("evaluable"), count_if(F.col("is_gap")).alias("gaps"),
        percent(count_if(evaluable()), n).alias("evaluable_pct"), percent(count_if(F.col("is_gap")), n).alias("gap_pct"))


def fallback_shares(predictions: DataFrame) -> DataFrame:
    """Share of each fallback level per model and route, where one is recorded."""
    keys = ["model", "target", "scenario", "route_id"]
    counts = predictions.filter(F.col("fallback_level").isNotNull()).groupBy(*keys, "fallback_level").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(*keys))))

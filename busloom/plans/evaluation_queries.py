"""Queries over prediction frames: metrics, bias, comparisons.

The predictions are made from the events' demand bins: the last bin, the one before it,
and the mean of earlier bins of the same slot.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from busloom.functions.calendar import day_type, is_holiday
from busloom.functions.columns import service_day
from busloom.operators import bias, comparison, fleet, metrics, series
from busloom.plans.common_sql import block, day_type_sql, sql
from busloom.plans.eda_queries import daily_series
from busloom.plans.registry import Query
from busloom.plans.series_queries import ready
from busloom.sources.tables import long_trips

ROUTES = ("click", "error", "purchase", "signup", "view")
_MODELS = {"last": "lag1", "second_last": "lag2", "slot_mean": "slot_mean"}

block("b30_v", f"""
  SELECT *, CAST(timestamp - INTERVAL 4 HOUR AS DATE) AS service_day, hour(timestamp) AS hour, {day_type_sql('timestamp')} AS day_type,
    CASE WHEN trips = 1 AND passengers_sum % 13 = 0 THEN NULL ELSE passengers_sum END AS y_real, trips = 1 AND passengers_sum % 13 = 0 AS gap,
    lag(passengers_sum, 1) OVER r AS lag1, lag(passengers_sum, 2) OVER r AS lag2, avg(passengers_sum) OVER s AS slot_mean, count(*) OVER s AS slot_n
  FROM bins_v WHERE gran_min = 30
  WINDOW r AS (PARTITION BY route_id ORDER BY timestamp),
    s AS (PARTITION BY route_id, hour(timestamp), minute(timestamp) ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
block("p_v", " UNION ALL ".join(
    f"""SELECT '{m}' AS model, 'base' AS scenario, 'passengers_sum' AS target, route_id, timestamp, service_day, hour, day_type, trips, gap AS is_gap, y_real, {c} AS y_pred,
    CAST(date_diff('day', DATE '2023-12-31', service_day) // 6 + 1 AS VARCHAR) AS fold, CASE WHEN service_day >= DATE '2024-01-24' THEN 'test_final' ELSE 'validation' END AS split,
    CASE WHEN trips <= 1 THEN 'bajo' WHEN trips <= 2 THEN 'medio' ELSE 'alto' END AS history_level,
    {"CASE WHEN slot_n >= 3 THEN '1' ELSE '5' END" if m == 'slot_mean' else 'CAST(NULL AS VARCHAR)'} AS fallback_level FROM b30_v""" for m, c in _MODELS.items()))
block("e_v", "SELECT *, y_pred - y_real AS error FROM p_v WHERE y_real IS NOT NULL AND y_pred IS NOT NULL")
_M = """count(*) FILTER (y_real IS NOT NULL AND y_pred IS NOT NULL) AS n, count(*) AS n_total, count(*) - count(y_real) AS missing_y, count(*) - count(y_pred) AS missing_pred,
  avg(abs(y_pred - y_real)) AS mae, sqrt(avg(pow(y_pred - y_real, 2))) AS rmse,
  100 * avg(CASE WHEN abs(y_real) + abs(y_pred) > 0 THEN 2 * abs(y_pred - y_real) / (abs(y_real) + abs(y_pred)) WHEN y_real IS NOT NULL AND y_pred IS NOT NULL THEN 0 END) AS smape,
  CASE WHEN sum(abs(y_real)) FILTER (y_pred IS NOT NULL) > 0 THEN 100 * sum(abs(y_pred - y_real)) / sum(abs(y_real)) FILTER (y_pred IS NOT NULL) END AS wape,
  avg(y_pred - y_real) AS bias_mean, abs(avg(y_pred - y_real)) AS bias_abs, abs(avg(y_pred - y_real)) / nullif(avg(abs(y_pred - y_real)), 0) AS bias_to_mae_ratio"""
_MSPEC = "n:i n_total:i missing_y:i missing_pred:i mae:f rmse:f smape:f wape:f bias_mean:f bias_abs:f bias_to_mae_ratio:f"
block("folds6_v", """SELECT split, fold, min(timestamp) AS eval_start, max(timestamp) AS eval_end, TIMESTAMP '2023-12-01 04:00:00' AS train_start,
  min(timestamp) AS train_end FROM p_v GROUP BY 1, 2""")
block("bf_v", """
  SELECT b.*, (epoch_us(eval_start) / 2e6 + epoch_us(eval_end) / 2e6 - epoch_us(train_start) / 2e6 - epoch_us(train_end) / 2e6) / 86400 AS distance_days
  FROM (SELECT scenario, target, model, route_id, split, fold, avg(error) AS bias_mean, count(*) AS n FROM e_v GROUP BY ALL) b
  JOIN folds6_v f ON f.split = b.split AND f.fold = b.fold""")
# Long daily predictions: mean of the previous 28 days.
block("dp_v", """
  SELECT 'base' AS scenario, 'passengers_sum' AS target, 'previous_days' AS model, route_id, timestamp, passengers_sum AS y_real,
    avg(passengers_sum) OVER (PARTITION BY route_id ORDER BY timestamp ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS y_pred FROM daily_v""")
block("mb_v", """SELECT scenario, target, model, route_id, CAST(date_trunc('month', timestamp) AS DATE) AS month, avg(y_pred - y_real) AS bias_mean, count(*) AS n
  FROM dp_v WHERE y_pred IS NOT NULL GROUP BY ALL""")
block("slot_bias_v", "SELECT scenario, target, model, route_id, day_type, hour, avg(error) AS bias_mean, count(*) AS n FROM e_v GROUP BY ALL")
block("rf_v", """
  SELECT scenario, target, model, route_id, CASE WHEN day_type LIKE 'FESTIVO%' THEN 'raro' ELSE 'ordinario' END AS regime, split, fold, count(*) AS n,
    avg(y_real) AS demand_mean, avg(abs(error)) AS mae, avg(error) AS bias FROM e_v GROUP BY ALL""")
block("ra_v", """
  SELECT *, 100 * mae_mean / demand_mean AS mae_pct, 100 * bias_mean / demand_mean AS bias_pct, abs(bias_mean) / mae_mean AS bias_fraction FROM (
    SELECT scenario, target, model, route_id, regime, count(DISTINCT fold) AS folds, sum(n) AS n_total, avg(demand_mean) AS demand_mean, avg(mae) AS mae_mean,
      stddev_samp(mae) AS mae_std, avg(bias) AS bias_mean, stddev_samp(bias) AS bias_std FROM rf_v GROUP BY ALL)""")
block("pd_v", """
  SELECT model, route_id, service_day, arg_min(day_type, timestamp) AS day_type, count(*) AS n, avg(y_real) AS demand_mean, avg(abs(error)) AS mae, avg(error) AS bias,
    max(y_pred) - min(y_pred) AS range_pred, max(y_real) - min(y_real) AS range_real FROM e_v GROUP BY 1, 2, 3""")
block("two_v", """SELECT a.route_id, a.service_day, a.day_type, a.n, a.demand_mean, a.mae AS mae_a, a.bias AS bias_a, b.mae AS mae_b, b.bias AS bias_b
  FROM pd_v a JOIN pd_v b ON b.route_id = a.route_id AND b.service_day = a.service_day WHERE a.model = 'slot_mean' AND b.model = 'last'""")
block("shared_v", """SELECT *, CASE WHEN day_type LIKE 'FESTIVO%' THEN 'raro' ELSE 'ordinario' END AS regime FROM e_v
  WHERE (route_id, service_day) IN (SELECT (route_id, service_day) FROM e_v GROUP BY route_id, service_day HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM e_v))""")
_MM = """count(*) AS n, avg(y_real) AS demand_mean, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, 100 * sum(abs(error)) / sum(y_real) AS wape, avg(error) AS bias,
  100 * avg(abs(error) / y_real) FILTER (y_real >= 10) AS mape_partial, count(*) FILTER (y_real >= 10) AS n_mape"""
_SUM = """count(*) AS n, avg(y_real) AS demand_mean, avg(abs(error)) AS mae, avg(error) AS bias, 100 * avg(error) / avg(y_real) AS bias_pct, 100.0 * avg(CAST(error > 0 AS INT)) AS over_pct"""


def predictions(s, d):
    b = series.demand_bins(ready(s, d), (30,))
    route = Window.partitionBy("route_id").orderBy("timestamp")
    slot = Window.partitionBy("route_id", F.hour("timestamp"), F.minute("timestamp")).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    v, trips = F.col("passengers_sum"), F.col("trips")
    gap = (trips == 1) & (v % 13 == 0)
    rows = b.withColumns({
        "lag1": F.lag(v, 1).over(route), "lag2": F.lag(v, 2).over(route), "slot_mean": F.avg(v).over(slot),
        "_slot_n": F.count(F.lit(1)).over(slot), "_day": service_day("timestamp")})
    models = F.array(*[F.struct(
        F.lit(m).alias("model"), F.col(c).cast("double").alias("y_pred"),
        (F.when(F.col("_slot_n") >= 3, "1").otherwise("5") if m == "slot_mean" else F.lit(None).cast("string")).alias("fallback_level"))
        for m, c in _MODELS.items()])
    return rows.select(
        "route_id", "timestamp", F.hour("timestamp").alias("hour"), "trips", gap.alias("is_gap"), F.when(~gap, v).alias("y_real"),
        F.lit("base").alias("scenario"), F.lit("passengers_sum").alias("target"),
        day_type(F.weekday("timestamp"), is_holiday(F.to_date("timestamp"))).alias("day_type"),
        (F.floor(F.date_diff("_day", F.lit("2023-12-31").cast("date")) / 6) + 1).cast("string").alias("fold"),
        F.when(F.col("_day") >= F.lit("2024-01-24").cast("date"), "test_final").otherwise("validation").alias("split"),
        F.when(trips <= 1, "bajo").when(trips <= 2, "medio").otherwise("alto").alias("history_level"),
        F.inline(models))


def folds(p):
    return p.groupBy("split", "fold").agg(
        F.min("timestamp").alias("eval_start"), F.max("timestamp").alias("eval_end"), F.min("timestamp").alias("train_end")).withColumn(
        "train_start", F.lit("2023-12-01 04:00:00").cast("timestamp_ntz"))


def daily_predictions(s, d):
    past = Window.partitionBy("route_id").orderBy("timestamp").rowsBetween(-28, -1)
    return daily_series(s, d).select(
        F.lit("base").alias("scenario"), F.lit("passengers_sum").alias("target"), F.lit("previous_days").alias("model"), "route_id", "timestamp",
        F.col("passengers_sum").alias("y_real"), F.avg("passengers_sum").over(past).alias("y_pred"))


def by_fold(s, d):
    p = predictions(s, d)
    return bias.bias_by_fold(p, folds(p))


def days(s, d):
    return comparison.by_day(predictions(s, d))


def _of(fn, *args):
    return lambda s, d: fn(predictions(s, d), *args)


def _days(fn, *args):
    return lambda s, d: fn(days(s, d), *args)


def _tables_sql() -> str:
    names = list(dict.fromkeys(k for keys in metrics.TABLES.values() for k in keys))
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", " + ", ".join(n if n in keys else f"NULL AS {n}" for n in names) + f", {_M} FROM p_v GROUP BY {', '.join(keys)}"
        for t, keys in metrics.TABLES.items())


_G = "scenario:s target:s model:s route_id:s "
_gk = "scenario, target, model, route_id"

QUERIES = [
    Query("v1_metrics", "model:s route_id:s " + _MSPEC, _of(metrics.metrics_by, ["model", "route_id"]),
          sql(f"SELECT model, route_id, {_M} FROM p_v GROUP BY 1, 2")),
    Query("v2_error_tables", "table:s fold:s split:s hour:i day_type:s target:s scenario:s history_level:s model:s route_id:s " + _MSPEC,
          _of(metrics.error_tables), sql(_tables_sql())),
    Query("v3_common_support", _G + "split:s " + _MSPEC, _of(metrics.common_support_metrics),
          sql(f"""SELECT {_gk}, split, {_M} FROM p_v WHERE (route_id, timestamp) IN (SELECT (route_id, timestamp) FROM e_v GROUP BY route_id, timestamp
                 HAVING count(*) = 3) GROUP BY {_gk}, split""")),
    Query("v4_final_bias", "model:s route_id:s bias_mean:f bias_direction:s bias_level:s",
          lambda s, d: metrics.final_bias_summary(metrics.metrics_by(predictions(s, d), ["split", "model", "route_id"])),
          sql("""SELECT *, CASE WHEN bias_mean > 0 THEN 'sobreestima' WHEN bias_mean < 0 THEN 'subestima' ELSE 'sin_sesgo' END AS bias_direction,
                 CASE WHEN coalesce(mae, 0) = 0 THEN 'No disponible' WHEN abs(bias_mean) / mae >= 0.5 THEN 'alto' WHEN abs(bias_mean) / mae >= 0.2 THEN 'moderado' ELSE 'bajo' END AS bias_level
                 FROM (SELECT model, route_id, avg(error) AS bias_mean, avg(abs(error)) AS mae FROM e_v WHERE split = 'test_final' GROUP BY 1, 2)""")),
    Query("v5_coverage", "target:s scenario:s split:s route_id:s n_rows:i real_present:i pred_present:i evaluable:i gaps:i evaluable_pct:f gap_pct:f",
          _of(metrics.coverage),
          sql("""SELECT *, 100.0 * evaluable / n_rows AS evaluable_pct, 100.0 * gaps / n_rows AS gap_pct FROM (SELECT target, scenario, split, route_id, count(*) AS n_rows,
                 count(y_real) AS real_present, count(y_pred) AS pred_present, count(y_real + y_pred) AS evaluable, count(*) FILTER (is_gap) AS gaps FROM p_v GROUP BY 1, 2, 3, 4)""")),
    Query("v6_bias_decomposition", _G + "split:s n:i bias_mean:f bias_median:f error_std:f over_pct:f mae:f bias_to_mae_ratio:f dispersion_fraction:f",
          _of(bias.bias_decomposition),
          sql(f"""SELECT *, greatest(0, 1 - bias_to_mae_ratio) AS dispersion_fraction FROM (SELECT {_gk}, split, count(*) AS n, avg(error) AS bias_mean, median(error) AS bias_median,
                 stddev_samp(error) AS error_std, 100.0 * avg(CAST(error > 0 AS INT)) AS over_pct, avg(abs(error)) AS mae, abs(avg(error)) / avg(abs(error)) AS bias_to_mae_ratio
                 FROM e_v GROUP BY {_gk}, split)""")),
    Query("v7_bias_by_fold", _G + "split:s fold:s n:i bias_mean:f distance_days:f", by_fold, sql("SELECT * FROM bf_v")),
    Query("v8_distance_correlation", _G + "folds:i pearson:f spearman:f",
          lambda s, d: bias.distance_bias_correlation(by_fold(s, d)),
          sql(f"""SELECT {_gk}, count(*) AS folds, corr(distance_days, bias_mean) AS pearson, corr(rx, ry) AS spearman FROM (SELECT *,
                 rank() OVER (PARTITION BY {_gk} ORDER BY distance_days) AS rx, rank() OVER (PARTITION BY {_gk} ORDER BY bias_mean) AS ry FROM bf_v) GROUP BY {_gk}""")),
    Query("v9_monthly_bias", _G + "month:d bias_mean:f n:i", lambda s, d: bias.monthly_bias(daily_predictions(s, d)), sql("SELECT * FROM mb_v")),
    Query("v9_bias_by_slot", _G + "day_type:s hour:i bias_mean:f n:i", _of(bias.bias_by_slot), sql("SELECT * FROM slot_bias_v")),
    Query("v9_weighted_hourly_bias", _G + "hour:i bias_weighted:f n:i", lambda s, d: bias.weighted_hourly_bias(bias.bias_by_slot(predictions(s, d))),
          sql(f"SELECT {_gk}, hour, sum(bias_mean * n) / sum(n) AS bias_weighted, sum(n) AS n FROM slot_bias_v GROUP BY {_gk}, hour")),
    Query("v10_bias_against_fleet", _G + "measure:s months:i pearson:f spearman:f ci_low:f ci_high:f",
          lambda s, d: bias.bias_against_fleet(bias.monthly_bias(daily_predictions(s, d)), fleet.monthly_fleet(long_trips(s, d))),
          sql(f"""SELECT *, (exp(2 * (atanh(pearson) - h)) - 1) / (exp(2 * (atanh(pearson) - h)) + 1) AS ci_low, (exp(2 * (atanh(pearson) + h)) - 1) / (exp(2 * (atanh(pearson) + h)) + 1) AS ci_high
                 FROM (SELECT {_gk}, measure, count(*) AS months, corr(x, bias_mean) AS pearson, corr(rx, ry) AS spearman, 1.959963984540054 / sqrt(count(*) - 3) AS h FROM (
                 SELECT *, rank() OVER (PARTITION BY {_gk}, measure ORDER BY x) + (count(*) OVER (PARTITION BY {_gk}, measure, x) - 1) / 2.0 AS rx,
                   rank() OVER (PARTITION BY {_gk}, measure ORDER BY bias_mean) + (count(*) OVER (PARTITION BY {_gk}, measure, bias_mean) - 1) / 2.0 AS ry FROM (
                 SELECT b.*, 'vehicles' AS measure, m.vehicles AS x FROM mb_v b JOIN monthly_v m ON m.month = b.month
                 UNION ALL SELECT b.*, 'trips', m.trips FROM mb_v b JOIN monthly_v m ON m.month = b.month)) GROUP BY {_gk}, measure)""")),
    Query("v11_fallback_shares", "model:s target:s scenario:s route_id:s fallback_level:s n:i pct:f", _of(metrics.fallback_shares),
          sql("""SELECT model, target, scenario, route_id, fallback_level, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY model, route_id) AS pct
                 FROM p_v WHERE fallback_level IS NOT NULL GROUP BY 1, 2, 3, 4, 5""")),
    Query("v12_regime_by_fold", _G + "regime:s split:s fold:s n:i demand_mean:f mae:f bias:f", _of(comparison.regime_by_fold), sql("SELECT * FROM rf_v")),
    Query("v12_regime_across_folds", _G + "regime:s folds:i n_total:i demand_mean:f mae_mean:f mae_std:f bias_mean:f bias_std:f mae_pct:f bias_pct:f bias_fraction:f",
          lambda s, d: comparison.regime_across_folds(comparison.regime_by_fold(predictions(s, d))), sql("SELECT * FROM ra_v")),
    Query("v13_paired_models", "scenario:s metric:s model_a:s model_b:s route_id:s folds:i diff_mean:f diff_std:f a_wins_pct:f",
          lambda s, d: comparison.paired_models(comparison.regime_by_fold(predictions(s, d)).filter("split = 'validation'")),
          sql("""SELECT a.scenario, m.metric, a.model AS model_a, b.model AS model_b, a.route_id, count(*) AS folds, avg(d) AS diff_mean, stddev_samp(d) AS diff_std,
                 100.0 * avg(CAST(d < 0 AS INT)) AS a_wins_pct FROM rf_v a JOIN rf_v b ON a.route_id = b.route_id AND a.fold = b.fold AND a.split = b.split AND a.regime = b.regime AND a.model < b.model
                 CROSS JOIN LATERAL (SELECT 'mae' AS metric, a.mae - b.mae AS d UNION ALL SELECT 'bias', abs(a.bias) - abs(b.bias)) m
                 WHERE a.regime = 'ordinario' AND a.split = 'validation' GROUP BY 1, 2, 3, 4, 5""")),
    Query("v14_reference_table", "role:s model:s route_id:s regime:s folds:i n_total:i mae_mean:f mae_pct:f bias_mean:f bias_fraction:f",
          lambda s, d: comparison.reference_table(comparison.regime_across_folds(comparison.regime_by_fold(predictions(s, d))), "last", "slot_mean"),
          sql("""SELECT *, CASE WHEN model = 'last' THEN 'referencia_debil' ELSE 'referencia_honesta' END AS role FROM ra_v WHERE model IN ('last', 'slot_mean')""")),
    Query("v15_objective_pairs", "scenario:s target:s fold:s route_id:s mae_l2:f mae_l1:f mae_diff:f bias_abs_diff:f winner:s",
          lambda s, d: comparison.objective_pairs(metrics.metrics_by(predictions(s, d), ["scenario", "target", "split", "fold", "model", "route_id"]), "last", "second_last"),
          sql("""SELECT a.scenario, a.target, a.fold, a.route_id, a.mae AS mae_l2, b.mae AS mae_l1, b.mae - a.mae AS mae_diff, abs(b.bias) - abs(a.bias) AS bias_abs_diff,
                 CASE WHEN b.mae > a.mae THEN 'last' WHEN b.mae < a.mae THEN 'second_last' ELSE 'empate' END AS winner
                 FROM (SELECT scenario, target, fold, route_id, avg(abs(error)) AS mae, avg(error) AS bias FROM e_v WHERE model = 'last' AND split = 'validation' GROUP BY ALL) a
                 JOIN (SELECT scenario, target, fold, route_id, avg(abs(error)) AS mae, avg(error) AS bias FROM e_v WHERE model = 'second_last' AND split = 'validation' GROUP BY ALL) b
                 USING (scenario, target, fold, route_id)""").replace("a.scenario, a.target, a.fold, a.route_id, a.mae", "scenario, target, fold, route_id, a.mae")),
    Query("v16_method_metrics", "model:s route_id:s regime:s day_type:s n:i demand_mean:f mae:f rmse:f wape:f bias:f mape_partial:f n_mape:i",
          lambda s, d: comparison.method_metrics(comparison.shared_days(predictions(s, d))),
          sql(f"""SELECT model, route_id, NULL AS regime, NULL AS day_type, {_MM} FROM shared_v GROUP BY 1, 2
                 UNION ALL SELECT model, route_id, regime, NULL, {_MM} FROM shared_v GROUP BY 1, 2, 3
                 UNION ALL SELECT model, route_id, NULL, day_type, {_MM} FROM shared_v GROUP BY 1, 2, day_type""")),
    Query("v17_two_methods", "route_id:s day_type:s days:i demand_mean:f mae_a:f mae_b:f bias_a:f bias_b:f a_wins_pct:f",
          lambda s, d: comparison.two_method_means(comparison.two_methods(days(s, d), "slot_mean", "last")),
          sql("""SELECT route_id, day_type, count(*) AS days, avg(demand_mean) AS demand_mean, avg(mae_a) AS mae_a, avg(mae_b) AS mae_b, avg(bias_a) AS bias_a, avg(bias_b) AS bias_b,
                 100.0 * avg(CAST(mae_a < mae_b AS INT)) AS a_wins_pct FROM two_v GROUP BY GROUPING SETS ((route_id), (route_id, day_type))""")),
    Query("v18_amplitude", "model:s route_id:s range_pred:f range_real:f ratio:f", _days(comparison.amplitude),
          sql("SELECT model, route_id, avg(range_pred) AS range_pred, avg(range_real) AS range_real, avg(range_pred) / avg(range_real) AS ratio FROM pd_v GROUP BY 1, 2")),
    Query("v19_weekday_errors", "weekday:i " + " ".join(f"{r}:f" for r in ROUTES), _days(comparison.weekday_errors, "last", ROUTES),
          sql("SELECT isodow(service_day) - 1 AS weekday, " + ", ".join(f"avg(mae) FILTER (route_id = '{r}') AS \"{r}\"" for r in ROUTES)
              + " FROM pd_v WHERE model = 'last' AND day_type = 'LABORAL' GROUP BY 1")),
    Query("v19_worst_days", "model:s route_id:s service_day:d mae:f", _days(comparison.worst_days),
          sql("SELECT * FROM pd_v ORDER BY mae DESC, model, route_id, service_day LIMIT 10")),
    Query("v19_holiday_detail", "model:s route_id:s service_day:d day_type:s n:i mae:f bias:f", _days(comparison.holiday_detail),
          sql("SELECT * FROM pd_v WHERE day_type LIKE 'FESTIVO%'")),
    Query("v20_final_test_summary", "model:s route_id:s regime:s day_type:s n:i demand_mean:f mae:f bias:f bias_pct:f over_pct:f", _of(comparison.final_test_summary),
          sql(f"""SELECT model, route_id, CASE WHEN day_type LIKE 'FESTIVO%' THEN 'raro' ELSE 'ordinario' END AS regime, NULL AS day_type, {_SUM} FROM e_v WHERE split = 'test_final' GROUP BY 1, 2, 3
                 UNION ALL SELECT model, route_id, NULL, day_type, {_SUM} FROM e_v WHERE split = 'test_final' GROUP BY 1, 2, day_type""")),
    Query("v20_hourly_bias_pivot", "model:s hour:i " + " ".join(f"{r}:f" for r in ROUTES), _of(comparison.hourly_bias_pivot, ROUTES),
          sql("SELECT model, hour, " + ", ".join(f"avg(error) FILTER (route_id = '{r}') AS \"{r}\"" for r in ROUTES) + " FROM e_v GROUP BY 1, 2")),
    Query("v20_worst_days_by_bias", "model:s route_id:s service_day:d bias:f", _days(comparison.worst_days, "bias"),
          sql("SELECT * FROM pd_v ORDER BY bias DESC, model, route_id, service_day LIMIT 10")),
    Query("v21_weighted_comparison", "route_id:s days:i observations:i mae_a:f mae_b:f days_a_wins:i change_pct:f", _days(comparison.weighted_comparison, "slot_mean", "last"),
          sql("""SELECT *, 100 * (mae_a / mae_b - 1) AS change_pct FROM (SELECT coalesce(route_id, 'GLOBAL') AS route_id, count(*) AS days, sum(n) AS observations,
                 sum(mae_a * n) / sum(n) AS mae_a, sum(mae_b * n) / sum(n) AS mae_b, count(*) FILTER (mae_a < mae_b) AS days_a_wins FROM two_v GROUP BY ROLLUP (two_v.route_id))""")),
    Query("v22_shared_hours_bias", "model:s route_id:s hour:i bias:f n:i", _of(comparison.shared_hours_bias, 15),
          sql("""WITH h AS (SELECT model, route_id, hour, avg(error) AS bias, count(*) AS n FROM e_v GROUP BY 1, 2, 3 HAVING count(*) >= 15)
                 SELECT * FROM h WHERE (model, hour) IN (SELECT (model, hour) FROM h GROUP BY model, hour
                 HAVING count(*) = (SELECT count(DISTINCT route_id) FROM h h2 WHERE h2.model = h.model))""").replace("\nWITH h AS", ",\nh AS")),
    Query("v23_day_balanced_mae", "model:s route_id:s mae:f days:i", _days(comparison.day_balanced_mae),
          sql("SELECT model, route_id, avg(mae) AS mae, count(*) AS days FROM pd_v GROUP BY 1, 2")),
]

"""Queries over features, splits and forecasting baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from busloom.functions.calendar import DAY_TYPES
from busloom.functions.columns import service_day
from busloom.operators import baselines, features, sequences, splits
from busloom.plans.common_sql import block, sql
from busloom.plans.registry import Query
from busloom.plans.stages import staged
from busloom.plans.series_queries import ready, series_30
from busloom.sources.tables import trips

# The events span 30 days: fold lengths in days.
PLAN = splits.SplitPlan(min_train_days=14, validation_days=2, step_days=2, test_days=5)
WINDOWS = (4, 8)
CUTS = ("2024-01-17", "2024-01-20", "2024-01-23")
SWEEP_WINDOWS = (7, 14, 28, None)

# ---------------------------------------------------------------- SQL blocks

block("targets_v", """
  SELECT *, CASE WHEN trips > 0 THEN passengers_sum / trips END AS passengers_per_trip, NOT is_gap AS demand_observed,
    NOT is_gap AND coalesce(trips > 0, false) AS per_trip_observed, CAST(timestamp - INTERVAL 4 HOUR AS DATE) AS service_day, minute // 30 AS slot
  FROM series_v WHERE gran_min = 30""")


def _lag_sql(m: str, lags, stds) -> list[str]:
    out = [f"lag({m}, {k}) OVER w AS {m}_lag_{k}" for k in lags]
    out += [f"avg({m}) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {m}_mean_{k}" for k in features.MEAN_WINDOWS]
    return out + [f"stddev_samp({m}) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) AS {m}_std_{k}" for k in stds]


_LAGS = (_lag_sql("passengers_sum", features.LAGS, features.STD_WINDOWS)
         + _lag_sql("passengers_per_trip", features.LAGS, features.STD_WINDOWS)
         + _lag_sql("trips", features.TRIP_LAGS, ()))
_LAG_NAMES = [c.rsplit(" AS ", 1)[1] for c in _LAGS]
block("lags_v", f"SELECT *, {', '.join(_LAGS)} FROM targets_v WINDOW w AS (PARTITION BY route_id ORDER BY timestamp)")
block("table_v", "SELECT * FROM lags_v WHERE in_hours")
block("scen_v", " UNION ALL ".join(
    f"""SELECT '{s.name}' AS scenario, '{s.target}' AS target, '{s.feature_set}' AS feature_set, route_id, timestamp, service_day, day_type, hour, slot, is_gap,
    gap_type, trips, trips_lag_48, {s.target} AS y, {'per_trip_observed' if s.target == features.PER_TRIP else 'demand_observed'} AS observed,
    {s.target}_lag_1 AS y_lag_1, {s.target}_lag_48 AS y_lag_48, {s.target}_lag_336 AS y_lag_336 FROM table_v""" for s in features.SCENARIOS))
_b = "date_trunc('day', {0}) + INTERVAL 4 HOUR"


def _up(ts: str) -> str:
    return f"CASE WHEN {ts} <= {_b.format(ts)} THEN {_b.format(ts)} ELSE {_b.format(ts)} + INTERVAL 1 DAY END"


def _down(ts: str) -> str:
    return f"CASE WHEN {ts} >= {_b.format(ts)} THEN {_b.format(ts)} ELSE {_b.format(ts)} - INTERVAL 1 DAY END"


block("bounds_v", f"""
  SELECT *, {_up('start_raw')} AS lo, {_down('end_raw')} AS hi, {_up('test_raw')} AS test_lo FROM (
    SELECT min(timestamp) AS start_raw, max(timestamp) + INTERVAL 30 MINUTE AS end_raw, max(timestamp) - INTERVAL 5 DAY AS test_raw FROM table_v)""")
block("folds_v", """
  SELECT k + 1 AS fold_no, 'validation' AS split, CAST(k + 1 AS VARCHAR) AS fold, lo AS train_start, lo + to_days(CAST(14 + 2 * k AS INT)) AS train_end,
    lo + to_days(CAST(14 + 2 * k AS INT)) AS eval_start, lo + to_days(CAST(16 + 2 * k AS INT)) AS eval_end
  FROM bounds_v, range(0, 400) AS r(k) WHERE lo + to_days(CAST(16 + 2 * k AS INT)) <= test_lo
  UNION ALL SELECT (SELECT count(*) FROM bounds_v, range(0, 400) AS r(k) WHERE lo + to_days(CAST(16 + 2 * k AS INT)) <= test_lo) + 1,
    'test_final', 'test_final', lo, test_lo, test_lo, hi FROM bounds_v""")
block("train_v", """SELECT s.*, f.fold_no, f.train_end FROM scen_v s JOIN folds_v f ON s.timestamp >= f.train_start AND s.timestamp < f.train_end
  WHERE s.observed AND s.y IS NOT NULL""")
block("eval_v", "SELECT s.*, f.fold_no, f.fold, f.split FROM scen_v s JOIN folds_v f ON s.timestamp >= f.eval_start AND s.timestamp < f.eval_end")
block("hist_v", """
  SELECT e.*, coalesce(a.m, b.m, c.m, d.m) AS y_pred FROM eval_v e
  LEFT JOIN (SELECT scenario, fold_no, route_id, day_type, slot, avg(y) AS m FROM train_v GROUP BY ALL) a
    ON a.scenario = e.scenario AND a.fold_no = e.fold_no AND a.route_id = e.route_id AND a.day_type = e.day_type AND a.slot = e.slot
  LEFT JOIN (SELECT scenario, fold_no, route_id, slot, avg(y) AS m FROM train_v GROUP BY ALL) b
    ON b.scenario = e.scenario AND b.fold_no = e.fold_no AND b.route_id = e.route_id AND b.slot = e.slot
  LEFT JOIN (SELECT scenario, fold_no, route_id, avg(y) AS m FROM train_v GROUP BY ALL) c ON c.scenario = e.scenario AND c.fold_no = e.fold_no AND c.route_id = e.route_id
  LEFT JOIN (SELECT scenario, fold_no, avg(y) AS m FROM train_v GROUP BY ALL) d ON d.scenario = e.scenario AND d.fold_no = e.fold_no""")
_w = " UNION ALL ".join(
    f"SELECT t.*, {w} AS win, timestamp >= train_end - INTERVAL {w} DAY AS near FROM train_v t WHERE timestamp >= train_end - INTERVAL {2 * w} DAY" for w in WINDOWS)
block("win_v", _w)
_k = "scenario, fold_no, win"
block("roll_v", f"""
  SELECT e.*, win, coalesce(v1, v2, v3, v4, v5, v6) AS y_pred, CASE WHEN v1 IS NOT NULL THEN '1' WHEN v2 IS NOT NULL THEN '2' WHEN v3 IS NOT NULL THEN '3'
    WHEN v4 IS NOT NULL THEN '4' ELSE '5' END AS fallback_level
  FROM (SELECT * FROM eval_v CROSS JOIN (VALUES {', '.join(f'({w})' for w in WINDOWS)}) AS ww(win)) e
  LEFT JOIN (SELECT {_k}, route_id, day_type, slot, CASE WHEN count(*) FILTER (near) >= 3 THEN avg(y) FILTER (near) END AS v1,
      CASE WHEN count(*) >= 3 THEN avg(y) END AS v2 FROM win_v GROUP BY ALL) a USING ({_k}, route_id, day_type, slot)
  LEFT JOIN (SELECT {_k}, route_id, day_type, slot, avg(y) AS v3 FROM (
      SELECT {_k}, route_id, day_type, (slot + 1) % 48 AS slot, y FROM win_v WHERE near UNION ALL
      SELECT {_k}, route_id, day_type, (slot + 47) % 48, y FROM win_v WHERE near) GROUP BY {_k}, route_id, day_type, slot HAVING count(*) >= 3) b USING ({_k}, route_id, day_type, slot)
  LEFT JOIN (SELECT {_k}, route_id, slot, avg(y) AS v4 FROM win_v WHERE near GROUP BY {_k}, route_id, slot HAVING count(*) >= 3) c USING ({_k}, route_id, slot)
  LEFT JOIN (SELECT {_k}, route_id, coalesce(avg(y) FILTER (near), avg(y)) AS v5 FROM win_v GROUP BY {_k}, route_id) d USING ({_k}, route_id)
  LEFT JOIN (SELECT {_k}, coalesce(avg(y) FILTER (near), avg(y)) AS v6 FROM win_v GROUP BY {_k}) g USING ({_k})""")
block("level_v", """
  SELECT e.*, CASE WHEN trips_lag_48 <= lo THEN 'bajo' WHEN trips_lag_48 <= hi THEN 'medio' WHEN trips_lag_48 > hi THEN 'alto' END AS history_level
  FROM eval_v e LEFT JOIN (SELECT scenario, fold_no, quantile_cont(trips_lag_48, 1.0 / 3) AS lo, quantile_cont(trips_lag_48, 2.0 / 3) AS hi
    FROM train_v GROUP BY 1, 2) q ON q.scenario = e.scenario AND q.fold_no = e.fold_no""")
_pred = "scenario, route_id, timestamp, fold, split, day_type, hour, is_gap, trips, y AS y_real"
block("pred_v", f"""
  SELECT p.*, l.history_level, y_pred - y_real AS error FROM (
    SELECT 'historical_average_route_day_type_slot' AS model, {_pred}, y_pred, NULL AS fallback_level FROM hist_v
    UNION ALL SELECT 'rolling_average_' || win || 'd', {_pred}, y_pred, fallback_level FROM roll_v
    UNION ALL SELECT 'naive', {_pred}, y_lag_1, NULL FROM eval_v UNION ALL SELECT 'seasonal_naive_daily', {_pred}, y_lag_48, NULL FROM eval_v
    UNION ALL SELECT 'seasonal_naive_weekly', {_pred}, y_lag_336, NULL FROM eval_v) p
  LEFT JOIN level_v l ON l.scenario = p.scenario AND l.route_id = p.route_id AND l.timestamp = p.timestamp""")
block("obs_v", "SELECT * FROM table_v WHERE demand_observed")
block("walk_v", """
  SELECT route_id, timestamp, service_day, day_type, slot, y AS y_real, cell IS NULL AS no_precedent, coalesce(cell, route) AS y_pred FROM (
    SELECT o.route_id, o.timestamp, o.service_day, o.day_type, o.slot, o.passengers_sum AS y,
      (SELECT avg(p.passengers_sum) FROM obs_v p WHERE p.route_id = o.route_id AND p.day_type = o.day_type AND p.slot = o.slot
        AND p.service_day BETWEEN o.service_day - 14 AND o.service_day - 1) AS cell, r.route
    FROM obs_v o JOIN (SELECT a.route_id, a.service_day, avg(b.passengers_sum) AS route FROM (SELECT DISTINCT route_id, service_day FROM obs_v) a
      LEFT JOIN obs_v b ON b.route_id = a.route_id AND b.service_day BETWEEN a.service_day - 14 AND a.service_day - 1 GROUP BY 1, 2) r
      ON r.route_id = o.route_id AND r.service_day = o.service_day)""")
block("walk_days_v", """
  SELECT * FROM (SELECT route_id, service_day, arg_min(day_type, timestamp) AS day_type, count(*) AS n, avg(y_real) AS demand_mean, avg(abs(y_pred - y_real)) AS mae,
    avg(y_pred - y_real) AS bias, max(y_pred) - min(y_pred) AS range_pred, max(y_real) - min(y_real) AS range_real, count(*) FILTER (no_precedent) AS no_precedent
    FROM walk_v WHERE y_pred IS NOT NULL GROUP BY 1, 2) WHERE n >= 8""")
_pairs = ", ".join(f"(DATE '{c}', {'NULL' if w is None else w})" for c in CUTS for w in SWEEP_WINDOWS)
block("cut_pairs_v", f"""
  SELECT * FROM (SELECT cut, win, CASE WHEN win IS NULL THEN first ELSE cut - win END AS lo, first
    FROM (SELECT cut, CAST(win AS INT) AS win FROM (VALUES {_pairs}) AS p(cut, win)), (SELECT min(service_day) AS first FROM obs_v)) WHERE lo >= first""")
block("sweep_v", """
  SELECT cut, win AS window_days, regime, count(e) AS n, avg(abs(e)) AS mae, avg(e) AS bias FROM (
    SELECT p.cut, p.win, CASE WHEN o.day_type LIKE 'FESTIVO%' THEN 'raro' ELSE 'ordinario' END AS regime, coalesce(
      (SELECT avg(t.passengers_sum) FROM obs_v t WHERE t.route_id = o.route_id AND t.day_type = o.day_type AND t.slot = o.slot AND t.service_day >= p.lo AND t.service_day < p.cut),
      (SELECT avg(t.passengers_sum) FROM obs_v t WHERE t.route_id = o.route_id AND t.service_day >= p.lo AND t.service_day < p.cut)) - o.passengers_sum AS e
    FROM obs_v o JOIN cut_pairs_v p ON o.service_day >= p.cut AND o.service_day < p.cut + 14) GROUP BY 1, 2, 3""")
block("day_slots_v", """
  SELECT route_id, service_day, count(*) AS n, arg_min(day_type, timestamp) AS day_type, arg_min(weekday, timestamp) AS weekday,
    list(passengers_sum ORDER BY timestamp) AS vals, list((minute - 240) // 30 ORDER BY timestamp) AS places FROM obs_v GROUP BY 1, 2""")
block("ordinal_v", """
  SELECT *, [CASE WHEN i <= n THEN vals[i] ELSE 0 END FOR i IN range(1, 29)] AS vv, [CASE WHEN i <= n THEN 1.0 ELSE 0.0 END FOR i IN range(1, 29)] AS mm FROM day_slots_v""")


# ---------------------------------------------------------------- Spark frames

def grid(s, d):
    return features.add_targets(series_30(s, d))


@staged
def table(s, d):
    out = features.modeling_table(series_30(s, d))
    return out.withColumn("service_day", service_day("timestamp"))


@staged
def scenario_table(s, d):
    return features.scenario_rows(table(s, d))


@staged
def folds_table(s, d):
    return splits.make_folds(scenario_table(s, d), PLAN)


@staged
def assigned_rows(s, d):
    return splits.assign_folds(baselines.with_slot(scenario_table(s, d)), folds_table(s, d))


def assigned(s, d):
    return assigned_rows(s, d), folds_table(s, d)


@staged
def predictions(s, d):
    return baselines.backtest(scenario_table(s, d), folds_table(s, d), WINDOWS)


def _on(fn):
    """A query over (assigned rows, folds)."""
    return lambda s, d: fn(*assigned(s, d))


def _text(col: str):
    return F.array_join(F.transform(col, lambda v: F.format_string("%.4f", v)), ",").alias(col)


def ordinal(s, d):
    return sequences.ordinal_sequences(table(s, d))


def _sum_products(days):
    """Array columns told by length, sum and position-weighted sum."""
    def at(c: str):
        return F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)

    def total(c: str):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    names = [n for n, t in days.dtypes if t.startswith("array")]
    return days.select(*[c for c in days.columns if c not in names], *[
        f(n).alias(f"{n}_{tag}") for n in names for tag, f in (("len", F.size), ("sum", total), ("dot", at))])


def _sums_sql(col: str, name: str) -> str:
    return (f"len({col}) AS {name}_len, list_sum({col}) AS {name}_sum, "
            f"list_sum([x * i FOR x, i IN {col}]) AS {name}_dot")


def _sum_spec(*names: str) -> str:
    return " ".join(f"{n}_len:i {n}_sum:f {n}_dot:f" for n in names)


_PAIR = """SELECT c.route_id, c.service_day, c.day_type, c.weekday, {0} FROM ordinal_v c {1} WHERE c.n >= 8 {2}"""
_FOLD = "fold_no:i split:s fold:s train_start:t train_end:t eval_start:t eval_end:t"
_ROW = "scenario:s route_id:s timestamp:t "
_CHECK = [f"passengers_sum_lag_{k}" for k in features.LAGS] + [f"passengers_sum_mean_{k}" for k in features.MEAN_WINDOWS] + [
    f"passengers_sum_std_{k}" for k in features.STD_WINDOWS]
_NUMERIC_EXCLUDED = ("gran_min", "passengers_sum", "passengers_per_trip", "trips", "demand_observed", "per_trip_observed", "is_gap", "in_hours",
                     "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "is_weekend", "is_holiday", "quarter")


def _numeric(s, d):
    t = table(s, d)
    names = features.numeric_features(t, _NUMERIC_EXCLUDED)
    return t.select("route_id", "timestamp", F.lit(len(names)).alias("n_features"), F.col("passengers_sum_lag_48"), F.col("passengers_per_trip_lag_336"))


QUERIES = [
    Query("f1_targets", "route_id:s timestamp:t passengers_per_trip:f demand_observed:b per_trip_observed:b", grid, sql("SELECT * FROM targets_v")),
    Query("f2_lags", "route_id:s timestamp:t " + " ".join(f"{n}:f" for n in _LAG_NAMES if "_lag_" in n),
          lambda s, d: features.add_lags(grid(s, d)), sql("SELECT * FROM lags_v")),
    Query("f3_rolling", "route_id:s timestamp:t " + " ".join(f"{n}:f" for n in _LAG_NAMES if "_lag_" not in n),
          lambda s, d: features.add_lags(grid(s, d)), sql("SELECT * FROM lags_v")),
    Query("f4_cycles", "route_id:s timestamp:t slot_label:s hour_sin:f hour_cos:f weekday_sin:f weekday_cos:f",
          lambda s, d: features.add_cycles(grid(s, d)),
          sql("""SELECT route_id, timestamp, strftime(timestamp, '%H:%M') AS slot_label, sin(2 * pi() * minute / 1440) AS hour_sin, cos(2 * pi() * minute / 1440) AS hour_cos,
                 sin(2 * pi() * weekday / 7) AS weekday_sin, cos(2 * pi() * weekday / 7) AS weekday_cos FROM targets_v""")),
    Query("f5_intervals", "route_id:s interval_start:t interval_end:t cutoff_ts:t", lambda s, d: features.add_interval(grid(s, d)),
          sql("SELECT route_id, timestamp AS interval_start, timestamp + INTERVAL 30 MINUTE AS interval_end, timestamp AS cutoff_ts FROM targets_v")),
    Query("f6_modeling_table", "route_id:s timestamp:t is_gap:b day_type:s passengers_sum:f passengers_sum_lag_1:f",
          lambda s, d: features.modeling_table(series_30(s, d), first_days=20),
          sql("""SELECT * FROM table_v WHERE timestamp < (SELECT min(timestamp) FROM table_v) + INTERVAL 20 DAY""")),
    Query("f7_leakage_check", "feature:s checked:i mismatches:i", lambda s, d: features.leakage_check(features.add_lags(grid(s, d))),
          sql(" UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS checked, 0 AS mismatches FROM targets_v" for n in _CHECK))),
    Query("f8_scenarios", _ROW + "target:s feature_set:s y:f observed:b y_lag_1:f y_lag_48:f", scenario_table, sql("SELECT * FROM scen_v")),
    Query("f9_usable_snapshot", "trip_id:i route_id:s",
          lambda s, d: features.usable_snapshot(ready(s, d), ("click", "view"), ("trip_id", "actual_start", "boardings")),
          sql("SELECT * FROM ready_v WHERE route_id IN ('click', 'view')")),
    Query("f10_ordinal_sequences", "route_id:s service_day:d n:i day_type:s weekday:i " + _sum_spec("values", "mask"),
          lambda s, d: _sum_products(ordinal(s, d)),
          sql(f"SELECT route_id, service_day, n, day_type, weekday, {_sums_sql('vv', 'values')}, {_sums_sql('mm', 'mask')} FROM ordinal_v")),
    Query("f11_clock_sequences", "route_id:s service_day:d n:i duplicates:i " + _sum_spec("values", "mask"),
          lambda s, d: _sum_products(sequences.clock_sequences(table(s, d))),
          sql("""SELECT route_id, service_day, count(*) AS n, 0 AS duplicates, 29 AS values_len, coalesce(sum(passengers_sum) FILTER (p BETWEEN 0 AND 28), 0) AS values_sum,
                 coalesce(sum(passengers_sum * (p + 1)) FILTER (p BETWEEN 0 AND 28), 0) AS values_dot, 29 AS mask_len, count(*) FILTER (p BETWEEN 0 AND 28) AS mask_sum,
                 coalesce(sum(p + 1) FILTER (p BETWEEN 0 AND 28), 0) AS mask_dot FROM (SELECT *, floor((minute - 240) / 30.0) AS p FROM obs_v) GROUP BY 1, 2""")),
    Query("f12_day_pairs", "route_id:s service_day:d day_type:s weekday:i " + _sum_spec("values", "previous_values"),
          lambda s, d: _sum_products(sequences.day_pairs(ordinal(s, d))),
          sql(_PAIR.format(_sums_sql("c.vv", "values") + ", " + _sums_sql("p.vv", "previous_values"),
                           "JOIN ordinal_v p ON p.route_id = c.route_id AND p.service_day = c.service_day - 1", "AND p.n >= 8"))),
    Query("f13_two_channel_pairs", "route_id:s service_day:d " + _sum_spec("values", "previous_values", "week_values"),
          lambda s, d: _sum_products(sequences.day_pairs(ordinal(s, d), {"previous": 1, "week": 7})),
          sql(_PAIR.format(_sums_sql("c.vv", "values") + ", " + _sums_sql("p.vv", "previous_values") + ", " + _sums_sql("k.vv", "week_values"),
                           "JOIN ordinal_v p ON p.route_id = c.route_id AND p.service_day = c.service_day - 1 JOIN ordinal_v k ON k.route_id = c.route_id AND k.service_day = c.service_day - 7",
                           "AND p.n >= 8 AND k.n >= 8"))),
    Query("f14_standardise", "route_id:s service_day:d train_mean:f train_std:f scaled_sum:f previous_scaled_sum:f previous_scaled_dot:f",
          lambda s, d: _sum_products(sequences.standardise(sequences.day_pairs(ordinal(s, d)), F.col("service_day") < F.lit("2024-01-20").cast("date"))),
          sql("""SELECT c.route_id, c.service_day, t.m AS train_mean, t.sd AS train_std, list_sum([(x - t.m) / t.sd FOR x IN c.vv]) AS scaled_sum,
                 list_sum([CASE WHEN i <= p.n THEN (x - t.m) / t.sd ELSE 0 END FOR x, i IN p.vv]) AS previous_scaled_sum,
                 list_sum([CASE WHEN i <= p.n THEN i * (x - t.m) / t.sd ELSE 0 END FOR x, i IN p.vv]) AS previous_scaled_dot
                 FROM ordinal_v c JOIN ordinal_v p ON p.route_id = c.route_id AND p.service_day = c.service_day - 1
                 JOIN (SELECT route_id, avg(v) AS m, stddev_pop(v) AS sd FROM (SELECT c.route_id, unnest(c.vals[1:28]) AS v FROM ordinal_v c
                   JOIN ordinal_v p ON p.route_id = c.route_id AND p.service_day = c.service_day - 1 AND p.n >= 8
                   WHERE c.n >= 8 AND c.service_day < DATE '2024-01-20') GROUP BY 1) t ON t.route_id = c.route_id WHERE c.n >= 8 AND p.n >= 8""")),
    Query("f15_one_hot_day_types", "route_id:s timestamp:t " + " ".join(f"is_{t.lower()}:i" for t in DAY_TYPES),
          lambda s, d: features.one_hot_day_types(grid(s, d)),
          sql("SELECT route_id, timestamp, " + ", ".join(f"CAST(day_type = '{t}' AS INT) AS is_{t.lower()}" for t in DAY_TYPES) + " FROM targets_v")),
    Query("f16_holiday_days", "day_type:s service_day:d", lambda s, d: features.holiday_days(table(s, d)),
          sql("SELECT DISTINCT day_type, service_day FROM table_v WHERE day_type LIKE 'FESTIVO%'")),
    Query("n13_regime", "route_id:s timestamp:t regime:s",
          lambda s, d: grid(s, d).withColumn("regime", baselines.regime(F.col("day_type"))),
          sql("SELECT route_id, timestamp, CASE WHEN day_type LIKE 'FESTIVO%' THEN 'raro' ELSE 'ordinario' END AS regime FROM targets_v")),
    Query("n14_feature_projection", "route_id:s " + " ".join(f"{n}:f" for n in ("passengers_sum_lag_1", "passengers_sum_std_12", "trips_mean_3", "trips_lag_336", "weekday_cos")),
          lambda s, d: table(s, d).select(*features.feature_names(features.DEMAND_TRIPS_SET)),
          sql("SELECT *, cos(2 * pi() * weekday / 7) AS weekday_cos FROM table_v")),
    Query("n15_numeric_features", "route_id:s timestamp:t n_features:i passengers_sum_lag_48:f passengers_per_trip_lag_336:f", _numeric,
          sql("SELECT *, 8 AS n_features FROM table_v")),
    Query("b1_service_day_borders", "route_id:s timestamp:t start_up:t end_down:t",
          lambda s, d: series_30(s, d).withColumns({"start_up": splits.align_start(F.col("timestamp")), "end_down": splits.align_end(F.col("timestamp"))}),
          sql(f"SELECT route_id, timestamp, {_up('timestamp')} AS start_up, {_down('timestamp')} AS end_down FROM targets_v")),
    Query("b2_alignment_summary", "scope:s boundary:s original_ts:t aligned_ts:t rows_cut:i days_cut:i",
          lambda s, d: splits.alignment_summary(table(s, d), PLAN),
          sql(" UNION ALL ".join(
              f"""SELECT '{scope}' AS scope, '{side}' AS boundary, {raw} AS original_ts, {al} AS aligned_ts, count(t.timestamp) AS rows_cut, count(DISTINCT t.service_day) AS days_cut
              FROM bounds_v LEFT JOIN table_v t ON t.timestamp >= least({raw}, {al}) AND t.timestamp < greatest({raw}, {al}) GROUP BY 1, 2, 3, 4"""
              for scope, side, raw, al in (("dataset", "start", "start_raw", "lo"), ("dataset", "end", "end_raw", "hi"),
                                           ("final_test", "start", "test_raw", "test_lo"), ("final_test", "end", "end_raw", "hi"))))),
    Query("b3_final_test_window", "split:s fold:s train_start:t train_end:t eval_start:t eval_end:t",
          lambda s, d: splits.final_test_window(table(s, d), PLAN), sql("SELECT * FROM folds_v WHERE split = 'test_final'")),
    Query("b4_expanding_folds", _FOLD, lambda s, d: splits.make_folds(table(s, d), PLAN), sql("SELECT * FROM folds_v")),
    Query("b5_fold_validation", "folds:i bad_order:i overlaps:i reach_test:i partial_days:i",
          lambda s, d: splits.validate_folds(splits.make_folds(table(s, d), PLAN)),
          sql("SELECT count(*) AS folds, 0 AS bad_order, 0 AS overlaps, 0 AS reach_test, 0 AS partial_days FROM folds_v")),
    Query("b6_fold_sizes", _FOLD + " train_rows:i eval_rows:i", _on(splits.fold_sizes),
          sql("""SELECT f.*, (SELECT count(*) FROM scen_v s WHERE s.timestamp >= f.train_start AND s.timestamp < f.train_end) AS train_rows,
                 (SELECT count(*) FROM scen_v s WHERE s.timestamp >= f.eval_start AND s.timestamp < f.eval_end) AS eval_rows FROM folds_v f""")),
    Query("b7_naive_forecasts", _ROW + "model:s y_pred:f", _on(lambda r, f: baselines.naive_predictions(r.filter("fold_no is not null"))),
          sql("SELECT scenario, route_id, timestamp, model, y_pred FROM pred_v WHERE model LIKE '%naive%'")),
    Query("b8_historical_average", _ROW + "fold_no:i y_pred:f", _on(baselines.historical_average), sql("SELECT * FROM hist_v")),
    Query("b9_rolling_average", _ROW + "fold_no:i model:s y_pred:f fallback_level:s",
          _on(lambda r, f: baselines.rolling_average(r, f, WINDOWS)),
          sql("SELECT *, 'rolling_average_' || win || 'd' AS model FROM roll_v")),
    Query("b10_history_level", _ROW + "fold_no:i history_level:s", _on(baselines.history_level), sql("SELECT * FROM level_v")),
    Query("b11_prediction_frame", _ROW + "model:s split:s fold:s day_type:s hour:i is_gap:b y_real:f y_pred:f error:f error_abs:f error_squared:f", predictions,
          sql("SELECT *, abs(error) AS error_abs, error * error AS error_squared FROM pred_v")),
    Query("b12_backtest_summary", "scenario:s model:s split:s fold:s n:i mae:f bias:f",
          lambda s, d: predictions(s, d).groupBy("scenario", "model", "split", "fold").agg(
              F.count("error").alias("n"), F.avg("error_abs").alias("mae"), F.avg("error").alias("bias")),
          sql("SELECT scenario, model, split, fold, count(error) AS n, avg(abs(error)) AS mae, avg(error) AS bias FROM pred_v GROUP BY ALL")),
    Query("b15_three_blocks", "route_id:s timestamp:t block:s",
          lambda s, d: splits.three_blocks(table(s, d), "2024-01-22 04:00:00", train_days=15, stop_days=3, eval_days=4),
          sql("""SELECT * FROM (SELECT route_id, timestamp, CASE WHEN timestamp >= '2024-01-19 04:00:00' AND timestamp < '2024-01-22 04:00:00' THEN 'stop'
                 WHEN timestamp >= '2024-01-22 04:00:00' AND timestamp < '2024-01-26 04:00:00' THEN 'eval'
                 WHEN timestamp >= '2024-01-07 04:00:00' AND timestamp < '2024-01-19 04:00:00' THEN 'fit' END AS block FROM obs_v) WHERE block IS NOT NULL""")),
    Query("b16_window_sweep", "cut:d window_days:i regime:s n:i mae:f bias:f",
          lambda s, d: baselines.window_sweep(table(s, d), CUTS, SWEEP_WINDOWS), sql("SELECT * FROM sweep_v")),
    Query("b16_sweep_summary", "window_days:i ordinario_cuts:i ordinario_mae:f ordinario_bias:f ordinario_bias_std:f",
          lambda s, d: baselines.sweep_summary(baselines.window_sweep(table(s, d), CUTS, SWEEP_WINDOWS)),
          sql("""SELECT window_days, count(*) AS ordinario_cuts, avg(mae) AS ordinario_mae, avg(bias) AS ordinario_bias, stddev_samp(bias) AS ordinario_bias_std
                 FROM sweep_v WHERE regime = 'ordinario' GROUP BY 1""")),
    Query("b17_walk_forward", "route_id:s timestamp:t y_real:f y_pred:f no_precedent:b",
          lambda s, d: baselines.walk_forward(table(s, d), 14), sql("SELECT * FROM walk_v")),
    Query("b17_walk_forward_days", "route_id:s service_day:d day_type:s n:i demand_mean:f mae:f bias:f range_pred:f range_real:f no_precedent:i",
          lambda s, d: baselines.walk_forward_days(baselines.walk_forward(table(s, d), 14)), sql("SELECT * FROM walk_days_v")),
    Query("b18_regime_hybrid", _ROW + "y_hybrid:f",
          _on(lambda r, f: baselines.historical_average(r, f).withColumn("y_pred_average", F.col("y_pred")).withColumn(
              "y_hybrid", baselines.regime_hybrid(r, "y_lag_48", "y_pred_average"))),
          sql("SELECT scenario, route_id, timestamp, CASE WHEN day_type LIKE 'FESTIVO%' THEN y_pred ELSE y_lag_48 END AS y_hybrid FROM hist_v")),
]

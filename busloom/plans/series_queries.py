"""Queries over demand series and service hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.functions.calendar import DAY_TYPES
from busloom.functions.reuse import written_once
from busloom.operators import hours, normalize, series
from busloom.plans.common_sql import block, day_type_sql, sql
from busloom.plans.registry import Query
from busloom.plans.stages import staged
from busloom.sources.tables import trips

# ---------------------------------------------------------------- SQL blocks

block("bins_v", """
  SELECT route_id, gran_min, date_trunc('day', actual_start) + to_minutes(((hour(actual_start) * 60 + minute(actual_start)) // gran_min) * gran_min) AS timestamp,
    sum(boardings) AS passengers_sum, count(trip_id) AS trips, avg(boardings) AS passengers_mean, quantile_cont(boardings, 0.95) AS passengers_p95
  FROM ready_v CROSS JOIN (VALUES (15), (30), (60)) AS g(gran_min) GROUP BY 1, 2, 3""")
block("grid_v", """
  SELECT s.route_id, s.gran_min, s.timestamp, b.passengers_sum, b.trips, b.passengers_mean, b.passengers_p95, b.trips IS NULL AS is_gap
  FROM (SELECT route_id, gran_min, unnest(generate_series(min(timestamp), max(timestamp), to_minutes(gran_min))) AS timestamp
    FROM bins_v GROUP BY 1, 2) s
  LEFT JOIN bins_v b ON b.route_id = s.route_id AND b.gran_min = s.gran_min AND b.timestamp = s.timestamp""")
block("cal_v", f"""
  SELECT *, hour(timestamp) AS hour, isodow(timestamp) - 1 AS weekday, isodow(timestamp) >= 6 AS is_weekend, month(timestamp) AS month,
    week(timestamp) AS iso_week, quarter(timestamp) AS quarter, hour(timestamp) * 60 + minute(timestamp) AS minute,
    CASE WHEN hour(timestamp) <= 5 THEN 'MADRUGADA' WHEN hour(timestamp) <= 11 THEN 'MANANA' WHEN hour(timestamp) <= 13 THEN 'MEDIODIA'
      WHEN hour(timestamp) <= 18 THEN 'TARDE' ELSE 'NOCHE' END AS day_part,
    {day_type_sql('timestamp')} AS day_type, day_type LIKE 'FESTIVO%' AS is_holiday
  FROM grid_v""")
block("activity_v", """
  SELECT route_id, gran_min, day_type, minute, count(*) FILTER (NOT is_gap) AS active_days, count(*) AS days,
    count(*) FILTER (NOT is_gap) / count(*)::DOUBLE AS active_share FROM cal_v GROUP BY 1, 2, 3, 4""")
block("days_v", """SELECT route_id, gran_min, day_type, count(DISTINCT CAST(timestamp AS DATE)) AS sample_days
  FROM cal_v GROUP BY 1, 2, 3""")
_types = ", ".join(f"('{t}')" for t in DAY_TYPES)
block("hours_v", f"""
  SELECT *, CASE WHEN start_min < 0 THEN '' ELSE printf('%02d:%02d', start_min // 60, start_min % 60) END AS start_clock,
    CASE WHEN start_min < 0 THEN '' ELSE printf('%02d:%02d', end_min // 60, end_min % 60) END AS end_clock,
    CASE WHEN start_min < 0 THEN 0 ELSE (end_min - start_min + gran_min) / 60.0 END AS service_h
  FROM (SELECT p.route_id, p.gran_min, p.day_type, p.sample_days,
    coalesce(p.lo, -1) AS start_min, coalesce(p.hi, -1) AS end_min,
    CASE WHEN p.lo IS NULL THEN 0 ELSE p.used_days END AS used_days, p.borrowed AND p.lo IS NOT NULL AS borrowed,
    coalesce((SELECT count(*) FROM activity_v a WHERE a.route_id = p.route_id AND a.gran_min = p.gran_min AND a.day_type = p.source
      AND a.minute BETWEEN p.lo AND p.hi AND a.active_share < 0.3), 0) AS odd_slots,
    coalesce((SELECT avg(CAST(a.active_share >= 0.1 AS INT)) FROM activity_v a WHERE a.route_id = p.route_id AND a.gran_min = p.gran_min
      AND a.day_type = p.source AND a.minute BETWEEN p.lo AND p.hi), 0) AS coverage
   FROM (SELECT w.*, (SELECT min(minute) FROM activity_v a WHERE a.route_id = w.route_id AND a.gran_min = w.gran_min
        AND a.day_type = w.source AND active_share >= 0.1) AS lo,
      (SELECT max(minute) FROM activity_v a WHERE a.route_id = w.route_id AND a.gran_min = w.gran_min
        AND a.day_type = w.source AND active_share >= 0.1) AS hi
    FROM (SELECT s.route_id, s.gran_min, t.day_type, coalesce(d.sample_days, 0) AS sample_days,
        coalesce(d.sample_days, 0) < 10 AND t.day_type <> 'LABORAL' AND l.sample_days IS NOT NULL AS borrowed,
        CASE WHEN coalesce(d.sample_days, 0) < 10 AND t.day_type <> 'LABORAL' AND l.sample_days IS NOT NULL THEN 'LABORAL' ELSE t.day_type END AS source,
        CASE WHEN coalesce(d.sample_days, 0) < 10 AND t.day_type <> 'LABORAL' AND l.sample_days IS NOT NULL THEN l.sample_days ELSE coalesce(d.sample_days, 0) END AS used_days
      FROM (SELECT DISTINCT route_id, gran_min FROM days_v) s CROSS JOIN (VALUES {_types}) AS t(day_type)
      LEFT JOIN days_v d ON d.route_id = s.route_id AND d.gran_min = s.gran_min AND d.day_type = t.day_type
      LEFT JOIN days_v l ON l.route_id = s.route_id AND l.gran_min = s.gran_min AND l.day_type = 'LABORAL') w) p)""")
block("series_v", """
  SELECT c.*, coalesce(c.minute BETWEEN h.start_min AND h.end_min, false) AS in_hours,
    CASE WHEN NOT c.is_gap THEN 'operativo' WHEN coalesce(c.minute BETWEEN h.start_min AND h.end_min, false) THEN 'gap_anomalo'
      ELSE 'fuera_operacion' END AS gap_type
  FROM cal_v c LEFT JOIN hours_v h ON h.route_id = c.route_id AND h.gran_min = c.gran_min AND h.day_type = c.day_type AND h.start_min >= 0""")
block("gap_cmp_v", """
  SELECT *, 100.0 * gaps / slots AS gap_pct, CASE WHEN hours_slots > 0 THEN 100.0 * hours_gaps / hours_slots END AS hours_gap_pct FROM (
    SELECT route_id, gran_min, day_type, count(*) AS slots, count(*) FILTER (is_gap) AS gaps, count(*) FILTER (in_hours) AS hours_slots,
      count(*) FILTER (in_hours AND is_gap) AS hours_gaps FROM series_v GROUP BY 1, 2, 3)""")
block("valid_v", """
  SELECT *, span_days >= 30 AS span_ok FROM (
    SELECT route_id, gran_min, count(*) AS n_rows, count(*) FILTER (timestamp - prev > to_minutes(gran_min)) AS jumps,
      count(*) FILTER (is_gap) AS gaps, count(*) FILTER (passengers_sum < 0) + count(*) FILTER (trips < 0) + count(*) FILTER (passengers_mean < 0)
        + count(*) FILTER (passengers_p95 < 0) AS negatives, 4 * count(*) FILTER (trips IS NULL) AS nulls,
      date_diff('hour', min(timestamp), max(timestamp)) // 24 + 1 AS span_days, min(timestamp) AS first_ts, max(timestamp) AS last_ts
    FROM (SELECT *, lag(timestamp) OVER (PARTITION BY route_id, gran_min ORDER BY timestamp) AS prev FROM grid_v) GROUP BY 1, 2)""")


# ---------------------------------------------------------------- Spark frames

def ready(spark: SparkSession, d: str) -> DataFrame:
    return normalize.model_ready(trips(spark, d))


def plain_series(spark: SparkSession, d: str, grans=series.GRANULARITIES, fill: str = "mark", **kw) -> DataFrame:
    return series.calendar_series(ready(spark, d), grans, fill=fill, **kw)


def full_series(spark: SparkSession, d: str, grans=series.GRANULARITIES) -> DataFrame:
    """Hours and gap types over bins that are written once, as the hours are worked out from them too."""
    base = written_once(plain_series(spark, d, grans), "series")
    return series.add_service_hours(base, hours.estimate_hours(base))


@staged
def series_table(spark: SparkSession, d: str) -> DataFrame:
    return full_series(spark, d)


def series_30(spark: SparkSession, d: str) -> DataFrame:
    return series_table(spark, d).filter("gran_min = 30")


_S = "route_id:s gran_min:i timestamp:t "
_M = "passengers_sum:f trips:i passengers_mean:f passengers_p95:f "

QUERIES = [
    Query("s1_demand_bins", _S + _M, lambda s, d: series.demand_bins(ready(s, d)), sql("SELECT * FROM bins_v")),
    Query("s2_complete_grid", _S + "is_gap:b", lambda s, d: series.complete_grid(series.demand_bins(ready(s, d))),
          sql("SELECT * FROM grid_v")),
    Query("s3_fill_zero", _S + _M, lambda s, d: plain_series(s, d, fill="zero"),
          sql("""SELECT route_id, gran_min, timestamp, coalesce(passengers_sum, 0) AS passengers_sum, coalesce(trips, 0) AS trips,
                 coalesce(passengers_mean, 0) AS passengers_mean, coalesce(passengers_p95, 0) AS passengers_p95 FROM grid_v""")),
    Query("s3_fill_forward", _S + _M, lambda s, d: plain_series(s, d, fill="ffill"),
          sql("""SELECT route_id, gran_min, timestamp, last_value(passengers_sum IGNORE NULLS) OVER w AS passengers_sum,
                 last_value(trips IGNORE NULLS) OVER w AS trips, last_value(passengers_mean IGNORE NULLS) OVER w AS passengers_mean,
                 last_value(passengers_p95 IGNORE NULLS) OVER w AS passengers_p95 FROM grid_v
                 WINDOW w AS (PARTITION BY route_id, gran_min ORDER BY timestamp)""")),
    Query("s3_mark_gaps", _S + _M + "is_gap:b", plain_series,
          sql("SELECT * FROM grid_v")),
    Query("s4_calendar_parts", _S + "hour:i weekday:i is_weekend:b month:i iso_week:i quarter:i day_part:s",
          plain_series, sql("SELECT * FROM cal_v")),
    Query("s5_day_types", "timestamp:t weekday:i is_holiday:b day_type:s",
          lambda s, d: series.add_calendar(
              s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").alias("timestamp")).distinct()),
          sql(f"""SELECT *, day_type LIKE 'FESTIVO%' AS is_holiday FROM (SELECT timestamp, isodow(timestamp) - 1 AS weekday,
                 {day_type_sql('timestamp')} AS day_type FROM (SELECT DISTINCT o_orderdate AS timestamp FROM orders))""")),
    Query("s6_gap_types", _S + "is_gap:b day_type:s in_hours:b gap_type:s", full_series, sql("SELECT * FROM series_v")),
    Query("s7_all_routes_series", "timestamp:t passengers_sum:f trips:i passengers_mean:f passengers_p95:f is_gap:b",
          lambda s, d: plain_series(s, d, (60,), route=None),
          sql("""WITH b AS (SELECT date_trunc('hour', actual_start) AS timestamp, sum(boardings) AS passengers_sum, count(*) AS trips,
                 avg(boardings) AS passengers_mean, quantile_cont(boardings, 0.95) AS passengers_p95 FROM ready_v GROUP BY 1)
                 SELECT g.timestamp, passengers_sum, trips, passengers_mean, passengers_p95, trips IS NULL AS is_gap
                 FROM (SELECT unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp FROM b) g
                 LEFT JOIN b ON b.timestamp = g.timestamp""").replace("\nWITH b AS", ",\nb AS")),
    Query("s8_run_summary", "route_id:s gran_min:i slots:i gap_slots:i passengers:f gap_pct:f is_valid:b",
          lambda s, d: series.run_summary(plain_series(s, d)),
          sql("""SELECT g.route_id, g.gran_min, count(*) AS slots, count(*) FILTER (is_gap) AS gap_slots, coalesce(sum(passengers_sum), 0) AS passengers,
                 100.0 * count(*) FILTER (is_gap) / count(*) AS gap_pct, bool_and(v.negatives = 0 AND v.span_ok) AS is_valid
                 FROM grid_v g JOIN valid_v v ON v.route_id = g.route_id AND v.gran_min = g.gran_min GROUP BY 1, 2""")),
    Query("q11_validate_series",
          "route_id:s gran_min:i n_rows:i first_ts:t last_ts:t jumps:i gaps:i negatives:i nulls:i span_days:i span_ok:b errors:i warnings:i is_valid:b",
          lambda s, d: series.validate_series(plain_series(s, d)),
          sql("""SELECT *, CAST(NOT span_ok AS INT) AS errors, CASE WHEN nulls > 0 THEN 4 ELSE 0 END + CAST(jumps > 0 AS INT) AS warnings,
                 negatives = 0 AND span_ok AS is_valid FROM valid_v""")),
    Query("q11_validate_bins", "route_id:s gran_min:i n_rows:i jumps:i gaps:i",
          lambda s, d: series.validate_series(series.demand_bins(ready(s, d)).withColumn("is_gap", F.lit(False))),
          sql("""SELECT route_id, gran_min, count(*) AS n_rows, count(*) FILTER (timestamp - prev > to_minutes(gran_min)) AS jumps, 0 AS gaps
                 FROM (SELECT *, lag(timestamp) OVER (PARTITION BY route_id, gran_min ORDER BY timestamp) AS prev FROM bins_v) GROUP BY 1, 2""")),
    Query("h1_slot_activity", "route_id:s gran_min:i day_type:s minute:i active_days:i days:i active_share:f",
          lambda s, d: hours.slot_activity(plain_series(s, d)), sql("SELECT * FROM activity_v")),
    Query("h2_service_hours",
          "route_id:s gran_min:i day_type:s start_min:i end_min:i start_clock:s end_clock:s service_h:f odd_slots:i coverage:f",
          lambda s, d: hours.estimate_hours(plain_series(s, d)), sql("SELECT * FROM hours_v")),
    Query("h3_borrowed_hours", "route_id:s gran_min:i day_type:s sample_days:i used_days:i borrowed:b",
          lambda s, d: hours.estimate_hours(plain_series(s, d)), sql("SELECT * FROM hours_v")),
    Query("h4_activity_matrix", "route_id:s gran_min:i minute:i " + " ".join(f"{t}:f" for t in DAY_TYPES),
          lambda s, d: hours.activity_matrix(plain_series(s, d)),
          sql("SELECT route_id, gran_min, minute, " + ", ".join(
              f"max(active_share) FILTER (day_type = '{t}') AS {t}" for t in DAY_TYPES) + " FROM activity_v GROUP BY 1, 2, 3")),
    Query("h5_gap_comparison", "route_id:s gran_min:i day_type:s slots:i gaps:i gap_pct:f hours_slots:i hours_gaps:i hours_gap_pct:f",
          lambda s, d: hours.gap_comparison(series_table(s, d)), sql("SELECT * FROM gap_cmp_v")),
    Query("h6_gap_rollup", "route_id:s gran_min:i slots:i gaps:i hours_slots:i hours_gaps:i gap_pct:f hours_gap_pct:f reduction_points:f",
          lambda s, d: hours.gap_rollup(hours.gap_comparison(series_table(s, d))),
          sql("""SELECT *, gap_pct - hours_gap_pct AS reduction_points FROM (SELECT route_id, gran_min, sum(slots) AS slots, sum(gaps) AS gaps,
                 sum(hours_slots) AS hours_slots, sum(hours_gaps) AS hours_gaps, 100.0 * sum(gaps) / sum(slots) AS gap_pct,
                 100.0 * sum(hours_gaps) / sum(hours_slots) AS hours_gap_pct FROM gap_cmp_v WHERE hours_gap_pct IS NOT NULL GROUP BY 1, 2)""")),
]

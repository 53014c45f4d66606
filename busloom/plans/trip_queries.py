"""Queries over trip records: normalisation, quality, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.functions.columns import service_day
from busloom.operators import diagnostics, normalize, quality
from busloom.plans.common_sql import block, minutes, sql
from busloom.plans.registry import Query
from busloom.plans.stages import staged
from busloom.sources.tables import pings, raw_trips, read_table, trips

LIMITS = quality.QualityLimits(valid_status=(0, 1, 2, 3))
REPORT_COLUMNS = ("trip_id", "vehicle_id", "route_id", "actual_start", "actual_end",
                  "boardings_raw", "boardings", "distance")

# ---------------------------------------------------------------- SQL blocks

_d = minutes("actual_start", "actual_end")
block("flag_base_v", f"""
  SELECT *, trip_id IS NULL AS flag_key_null,
    count(*) OVER (PARTITION BY trip_id) > 1 AS flag_key_duplicated,
    vehicle_id IS NULL OR lower(trim(vehicle_id)) IN ('', 'nan', 'none', 'null') AS flag_vehicle_blank,
    actual_start IS NULL AS flag_start_null, actual_end IS NULL AS flag_end_null,
    coalesce(actual_end < actual_start, false) AS flag_end_before_start,
    {_d} AS duration_min, coalesce({_d} < 0, false) AS flag_duration_negative,
    coalesce(boardings_raw < 0, false) AS flag_boardings_negative,
    coalesce(distance < 0, false) AS flag_distance_negative,
    coalesce(frequency_min < 1 OR frequency_min > 60, false) AS flag_frequency_out,
    coalesce(trip_status NOT IN (0, 1, 2, 3), false) AS flag_status_invalid
  FROM raw_trips_v""")
block("duration_limit_v", """SELECT route_id, quantile_cont(duration_min, 0.99) AS lim FROM flag_base_v
  WHERE duration_min >= 0 AND route_id IS NOT NULL GROUP BY 1""")
block("boardings_limit_v", """SELECT route_id, quantile_cont(boardings_raw, 0.995) AS lim FROM flag_base_v
  WHERE boardings_raw >= 0 AND route_id IS NOT NULL GROUP BY 1""")

_HARD = " OR ".join(quality.HARD_FLAGS)
_SOFT = " OR ".join(quality.SOFT_FLAGS)
_SUM = " + ".join(f"CAST({f} AS INT)" for f in quality.ALL_FLAGS)


def _reason(names, cond: str) -> str:
    cases = ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in names)
    return f"CASE WHEN {cond} THEN concat_ws(',', {cases}) ELSE '' END"


block("flagged_v", f"""
  SELECT *, {_SUM} + 5 * CAST(qc_hard_fail AS INT) AS qc_score,
    {_reason(quality.HARD_FLAGS, 'qc_hard_fail')} AS qc_reason_hard,
    {_reason(quality.SOFT_FLAGS, 'qc_soft_fail')} AS qc_reason_soft
  FROM (SELECT *, {_HARD} OR {_SOFT} OR flag_status_invalid AS qc_any_flag, {_HARD} AS qc_hard_fail,
      NOT ({_HARD}) AND ({_SOFT}) AS qc_soft_fail
    FROM (SELECT b.*, coalesce(duration_min > d.lim, false) AS flag_duration_excess,
        coalesce(boardings_raw > p.lim, false) AS flag_boardings_excess
      FROM flag_base_v b LEFT JOIN duration_limit_v d ON b.route_id = d.route_id
      LEFT JOIN boardings_limit_v p ON b.route_id = p.route_id))""")

block("raw_ready_v", f"""
  SELECT *, actual_end AS final_end, CASE WHEN boardings_raw IS NOT NULL THEN greatest(boardings_raw - door_alarms, 0) END AS boardings,
    CAST(actual_end IS NOT NULL AS INT) AS is_complete
  FROM flagged_v WHERE NOT qc_hard_fail AND duration_min BETWEEN 5 AND 480""")

block("stage_sizes_v", """SELECT (SELECT count(*) FROM raw_trips_v) AS a, (SELECT count(*) FROM flagged_v) AS b,
  (SELECT count(*) FROM flagged_v WHERE NOT qc_hard_fail) AS c, (SELECT count(*) FROM raw_ready_v) AS e""")


# ---------------------------------------------------------------- Spark frames

def flagged(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_trips(raw_trips(spark, d), LIMITS)


@staged
def qc_table(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d)


def raw_ready(spark: SparkSession, d: str) -> DataFrame:
    ready = normalize.model_ready(qc_table(spark, d))
    return normalize.label_trips(ready.withColumn(
        "boardings", normalize.corrected_boardings("boardings_raw", "door_alarms")))


def stages(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    qc = qc_table(spark, d)
    return {"raw": raw_trips(spark, d), "qc": qc, "end": normalize.label_trips(qc.filter(~F.col("qc_hard_fail"))),
            "model_ready": raw_ready(spark, d)}


def _clock_trips(spark, d):
    e = read_table(spark, d, "events")
    clock = F.when(F.col("event_id") % 9 == 0, "pending").otherwise(
        F.concat(F.lit("0 days "), F.date_format("ts", "HH:mm:ss"), F.lit(".5")))
    date = F.when(F.col("event_id") % 17 == 0, "2024-13-45").otherwise(F.to_date("ts").cast("string"))
    return e.select(F.col("event_id").alias("trip_id"), date.alias("start_date"), clock.alias("clock"))


_FLAG_SPEC = " ".join(f"{f}:b" for f in (*quality.ALL_FLAGS, *quality.ROLLUPS))
_PCT = "100.0 * count(*) FILTER ({0}) / count(*)"


def _union(names, template: str) -> str:
    return " UNION ALL ".join(template.replace("{c}", n) for n in names)


# Columns that quality checks add besides the duration (13 flags, 3 roll-ups, 2 reasons, the score), and that
# make a trip model-ready (end, 6 clock parts, readiness, boardings, 4 labels).
_ADDED_BY_QC, _ADDED_BY_READY = 19, 13
_RAW_COLUMNS = ("trip_id", "vehicle_id", "route_id", "row_id", "actual_start", "actual_end", "boardings_raw",
                "door_alarms", "distance", "frequency_min", "trip_status")

QUERIES = [
    Query("n1_combine_date_clock", "trip_id:i start:t",
          lambda s, d: _clock_trips(s, d).withColumn("start", normalize.combine_date_clock("start_date", "clock")),
          sql("""SELECT event_id AS trip_id, CASE WHEN event_id % 9 <> 0 AND event_id % 17 <> 0
                 THEN date_trunc('second', ts) END AS start FROM events""")),
    Query("n2_corrected_boardings", "row_id:i boardings:f",
          lambda s, d: raw_trips(s, d).withColumn(
              "boardings", normalize.corrected_boardings("boardings_raw", "door_alarms")),
          sql("""SELECT row_id, CASE WHEN boardings_raw IS NOT NULL
                 THEN greatest(boardings_raw - door_alarms, 0) END AS boardings FROM raw_trips_v""")),
    Query("n3_only_routes", "trip_id:i route_id:s",
          lambda s, d: normalize.only_routes(trips(s, d), ["click", "view"]),
          sql("SELECT trip_id, route_id FROM trips_v WHERE route_id IN ('click', 'view')")),
    Query("n4_missing_share", "column_name:s missing_pct:f",
          lambda s, d: normalize.missing_share(raw_trips(s, d)),
          sql("SELECT * FROM (" + _union(_RAW_COLUMNS, "SELECT '{c}' AS column_name, 100.0 * avg(CAST({c} IS NULL AS INT)) AS missing_pct FROM raw_trips_v")
              + ") ORDER BY missing_pct DESC, column_name LIMIT 10")),
    Query("n5_clean_positions", "ping_id:i lat:f lon:f",
          lambda s, d: normalize.clean_positions(pings(s, d)),
          sql("""SELECT ping_id, la AS lat, lo AS lon FROM (SELECT ping_id, TRY_CAST(replace(trim(lat), ',', '.') AS DOUBLE) AS la,
                 TRY_CAST(replace(trim(lon), ',', '.') AS DOUBLE) AS lo FROM pings_v)
                 WHERE la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180""")),
    Query("n6_trip_labels", "row_id:i is_complete:i end_source:s end_reason:s order_invalid:b",
          lambda s, d: normalize.label_trips(raw_trips(s, d)),
          sql("""SELECT row_id, CAST(actual_end IS NOT NULL AS INT) AS is_complete,
                 CASE WHEN actual_end IS NULL THEN 'SIN_FIN' ELSE 'REAL' END AS end_source,
                 CASE WHEN actual_end IS NULL THEN 'TRUNCADO_SIN_FIN' ELSE 'COMPLETO' END AS end_reason,
                 coalesce(NOT actual_end > actual_start, false) AS order_invalid FROM raw_trips_v""")),
    Query("n7_demand_subset", "row_id:i",
          lambda s, d: normalize.demand_subset(raw_trips(s, d)),
          sql("SELECT row_id FROM raw_trips_v WHERE trip_status <> 4 AND actual_start IS NOT NULL")),
    Query("n7_timing_subset", "row_id:i",
          lambda s, d: normalize.timing_subset(raw_trips(s, d)),
          sql("""SELECT row_id FROM raw_trips_v WHERE trip_status <> 4 AND actual_end IS NOT NULL
                 AND (actual_start IS NULL OR actual_end > actual_start)""")),
    Query("n8_model_ready", "trip_id:i final_end:t duration_min:f start_hour:i end_hour:i weekday:i month:i day:i service_date:d",
          lambda s, d: normalize.model_ready(trips(s, d)),
          sql("""SELECT *, hour(final_end) AS end_hour, month(actual_start) AS month, day(actual_start) AS day FROM ready_v""")),
    Query("n9_final_integrity", "trip_id:i row_id:i",
          lambda s, d: normalize.final_integrity(
              normalize.model_ready(raw_trips(s, d), keep_all=True), order=("actual_start", "row_id")),
          sql(f"""SELECT trip_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY actual_start, row_id) AS k
                 FROM raw_trips_v WHERE trip_id IS NOT NULL AND actual_start IS NOT NULL AND actual_end IS NOT NULL
                 AND {_d} > 0) WHERE k = 1""")),
    Query("n9_final_report", "rule:s n:i pct:f",
          lambda s, d: normalize.final_quality_report(normalize.model_ready(raw_trips(s, d), keep_all=True)),
          sql("""SELECT rule, n, 100.0 * n / total AS pct FROM (
                 SELECT 'duplicate_key' AS rule, count(*) FILTER (flag_key_duplicated) AS n, count(*) AS total FROM flag_base_v
                 UNION ALL SELECT 'blank_vehicle', count(*) FILTER (flag_vehicle_blank), count(*) FROM flag_base_v
                 UNION ALL SELECT 'non_positive_duration', count(*) FILTER (duration_min <= 0), count(*) FROM flag_base_v)""")),
    Query("n10_boardings_fallback", "route_id:s passengers_sum:f",
          lambda s, d: (lambda t: t.groupBy("route_id").agg(
              F.sum(normalize.boardings_column(t)).alias("passengers_sum")))(trips(s, d).drop("boardings")),
          sql("SELECT route_id, sum(boardings_raw) AS passengers_sum FROM trips_v GROUP BY 1")),
    Query("n11_date_slice", "trip_id:i actual_start:t",
          lambda s, d: normalize.date_slice(trips(s, d), "2024-01-05", "2024-01-09", "actual_start"),
          sql("""SELECT trip_id, actual_start FROM trips_v
                 WHERE CAST(actual_start AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""")),
    Query("n12_service_day", "service_day:d trips:i",
          lambda s, d: trips(s, d).filter("actual_start is not null").groupBy(
              service_day("actual_start").alias("service_day")).agg(F.count("*").alias("trips")),
          sql("""SELECT CAST(actual_start - INTERVAL 4 HOUR AS DATE) AS service_day, count(*) AS trips FROM trips_v
                 WHERE actual_start IS NOT NULL GROUP BY 1""")),
    Query("q1_structural_flags", "row_id:i flag_key_null:b flag_key_duplicated:b flag_vehicle_blank:b flag_start_null:b flag_end_null:b",
          lambda s, d: quality.structural_flags(raw_trips(s, d)), sql("SELECT * FROM flag_base_v")),
    Query("q2_temporal_flags", "row_id:i duration_min:f flag_end_before_start:b flag_duration_negative:b",
          lambda s, d: quality.temporal_flags(raw_trips(s, d)), sql("SELECT * FROM flag_base_v")),
    Query("q3_duration_excess", "row_id:i flag_duration_excess:b",
          lambda s, d: quality.percentile_flag(quality.temporal_flags(raw_trips(s, d)), "duration_min",
                                               "flag_duration_excess", 0.99, cap=170.0),
          sql("""SELECT row_id, coalesce(duration_min > lim, false) OR coalesce(duration_min > 170, false) AS flag_duration_excess
                 FROM flag_base_v b LEFT JOIN duration_limit_v d ON b.route_id = d.route_id""")),
    Query("q3_duration_excess_global", "row_id:i flag_duration_excess:b",
          lambda s, d: quality.percentile_flag(quality.temporal_flags(raw_trips(s, d)), "duration_min",
                                               "flag_duration_excess", 0.99, route=None),
          sql("""SELECT row_id, coalesce(duration_min > (SELECT quantile_cont(duration_min, 0.99) FROM flag_base_v), false)
                 AS flag_duration_excess FROM flag_base_v""")),
    Query("q4_boardings_excess", "row_id:i flag_boardings_negative:b flag_boardings_excess:b",
          lambda s, d: quality.percentile_flag(quality.operational_flags(raw_trips(s, d)), "boardings_raw",
                                               "flag_boardings_excess", 0.995, width=1.0),
          sql("""SELECT row_id, flag_boardings_negative, coalesce(boardings_raw > lim, false) AS flag_boardings_excess
                 FROM flag_base_v b LEFT JOIN boardings_limit_v d ON b.route_id = d.route_id""")),
    Query("q5_operational_flags", "row_id:i flag_distance_negative:b flag_frequency_out:b flag_status_invalid:b",
          lambda s, d: quality.operational_flags(raw_trips(s, d), LIMITS), sql("SELECT * FROM flag_base_v")),
    Query("q6_quality_rollup", f"row_id:i {_FLAG_SPEC} qc_score:i", flagged, sql("SELECT * FROM flagged_v")),
    Query("q7_quality_reasons", "row_id:i qc_reason_hard:s qc_reason_soft:s", flagged, sql("SELECT * FROM flagged_v")),
    Query("q8_flag_summary", "flag:s n:i pct:f", lambda s, d: quality.flag_summary(qc_table(s, d)),
          sql(_union((*quality.ALL_FLAGS, *quality.ROLLUPS),
                     "SELECT '{c}' AS flag, count(*) FILTER ({c}) AS n, 100.0 * count(*) FILTER ({c}) / count(*) AS pct FROM flagged_v"))),
    *[Query(f"q9_top_{by.split('_')[0]}s", f"{by}:s qc_any_flag:i qc_hard_fail:i qc_soft_fail:i",
            lambda s, d, by=by: quality.top_offenders(qc_table(s, d), by),
            sql(f"""SELECT {by}, count(*) FILTER (qc_any_flag) AS qc_any_flag, count(*) FILTER (qc_hard_fail) AS qc_hard_fail,
                   count(*) FILTER (qc_soft_fail) AS qc_soft_fail FROM flagged_v WHERE {by} IS NOT NULL GROUP BY 1
                   ORDER BY 3 DESC, 2 DESC, 1 LIMIT 15""")) for by in ("vehicle_id", "route_id")],
    Query("q10_duration_describe", "n:i mean:f std:f min:f max:f p50:f p90:f p95:f p99:f",
          lambda s, d: quality.describe(quality.temporal_flags(raw_trips(s, d)), "duration_min"),
          sql("""SELECT count(duration_min) AS n, avg(duration_min) AS mean, stddev_samp(duration_min) AS std,
                 min(duration_min) AS min, max(duration_min) AS max, quantile_cont(duration_min, 0.5) AS p50,
                 quantile_cont(duration_min, 0.9) AS p90, quantile_cont(duration_min, 0.95) AS p95,
                 quantile_cont(duration_min, 0.99) AS p99 FROM flag_base_v""")),
    Query("q10_negative_durations", "row_id:i duration_min:f",
          lambda s, d: quality.negative_durations(quality.temporal_flags(raw_trips(s, d)), "row_id"),
          sql("SELECT row_id, duration_min FROM flag_base_v WHERE duration_min < 0 ORDER BY row_id LIMIT 20")),
    Query("d1_stage_overview", "stage:s available:b n_rows:i n_columns:i",
          lambda s, d: diagnostics.stage_overview(s, {**stages(s, d), "end": None}),
          sql(f"""SELECT 'raw' AS stage, true AS available, count(*) AS n_rows, {len(_RAW_COLUMNS)} AS n_columns FROM raw_trips_v
                 UNION ALL SELECT 'quality_checked', true, count(*), {len(_RAW_COLUMNS) + 1 + _ADDED_BY_QC} FROM flagged_v
                 UNION ALL SELECT 'trip_end_resolved', false, 0, 0
                 UNION ALL SELECT 'model_ready', true, count(*), {len(_RAW_COLUMNS) + 1 + _ADDED_BY_QC + _ADDED_BY_READY} FROM raw_ready_v""")),
    Query("d2_retention", "raw_rows:i final_rows:i rows_difference:i retention_pct:f",
          lambda s, d: diagnostics.retention(raw_trips(s, d), raw_ready(s, d)),
          sql("""SELECT a AS raw_rows, b AS final_rows, a - b AS rows_difference, 100.0 * b / a AS retention_pct
                 FROM (SELECT (SELECT count(*) FROM raw_trips_v) AS a, (SELECT count(*) FROM raw_ready_v) AS b)""")),
    Query("d3_missing_before_after", "column_name:s raw_missing:i raw_missing_pct:f final_missing:i final_missing_pct:f",
          lambda s, d: diagnostics.missing_before_after(raw_trips(s, d), raw_ready(s, d), REPORT_COLUMNS),
          sql("SELECT a.*, b.final_missing, b.final_missing_pct FROM ("
              + _union([c for c in REPORT_COLUMNS if c != "boardings"],
                       "SELECT '{c}' AS column_name, count(*) - count({c}) AS raw_missing, 100.0 * (count(*) - count({c})) / count(*) AS raw_missing_pct FROM raw_trips_v")
              + " UNION ALL SELECT 'boardings', NULL, NULL) a JOIN ("
              + _union(REPORT_COLUMNS,
                       "SELECT '{c}' AS column_name, count(*) - count({c}) AS final_missing, 100.0 * (count(*) - count({c})) / count(*) AS final_missing_pct FROM raw_ready_v")
              + ") b ON a.column_name = b.column_name")),
    Query("d4_flag_summary", "flag:s n:i pct:f",
          lambda s, d: diagnostics.report_bundle(s, stages(s, d), REPORT_COLUMNS)["qc_flag_summary"],
          sql(_union((*quality.ALL_FLAGS, *quality.ROLLUPS),
                     "SELECT '{c}' AS flag, count(*) FILTER ({c}) AS n, 100.0 * count(*) FILTER ({c}) / count(*) AS pct FROM flagged_v"))),
    Query("d6_operational_kpis", "kpi:s value:f unit:s",
          lambda s, d: diagnostics.operational_kpis(stages(s, d)),
          sql("SELECT 'despachos_raw' AS kpi, a AS value, 'rows' AS unit FROM stage_sizes_v "
              "UNION ALL SELECT 'despachos_qc', b, 'rows' FROM stage_sizes_v UNION ALL SELECT 'despachos_end', c, 'rows' FROM stage_sizes_v "
              "UNION ALL SELECT 'despachos_model_ready', e, 'rows' FROM stage_sizes_v "
              "UNION ALL SELECT 'retencion_model_ready_pct', 100.0 * e / a, 'pct' FROM stage_sizes_v UNION ALL "
              + _union(quality.ROLLUPS, "SELECT '{c}', count(*) FILTER ({c}), 'rows' FROM flagged_v UNION ALL SELECT '{c}_pct', 100.0 * count(*) FILTER ({c}) / count(*), 'pct' FROM flagged_v")
              + """ UNION ALL SELECT 'pasajeros_total', sum(boardings), 'passengers' FROM raw_ready_v
                 UNION ALL SELECT 'pasajeros_promedio', avg(boardings), 'passengers' FROM raw_ready_v
                 UNION ALL SELECT 'duracion_promedio_min', avg(duration_min), 'minutes' FROM raw_ready_v
                 UNION ALL SELECT 'duracion_p95_min', quantile_cont(duration_min, 0.95), 'minutes' FROM raw_ready_v
                 UNION ALL SELECT 'recorridos_completos', count(actual_end), 'rows' FROM flagged_v WHERE NOT qc_hard_fail
                 UNION ALL SELECT 'recorridos_completos_pct', 100.0 * count(actual_end) / count(*), 'pct' FROM flagged_v WHERE NOT qc_hard_fail""")),
    Query("d7_demand_by_route", "route_id:s trips:i passengers_sum:f passengers_mean:f",
          lambda s, d: diagnostics.demand_by_route(raw_ready(s, d)),
          sql("""SELECT route_id, count(*) AS trips, coalesce(sum(boardings), 0) AS passengers_sum, avg(boardings) AS passengers_mean
                 FROM raw_ready_v GROUP BY 1""")),
    Query("d8_demand_by_weekday_hour", "weekday:i hour:i trips:i passengers_sum:f",
          lambda s, d: diagnostics.demand_by_weekday_hour(trips(s, d)),
          sql("""SELECT isodow(actual_start) - 1 AS weekday, hour(actual_start) AS hour, count(*) AS trips,
                 coalesce(sum(boardings), 0) AS passengers_sum FROM trips_v WHERE actual_start IS NOT NULL GROUP BY 1, 2""")),
    Query("d9_duration_by_route", "route_id:s n:i mean:f median:f p95:f",
          lambda s, d: diagnostics.duration_by_route(raw_ready(s, d)),
          sql("""SELECT route_id, count(*) AS n, avg(duration_min) AS mean, median(duration_min) AS median,
                 quantile_cont(duration_min, 0.95) AS p95 FROM raw_ready_v GROUP BY 1""")),
]

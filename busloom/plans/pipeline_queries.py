"""The end-to-end chain and the whole report bundle, as one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom import pipeline
from busloom.operators import diagnostics, series, trip_end
from busloom.plans import gps_queries, trip_queries
from busloom.plans.common_sql import block, clone, minutes, sql
from busloom.plans.gps_queries import RULES
from busloom.plans.registry import Query
from busloom.plans.trip_queries import LIMITS
from busloom.sources.tables import YARDS, pings, trips

# The blocks of the single steps, fed by each other: imputed starts into the flags, sound trips into the ends, ended trips into the bins.
block("p1_trips_v", """
  SELECT t.trip_id, t.vehicle_id, t.route_id, t.trip_id AS row_id, t.planned_start, coalesce(t.actual_start, d.departure_ts) AS actual_start, t.actual_end,
    t.boardings_raw, t.boardings, t.door_alarms, t.distance, CAST(NULL AS DOUBLE) AS frequency_min, t.trip_status
  FROM trips_v t LEFT JOIN departures_v d ON d.trip_id = t.trip_id""")
clone("p1_", ["flag_base_v", "duration_limit_v", "boardings_limit_v", "flagged_v"], raw_trips_v="p1_trips_v")
block("p1_sound_v", "SELECT * FROM p1_flagged_v WHERE NOT qc_hard_fail")
clone("p1_", ["trunc_v", "post_v", "tail_rank_v", "tail_stats_v", "nearby_v", "ends_v"], trips_v="p1_sound_v")
block("p1_ready_v", f"""
  SELECT * FROM (SELECT t.*, coalesce(t.actual_end, e.estimated_end) AS final_end FROM p1_sound_v t LEFT JOIN p1_ends_v e ON e.trip_id = t.trip_id)
  WHERE {minutes('actual_start', 'final_end')} BETWEEN 5 AND 480""")
clone("p1_", ["bins_v"], ready_v="p1_ready_v")


# The report bundle in long form: each table's keys and its twin.
_TWINS = {q.name: q.sql for q in (*trip_queries.QUERIES, *gps_queries.QUERIES)}
_RAW = len(trip_queries._RAW_COLUMNS)
BUNDLE = {
    "dataset_overview": (("stage",), ("available", "n_rows", "n_columns"), sql(f"""
        SELECT 'raw' AS stage, true AS available, a AS n_rows, {_RAW} AS n_columns FROM stage_sizes_v
        UNION ALL SELECT 'quality_checked', true, b, {_RAW + 20} FROM stage_sizes_v
        UNION ALL SELECT 'trip_end_resolved', true, c, {_RAW + 24} FROM stage_sizes_v
        UNION ALL SELECT 'model_ready', true, e, {_RAW + 33} FROM stage_sizes_v""")),
    "retention_summary": ((), ("raw_rows", "final_rows", "rows_difference", "retention_pct"), _TWINS["d2_retention"]),
    "missing_before_after": (("column_name",), ("raw_missing", "raw_missing_pct", "final_missing", "final_missing_pct"), _TWINS["d3_missing_before_after"]),
    "qc_flag_summary": (("flag",), ("n", "pct"), _TWINS["d4_flag_summary"]),
    "operational_kpis": (("kpi", "unit"), ("value",), _TWINS["d6_operational_kpis"]),
    "demand_by_route": (("route_id",), ("trips", "passengers_sum", "passengers_mean"), _TWINS["d7_demand_by_route"]),
    "demand_by_hour_weekday": (("weekday", "hour"), ("trips", "passengers_sum"), sql(
        "SELECT isodow(actual_start) - 1 AS weekday, hour(actual_start) AS hour, count(*) AS trips, coalesce(sum(boardings), 0) AS passengers_sum FROM raw_ready_v GROUP BY 1, 2")),
    "duration_by_route": (("route_id",), ("n", "mean", "median", "p95"), _TWINS["d9_duration_by_route"]),
    "finalization_summary": (("end_type",), ("n", "pct"), _TWINS["d5_trip_end_distribution"]),
}


def _long(name: str, frame: DataFrame) -> DataFrame:
    keys, measures, _ = BUNDLE[name]
    return frame.select(
        F.lit(name).alias("bundle"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])))


def _long_sql() -> str:
    def key(keys) -> str:
        return f"concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})" if keys else "''"

    return " UNION ALL ".join(
        f"SELECT '{name}' AS bundle, {key(keys)} AS key, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({twin})"
        for name, (keys, measures, twin) in BUNDLE.items() for m in measures)


def bundle(s, d) -> DataFrame:
    """Every table of the bundle; the ends' table needs resolved ends, which the trips with clean vehicle names have."""
    stages = trip_queries.stages(s, d)
    tables = diagnostics.report_bundle(s, stages, trip_queries.REPORT_COLUMNS)
    ended = {**stages, "end": trip_end.resume_trip_ends(trips(s, d), pings(s, d), rules=RULES)}
    tables["finalization_summary"] = diagnostics.report_bundle(s, ended, trip_queries.REPORT_COLUMNS)["finalization_summary"]
    return diagnostics.union_all([_long(name, tables[name]) for name in BUNDLE])


def prepared(s, d) -> pipeline.Prepared:
    return pipeline.run(trips(s, d), pings(s, d), YARDS, limits=LIMITS, rules=RULES)


QUERIES = [
    Query("d10_report_bundle", "bundle:s key:s measure:s value:f", bundle, _long_sql()),
    Query("p1_pipeline", "route_id:s gran_min:i timestamp:t passengers_sum:f trips:i passengers_mean:f passengers_p95:f",
          lambda s, d: series.demand_bins(prepared(s, d).final), sql("SELECT * FROM p1_bins_v")),
    Query("p1_final_trips", "trip_id:i actual_start:t final_end:t boardings:i",
          lambda s, d: prepared(s, d).final, sql("SELECT * FROM p1_ready_v")),
]

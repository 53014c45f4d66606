"""Queries over GPS pings and trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from busloom.functions.columns import haversine_m
from busloom.operators import diagnostics, gps, places, quality, trip_end
from busloom.plans.common_sql import block, sql
from busloom.plans.registry import Query
from busloom.sources.tables import YARDS, pings, read_table, trips

RULES = trip_end.EndRules(power_off_text="error")


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"(2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - ({a}))))"


block("placed_v", """
  SELECT * FROM (SELECT ping_id, vehicle_id, ping_ts, speed_kmh, message, TRY_CAST(replace(trim(lat), ',', '.') AS DOUBLE) AS la,
    TRY_CAST(replace(trim(lon), ',', '.') AS DOUBLE) AS lo FROM pings_v)
  WHERE la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180""")
block("hits_v", f"""
  SELECT vehicle_id, yard, 1 AS kind, ping_ts FROM pings_v
    JOIN (SELECT DISTINCT yard, yard_lat, yard_lon FROM yards_v) ON contains(upper(message), upper(yard))
  UNION ALL SELECT vehicle_id, yard, 2, ping_ts FROM placed_v
    JOIN (SELECT DISTINCT yard, yard_lat, yard_lon FROM yards_v) ON {haversine_sql('la', 'lo', 'yard_lat', 'yard_lon')} <= 700""")
block("departures_v", """
  SELECT trip_id, route_id, vehicle_id, planned_start, actual_start, search_outcome, window_used, departure_ts FROM (
    SELECT t.*, CASE WHEN h.ping_ts IS NULL THEN 'NO_ENCONTRADO' ELSE 'OK' END AS search_outcome, w.w AS window_used,
      h.ping_ts AS departure_ts,
      row_number() OVER (PARTITION BY t.trip_id ORDER BY h.ping_ts IS NULL, w.w, h.kind, h.ping_ts) AS k
    FROM trips_v t JOIN yards_v y ON t.route_id = y.route_id CROSS JOIN (VALUES (30), (90), (180)) AS w(w)
    LEFT JOIN hits_v h ON h.vehicle_id = t.vehicle_id AND h.yard = y.yard
      AND h.ping_ts BETWEEN t.planned_start - to_minutes(w.w) AND t.planned_start + to_minutes(w.w)
    WHERE t.actual_start IS NULL) WHERE k = 1""")
# Places around the pings, as many as there are parts.
block("places_v", """SELECT 'STOP ' || p_partkey AS place, 3.4 + (p_partkey * 7919 % 1000) / 5000.0::DOUBLE AS place_lat, -76.6 + (p_partkey * 104729 % 1000) / 5000.0::DOUBLE AS place_lon,
  200.0::DOUBLE + 100 * (p_partkey % 5) AS radius_m FROM part""")
block("at_places_v", f"""SELECT * FROM (SELECT p.*, place, radius_m, {haversine_sql('la', 'lo', 'place_lat', 'place_lon')} AS distance_m FROM placed_v p, places_v) WHERE distance_m <= radius_m""")
block("trunc_v", "SELECT * FROM trips_v WHERE actual_end IS NULL")
block("post_v", """
  SELECT t.trip_id, t.actual_start, p.ping_ts, p.ping_id, p.speed_kmh, p.message,
    max(p.ping_ts) OVER (PARTITION BY t.trip_id) AS fin
  FROM trunc_v t JOIN pings_v p ON p.vehicle_id = t.vehicle_id AND p.ping_ts BETWEEN t.actual_start AND t.actual_start + INTERVAL 180 MINUTE""")
block("tail_rank_v", """
  SELECT *, count(speed_kmh) FILTER (ping_ts >= fin - INTERVAL 15 MINUTE) OVER (PARTITION BY trip_id) AS tail_n,
    row_number() OVER (PARTITION BY trip_id ORDER BY speed_kmh IS NULL, ping_ts DESC, ping_id DESC) AS back
  FROM post_v""")
block("tail_stats_v", """
  SELECT trip_id, max(fin) AS fin, bool_or(coalesce(contains(message, 'error'), false) AND ping_ts >= fin - INTERVAL 15 MINUTE) AS off,
    count(speed_kmh) FILTER (used) AS n, count(*) FILTER (used AND speed_kmh <= 3) AS low, median(speed_kmh) FILTER (used) AS med
  FROM (SELECT *, speed_kmh IS NOT NULL AND ((tail_n > 0 AND ping_ts >= fin - INTERVAL 15 MINUTE) OR (tail_n = 0 AND back <= 10)) AS used
    FROM tail_rank_v) GROUP BY 1""")
block("nearby_v", """
  SELECT t.trip_id, count(p.ping_ts) AS pings FROM trunc_v t LEFT JOIN pings_v p ON p.vehicle_id = t.vehicle_id
    AND p.ping_ts BETWEEN t.actual_start - INTERVAL 20 MINUTE AND t.actual_start + INTERVAL 180 MINUTE GROUP BY 1""")
block("ends_v", """
  SELECT trip_id, 0 AS is_complete, estimated_end, end_type, CASE WHEN estimated_end IS NULL THEN 'SIN_INFO' ELSE 'GPS_ESTIMADA' END AS end_source
  FROM (SELECT t.trip_id, s.fin AS estimated_end,
    CASE WHEN t.actual_start IS NULL THEN 'SIN_PLACA_O_INICIO' WHEN b.pings = 0 THEN 'SIN_GPS'
      WHEN s.fin IS NULL THEN 'SIN_GPS_POST_INICIO' WHEN s.n = 0 THEN 'TRUNCADO_INDETERMINADO'
      WHEN CASE WHEN s.off THEN least(1.0, 0.65 * (s.low / s.n::DOUBLE) + 0.35) ELSE s.low / s.n::DOUBLE END >= 0.7 THEN 'TRUNCADO_ABANDONO'
      WHEN s.med >= 12 THEN 'TRUNCADO_RETORNO' ELSE 'TRUNCADO_INDETERMINADO' END AS end_type
    FROM trunc_v t JOIN nearby_v b ON b.trip_id = t.trip_id LEFT JOIN tail_stats_v s ON s.trip_id = t.trip_id)""")
block("earlier_v", """SELECT trip_id, 0 AS is_complete, planned_start AS estimated_end, 'TRUNCADO_RETORNO' AS end_type, 'GPS_ESTIMADA' AS end_source
  FROM trips_v WHERE trip_id % 3 = 0 AND actual_end IS NULL""")


def resolved(s, d):
    return trip_end.resolve_trip_ends(trips(s, d).filter("actual_end is null"), pings(s, d), RULES)


def earlier(s, d):
    """Estimates of an earlier run for a third of the open trips."""
    return trips(s, d).filter("trip_id % 3 = 0 and actual_end is null").select(
        "trip_id", F.lit(0).alias("is_complete"), F.col("planned_start").alias("estimated_end"),
        F.lit(trip_end.RETURNING).alias("end_type"), F.lit(trip_end.ESTIMATED).alias("end_source"))


def many_places(s, d):
    key = F.col("p_partkey")
    return read_table(s, d, "part").select(
        F.concat(F.lit("STOP "), key).alias("place"), (F.lit(3.4) + (key * 7919 % 1000) / F.lit(5000.0)).alias("lat"),
        (F.lit(-76.6) + (key * 104729 % 1000) / F.lit(5000.0)).alias("lon"), (F.lit(200.0) + 100 * (key % 5)).alias("radius_m"))


def stop_pings(s, d):
    """The pings, every tenth of which names a stop."""
    stop = F.concat(F.lit("left Stop "), F.col("ping_id") % 300, F.lit(" now"))
    return pings(s, d).withColumn("message", F.when(F.col("ping_id") % 10 == 0, stop).otherwise(F.col("message")))


def imputed(s, d):
    return gps.impute_departures(trips(s, d), pings(s, d), YARDS)


_DIST = haversine_sql("la", "lo", "3.45::DOUBLE", "-76.53::DOUBLE")
_END_SPEC = "trip_id:i is_complete:i estimated_end:t end_type:s end_source:s"
_MERGED = """SELECT t.trip_id, CASE WHEN t.actual_end IS NOT NULL THEN 1 ELSE coalesce({a}.is_complete, {b}.is_complete, {none}) END AS is_complete,
  coalesce(t.actual_end, {a}.estimated_end, {b}.estimated_end) AS estimated_end,
  CASE WHEN t.actual_end IS NOT NULL THEN 'COMPLETO' ELSE coalesce({a}.end_type, {b}.end_type) END AS end_type,
  CASE WHEN t.actual_end IS NOT NULL THEN 'REAL' ELSE coalesce({a}.end_source, {b}.end_source) END AS end_source
  FROM trips_v t LEFT JOIN earlier_v e ON e.trip_id = t.trip_id
  LEFT JOIN (SELECT * FROM ends_v WHERE end_type <> 'SIN_PLACA_O_INICIO') n ON n.trip_id = t.trip_id"""

QUERIES = [
    Query("g1_haversine", "ping_id:i distance_m:f",
          lambda s, d: gps.yard_distance(pings(s, d), YARDS[0]).withColumn(
              "distance_m", haversine_m("lat", "lon", F.lit(YARDS[0].lat), F.lit(YARDS[0].lon))),
          sql(f"SELECT ping_id, {_DIST} AS distance_m FROM placed_v")),
    Query("g2_fence_entry", "vehicle_id:s entry_ts:t",
          lambda s, d: gps.fence_entry(pings(s, d), YARDS[0]),
          sql(f"SELECT vehicle_id, min(ping_ts) FILTER ({_DIST} <= 1800) AS entry_ts FROM placed_v GROUP BY 1")),
    Query("g3_departure_detection", "vehicle_id:s departure_ts:t",
          lambda s, d: gps.departure_by_yard(pings(s, d), YARDS[1]),
          sql("""SELECT vehicle_id, coalesce(min(ping_ts) FILTER (kind = 1), min(ping_ts) FILTER (kind = 2)) AS departure_ts
                 FROM hits_v WHERE yard = 'Purchase' GROUP BY 1""")),
    Query("g4_impute_departures", "trip_id:i actual_start:t",
          imputed,
          sql("""SELECT t.trip_id, coalesce(t.actual_start, d.departure_ts) AS actual_start
                 FROM trips_v t LEFT JOIN departures_v d ON d.trip_id = t.trip_id""")),
    Query("g5_search_audit", "search_outcome:s window_used:i n:i",
          lambda s, d: gps.search_audit(imputed(s, d)),
          sql("""SELECT search_outcome, CASE WHEN search_outcome = 'OK' THEN window_used END AS window_used, count(*) AS n
                 FROM departures_v GROUP BY 1, 2""")),
    Query("g6_fence_radius_study", "n:i mean:f std:f min:f max:f p50:f p75:f p90:f p95:f p99:f",
          lambda s, d: quality.describe(
              gps.fence_radius_study(trips(s, d), pings(s, d), YARDS), "min_distance_m", width=1.0,
              probs={"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}),
          sql(f"""SELECT count(*) AS n, avg(m) AS mean, stddev_samp(m) AS std, min(m) AS min, max(m) AS max,
                 quantile_cont(m, 0.5) AS p50, quantile_cont(m, 0.75) AS p75, quantile_cont(m, 0.9) AS p90,
                 quantile_cont(m, 0.95) AS p95, quantile_cont(m, 0.99) AS p99 FROM (
                 SELECT t.trip_id, min({haversine_sql('la', 'lo', 'yard_lat', 'yard_lon')}) AS m
                 FROM (SELECT * FROM trips_v WHERE actual_start IS NULL) t
                 JOIN yards_v y ON y.route_id = t.route_id JOIN placed_v p ON p.vehicle_id = t.vehicle_id
                 AND p.ping_ts BETWEEN t.planned_start - INTERVAL 10 MINUTE AND t.planned_start + INTERVAL 10 MINUTE GROUP BY 1)""")),
    Query("g2_many_fences", "vehicle_id:s place:s entry_ts:t last_ts:t pings:i min_distance_m:f",
          lambda s, d: places.place_entries(pings(s, d), many_places(s, d)),
          sql("""SELECT vehicle_id, place, min(ping_ts) AS entry_ts, max(ping_ts) AS last_ts, count(*) AS pings, min(distance_m) AS min_distance_m FROM at_places_v GROUP BY 1, 2""")),
    Query("g3_many_departures", "vehicle_id:s yard:s kind:s pings:i first_ts:t",
          lambda s, d: places.place_hits(stop_pings(s, d), many_places(s, d), summed=True),
          sql("""SELECT vehicle_id, yard, kind, count(*) AS pings, min(ping_ts) AS first_ts FROM (
                 SELECT vehicle_id, place AS yard, 'fence' AS kind, ping_ts FROM at_places_v
                 UNION ALL SELECT vehicle_id, place, 'text', ping_ts FROM pings_v p JOIN places_v ON p.ping_id % 10 = 0 AND contains('LEFT STOP ' || (p.ping_id % 300) || ' NOW', place))
                 GROUP BY 1, 2, 3""")),
    Query("t1_trip_end_types", "end_type:s n:i", lambda s, d: resolved(s, d).groupBy("end_type").agg(F.count("*").alias("n")),
          sql("SELECT end_type, count(*) AS n FROM ends_v GROUP BY 1")),
    Query("t2_resolve_trip_ends", _END_SPEC, resolved, sql("SELECT * FROM ends_v")),
    Query("t3_resume_trip_ends", _END_SPEC,
          lambda s, d: trip_end.resume_trip_ends(trips(s, d), pings(s, d), earlier(s, d), rules=RULES),
          sql(_MERGED.format(a="e", b="n", none="0"))),
    Query("t4_merge_ends", _END_SPEC,
          lambda s, d: trip_end.merge_ends(trips(s, d), earlier(s, d)),
          sql(_MERGED.format(a="e", b="e", none="NULL"))),
    Query("d5_trip_end_distribution", "end_type:s n:i pct:f",
          lambda s, d: diagnostics.trip_end_distribution(
              trip_end.resume_trip_ends(trips(s, d), pings(s, d), rules=RULES)),
          sql("""SELECT end_type, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM trips_v) AS pct FROM (
                 SELECT CASE WHEN t.actual_end IS NOT NULL THEN 'COMPLETO' WHEN t.actual_start IS NULL THEN 'SIN_VALOR' ELSE e.end_type END AS end_type
                 FROM trips_v t LEFT JOIN ends_v e ON e.trip_id = t.trip_id) GROUP BY 1""")),
]

"""Queries over service KPIs and the fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from busloom.operators import fleet, service
from busloom.plans.common_sql import block, minutes, sql
from busloom.plans.registry import Query
from busloom.plans.series_queries import ready, series_30
from busloom.plans.stages import staged
from busloom.sources.tables import long_trips, trips

N_DAYS = 12

block("all_headways_v", f"""
  SELECT *, {minutes('prev', 'actual_start')} AS headway_min FROM (
    SELECT *, lag(actual_start) OVER (PARTITION BY route_id, service_date ORDER BY actual_start, trip_id) AS prev FROM ready_v)""")
block("headways_v", f"""
  SELECT *, CASE WHEN weekday = 5 THEN 'SABADO' WHEN weekday = 6 THEN 'DOMINGO' ELSE 'LABORAL' END AS day_type,
    CASE WHEN start_hour BETWEEN 5 AND 9 THEN 'PICO_MANANA' WHEN start_hour BETWEEN 10 AND 12 THEN 'MEDIODIA'
      WHEN start_hour BETWEEN 13 AND 15 THEN 'PICO_TARDE' WHEN start_hour BETWEEN 16 AND 19 THEN 'TARDE_VALLE' ELSE 'SIN_FRANJA' END AS hour_band
  FROM (SELECT *, {minutes('prev', 'actual_start')} AS headway_min FROM (
    SELECT *, lag(actual_start) OVER (PARTITION BY route_id, service_date ORDER BY actual_start, trip_id) AS prev
    FROM ready_v WHERE start_hour BETWEEN 4 AND 19)) WHERE headway_min BETWEEN 0.1 AND 120""")
_hw = """count(*) AS n, avg(headway_min) AS mean, stddev_samp(headway_min) AS std, stddev_samp(headway_min) / avg(headway_min) AS cv,
  median(headway_min) AS p50, quantile_cont(headway_min, 0.95) AS p95, 100.0 * avg(CAST(headway_min < 3 AS INT)) AS bunching_pct,
  100.0 * avg(CAST(headway_min > 30 AS INT)) AS long_wait_pct"""
block("headway_stats_v", f"""
  SELECT 'route' AS level, route_id, '*' AS band, '*' AS day, -1 AS hour, {_hw} FROM headways_v GROUP BY route_id
  UNION ALL SELECT 'band', route_id, hour_band, day_type, -1, {_hw} FROM headways_v GROUP BY route_id, hour_band, day_type
  UNION ALL SELECT 'hour', route_id, '*', day_type, start_hour, {_hw} FROM headways_v GROUP BY route_id, start_hour, day_type""")
block("loads_v", """
  SELECT *, CASE WHEN load_factor > 0.85 THEN 'SOBRECARGA' WHEN load_factor < 0.4 THEN 'SUBCARGA' ELSE 'OPTIMO' END AS load_state,
    abs(passengers_sum - trips * 80) AS mismatch
  FROM (SELECT *, passengers_sum / (trips * 80)::DOUBLE AS load_factor FROM series_v WHERE gran_min = 30 AND in_hours AND NOT is_gap AND trips > 0)""")
_ld = """count(*) AS n, avg(load_factor) AS mean, median(load_factor) AS p50, quantile_cont(load_factor, 0.95) AS p95,
  100.0 * avg(CAST(load_factor > 0.85 AS INT)) AS over_pct, 100.0 * avg(CAST(load_factor < 0.4 AS INT)) AS under_pct,
  100.0 * avg(CAST(load_factor BETWEEN 0.4 AND 0.85 AS INT)) AS optimal_pct, avg(mismatch) AS mismatch_mean"""
block("long_trips_v", """
  SELECT o_orderkey AS trip_id, 'V' || CAST(o_custkey // 4 AS VARCHAR) AS vehicle_id, o_orderpriority AS route_id,
    o_orderdate + to_minutes(300 + o_orderkey * 7 % 900) AS actual_start, CAST(o_orderdate AS DATE) AS service_date,
    CAST(floor(o_totalprice / 10000) AS BIGINT) AS boardings FROM orders""")
block("weekly_v", """
  SELECT *, NOT (count(*) OVER (PARTITION BY route_id) > 2 AND (week = min(week) OVER (PARTITION BY route_id) OR week = max(week) OVER (PARTITION BY route_id))) AS is_complete
  FROM (SELECT route_id, CAST(date_trunc('week', service_date) AS DATE) AS week, sum(boardings) AS passengers, count(*) AS trips,
    sum(boardings) / count(*)::DOUBLE AS productivity FROM long_trips_v GROUP BY 1, 2)""")
block("detrended_v", """
  SELECT *, intercept + slope * t AS trend, productivity - (intercept + slope * t) + m AS adjusted FROM (
    SELECT *, regr_slope(productivity, t) OVER (PARTITION BY route_id) AS slope, regr_intercept(productivity, t) OVER (PARTITION BY route_id) AS intercept,
      avg(productivity) OVER (PARTITION BY route_id) AS m
    FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY week) - 1 AS t FROM weekly_v WHERE is_complete))""")
block("productivity_v", """
  SELECT route_id, count(*) AS weeks, avg(productivity) AS mean, median(productivity) AS p50, stddev_samp(productivity) AS std,
    max(slope) AS slope_week, max(slope) * 4.33 AS slope_month, arg_min(trend, week) AS first_fitted, arg_max(trend, week) AS last_fitted,
    arg_min(trend, week) - arg_max(trend, week) AS fall FROM detrended_v GROUP BY 1""")
block("next_v", """
  SELECT *, lead(actual_start) OVER w AS next_start, lead(route_id) OVER w AS next_route FROM ready_v
  WINDOW w AS (PARTITION BY vehicle_id, service_date ORDER BY actual_start, trip_id)""")
block("timeline_v", """
  SELECT * FROM (SELECT vehicle_id, service_date, 'EN_RUTA' AS state, actual_start AS start_ts, final_end AS end_ts FROM next_v
    UNION ALL SELECT vehicle_id, service_date, 'EN_PATIO', final_end, next_start FROM next_v) WHERE start_ts < end_ts""")
block("work_days_v", """SELECT service_date, count(*) AS trips FROM ready_v GROUP BY 1
  HAVING count(*) >= 150 AND isodow(service_date) <= 5""")
block("day_rank_v", "SELECT *, row_number() OVER (ORDER BY service_date) - 1 AS r, count(*) OVER () AS n FROM work_days_v")
block("spaced_v", f"""SELECT service_date, trips FROM day_rank_v
  WHERE r IN (SELECT CAST(round_even(i * (n - 1) / {N_DAYS - 1}::DOUBLE, 0) AS INT) FROM range(0, {N_DAYS}) AS s(i))""")
block("yard_v", """
  SELECT g.service_date, g.tick, g.tick_ts, count(t.start_ts) AS in_yard
  FROM (SELECT service_date, i AS tick, CAST(service_date AS TIMESTAMP) + to_minutes(240 + 5 * i) AS tick_ts
    FROM (SELECT DISTINCT service_date FROM ready_v), range(0, 193) AS r(i)) g
  LEFT JOIN timeline_v t ON t.state = 'EN_PATIO' AND t.service_date = g.service_date AND t.start_ts <= g.tick_ts AND t.end_ts > g.tick_ts
  GROUP BY 1, 2, 3""")
_bands = {"morning": (5, 9), "afternoon": (14, 16), "closing": (16.5, 17.5)}
_h = "hour(tick_ts) + minute(tick_ts) / 60.0"
block("bands_v", "SELECT service_date, " + ", ".join(
    f"avg(in_yard) FILTER ({_h} >= {a} AND {_h} < {b}) AS available_{n}, "
    f"100.0 * avg(CAST(in_yard = 0 AS INT)) FILTER ({_h} >= {a} AND {_h} < {b}) AS empty_pct_{n}"
    for n, (a, b) in _bands.items()) + " FROM yard_v GROUP BY 1")
_hs = "hour(actual_start) + minute(actual_start) / 60.0"
block("long_bands_v", "SELECT service_date, " + ", ".join(
    f"count(*) FILTER (headway_min > 15 AND {_hs} >= {a} AND {_hs} < {b}) AS long_{n}" for n, (a, b) in _bands.items())
    + ", count(*) FILTER (headway_min > 15 AND NOT (" + " OR ".join(f"({_hs} >= {a} AND {_hs} < {b})" for a, b in _bands.values())
    + ")) AS long_other FROM all_headways_v GROUP BY 1")
block("by_day_v", """
  SELECT b.*, l.long_morning, l.long_afternoon, l.long_closing, l.long_other, n.trips, n.vehicles FROM bands_v b JOIN spaced_v s ON s.service_date = b.service_date
  JOIN long_bands_v l ON l.service_date = b.service_date
  JOIN (SELECT service_date, count(*) AS trips, count(DISTINCT vehicle_id) AS vehicles FROM ready_v GROUP BY 1) n ON n.service_date = b.service_date""")
_lt = "sum(long_morning + long_afternoon + long_closing + long_other)"
block("fleet_sum_v", "SELECT count(*) AS days, " + f"{_lt} AS long_total, " + ", ".join(
    f"100.0 * sum(long_{n}) / {_lt} AS long_pct_{n}" for n in (*_bands, "other")) + ", " + ", ".join(
    f"avg(available_{n}) AS available_{n}, avg(empty_pct_{n}) AS empty_pct_{n}" for n in _bands) + " FROM by_day_v")
block("monthly_v", """
  SELECT *, passengers / trips::DOUBLE AS passengers_per_trip, trips / vehicles::DOUBLE AS trips_per_vehicle FROM (
    SELECT CAST(date_trunc('month', service_date) AS DATE) AS month, count(DISTINCT vehicle_id) AS vehicles, count(*) AS trips,
      CAST(sum(boardings) AS BIGINT) AS passengers FROM long_trips_v GROUP BY 1)""")
block("inner_months_v", "SELECT * FROM monthly_v WHERE month > (SELECT min(month) FROM monthly_v) AND month < (SELECT max(month) FROM monthly_v)")
block("change_v", " UNION ALL ".join(
    f"""SELECT '{c}' AS indicator, arg_min({c}, month) AS first_month, arg_max({c}, month) AS last_month,
    arg_max({c}, month) - arg_min({c}, month) AS change, 100.0 * (arg_max({c}, month) - arg_min({c}, month)) / arg_min({c}, month) AS change_pct
    FROM inner_months_v""" for c in fleet.MONTH_INDICATORS))
block("vehicle_last_v", """
  SELECT *, months_since >= 2 AS is_retired FROM (SELECT vehicle_id, last_month,
    round(((SELECT max(date_trunc('month', service_date)) FROM long_trips_v)::DATE - last_month) / 30.44, 1) AS months_since
    FROM (SELECT vehicle_id, CAST(max(date_trunc('month', service_date)) AS DATE) AS last_month FROM long_trips_v GROUP BY 1))""")


@staged
def headways(s, d):
    return service.headways(ready(s, d))


@staged
def detrended(s, d):
    return service.detrended_productivity(service.weekly_productivity(long_trips(s, d)))


def loads(s, d):
    return service.load_factors(series_30(s, d))


def work_days(s, d):
    return fleet.working_days(ready(s, d))


def occupancy(s, d):
    r = ready(s, d)
    return fleet.yard_occupancy(fleet.vehicle_timeline(r), r.select("service_date"))


@staged
def by_day(s, d):
    return fleet.availability_by_day(ready(s, d), fleet.spaced_days(work_days(s, d), N_DAYS))


def recommendations(s, d):
    """One more trip than run in every week, as an example input."""
    w = service.weekly_productivity(long_trips(s, d))
    return w.select("route_id", "week", "trips", (F.col("trips") + 1).alias("recommended_trips"))


def _consolidated(s, d):
    return service.kpi_table(
        service.headway_stats(headways(s, d)), service.productivity_summary(detrended(s, d)),
        fleet.availability_summary(by_day(s, d)), fleet.first_last_month(fleet.monthly_fleet(long_trips(s, d))))


def _long_sql(section: str, table: str, names, route: str, where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, {route} AS route_id, '{n}' AS indicator, {n} AS value FROM {table} {where}" for n in names)


_BAND_SPEC = " ".join(f"available_{n}:f empty_pct_{n}:f" for n in _bands)
_STAT = "n:i mean:f std:f cv:f p50:f p95:f bunching_pct:f long_wait_pct:f"

QUERIES = [
    Query("k1_headways", "trip_id:i route_id:s service_date:d headway_min:f", headways, sql("SELECT * FROM headways_v")),
    Query("k2_hour_bands", "trip_id:i hour_band:s day_type:s", headways, sql("SELECT * FROM headways_v")),
    Query("k3_headway_stats", f"level:s route_id:s band:s day:s hour:i {_STAT}",
          lambda s, d: service.headway_stats(headways(s, d)), sql("SELECT * FROM headway_stats_v")),
    Query("k4_regularity_class", "route_id:s cv:f regularity:s",
          lambda s, d: service.headway_stats(headways(s, d)).filter("level = 'route'").withColumn(
              "regularity", service.regularity(F.col("cv"))),
          sql("""SELECT route_id, cv, CASE WHEN cv > 0.68 THEN 'IRREGULAR' WHEN cv > 0.37 THEN 'MODERADO' ELSE 'REGULAR' END AS regularity
                 FROM headway_stats_v WHERE level = 'route'""")),
    Query("k5_load_factors", "route_id:s timestamp:t load_factor:f load_state:s mismatch:f", loads, sql("SELECT * FROM loads_v")),
    Query("k6_load_stats", "route_id:s part:s day:s n:i mean:f p50:f p95:f over_pct:f under_pct:f optimal_pct:f mismatch_mean:f",
          lambda s, d: service.load_stats(loads(s, d)),
          sql(f"""SELECT route_id, '*' AS part, '*' AS day, {_ld} FROM loads_v GROUP BY 1
                 UNION ALL SELECT route_id, day_part, day_type, {_ld} FROM loads_v GROUP BY 1, 2, 3""")),
    Query("k7_load_distribution", "route_id:s load_state:s n:i pct:f",
          lambda s, d: service.load_distribution(loads(s, d)),
          sql("""SELECT route_id, load_state, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY route_id) AS pct
                 FROM loads_v GROUP BY 1, 2""")),
    Query("k8_supply_demand_mismatch", "route_id:s dissimilarity:f relocate_pct:f mean_abs_diff:f slots:i",
          lambda s, d: service.supply_demand_dissimilarity(series_30(s, d)),
          sql("""SELECT route_id, sum(g) / 2 AS dissimilarity, sum(g) * 50 AS relocate_pct, avg(g) AS mean_abs_diff, count(*) AS slots FROM (
                 SELECT route_id, abs(a / sum(a) OVER (PARTITION BY route_id) - b / sum(b) OVER (PARTITION BY route_id)) AS g FROM (
                 SELECT route_id, minute, avg(coalesce(trips, 0)) AS a, avg(coalesce(passengers_sum, 0)) AS b FROM series_v
                 WHERE gran_min = 30 AND in_hours AND day_type = 'LABORAL' GROUP BY 1, 2)) GROUP BY 1""")),
    Query("k9_weekly_productivity", "route_id:s week:d passengers:i trips:i productivity:f is_complete:b",
          lambda s, d: service.weekly_productivity(long_trips(s, d)), sql("SELECT * FROM weekly_v")),
    Query("k10_detrended_productivity", "route_id:s week:d productivity:f trend:f adjusted:f", detrended, sql("SELECT * FROM detrended_v")),
    Query("k11_productivity_summary",
          "route_id:s weeks:i mean:f p50:f std:f slope_week:f slope_month:f first_fitted:f last_fitted:f fall:f",
          lambda s, d: service.productivity_summary(detrended(s, d)), sql("SELECT * FROM productivity_v")),
    Query("k12_vehicle_timeline", "vehicle_id:s service_date:d state:s start_ts:t end_ts:t",
          lambda s, d: fleet.vehicle_timeline(ready(s, d)), sql("SELECT * FROM timeline_v")),
    Query("k13_yard_occupancy", "service_date:d tick:i tick_ts:t in_yard:i", occupancy, sql("SELECT * FROM yard_v")),
    Query("k14_band_availability", "service_date:d " + _BAND_SPEC,
          lambda s, d: fleet.band_availability(occupancy(s, d)), sql("SELECT * FROM bands_v")),
    Query("k15_long_headways", "service_date:d long_morning:i long_afternoon:i long_closing:i long_other:i",
          lambda s, d: fleet.long_headways_by_band(ready(s, d)), sql("SELECT * FROM long_bands_v")),
    Query("k16_spaced_days", "service_date:d trips:i",
          lambda s, d: fleet.spaced_days(work_days(s, d), N_DAYS), sql("SELECT * FROM spaced_v")),
    Query("k16_strided_days", "service_date:d trips:i",
          lambda s, d: fleet.every_kth_day(work_days(s, d), 5),
          sql("SELECT service_date, trips FROM day_rank_v WHERE r % greatest(n // 5, 1) = 0 AND r < 5 * greatest(n // 5, 1)")),
    Query("k17_availability_by_day", f"service_date:d {_BAND_SPEC} long_morning:i long_afternoon:i long_closing:i long_other:i trips:i vehicles:i",
          by_day, sql("SELECT * FROM by_day_v")),
    Query("k17_availability_summary", "days:i long_total:i " + " ".join(f"long_pct_{n}:f" for n in (*_bands, "other")) + " " + _BAND_SPEC,
          lambda s, d: fleet.availability_summary(by_day(s, d)), sql("SELECT * FROM fleet_sum_v")),
    Query("k18_availability_before_gaps", "service_date:d trip_id:i headway_min:f in_yard_before:f",
          lambda s, d: fleet.availability_before_gaps(ready(s, d), occupancy(s, d)),
          sql("""SELECT h.service_date, h.trip_id, h.headway_min, avg(y.in_yard) AS in_yard_before FROM all_headways_v h LEFT JOIN yard_v y
                 ON y.service_date = h.service_date AND y.tick_ts BETWEEN h.actual_start - INTERVAL 15 MINUTE AND h.actual_start - INTERVAL 5 MINUTE
                 WHERE h.headway_min > 20 GROUP BY 1, 2, 3""")),
    Query("k19_turnarounds", "n:i negative:i negative_pct:f within_minute:i mean:f std:f min:f max:f",
          lambda s, d: fleet.turnaround_summary(fleet.turnarounds(ready(s, d))),
          sql(f"""SELECT count(*) AS n, count(*) FILTER (g < 0) AS negative, 100.0 * avg(CAST(g < 0 AS INT)) AS negative_pct,
                 count(*) FILTER (g BETWEEN 0 AND 1) AS within_minute, avg(g) FILTER (g >= 0) AS mean, stddev_samp(g) FILTER (g >= 0) AS std,
                 min(g) FILTER (g >= 0) AS min, max(g) FILTER (g >= 0) AS max FROM (SELECT {minutes('final_end', 'next_start')} AS g FROM next_v WHERE next_start IS NOT NULL)""")),
    Query("k20_vehicle_day_distribution", "n:i mean:f std:f min:i max:i p25:f p50:f p75:f mode:i",
          lambda s, d: fleet.vehicle_day_distribution(fleet.trips_per_vehicle_day(ready(s, d))),
          sql("""WITH c AS (SELECT count(*) AS k FROM ready_v GROUP BY vehicle_id, service_date)
                 SELECT count(*) AS n, avg(k) AS mean, stddev_samp(k) AS std, min(k) AS min, max(k) AS max, quantile_cont(k, 0.25) AS p25,
                 quantile_cont(k, 0.5) AS p50, quantile_cont(k, 0.75) AS p75,
                 (SELECT k FROM c GROUP BY k ORDER BY count(*) DESC, k LIMIT 1) AS mode FROM c""").replace("\nWITH c AS", ",\nc AS")),
    Query("k20_vehicle_day_histogram", "n_trips:i n:i",
          lambda s, d: fleet.vehicle_day_histogram(fleet.trips_per_vehicle_day(ready(s, d))),
          sql("""SELECT k AS n_trips, count(*) AS n FROM (SELECT count(*) AS k FROM ready_v GROUP BY vehicle_id, service_date)
                 GROUP BY 1 ORDER BY 1 LIMIT 10""")),
    Query("k21_route_changes", "n:i changed:i changed_pct:f kept_pct:f",
          lambda s, d: fleet.route_changes(ready(s, d)),
          sql("""SELECT count(*) AS n, count(*) FILTER (route_id <> next_route) AS changed, 100.0 * avg(CAST(route_id <> next_route AS INT)) AS changed_pct,
                 100.0 * avg(CAST(route_id = next_route AS INT)) AS kept_pct FROM next_v WHERE next_route IS NOT NULL""")),
    Query("k22_busiest_vehicles", "vehicle_id:s trips:i busiest_day:d busiest_day_trips:i",
          lambda s, d: fleet.busiest_vehicles(ready(s, d)),
          sql("""SELECT vehicle_id, trips, service_date AS busiest_day, k AS busiest_day_trips FROM (
                 SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY k DESC, service_date) AS r, sum(k) OVER (PARTITION BY vehicle_id) AS trips
                 FROM (SELECT vehicle_id, service_date, count(*) AS k FROM ready_v GROUP BY 1, 2)) WHERE r = 1 ORDER BY trips DESC, vehicle_id LIMIT 5""")),
    Query("k23_monthly_fleet", "month:d vehicles:i trips:i passengers:i passengers_per_trip:f trips_per_vehicle:f",
          lambda s, d: fleet.monthly_fleet(long_trips(s, d)), sql("SELECT * FROM monthly_v")),
    Query("k24_first_last_month", "indicator:s first_month:f last_month:f change:f change_pct:f",
          lambda s, d: fleet.first_last_month(fleet.monthly_fleet(long_trips(s, d))), sql("SELECT * FROM change_v")),
    Query("k25_vehicle_activity", "vehicle_id:s last_month:d months_since:f is_retired:b",
          lambda s, d: fleet.vehicle_activity(long_trips(s, d)), sql("SELECT * FROM vehicle_last_v")),
    Query("k25_retirements", "last_month:d retired:i",
          lambda s, d: fleet.retirements_by_month(fleet.vehicle_activity(long_trips(s, d))),
          sql("SELECT last_month, count(*) AS retired FROM vehicle_last_v WHERE is_retired GROUP BY 1")),
    Query("k26_kpi_table", "section:s route_id:s indicator:s value:f", _consolidated,
          sql(_long_sql("headway", "headway_stats_v", ("mean", "std", "cv", "p95", "bunching_pct", "long_wait_pct"), "route_id", "WHERE level = 'route'")
              + " UNION ALL SELECT 'fleet_change', NULL, indicator, change_pct FROM change_v UNION ALL "
              + _long_sql("productivity", "productivity_v", ("mean", "std", "slope_month"), "route_id") + " UNION ALL "
              + _long_sql("availability", "fleet_sum_v", ("days", "empty_pct_morning", "empty_pct_afternoon", "empty_pct_closing",
                                                          "long_pct_morning", "long_pct_other"), "NULL"))),
    Query("k27_seat_turnover", "trips:i passengers:i seat_turnover:f duration_mean:f retention_pct:f",
          lambda s, d: service.seat_turnover(ready(s, d), trips(s, d)),
          sql("""SELECT count(*) AS trips, sum(boardings) AS passengers, avg(boardings) / 28 AS seat_turnover, avg(duration_min) AS duration_mean,
                 100.0 * count(*) / (SELECT count(*) FROM trips_v) AS retention_pct FROM ready_v""")),
    Query("b19_recoverable_demand", "route_id:s week:d recoverable:f",
          lambda s, d: service.recoverable_demand(recommendations(s, d), service.productivity_summary(detrended(s, d)).withColumnRenamed(
              "mean", "productivity")),
          sql("""SELECT w.route_id, w.week, (w.trips + 1 - w.trips) * p.mean AS recoverable FROM weekly_v w
                 JOIN productivity_v p ON p.route_id = w.route_id""")),
]

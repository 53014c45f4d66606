"""Queries over sources, sinks and streams."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators import normalize, quality
from busloom.plans.common_sql import block, minutes, sql
from busloom.plans.gps_queries import RULES
from busloom.plans.registry import Query
from busloom.plans.series_queries import plain_series, ready
from busloom.plans.stages import staged
from busloom.plans.trip_queries import qc_table
from busloom.session import shared_dir
from busloom.sources import extract, files
from busloom.sources.tables import pings_from_events, raw_trips_from_events, read_table, trips, trips_from_events
from busloom.streaming import streams, trip_tails

# An event that no real one follows; it closes the replayed streams.
CLOSING = {"event_id": 1, "ts": "9000-01-01 00:00:00", "user_id": 0, "event_type": "closing", "value": 0.0}

block("counters_v", """SELECT l_orderkey AS trip_id, l_partkey * 1000 + l_suppkey AS counter_id, l_shipdate AS exit_date, CAST(l_quantity AS BIGINT) AS boardings_raw
  FROM lineitem""")
block("points_v", """SELECT l_orderkey AS trip_id, max(l_shipdate) FILTER (l_linenumber = 1) AS actual_start, max(l_shipdate) FILTER (l_linenumber = 3) AS actual_end,
  max(l_linestatus) FILTER (l_linenumber = 3) AS trip_status FROM lineitem GROUP BY 1""")
block("door_v", """SELECT l_partkey * 1000 + l_suppkey AS counter_id, sum(l_linenumber) AS door_alarms FROM lineitem
  WHERE CAST(CAST(l_quantity AS BIGINT) % 8 AS VARCHAR) IN ('5', '6') GROUP BY 1""")
block("pos_pings_v", "SELECT *, lag(ping_ts) OVER (PARTITION BY vehicle_id ORDER BY ping_ts, ping_id) AS before FROM pings_v")
block("runs_v", """SELECT *, sum(CASE WHEN before IS NULL OR ping_ts > before + INTERVAL 20 MINUTE THEN 1 ELSE 0 END)
  OVER (PARTITION BY vehicle_id ORDER BY ping_ts, ping_id) AS run FROM pos_pings_v""")


def extracted(s, d) -> DataFrame:
    o, li, cust = (read_table(s, d, t) for t in ("orders", "lineitem", "customer"))
    counter = (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("counter_id")
    intervals = o.select(
        F.col("o_orderkey").alias("trip_id"), F.col("o_orderdate").alias("start_date"), F.col("o_orderpriority").alias("route_id"),
        F.col("o_custkey").alias("vehicle_key"), F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("row_status"))
    counters = li.select(
        F.col("l_orderkey").alias("trip_id"), counter, F.col("l_shipdate").alias("exit_date"), F.col("l_quantity").cast("long").alias("boardings_raw"))
    sheet = li.select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("point_type"),
                      F.col("l_shipdate").alias("actual_clock"), F.col("l_linestatus").alias("trip_status"))
    alarms = li.select(counter, (F.col("l_quantity").cast("long") % 8).cast("string").alias("alarm_kind"), F.col("l_linenumber").alias("quantity"))
    vehicles = cust.select(F.col("c_custkey").alias("vehicle_key"), F.col("c_name").alias("vehicle_id"))
    return extract.extract_trips(intervals, counters, sheet, alarms, vehicles, "1996-01-01", "1999-12-31", 1000)


def _scratch(s) -> str:
    return f"{shared_dir(s)}/busloom-io-{uuid4().hex}"


def named_vehicles(s, d) -> DataFrame:
    e = read_table(s, d, "events")
    raw = raw_trips_from_events(e).join(e.select(F.col("event_id").alias("row_id"), F.floor(F.col("user_id") / 8).alias("vehicle_key")), "row_id")
    known = e.select(F.floor(F.col("user_id") / 8).alias("vehicle_key")).distinct()
    return extract.fill_vehicle_names(raw, known.withColumn("vehicle_id", F.concat(F.lit("V"), F.col("vehicle_key").cast("string"))))


def appended(s, d) -> DataFrame:
    t = trips(s, d)
    return extract.append_newer(t.filter(F.col("planned_start") < F.lit("2024-01-20").cast("timestamp_ntz")), t, order=("planned_start",))


def csv_back(s, d) -> DataFrame:
    t = ready(s, d).select("trip_id", "route_id", "service_date", "boardings")
    path = f"{_scratch(s)}/ready.csv"
    t.write.option("header", True).csv(path)
    return files.read_dataset(s, path, t.schema)


def series_back(s, d) -> DataFrame:
    path = f"{_scratch(s)}/series"
    files.write_series(plain_series(s, d), path)
    return files.read_series(s, path)


def series_by_name(s, d) -> DataFrame:
    path = f"{_scratch(s)}/series"
    files.write_series(plain_series(s, d), path)
    return files.read_named_files(s, path, r"route_id=([^/]+)/gran_min=(\d+)", {"route_id": "string", "gran_min": "int"})


def snapshots(s, d) -> DataFrame:
    t = ready(s, d).select("trip_id", "boardings")
    paths = files.write_snapshot(t, _scratch(s), "trips_ready", "20240131_000000")
    parts = [files.read_dataset(s, p, t.schema).agg(F.lit(k).alias("version"), F.count("*").alias("n"), F.sum("boardings").alias("passengers"))
             for k, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def quality_split(s, d) -> DataFrame:
    paths = files.write_quality_split(qc_table(s, d), _scratch(s))
    parts = [s.read.parquet(p).agg(F.lit(k).alias("part"), F.count("*").alias("n")) for k, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def doubled_columns(s, d) -> DataFrame:
    t = trips(s, d).withColumns({"planned_copy": F.col("planned_start"), "boardings_copy": F.col("boardings"), "vehicle_copy": F.col("vehicle_id")})
    return files.identical_columns(t, "trip_id")


def stream_of(s, d, adapter) -> DataFrame:
    return adapter(streams.read_growing(s, d, "events"))


_PAIRS = [("planned_start", "planned_copy"), ("boardings", "boardings_copy"), ("vehicle_id", "vehicle_copy")]

QUERIES = [
    Query("io1_extract_trips", "trip_id:i counter_id:i start_date:t actual_start:t actual_end:t trip_status:s boardings_raw:i door_alarms:i vehicle_id:s route_id:s", extracted,
          sql("""SELECT o.o_orderkey AS trip_id, c.counter_id, o.o_orderdate AS start_date, p.actual_start, p.actual_end, p.trip_status, c.boardings_raw,
                 coalesce(a.door_alarms, 0) AS door_alarms, v.c_name AS vehicle_id, o.o_orderpriority AS route_id
                 FROM orders o JOIN counters_v c ON c.trip_id = o.o_orderkey LEFT JOIN points_v p ON p.trip_id = o.o_orderkey
                 LEFT JOIN door_v a ON a.counter_id = c.counter_id LEFT JOIN customer v ON v.c_custkey = o.o_custkey
                 WHERE o.o_orderdate BETWEEN '1996-01-01' AND '1999-12-31' AND o.o_orderstatus <> 'P' AND o.o_orderkey > 1000
                 AND c.exit_date BETWEEN '1996-01-01' AND '1999-12-31'""")),
    Query("io2_append_newer", "trip_id:i planned_start:t boardings:i", appended,
          sql("""SELECT * FROM trips_v WHERE planned_start < '2024-01-20' OR trip_id > (SELECT max(trip_id) FROM trips_v WHERE planned_start < '2024-01-20')""")),
    Query("io3_pings_of_vehicle", "ping_id:i ping_ts:t speed_kmh:f message:s",
          lambda s, d: extract.pings_of(pings_from_events(read_table(s, d, "events")), "V1", "2024-01-05 00:00:00", "2024-01-20 00:00:00"),
          sql("SELECT * FROM pings_v WHERE vehicle_id = 'V1' AND ping_ts BETWEEN '2024-01-05' AND '2024-01-20' ORDER BY ping_ts, ping_id")),
    Query("io4_vehicle_names", "row_id:i vehicle_id:s", named_vehicles,
          sql("SELECT r.row_id, coalesce(r.vehicle_id, t.vehicle_id) AS vehicle_id FROM raw_trips_v r JOIN trips_v t ON t.trip_id = r.row_id")),
    Query("io5_csv_round_trip", "trip_id:i route_id:s service_date:d boardings:i", csv_back, sql("SELECT * FROM ready_v")),
    Query("io6_partitioned_series", "route_id:s gran_min:i timestamp:t passengers_sum:f", series_back, sql("SELECT * FROM grid_v")),
    Query("io6_series_by_file_name", "route_id:s gran_min:i timestamp:t passengers_sum:f", series_by_name, sql("SELECT * FROM grid_v")),
    Query("io7_snapshots", "version:s n:i passengers:i", snapshots,
          sql("""SELECT version, n, passengers FROM (SELECT count(*) AS n, sum(boardings) AS passengers FROM ready_v), (VALUES ('latest'), ('frozen'), ('csv')) AS v(version)""")),
    Query("io8_quality_split", "part:s n:i", quality_split,
          sql("""SELECT 'all' AS part, count(*) AS n FROM flagged_v UNION ALL SELECT 'pass', count(*) FILTER (NOT qc_hard_fail) FROM flagged_v
                 UNION ALL SELECT 'excluded', count(*) FILTER (qc_hard_fail) FROM flagged_v""")),
    Query("io9_profile", "item:s value:i", lambda s, d: files.profile(trips(s, d), "actual_end", "route_id"),
          sql("""SELECT 'rows' AS item, count(*) AS value FROM trips_v UNION ALL SELECT 'columns', 11 UNION ALL SELECT 'actual_end_missing', count(*) - count(actual_end) FROM trips_v
                 UNION ALL SELECT 'route_id=' || route_id, count(*) FROM trips_v GROUP BY route_id""")),
    Query("io9_describe", "route_id:s n:i mean:f std:f min:f max:f p50:f p90:f p95:f p99:f",
          lambda s, d: quality.describe(normalize.model_ready(trips(s, d)), "duration_min", ["route_id"]),
          sql(f"""SELECT route_id, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.9) AS p90,
                 quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99 FROM (SELECT route_id, {minutes('actual_start', 'final_end')} AS x FROM ready_v) GROUP BY 1""")),
    Query("io10_fingerprint", "n_rows:i checksum:s", lambda s, d: files.fingerprint(trips(s, d)),
          sql("SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(
              f"coalesce({c}, '\\N')" for c in (
                  "CAST(trip_id AS VARCHAR)", "vehicle_id", "route_id", "CAST(epoch_us(planned_start) AS VARCHAR)", "CAST(epoch_us(actual_start) AS VARCHAR)",
                  "CAST(epoch_us(actual_end) AS VARCHAR)", "CAST(boardings_raw AS VARCHAR)", "CAST(door_alarms AS VARCHAR)", "CAST(boardings AS VARCHAR)",
                  "printf('%.9e', distance)", "CAST(trip_status AS VARCHAR)")) + ")), 1, 15) AS HUGEINT)) AS VARCHAR) AS checksum FROM trips_v")),
    Query("io11_identical_columns", "column_a:s column_b:s", doubled_columns,
          sql(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b FROM trips_v HAVING count(*) > 0" for a, b in _PAIRS))),
    Query("st1_stream_dedup", "trip_id:i",
          lambda s, d: streams.run_available(streams.dedup_trips(stream_of(s, d, raw_trips_from_events)).select("trip_id")),
          sql("SELECT DISTINCT trip_id FROM raw_trips_v WHERE trip_id IS NOT NULL AND actual_start IS NOT NULL")),
    Query("st1_exact_dedup", "trip_id:i",
          lambda s, d: streams.dedup_exactly(
              stream_of(s, d, raw_trips_from_events).filter("actual_start IS NOT NULL"), f"{shared_dir(s)}/stream-{uuid4().hex}", order=["actual_start", "row_id"]).select("trip_id"),
          sql("SELECT DISTINCT trip_id FROM raw_trips_v WHERE trip_id IS NOT NULL AND actual_start IS NOT NULL")),
    Query("st2_stream_bins", "bin_start:t route_id:s trips:i passengers_sum:i passengers_p95:f",
          lambda s, d: streams.replay(s, d, "events", lambda e: streams.demand_bins(trips_from_events(e)), CLOSING),
          sql("""SELECT time_bucket(INTERVAL 30 MINUTE, actual_start) AS bin_start, route_id, count(*) AS trips, sum(boardings) AS passengers_sum,
                 quantile_cont(boardings, 0.95) AS passengers_p95 FROM trips_v WHERE actual_start IS NOT NULL GROUP BY 1, 2""")),
    Query("st3_stream_sessions", "vehicle_id:s first_ping:t last_ping:t pings:i speed_mean:f last_speed:f",
          lambda s, d: streams.replay(s, d, "events", lambda e: streams.ping_sessions(pings_from_events(e)), CLOSING),
          sql("""SELECT vehicle_id, min(ping_ts) AS first_ping, max(ping_ts) AS last_ping, count(*) AS pings, avg(speed_kmh) AS speed_mean,
                 last(speed_kmh ORDER BY ping_ts) FILTER (speed_kmh IS NOT NULL) AS last_speed FROM runs_v GROUP BY vehicle_id, run""")),
    Query("st3_stream_trip_ends", "vehicle_id:s actual_start:t estimated_end:t end_type:s",
          lambda s, d: streams.replay(
              s, d, "events", lambda e: trip_tails.trip_ends(trips_from_events(e).filter("actual_end IS NULL"), pings_from_events(e), RULES).drop("held_pings"),
              CLOSING | {"ts": "2200-01-01 00:00:00"}),  # pandas knows no later centuries
          sql("""SELECT DISTINCT t.vehicle_id, t.actual_start, e.estimated_end, e.end_type FROM trunc_v t JOIN ends_v e ON e.trip_id = t.trip_id
                 WHERE t.actual_start IS NOT NULL AND trim(t.vehicle_id) <> ''""")),
]

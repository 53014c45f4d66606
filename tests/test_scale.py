"""Hot keys, years and windows outside the benchmark's, plans without shuffles by hot keys, and the whole chain."""

import random
from datetime import date, datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from busloom import pipeline
from busloom.functions.calendar import holidays, is_holiday
from busloom.functions.columns import haversine_m
from busloom.operators import baselines, gps, quality, series, trip_end
from busloom.plans.catalog import all_queries
from busloom.streaming import streams

FOLDER = "/root/testdata/sf0.001"
T0 = datetime(2024, 4, 16, 8, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_holidays_of_any_year(spark):
    days = spark.sql("SELECT explode(sequence(DATE '1985-01-01', DATE '2060-12-31')) AS day").withColumn("h", is_holiday(F.col("day")))
    assert [r.day for r in days.filter("h").orderBy("day").collect()] == holidays(1985, 2060)
    new_year = spark.createDataFrame([(datetime(2031, 1, 1, 9),), (datetime(2031, 1, 2, 9),)], "timestamp timestamp_ntz")
    assert [r.day_type for r in series.add_calendar(new_year).orderBy("timestamp").collect()] == ["FESTIVO", "LABORAL"]


def test_a_window_of_999_days_and_all_history(spark):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(1500)]
    rows = spark.createDataFrame(
        [("r", datetime(d.year, d.month, d.day, 8), d, "LABORAL", float(i)) for i, d in enumerate(days)],
        "route_id string, timestamp timestamp_ntz, service_day date, day_type string, passengers_sum double")
    cut = days[1400]
    found = {r.window_days: r.bias for r in baselines.window_sweep(rows, [str(cut)], [7, 999, None]).collect()}
    evaluated = sum(range(1400, 1414)) / 14
    for window, start in ((7, 1393), (999, 401), (None, 0)):
        assert found[window] == pytest.approx(sum(range(start, 1400)) / (1400 - start) - evaluated)


def test_ends_with_one_busy_vehicle(spark, monkeypatch):
    """A vehicle with over a third of all pings, many of them in tails split exactly in half by the limit."""
    monkeypatch.setattr(trip_end, "SPEED_BLOCK", 4)
    draw = random.Random(8)
    pings = [("hot", at(draw.randrange(0, 40000) / 10), float(draw.choice([5, 9, 11, 12, 14, 30]))) for _ in range(2500)]
    pings += [(f"v{i % 40}", at(draw.randrange(0, 40000) / 10), float(draw.choice([5, 11, 13]))) for i in range(2500)]
    starts = [(i, "hot" if i % 3 == 0 else f"v{i % 40}", at(draw.randrange(0, 3900))) for i in range(300)]
    rules = trip_end.EndRules(after_min=30)
    frame = spark.createDataFrame([(i, v, t, s, "") for i, (v, t, s) in enumerate(pings)], "ping_id long, vehicle_id string, ping_ts timestamp_ntz, speed_kmh double, message string")
    trips = spark.createDataFrame(starts, "trip_id long, vehicle_id string, actual_start timestamp_ntz")
    found = {r.trip_id: (r.end_type, r.estimated_end) for r in trip_end.resolve_trip_ends(trips, frame, rules).collect()}
    split = 0
    for trip, vehicle, start in starts:
        own = sorted((t, s) for v, t, s in pings if v == vehicle and start <= t <= start + timedelta(minutes=30))
        if not own:
            assert found[trip][1] is None
            continue
        end = own[-1][0]
        tail = [s for t, s in own if t >= end - timedelta(minutes=15)]
        split += sum(s >= 12 for s in tail) * 2 == len(tail)
        low = sum(s <= 3 for s in tail) / len(tail)
        expected = trip_end.ABANDONED if low >= 0.7 else trip_end.RETURNING if median(tail) >= 12 else trip_end.UNDETERMINED
        assert found[trip] == (expected, end), trip
    assert split > 10


def test_fence_study_is_the_minimum_over_all_trips(spark):
    draw = random.Random(9)
    yards = (gps.Yard("North", 3.45, -76.53, ("a",)), gps.Yard("South", 3.47, -76.5, ("b",)))
    pings = [("hot" if i % 2 else "v1", at(draw.randrange(0, 6000) / 10), f"{3.4 + draw.random() / 10:.4f}", "-76.5300") for i in range(400)]
    trips = [(2**60 + i, draw.choice(["hot", "v1", "v2"]), draw.choice("abc"), at(draw.randrange(0, 600)), None if i % 4 else T0) for i in range(300)]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(pings)], "ping_id long, vehicle_id string, ping_ts timestamp_ntz, lat string, lon string")
    t = spark.createDataFrame(trips, "trip_id long, vehicle_id string, route_id string, planned_start timestamp_ntz, actual_start timestamp_ntz")
    found = {r.trip_id: r.min_distance_m for r in gps.fence_radius_study(t, p, yards).collect()}
    points = spark.createDataFrame([(float(r[2]),) for r in pings], "lat double").withColumns({
        y.name: haversine_m(F.col("lat"), F.lit(-76.53), F.lit(y.lat), F.lit(y.lon)) for y in yards}).distinct()
    far = {r.lat: {"a": r.North, "b": r.South} for r in points.collect()}
    expected = {}
    for trip, vehicle, route, plan, start in trips:
        near = [far[float(lat)][route] for v, ts, lat, _ in pings if v == vehicle and abs(ts - plan) <= timedelta(minutes=10)] if route != "c" and start is None else []
        if near:
            expected[trip] = min(near)
    assert len(expected) > 60 and found == pytest.approx(expected)


def test_flags_do_not_shuffle_trips_by_route(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        rows = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr(
            "event_id AS trip_id", "event_type AS route_id", "'v' AS vehicle_id", "ts AS actual_start", "ts + INTERVAL 1 HOUR AS actual_end",
            "int(value) AS boardings_raw", "value AS distance", "0 AS trip_status")
        plan = quality.flag_trips(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    main = plan.split("Subquery")[0]
    assert "hashpartitioning(route_id" not in main.split("===== Subqueries =====")[0].replace("Subquery", "")


def test_streams_hand_out_their_last_windows(spark, tmp_path):
    """Two input files; the second has a late copy of a trip, and the last bins are still open at its end."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    first = spark.createDataFrame([(1, at(0), 1, "r", 5.0), (2, at(10), 1, "r", 7.0)], schema)
    second = spark.createDataFrame([(1, at(20), 1, "r", 5.0), (3, at(300), 1, "r", 9.0)], schema)
    first.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    second.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")

    def bins(e):
        return streams.demand_bins(e.selectExpr("event_id AS trip_id", "ts AS actual_start", "event_type AS route_id", "CAST(value AS BIGINT) AS boardings"))

    closing = {"event_id": 1, "ts": "9000-01-01 00:00:00", "user_id": 0, "event_type": "closing", "value": 0.0}
    rows = streams.replay(spark, str(tmp_path), "events", bins, closing).collect()
    assert sorted((r.trips, r.passengers_sum) for r in rows) == [(1, 9), (3, 17)]


def test_the_whole_chain_on_raw_records(spark):
    """22 raw records, of which two are on lines that are not studied; every kept trip comes out complete."""
    rows = []
    for i in range(20):
        start = datetime(2024, 4, 16, 5, 30) + timedelta(minutes=30 * i)
        end = start + timedelta(minutes=90)
        day = start.strftime("%Y-%m-%d")
        rows.append((i, day, day, f"{start:%H:%M:%S}", f"{start:%H:%M:%S}", None, f"{end:%H:%M:%S}", f"{end:%H:%M:%S}", None, 1 if i % 2 == 0 else 3, str(10 + i), "1", 12.5, 100 + i, 0, f"P{i}"))
    rows += [(20 + k, *rows[0][1:9], route, *rows[0][10:]) for k, route in enumerate((2, 4))]
    raw = spark.createDataFrame(rows, """trip_id long, start_date string, end_date string, planned_start string, actual_start string, aux_start string,
        planned_end string, actual_end string, aux_end string, route_id int, boardings_raw string, door_alarms string, distance double, driver_key long, trip_status int, vehicle_id string""")
    pings = spark.createDataFrame([], "ping_id long, vehicle_id string, ping_ts timestamp_ntz, speed_kmh double, message string, lat string, lon string")
    yards = (gps.Yard("North", 3.45, -76.53, (1, 3)),)
    done = pipeline.run(pipeline.normalized(raw, routes=(1, 3)), pings, yards, limits=quality.QualityLimits(duration_percentile=1.0, boardings_percentile=1.0))
    final = done.final.collect()
    assert len(final) == 20 and {r.trip_id for r in final} == set(range(20))
    assert all(r.boardings == 9 + r.trip_id and not r.qc_hard_fail and r.is_complete == 1 and r.duration_min == 90 for r in final)
    assert done.qc.filter("qc_hard_fail").count() == 0


@pytest.mark.parametrize("name, most", [("b8_historical_average", 3), ("b9_rolling_average", 4), ("b12_backtest_summary", 4), ("s6_gap_types", 3)])
def test_back_tests_scan_little(spark, name, most):
    plan = all_queries()[name].run(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan
    assert len({line.split("Relation [")[1].split("]")[0] for line in plan.splitlines() if "Relation [" in line}) <= most + 2


def test_limits_are_looked_up_or_joined_alike(spark, monkeypatch):
    """A dirty route column has more values than a map should hold; its trips get the same flags."""
    from busloom.operators import quality

    rows = spark.range(6000).selectExpr(
        "id AS trip_id", "IF(id % 3 = 0, 'hot', IF(id % 50 = 0, NULL, concat('r', id % 700))) AS route_id", "CAST((id * 7919) % 501 - 5 AS DOUBLE) AS v", "array(id) AS extra")

    def flagged():
        out = quality.percentile_flag(rows, "v", "over", 0.9, cap=490.0)
        assert out.columns == [*rows.columns, "over"]
        return out, sorted((r.trip_id, r.over) for r in out.collect())

    looked_up, expected = flagged()
    assert "SortMergeJoin" not in looked_up._jdf.queryExecution().optimizedPlan().toString() and sum(o for _, o in expected) > 300
    monkeypatch.setattr(quality, "MOST_MAPPED_ROUTES", 10)
    joined, found = flagged()
    assert found == expected and "_salt" in joined._jdf.queryExecution().analyzed().toString()

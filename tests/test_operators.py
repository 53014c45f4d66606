"""Operators on small literal tables."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from busloom.functions.calendar import day_type, easter, holidays
from busloom.functions.columns import floor_to_minutes, haversine_m
from busloom.operators import baselines, eda, features, fleet, gps, hours, metrics, normalize, quality, series, splits, trip_end
from busloom.sources import files

T0 = datetime(2024, 4, 16, 8, 0)
YARD = gps.Yard("Terminal", 3.45, -76.53, (1,))


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


# ---------------------------------------------------------------- calendar and clocks

def test_holidays():
    days = set(holidays(2024, 2026))
    assert {date(2024, 1, 1), date(2025, 1, 6), date(2026, 4, 2), date(2026, 4, 3), date(2026, 5, 1),
            date(2026, 5, 18), date(2026, 6, 8)} <= days
    assert [easter(y) for y in (2024, 2025, 2026)] == [date(2024, 3, 31), date(2025, 4, 20), date(2026, 4, 5)]
    assert len([d for d in days if d.year == 2024]) == 18


def test_day_types(spark):
    rows = [(0, True), (2, True), (5, False), (6, False), (3, False)]
    got = spark.createDataFrame(rows, "w int, h boolean").select(day_type(F.col("w"), F.col("h")).alias("t")).collect()
    assert [r["t"] for r in got] == ["FESTIVO_PUENTE", "FESTIVO", "SABADO", "DOMINGO", "LABORAL"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**7), st.sampled_from([15, 30, 60])), min_size=1, max_size=20))
def test_slot_start(spark, cases):
    rows = [(at(s / 60), w) for s, w in cases]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, w int").withColumn("b", floor_to_minutes("ts", "w"))
    for r in df.collect():
        assert r["b"] <= r["ts"] < r["b"] + timedelta(minutes=r["w"]) and r["b"].minute % r["w"] == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-80, 80), st.floats(-170, 170)] * 2), min_size=1, max_size=10))
def test_haversine(spark, cases):
    df = spark.createDataFrame(cases, "a double, b double, c double, d double")
    for r in df.select(haversine_m("a", "b", "c", "d").alias("x"), haversine_m("c", "d", "a", "b").alias("y"),
                       haversine_m("a", "b", "a", "b").alias("z")).collect():
        assert r["z"] == 0 and 0 <= r["x"] <= np.pi * 6371000.0 + 1 and abs(r["x"] - r["y"]) < 1e-3


# ---------------------------------------------------------------- trips

def test_normalise(spark):
    df = spark.createDataFrame([("2024-04-16", "08:30:00", "10", 2), ("bad", "x", "3", 5), ("2024-04-16", None, None, None)],
                               "d string, c string, raw string, alarms int")
    rows = df.select(normalize.combine_date_clock("d", "c").alias("t"), normalize.corrected_boardings("raw", "alarms").alias("b")).collect()
    assert [r["t"] for r in rows] == [datetime(2024, 4, 16, 8, 30), None, None]
    assert [r["b"] for r in rows] == [8.0, 0.0, None]


def test_positions(spark):
    df = spark.createDataFrame([("3,4516", "-76,5320"), ("91", "0"), ("text", "1"), ("1", "181")], "lat string, lon string")
    assert [(r["lat"], r["lon"]) for r in normalize.clean_positions(df).collect()] == [(3.4516, -76.532)]


def test_quality_flags(spark):
    rows = [(1, "A", at(0), at(60), 10, 5.0, 1), (2, " ", None, at(60), -1, -5.0, 1),
            (3, "C", at(0), at(-10), 5, 1.0, 1), (3, "D", at(0), None, 5, 1.0, 1)]
    df = spark.createDataFrame(rows, "trip_id int, vehicle_id string, actual_start timestamp_ntz, actual_end timestamp_ntz, "
                                     "boardings_raw int, distance double, route_id int")
    limits = quality.QualityLimits(duration_percentile=1.0, boardings_percentile=1.0)
    out = {(r["trip_id"], r["vehicle_id"]): r for r in quality.flag_trips(df, limits).collect()}
    assert sum(r["qc_hard_fail"] for r in out.values()) == 3
    clean = out[(1, "A")]
    assert not clean["qc_any_flag"] and clean["qc_score"] == 0 and clean["qc_reason_hard"] == ""
    assert out[(3, "D")]["flag_key_duplicated"] and out[(3, "D")]["flag_end_null"]
    assert out[(2, " ")]["qc_reason_hard"] == ("flag_vehicle_blank,flag_start_null,flag_distance_negative,flag_boardings_negative")


def test_null_keys_are_copies_of_each_other(spark):
    df = spark.createDataFrame([(None, "A", T0, T0), (None, "B", T0, T0), (1, "C", T0, T0)],
                               "trip_id int, vehicle_id string, actual_start timestamp_ntz, actual_end timestamp_ntz")
    out = {r["vehicle_id"]: r["flag_key_duplicated"] for r in quality.structural_flags(df).collect()}
    assert out == {"A": True, "B": True, "C": False}


def test_model_ready(spark):
    df = spark.createDataFrame([(1, at(0), at(60), False), (2, at(0), at(60), True), (3, at(0), at(3), False)],
                               "trip_id int, actual_start timestamp_ntz, actual_end timestamp_ntz, qc_hard_fail boolean")
    assert [(r["trip_id"], r["duration_min"]) for r in normalize.model_ready(df).collect()] == [(1, 60.0)]


# ---------------------------------------------------------------- GPS

def ends(spark, starts, pings, **rules):
    trips = spark.createDataFrame(starts, "trip_id int, vehicle_id string, actual_start timestamp_ntz")
    rows = [(i, v, t, s, m) for i, (v, t, s, m) in enumerate(pings)]
    p = spark.createDataFrame(rows, "ping_id int, vehicle_id string, ping_ts timestamp_ntz, speed_kmh double, message string")
    out = trip_end.resolve_trip_ends(trips, p, trip_end.EndRules(**rules)).collect()
    return {r["trip_id"]: (r["end_type"], r["estimated_end"]) for r in out}


def test_trip_end_classes(spark):
    starts = [(i, f"v{i}", T0) for i in range(1, 11)] + [(11, None, T0), (12, "v1", None), (13, "v13", T0), (14, "v14", T0)]
    pings = []
    for v, speeds in ((1, (2, 1, 0, 1.5)), (2, (15, 16, 18)), (3, (5, 5, 5))):
        pings += [(f"v{v}", at(5 * i), float(s), "") for i, s in enumerate(speeds)]
    pings += [("v4", at(-10), 1.0, ""), ("v5", at(0), None, ""), ("v5", at(10), None, "")]
    # No speed in the last 15 minutes: the last ten earlier ones count (fast ones lie further back).
    pings += [("v6", at(i), 40.0, "") for i in range(5)] + [("v6", at(10 + i), 1.0, "") for i in range(10)] + [("v6", at(100), None, "")]
    pings += [("v7", at(180), 1.0, ""), ("v7", at(181), 50.0, "")]                      # the window's end counts
    pings += [("v8", at(0), 10.0, ""), ("v8", at(1), 15.0, "")]                         # median 12.5 from a split tail
    pings += [("v9", at(0), 8.0, ""), ("v9", at(1), 13.0, "")]                          # median 10.5
    pings += [("v10", at(-25), 1.0, "")]
    pings += [("v13", at(5 * i), 8.0, "x Móvil Apagado" if i == 3 else "") for i in range(4)]
    pings += [("v14", at(-1), 1.0, "Móvil Apagado"), ("v14", at(2), 2.0, ""), ("v14", at(3), 9.0, "")]
    got = ends(spark, starts, pings)
    assert got[1] == (trip_end.ABANDONED, at(15)) and got[2] == (trip_end.RETURNING, at(10))
    assert got[3] == (trip_end.UNDETERMINED, at(10)) and got[4] == (trip_end.NO_GPS_AFTER_START, None)
    assert got[5] == (trip_end.UNDETERMINED, at(10)) and got[6] == (trip_end.ABANDONED, at(100))
    assert got[7] == (trip_end.ABANDONED, at(180)) and got[8] == (trip_end.RETURNING, at(1))
    assert got[9] == (trip_end.UNDETERMINED, at(1)) and got[10] == (trip_end.NO_GPS, None)
    assert got[11] == (trip_end.NO_VEHICLE_OR_START, None) and got[12] == (trip_end.NO_VEHICLE_OR_START, None)
    assert got[13][0] == trip_end.UNDETERMINED and got[14][0] == trip_end.UNDETERMINED
    assert ends(spark, starts[12:13], pings, abandoned_share=0.3)[13] == (trip_end.ABANDONED, at(15))


def test_smallest_window_wins(spark):
    plans = [(1, "a", 1, T0, None), (2, "b", 1, T0, None), (3, "c", 1, T0, None), (4, None, 1, T0, None), (5, "d", 1, None, None),
             (6, "e", 1, T0, at(1)), (7, "f", 1, T0, None), (8, "g", 9, T0, None)]
    trips = spark.createDataFrame(plans, "trip_id int, vehicle_id string, route_id int, planned_start timestamp_ntz, actual_start timestamp_ntz")
    near, far = ("3,45", "-76,53"), ("4", "-76")
    pings = [("a", at(100), "at TERMINAL", *far), ("a", at(20), "", *near),           # fence at 20 beats text at 100
             ("b", at(-25), "", *near), ("b", at(10), "terminal gate", *far),         # text beats the earlier fence hit
             ("c", at(-170), "", *near), ("f", at(181), "", *near)]
    df = spark.createDataFrame(pings, "vehicle_id string, ping_ts timestamp_ntz, message string, lat string, lon string")
    got = {r["trip_id"]: (r["actual_start"], r["search_outcome"], r["window_used"]) for r in gps.impute_departures(trips, df, [YARD]).collect()}
    assert got == {1: (at(20), "OK", 30), 2: (at(10), "OK", 30), 3: (at(-170), "OK", 180), 4: (None, "SIN_PLACA", None),
                   5: (None, "SIN_HORA_PLAN", None), 6: (at(1), None, None), 7: (None, "NO_ENCONTRADO", None), 8: (None, None, None)}


def test_real_end_wins(spark):
    base = spark.createDataFrame([(1, at(60), at(30), None), (2, None, None, None)],
                                 "trip_id int, actual_end timestamp_ntz, estimated_end timestamp_ntz, end_type string")
    upd = spark.createDataFrame([(1, 0, at(45), "x", "y"), (2, 0, at(180), trip_end.RETURNING, "GPS_ESTIMADA")],
                                "trip_id int, is_complete int, estimated_end timestamp_ntz, end_type string, end_source string")
    out = {r["trip_id"]: r for r in trip_end.merge_ends(base, upd).collect()}
    assert (out[1]["estimated_end"], out[1]["end_type"], out[1]["is_complete"]) == (at(60), "COMPLETO", 1)
    assert (out[2]["estimated_end"], out[2]["end_type"], out[2]["is_complete"]) == (at(180), trip_end.RETURNING, 0)


# ---------------------------------------------------------------- series

def trips_every(spark, minutes=10, n=288, route=1):
    rows = [(i, at(minutes * i), 20, route) for i in range(n)]
    return spark.createDataFrame(rows, "trip_id int, actual_start timestamp_ntz, boardings int, route_id int")


def test_bins_and_grid(spark):
    t = trips_every(spark).filter("trip_id < 12 or trip_id > 23")
    rows = series.calendar_series(t).filter("gran_min = 60").orderBy("timestamp").collect()
    assert [r["is_gap"] for r in rows[:5]] == [False, False, True, True, False]
    assert rows[0]["trips"] == 6 and rows[0]["passengers_sum"] == 120 and rows[0]["passengers_p95"] == 20
    filled = series.fill_gaps(series.complete_grid(series.demand_bins(t, (60,))), "ffill").orderBy("timestamp").collect()
    assert filled[2]["trips"] == 6
    counts = series.complete_grid(series.demand_bins(t)).groupBy("gran_min").agg(F.count("*").alias("n"), F.sum(F.col("is_gap").cast("int")).alias("g")).collect()
    n = {r["gran_min"]: (r["n"], r["g"]) for r in counts}
    assert abs(n[15][0] - 4 * n[60][0]) <= 4 and n[15][1] > n[30][1] > n[60][1]


def test_validation_finds_short_series(spark):
    checked = series.validate_series(series.complete_grid(series.demand_bins(trips_every(spark), (60,)))).first()
    assert not checked["is_valid"] and checked["span_days"] == 2 and checked["jumps"] == 0


def test_service_hours(spark):
    rows = [(1, 60, datetime(2024, 4, 1) + timedelta(days=d, hours=h), not 5 <= h <= 20) for d in range(28) for h in range(24)]
    df = spark.createDataFrame(rows, "route_id int, gran_min int, timestamp timestamp_ntz, is_gap boolean")
    out = {r["day_type"]: r for r in hours.estimate_hours(series.add_calendar(df)).collect()}
    assert len(out) == 5 and (out["LABORAL"]["start_min"], out["LABORAL"]["end_min"], out["LABORAL"]["service_h"]) == (300, 1200, 16.0)
    assert out["SABADO"]["borrowed"] and out["SABADO"]["start_clock"] == "05:00"


def test_acf_and_pacf(spark):
    y = np.sin(np.arange(200) * 0.3) + np.arange(200) % 7
    rows = [("r", 30, T0 + timedelta(minutes=30 * i), float(v), False) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "route_id string, gran_min int, timestamp timestamp_ntz, passengers_sum double, is_gap boolean")
    acf = eda.autocorrelation(df)
    got = {r["lag"]: r["acf"] for r in acf.collect()}
    d = y - y.mean()
    assert got[0] == 1 and np.allclose([got[k] for k in (1, 7, 48)], [(d[k:] * d[:-k]).sum() / (d * d).sum() for k in (1, 7, 48)])
    pacf = {r["lag"]: r["pacf"] for r in eda.partial_autocorrelation(acf).collect()}
    for k in (1, 5, 20):
        lhs = np.array([[got[abs(i - j)] for j in range(k)] for i in range(k)])
        assert np.isclose(pacf[k], np.linalg.solve(lhs, [got[i + 1] for i in range(k)])[-1])


# ---------------------------------------------------------------- models

def model_series(spark, n):
    start = datetime(2024, 1, 1, 4)
    rows = [("r", 30, start + timedelta(minutes=30 * i), float(i % 50), 2 if i % 9 else 0, False, i) for i in range(n)]
    df = spark.createDataFrame(rows, "route_id string, gran_min int, timestamp timestamp_ntz, passengers_sum double, trips int, is_gap boolean, i int")
    return series.add_calendar(df)


def test_frozen_baselines(spark):
    # The expected errors belong to a series whose days are all of one type.
    table = features.add_lags(features.add_targets(model_series(spark, 400))).withColumn("day_type", F.lit("LABORAL"))
    rows = features.scenario_rows(table, features.SCENARIOS[:1]).withColumns({
        "first_fold": F.when(F.col("i") < 300, 1), "fold_no": F.when(F.col("i").between(350, 359), 1)})
    rows = baselines.with_slot(rows)
    folds = spark.createDataFrame([(1,)], "fold_no int")
    naive = baselines.naive_predictions(rows.filter("fold_no is not null")).select("model", "y", "y_pred")
    both = naive.unionByName(baselines.historical_average(rows, folds).select("model", "y", "y_pred"))
    got = {r["model"]: (round(r["mae"], 6), round(r["bias"], 6)) for r in both.withColumn("e", F.col("y_pred") - F.col("y")).groupBy("model").agg(
        F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias")).collect()}
    assert got == {"naive": (5.8, 4.0), "seasonal_naive_daily": (2.0, 2.0), "seasonal_naive_weekly": (14.0, 14.0), baselines.HISTORICAL: (9.0, 9.0)}


def test_metrics(spark):
    df = spark.createDataFrame([("m", 10.0, 12.0), ("m", 20.0, 18.0)], "model string, y_real double, y_pred double")
    r = metrics.metrics_by(df, ["model"]).first()
    assert (r["mae"], r["rmse"], round(r["wape"], 2), r["bias_mean"]) == (2.0, 2.0, 13.33, 0.0)


def test_folds_do_not_overlap(spark):
    table = model_series(spark, 48 * 40)
    plan = splits.SplitPlan(min_train_days=14, validation_days=3, step_days=3, test_days=6)
    folds = splits.make_folds(table, plan)
    assert splits.validate_folds(folds).select("bad_order", "overlaps", "reach_test", "partial_days").first() == (0, 0, 0, 0)
    assert folds.count() == 7
    rows = splits.assign_folds(table, folds)
    assert rows.filter("fold_no is not null and first_fold <= fold_no").count() == 0


def test_leak_is_found(spark):
    table = features.add_lags(features.add_targets(model_series(spark, 120)))
    assert features.leakage_check(table).filter("mismatches > 0").count() == 0
    leaky = table.withColumn("passengers_sum_lag_1", F.col("passengers_sum"))
    with pytest.raises(ValueError, match="passengers_sum_lag_1"):
        features.require_no_leakage(features.leakage_check(leaky))
    with pytest.raises(ValueError):
        features.check_predictors(["hour", "duration_min"])


def test_three_blocks_reject_long_windows(spark):
    table = model_series(spark, 48 * 20)
    ok = splits.three_blocks(table, "2024-01-15 04:00:00", train_days=10, stop_days=2, eval_days=2).groupBy("block").count().collect()
    assert {r["block"]: r["count"] for r in ok} == {"fit": 48 * 8, "stop": 96, "eval": 96}
    with pytest.raises(Exception, match="starts before the data"):
        splits.three_blocks(table, "2024-01-15 04:00:00", train_days=30).collect()


# ---------------------------------------------------------------- fleet and files

def test_yard_occupancy(spark):
    d = date(2024, 4, 16)
    rows = [("v", d, fleet.IN_YARD, datetime(2024, 4, 16, 8, 0), datetime(2024, 4, 16, 8, 10)),
            ("w", d, fleet.IN_YARD, datetime(2024, 4, 16, 8, 1), datetime(2024, 4, 16, 8, 4)),
            ("x", d, fleet.IN_YARD, datetime(2024, 4, 16, 3, 0), datetime(2024, 4, 16, 4, 1))]
    t = spark.createDataFrame(rows, "vehicle_id string, service_date date, state string, start_ts timestamp_ntz, end_ts timestamp_ntz")
    got = {r["tick_ts"]: r["in_yard"] for r in fleet.yard_occupancy(t, t).collect()}
    assert len(got) == 193 and {k.strftime("%H:%M") for k, v in got.items() if v} == {"04:00", "08:00", "08:05"}


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(i, str(i % 5)) for i in range(100)], "a int, b string")
    assert files.fingerprint(df).first() == files.fingerprint(df.orderBy(F.desc("a")).repartition(3)).first()
    assert files.fingerprint(df).first() != files.fingerprint(df.withColumn("b", F.lit("x"))).first()

"""Published versions, series kept up to date, trip ends that resume."""

from datetime import datetime, timedelta
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from busloom.operators import incremental, series, trip_end
from busloom.session import shared_dir
from busloom.sources import versions

TRIPS = "trip_id long, route_id string, actual_start timestamp_ntz, boardings long"


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/published-{uuid4().hex}"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def trip(i, day, minute, boardings, route="a"):
    return (i, route, datetime(2024, 1, day) + timedelta(minutes=minute), boardings)


def dated(spark, rows):
    return spark.createDataFrame(rows, "x int, service_day string").withColumn("service_day", F.col("service_day").cast("date"))


def test_versions_replace_days_and_nothing_else(spark, folder):
    assert versions.read_published(spark, folder) is None
    one = versions.publish_days(dated(spark, [(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")]), folder)
    reader = versions.read_published(spark, folder)
    two = versions.publish_days(dated(spark, [(9, "2024-01-02")]), folder, ["2024-01-02", "2024-01-03"], {"run": "x"})
    assert [r[0] for r in rows_of(versions.read_published(spark, folder))] == [1, 9]
    assert [r[0] for r in rows_of(reader)] == [1, 2, 3]  # who has opened a version keeps it
    assert two["days"] == {"2024-01-01": one["version"], "2024-01-02": two["version"]} and two["notes"] == {"run": "x"}
    assert versions.read_published(spark, folder, ["2024-01-02", "2030-01-01"]).collect()[0].x == 9
    with pytest.raises(ValueError):
        versions.publish_days(dated(spark, [(1, "2024-02-01")]), folder, ["2024-01-01"])
    with pytest.raises(Exception, match="no service day"):
        versions.publish_days(dated(spark, [(1, None)]), folder)
    assert [r[0] for r in rows_of(versions.read_published(spark, folder))] == [1, 9]  # failed writes are not seen
    assert versions.drop_old_versions(spark, folder, keep=1) and [r[0] for r in rows_of(versions.read_published(spark, folder))] == [1, 9]


def test_a_writer_that_dies_before_the_pointer_is_not_seen(spark, folder, monkeypatch):
    versions.publish_days(dated(spark, [(1, "2024-01-01")]), folder)

    def dies(self, name, text):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions._Store, "replace", dies)
    with pytest.raises(KeyboardInterrupt):
        versions.publish_days(dated(spark, [(2, "2024-01-01"), (3, "2024-01-02")]), folder)
    monkeypatch.undo()
    assert [r[0] for r in rows_of(versions.read_published(spark, folder))] == [1]
    versions.publish_days(dated(spark, [(4, "2024-01-02")]), folder)
    assert [r[0] for r in rows_of(versions.read_published(spark, folder))] == [1, 4]


def test_refreshed_series_equal_a_rebuild_and_read_touched_days_only(spark, folder):
    trips, counts = f"{folder}-trips", f"{folder}-counts"
    old = [trip(i, 1 + i % 5, 300 + 7 * i, i % 9, "ab"[i % 2]) for i in range(200)]
    fresh = [trip(900, 6, 400, 5), trip(901, 6, 180, 7), trip(10, 1, 1000, 50), trip(33, 2, 500, 1)]  # a new day, the night before it, corrections
    for rows in (old, fresh):
        moved = spark.createDataFrame([(*r, None) for r in rows], TRIPS + ", was date")
        if rows is fresh:
            moved = moved.withColumn("was", F.when(F.col("trip_id") == 33, F.lit("2024-01-04").cast("date")))
        days = incremental.merge_trips(spark, trips, moved, moved_from="was")
        incremental.refresh_counts(spark, trips, counts, days)
    assert days == ["2024-01-01", "2024-01-02", "2024-01-04", "2024-01-05", "2024-01-06"]
    now = {r[0]: r for r in old} | {r[0]: r for r in fresh}
    assert rows_of(versions.read_published(spark, trips).select("trip_id", "route_id", "actual_start", "boardings")) == sorted(now.values(), key=str)
    rebuilt = series.demand_bins(spark.createDataFrame(list(now.values()), TRIPS))
    assert rows_of(incremental.bins(spark, counts).select(*rebuilt.columns)) == rows_of(rebuilt)
    # What a refresh of one day reads.
    read = versions.read_published(spark, trips, ["2024-01-06"]).inputFiles()
    assert read and all("service_day=2024-01-06" in f for f in read)
    before = versions.manifest(spark, counts)["days"]["2024-01-03"]
    incremental.refresh_counts(spark, trips, counts, ["2024-01-06"])
    assert versions.manifest(spark, counts)["days"]["2024-01-03"] == before


def test_a_cancelled_day_is_empty(spark, folder):
    trips, counts = f"{folder}-trips", f"{folder}-counts"
    days = incremental.merge_trips(spark, trips, spark.createDataFrame([trip(1, 1, 600, 4), trip(2, 2, 600, 4)], TRIPS))
    incremental.refresh_counts(spark, trips, counts, days)
    gone = spark.createDataFrame([(2, "a", None, 4, "2024-01-02")], TRIPS + ", was string").withColumn("was", F.col("was").cast("date"))
    days = incremental.merge_trips(spark, trips, gone, moved_from="was")
    incremental.refresh_counts(spark, trips, counts, days)
    assert days == ["2024-01-02"] and {r.timestamp.day for r in incremental.bins(spark, counts).collect()} == {1}


def test_trip_ends_resume_where_a_run_died(spark, folder):
    start = datetime(2024, 1, 1, 8)
    trips = [(i, f"V{i % 3}", start + timedelta(days=i % 6, hours=i // 6), None if i % 4 else start + timedelta(days=i % 6, hours=i // 6 + 1)) for i in range(48)]
    trips += [(90, "V1", None, None), (91, None, start, None)]
    pings = [(n, f"V{n % 3}", start + timedelta(minutes=13 * n), float(n % 30), "x") for n in range(900)]
    frame = spark.createDataFrame(trips, "trip_id long, vehicle_id string, actual_start timestamp_ntz, actual_end timestamp_ntz")
    seen = spark.createDataFrame(pings, "ping_id long, vehicle_id string, ping_ts timestamp_ntz, speed_kmh double, message string")
    run = trip_end.publish_trip_ends(frame, seen, folder, run="one", days_per_batch=2)
    assert next(run) == ["1900-01-01", "2024-01-01"]
    run.close()  # dies after its first batch
    assert versions.read_published(spark, folder).filter("trip_id = 1").isEmpty()
    rest = list(trip_end.publish_trip_ends(frame, seen, folder, run="one", days_per_batch=2))
    assert [d for batch in rest for d in batch] == [f"2024-01-0{d}" for d in range(2, 7)]
    columns = ["trip_id", *trip_end.END_COLUMNS]
    assert rows_of(versions.read_published(spark, folder).select(*columns)) == rows_of(trip_end.resume_trip_ends(frame, seen).select(*columns))
    assert list(trip_end.publish_trip_ends(frame, seen, folder, run="one")) == []
    assert sum(map(len, trip_end.publish_trip_ends(frame, seen, folder, run="two"))) == 7

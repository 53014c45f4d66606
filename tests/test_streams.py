"""Streams over several files: copies far apart, batches that run again, late rows."""

from datetime import datetime, timedelta
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from busloom.operators import trip_end
from busloom.session import shared_dir
from busloom.streaming import streams, trip_tails

DDL = "trip_id long, route_id string, actual_start timestamp_ntz, boardings long"
START = datetime(2024, 1, 1)


def row(i, days, minute, boardings=1, route="a"):
    return (i, route, START + timedelta(days=days, minutes=minute), boardings)


@pytest.fixture
def files(spark):
    """A function that puts rows into a new file, and the stream over all of them, a file at a time."""
    folder = f"{shared_dir(spark)}/arrivals-{uuid4().hex}"

    def put(rows):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(folder)

    return put, stream


def test_copies_that_arrive_days_apart_leave_one_row(spark, files, monkeypatch):
    monkeypatch.setattr(streams, "KEY_BLOCK", 10)
    put, stream = files
    base = f"{shared_dir(spark)}/dedup-{uuid4().hex}"
    put([row(1, 0, 5), row(1, 0, 3, 9), row(2, 0, 7), (None, "a", START, 1)])
    put([row(25, 1, 0), row(1, 1, 3), row(2, 0, 7)])
    found = streams.dedup_exactly(stream(), base, order=["actual_start"])
    assert sorted((r.trip_id, r.boardings) for r in found.collect()) == [(1, 9), (2, 1), (25, 1)]
    put([row(2, 9, 7), row(25, 9, 0), row(26, 9, 0)])  # days later, in another run
    found = streams.dedup_exactly(stream(), base, order=["actual_start"])
    assert sorted(r.trip_id for r in found.collect()) == [1, 2, 25, 26]


def test_a_batch_that_runs_again_changes_nothing(spark, files):
    """A batch whose last write fails is run again; so is one that failed behind its rows."""
    put, stream = files
    base = f"{shared_dir(spark)}/dedup-{uuid4().hex}"
    put([row(1, 0, 5), row(2, 0, 7)])
    streams.dedup_exactly(stream(), base)
    put([row(2, 1, 5), row(3, 1, 7)])
    real = streams.written_once
    calls = []

    def fails(df, name="part"):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(df, name)

    streams.written_once = fails
    try:
        with pytest.raises(Exception, match="lost"):
            streams.dedup_exactly(stream(), base)
    finally:
        streams.written_once = real
    # The batch's rows and keys are there already, as if it had died just before its commit.
    half = spark.createDataFrame([row(3, 1, 7)], DDL)
    half.write.parquet(f"{base}/out/batch=1")
    half.select("trip_id", F.lit(0).cast("long").alias("block")).write.partitionBy("block").parquet(f"{base}/keys/batch=1")
    for _ in range(2):
        assert sorted(r.trip_id for r in streams.dedup_exactly(stream(), base).collect()) == [1, 2, 3]


def test_bins_have_the_exact_p95_and_late_rows_are_dropped(spark, files):
    put, stream = files
    base = f"{shared_dir(spark)}/bins-{uuid4().hex}"
    values = [3, 8, 8, 1, 40, 7, 2, 9, 30, 5, 6]
    put([row(i, 0, 10 + i % 5, v) for i, v in enumerate(values)] + [row(50, 0, 12, 100, "b")])
    put([row(60, 0, 200)])  # the watermark passes the first bins
    put([row(59, 0, 195, 3)])  # and holds for late rows from the batch after the next one on
    put([row(61, 0, 12, 1000), row(62, 0, 190, 4)])  # too late for its bin; late, but not too late
    put([row(63, 30, 0)])
    put([row(64, 31, 0)])
    found = {(r.bin_start.replace(tzinfo=None), r.route_id): r for r in streams.run_available(streams.demand_bins(stream()), base).collect()}
    first = found[START, "a"]
    exact = spark.createDataFrame([(v,) for v in values], "v long").agg(F.percentile("v", 0.95)).first()[0]
    assert (first.trips, first.passengers_sum, first.passengers_p95) == (len(values), sum(values), exact)
    assert found[START, "b"].passengers_p95 == 100
    third = found[START + timedelta(hours=3), "a"]
    assert (third.trips, third.passengers_sum) == (3, 8)


EVENTS = "vehicle_id string, at timestamp_ntz, is_start boolean, ping_id long, speed_kmh double, message string"


def halves(events):
    starts = events.where("is_start").select("vehicle_id", F.col("at").alias("actual_start"))
    return starts, events.where("NOT is_start").select("vehicle_id", F.col("at").alias("ping_ts"), "ping_id", "speed_kmh", "message")


def test_streamed_trip_ends_equal_the_batch_with_bounded_state(spark):
    """Three days, a file each three hours, out of order within an hour: one busy vehicle, one silent at times, one silent."""
    import random

    random_ = random.Random(8)
    rows = []
    for i in range(3 * 24 * 60):
        mode = i // 200 % 4  # slow, fast, mixed, without speeds
        speed = [random_.choice([0.0, 2.0, 3.0, 20.0]), random_.choice([11.0, 12.0, 30.0]), random_.choice([1.0, 5.0, 12.0, 13.0]), None][mode]
        message = "engine error" if random_.random() < 0.01 else None
        rows.append(("busy", START + timedelta(minutes=i), False, i, speed, message))
        if i // 500 % 2 and i % 7 == 0:
            rows.append(("shy", START + timedelta(minutes=i), False, 100_000 + i, speed, message))
        if i % 45 == 0:
            rows += [(v, START + timedelta(minutes=i + 3), True, None, None, None) for v in ("busy", "shy", "silent")]
    rows += [(None, START, True, None, None, None), (" ", START, True, None, None, None), rows[0], rows[1]]
    folder, base = (f"{shared_dir(spark)}/{n}-{uuid4().hex}" for n in ("tail-events", "tails"))
    arrival = sorted(rows, key=lambda r: r[1] + timedelta(minutes=random_.randrange(50)))
    per_file = len(arrival) // 24 + 1

    def stream():
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
        return trip_tails.trip_ends(*halves(events), trip_end.EndRules(power_off_text="error"))

    for k in range(0, len(arrival), per_file):
        spark.createDataFrame(arrival[k: k + per_file], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    streams.run_available(stream(), base)
    spark.createDataFrame([("end", START + timedelta(days=400), False, 1, 1.0, None)], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    found = streams.run_available(stream(), base).collect()
    known = spark.createDataFrame(rows, EVENTS).where("trim(vehicle_id) <> ''")
    want = trip_end.ends_for_starts(*halves(known), trip_end.EndRules(power_off_text="error")).collect()
    assert sorted((r.vehicle_id, r.actual_start, str(r.estimated_end), r.end_type) for r in found) == sorted(
        (r.vehicle_id, r.actual_start, str(r.estimated_end), r.end_type) for r in want)
    assert len({r.end_type for r in found}) >= 5
    # A file is three hours, the delay one, the tail a quarter; a ping a minute.
    assert max(r.held_pings for r in found if r.vehicle_id == "busy") <= 6 * 60

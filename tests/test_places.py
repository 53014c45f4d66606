"""Places by cells against all distances."""

import random
from datetime import datetime
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from busloom.functions.columns import EARTH_RADIUS_M
from busloom.operators import places


def distance(a, b, c, d):
    h = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_M * asin(min(1.0, sqrt(h)))


def frames(spark, pings, stops):
    pings = spark.createDataFrame([(i, "v", a, b) for i, (a, b) in enumerate(pings)], "ping_id long, vehicle_id string, lat double, lon double")
    return pings, spark.createDataFrame([(f"p{i}", *s) for i, s in enumerate(stops)], "place string, lat double, lon double, radius_m double")


@pytest.mark.parametrize(("center", "spread", "radii"), [
    ((3.45, -76.53), 0.05, (50, 900)), ((0.0, 0.0), 0.02, (100, 2000)), ((60.0, 179.99), 0.05, (500, 3000)),
    ((-89.98, 10.0), 0.03, (300, 4000)), ((89.999, -120.0), 0.01, (300, 4000)), ((45.0, -180.0), 40.0, (200_000, 900_000)), ((0.0, 0.0), 80.0, (2_000_000, 9_000_000))])
def test_all_pairs_within_the_radius(spark, center, spread, radii):
    rng = random.Random(str(center))

    def point():
        lat = max(-90.0, min(90.0, center[0] + rng.uniform(-spread, spread)))
        lon = center[1] + rng.uniform(-spread, spread) * rng.choice([1, 1, 2000 if abs(center[0]) > 89 else 1])
        return lat, (lon + 180) % 360 - 180

    seen, stops = [point() for _ in range(400)], [(*point(), float(rng.uniform(*radii))) for _ in range(60)]
    found = {(r.ping_id, r.place): r.distance_m for r in places.near_places(*frames(spark, seen, stops)).collect()}
    expected = {}
    for i, (a, b) in enumerate(seen):
        for j, (c, d, radius) in enumerate(stops):
            m = distance(a, b, c, d)
            if m <= radius:
                expected[i, f"p{j}"] = m
    assert expected and {k for k in found.keys() ^ expected.keys()} == set()
    assert all(abs(found[k] - m) < 1e-3 + 1e-7 * m for k, m in expected.items())


def test_five_thousand_places_without_a_cross_join(spark):
    rng = random.Random(1)
    seen = [(3 + rng.random(), -76 + rng.random()) for _ in range(3000)]
    stops = [(3 + rng.random(), -76 + rng.random(), 400.0) for _ in range(5000)]
    found = places.near_places(*frames(spark, seen, stops))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wanted = sum(distance(a, b, c, d) <= 400 for a, b in seen[:200] for c, d, _ in stops if abs(a - c) < 0.01)
    assert found.filter("ping_id < 200").count() == wanted


def test_odd_places_and_pings(spark):
    pings = spark.createDataFrame([(1, "v", "3,5", "-76,5"), (2, "v", None, "1"), (3, "v", "x", "1"), (4, "v", "91", "1")], "ping_id long, vehicle_id string, lat string, lon string")
    stops = spark.createDataFrame([("a", 3.5, -76.5, 10.0), (None, 3.5, -76.5, 10.0), ("b", None, 1.0, 5.0), ("c", 3.5, -76.5, 0.0), ("d", 3.5, -76.5, None), ("a", 3.5, -76.5, 90.0)],
                                  "place string, lat double, lon double, radius_m double")
    assert [(r.ping_id, r.place) for r in places.near_places(pings, stops).collect()] == [(1, "a"), (1, "a")]
    assert places.near_places(pings, stops.limit(0)).count() == 0


def test_names_in_messages(spark):
    texts = ["at Stop 1 now", "STOP 12", "stop", None, "", "xYz", "ñandú y más", "at Stop 1 now"]
    pings = spark.createDataFrame(list(enumerate(texts)), "ping_id long, message string")
    stops = spark.createDataFrame([(x, 1.0, 1.0, 1.0) for x in ("Stop 1", "stop 12", "z", "ÑANDÚ Y", " ", None, "longer than any")], "place string, lat double, lon double, radius_m double")
    found = {(r.ping_id, r.place) for r in places.named_places(pings, stops).collect()}
    assert found == {(i, p) for i, t in enumerate(texts) for p in ("Stop 1", "stop 12", "z", "ÑANDÚ Y", "longer than any") if t and p.upper() in t.upper()}
    assert places.named_places(pings, stops.limit(0)).count() == 0 and "place" in places.named_places(pings, stops.limit(0)).columns


def test_repeated_positions_and_circles_are_compared_once(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(places, "written_once", lambda df, name: written.setdefault(name, df), raising=False)
    pings = spark.createDataFrame([(i, f"v{i % 3}", 3.5, -76.5) for i in range(300)], "ping_id long, vehicle_id string, lat double, lon double")
    stops = spark.createDataFrame([(f"p{i}", 3.5001, -76.5, 50.0) for i in range(200)], "place string, lat double, lon double, radius_m double")
    assert places.near_places(pings, stops).count() == 300 * 200
    assert written["met"].count() == 1


def test_entries_of_vehicles_are_those_of_their_pings(spark):
    rng = random.Random(2)
    at = [(round(3.5 + rng.randrange(8) / 2000, 4), -76.5) for _ in range(400)]
    moment = [None, *(datetime(2024, 1, 1, 5, m) for m in range(50))]
    pings = spark.createDataFrame([(i, rng.choice(["a", "b", None]), rng.choice(moment), str(a).replace(".", ","), str(b)) for i, (a, b) in enumerate(at)] * 2,
                                  "ping_id long, vehicle_id string, ping_ts timestamp_ntz, lat string, lon string")
    # The names x and y belong to several circles, one of them twice.
    stops = spark.createDataFrame([("x", 3.5, -76.5, 90.0), ("x", 3.501, -76.5, 90.0), ("y", 3.5, -76.5, 90.0), ("y", 3.5, -76.5, 90.0), ("z", 3.502, -76.5, 300.0)],
                                  "place string, lat double, lon double, radius_m double")
    expected = places.near_places(pings, stops).groupBy("vehicle_id", "place").agg(
        F.min("ping_ts").alias("entry_ts"), F.max("ping_ts").alias("last_ts"), F.count("*").alias("pings"), F.min("distance_m").alias("min_distance_m"))
    found = places.place_entries(pings, stops)
    assert found.schema.simpleString() == expected.schema.simpleString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect())) and found.count() == 9


def test_full_cells_are_dealt_to_several_tasks(spark):
    rng = random.Random(3)
    seen = [(3.5 + rng.random() / 500, -76.5 + rng.random() / 500) for _ in range(500)]
    pings, stops = frames(spark, seen, [(3.5 + rng.random() / 500, -76.5 + rng.random() / 500, 100.0) for _ in range(40)])
    known = places._known(stops)
    whole, dealt = ({tuple(r) for r in places._met(pings, known, deal).collect()} for deal in (10_000, 7))
    assert whole == dealt and len(whole) > 1000


def test_hits_of_many_pings_at_one_place(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(places, "written_once", lambda df, name: written.setdefault(name, df), raising=False)
    pings = spark.createDataFrame([(f"v{i % 3}", datetime(2024, 1, 1), "at P7 now", 3.5, -76.5) for i in range(60)] + [(None, datetime(2024, 1, 1), "at P7 now", 3.5, -76.5)],
                                  "vehicle_id string, ping_ts timestamp_ntz, message string, lat double, lon double")
    stops = spark.createDataFrame([(f"p{i} ", 3.5001, -76.5, 50.0) for i in range(20)], "place string, lat double, lon double, radius_m double")
    found = places.place_hits(pings, stops).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in found} == {"text": 60, "fence": 60 * 20}
    assert written["met"].count() == 1


@pytest.mark.parametrize("side", [2, 1000])
def test_summed_hits_are_those_of_the_pings(spark, monkeypatch, side):
    monkeypatch.setattr(places, "CIRCLE_SIDE", side)
    rng = random.Random(4)
    moment = [None, *(datetime(2024, 1, 1, 5, m) for m in range(50))]
    # The same position in several spellings, positions that can't be read, and messages of several names.
    lats = ["3,5", "3.5", " 3,500", "3,5005", "3,501", "3,502", "91", "x", None]
    texts = ["at Stop 1 now", "left STOP 12, stop 7", "y and Stop 123", "stop", "", None]
    rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice(moment), rng.choice(texts), rng.choice(lats), "-76,5") for _ in range(300)]
    pings = spark.createDataFrame(rows * 2, "vehicle_id string, ping_ts timestamp_ntz, message string, lat string, lon string")
    # The names y and Stop 7 belong to several circles; y and Stop 12 are listed twice with one of theirs.
    stops = spark.createDataFrame(
        [("Stop 1", 3.5, -76.5, 90.0), ("stop 1", 3.5, -76.5, 90.0), ("Stop 12", 3.501, -76.5, 90.0), ("Stop 12", 3.501, -76.5, 90.0), ("Stop 123", 3.5, -76.5, 90.0),
         ("y", 3.5, -76.5, 90.0), ("y", 3.5, -76.5, 90.0), ("y", 3.5, -76.5, 30.0), ("Stop 7", 3.502, -76.5, 300.0), ("Stop 7", 3.501, -76.5, 90.0), ("far", 9.0, 9.0, 50.0), (None, 3.5, -76.5, 90.0)],
        "place string, lat double, lon double, radius_m double")
    expected = places.place_hits(pings, stops).groupBy("vehicle_id", "yard", "kind").agg(F.count("*").alias("pings"), F.min("ping_ts").alias("first_ts"))
    found = places.place_hits(pings, stops, summed=True)
    assert dict(found.dtypes) == dict(expected.dtypes) and found.columns == expected.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect())) and found.count() > 40
    assert places.place_hits(pings, stops.limit(0), summed=True).count() == 0


def test_summed_hits_make_no_row_per_ping_and_place(spark, monkeypatch):
    written, keep = {}, places.written_once
    monkeypatch.setattr(places, "written_once", lambda df, name: written.setdefault(name, keep(df, name)))
    pings = spark.range(20_000).select(F.concat(F.lit("v"), F.col("id") % 3).alias("vehicle_id"), F.lit(datetime(2024, 1, 1)).alias("ping_ts"), F.lit("at P7 now").alias("message"),
                                       F.lit(3.5).alias("lat"), F.lit(-76.5).alias("lon"))
    stops = spark.range(2_000).select(F.concat(F.lit("p"), F.col("id"), F.lit(" ")).alias("place"), F.lit(3.5001).alias("lat"), F.lit(-76.5).alias("lon"), F.lit(50.0).alias("radius_m"))
    found = places.place_hits(pings, stops, summed=True).groupBy("kind").agg(F.count("*").alias("rows"), F.sum("pings").alias("pings")).collect()
    assert {r["kind"]: (r["rows"], r["pings"]) for r in found} == {"text": (3, 20_000), "fence": (3 * 2_000, 20_000 * 2_000)}
    assert {name: rows.count() for name, rows in written.items() if name in ("said", "stays", "inside")} == {"said": 3, "stays": 3, "inside": 3}


def test_messages_meet_whole_names_only(spark):
    """No pairs of a message and a name that only begins as a part of it does."""
    pings = spark.range(300).select(F.concat(F.lit("left Stop 1"), F.col("id"), F.lit(" now")).alias("message"))
    stops = spark.range(3_000).select(F.concat(F.lit("STOP 10000"), F.col("id")).alias("place"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), F.lit(1.0).alias("radius_m"))
    found = places.named_places(pings, stops)
    assert found.count() == 0 and "contains" not in found._jdf.queryExecution().toString().lower()

"""Pings near any of many places: a grid of cells, an equi-join, the exact distance last.

Cells are rows of latitude as high as the largest radius, cut into equally many degrees of longitude that are at least
that wide on the ground; the last cell of a row meets the first.  A place is copied to every cell that its circle
touches (a few), a ping lies in exactly one.  So a ping is compared with the places around it, however many there are in all.

Distances are worked out between different positions and different circles (position and radius), once each; pings and names
are joined to the pairs that are near enough.

Names in messages are looked up among the distinct messages: where the letters that a name begins with stand, the letters
that follow are taken in every length such a name has, and must be a name.
"""

from __future__ import annotations

from math import ceil, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.functions.columns import EARTH_RADIUS_M, haversine_m
from busloom.functions.reuse import written_once
from busloom.operators.normalize import clean_positions

LEAST_CELL_M = 100.0
NAME_LETTERS = 6
SPARE = 1.000001  # cells are that much larger than the largest circle, far more than rounding
CELL_POSITIONS = 10_000  # positions of a cell that one task compares; a fuller cell is dealt to several
CIRCLE_SIDE = 1_000  # vehicles and names of a circle that one task pairs; a fuller circle is dealt to several
CIRCLE = ["place_lat", "place_lon", "radius_m"]


def _row(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height).cast("int")


def _cells_in(row: Column, height: float) -> Column:
    """How many cells a row has: none is narrower, at the row's side nearer to the equator or the pole, than it is high."""
    far = F.greatest(F.abs(row * height - 90), F.abs((row + 1) * height - 90))
    wide = F.floor(F.lit(360.0) * F.cos(F.radians(F.least(far, F.lit(90.0)))) / height)
    return F.greatest(wide, F.lit(1)).cast("long")


def _cell(lon: Column, cells: Column) -> Column:
    """Longitudes beyond a half turn go on at the other side."""
    return F.pmod(F.floor((lon + 180) / 360 * cells), cells)


def _covered(places: DataFrame, height: float) -> DataFrame:
    """A row per cell that a place's circle touches."""
    reach = F.degrees(F.col("radius_m") / EARTH_RADIUS_M) * SPARE
    low, high = F.greatest(F.col("place_lat") - reach, F.lit(-90.0)), F.least(F.col("place_lat") + reach, F.lit(90.0))
    # The circle's half width in longitude; a circle around a pole touches all of them.
    ratio = F.sin(F.radians(reach)) / F.cos(F.radians("place_lat"))
    pole = (F.col("place_lat") - reach <= -90) | (F.col("place_lat") + reach >= 90) | (ratio >= 1)
    half = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * SPARE)
    rows = places.withColumns({"_half": half, "_row": F.explode(F.sequence(_row(low, height), _row(high, height)))}).withColumn("_n", _cells_in(F.col("_row"), height))
    west, east = F.floor((F.col("place_lon") - F.col("_half") + 180) / 360 * F.col("_n")), F.floor((F.col("place_lon") + F.col("_half") + 180) / 360 * F.col("_n"))
    cells = F.sequence(west, F.least(east, west + F.col("_n") - 1))
    return rows.withColumn("_cell", F.explode(cells)).withColumn("_cell", F.pmod("_cell", "_n")).drop("_half", "_n")


def _known(places: DataFrame) -> DataFrame:
    """The places that can have pings: place and its circle."""
    return places.filter("place IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND radius_m > 0").select(
        "place", F.col("lat").cast("double").alias("place_lat"), F.col("lon").cast("double").alias("place_lon"), F.col("radius_m").cast("double").alias("radius_m"))


def _met(found: DataFrame, known: DataFrame, deal: int = CELL_POSITIONS) -> DataFrame:
    """Every different position of ``found`` with every different circle that it lies in: lat, lon, the circle, distance_m."""
    circles = known.select(*CIRCLE).distinct()
    largest = max(circles.agg(F.max("radius_m")).first()[0] or 0.0, LEAST_CELL_M)
    height = min(largest / EARTH_RADIUS_M * 180 / pi * SPARE, 180.0)
    height = 180.0 / max(1, ceil(180.0 / height) - 1)  # whole rows, none lower
    row = _row(F.col("lat"), height)
    cells = found.select("lat", "lon").distinct().withColumn("_row", row).withColumn("_cell", _cell(F.col("lon"), _cells_in(F.col("_row"), height)))
    placed = written_once(cells, "positions")
    full = placed.groupBy("_row", "_cell").agg(F.ceil(F.count(F.lit(1)) / deal).alias("_deals"))
    dealt = placed.join(full, ["_row", "_cell"]).withColumn("_deal", F.pmod(F.xxhash64("lat", "lon"), "_deals")).drop("_deals")
    copied = _covered(circles, height).join(full, ["_row", "_cell"]).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1)))
    pairs = dealt.join(copied, ["_row", "_cell", "_deal"]).withColumn("distance_m", haversine_m("lat", "lon", "place_lat", "place_lon"))
    return written_once(pairs.filter(F.col("distance_m") <= F.col("radius_m")).select("lat", "lon", *CIRCLE, "distance_m"), "met")


def _names_of(met: DataFrame, known: DataFrame) -> DataFrame:
    """The places whose circles hold a position."""
    return known.join(met.select(*CIRCLE).distinct(), CIRCLE, "left_semi")


def _tasks(rows: DataFrame) -> int:
    """Tasks for short rows that unfold to many: runtime re-planning would put them into a few."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near_places(pings: DataFrame, places: DataFrame) -> DataFrame:
    """Every readable ping with every place it lies at: the ping's columns, place, distance_m.

    ``places``: place, lat, lon, radius_m (positive).  Places without a name, position or radius have no pings.  The pairs of
    positions and circles are written while the frame is built; pings are dealt evenly before they meet their places, by vehicle if
    they have one, as that is what their results are mostly grouped by.
    """
    known, found = _known(places), clean_positions(pings)
    met = _met(found, known)
    by = [c for c in ("vehicle_id",) if c in found.columns]
    dealt = found.repartition(_tasks(found), *by)
    return dealt.join(met, ["lat", "lon"]).join(_names_of(met, known), CIRCLE).select(*found.columns, "place", "distance_m")


def named_places(pings: DataFrame, places: DataFrame) -> DataFrame:
    """Every ping whose message holds a place's name, in any case: the ping's columns, place."""
    return pings.join(_held(pings, places), "message").select(*pings.columns, "place")


def _held(pings: DataFrame, places: DataFrame) -> DataFrame:
    """The names that each different message holds: message, place.

    A message is met by the first letters of names, once per place in it, and by whole names; never by the names that only begin alike.
    """
    names = places.filter("trim(place) <> ''").select("place", F.upper("place").alias("_name")).distinct()
    letters = F.least(F.length("_name"), F.lit(NAME_LETTERS))
    begins = names.groupBy(F.substring(F.col("_name"), F.lit(1), letters).alias("_begin")).agg(F.collect_set(F.length("_name")).alias("_lengths"))
    lengths = [r[0] for r in names.select(letters).distinct().collect()]  # NAME_LETTERS numbers at most
    messages = pings.filter("message IS NOT NULL").select("message").distinct().withColumn("_text", F.upper("message"))
    if not lengths:
        return messages.select("message", F.lit(None).cast("string").alias("place")).limit(0)
    parts = F.flatten(F.array(*(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length("_text") - (n - 1), F.lit(1))), _part_of(n)) for n in lengths)))
    begun = messages.select("message", "_text", F.inline(parts)).join(begins, "_begin").withColumn("_length", F.explode("_lengths"))
    whole = begun.select("message", F.substring(F.col("_text"), F.col("_at"), F.col("_length")).alias("_name")).distinct()
    return whole.join(names, "_name").select("message", "place").distinct()


def _part_of(n: int):
    return lambda at: F.struct(at.alias("_at"), F.substring(F.col("_text"), at, F.lit(n)).alias("_begin"))


def place_hits(pings: DataFrame, places: DataFrame, *, summed: bool = False) -> DataFrame:
    """Pings that tell of a place, by text or by fence: vehicle, yard, kind, time, as ``gps.yard_hits`` gives them for a few.

    ``summed``: a row per vehicle, yard and kind instead, with the number of its pings and the first of their times.  Pings are
    then summed up before they meet places, so the work follows from the vehicles and places, not from the pings.
    """
    seen = pings.filter("vehicle_id IS NOT NULL AND ping_ts IS NOT NULL")
    named, near = (_named_sums, _near_sums) if summed else (named_places, near_places)
    kinds = (("text", named(seen, places)), ("fence", near(seen, places)))
    before, after = ([], ["pings", "first_ts"]) if summed else (["ping_ts"], [])
    text, fence = (found.select("vehicle_id", *before, F.col("place").alias("yard"), F.lit(kind).alias("kind"), *after) for kind, found in kinds)
    return text.unionByName(fence)


def _counted(pings: DataFrame, *by: str) -> DataFrame:
    return pings.groupBy("vehicle_id", *by).agg(F.count(F.lit(1)).alias("pings"), F.min("ping_ts").alias("first_ts"))


def _added(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("vehicle_id", *by).agg(F.sum("pings").alias("pings"), F.min("first_ts").alias("first_ts"))


def _named_sums(pings: DataFrame, places: DataFrame) -> DataFrame:
    """``named_places`` summed up: by vehicle and message before messages meet names."""
    said = written_once(_counted(pings.filter("message IS NOT NULL"), "message"), "said")
    return _added(said.join(_held(said, places), "message"), "place")


def _near_sums(pings: DataFrame, places: DataFrame) -> DataFrame:
    """``near_places`` summed up: by vehicle and position as written, then by vehicle and circle, before circles meet names.

    A name of one circle, as most are, needs no sum after that: its pings are those of the circle, as often as it is listed.
    """
    known = _known(places)
    stays = clean_positions(written_once(_counted(pings, "lat", "lon"), "stays"))
    met = _met(stays, known)
    inside = written_once(_added(stays.join(met, ["lat", "lon"]), *CIRCLE), "inside")
    names = written_once(_names_of(met, known).groupBy("place", *CIRCLE).agg(F.count(F.lit(1)).alias("_times")), "names")
    several = names.groupBy("place").agg(F.count(F.lit(1)).alias("_circles")).filter("_circles > 1")
    blocks = written_once(_blocks(inside, names, CIRCLE_SIDE), "blocks")

    def at(which: str) -> DataFrame:
        met_names = _paired(inside, names.join(several, "place", which), blocks)
        return met_names.select("vehicle_id", "place", (F.col("pings") * F.col("_times")).alias("pings"), "first_ts")

    return at("left_anti").unionByName(_added(at("left_semi"), "place"))


def _blocks(inside: DataFrame, names: DataFrame, side: int) -> DataFrame:
    """Circles by number, and how many blocks their vehicles and names are dealt to."""
    vehicles, called = (rows.groupBy(*CIRCLE).agg(F.ceil(F.count(F.lit(1)) / side).alias(to)) for rows, to in ((inside, "_vehicles"), (names, "_names")))
    return vehicles.join(called, CIRCLE).withColumn("_circle", F.monotonically_increasing_id())


def _paired(inside: DataFrame, names: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every vehicle of a circle with every name of it; every two blocks meet in one task, which keeps the names only.

    They meet by whole numbers: rows that were dealt by a fraction would be dealt again for the join.
    """
    key = ["_circle", "_vehicles", "_names"]

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        block = {own: F.pmod(F.xxhash64(by), own), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        return rows.join(blocks, CIRCLE).withColumns(block).drop(*CIRCLE).repartition(_tasks(rows), *key)

    return dealt(inside, "vehicle_id", "_vehicles", "_names").join(dealt(names, "place", "_names", "_vehicles"), key)


def place_entries(pings: DataFrame, places: DataFrame) -> DataFrame:
    """First and last ping, number of pings and least distance of every vehicle at every place it was at.

    Pings are summed up by vehicle and position, then by vehicle and circle, before they meet the places' names.
    """
    known = _known(places)
    stays = clean_positions(pings).groupBy("vehicle_id", "lat", "lon").agg(
        F.min("ping_ts").alias("entry_ts"), F.max("ping_ts").alias("last_ts"), F.count(F.lit(1)).alias("pings"))
    met = _met(stays, known)

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy("vehicle_id", *by).agg(
            F.min("entry_ts").alias("entry_ts"), F.max("last_ts").alias("last_ts"), F.sum("pings").alias("pings"), F.min("distance_m").alias("min_distance_m"))

    inside = summed(stays.join(met, ["lat", "lon"]), *CIRCLE).withColumnRenamed("min_distance_m", "distance_m")
    dealt = inside.repartition(_tasks(inside), "vehicle_id")  # a vehicle's rows are as many as the circles
    return summed(dealt.join(_names_of(met, known), CIRCLE), "place")

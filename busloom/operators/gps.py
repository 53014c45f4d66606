"""Departure times from GPS pings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.columns import haversine_m, plus_minutes, true_or_false
from busloom.functions.ordered import as_of, time_chunk
from busloom.functions.reuse import written_once
from busloom.operators.normalize import clean_positions
from busloom.operators.places import place_hits

# Search windows and fence radii in metres, outcomes of a search.
SEARCH_MINUTES = (30, 90, 180)
FENCE_M = 700.0
STUDY_FENCE_M = 1800.0
STUDY_MINUTES = 10
FOUND, NOT_FOUND, NO_VEHICLE, NO_PLAN = "OK", "NO_ENCONTRADO", "SIN_PLACA", "SIN_HORA_PLAN"


@dataclass(frozen=True)
class Yard:
    """A departure yard: the text that names it in messages, its position, its routes."""

    name: str
    lat: float
    lon: float
    routes: tuple


def _yard_of(route: Column, yards: Sequence[Yard], what=lambda y: y.name) -> Column:
    result = F
    for y in yards:
        result = result.when(route.isin(*y.routes), what(y))
    return result


def yard_distance(pings: DataFrame, yard: Yard) -> DataFrame:
    """Readable pings with their distance to one yard."""
    return clean_positions(pings).withColumn(
        "distance_m", haversine_m("lat", "lon", F.lit(yard.lat), F.lit(yard.lon)))


def fence_entry(pings: DataFrame, yard: Yard, keys: Sequence[str] = ("vehicle_id",),
                radius_m: float = STUDY_FENCE_M) -> DataFrame:
    """Earliest ping inside the fence, per key; null if none is."""
    near = F.col("distance_m") <= radius_m
    return yard_distance(pings, yard).groupBy(*keys).agg(
        F.min(F.when(near, F.col("ping_ts"))).alias("entry_ts"))


def yard_hits(pings: DataFrame, yards: Sequence[Yard], radius_m: float = FENCE_M) -> DataFrame:
    """Pings that tell of a yard, by text or by fence: (vehicle, yard, kind, time).

    The yards are a short list given by the caller, so they are spelled out per ping
    instead of joined; most pings leave no row.
    """
    def number(name: str) -> Column:
        return F.replace(F.trim(F.col(name).cast("string")), F.lit(","), F.lit(".")).try_cast("double")

    lat, lon = number("lat"), number("lon")
    placed = lat.between(-90, 90) & lon.between(-180, 180)
    checks = []
    for y in yards:
        named = F.upper("message").contains(y.name.upper())
        near = placed & (haversine_m(lat, lon, F.lit(y.lat), F.lit(y.lon)) <= radius_m)
        for kind, hit in (("text", named), ("fence", near)):
            checks.append(F.struct(F.lit(y.name).alias("yard"), F.lit(kind).alias("kind"),
                                   true_or_false(hit).alias("hit")))
    return (
        pings.filter(F.col("vehicle_id").isNotNull() & F.col("ping_ts").isNotNull())
        .select("vehicle_id", "ping_ts", F.inline(F.array(*checks)))
        .filter("hit").drop("hit")
    )


def departure_by_yard(pings: DataFrame, yard: Yard, keys: Sequence[str] = ("vehicle_id",),
                      radius_m: float = FENCE_M) -> DataFrame:
    """Departure per key: earliest ping that names the yard, else earliest inside its fence."""
    hits = yard_hits(pings, [yard], radius_m)
    first = {k: F.min(F.when(F.col("kind") == k, F.col("ping_ts"))) for k in ("text", "fence")}
    return hits.groupBy(*keys).agg(F.coalesce(first["text"], first["fence"]).alias("departure_ts"))


def find_departures(plans: DataFrame, pings: DataFrame, yards: Sequence[Yard] | DataFrame,
                    windows: Sequence[int] = SEARCH_MINUTES, radius_m: float = FENCE_M) -> DataFrame:
    """Departure of each distinct (vehicle, yard, planned start) and the window that had it.

    The smallest window wins; inside a window text comes before the fence.  For each
    window and kind the first hit at or after the window's start is looked up; it counts
    if it lies before the window's end.  So each plan makes two probes per window and no
    plan-ping pairs.  Many yards are given as a frame (place, lat, lon, radius_m).
    """
    plan_keys = ["vehicle_id", "yard", "planned_start"]
    probes = plans.select(*plan_keys).distinct().select(
        *plan_keys, F.inline(F.array(*[
            F.struct(F.lit(w).alias("window_min"), F.lit(k).alias("kind"))
            for w in windows for k in ("text", "fence")])))
    probes = probes.withColumn("_from", plus_minutes("planned_start", -F.col("window_min")))
    hits = place_hits(pings, yards) if isinstance(yards, DataFrame) else yard_hits(pings, yards, radius_m)
    hits = written_once(hits, "hits")  # few of the pings, read twice
    seen = as_of(probes, hits, ["vehicle_id", "yard", "kind"],
                 "_from", "ping_ts", {"_hit": "ping_ts"}, following=True, monotone=True)
    inside = F.col("_hit") <= plus_minutes("planned_start", F.col("window_min"))
    order = F.struct("window_min", (F.col("kind") == "fence").alias("_late"))
    best = F.min_by(F.struct("_hit", "window_min"), F.when(inside, order))
    return seen.groupBy(*plan_keys).agg(best.alias("_best")).select(
        *plan_keys, F.col("_best._hit").alias("departure_ts"), F.col("_best.window_min").alias("window_used"))


def impute_departures(trips: DataFrame, pings: DataFrame, yards: Sequence[Yard], *,
                      vehicles: DataFrame | None = None,
                      windows: Sequence[int] = SEARCH_MINUTES, radius_m: float = FENCE_M) -> DataFrame:
    """Fill missing starts; adds ``search_outcome`` and ``window_used`` (null if not searched).

    ``vehicles`` (vehicle_key, vehicle_id) names vehicles of trips that lack the name.
    """
    named = trips
    blank = F.col("vehicle_id").isNull() | (F.trim("vehicle_id") == "")
    if vehicles is not None:
        lookup = vehicles.select("vehicle_key", F.col("vehicle_id").alias("_looked_up"))
        named = trips.join(lookup, "vehicle_key", "left").withColumn(
            "vehicle_id", F.when(blank, F.col("_looked_up")).otherwise(F.col("vehicle_id"))).drop("_looked_up")
    routes = [r for y in yards for r in y.routes]
    wanted = (F.col("actual_start").isNull() & F.col("route_id").isin(*routes)
              & F.col("trip_id").isNotNull())
    searchable = true_or_false(wanted & ~blank & F.col("planned_start").isNotNull())

    outcome = F.when(true_or_false(wanted), F.when(blank, NO_VEHICLE).otherwise(NO_PLAN))
    rest = named.filter(~searchable).withColumns({
        "search_outcome": outcome, "window_used": F.lit(None).cast("int")})
    open_trips = named.filter(searchable).withColumn("yard", _yard_of(F.col("route_id"), yards))
    found = find_departures(open_trips, pings, yards, windows, radius_m)
    filled = open_trips.join(found, ["vehicle_id", "yard", "planned_start"], "left").withColumns({
        "actual_start": F.coalesce("actual_start", "departure_ts"),
        "search_outcome": F.when(F.col("departure_ts").isNotNull(), FOUND).otherwise(NOT_FOUND),
    })
    return rest.unionByName(filled.select(*rest.columns))


def search_audit(imputed: DataFrame) -> DataFrame:
    return (
        imputed.filter(F.col("search_outcome").isNotNull())
        .groupBy("search_outcome", "window_used").agg(F.count(F.lit(1)).alias("n"))
    )


def fence_radius_study(trips: DataFrame, pings: DataFrame, yards: Sequence[Yard], *,
                       minutes: int = STUDY_MINUTES) -> DataFrame:
    """Smallest distance to the yard around the planned start, for every trip without a start.

    The span around a plan is as long as a chunk of ``2 * minutes``, so it is the end of one
    chunk and the start of the next.  Distances carry the running minimum from either end of
    their (vehicle, chunk); a trip looks up one value in each chunk, and no trip-ping
    pairs are made.  Trips that share vehicle, yard and plan are looked up once.
    """
    routes = [r for y in yards for r in y.routes]
    route = F.col("route_id")
    wanted = trips.filter(F.col("actual_start").isNull() & F.col("planned_start").isNotNull()
                          & F.col("vehicle_id").isNotNull() & route.isin(*routes)).select(
        "trip_id", "vehicle_id", "planned_start", _yard_of(route, yards).alias("yard"))
    far = F.array(*[F.struct(F.lit(y.name).alias("yard"), haversine_m("lat", "lon", F.lit(y.lat), F.lit(y.lon)).alias("distance_m")) for y in yards])
    placed = clean_positions(pings).filter("vehicle_id IS NOT NULL AND ping_ts IS NOT NULL").select("vehicle_id", "ping_ts", F.inline(far))
    per_moment = placed.groupBy("vehicle_id", "yard", "ping_ts").agg(F.min("distance_m").alias("distance_m"))
    chunked = per_moment.withColumn("chunk", time_chunk(F.col("ping_ts"), 2 * minutes))
    inside = Window.partitionBy("vehicle_id", "yard", "chunk").orderBy("ping_ts")
    least = written_once(chunked.select(
        "vehicle_id", "yard", "chunk", "ping_ts",
        F.min("distance_m").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.min("distance_m").over(inside.rowsBetween(0, Window.unboundedFollowing)).alias("onward")), "distances")
    plans = wanted.select("vehicle_id", "yard", "planned_start").distinct()
    key = ["vehicle_id", "yard", "chunk"]

    def look(side: str, at: Column, following: bool) -> DataFrame:
        probes = plans.withColumn("_at", at).withColumn("chunk", time_chunk(F.col("_at"), 2 * minutes))
        return as_of(probes, least, key, "_at", "ping_ts", {"_near": side}, following=following).select(
            "vehicle_id", "yard", "planned_start", "_near")

    both = look("onward", plus_minutes("planned_start", -minutes), True).unionByName(look("upto", plus_minutes("planned_start", minutes), False))
    found = both.groupBy("vehicle_id", "yard", "planned_start").agg(F.min("_near").alias("min_distance_m")).filter("min_distance_m IS NOT NULL")
    return wanted.join(found, ["vehicle_id", "yard", "planned_start"]).select("trip_id", "min_distance_m")

"""Trip extraction from the dispatch tables, in one pass per table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.functions.ordered import keep_last

# Alarm kinds that inflate the count, point types of a trip sheet, status
# of a valid record.
DOOR_ALARMS = ("5", "6")
START_POINT, END_POINT = 1, 3
VALID = 1


def extract_trips(
    intervals: DataFrame,
    counters: DataFrame,
    sheet: DataFrame,
    alarms: DataFrame,
    vehicles: DataFrame,
    first: str,
    last: str,
    after_key: int = 0,
) -> DataFrame:
    """Trips with their counter, actual times, door alarms and vehicle name.

    The filters on trips come first, so that they reach the scan.  The sheet lookups
    become one conditional aggregate and the alarms one sum; both combine before the
    shuffle, and neither multiplies trips.
    """
    days = lambda c: F.col(c).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    trips = intervals.filter(days("start_date") & (F.col("row_status") == VALID) & (F.col("trip_id") > after_key))
    counted = counters.filter(days("exit_date")).drop("exit_date")
    at = lambda point, c: F.max(F.when(F.col("point_type") == point, F.col(c)))
    points = sheet.filter(F.col("point_type").isin(START_POINT, END_POINT)).groupBy("trip_id").agg(
        at(START_POINT, "actual_clock").alias("actual_start"), at(END_POINT, "actual_clock").alias("actual_end"),
        at(END_POINT, "trip_status").alias("trip_status"))
    door = alarms.filter(F.col("alarm_kind").isin(*DOOR_ALARMS)).groupBy("counter_id").agg(
        F.sum("quantity").alias("door_alarms"))
    out = trips.join(counted, "trip_id").join(points, "trip_id", "left").join(door, "counter_id", "left")
    out = out.withColumn("door_alarms", F.coalesce("door_alarms", F.lit(0))).drop("row_status")
    return fill_vehicle_names(out.withColumn("vehicle_id", F.lit(None).cast("string")), vehicles)


def fill_vehicle_names(trips: DataFrame, vehicles: DataFrame) -> DataFrame:
    """The trip's own vehicle name, else the one its key leads to."""
    names = vehicles.select("vehicle_key", F.col("vehicle_id").alias("_name"))
    return trips.join(names, "vehicle_key", "left").withColumn(
        "vehicle_id", F.coalesce("vehicle_id", "_name")).drop("_name")


def append_newer(stored: DataFrame, source: DataFrame, key: str = "trip_id", order: Sequence[str] = ()) -> DataFrame:
    """Stored rows plus the source rows above the stored high-water mark, last one per key.

    The mark is a scalar subquery over the stored key column; rows without a key are
    dropped with the deduplication of keys.
    """
    mark = F.coalesce(stored.agg(F.max(key).alias("m")).scalar(), F.lit(0))
    fresh = source.filter(F.col(key) > mark)
    both = stored.withColumn("_batch", F.lit(0)).unionByName(fresh.withColumn("_batch", F.lit(1)))
    return keep_last(both.filter(F.col(key).isNotNull()), [key], ["_batch", *order]).drop("_batch")


def pings_of(pings: DataFrame, vehicle: str, first: str, last: str) -> DataFrame:
    """One vehicle's pings in an inclusive time range, in order."""
    t = F.col("ping_ts")
    return pings.filter((F.col("vehicle_id") == vehicle) & (t >= F.lit(first).cast("timestamp_ntz"))
                        & (t <= F.lit(last).cast("timestamp_ntz"))).orderBy("ping_ts", "ping_id")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int,
              **options: str) -> DataFrame:
    """A database table read in key ranges, so that no single task pulls it all."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(partitions), **options).load()

"""Table readers, and trip-shaped views of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.functions.columns import plus_minutes
from busloom.operators.gps import Yard


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _every(k: int) -> Column:
    return F.col("event_id") % k == 0


def trips_from_events(events: DataFrame) -> DataFrame:
    """One trip per event; some starts and ends are missing."""
    ident = F.col("event_id")
    raw = F.floor("value").cast("long")
    alarms = ident % 3
    return events.select(
        ident.alias("trip_id"),
        F.concat(F.lit("V"), F.floor(F.col("user_id") / 8).cast("string")).alias("vehicle_id"),
        F.col("event_type").alias("route_id"),
        plus_minutes("ts", -(ident % 20)).alias("planned_start"),
        F.when(~_every(11), F.col("ts")).alias("actual_start"),
        F.when(~_every(7), plus_minutes("ts", 20 + ident * 37 % 160)).alias("actual_end"),
        raw.alias("boardings_raw"),
        alarms.alias("door_alarms"),
        F.greatest(raw - alarms, F.lit(0)).alias("boardings"),
        (F.col("value") * 10).alias("distance"),
        (ident % 5).alias("trip_status"),
    )


def raw_trips_from_events(events: DataFrame) -> DataFrame:
    """Trips with the faults the quality flags look for."""
    ident = F.col("event_id")
    number = F.floor(F.col("user_id") / 8).cast("string")
    start = F.when(~_every(11), F.col("ts"))
    end = F.when(_every(83), plus_minutes("ts", -5)).when(
        ~_every(7), plus_minutes("ts", 20 + ident * 37 % 160))
    raw = F.when(_every(89), F.lit(-1)).when(~_every(97), F.floor("value")).cast("long")
    return events.select(
        F.when(_every(211), F.lit(None)).when(_every(50), ident + 1).otherwise(ident).alias("trip_id"),
        F.when(_every(101), F.lit(" ")).when(_every(103), F.lit("None")).when(_every(107), F.lit(None))
        .otherwise(F.concat(F.lit("V"), number)).alias("vehicle_id"),
        F.when(~_every(109), F.col("event_type")).alias("route_id"),
        F.col("event_id").alias("row_id"),
        start.alias("actual_start"),
        end.alias("actual_end"),
        raw.alias("boardings_raw"),
        (ident % 3).alias("door_alarms"),
        F.when(_every(113), F.lit(-5.0)).otherwise(F.col("value") * 10).alias("distance"),
        (F.col("value") % 70).alias("frequency_min"),
        (ident % 5).alias("trip_status"),
    )


def pings_from_events(events: DataFrame) -> DataFrame:
    """One GPS reading per event; coordinates are text with a decimal comma."""
    ident = F.col("event_id")

    def comma(c: Column) -> Column:
        return F.regexp_replace(F.format_string("%.4f", c), "\\.", ",")

    return events.select(
        ident.alias("ping_id"),
        F.concat(F.lit("V"), F.floor(F.col("user_id") / 8).cast("string")).alias("vehicle_id"),
        plus_minutes("ts", ident * 13 % 240 - 60).alias("ping_ts"),
        F.when(~_every(13), F.col("value") % 60).alias("speed_kmh"),
        F.concat(F.lit("at "), F.col("event_type")).alias("message"),
        F.when(_every(53), F.lit(" 91,0")).otherwise(
            comma(F.lit(3.45) + (ident % 100).cast("double") / 5000)).alias("lat"),
        F.when(_every(59), F.lit("x")).otherwise(comma(F.lit(-76.53).cast("double"))).alias("lon"),
    )


# Yards of the benchmark routes: text that marks one in a message, and its position.
YARDS = (
    Yard("signup", 3.45, -76.53, ("click", "view", "error")),
    Yard("Purchase", 3.46, -76.53, ("purchase", "signup")),
)


def trips(spark: SparkSession, folder: str) -> DataFrame:
    return trips_from_events(read_table(spark, folder, "events"))


def raw_trips(spark: SparkSession, folder: str) -> DataFrame:
    return raw_trips_from_events(read_table(spark, folder, "events"))


def pings(spark: SparkSession, folder: str) -> DataFrame:
    return pings_from_events(read_table(spark, folder, "events"))


def trips_from_orders(orders: DataFrame) -> DataFrame:
    """Usable trips over several years, one per order, for weekly and monthly operators."""
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("trip_id"),
        F.concat(F.lit("V"), F.floor(F.col("o_custkey") / 4).cast("string")).alias("vehicle_id"),
        F.col("o_orderpriority").alias("route_id"),
        plus_minutes("o_orderdate", 300 + key * 7 % 900).alias("actual_start"),
        F.to_date("o_orderdate").alias("service_date"),
        F.floor(F.col("o_totalprice") / 10000).cast("long").alias("boardings"),
    )


def long_trips(spark: SparkSession, folder: str) -> DataFrame:
    return trips_from_orders(read_table(spark, folder, "orders"))

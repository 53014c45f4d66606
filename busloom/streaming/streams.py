"""Streaming counterparts: trip deduplication, demand bins, ping sessions.

Event times are cast to TIMESTAMP, which watermarks need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from busloom.functions.ordered import keep_first
from busloom.functions.reuse import written_once
from busloom.session import shared_dir

# Delay allowed, bin width, silence that ends a session.
DELAY = "1 hour"
BIN = "30 minutes"
SILENCE = "20 minutes"
KEY_BLOCK = 1_000_000


def dedup_trips(trips: DataFrame, key: str = "trip_id", ts: str = "actual_start", delay: str = DELAY) -> DataFrame:
    """First arrival of each trip; state is dropped once the watermark has passed.

    Copies that arrive further apart than the delay stay: ``dedup_exactly`` finds those too.
    """
    timed = trips.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("event_time", F.col(ts).cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def demand_bins(trips: DataFrame, ts: str = "actual_start", passengers: str = "boardings", delay: str = DELAY,
                width: str = BIN) -> DataFrame:
    """Trips, passengers and the exact p95 per route and bin; later trips than the delay are dropped.

    Two aggregates in a row: trips are counted by passengers first, so the state of an open bin is a row per number of
    passengers however many trips there are; what a closed bin's counts add up to follows from these rows.
    """
    timed = trips.filter(F.col(ts).isNotNull()).withColumn("event_time", F.col(ts).cast("timestamp"))
    counts = timed.withWatermark("event_time", delay).groupBy(F.window("event_time", width), "route_id", F.col(passengers).alias("pax")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.window(F.window_time("window"), width).alias("bin"), "route_id").agg(
        F.sum("n").alias("trips"), F.sum(F.col("pax") * F.col("n")).alias("passengers_sum"),
        F.percentile("pax", 0.95, F.col("n")).alias("passengers_p95"),
    ).select(F.col("bin.start").alias("bin_start"), "route_id", "trips", "passengers_sum", "passengers_p95")


def dedup_exactly(stream: DataFrame, base: str, key: str = "trip_id", block: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """One row per key of all that ever arrived, however far apart its copies are; the table so far.

    Each micro-batch is reduced to its first row per key (by ``order``) and compared with the keys of earlier batches, which lie
    in a table by blocks of keys (``block``; by default a million numbers each): a batch reads the blocks it has keys of, and
    new keys, which grow with time, are in few.  Both the rows and the keys of a batch are written under its number, rows first:
    a batch that is run again finds only earlier ones' keys and replaces its own files, so nothing is lost or doubled.
    Rows without a key are left out.  The checkpoint next to the table makes a rerun with the same ``base`` go on.
    """
    spark = stream.sparkSession
    block = F.floor(F.col(key).cast("double") / KEY_BLOCK).cast("long") if block is None else block
    keys_schema = StructType([stream.schema[key], StructField("block", LongType()), StructField("batch", LongType())])

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        rows = keep_first(batch.filter(F.col(key).isNotNull()), [key], list(order) or [c for c in batch.columns if c != key]).withColumn("block", block)
        rows = written_once(rows, "batch")
        blocks = [r[0] for r in rows.select("block").distinct().collect()]  # as many as the batch has blocks of keys
        known = _keys(own, f"{base}/keys", keys_schema).filter((F.col("batch") < number) & F.col("block").isin(blocks))
        new = written_once(rows.join(known.select(key).distinct(), key, "left_anti"), "batch")
        new.select(batch.columns).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        new.select(key, "block").write.mode("overwrite").partitionBy("block").parquet(f"{base}/keys/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not out.getFileSystem(spark._jsc.hadoopConfiguration()).exists(out):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(stream.columns)


def _keys(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def ping_sessions(pings: DataFrame, ts: str = "ping_ts", delay: str = DELAY, silence: str = SILENCE) -> DataFrame:
    """Runs of pings per vehicle: first and last ping, count, mean and last known speed."""
    timed = pings.withColumn("event_time", F.col(ts).cast("timestamp"))
    return timed.withWatermark("event_time", delay).groupBy(F.session_window("event_time", silence), "vehicle_id").agg(
        F.min("event_time").alias("first_ping"), F.max("event_time").alias("last_ping"), F.count(F.lit(1)).alias("pings"),
        F.avg("speed_kmh").alias("speed_mean"), F.max_by("speed_kmh", F.when(F.col("speed_kmh").isNotNull(), F.col("event_time"))).alias("last_speed"),
    ).drop("session_window")


def read_growing(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as a file stream; new files of that name pattern are picked up."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def run_available(stream: DataFrame, base: str | None = None) -> DataFrame:
    """Process what is there, append it to a table in the shared folder, and read that.

    The checkpoint next to the table makes a rerun with the same ``base`` go on where it stopped.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid4().hex}"
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def replay(spark: SparkSession, folder: str, name: str, build: Callable[[DataFrame], DataFrame], closing: dict) -> DataFrame:
    """Run a finished table through a stream to its very end.

    In append mode the last windows stay open for want of a later event.  So a second source
    gets one ``closing`` row, far in the future, once everything else is through: the watermark
    passes all windows but the closing row's own, which is never handed out.
    """
    base = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/closing")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema

    def stream() -> DataFrame:
        late = spark.readStream.schema(schema).parquet(f"{base}/closing")
        return build(read_growing(spark, folder, name).unionByName(late))

    run_available(stream(), base)
    row = spark.range(1).select(*[F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
    row.write.mode("append").parquet(f"{base}/closing")
    return run_available(stream(), base)

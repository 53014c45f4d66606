"""Day sequences: fixed-length arrays of slot values with a mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.functions.columns import minute_of_day

# Length by order and by clock, first minute and width of a clock slot,
# slots a day needs.
ORDINAL_LENGTH = 28
CLOCK_LENGTH = 29
CLOCK_START_MIN = 240
CLOCK_SLOT_MIN = 30
MIN_SLOTS = 8

DAY = ("route_id", "service_day")


def _day_slots(table: DataFrame, value: str) -> DataFrame:
    """One row per route and service day: its slots in order (at most a day's slots)."""
    seen = table.filter(F.col(value).isNotNull())
    slot = F.struct("timestamp", minute_of_day("timestamp").alias("minute"), F.col(value).cast("double").alias("value"),
                    "day_type", "weekday")
    return seen.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(slot)).alias("_slots"))


def _calendar() -> list[Column]:
    first = F.col("_slots")[0]
    return [first["day_type"].alias("day_type"), first["weekday"].alias("weekday")]


def ordinal_sequences(table: DataFrame, value: str = "passengers_sum", length: int = ORDINAL_LENGTH) -> DataFrame:
    """First values of the day in time order, padded with zeros; the mask tells which count."""
    used = F.slice(F.transform("_slots", lambda s: s["value"]), 1, length)
    pad = F.lit(length) - F.size(used)
    ones = F.transform(used, lambda _: F.lit(1.0))
    zeros = F.array_repeat(F.lit(0.0), pad)
    return _day_slots(table, value).select(
        *DAY, "n", *_calendar(), F.concat(used, zeros).alias("values"), F.concat(ones, zeros).alias("mask"))


def clock_sequences(table: DataFrame, value: str = "passengers_sum", length: int = CLOCK_LENGTH) -> DataFrame:
    """Values at their clock position; ``duplicates`` counts slots that share one (an error)."""
    place = lambda s: F.floor((s["minute"] - CLOCK_START_MIN) / CLOCK_SLOT_MIN).cast("int")
    placed = F.filter(F.transform("_slots", lambda s: F.struct(place(s).alias("i"), s["value"].alias("v"))),
                      lambda s: (s["i"] >= 0) & (s["i"] < length))
    days = _day_slots(table, value).withColumn("_placed", placed)
    positions = F.transform("_placed", lambda s: s["i"])

    def at(i: Column) -> Column:
        return F.filter("_placed", lambda s: s["i"] == i)

    steps = F.sequence(F.lit(0), F.lit(length - 1))
    return days.select(
        *DAY, "n", *_calendar(),
        F.transform(steps, lambda i: F.coalesce(F.get(at(i), F.lit(0))["v"], F.lit(0.0))).alias("values"),
        F.transform(steps, lambda i: (F.size(at(i)) > 0).cast("double")).alias("mask"),
        (F.size(positions) - F.size(F.array_distinct(positions))).alias("duplicates"))


def _earlier(days: DataFrame, offset: int, prefix: str) -> DataFrame:
    return days.select(
        "route_id", F.date_add("service_day", offset).alias("service_day"), F.col("n").alias(f"_{prefix}_n"),
        F.col("values").alias(f"{prefix}_values"), F.col("mask").alias(f"{prefix}_mask"))


def day_pairs(days: DataFrame, channels: dict[str, int] | None = None, min_slots: int = MIN_SLOTS) -> DataFrame:
    """Each day joined to earlier days of its route, all with enough slots.

    ``channels`` maps a prefix to days back: the day before by default, or the day before
    and the same day of last week.
    """
    out = days.filter(F.col("n") >= min_slots)
    for prefix, back in (channels or {"previous": 1}).items():
        past = _earlier(days, back, prefix).filter(F.col(f"_{prefix}_n") >= min_slots).drop(f"_{prefix}_n")
        out = out.join(past, list(DAY))
    return out


def standardise(pairs: DataFrame, is_training: Column, inputs: Sequence[str] = ("previous",)) -> DataFrame:
    """Scale targets and inputs by mean and population deviation of the training targets
    that count; masked input positions become zero."""
    seen = pairs.filter(is_training).select("route_id", F.explode(F.arrays_zip("values", "mask")).alias("s")).filter("s.mask = 1")
    stats = seen.groupBy("route_id").agg(F.avg("s.values").alias("_mean"), F.stddev_pop("s.values").alias("_std"))
    mean, std = F.col("_mean"), F.col("_std")
    out = pairs.join(stats, "route_id").withColumn("scaled", F.transform("values", lambda v: (v - mean) / std))
    for p in inputs:
        out = out.withColumn(f"{p}_scaled", F.zip_with(
            f"{p}_values", f"{p}_mask", lambda v, m: F.when(m == 1, (v - mean) / std).otherwise(0.0)))
    return out.withColumnsRenamed({"_mean": "train_mean", "_std": "train_std"})

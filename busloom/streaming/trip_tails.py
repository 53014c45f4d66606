"""Trip ends as a stream: the same classes as ``operators.trip_end``, from a bounded tail per vehicle.

Starts and pings arrive together, keyed by vehicle.  A trip is judged once the watermark has passed the end of its
search window, as no ping of the window can come after that.  Per vehicle the state holds

* the starts that wait for the end of their window,
* the pings that are newer than the watermark, as these may still come out of order,
* of those before it, the last ``tail_min`` minutes and the last ``tail_pings`` speeds: whichever start is judged
  later, its tail ends at the last of them or at a newer ping.

So state grows with the pings of the delay and the tail, not with the trips' length or the stream's age.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from busloom.operators.trip_end import ABANDONED, NO_GPS, NO_GPS_AFTER_START, RETURNING, UNDETERMINED, EndRules

MINUTE = 60_000_000
PING = np.dtype([("ts", "<i8"), ("id", "<i8"), ("speed", "<f8"), ("off", "?")])
ENDS = "vehicle_id string, start_us long, end_us long, end_type string, held_pings long"
STATE = "pings binary, starts binary"


def judge(start: int, pings: np.ndarray, rules: EndRules) -> tuple[int | None, str]:
    """End (microseconds) and its type for a start; ``pings`` sorted, with all of its window from the tail on."""
    upto = pings[: np.searchsorted(pings["ts"], start + rules.after_min * MINUTE, "right")]
    if not len(upto) or upto["ts"][-1] < start - rules.before_min * MINUTE:
        return None, NO_GPS
    end = int(upto["ts"][-1])
    if end < start:
        return None, NO_GPS_AFTER_START
    tail = upto[upto["ts"] >= max(start, end - rules.tail_min * MINUTE)]
    speeds = tail["speed"][~np.isnan(tail["speed"])]
    if not len(speeds):
        known = upto[~np.isnan(upto["speed"])][-rules.tail_pings:]
        speeds = known["speed"][known["ts"] >= start]
    if not len(speeds):
        return end, UNDETERMINED
    score = np.count_nonzero(speeds <= rules.low_kmh) / len(speeds)
    if rules.use_power_off and tail["off"].any():
        score = min(1.0, (1 - rules.power_off_weight) * score + rules.power_off_weight)
    if score >= rules.abandoned_share:
        return end, ABANDONED
    return end, RETURNING if np.median(speeds) >= rules.returning_kmh else UNDETERMINED


def needed(pings: np.ndarray, watermark: int, rules: EndRules) -> np.ndarray:
    """The sorted pings without those that no later judgement can see."""
    past = pings[: np.searchsorted(pings["ts"], watermark, "right")]
    if not len(past):
        return pings
    keep = past["ts"] >= past["ts"][-1] - rules.tail_min * MINUTE
    keep[np.flatnonzero(~np.isnan(past["speed"]))[-rules.tail_pings:]] = True
    return np.concatenate([past[keep], pings[len(past):]])


def trip_ends(starts: DataFrame, pings: DataFrame, rules: EndRules = EndRules(), delay: str = "1 hour") -> DataFrame:
    """vehicle_id, actual_start, estimated_end, end_type, held_pings for each distinct (vehicle, start) of a stream of trips.

    ``starts``: vehicle_id, actual_start; ``pings``: vehicle_id, ping_ts, ping_id, speed_kmh, message; both streams.
    Rows without a vehicle or a time take no part, nor do rows later than ``delay``.  ``held_pings`` is how many pings the
    vehicle's state keeps after the judgement.  A vehicle's rows of one batch are in one task.
    """
    def at(column: str) -> Any:
        return F.col(column).cast("timestamp").alias("event_time")

    blank = F.lit(None)
    both = starts.select("vehicle_id", at("actual_start"), F.lit(True).alias("is_start"), blank.cast("long").alias("id"), blank.cast("double").alias("speed"), F.lit(False).alias("off")).unionByName(
        pings.select("vehicle_id", at("ping_ts"), F.lit(False).alias("is_start"), F.col("ping_id").cast("long").alias("id"), F.col("speed_kmh").cast("double").alias("speed"),
                     F.coalesce(F.col("message").contains(rules.power_off_text), F.lit(False)).alias("off")))
    timed = both.where((F.trim("vehicle_id") != "") & F.col("event_time").isNotNull()).withWatermark("event_time", delay).withColumn("us", F.unix_micros("event_time"))
    after = rules.after_min * MINUTE

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = (np.frombuffer(state.get[0], PING), np.frombuffer(state.get[1], "<i8")) if state.exists else (np.empty(0, PING), np.empty(0, "<i8"))
        fresh, begun = [held], [waiting]
        if not state.hasTimedOut:
            for frame in frames:
                mine = frame["is_start"].to_numpy(bool)
                begun.append(frame["us"].to_numpy("i8")[mine])
                frame = frame[~mine]
                part = np.empty(len(frame), PING)
                part["ts"], part["id"] = frame["us"], frame["id"].fillna(-1)
                part["speed"], part["off"] = frame["speed"].astype("f8"), frame["off"].astype(bool)
                fresh.append(part)
        pings, waiting = np.concatenate(fresh), np.unique(np.concatenate(begun))
        pings = pings[np.lexsort((pings["id"], pings["ts"]))]
        watermark = state.getCurrentWatermarkMs() * 1000
        due = waiting[waiting + after <= watermark]
        rows = [(key[0], int(s), *judge(int(s), pings, rules)) for s in due]
        pings, waiting = needed(pings, watermark, rules), waiting[len(due):]
        state.update((pings.tobytes(), waiting.tobytes()))
        if len(waiting):
            state.setTimeoutTimestamp(max(int(waiting[0] + after) // 1000 + 1, watermark // 1000 + 1))
        if rows:
            found = pd.DataFrame(rows, columns=["vehicle_id", "start_us", "end_us", "end_type"]).astype({"end_us": "Int64"})
            yield found.assign(held_pings=len(pings))

    judged = timed.groupBy("vehicle_id").applyInPandasWithState(step, ENDS, STATE, "append", GroupStateTimeout.EventTimeTimeout)

    def local(column: str) -> Any:
        return F.timestamp_micros(column).cast("timestamp_ntz")

    return judged.select("vehicle_id", local("start_us").alias("actual_start"), local("end_us").alias("estimated_end"), "end_type", "held_pings")

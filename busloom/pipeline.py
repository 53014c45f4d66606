"""The whole preparation of trips in one call: raw records to clean, ended, model-ready trips."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once
from busloom.operators import gps, normalize, quality, trip_end


@dataclass(frozen=True)
class Prepared:
    """The stages, as the post-load reports name them."""

    raw: DataFrame
    qc: DataFrame
    end: DataFrame
    model_ready: DataFrame
    final: DataFrame


def normalized(raw: DataFrame, routes: Sequence | None = None) -> DataFrame:
    """Raw records (dates and clock texts apart, counts maybe as text) as trips.

    ``aux_start`` and ``aux_end`` stand in for missing actual clocks.  ``routes`` keeps the
    lines that are studied.
    """
    def moment(date: str, *clocks: str) -> Column:
        return F.coalesce(*[normalize.combine_date_clock(date, c) for c in clocks if c in raw.columns])

    trips = raw.withColumns({
        "planned_start": moment("start_date", "planned_start"), "planned_end": moment("end_date", "planned_end"),
        "actual_start": moment("start_date", "actual_start", "aux_start"), "actual_end": moment("end_date", "actual_end", "aux_end"),
        "boardings_raw": F.col("boardings_raw").try_cast("long"), "door_alarms": F.col("door_alarms").try_cast("long"),
    }).drop("aux_start", "aux_end")
    trips = trips.withColumn("boardings", normalize.corrected_boardings("boardings_raw", "door_alarms"))
    return trips if routes is None else trips.filter(F.col("route_id").isin(*routes))


def run(trips: DataFrame, pings: DataFrame, yards: Sequence[gps.Yard], *,
        limits: quality.QualityLimits = quality.QualityLimits(), rules: trip_end.EndRules = trip_end.EndRules()) -> Prepared:
    """Missing starts from GPS, quality flags, trip ends, model-ready trips and their final integrity.

    Trips that fail hard are left out from the ends on.  The checked and the ended trips are
    written once, as later stages and reports read them again.
    """
    imputed = gps.impute_departures(trips, pings, yards)
    checked = written_once(quality.flag_trips(imputed, limits), "checked")
    sound = checked.filter(~F.col("qc_hard_fail"))
    ended = written_once(trip_end.resume_trip_ends(sound, pings, rules=rules), "ended")
    ready = normalize.model_ready(ended)
    return Prepared(trips, checked, ended, ready, normalize.final_integrity(ready))

"""Queries over published versions: series kept up to date, trip ends in batches, days that are replaced."""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.functions.columns import service_day
from busloom.operators import hours, incremental, series, trip_end
from busloom.plans.common_sql import sql
from busloom.plans.gps_queries import RULES, pings
from busloom.plans.registry import Query
from busloom.plans.series_queries import ready
from busloom.session import shared_dir
from busloom.sources import versions
from busloom.sources.tables import trips

LATE_DAYS = 3
DAYS_PER_BATCH = 11


def _place(s, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid4().hex}"


def kept_up_to_date(s, d) -> DataFrame:
    """Bins after two deliveries: first wrong passengers for some trips and without the last days, then these and the corrections."""
    now = ready(s, d).select("trip_id", "route_id", "actual_start", "boardings")
    day, wrong = service_day("actual_start"), F.col("trip_id") % 997 == 0
    last = now.agg(F.max(day)).first()[0]
    late = day > F.lit(last - timedelta(days=LATE_DAYS)) if last else F.lit(False)
    first = now.filter(~late).withColumn("boardings", F.when(wrong, F.col("boardings") + 1000).otherwise(F.col("boardings")))
    stored, counts = _place(s, "trips"), _place(s, "counts")
    for delivery in (first, now.filter(late | wrong)):
        incremental.refresh_counts(s, stored, counts, incremental.merge_trips(s, stored, delivery))
    return incremental.bins(s, counts)


def gap_types(s, d) -> DataFrame:
    base = series.series_of(kept_up_to_date(s, d))
    return series.add_service_hours(base, hours.estimate_hours(base))


def ends_in_batches(s, d) -> DataFrame:
    """Trip ends after a run that died behind its first batch and one that went on."""
    t, p, folder = trips(s, d), pings(s, d), _place(s, "ends")
    for _ in range(2):
        run = trip_end.publish_trip_ends(t, p, folder, run="one", days_per_batch=DAYS_PER_BATCH, rules=RULES)
        next(run, None)
        run.close()
    for _ in trip_end.publish_trip_ends(t, p, folder, run="one", days_per_batch=DAYS_PER_BATCH, rules=RULES):
        pass
    return versions.read_published(s, folder)


def replaced_days(s, d) -> DataFrame:
    """Rows per day and the version each day is of, after every third day was published again."""
    folder = _place(s, "days")
    rows = ready(s, d).select("trip_id", "boardings", service_day("actual_start").alias(versions.DAY))
    versions.publish_days(rows.withColumn("boardings", F.lit(0).cast("long")), folder)
    third = F.dayofmonth(versions.DAY) % 3 == 0
    again = rows.filter(third).withColumn("boardings", F.col("boardings").cast("long"))
    versions.publish_days(again, folder, [d for d in versions.manifest(s, folder)["days"] if int(d[-2:]) % 3 == 0])
    number = {d: int(v.split("-")[0]) for d, v in versions.manifest(s, folder)["days"].items()}
    of_day = F.create_map(*(F.lit(x) for pair in number.items() for x in pair))[F.col(versions.DAY).cast("string")]
    return versions.read_published(s, folder).groupBy(versions.DAY).agg(
        F.count("*").alias("n"), F.sum("boardings").alias("passengers")).withColumn("version", of_day)


_ENDS = "trip_id:i is_complete:i estimated_end:t end_type:s end_source:s"

QUERIES = [
    Query("s1_incremental_bins", "route_id:s gran_min:i timestamp:t passengers_sum:f trips:i passengers_mean:f passengers_p95:f", kept_up_to_date, sql("SELECT * FROM bins_v")),
    Query("s6_incremental_gap_types", "route_id:s gran_min:i timestamp:t is_gap:b day_type:s in_hours:b gap_type:s", gap_types, sql("SELECT * FROM series_v")),
    Query("t3_published_trip_ends", _ENDS, ends_in_batches, sql("""
      SELECT t.trip_id, CASE WHEN t.actual_end IS NOT NULL THEN 1 ELSE coalesce(n.is_complete, 0) END AS is_complete, coalesce(t.actual_end, n.estimated_end) AS estimated_end,
        CASE WHEN t.actual_end IS NOT NULL THEN 'COMPLETO' ELSE n.end_type END AS end_type, CASE WHEN t.actual_end IS NOT NULL THEN 'REAL' ELSE n.end_source END AS end_source
      FROM trips_v t LEFT JOIN (SELECT * FROM ends_v WHERE end_type <> 'SIN_PLACA_O_INICIO') n ON n.trip_id = t.trip_id""")),
    Query("io7_replaced_days", "service_day:d n:i passengers:i version:i", replaced_days, sql("""
      SELECT service_day, n, CASE WHEN third THEN passengers ELSE 0 END AS passengers, CASE WHEN third THEN 2 ELSE 1 END AS version FROM (
        SELECT service_day, day(service_day) % 3 = 0 AS third, count(*) AS n, sum(boardings) AS passengers
        FROM (SELECT *, CAST(actual_start - INTERVAL 4 HOUR AS DATE) AS service_day FROM ready_v) GROUP BY 1)""")),
]

"""Demand series kept up to date: counts per service day, refreshed only for the days that new or corrected trips touch.

Both tables are published (``sources.versions``).  Trips keep their rows by service day; the counts are
``series.fine_counts`` of ``FINE`` minutes, from which sums, means and exact percentiles of all widths follow.  A refresh
reads and writes the touched days only; the bins are then one aggregate over the counts, of which there are at most as
many as trips and, for a busy route, far fewer.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busloom.functions.columns import service_day
from busloom.functions.ordered import keep_last
from busloom.functions.reuse import written_once
from busloom.operators import series
from busloom.sources.versions import DAY, manifest, publish_days, read_published

FINE = 15


def _days(rows: DataFrame, *columns: str) -> list[str]:
    """The distinct days of some columns: one name per calendar day."""
    found = rows.select(F.explode(F.array(*(F.col(c).cast("date") for c in columns))).alias("d")).filter("d IS NOT NULL").distinct()
    return sorted(str(r[0]) for r in found.collect())


def merge_trips(spark: SparkSession, folder: str, fresh: DataFrame, *, key: str = "trip_id", ts: str = "actual_start",
                moved_from: str | None = None, order: Sequence[str] = ()) -> list[str]:
    """Publish new and corrected trips; the service days that were touched.

    A trip in ``fresh`` replaces the stored one with its key: on its own day, and, where a correction has moved it, on the
    day that ``moved_from`` (a date column of ``fresh``) names.  Of several rows with a key the last by ``order``
    counts.  A trip without a start belongs to no day: if it had one, it is taken out there.  Rows
    without a key are left out.
    """
    fresh = fresh.withColumn(DAY, service_day(ts))
    columns = [c for c in fresh.columns if c != moved_from]
    fresh = written_once(keep_last(fresh.filter(F.col(key).isNotNull()), [key], list(order) or [c for c in fresh.columns if c != key]), "fresh")
    touched = _days(fresh, DAY, *([moved_from] if moved_from else []))
    rows = fresh.filter(F.col(DAY).isNotNull()).select(*columns)
    stored = read_published(spark, folder, touched)
    if stored is not None:
        rows = stored.join(fresh.select(key), key, "left_anti").select(*columns).unionByName(rows)
    publish_days(rows, folder, touched)
    return touched


def refresh_counts(spark: SparkSession, trips_folder: str, counts_folder: str, days: Iterable[str], **options: str) -> None:
    """Count the trips of some service days anew, and no others."""
    days = sorted(set(days))
    trips = read_published(spark, trips_folder, days)
    if trips is None or not days:
        return
    publish_days(series.fine_counts(trips, FINE, by={DAY: F.col(DAY)}, **options), counts_folder, days, {"counted": manifest(spark, trips_folder)["version"]})


def bins(spark: SparkSession, counts_folder: str, granularities: Sequence[int] = series.GRANULARITIES) -> DataFrame:
    """The demand bins of all that has been counted, for widths that are multiples of ``FINE``."""
    if any(g % FINE for g in granularities):
        raise ValueError(f"widths must be multiples of {FINE} minutes")
    counts = read_published(spark, counts_folder)
    if counts is None:
        raise ValueError(f"nothing has been counted yet: {counts_folder}")
    return series.bins_of(counts, granularities)

"""Neighbour and as-of lookups that keep hot keys spread over tasks.

A plain window over ``key`` puts all rows of a key in one task.  Here the window
runs over (key, time chunk), and only one small row per chunk is looked at to carry
a value over the chunk border.  A key holding a third of all rows is thus split into
as many pieces as it has chunks, with the same exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.columns import struct_of

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def time_chunk(ts: Column, minutes: int) -> Column:
    elapsed = F.timestamp_diff("SECOND", F.expr(_EPOCH), ts.cast("timestamp_ntz"))
    return F.floor(elapsed / F.lit(60 * minutes))


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    take: dict[str, str],
    *,
    following: bool = False,
    chunk_minutes: int = 60,
) -> DataFrame:
    """Add columns of the previous (or following) row of the same key.

    ``take`` maps output names to source columns.  Rows are ordered by (ts, tie); the
    keys must not be null.
    """
    sources = list(dict.fromkeys(take.values()))
    chunked = df.withColumn("_chunk", time_chunk(F.col(ts), chunk_minutes))
    part = [*keys, "_chunk"]
    order = [F.col(ts).desc(), F.col(tie).desc()] if following else [F.col(ts), F.col(tie)]
    inside = F.lag(struct_of(sources)).over(Window.partitionBy(*part).orderBy(*order))

    chunk_order = F.col("_chunk").desc() if following else F.col("_chunk")
    if sources == [ts]:
        # A plain minimum or maximum aggregates by hash; a struct would need a sort.
        edge = F.struct((F.min(ts) if following else F.max(ts)).alias(ts))
    else:
        edge = (F.min_by if following else F.max_by)(struct_of(sources), struct_of([ts, tie]))
    borders = (
        chunked.groupBy(*part).agg(edge.alias("_edge"))
        .withColumn("_carry", F.lag("_edge").over(Window.partitionBy(*keys).orderBy(chunk_order)))
        .select(*part, "_carry")
    )
    found = (
        chunked.withColumn("_inside", inside)
        .join(borders, part, "left")
        .withColumn("_near", F.coalesce("_inside", "_carry"))
    )
    return found.select(
        *[F.col(c) for c in df.columns],
        *[F.col("_near").getField(src).alias(out) for out, src in take.items()],
    )


def with_running_counts(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    counts: dict[str, Column],
    *,
    chunk_minutes: int = 60,
) -> DataFrame:
    """Add, per key, how many rows up to and including this one meet each condition.

    Counted inside each (key, chunk) and shifted by the total of the earlier chunks.
    """
    chunked = df.withColumns({
        "_chunk": time_chunk(F.col(ts), chunk_minutes),
        **{f"_is_{n}": F.coalesce(c, F.lit(False)).cast("long") for n, c in counts.items()},
    })
    part = [*keys, "_chunk"]
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*part).agg(*[F.sum(f"_is_{n}").alias(f"_sum_{n}") for n in counts])
        .select(*part, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}")
                         for n in counts])
    )
    inside = Window.partitionBy(*part).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.withColumns({f"_run_{n}": F.sum(f"_is_{n}").over(inside) for n in counts})
        .join(offsets, part)
        .select(*df.columns, *[(F.col(f"_run_{n}") + F.col(f"_before_{n}")).alias(n) for n in counts])
    )


def as_of(
    probes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    probe_ts: str,
    event_ts: str,
    take: dict[str, str],
    *,
    following: bool = False,
    tie: str | None = None,
    monotone: bool = False,
    chunk_minutes: int = 60,
) -> DataFrame:
    """Add columns of the last event at or before each probe (or first at or after it).

    Both sides are stacked and sorted once per (key, chunk): no probe-event pairs are
    made.  Keys and times must not be null.  ``monotone`` tells that every taken column
    never falls in event order (as times and running counts), so that a chunk's last
    values are plain maxima.
    """
    sources = list(dict.fromkeys(take.values()))
    tie_col = F.col(tie) if tie else F.lit(0)
    stacked = events.select(
        *keys, F.col(event_ts).alias("_ts"), struct_of(sources).alias("_event"), tie_col.alias("_tie"),
    ).unionByName(
        probes.select(*keys, F.col(probe_ts).alias("_ts"), struct_of(probes.columns).alias("_probe")),
        allowMissingColumns=True,
    ).withColumn("_chunk", time_chunk(F.col("_ts"), chunk_minutes))

    part = [*keys, "_chunk"]
    is_probe = F.col("_probe").isNotNull()
    if following:
        order = [F.col("_ts").desc(), is_probe, F.col("_tie").desc()]
        chunk_order, extreme, pick = F.col("_chunk").desc(), F.min, F.min_by
    else:
        order = [F.col("_ts"), is_probe, F.col("_tie")]
        chunk_order, extreme, pick = F.col("_chunk"), F.max, F.max_by
    if monotone:
        edge = F.struct(*[extreme(F.col("_event").getField(c)).alias(c) for c in sources]).alias("_edge")
    else:
        edge = pick("_event", F.struct("_ts", "_tie")).alias("_edge")

    so_far = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    first_chunk = events.select(*keys, time_chunk(F.col(event_ts), chunk_minutes).alias("_chunk"),
                                struct_of(sources).alias("_event"),
                                F.col(event_ts).alias("_ts"), tie_col.alias("_tie"))
    probe_chunks = probes.select(*keys, time_chunk(F.col(probe_ts), chunk_minutes).alias("_chunk"))
    borders = (
        first_chunk.groupBy(*part).agg(edge)
        .unionByName(probe_chunks.distinct(), allowMissingColumns=True)
        .groupBy(*part).agg(F.first("_edge", ignorenulls=True).alias("_edge"))
        .withColumn("_carry", F.last("_edge", ignorenulls=True).over(earlier))
        .select(*part, "_carry")
    )
    found = (
        stacked.withColumn("_inside", F.last("_event", ignorenulls=True).over(so_far))
        .filter(is_probe)
        .join(borders, part, "left")
        .withColumn("_near", F.coalesce("_inside", "_carry"))
    )
    return found.select(
        "_probe.*", *[F.col("_near").getField(src).alias(out) for out, src in take.items()]
    )


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``.

    An aggregate, not a window: copies of a hot key collapse before the shuffle.
    """
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def _keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(pick(struct_of(rest), struct_of(order)).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)

"""Exact statistics over groups that may be very large."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once


# Bands of equal width up to so many widths from 0; further out they grow with the value, so many to a doubling.
LINEAR_BANDS = 1 << 16
BANDS_PER_DOUBLING = 1 << 12


def value_band(widths: Column) -> Column:
    """Monotone band number of a value given in band widths; outliers add few bands, however far they lie."""
    far = F.abs(widths)
    out = F.lit(LINEAR_BANDS) + F.floor((F.log2(far) - LINEAR_BANDS.bit_length() + 1) * BANDS_PER_DOUBLING)
    return F.when(far < LINEAR_BANDS, F.floor(widths)).when(widths > 0, out).otherwise(-out - 1)


def running_total(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, out: str) -> DataFrame:
    """Add the running total of ``amount`` per key in the given order, the row itself included.

    Rows are cut into ranges of the whole order, totalled inside their range and shifted by the
    ranges before it (one row per key and range), so neither a key nor a prefix has to fit one
    task.  The ranges are written once, as they are read twice.
    """
    cut = written_once(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    part = [*keys, "_range"]
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*part).agg(F.sum(amount).alias("_s")).select(
        *part, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_inside", F.sum(amount).over(inside)).join(offsets, part).withColumn(
        out, F.col("_inside") + F.col("_before")).select(*rows.columns, out)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    *,
    width: float | Column = 1 / 64,
) -> DataFrame:
    """Exact linear-interpolation percentiles per key, for values of any number.

    The built-in ``percentile`` gathers every distinct value of a group in one task.
    Here a histogram of value bands, counted map-side, tells in which band each wanted
    rank lies; then only rows of those bands are shuffled, counted by value and sorted,
    each band on its own.  Keys must not be null.
    """
    w = F.lit(width) if isinstance(width, (int, float)) else width
    v = F.col(value).cast("double")
    rows = df.filter(F.col(value).isNotNull()).select(
        *keys, v.alias("_value"), value_band(v / w).alias("_band"))
    part = [*keys, "_band"]

    per_key = Window.partitionBy(*keys)
    hist = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_size")).withColumns({
        "_upto": F.sum("_size").over(per_key.orderBy("_band")),
        "_total": F.sum("_size").over(per_key),
    })
    before = F.col("_upto") - F.col("_size")
    wanted = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("low", F.floor(pos)), ("high", F.ceil(pos))):
            wanted.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"),
                                   (rank - before).alias("rank"), (pos - F.floor(pos)).alias("frac")))
    here = F.filter(F.array(*wanted), lambda t: (t["rank"] >= 0) & (t["rank"] < F.col("_size")))
    targets = hist.select(*part, here.alias("_targets")).filter(F.size("_targets") > 0)

    counts = (
        rows.join(targets.select(*part), part, "left_semi")
        .groupBy(*part, "_value").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_until", F.sum("_n").over(Window.partitionBy(*part).orderBy("_value")))
    )
    hits = counts.join(targets, part).select(
        *keys, "_value",
        F.explode(F.filter("_targets", lambda t: (t["rank"] < F.col("_until"))
                           & (t["rank"] >= F.col("_until") - F.col("_n")))).alias("_t"))

    outs = []
    for name in probs:
        def pick(side: str, what: Column, name: str = name) -> Column:
            return F.max(F.when((F.col("_t.name") == name) & (F.col("_t.side") == side), what))

        low, high = pick("low", F.col("_value")), pick("high", F.col("_value"))
        outs.append((low + (high - low) * pick("low", F.col("_t.frac"))).alias(name))
    return hits.groupBy(*keys).agg(*outs)


def describe_by(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                *, width: float | Column = 1 / 64) -> DataFrame:
    """n, mean, std, min, max and exact percentiles per key."""
    base = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return base.join(exact_percentiles(df, keys, value, probs, width=width), list(keys))


def average_rank(partition: Sequence[str], value: str) -> Column:
    """Rank with ties at their mean, as Spearman's coefficient needs."""
    ordered = Window.partitionBy(*partition).orderBy(value)
    peers = Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(peers) - 1) / F.lit(2.0)

"""Outliers and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once
from busloom.functions.stats import running_total
from busloom.operators.eda import VALUE, operating
from busloom.operators.series import SERIES

# Fence width, z limit, rows a context needs, pairs a correlation needs.
IQR_FACTOR = 1.5
Z_LIMIT = 3
MIN_CONTEXT = 8
MIN_PAIRS = 10


def series_outliers(series: DataFrame, value: str = VALUE) -> DataFrame:
    """Slots outside the series' IQR fence or far from their day type's mean.

    Fixed values of ``method``: IQR / zscore / ambos.
    """
    v = F.col(value)
    rows = operating(series).filter(v.isNotNull())
    fence = rows.groupBy(*SERIES).agg(F.percentile(v, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    fence = fence.select(*SERIES, (q1 - IQR_FACTOR * (q3 - q1)).alias("fence_low"), (q3 + IQR_FACTOR * (q3 - q1)).alias("fence_high"))
    spread = rows.groupBy(*SERIES, "day_type").agg(F.avg(v).alias("_mean"), F.stddev_samp(v).alias("_std"))
    z = F.when(F.col("_std") > 0, (v - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    iqr, far = F.col("is_iqr"), F.col("is_z")
    marked = (
        rows.join(fence, list(SERIES)).join(spread, [*SERIES, "day_type"])
        .withColumn("zscore", z)
        .withColumns({"is_iqr": (v < F.col("fence_low")) | (v > F.col("fence_high")), "is_z": F.abs("zscore") > Z_LIMIT})
        .withColumn("method", F.when(iqr & far, "ambos").when(iqr, "IQR").when(far, "zscore").otherwise(""))
        .withColumn("outlier_pct", 100 * F.avg((iqr | far).cast("int")).over(Window.partitionBy(*SERIES)))
    )
    return marked.filter(iqr | far).drop("_mean", "_std")


def contextual_outliers(series: DataFrame, value: str = VALUE, factor: float = IQR_FACTOR) -> DataFrame:
    """Every slot scored against its weekday-hour context.

    Fixed values of ``outlier_type``: alto / bajo / empty.
    """
    v = F.col(value)
    keys = [*SERIES, "weekday", "hour"]
    context = series.groupBy(*keys).agg(
        F.count(v).alias("context_n"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    context = context.select(
        *keys, "context_n", F.col("_q")[1].alias("context_median"), (q3 - q1).alias("context_iqr"),
        F.greatest(q1 - factor * (q3 - q1), F.lit(0.0)).alias("low_limit"), (q3 + factor * (q3 - q1)).alias("high_limit"))
    usable = (F.col("context_n") >= MIN_CONTEXT) & (F.col("context_iqr") > 0) & v.isNotNull()
    kind = F.when(usable & (v > F.col("high_limit")), "alto").when(usable & (v < F.col("low_limit")), "bajo").otherwise("")
    return series.join(context, keys).withColumns({
        "outlier_type": kind,
        "deviation": v - F.col("context_median"),
        "median_ratio": F.when(F.col("context_median") != 0, v / F.col("context_median")),
    })


def _ranked(counts: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of each (feature, value): counts before it plus half its own."""
    values = counts.groupBy("feature", value).agg(F.sum("_n").alias("_n"))
    return running_total(values, ["feature"], [value], "_n", "_upto").select(
        "feature", value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))


def text_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace texts by their place in sorted order, missing ones by -1."""
    out = df
    for c in columns:
        known = df.filter(F.col(c).isNotNull()).select(c).distinct().withColumn("_one", F.lit(1))
        codes = running_total(known, [], [c], "_one", "_upto").select(c, (F.col("_upto") - 1).alias(f"_{c}"))
        out = out.join(codes, c, "left").withColumn(c, F.coalesce(F.col(f"_{c}"), F.lit(-1))).drop(f"_{c}")
    return out


def spearman_by_feature(df: DataFrame, target: str, features: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """Rank correlation of each feature with the target, strongest first.

    Pairs with a missing side are left out per feature.  Rows are first counted per
    (feature, value, target); ranks and sums work on these counts.
    """
    coded = text_codes(df, texts) if texts else df
    pairs = coded.filter(F.col(target).isNotNull()).select(
        F.col(target).cast("double").alias("y"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in (*features, *texts)])),
    ).filter(F.col("x").isNotNull())
    counts = written_once(pairs.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("_n")), "counts")
    n, rx, ry = F.col("_n"), F.col("rx"), F.col("ry")
    ranked = counts.join(_ranked(counts, "x", "rx"), ["feature", "x"]).join(_ranked(counts, "y", "ry"), ["feature", "y"])
    total = F.sum(n)
    mean = (total + 1) / 2
    sizes = counts.groupBy("feature").agg(total.alias("n"), mean.alias("_m"))
    dx, dy = rx - F.col("_m"), ry - F.col("_m")
    rho = ranked.join(sizes, "feature").groupBy("feature", "n").agg(
        (F.sum(n * dx * dy) / F.sqrt(F.sum(n * dx * dx)) / F.sqrt(F.sum(n * dy * dy))).alias("spearman"))
    order = Window.partitionBy().orderBy(F.col("abs_spearman").desc(), "feature")
    return (rho.filter((F.col("n") >= MIN_PAIRS) & F.col("spearman").isNotNull() & ~F.isnan("spearman"))
            .withColumn("abs_spearman", F.abs("spearman"))
            .withColumn("place", F.row_number().over(order)))

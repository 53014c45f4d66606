"""Stage diagnostics and operating KPIs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busloom.functions.columns import count_if, percent
from busloom.functions.stats import exact_percentiles
from busloom.operators.normalize import boardings_column
from busloom.operators.quality import ROLLUPS, flag_summary

# Stages in order with their report names; label of a missing end type.
STAGES = {"raw": "raw", "qc": "quality_checked", "end": "trip_end_resolved", "model_ready": "model_ready"}
NO_VALUE = "SIN_VALOR"


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def stage_overview(spark: SparkSession, stages: Mapping[str, DataFrame | None]) -> DataFrame:
    frames = []
    for name, label in STAGES.items():
        df = stages.get(name)
        source = df if df is not None else spark.range(0)
        frames.append(source.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(label).alias("stage"), F.lit(df is not None).alias("available"),
            "n_rows", F.lit(len(df.columns) if df is not None else 0).alias("n_columns")))
    return union_all(frames)


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def retention(raw: DataFrame, final: DataFrame) -> DataFrame:
    n, m = F.col("raw_rows"), F.col("final_rows")
    return (
        raw.agg(F.count(F.lit(1)).alias("raw_rows"))
        .withColumn("final_rows", _row_count(final))
        .select("raw_rows", "final_rows",
                F.when(n > 0, n - m).alias("rows_difference"), percent(m, n).alias("retention_pct"))
    )


def missing_counts(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    """Missing count and share per column; null for columns the table does not have."""
    have = [c for c in columns if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[count_if(F.col(c).isNull()).alias(c) for c in have])
    cells = [
        F.struct(F.lit(c).alias("column_name"),
                 (F.col(c) if c in have else F.lit(None).cast("long")).alias("n"))
        for c in columns
    ]
    return row.select("_rows", F.inline(F.array(*cells))).select(
        "column_name", F.col("n").alias(f"{prefix}_missing"),
        F.when(F.col("n").isNotNull(), F.coalesce(percent(F.col("n"), F.col("_rows")), F.lit(0.0)))
        .alias(f"{prefix}_missing_pct"))


def missing_before_after(raw: DataFrame, final: DataFrame, columns: Sequence[str]) -> DataFrame:
    return missing_counts(raw, columns, "raw").join(
        missing_counts(final, columns, "final"), "column_name", "full")


def share_by_value(df: DataFrame, column: str, label_null: str | None = None) -> DataFrame:
    """Count and share of each value of an enumeration column."""
    c = F.coalesce(F.col(column).cast("string"), F.lit(label_null)) if label_null else F.col(column)
    counts = df.groupBy(c.alias(column)).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.withColumn("pct", percent(F.col("n"), total))


def trip_end_distribution(df: DataFrame) -> DataFrame:
    return share_by_value(df, "end_type", NO_VALUE)


def _long(row: DataFrame, items: Sequence[tuple[str, Column, str]]) -> DataFrame:
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(kpi).alias("kpi"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))
        for kpi, value, unit in items])))


def operational_kpis(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Long table (kpi, value, unit): one aggregate per stage."""
    raw, qc, end, ready = (stages[s] for s in STAGES)
    c = F.col
    # KPI names of the report.
    parts = [_long(raw.agg(F.count(F.lit(1)).alias("n")), [("despachos_raw", c("n"), "rows")])]
    flags = [f for f in ROLLUPS if f in qc.columns]
    flag_row = qc.agg(F.count(F.lit(1)).alias("n"), *[count_if(c(f)).alias(f) for f in flags])
    parts.append(_long(flag_row, [("despachos_qc", c("n"), "rows"), *(
        item for f in flags
        for item in ((f, c(f), "rows"), (f"{f}_pct", percent(c(f), c("n")), "pct")))]))
    ended = [F.count(F.lit(1)).alias("n")]
    end_items = [("despachos_end", c("n"), "rows")]
    if "is_complete" in end.columns:
        ended.append(F.sum("is_complete").alias("k"))
        end_items += [("recorridos_completos", c("k"), "rows"),
                      ("recorridos_completos_pct", percent(c("k"), c("n")), "pct")]
    parts.append(_long(end.agg(*ended), end_items))
    final = [F.count(F.lit(1)).alias("n"), F.avg("duration_min").alias("d")]
    final_items = [("despachos_model_ready", c("n"), "rows"),
                   ("retencion_model_ready_pct", percent(c("n"), _row_count(raw)), "pct"),
                   ("duracion_promedio_min", c("d"), "minutes")]
    pax = boardings_column(ready)
    if pax:
        final += [F.sum(pax).alias("s"), F.avg(pax).alias("a")]
        final_items += [("pasajeros_total", c("s"), "passengers"), ("pasajeros_promedio", c("a"), "passengers")]
    parts.append(_long(ready.agg(*final), final_items))
    p95 = exact_percentiles(ready.withColumn("_all", F.lit(1)), ["_all"], "duration_min", {"p95": 0.95})
    parts.append(_long(p95, [("duracion_p95_min", c("p95"), "minutes")]))
    return union_all(parts)


def demand_by_route(df: DataFrame, route: str = "route_id") -> DataFrame:
    pax = boardings_column(df)
    return df.groupBy(route).agg(
        F.count(F.lit(1)).alias("trips"),
        F.coalesce(F.sum(pax), F.lit(0)).alias("passengers_sum"), F.avg(pax).alias("passengers_mean"))


def demand_by_weekday_hour(df: DataFrame, ts: str = "actual_start") -> DataFrame:
    pax = boardings_column(df)
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("hour"))
        .agg(F.count(F.lit(1)).alias("trips"), F.coalesce(F.sum(pax), F.lit(0)).alias("passengers_sum"))
    )


def duration_by_route(df: DataFrame, route: str = "route_id", value: str = "duration_min") -> DataFrame:
    """Count, mean, median and p95 per route; trips without a route make their own row."""
    probs = {"median": 0.5, "p95": 0.95}
    size = [F.count(value).alias("n"), F.avg(value).alias("mean")]
    known, rest = df.filter(F.col(route).isNotNull()), df.filter(F.col(route).isNull())
    by_route = known.groupBy(route).agg(*size).join(exact_percentiles(known, [route], value, probs), route, "left")
    found = exact_percentiles(rest.withColumn("_all", F.lit(1)), ["_all"], value, probs)
    nameless = (
        rest.agg(F.max(route).alias(route), *size, F.count(F.lit(1)).alias("_rows")).filter("_rows > 0")
        .withColumn("_p", found.select(F.struct(*probs).alias("p")).scalar())
        .select(route, "n", "mean", *[F.col("_p").getField(p).alias(p) for p in probs])
    )
    return by_route.unionByName(nameless)


def report_bundle(spark: SparkSession, stages: Mapping[str, DataFrame], columns: Sequence[str]) -> dict[str, DataFrame]:
    """All post-load report tables by name, lazily."""
    raw, qc, end, ready = (stages[s] for s in STAGES)
    tables = {
        "dataset_overview": stage_overview(spark, stages),
        "retention_summary": retention(raw, ready),
        "missing_before_after": missing_before_after(raw, ready, columns),
        "qc_flag_summary": flag_summary(qc),
        "operational_kpis": operational_kpis(stages),
        "demand_by_route": demand_by_route(ready),
        "demand_by_hour_weekday": demand_by_weekday_hour(ready),
        "duration_by_route": duration_by_route(ready),
    }
    if "end_type" in end.columns:
        tables["finalization_summary"] = trip_end_distribution(end)
    return tables


def share_within(counts: DataFrame, keys: Sequence[str], n: str = "n", out: str = "pct") -> DataFrame:
    """Share of a pre-aggregated count within its key (few rows per key)."""
    return counts.withColumn(out, percent(F.col(n), F.sum(n).over(Window.partitionBy(*keys))))

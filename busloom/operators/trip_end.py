"""Trip ends from the GPS pings after the start."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.columns import plus_minutes, require_columns, service_day, true_or_false
from busloom.functions.reuse import written_once
from busloom.functions.ordered import as_of, keep_first, with_running_counts
from busloom.sources.versions import DAY, manifest, publish_days, read_published

# End types and sources.
COMPLETE = "COMPLETO"
ABANDONED, RETURNING, UNDETERMINED = "TRUNCADO_ABANDONO", "TRUNCADO_RETORNO", "TRUNCADO_INDETERMINADO"
NO_GPS, NO_GPS_AFTER_START, NO_VEHICLE_OR_START = "SIN_GPS", "SIN_GPS_POST_INICIO", "SIN_PLACA_O_INICIO"
REAL, ESTIMATED, NO_INFO = "REAL", "GPS_ESTIMADA", "SIN_INFO"

END_COLUMNS = ("is_complete", "estimated_end", "end_type", "end_source")


@dataclass(frozen=True)
class EndRules:
    """Windows in minutes, speeds in km/h, weights and texts."""

    before_min: int = 20
    after_min: int = 180
    low_kmh: float = 3.0
    returning_kmh: float = 12.0
    tail_min: int = 15
    tail_pings: int = 10
    abandoned_share: float = 0.70
    use_power_off: bool = True
    power_off_weight: float = 0.35
    power_off_text: str = "Móvil Apagado"


# Speeds are looked up in blocks of so many.
SPEED_BLOCK = 64
_JUST_BEFORE = "INTERVAL '0.000001' SECOND"


def _classify(rules: EndRules) -> Column:
    """End type from tail counts ``_n``, ``_low``, ``_off`` and ``_fast`` (median test)."""
    score = F.col("_low") / F.col("_n")
    if rules.use_power_off:
        w = rules.power_off_weight
        score = F.when(F.col("_off"), F.least(F.lit(1.0), (1 - w) * score + w)).otherwise(score)
    return (
        F.when(F.coalesce("_n", F.lit(0)) == 0, UNDETERMINED)
        .when(score >= rules.abandoned_share, ABANDONED)
        .when(F.col("_fast"), RETURNING)
        .otherwise(UNDETERMINED)
    )


def ends_for_starts(starts: DataFrame, pings: DataFrame, rules: EndRules = EndRules()) -> DataFrame:
    """End and type for each distinct (vehicle, start).

    All tail statistics come from running counts looked up at both ends of the tail, so
    the work is one sorted pass per (vehicle, hour) and no trip-ping pairs are made: a
    vehicle holding a third of all pings costs no more than its share of rows.  The
    counted pings and the tails are written once, as several branches read them.  Two
    small exceptions join by exact key or on a narrow subset:

    * a tail without speeds takes the last ten earlier ones, found by their number;
    * a median that falls between the two middle values of a tail split exactly in half
      by the limit needs those two values.
    """
    key = ["vehicle_id", "actual_start"]
    speed = F.col("speed_kmh")
    counted = written_once(with_running_counts(
        pings.filter(F.col("vehicle_id").isNotNull() & F.col("ping_ts").isNotNull())
        .select("vehicle_id", "ping_ts", "ping_id", "speed_kmh", "message"),
        ["vehicle_id"], "ping_ts", "ping_id",
        {
            "c_speed": speed.isNotNull(),
            "c_low": speed <= rules.low_kmh,
            "c_fast": speed >= rules.returning_kmh,
            "c_off": F.col("message").contains(rules.power_off_text),
        },
    ).drop("message"))
    sums = ("c_speed", "c_low", "c_fast", "c_off")
    starts = starts.select(*key).distinct()
    probes = starts.withColumn("_until", plus_minutes("actual_start", rules.after_min))
    last = as_of(probes, counted, ["vehicle_id"], "_until", "ping_ts",
                 {"_end": "ping_ts", **{f"_end_{c}": c for c in sums}}, tie="ping_id", monotone=True)
    start = F.col("actual_start")
    state = (
        F.when(F.col("_end").isNull() | (F.col("_end") < plus_minutes(start, -rules.before_min)), NO_GPS)
        .when(F.col("_end") < start, NO_GPS_AFTER_START)
    )
    last = last.withColumn("_state", state)
    # Silent starts are probed too, at the start itself, and dropped below.
    tails = last.withColumn("_state", state).withColumn(
        "_low_ts", F.when(F.col("_state").isNull(), F.greatest(start, plus_minutes("_end", -rules.tail_min)))
        .otherwise(start))
    tails = tails.withColumn("_probe", F.col("_low_ts") - F.expr(_JUST_BEFORE))
    tails = as_of(tails, counted, ["vehicle_id"], "_probe", "ping_ts",
                  {f"_pre_{c}": c for c in sums}, tie="ping_id", monotone=True)

    def inside(c: str) -> Column:
        return F.col(f"_end_{c}") - F.coalesce(F.col(f"_pre_{c}"), F.lit(0))

    tails = written_once(tails.select(
        *key, "_state", "_end", "_low_ts", F.col("_end_c_speed").alias("_last_no"),
        inside("c_speed").alias("_n"), inside("c_low").alias("_low"),
        inside("c_fast").alias("_above"), (inside("c_off") > 0).alias("_off")))
    silent = tails.filter("_state is not null").select(
        *key, F.lit(None).cast("timestamp_ntz").alias("estimated_end"), F.col("_state").alias("end_type"))
    tails = tails.filter("_state is null").drop("_state")
    half = (F.col("_above") * 2 == F.col("_n")) & (F.col("_n") > 0)
    plain = tails.filter((F.col("_n") > 0) & ~half).withColumn("_fast", F.col("_above") * 2 > F.col("_n"))

    split = tails.filter(half)
    decided = split.join(_middle_values(split.select("vehicle_id", "_low_ts", "_end", "_last_no", "_n").distinct(), counted, rules),
                         ["vehicle_id", "_low_ts", "_end"], "left")
    earlier = _last_numbered(tails.filter("_n = 0"), counted, rules)

    cols = [*key, "_end", "_n", "_low", "_off", "_fast"]
    judged = plain.select(*cols).unionByName(decided.select(*cols)).unionByName(earlier.select(*cols))
    return silent.unionByName(judged.select(
        *key, F.col("_end").alias("estimated_end"), _classify(rules).alias("end_type")))


def _middle_values(tails: DataFrame, counted: DataFrame, rules: EndRules) -> DataFrame:
    """Median test for tails with exactly half of the speeds at or above the limit.

    The two middle values are the largest speed below the limit and the smallest at or above
    it.  Speeds are numbered per vehicle, and a tail is a run of numbers: the end of one
    block of ``SPEED_BLOCK`` numbers, whole blocks, and the start of another.  Each of these
    is one look-up by (vehicle, number) or (vehicle, block); only a tail inside one block
    looks at its speeds, at most ``SPEED_BLOCK``.  So a busy vehicle makes no pairs.
    """
    key, limit, v = ["vehicle_id", "_low_ts", "_end"], rules.returning_kmh, F.col("speed_kmh")
    block = F.floor((F.col("c_speed") - 1) / SPEED_BLOCK)
    speeds = counted.filter(v.isNotNull()).select(
        "vehicle_id", "c_speed", block.alias("_block"), F.when(v < limit, v).alias("_below"), F.when(v >= limit, v).alias("_over"))
    inside = Window.partitionBy("vehicle_id", "_block").orderBy("c_speed")
    upto, onward = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    running = speeds.withColumns({
        f"_{value}_{side}": extreme(f"_{value}").over(w)
        for side, w in (("from", onward), ("upto", upto)) for value, extreme in (("below", F.max), ("over", F.min))})
    edges = running.select("vehicle_id", "c_speed", F.inline(F.array(*[
        F.struct(F.lit(side).alias("_side"), F.col(f"_below_{side}").alias("_below"), F.col(f"_over_{side}").alias("_over"))
        for side in ("from", "upto")])))
    whole = speeds.groupBy("vehicle_id", "_block").agg(F.max("_below").alias("_below"), F.min("_over").alias("_over"))

    first, last = F.col("_last_no") - F.col("_n") + 1, F.col("_last_no")
    runs = tails.select(*key, first.alias("_first"), last.alias("_last"))
    runs = runs.withColumns({"_b1": F.floor((F.col("_first") - 1) / SPEED_BLOCK), "_b2": F.floor((F.col("_last") - 1) / SPEED_BLOCK)})
    short = runs.filter("_b1 = _b2").select(*key, F.explode(F.sequence("_first", "_last")).alias("c_speed"))
    ends = runs.filter("_b1 < _b2").select(*key, F.inline(F.array(
        F.struct(F.col("_first").alias("c_speed"), F.lit("from").alias("_side")),
        F.struct(F.col("_last").alias("c_speed"), F.lit("upto").alias("_side")))))
    between = runs.filter("_b1 + 1 < _b2").select(*key, F.explode(F.sequence(F.col("_b1") + 1, F.col("_b2") - 1)).alias("_block"))
    values = [*key, "_below", "_over"]
    found = short.join(speeds, ["vehicle_id", "c_speed"]).select(*values).unionByName(
        ends.join(edges, ["vehicle_id", "c_speed", "_side"]).select(*values)).unionByName(
        between.join(whole, ["vehicle_id", "_block"]).select(*values))
    return found.groupBy(*key).agg(((F.max("_below") + F.min("_over")) / 2 >= limit).alias("_fast"))


def _last_numbered(tails: DataFrame, counted: DataFrame, rules: EndRules) -> DataFrame:
    """Statistics of the last ten speeds since the start, joined by their running number."""
    numbers = F.sequence(F.greatest(F.lit(1), F.col("_last_no") - rules.tail_pings + 1), F.col("_last_no"))
    wanted = tails.filter("_last_no > 0").select(
        "vehicle_id", "actual_start", F.explode(numbers).alias("c_speed"))
    speeds = counted.filter("speed_kmh is not null").select("vehicle_id", "c_speed", "ping_ts", "speed_kmh")
    v = F.col("speed_kmh")
    stats = (
        wanted.join(speeds, ["vehicle_id", "c_speed"])
        .filter(F.col("ping_ts") >= F.col("actual_start"))
        .groupBy("vehicle_id", "actual_start")
        .agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(v <= rules.low_kmh, 1)).alias("_low"),
             (F.median(v) >= rules.returning_kmh).alias("_fast"))
    )
    return tails.drop("_n", "_low").join(stats, ["vehicle_id", "actual_start"], "left")


def resolve_trip_ends(trips: DataFrame, pings: DataFrame, rules: EndRules = EndRules(),
                      key: str = "trip_id") -> DataFrame:
    """One row per trip: estimated end, its type and source."""
    require_columns(trips, [key, "vehicle_id", "actual_start"])
    one = keep_first(trips.select(key, "vehicle_id", "actual_start").withColumn("_o", F.lit(0)),
                     [key], ["vehicle_id", "actual_start", "_o"]).drop("_o")
    usable = true_or_false((F.trim("vehicle_id") != "") & F.col("actual_start").isNotNull())
    known = one.filter(usable)
    ends = known.join(ends_for_starts(known, pings, rules), ["vehicle_id", "actual_start"], "left")
    unknown = one.filter(~usable).select(
        key, F.lit(None).cast("timestamp_ntz").alias("estimated_end"), F.lit(NO_VEHICLE_OR_START).alias("end_type"))
    both = ends.select(key, "estimated_end", "end_type").unionByName(unknown)
    return both.select(
        key, F.lit(0).alias("is_complete"), "estimated_end", "end_type",
        F.when(F.col("estimated_end").isNotNull(), ESTIMATED).otherwise(NO_INFO).alias("end_source"))


def with_end_columns(df: DataFrame) -> DataFrame:
    types = {"is_complete": "int", "estimated_end": "timestamp_ntz", "end_type": "string", "end_source": "string"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def real_end_wins(df: DataFrame) -> DataFrame:
    real = F.col("actual_end").isNotNull()
    return df.withColumns({
        "is_complete": F.when(real, 1).otherwise(F.col("is_complete")),
        "estimated_end": F.when(real, F.col("actual_end")).otherwise(F.col("estimated_end")),
        "end_type": F.when(real, COMPLETE).otherwise(F.col("end_type")),
        "end_source": F.when(real, REAL).otherwise(F.col("end_source")),
    })


def merge_ends(base: DataFrame, updates: DataFrame, key: str = "trip_id") -> DataFrame:
    """Updates fill nulls only; a real end always wins.

    Updates are one row per key, so the join never multiplies rows.
    """
    order = [c for c in END_COLUMNS if c in updates.columns]
    once = keep_first(updates.select(key, *order), [key], order)
    renamed = once.withColumnsRenamed({c: f"_new_{c}" for c in order})
    merged = with_end_columns(base).join(renamed, key, "left")
    merged = merged.withColumns({c: F.coalesce(F.col(c), F.col(f"_new_{c}")) for c in order})
    return real_end_wins(merged.drop(*[f"_new_{c}" for c in order]))


def resume_trip_ends(trips: DataFrame, pings: DataFrame, previous: DataFrame | None = None, *,
                     recompute: bool = False, rules: EndRules = EndRules(), key: str = "trip_id") -> DataFrame:
    """Keep earlier estimates and work out only the trips that have none yet."""
    base = with_end_columns(trips)
    base = merge_ends(base, previous, key) if previous is not None else real_end_wins(base)
    base = base.withColumn("is_complete", F.coalesce("is_complete", F.lit(0)))
    open_trip = F.col("actual_end").isNull() & F.col("actual_start").isNotNull()
    if not recompute:
        open_trip = open_trip & (F.col("estimated_end").isNull() | F.col("end_type").isNull())
    pending = base.filter(open_trip)
    return merge_ends(base, resolve_trip_ends(pending, pings, rules, key), key)


# The day of trips without a start; no ping is looked up for them.
NO_START_DAY = "1900-01-01"


def publish_trip_ends(trips: DataFrame, pings: DataFrame, folder: str, *, run: str, days_per_batch: int = 7,
                      recompute: bool = False, rules: EndRules = EndRules(), key: str = "trip_id") -> Iterator[Sequence[str]]:
    """Work out trip ends a batch of service days at a time; the days of each batch, once it is published.

    ``folder`` is a published table, one row per trip with its key, end columns and service day.  ``run`` names the
    state of the input: days that this run has published already are left out, so a run that died goes on where
    it stopped, and readers see whole batches.  Estimates of earlier runs are kept unless ``recompute``.
    A batch reads its own days' trips and estimates, and the pings within the rules' reach of them; the loop is over calendar
    days, not over rows.  A trip without a key is left out, as in ``resume_trip_ends`` it could not be found again.
    """
    spark = trips.sparkSession
    day = F.coalesce(service_day("actual_start"), F.lit(NO_START_DAY).cast("date"))
    dated = trips.filter(F.col(key).isNotNull()).withColumn(DAY, day)
    every = [str(r[0]) for r in dated.select(DAY).distinct().orderBy(DAY).collect()]
    while True:
        done = manifest(spark, folder)
        left = [d for d in every if done["notes"].get(d) != run]
        if not left:
            return
        batch = left[:days_per_batch]
        own = dated.filter(F.col(DAY).isin([F.lit(d).cast("date") for d in batch]))
        first, last = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in (batch[0], batch[-1]))
        reach = pings.filter((F.col("ping_ts") >= plus_minutes(first, -rules.before_min)) & (F.col("ping_ts") < plus_minutes(last, 2 * 1440 + rules.after_min)))
        earlier = read_published(spark, folder, batch)
        ends = resume_trip_ends(own, reach, earlier if earlier is None else earlier.select(key, *END_COLUMNS), recompute=recompute, rules=rules, key=key)
        publish_days(ends.select(key, *END_COLUMNS, DAY), folder, batch, dict.fromkeys(batch, run))
        yield batch

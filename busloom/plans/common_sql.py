"""Named SQL blocks the query twins are built from."""

from __future__ import annotations

import re

from busloom.functions.calendar import holidays
from busloom.sources.tables import YARDS

# The years of the benchmark tables, for the twins' list of holidays; the operators need no range.
CALENDAR_YEARS = (1992, 2026)

_BLOCKS: dict[str, str] = {}
_kept: set[str] = set()


def block(name: str, body: str, kept: bool = False) -> None:
    """``kept``: worked out once for all who read it, which a long chain of blocks needs."""
    _BLOCKS[name] = body
    if kept:
        _kept.add(name)


def clone(prefix: str, names: list[str], **replaced: str) -> None:
    """Copies of blocks under new names, reading each other and ``replaced`` blocks instead of the originals."""
    new = {n: f"{prefix}{n}" for n in names} | replaced
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, new)) + r")\b")
    for n in names:
        block(new[n], pattern.sub(lambda m: new[m[1]], _BLOCKS[n]))


def sql(body: str) -> str:
    """``body`` with every named block it uses, directly or not, put in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name, definition in _BLOCKS.items():
            if name in words and name not in needed and definition is not text:
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    blocks = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in _kept else ''}({_BLOCKS[n]})" for n in needed)
    return f"WITH {blocks}\n{body}"


def minutes(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 60000000.0)"


def values_list(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def day_type_sql(ts: str) -> str:
    days = ", ".join(f"DATE '{d}'" for d in holidays(*CALENDAR_YEARS))
    holiday = f"(CAST({ts} AS DATE) IN ({days}))"
    return (f"CASE WHEN {holiday} AND isodow({ts}) = 1 THEN 'FESTIVO_PUENTE' "
            f"WHEN {holiday} THEN 'FESTIVO' WHEN isodow({ts}) = 6 THEN 'SABADO' "
            f"WHEN isodow({ts}) = 7 THEN 'DOMINGO' ELSE 'LABORAL' END")


block("trips_v", """
  SELECT event_id AS trip_id, 'V' || CAST(user_id // 8 AS VARCHAR) AS vehicle_id,
    event_type AS route_id, ts - to_minutes(event_id % 20) AS planned_start,
    CASE WHEN event_id % 11 <> 0 THEN ts END AS actual_start,
    CASE WHEN event_id % 7 <> 0 THEN ts + to_minutes(20 + event_id * 37 % 160) END AS actual_end,
    CAST(floor(value) AS BIGINT) AS boardings_raw, event_id % 3 AS door_alarms,
    greatest(CAST(floor(value) AS BIGINT) - event_id % 3, 0) AS boardings,
    value * 10 AS distance, event_id % 5 AS trip_status
  FROM events""")

block("raw_trips_v", """
  SELECT CASE WHEN event_id % 211 = 0 THEN NULL WHEN event_id % 50 = 0 THEN event_id + 1 ELSE event_id END AS trip_id,
    CASE WHEN event_id % 101 = 0 THEN ' ' WHEN event_id % 103 = 0 THEN 'None' WHEN event_id % 107 = 0 THEN NULL
      ELSE 'V' || CAST(user_id // 8 AS VARCHAR) END AS vehicle_id,
    CASE WHEN event_id % 109 <> 0 THEN event_type END AS route_id, event_id AS row_id,
    CASE WHEN event_id % 11 <> 0 THEN ts END AS actual_start,
    CASE WHEN event_id % 83 = 0 THEN ts - to_minutes(5)
      WHEN event_id % 7 <> 0 THEN ts + to_minutes(20 + event_id * 37 % 160) END AS actual_end,
    CASE WHEN event_id % 89 = 0 THEN -1 WHEN event_id % 97 <> 0 THEN CAST(floor(value) AS BIGINT) END AS boardings_raw,
    event_id % 3 AS door_alarms,
    CASE WHEN event_id % 113 = 0 THEN -5.0 ELSE value * 10 END AS distance,
    fmod(value, 70) AS frequency_min, event_id % 5 AS trip_status
  FROM events""")

block("pings_v", """
  SELECT event_id AS ping_id, 'V' || CAST(user_id // 8 AS VARCHAR) AS vehicle_id,
    ts + to_minutes(event_id * 13 % 240 - 60) AS ping_ts,
    CASE WHEN event_id % 13 <> 0 THEN fmod(value, 60) END AS speed_kmh,
    'at ' || event_type AS message,
    CASE WHEN event_id % 53 = 0 THEN ' 91,0' ELSE replace(printf('%.4f', 3.45 + (event_id % 100) / 5000.0::DOUBLE), '.', ',') END AS lat,
    CASE WHEN event_id % 59 = 0 THEN 'x' ELSE '-76,5300' END AS lon
  FROM events""")

_yard_rows = ", ".join(
    f"('{r}', '{y.name}', {y.lat}::DOUBLE, {y.lon}::DOUBLE)" for y in YARDS for r in y.routes)
block("yards_v", f"SELECT * FROM (VALUES {_yard_rows}) AS y(route_id, yard, yard_lat, yard_lon)")

# Model-ready trips: both ends known, duration 5 to 480 minutes.
block("ready_v", f"""
  SELECT * FROM (SELECT trip_id, vehicle_id, route_id, actual_start, actual_end AS final_end,
    {minutes('actual_start', 'actual_end')} AS duration_min, boardings_raw, boardings, door_alarms, distance,
    hour(actual_start) AS start_hour, isodow(actual_start) - 1 AS weekday,
    CAST(actual_start AS DATE) AS service_date
  FROM trips_v WHERE actual_start IS NOT NULL AND actual_end IS NOT NULL)
  WHERE duration_min BETWEEN 5 AND 480""")

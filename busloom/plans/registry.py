"""Named queries with a declared output, and their SQL twins.

The output spec is a string of ``name:kind`` pairs.  Kinds: s text, i whole number,
f number rounded to 6 places, b boolean, d date, t timestamp.  Dates and timestamps
leave as text, so that both engines hand out the same values.  Numbers get a tiny
offset before rounding: a value on a rounding tie, up to the float noise of its sum
order, then rounds the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND_TO = 6
TIE_OFFSET = 1e-8


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        c = c.cast("long")
    elif kind == "f":
        c = F.round(c.cast("double") + F.lit(TIE_OFFSET), ROUND_TO) + F.lit(0.0)
    elif kind == "d":
        c = c.cast("date").cast("string")
    elif kind == "t":
        c = F.substring(c.cast("timestamp_ntz").cast("string"), 1, 19)
    elif kind == "s":
        c = c.cast("string")
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    c = f'q."{name}"'
    body = {
        "i": f"CAST({c} AS BIGINT)",
        "f": f"ROUND(CAST({c} AS DOUBLE) + {TIE_OFFSET:.8f}, {ROUND_TO}) + 0.0",
        "d": f"strftime(CAST({c} AS DATE), '%Y-%m-%d')",
        "t": f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')",
        "s": f"CAST({c} AS VARCHAR)",
        "b": c,
    }[kind]
    return f'{body} AS "{name}"'


@dataclass(frozen=True)
class Query:
    name: str
    spec: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(spark, folder)
        return df.select(*[_spark_column(n, k) for n, k in _columns(self.spec)])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_sql_column(n, k) for n, k in _columns(self.spec))
        return f"SELECT {cols} FROM ({self.sql}) AS q"

"""Compare registered queries with their SQL twins.

Usage: python tests/compare.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def _sorted(rows, order):
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, query, folder: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = query.run(spark, folder)
    rows = df.collect()
    text = query.oracle()
    if text is None:
        return None
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {df.columns} / {names}"
    mine = _sorted(rows, [df.columns.index(n) for n in sorted(df.columns)])
    theirs = _sorted(expected, [names.index(n) for n in sorted(names)])
    if len(mine) != len(theirs):
        return f"row counts differ: {len(mine)} / {len(theirs)}; {mine[:2]} / {theirs[:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ; columns {sorted(names)}; first {bad[0][0]} / {bad[0][1]}"
    return None if mine else "no rows"


def main() -> None:
    from busloom.plans.catalog import all_queries
    from busloom.session import local_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = local_session(8)
    con = connect(folder)
    failed = 0
    begun = time.time()
    for name, q in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            problem = compare(spark, con, q, folder)
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t0:6.2f}s {name}"
              + ("" if q.sql else " (no SQL)") + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{failed} failed, {time.time() - begun:.0f} s")
    spark.stop()


if __name__ == "__main__":
    main()

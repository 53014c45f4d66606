"""Neighbour and as-of lookups against brute force, with a hot key and ties."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from busloom.functions.ordered import as_of, keep_last, with_neighbour, with_running_counts
from busloom.functions.stats import describe_by, exact_percentiles

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    # Key a holds most rows; times repeat, so that ties matter.
    return [("a" if rnd.random() < 0.7 else rnd.choice("bcd"), T0 + timedelta(minutes=rnd.randrange(0, 600) // 7 * 7), i)
            for i in range(400)]


def frame(spark, rows, names="k string, ts timestamp_ntz, id int"):
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("following", [False, True])
def test_neighbour(spark, rows, following):
    got = with_neighbour(frame(spark, rows), ["k"], "ts", "id", {"other": "id", "other_ts": "ts"}, following=following)
    expected = {}
    for k in "abcd":
        mine = sorted((t, i) for kk, t, i in rows if kk == k)
        for n, (t, i) in enumerate(mine):
            m = n + 1 if following else n - 1
            expected[i] = mine[m][1] if 0 <= m < len(mine) else None
    assert {r["id"]: r["other"] for r in got.collect()} == expected


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("monotone", [False, True])
def test_as_of(spark, rows, following, monotone):
    rnd = random.Random(3)
    probes = [(k, T0 + timedelta(minutes=rnd.randrange(-50, 700)), n) for n in range(150) for k in rnd.choice("abcde")]
    got = as_of(frame(spark, probes, "k string, at timestamp_ntz, n int"), frame(spark, rows), ["k"], "at", "ts",
                {"hit": "ts"}, following=following, monotone=monotone)
    for r in got.collect():
        times = [t for k, t, _ in rows if k == r["k"] and ((t >= r["at"]) if following else (t <= r["at"]))]
        assert r["hit"] == (min(times) if following else max(times)) if times else r["hit"] is None
    assert got.count() == len(probes)


def test_running_counts(spark, rows):
    got = with_running_counts(frame(spark, rows), ["k"], "ts", "id", {"even": F.col("id") % 2 == 0})
    for r in got.collect():
        assert r["even"] == sum(1 for k, t, i in rows if k == r["k"] and i % 2 == 0 and (t, i) <= (r["ts"], r["id"]))


def test_keep_last(spark):
    df = spark.createDataFrame([(1, 0, "old"), (1, 1, "new"), (2, 0, "only")], "key int, batch int, what string")
    assert {(r["key"], r["what"]) for r in keep_last(df, ["key"], ["batch"]).collect()} == {(1, "new"), (2, "only")}


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0, 9.0], [-3.5, 0.0, 0.001, 2.25, 1e6]])
def test_percentiles_small(spark, values):
    df = spark.createDataFrame([("x", v) for v in values], "k string, v double")
    r = exact_percentiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    assert np.allclose([r["p10"], r["p50"], r["p99"]], np.percentile(values, [10, 50, 99]))


def test_percentiles_of_skewed_groups(spark):
    rnd = np.random.default_rng(1)
    data = {"hot": np.where(rnd.random(3000) < 0.4, 7.0, rnd.normal(50, 20, 3000)), "cold": rnd.exponential(3, 40)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    for r in describe_by(df, ["k"], "v", {"p25": 0.25, "p95": 0.95}).collect():
        vs = data[r["k"]]
        assert np.allclose([r["p25"], r["p95"], r["mean"], r["std"]],
                           [*np.percentile(vs, [25, 95]), vs.mean(), vs.std(ddof=1)])

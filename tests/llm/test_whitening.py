"""Whitening against a plain singular value decomposition and exact whole-number sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from busloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, component int"


def rows_of(found):
    return sorted((r.asDict() for r in found.collect()), key=lambda r: (r["vec_id"], r["component"]))


def checked(spark, vectors, components=32):
    """Compares with numpy on the plain definition; returns the rows."""
    frame = spark.createDataFrame([(i, [float(x) for x in v], 7) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    found = rows_of(whitening.whitened_components(frame, components))
    x = np.floor(64 * np.array(vectors, float)).astype(int) + 1_000_000
    n, total = len(x), x.sum(0)
    centred = (n * x - total) / n
    _, spread, axes = np.linalg.svd(centred, full_matrices=False)  # of the rows: a covariance squares their condition
    values, axes = spread**2 / n, axes.T
    k = max((r["component"] for r in found), default=0)
    assert len(found) == n * k
    got = np.array([r["whitened"] for r in found]).reshape(n, k)
    expected = centred @ axes[:, :k] / np.sqrt(values[:k])
    sign = np.sign((got * expected).sum(0))
    assert np.allclose(got, expected * sign, atol=1e-7)
    assert np.abs(got.T @ got / n - np.eye(k)).max(initial=0) < 1e-9
    for r in found:
        assert r["n"] == n
        exact = sum(int(v) ** 2 for v in n * x[r["vec_id"]] - total)
        assert r["deviation"] == (exact if exact < 1 << 63 else None)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
    return k


def test_components_and_deviations(spark):
    random = np.random.default_rng(3)
    assert checked(spark, random.normal(size=(300, 40)) @ random.normal(size=(40, 40))) == 32


def test_far_apart_spreads_need_more_than_one_round(spark):
    random = np.random.default_rng(4)
    scales = 10.0 ** np.arange(0, 10, 2)
    assert checked(spark, random.normal(size=(200, 5)) * scales) == 5


def test_directions_that_are_not_there(spark):
    random = np.random.default_rng(5)
    base = np.round(random.normal(size=(60, 3)) * 64) / 64
    vectors = np.column_stack([base, base[:, 0] * 2, base[:, 1] + base[:, 2], np.full(60, 9.0)])
    assert checked(spark, vectors) == 3
    assert checked(spark, [[1.0, 2.0]] * 8) == 0
    assert checked(spark, [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]]) == 1


def test_odd_rows(spark):
    good = [(1, [0.1, 0.5]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (None, [0.9, -0.4]), (5, [1e17, 0.0])]
    bad = [(6, None), (7, []), (8, [1.0, None]), (9, [float("nan"), 1.0]), (10, [float("inf"), 1.0]), (11, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in good[:4] + bad], SCHEMA).withColumn("deviation", F.lit("x")).withColumn("whitened", F.lit(1))
    found = whitening.whitened_components(frame).collect()
    assert {r.n for r in found} == {4}
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in found if r.vec_id) == [
        (False, 1, 1), (False, 1, 2), (False, 2, 1), (False, 2, 1), (False, 2, 2), (False, 2, 2)]
    assert whitening.whitened_components(frame.where("vec_id > 100")).count() == 0
    huge = whitening.whitened_components(spark.createDataFrame([(i, v, 0) for i, v in good], SCHEMA))
    assert {r.n for r in huge.collect()} == {4}  # 1e17 is no 64-bit number once scaled


def test_deviations_beyond_64_bits_are_null(spark):
    frame = spark.createDataFrame([(1, [2.0**40, 1.0], 0), (2, [-(2.0**40), 2.0], 0), (3, [0.0, 2.0], 0)], SCHEMA)
    found = {(r.vec_id, r.component): r.deviation for r in whitening.whitened_components(frame).collect()}
    assert found[1, 1] is None and found[2, 1] is None and found[3, 1] == 64**2


def test_query(spark):
    found = queries.QUERIES["op11_cholesky_whitening"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    top = found.agg(F.max("identity_error"), F.max("component"), F.countDistinct("vec_id"), F.max("n")).first()
    assert top[0] < 1e-9 and top[1] == 32 and top[2] == top[3]

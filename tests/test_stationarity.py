"""The augmented Dickey-Fuller test against ordinary least squares on whole regression matrices."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from busloom.operators import eda, stationarity

START = datetime(2024, 1, 1)


def least_squares(y, lag, skip):
    """t of the level, residual sum, rows and regressors, over the rows that ``skip`` lags leave."""
    d = np.diff(y)
    t = np.arange(skip, len(d))
    x = np.column_stack([y[t], np.ones(len(t)), *[d[t - k] for k in range(1, lag + 1)]])
    beta = np.linalg.lstsq(x, d[t], rcond=None)[0]
    rest = float(((d[t] - x @ beta) ** 2).sum())
    se = math.sqrt(rest / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    return beta[0] / se, rest, len(t), x.shape[1]


def plain_test(y):
    y = y - y.mean()  # the constant takes it up; least squares by matrices loses digits otherwise
    n = len(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    tried = []
    for lag in range(most + 1):
        _, rest, rows, k = least_squares(y, lag, most)
        tried.append((rows * math.log(rest / rows) + 2 * k, lag))
    lag = min(tried)[1]
    return lag, least_squares(y, lag, lag)[0]


def series_of(spark, values):
    rows = [(name, 30, START + timedelta(minutes=30 * i), None if v is None else float(v), False) for name, y in values.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "route_id string, gran_min int, timestamp timestamp_ntz, passengers_sum double, is_gap boolean")


def examples():
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(size=400))
    ar = np.zeros(3000)
    for i in range(2, len(ar)):
        ar[i] = 40 + 0.5 * ar[i - 1] - 0.3 * ar[i - 2] + rng.normal()
    daily = 30 + 20 * np.sin(np.arange(1500) * 2 * np.pi / 24) + rng.poisson(9, 1500)
    return {"walk": walk, "ar": ar, "daily": daily, "short": rng.poisson(5, 51).astype(float), "far": 1e6 + rng.normal(size=130)}


@pytest.mark.parametrize("chunk", [64, 8192])
def test_equals_least_squares(spark, chunk):
    values = examples()
    rows = {r.route_id: r for r in stationarity.augmented_dickey_fuller(series_of(spark, values), "passengers_sum", chunk=chunk).collect()}
    assert set(rows) == set(values)
    for name, y in values.items():
        lag, statistic = plain_test(y)
        r = rows[name]
        assert (r.n, r.used_lag, r.n_used) == (len(y), lag, len(y) - lag - 1), name
        assert r.statistic == pytest.approx(statistic, rel=1e-7), name
    assert not rows["walk"].is_stationary and rows["ar"].is_stationary


def test_odd_series(spark):
    rng = np.random.default_rng(5)
    y = list(rng.poisson(7, 80).astype(float))
    holes = [v for pair in zip(y, [None] * len(y)) for v in pair]
    values = {"constant": [4.0] * 90, "too short": y[:49], "holes": holes, "all null": [None] * 70}
    rows = {r.route_id: r for r in stationarity.augmented_dickey_fuller(series_of(spark, values), "passengers_sum").collect()}
    assert set(rows) == {"constant", "holes"}
    assert rows["constant"].statistic is None and rows["constant"].p_value is None and rows["constant"].is_stationary is False
    lag, statistic = plain_test(np.array(y))
    assert rows["holes"].used_lag == lag and rows["holes"].statistic == pytest.approx(statistic, rel=1e-7)
    nothing = series_of(spark, {"one": [1.0]})
    assert stationarity.augmented_dickey_fuller(nothing, "passengers_sum").collect() == []


def test_p_values(spark):
    # Known quantiles of the test with a constant: 1 %, 5 % and 10 %.
    stats = spark.createDataFrame([(-3.43035,), (-2.86154,), (-2.56677,), (-30.0,), (3.0,), (None,)], "t double")
    p = [r[0] for r in stats.select(stationarity.surface_p_value(F.col("t"))).collect()]
    assert p[:3] == pytest.approx([0.01, 0.05, 0.10], abs=1e-3)
    assert p[3:] == [0.0, 1.0, None]
    x = [-7.5, -1.96, 0.0, 0.3, 5.0]
    cdf = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(stationarity.normal_cdf(F.col("x"))).collect()]
    assert cdf == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in x], abs=1e-14)


def test_autocorrelation_in_chunks(spark):
    values = examples()
    series = series_of(spark, values)
    whole = {(r.route_id, r.lag): r.acf for r in eda.autocorrelation(series).collect()}
    parts = {(r.route_id, r.lag): r.acf for r in eda.autocorrelation(series, chunk=50).collect()}
    assert parts == pytest.approx(whole, abs=1e-12)
    for name, y in values.items():
        d = y - y.mean()
        assert whole[name, 7] == pytest.approx((d[7:] * d[:-7]).sum() / (d * d).sum(), abs=1e-9)  # a mean of 1e6 has digits to about 1e-10

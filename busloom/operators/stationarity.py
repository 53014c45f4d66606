"""Lagged products of long series, and the augmented Dickey-Fuller test on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.operators.series import SERIES

# Rows of a series that one task holds, besides the halo of the longest lag.
CHUNK = 8192
# A regressor that the earlier ones explain but for this share counts as one of them.
COLLINEAR = 1e-10
SIGNIFICANCE = 0.05

# MacKinnon's response surface of the p-value, one variable and a constant: polynomials in the statistic below
# and above a border, and the statistics beyond which the p-value is 0 or 1.
SURFACE_BORDER = -1.61
SURFACE_BELOW = (2.1659, 1.4412, 0.038269)
SURFACE_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)
SURFACE_LEAST, SURFACE_MOST = -18.83, 2.74


def positioned(rows: DataFrame, value: str) -> DataFrame:
    """Rows without a null value, centred (``_x``), with their place ``_i`` in the series and its length ``n``.

    Rows are numbered within a month; what comes before a month, the length and the mean of a series follow from one small
    row per series and month, so that no task sorts a whole series.
    """
    month = [*SERIES, "_month"]
    known = rows.filter(F.col(value).isNotNull()).select(*SERIES, "timestamp", F.trunc("timestamp", "month").alias("_month"), F.col(value).cast("double").alias("_v"))
    whole = Window.partitionBy(*SERIES)
    earlier = whole.orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = known.groupBy(*month).agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s")).select(
        *month, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("n"),
        (F.sum("_s").over(whole) / F.sum("_c").over(whole)).alias("_mean"))
    place = F.row_number().over(Window.partitionBy(*month).orderBy("timestamp"))
    return known.withColumn("_no", place).join(months, month).select(
        *SERIES, "n", (F.col("_no") + F.col("_before")).alias("_i"), (F.col("_v") - F.col("_mean")).alias("_x"))


def lagged_products(placed: DataFrame, lags: int, chunk: int = CHUNK) -> DataFrame:
    """Per series: its length, ``total``, ``products`` (sums of x(t) x(t - k) for k from 0 to ``lags``) and the ``lags`` + 2 values at either end.

    A chunk of the series is a group; the last rows of the one before come along as its halo.
    """
    chunk = max(chunk, lags)
    own = F.floor((F.col("_i") - 1) / chunk)
    homes = F.when((F.col("_i") - 1) % chunk >= chunk - lags, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.withColumn("_own", own).withColumn("_dealt", F.explode(homes))
    ordered = Window.partitionBy(*SERIES, "_dealt").orderBy("_i")
    x = F.col("_x")
    near = dealt.select(*SERIES, "n", "_i", "_x", "_own", "_dealt", *[F.lag("_x", k).over(ordered).alias(f"_l{k}") for k in range(1, lags + 1)])
    products = [x * x, *[x * F.col(f"_l{k}") for k in range(1, lags + 1)]]

    def end(inside: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(inside, F.struct("_i", "_x")))), lambda pair: pair["_x"])

    return near.filter("_own = _dealt").groupBy(*SERIES, "n").agg(
        F.sum(x).alias("total"), F.array(*[F.coalesce(F.sum(p), F.lit(0.0)) for p in products]).alias("products"),
        end(F.col("_i") <= lags + 2).alias("head"), end(F.col("_i") > F.col("n") - lags - 2).alias("tail"))


def most_lags(n: Column) -> Column:
    """Largest lag that the test tries: 12 (n / 100)^(1/4), rounded up, as far as the series has rows for it."""
    return F.least(F.ceil(12 * F.pow(n / 100, F.lit(0.25))), F.floor(n / 2) - 2)


def augmented_dickey_fuller(series: DataFrame, value: str, min_points: int = 50, chunk: int = CHUNK) -> DataFrame:
    """Test for a unit root, with a constant; the number of lagged differences is that of least AIC.

    Every regression works on levels at lags 0 to m + 1, whose cross products follow from the lagged products of the whole
    series and its ends.  So the series is read once, in chunks; all regressions are folds over one small matrix per series:
    a Cholesky factor of it holds the residuals of all nested models, which share the rows that the longest lag leaves, and a
    second one, over the rows of the chosen lag, the statistic.

    Null values are left out, and series of fewer than ``min_points`` values have no row.  A constant series, or one that its
    own past explains wholly, has a null statistic and is not called stationary.  Lags that would be collinear are not tried.
    """
    placed = positioned(series, value).filter(F.col("n") >= min_points)
    longest = placed.select(F.max(most_lags(F.col("n")))).first()[0]
    if longest is None:
        longest = 0
    sums = lagged_products(placed, longest + 1, chunk).withColumn("_m", most_lags(F.col("n")).cast("int"))

    tried = _factored(sums, "_m", level_first=True)
    tried = tried.withColumn("_y", F.expr("_b[_m + 1][_m + 1]")).withColumn("_z", F.expr("_l[_m + 1]")).withColumn("used_lag", F.expr("""
        array_min(filter(transform(sequence(0, _m), p -> named_struct(
            'aic', (n - _m - 1) * ln((_y - aggregate(slice(_z, 1, p + 1), 0D, (s, z) -> s + z * z)) / (n - _m - 1)) + 2 * (p + 2), 'p', p)),
          a -> a.aic IS NOT NULL)).p"""))

    last = _factored(tried.select(*SERIES, "n", "total", "products", "head", "tail", "used_lag"), "used_lag", level_first=False)
    z = "slice(_l[used_lag + 1], 1, used_lag + 1)"
    last = last.withColumn("_rest", F.expr(f"_b[used_lag + 1][used_lag + 1] - aggregate({z}, 0D, (s, z) -> s + z * z)")).withColumn(
        "n_used", F.expr("n - used_lag - 1"))
    t = F.when(F.col("_rest") > 0, F.expr("_l[used_lag + 1][used_lag]") / F.sqrt(F.col("_rest") / F.expr("n_used - used_lag - 2")))
    found = last.select(*SERIES, "n", "used_lag", "n_used", t.alias("statistic"))
    p = found.withColumn("p_value", surface_p_value(F.col("statistic")))
    return p.withColumn("is_stationary", F.coalesce(F.col("p_value") < SIGNIFICANCE, F.lit(False)))


def _factored(sums: DataFrame, m: str, level_first: bool) -> DataFrame:
    """Cross products ``_b`` of the regression with ``m`` lags, the constant taken out, and their Cholesky factor ``_l``.

    The last variable is the change; before it come the level, and the lagged changes before or after that.
    Every column is used more than once by the next, so that Spark works it out before and not inside a loop.
    """
    def fold(df: DataFrame, **columns: str) -> DataFrame:
        for name, text in columns.items():
            df = df.withColumn(name, F.expr(text.replace("{m}", m)))
        return df

    level, changes = "array(named_struct('a', 1, 'b', 1, 'c', 0D))", "transform(slice(sequence(0, {m}), 2, {m}), k -> named_struct('a', k, 'b', k + 1, 'c', 1D))"
    order = f"{level}, {changes}" if level_first else f"{changes}, {level}"
    return fold(
        sums,
        # Lag 0 against lags 0 to m + 1 over t from m + 2 on, and the sums of each lag.
        _first="""transform(sequence(0, {m} + 1), j -> products[j] - aggregate(sequence(j + 1, {m} + 2), 0D, (s, t) ->
            IF(t > {m} + 1, s, s + head[t - 1] * head[t - 1 - j])))""",
        _sum="""aggregate(sequence(0, {m}), array(total - aggregate(slice(head, 1, {m} + 1), 0D, (s, x) -> s + x)), (a, i) ->
            array_append(a, a[i] + head[{m} - i] - tail[size(tail) - 1 - i]))""",
        # One lag more on both sides: a row enters at the start and one leaves at the end.
        _gram="""aggregate(sequence(0, {m}), array(_first), (g, i) -> array_append(g, transform(sequence(0, {m} + 1), j -> IF(j = 0, _first[i + 1],
            g[i][j - 1] + head[{m} - i] * head[{m} + 1 - j] - tail[size(tail) - 1 - i] * tail[size(tail) - j]))))""",
        _a="transform(_gram, (r, i) -> transform(r, (v, j) -> v - _sum[i] * _sum[j] / (n - {m} - 1)))",
        _of=f"concat({order}, array(named_struct('a', 0, 'b', 1, 'c', 1D)))",
        _b="""transform(_of, u -> transform(_of, v -> _a[u.a][v.a] - v.c * _a[u.a][v.b] - u.c * _a[u.b][v.a] + u.c * v.c * _a[u.b][v.b]))""",
        _l=f"""aggregate(sequence(0, {{m}} + 1), cast(array() AS array<array<double>>), (l, i) -> array_append(l,
            aggregate(sequence(0, i), cast(array() AS array<double>), (r, j) -> array_append(r, transform(array(
                _b[i][j] - aggregate(zip_with(r, slice(IF(j < i, l[j], r), 1, j), (p, q) -> p * q), 0D, (s, v) -> s + v)),
              d -> IF(j < i, d / l[j][j], IF(d > {COLLINEAR}D * _b[i][i], sqrt(d), NULL)))[0]))))""")


def surface_p_value(statistic: Column) -> Column:
    """Approximate p-value: the normal distribution at a polynomial in the statistic."""
    def polynomial(parts) -> Column:
        total = F.lit(0.0)
        for part in reversed(parts):
            total = total * statistic + part
        return total

    at = F.when(statistic <= SURFACE_BORDER, polynomial(SURFACE_BELOW)).otherwise(polynomial(SURFACE_ABOVE))
    return F.when(statistic > SURFACE_MOST, 1.0).when(statistic < SURFACE_LEAST, 0.0).when(statistic.isNotNull(), normal_cdf(at))


def normal_cdf(x: Column) -> Column:
    """Normal distribution by its series x + x^3/3 + x^5/15 ..., which needs no more than 200 terms between -8 and 8."""
    bounded = F.greatest(F.least(x, F.lit(8.0)), F.lit(-8.0))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.struct(bounded.alias("term"), bounded.alias("sum")), lambda s, k: F.transform(
        F.array(s["term"] * bounded * bounded / (2 * k + 1)), lambda term: F.struct(term.alias("term"), (s["sum"] + term).alias("sum")))[0])["sum"]
    return 0.5 + F.exp(-bounded * bounded / 2) / F.lit(2.5066282746310002) * series

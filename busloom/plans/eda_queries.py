"""Queries over profiles, seasonality, outliers and highlights."""

from __future__ import annotations

from pyspark.sql import functions as F

from busloom.functions.calendar import day_type, is_holiday
from busloom.functions.columns import floor_to_minutes
from busloom.operators import eda, outliers, stationarity
from busloom.operators.eda import WEEKDAY_NAMES
from busloom.plans.common_sql import block, day_type_sql, sql, values_list
from busloom.plans.registry import Query
from busloom.plans.series_queries import plain_series, ready, series_table
from busloom.plans.stages import staged
from busloom.sources.tables import long_trips

KEYS = "route_id:s gran_min:i "
FEATURES = ("duration_min", "distance", "door_alarms", "start_hour", "end_hour", "weekday", "day")
TEXTS = ("route_id", "vehicle_id")

_names = "[" + values_list(WEEKDAY_NAMES) + "]"

block("op_v", "SELECT * FROM cal_v WHERE NOT is_gap")
block("intraday_v", """
  SELECT route_id, gran_min, day_type, hour, avg(passengers_sum) AS mean, median(passengers_sum) AS median, quantile_cont(passengers_sum, 0.25) AS p25,
    quantile_cont(passengers_sum, 0.75) AS p75, quantile_cont(passengers_sum, 0.95) AS p95 FROM op_v GROUP BY 1, 2, 3, 4""")
block("peaks_v", """
  SELECT *, mean > quantile_cont(mean, 0.75) OVER w AS is_peak, mean < quantile_cont(mean, 0.25) OVER w AS is_valley
  FROM intraday_v WINDOW w AS (PARTITION BY route_id, gran_min, day_type)""")
block("weekly_prof_v", f"""
  SELECT route_id, gran_min, weekday, total, mean, CASE WHEN mean > 0 THEN sd / mean END AS cv, {_names}[weekday + 1] AS weekday_name,
    mean = max(mean) OVER w AS is_max, mean = min(mean) OVER w AS is_min FROM (
    SELECT route_id, gran_min, weekday, sum(passengers_sum) AS total, avg(passengers_sum) AS mean, stddev_samp(passengers_sum) AS sd
    FROM op_v GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY route_id, gran_min)""")
# Long daily series from the orders: one slot a day, over several years.
block("daily_v", f"""
  SELECT o_orderpriority AS route_id, 60 AS gran_min, CAST(o_orderdate AS TIMESTAMP) AS timestamp, CAST(sum(floor(o_totalprice / 10000)) AS DOUBLE) AS passengers_sum,
    count(*) AS trips, false AS is_gap, isodow(o_orderdate) - 1 AS weekday, {day_type_sql('o_orderdate')} AS day_type FROM orders GROUP BY o_orderpriority, o_orderdate""")
block("day_trend_v", """
  SELECT route_id, CASE WHEN count(*) >= 3 THEN regr_slope(passengers_sum, x) END AS slope, CASE WHEN count(*) >= 3 THEN regr_intercept(passengers_sum, x) END AS intercept
  FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY timestamp) - 1 AS x FROM daily_v) GROUP BY 1""")
block("periods_v", """
  SELECT *, coalesce(period_type = 'mes' AND abs(total - avg(total) OVER w) > 2 * stddev_samp(total) OVER w, false) AS is_unusual FROM (
    SELECT route_id, 'mes' AS period_type, CAST(date_trunc('month', timestamp) AS DATE) AS period, sum(passengers_sum) AS total FROM daily_v GROUP BY 1, 2, 3
    UNION ALL SELECT route_id, 'semana', CAST(date_trunc('week', timestamp) AS DATE), sum(passengers_sum) FROM daily_v GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY route_id, period_type)""")
block("pos_v", """
  SELECT *, passengers_sum - avg(passengers_sum) OVER (PARTITION BY route_id, gran_min) AS dev, count(*) OVER (PARTITION BY route_id, gran_min) AS n,
    row_number() OVER (PARTITION BY route_id, gran_min ORDER BY timestamp) AS i FROM op_v""")


def acf_block(name: str, lags: int) -> None:
    block(name, f"""
  SELECT *, 1.959963984540054 * sqrt(CASE WHEN lag = 0 THEN 0 ELSE (1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER w, 0)) / n END) AS ci,
    abs(acf) > 1.96 / sqrt(n) AS is_significant, abs(acf) > 0.3 AS is_relevant FROM (
    SELECT a.route_id, a.gran_min, a.n, k.lag, sum(a.dev * b.dev) / any_value(c.c0) AS acf
    FROM pos_v a CROSS JOIN (SELECT unnest(range(0, {lags + 1})) AS lag) k
    JOIN pos_v b ON b.route_id = a.route_id AND b.gran_min = a.gran_min AND b.i = a.i - k.lag
    JOIN (SELECT route_id, gran_min, sum(dev * dev) AS c0 FROM pos_v GROUP BY 1, 2) c ON c.route_id = a.route_id AND c.gran_min = a.gran_min
    WHERE a.n >= 50 AND k.lag <= a.n // 4 GROUP BY 1, 2, 3, 4)
  WINDOW w AS (PARTITION BY route_id, gran_min ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")


acf_block("acf_v", eda.MAX_LAG)
acf_block("acf_long_v", eda.OPERATING_MAX_LAG)
block("out_v", """
  SELECT *, CASE WHEN is_iqr AND is_z THEN 'ambos' WHEN is_iqr THEN 'IQR' WHEN is_z THEN 'zscore' ELSE '' END AS method,
    100.0 * avg(CAST(is_iqr OR is_z AS INT)) OVER (PARTITION BY route_id, gran_min) AS outlier_pct FROM (
    SELECT *, passengers_sum < fence_low OR passengers_sum > fence_high AS is_iqr, abs(zscore) > 3 AS is_z FROM (
      SELECT *, q1 - 1.5 * (q3 - q1) AS fence_low, q3 + 1.5 * (q3 - q1) AS fence_high, CASE WHEN sd > 0 THEN (passengers_sum - m) / sd ELSE 0 END AS zscore FROM (
        SELECT *, quantile_cont(passengers_sum, 0.25) OVER (PARTITION BY route_id, gran_min) AS q1, quantile_cont(passengers_sum, 0.75) OVER (PARTITION BY route_id, gran_min) AS q3,
          avg(passengers_sum) OVER (PARTITION BY route_id, gran_min, day_type) AS m, stddev_samp(passengers_sum) OVER (PARTITION BY route_id, gran_min, day_type) AS sd FROM op_v)))""")
block("ctx_v", """
  SELECT *, CASE WHEN context_n >= 8 AND context_iqr > 0 AND passengers_sum > high_limit THEN 'alto'
      WHEN context_n >= 8 AND context_iqr > 0 AND passengers_sum < low_limit THEN 'bajo' ELSE '' END AS outlier_type,
    passengers_sum - context_median AS deviation, CASE WHEN context_median <> 0 THEN passengers_sum / context_median END AS median_ratio FROM (
    SELECT s.*, context_n, context_median, q3 - q1 AS context_iqr, greatest(q1 - 1.0 * (q3 - q1), 0) AS low_limit, q3 + 1.0 * (q3 - q1) AS high_limit
    FROM cal_v s JOIN (SELECT route_id, gran_min, weekday, hour, count(passengers_sum) AS context_n, median(passengers_sum) AS context_median,
      quantile_cont(passengers_sum, 0.25) AS q1, quantile_cont(passengers_sum, 0.75) AS q3 FROM cal_v GROUP BY 1, 2, 3, 4) c
    ON c.route_id = s.route_id AND c.gran_min = s.gran_min AND c.weekday = s.weekday AND c.hour = s.hour)""")

# Augmented Dickey-Fuller: cross products of rows [1, level, change, lags of change], swept one regressor after another.
block("adf_rows_v", """
  SELECT *, list(dx) OVER (PARTITION BY route_id, gran_min ORDER BY i ROWS BETWEEN 200 PRECEDING AND CURRENT ROW) AS upto FROM (
    SELECT route_id, gran_min, n, i, dev, lag(dev) OVER w AS lev, dev - lag(dev) OVER w AS dx,
      CAST(least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2) AS INT) AS m FROM pos_v WHERE n >= 50
    WINDOW w AS (PARTITION BY route_id, gran_min ORDER BY i))""")


def _sweep(source: str, m: str, order: str) -> str:
    """Cross products of the regressors of ``order`` over the rows after lag ``m``, after k steps of elimination."""
    return f"""
  WITH RECURSIVE cells AS (
    SELECT route_id, gran_min, {m} AS m, n, a, b, sum(v[a] * v[b]) AS c FROM (SELECT *, unnest(range(1, {m} + 4)) AS b FROM (SELECT *, unnest(range(1, {m} + 4)) AS a FROM (
      SELECT route_id, gran_min, n, {m}, {order} AS v FROM {source} WHERE i >= {m} + 2))) GROUP BY 1, 2, 3, 4, 5, 6),
  swept AS (
    SELECT route_id, gran_min, m, n, 0 AS k, list(r ORDER BY a) AS g FROM (SELECT route_id, gran_min, m, n, a, list(c ORDER BY b) AS r FROM cells GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4
    UNION ALL
    SELECT route_id, gran_min, m, n, k + 1, [[g[x][y] - g[x][k + 1] * g[k + 1][y] / g[k + 1][k + 1] FOR y IN range(1, m + 4)] FOR x IN range(1, m + 4)]
    FROM swept WHERE k < m + 2)
  SELECT * FROM swept"""


block("adf_tried_v", _sweep("adf_rows_v", "m", "[1.0, lev] || [upto[-j - 1] FOR j IN range(1, m + 1)] || [dx]"))
block("adf_lag_v", """
  SELECT route_id, gran_min, arg_min(lag, (aic, lag)) AS p FROM (
    SELECT route_id, gran_min, k - 2 AS lag, (n - m - 1) * ln(g[m + 3][m + 3] / (n - m - 1)) + 2 * k AS aic FROM adf_tried_v WHERE k >= 2 AND g[m + 3][m + 3] > 0) GROUP BY 1, 2""")
block("adf_chosen_v", "SELECT r.*, l.p FROM adf_rows_v r JOIN adf_lag_v l ON l.route_id = r.route_id AND l.gran_min = r.gran_min")
block("adf_last_v", _sweep("adf_chosen_v", "p", "[1.0] || [upto[-j - 1] FOR j IN range(1, p + 1)] || [lev, dx]"))
# The normal distribution by Simpson's rule.
block("adf_v", """
  SELECT route_id, gran_min, n, used_lag, n_used, statistic, p_value, coalesce(p_value < 0.05, false) AS is_stationary FROM (
    SELECT *, CASE WHEN statistic > 2.74 THEN 1 WHEN statistic < -18.83 THEN 0
      ELSE 0.5 + z / 12000 / sqrt(2 * pi()) * list_sum([CASE WHEN j IN (0, 4000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * j / 4000, 2) / 2) FOR j IN range(0, 4001)]) END AS p_value FROM (
      SELECT *, CASE WHEN statistic <= -1.61 THEN 2.1659 + 1.4412 * statistic + 0.038269 * pow(statistic, 2)
        ELSE 1.7339 + 0.93202 * statistic - 0.12745 * pow(statistic, 2) - 0.010368 * pow(statistic, 3) END AS z FROM (
        SELECT route_id, gran_min, n, m AS used_lag, n - m - 1 AS n_used,
          b / a / sqrt((c - b * b / a) / (n - m - 1 - m - 2) / a) AS statistic FROM (
          SELECT *, g[m + 2][m + 2] AS a, g[m + 2][m + 3] AS b, g[m + 3][m + 3] AS c FROM adf_last_v WHERE k = m + 1))))""")
block("odd_v", "SELECT * FROM ctx_v WHERE outlier_type <> ''")


@staged
def slots(s, d):
    """All widths; the operators group by route and width."""
    return plain_series(s, d)


def daily_series(s, d):
    """One slot a day per route over several years."""
    t = long_trips(s, d)
    day = t.groupBy("route_id", F.lit(60).alias("gran_min"), floor_to_minutes("service_date", 1440).alias("timestamp")).agg(
        F.sum("boardings").cast("double").alias("passengers_sum"), F.count(F.lit(1)).alias("trips"))
    holiday = is_holiday(F.to_date("timestamp"))
    return day.withColumns({"is_gap": F.lit(False), "weekday": F.weekday("timestamp"), "hour": F.lit(0),
                            "day_type": day_type(F.weekday("timestamp"), holiday)})


def ctx(s, d):
    return outliers.contextual_outliers(slots(s, d), factor=1.0)


def odd(s, d):
    return ctx(s, d).filter("outlier_type <> ''")


def acf(s, d):
    return eda.autocorrelation(slots(s, d))


def _matrix_sql(measure: str, source: str) -> str:
    cells = ", ".join(f"coalesce(max(m) FILTER (hour = {h}), 0) AS h{h:02d}" for h in range(24))
    return f"""SELECT s.route_id, s.gran_min, s.weekday, {cells} FROM (SELECT DISTINCT route_id, gran_min, w AS weekday FROM {source}, range(0, 7) AS r(w)) s
      LEFT JOIN (SELECT route_id, gran_min, weekday, hour, {measure} AS m FROM {source} GROUP BY 1, 2, 3, 4) c ON c.route_id = s.route_id AND c.gran_min = s.gran_min AND c.weekday = s.weekday GROUP BY 1, 2, 3"""


_MATRIX = KEYS + "weekday:i " + " ".join(f"h{h:02d}:f" for h in range(24))


def _box_sql(by: str, source: str = "cal_v") -> str:
    return f"""SELECT b.route_id, b.gran_min, b.{by}, q1, median, q3, count(*) AS n, min(v) FILTER (ok) AS whisker_low, max(v) FILTER (ok) AS whisker_high,
      count(*) FILTER (NOT ok) AS outliers FROM (SELECT s.route_id, s.gran_min, s.{by}, q.q1, q.median, q.q3, passengers_sum AS v,
        passengers_sum BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM {source} s JOIN (
        SELECT route_id, gran_min, {by}, quantile_cont(passengers_sum, 0.25) AS q1, median(passengers_sum) AS median, quantile_cont(passengers_sum, 0.75) AS q3
        FROM {source} GROUP BY 1, 2, 3) q ON q.route_id = s.route_id AND q.gran_min = s.gran_min AND q.{by} = s.{by} WHERE passengers_sum IS NOT NULL) b GROUP BY 1, 2, 3, 4, 5, 6"""


_BOX = "q1:f median:f q3:f n:i whisker_low:f whisker_high:f outliers:i"
_codes = "(SELECT {c} AS k, dense_rank() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM ready_v))"
block("feat_v", """SELECT r.*, hour(final_end) AS end_hour, day(actual_start) AS day FROM ready_v r""")
block("pairs_v", " UNION ALL ".join(
    [f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, boardings AS y FROM feat_v" for f in FEATURES]
    + [f"SELECT '{c}', CAST(k.code AS DOUBLE), boardings FROM feat_v r JOIN {_codes.format(c=c)} k ON k.k = r.{c}" for c in TEXTS]))


QUERIES = [
    Query("e1_intraday_profile", KEYS + "day_type:s hour:i mean:f median:f p25:f p75:f p95:f",
          lambda s, d: eda.intraday_profile(slots(s, d)), sql("SELECT * FROM intraday_v")),
    Query("e2_peaks_and_valleys", KEYS + "day_type:s hour:i is_peak:b is_valley:b peak_valley_ratio:f peak_hours:s valley_hours:s",
          lambda s, d: eda.peaks_and_valleys(eda.intraday_profile(slots(s, d))),
          sql("""SELECT p.*, g.peak_valley_ratio, g.peak_hours, g.valley_hours FROM peaks_v p JOIN (
                 SELECT route_id, gran_min, day_type, CASE WHEN avg(mean) FILTER (is_valley) > 0 THEN avg(mean) FILTER (is_peak) / avg(mean) FILTER (is_valley) END AS peak_valley_ratio,
                 coalesce(string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) FILTER (is_peak), '') AS peak_hours,
                 coalesce(string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) FILTER (is_valley), '') AS valley_hours FROM peaks_v GROUP BY 1, 2, 3) g
                 ON g.route_id = p.route_id AND g.gran_min = p.gran_min AND g.day_type = p.day_type""")),
    Query("e3_weekly_profile", KEYS + "weekday:i total:f mean:f cv:f weekday_name:s is_max:b is_min:b",
          lambda s, d: eda.weekly_profile(slots(s, d)), sql("SELECT * FROM weekly_prof_v")),
    Query("e4_period_totals", "route_id:s period_type:s period:d total:f is_unusual:b slope:f intercept:f",
          lambda s, d: eda.period_totals(daily_series(s, d)),
          sql("SELECT p.*, t.slope, t.intercept FROM periods_v p JOIN day_trend_v t ON t.route_id = p.route_id")),
    Query("e4_preferred_width", "route_id:s gran_min:i timestamp:t passengers_sum:f",
          lambda s, d: eda.preferred_width(plain_series(s, d)), sql("SELECT * FROM cal_v WHERE gran_min = 60")),
    Query("e5_daily_trend", "route_id:s slope:f intercept:f",
          lambda s, d: eda.daily_trend(daily_series(s, d)), sql("SELECT * FROM day_trend_v")),
    Query("e6_autocorrelation", KEYS + "n:i lag:i acf:f ci:f is_significant:b is_relevant:b", acf, sql("SELECT * FROM acf_v")),
    Query("e6_autocorrelation_long", KEYS + "n:i lag:i acf:f ci:f is_significant:b is_relevant:b",
          lambda s, d: eda.autocorrelation(slots(s, d), max_lag=eda.OPERATING_MAX_LAG), sql("SELECT * FROM acf_long_v")),
    Query("e7_partial_autocorrelation", KEYS + "lag:i pacf:f is_significant:b",
          lambda s, d: eda.partial_autocorrelation(acf(s, d)),
          sql("""SELECT route_id, gran_min, k AS lag, pacf, abs(pacf) > 1.96 / sqrt(n) AS is_significant FROM (
                 WITH RECURSIVE known AS (SELECT route_id, gran_min, any_value(n) AS n, list(acf ORDER BY lag) AS r FROM acf_v GROUP BY 1, 2),
                 solved AS (
                   SELECT route_id, gran_min, n, r, 0 AS k, []::DOUBLE[] AS phi, 1.0::DOUBLE AS pacf FROM known
                   UNION ALL
                   SELECT route_id, gran_min, n, r, k + 1, list_append([phi[j] - last * phi[k + 1 - j] FOR j IN range(1, k + 1)], last), last FROM (
                     SELECT *, (r[k + 2] - coalesce(list_sum([phi[j] * r[k + 2 - j] FOR j IN range(1, k + 1)]), 0))
                       / (1 - coalesce(list_sum([phi[j] * r[j + 1] FOR j IN range(1, k + 1)]), 0)) AS last FROM solved WHERE k + 2 <= len(r)))
                 SELECT * FROM solved)""")),
    Query("e8_dickey_fuller", KEYS + "n:i statistic:f is_stationary:b",
          lambda s, d: eda.dickey_fuller(slots(s, d)),
          sql("""SELECT *, statistic < -2.86 AS is_stationary FROM (SELECT route_id, gran_min, count(*) AS n,
                 regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (regr_count(y, x) - 2) / regr_sxx(y, x)) AS statistic
                 FROM (SELECT *, lag(passengers_sum) OVER (PARTITION BY route_id, gran_min ORDER BY timestamp) AS x,
                 passengers_sum - lag(passengers_sum) OVER (PARTITION BY route_id, gran_min ORDER BY timestamp) AS y FROM op_v) GROUP BY 1, 2) WHERE n >= 50""")),
    Query("e8_augmented_dickey_fuller", KEYS + "n:i used_lag:i n_used:i statistic:f p_value:f is_stationary:b",
          lambda s, d: stationarity.augmented_dickey_fuller(eda.operating(slots(s, d)), eda.VALUE), sql("SELECT * FROM adf_v")),
    Query("e9_recommended_lookback", KEYS + "lookback_slots:i relevant_lags:i lookback_hours:i",
          lambda s, d: eda.recommended_lookback(acf(s, d)),
          sql("""SELECT *, lookback_slots * gran_min // 60 AS lookback_hours FROM (SELECT route_id, gran_min,
                 max(lag) FILTER (is_relevant AND lag > 0) AS lookback_slots, count(*) FILTER (is_relevant AND lag > 0) AS relevant_lags FROM acf_v GROUP BY 1, 2)""")),
    Query("e10_trend_class", "route_id:s slope:f trend:s monthly_change:f",
          lambda s, d: eda.trend_class(eda.daily_trend(daily_series(s, d))),
          sql("""SELECT route_id, slope, CASE WHEN abs(slope) < 0.5 THEN 'ESTABLE' WHEN slope > 0 THEN 'CRECIENTE' ELSE 'DECRECIENTE' END AS trend,
                 slope * 30 AS monthly_change FROM day_trend_v""")),
    Query("e11_series_outliers", KEYS + "timestamp:t day_type:s passengers_sum:f is_iqr:b is_z:b zscore:f method:s fence_low:f fence_high:f outlier_pct:f",
          lambda s, d: outliers.series_outliers(slots(s, d)), sql("SELECT * FROM out_v WHERE is_iqr OR is_z")),
    Query("e12_contextual_outliers", KEYS + "timestamp:t context_n:i context_median:f context_iqr:f low_limit:f high_limit:f outlier_type:s deviation:f median_ratio:f",
          ctx, sql("SELECT * FROM ctx_v")),
    Query("e13_feature_correlation", "feature:s n:i spearman:f abs_spearman:f place:i",
          lambda s, d: outliers.spearman_by_feature(ready(s, d), "boardings", FEATURES, TEXTS),
          sql("""SELECT *, abs(spearman) AS abs_spearman, row_number() OVER (ORDER BY abs(spearman) DESC, feature) AS place FROM (
                 SELECT feature, count(*) AS n, corr(rx, ry) AS spearman FROM (SELECT feature,
                 rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
                 rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM pairs_v) GROUP BY 1)""")),
    Query("e14_highlights", KEYS + "finding:s detail:s value:f",
          lambda s, d: eda.highlights(slots(s, d), odd(s, d)),
          sql(f"""SELECT route_id, gran_min, 'Mayor valor por franja' AS finding, left(CAST(timestamp AS VARCHAR), 19) AS detail, passengers_sum AS value FROM (
                 SELECT *, row_number() OVER (PARTITION BY route_id, gran_min ORDER BY passengers_sum DESC NULLS LAST, timestamp) AS k FROM cal_v) WHERE k = 1
                 UNION ALL SELECT route_id, gran_min, 'Dia con mayor demanda acumulada', CAST(dd AS VARCHAR), v FROM (SELECT *, row_number() OVER (PARTITION BY route_id, gran_min ORDER BY v DESC NULLS LAST, dd) AS k
                 FROM (SELECT route_id, gran_min, CAST(timestamp AS DATE) AS dd, sum(passengers_sum) AS v FROM cal_v GROUP BY 1, 2, 3)) WHERE k = 1
                 UNION ALL SELECT route_id, gran_min, 'Contexto horario mas fuerte', {_names}[weekday + 1] || printf(' %02d:00', hour), v FROM (
                 SELECT *, row_number() OVER (PARTITION BY route_id, gran_min ORDER BY v DESC NULLS LAST, weekday, hour) AS k
                 FROM (SELECT route_id, gran_min, weekday, hour, avg(passengers_sum) AS v FROM cal_v GROUP BY 1, 2, 3, 4)) WHERE k = 1
                 UNION ALL SELECT route_id, gran_min, 'Franjas imputadas como gap', 'percent of all slots', 100.0 * avg(CAST(is_gap AS INT)) FROM cal_v GROUP BY 1, 2
                 UNION ALL SELECT route_id, gran_min, 'Atipicos detectados', 'slots off the range of their weekday and hour', count(*) FROM ctx_v WHERE outlier_type <> '' GROUP BY 1, 2""")),
    Query("e15_moving_average", KEYS + "timestamp:t moving_avg:f",
          lambda s, d: eda.moving_average(slots(s, d), 6),
          sql("""SELECT route_id, gran_min, timestamp, avg(passengers_sum) OVER (PARTITION BY route_id, gran_min ORDER BY timestamp ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
                 AS moving_avg FROM cal_v""")),
    Query("e16_demand_matrix", _MATRIX, lambda s, d: eda.weekday_hour_matrix(eda.operating(slots(s, d)), F.avg("passengers_sum")),
          sql(_matrix_sql("avg(passengers_sum)", "op_v"))),
    Query("e16_gap_matrix", _MATRIX, lambda s, d: eda.weekday_hour_matrix(slots(s, d), eda.gap_share()),
          sql(_matrix_sql("100.0 * avg(CAST(is_gap AS INT))", "cal_v"))),
    Query("e16_gap_type_matrix", _MATRIX,
          lambda s, d: eda.weekday_hour_matrix(series_table(s, d), eda.gap_type_share("gap_anomalo")),
          sql(_matrix_sql("100.0 * avg(CAST(gap_type = 'gap_anomalo' AS INT))", "series_v"))),
    Query("e16_outlier_matrix", _MATRIX, lambda s, d: eda.weekday_hour_matrix(odd(s, d), F.count(F.lit(1))),
          sql(_matrix_sql("count(*)", "odd_v"))),
    Query("e17_gap_type_summary", KEYS + "gap_type:s slots:i pct:f",
          lambda s, d: eda.gap_type_summary(series_table(s, d)),
          sql("""SELECT route_id, gran_min, gap_type, count(*) AS slots, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY route_id, gran_min) AS pct
                 FROM series_v GROUP BY 1, 2, 3""")),
    Query("e18_width_comparison", KEYS + "slots:i gaps:i gap_pct:f metric:f",
          lambda s, d: eda.width_comparison(plain_series(s, d)),
          sql("""SELECT route_id, gran_min, count(*) AS slots, count(*) FILTER (is_gap) AS gaps, 100.0 * avg(CAST(is_gap AS INT)) AS gap_pct,
                 sum(passengers_sum) AS metric FROM cal_v GROUP BY 1, 2""")),
    Query("e19_thin_out", KEYS + "timestamp:t", lambda s, d: eda.thin_out(slots(s, d), 300),
          sql("""SELECT route_id, gran_min, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY route_id, gran_min ORDER BY timestamp) - 1 AS i,
                 greatest(count(*) OVER (PARTITION BY route_id, gran_min) // 300, 1) AS step FROM cal_v) WHERE i % step = 0""")),
    Query("e20_top_scores", KEYS + "timestamp:t zscore:f",
          lambda s, d: eda.top_scores(outliers.series_outliers(slots(s, d)), "zscore", 20, ("route_id", "gran_min", "timestamp")),
          sql("SELECT * FROM out_v WHERE is_iqr OR is_z ORDER BY abs(zscore) DESC, route_id, gran_min, timestamp LIMIT 20")),
    Query("e21_intraday_variability", KEYS + "days:i mean:f std_median:f",
          lambda s, d: eda.intraday_variability(slots(s, d)),
          sql("""SELECT route_id, gran_min, count(*) AS days, avg(m) AS mean, median(sd) AS std_median FROM (SELECT route_id, gran_min,
                 CAST(timestamp - INTERVAL 4 HOUR AS DATE) AS dd, avg(passengers_sum) AS m, stddev_samp(passengers_sum) AS sd FROM op_v GROUP BY 1, 2, 3) GROUP BY 1, 2""")),
    Query("e21_slot_extremes", KEYS + "slots:i mean_min:f mean_max:f std_min:f std_max:f",
          lambda s, d: eda.slot_extremes(eda.weekday_slot_profile(slots(s, d)), 10),
          sql("""SELECT route_id, gran_min, count(*) AS slots, min(m) AS mean_min, max(m) AS mean_max, min(sd) AS std_min, max(sd) AS std_max FROM (
                 SELECT route_id, gran_min, minute, avg(passengers_sum) AS m, stddev_samp(passengers_sum) AS sd, count(*) AS n FROM op_v
                 WHERE day_type = 'LABORAL' GROUP BY 1, 2, 3) WHERE n >= 10 GROUP BY 1, 2""")),
    *[Query(f"e22_box_by_{by}", KEYS + f"{by}:{k} {_BOX}", lambda s, d, by=by: eda.box_numbers(slots(s, d), by), sql(_box_sql(by)))
      for by, k in (("day_part", "s"), ("hour", "i"), ("day_type", "s"))],
    Query("e23_worst_gap_cells", KEYS + "weekday:i hour:i slots:i gaps:i gap_pct:f",
          lambda s, d: eda.worst_gap_cells(slots(s, d)),
          sql("""SELECT route_id, gran_min, weekday, hour, count(*) AS slots, count(*) FILTER (is_gap) AS gaps, 100.0 * count(*) FILTER (is_gap) / count(*) AS gap_pct
                 FROM cal_v GROUP BY 1, 2, 3, 4 ORDER BY gap_pct DESC, route_id, gran_min, weekday, hour LIMIT 40""")),
    Query("e24_monthly_fit", "route_id:s period:d total:f fitted:f",
          lambda s, d: eda.monthly_fit(eda.period_totals(daily_series(s, d))),
          sql("""SELECT route_id, period, total, regr_intercept(total, x) OVER w + regr_slope(total, x) OVER w * x AS fitted FROM (
                 SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY period) - 1 AS x FROM periods_v WHERE period_type = 'mes')
                 WINDOW w AS (PARTITION BY route_id)""")),
    Query("e25_slice_scorecard", KEYS + "n_rows:i metric:f gaps:i gap_pct:f odd_gaps:i outliers:i",
          lambda s, d: (lambda f: eda.slice_scorecard(f, outliers.contextual_outliers(f, factor=1.0)))(series_table(s, d)),
          sql("""SELECT s.route_id, s.gran_min, count(*) AS n_rows, sum(s.passengers_sum) AS metric, count(*) FILTER (s.is_gap) AS gaps,
                 100.0 * count(*) FILTER (s.is_gap) / count(*) AS gap_pct, count(*) FILTER (s.gap_type = 'gap_anomalo') AS odd_gaps,
                 count(*) FILTER (c.outlier_type <> '') AS outliers FROM series_v s JOIN ctx_v c ON c.route_id = s.route_id AND c.gran_min = s.gran_min AND c.timestamp = s.timestamp GROUP BY 1, 2""")),
]

"""Queries over boosted trees; the SQL twin grows the same trees, round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators import features, trees
from busloom.plans.common_sql import block, sql
from busloom.plans.model_queries import folds_table, table
from busloom.plans.registry import Query
from busloom.plans.stages import staged

NUMERIC = ("hour", "weekday", *(f"passengers_sum_lag_{k}" for k in features.LAGS), *(f"trips_lag_{k}" for k in features.TRIP_LAGS))
TEXTS = ("day_type", "day_part")
# The benchmark's plan spans a month, a seventh of the default plan's lengths; so do rounds, patience and the days that decide when to stop.
HOW = trees.Boosting(trees=7, depth=3, rate=0.3, patience=2, stop_days=2, bins=24)

# ---------------------------------------------------------------- SQL blocks

_BY = "model, fold, split, route_id"
_ALL = len(NUMERIC) + len(TEXTS)
_S = trees.SCALE


def _fixed(x: str) -> str:
    return f"CAST(floor(({x}) * {_S} + 0.5) AS BIGINT)"


block("gb_known_v", f"""SELECT * FROM table_v WHERE passengers_sum IS NOT NULL
  AND timestamp < (SELECT min(train_end) FROM folds_v) - INTERVAL {HOW.stop_days} DAY""", kept=True)
block("gb_values_v", " UNION ALL ".join(f"SELECT {i} AS f, CAST({n} AS DOUBLE) AS v FROM gb_known_v WHERE {n} IS NOT NULL" for i, n in enumerate(NUMERIC)))
block("gb_borders_v", f"""SELECT f, list(border ORDER BY border) AS edges FROM (SELECT f, floor((upto - n) * {HOW.bins} / total) AS b, min(v) AS border FROM (
  SELECT f, v, n, sum(n) OVER (PARTITION BY f ORDER BY v) AS upto, sum(n) OVER (PARTITION BY f) AS total FROM (SELECT f, v, count(*) AS n FROM gb_values_v GROUP BY 1, 2)) GROUP BY 1, 2) GROUP BY 1""")
block("gb_edges_v", "SELECT " + ", ".join(f"max(edges) FILTER (f = {i}) AS e{i}" for i in range(len(NUMERIC))) + " FROM gb_borders_v")
block("gb_texts_v", "SELECT " + ", ".join(f"list(DISTINCT {n} ORDER BY {n}) FILTER ({n} IS NOT NULL) AS t{i}" for i, n in enumerate(TEXTS)) + " FROM gb_known_v")
_codes = [f"CASE WHEN {n} IS NULL OR e{i} IS NULL THEN 0 ELSE 1 + len(list_filter(e{i}[2:], lambda b: b <= CAST({n} AS DOUBLE))) END" for i, n in enumerate(NUMERIC)]
_codes += [f"coalesce(list_position(t{i}, {n}), 0)" for i, n in enumerate(TEXTS)]
block("gb_rows_v", f"SELECT route_id, timestamp, CAST(passengers_sum AS DOUBLE) AS y, [{', '.join(f'CAST({c} AS INTEGER)' for c in _codes)}] AS codes FROM table_v, gb_edges_v, gb_texts_v", kept=True)
block("gb_uses_v", f"""
  SELECT * FROM (SELECT m.model, f.fold, f.split, r.*, CASE WHEN r.timestamp >= f.train_end THEN 2 WHEN y IS NULL THEN NULL
    WHEN r.timestamp < f.train_end - INTERVAL {HOW.stop_days} DAY THEN 0 ELSE 1 END AS kind
  FROM gb_rows_v r JOIN folds_v f ON r.timestamp < f.eval_end, (VALUES ('trees_l2'), ('trees_l1')) AS m(model)) WHERE kind IS NOT NULL""")
block("gb_base_v", f"""SELECT {_BY}, CASE WHEN model = 'trees_l2' THEN CAST(sum({_fixed('y')}) AS DOUBLE) / {_S} / count(*) ELSE median(y) END AS pred
  FROM gb_uses_v WHERE kind = 0 GROUP BY {_BY}""")
block("gb_state_0_v", f"SELECT u.*, b.pred FROM gb_uses_v u LEFT JOIN gb_base_v b USING ({_BY})", kept=True)


def _score(g: str, n: str) -> str:
    return f"(CAST({g} AS DOUBLE) / {_S}) * (CAST({g} AS DOUBLE) / {_S}) / ({n} + {HOW.shrink:.1f}::DOUBLE)"


for _t in range(1, HOW.trees + 1):
    block(f"gb_node_{_t}_0_v", f"""SELECT *, 1 AS node, CASE WHEN model = 'trees_l2' THEN {_fixed('pred - y')} ELSE CAST(sign(pred - y) AS BIGINT) * {_S} END AS g
      FROM gb_state_{_t - 1}_v""")
    for _l in range(HOW.depth):
        _node = f"gb_node_{_t}_{_l}_v"
        block(f"gb_cell_{_t}_{_l}_v", f"""
          SELECT *, sum(g) OVER w AS all_g, sum(n) OVER w AS all_n, coalesce(sum(g) FILTER (code = 0) OVER w, 0) AS no_g, coalesce(sum(n) FILTER (code = 0) OVER w, 0) AS no_n
          FROM (SELECT {_BY}, node, feature, code, sum(g) AS g, count(*) AS n
            FROM (SELECT {_BY}, node, g, unnest(codes) AS code, unnest(range({_ALL})) AS feature FROM {_node} WHERE kind = 0) GROUP BY ALL)
          WINDOW w AS (PARTITION BY {_BY}, node, feature)""")
        block(f"gb_run_{_t}_{_l}_v", f"""
          SELECT * EXCLUDE (left_g, left_n, mask), left_g + missing_left * no_g AS left_g, left_n + missing_left * no_n AS left_n, mask + missing_left AS mask
          FROM (SELECT *, sum(g) OVER u AS left_g, sum(n) OVER u AS left_n, CASE WHEN feature < {len(NUMERIC)} THEN (2::BIGINT << code) - 2 ELSE bit_or(1::BIGINT << code) OVER u END AS mask
            FROM (SELECT *, CASE WHEN feature < {len(NUMERIC)} THEN CAST(code AS DOUBLE) ELSE g / n END AS place FROM gb_cell_{_t}_{_l}_v WHERE code > 0)
            WINDOW u AS (PARTITION BY {_BY}, node, feature ORDER BY place, code ROWS UNBOUNDED PRECEDING)), (VALUES (0), (1)) AS s(missing_left)""")
        block(f"gb_split_{_t}_{_l}_v", f"""
          SELECT * FROM (SELECT *, ({_score('left_g', 'left_n')} + {_score('(all_g - left_g)', '(all_n - left_n)')} - {_score('all_g', 'all_n')}) / 2 AS gain FROM gb_run_{_t}_{_l}_v)
          WHERE left_n >= {HOW.leaf_rows} AND all_n - left_n >= {HOW.leaf_rows} AND gain > {trees.LEAST_GAIN}
          QUALIFY row_number() OVER (PARTITION BY {_BY}, node ORDER BY gain DESC, feature, missing_left, code) = 1""", kept=True)
        block(f"gb_node_{_t}_{_l + 1}_v", f"""
          SELECT n.* EXCLUDE (node), 2 * n.node + CASE WHEN b.mask IS NULL OR (b.mask >> n.codes[b.feature + 1]) & 1 = 1 THEN 0 ELSE 1 END AS node
          FROM {_node} n LEFT JOIN (SELECT {_BY}, node, feature, mask FROM gb_split_{_t}_{_l}_v) b USING ({_BY}, node)""", kept=_l + 1 == HOW.depth)
    _node = f"gb_node_{_t}_{HOW.depth}_v"
    block(f"gb_leaf_{_t}_v", f"""
      SELECT {_BY}, node, CASE WHEN model = 'trees_l2' THEN -(CAST(sum(g) AS DOUBLE) / {_S}) / (count(*) + {HOW.shrink:.1f}::DOUBLE) ELSE median(y - pred) END * {HOW.rate}::DOUBLE AS leaf
      FROM {_node} WHERE kind = 0 GROUP BY {_BY}, node""")
    block(f"gb_state_{_t}_v", f"""SELECT n.* EXCLUDE (node, g, pred), n.pred + coalesce(l.leaf, 0.0) AS pred FROM {_node} n LEFT JOIN gb_leaf_{_t}_v l USING ({_BY}, node)""", kept=True)
_rounds = range(1, HOW.trees + 1)
block("gb_error_v", " UNION ALL ".join(f"SELECT {_BY}, {t} AS tree, sum({_fixed('abs(y - pred)')}) AS error FROM gb_state_{t}_v WHERE kind = 1 GROUP BY ALL" for t in _rounds))
# The round a model stops after is the first one that many rounds past the best before it.
block("gb_best_v", f"""
  SELECT {_BY}, min(tree) AS trees FROM (SELECT e.*, min(error) OVER (PARTITION BY {_BY}) AS least FROM gb_error_v e JOIN (
      SELECT {_BY}, coalesce(min(tree) FILTER (tree - best >= {HOW.patience}), {HOW.trees}) AS last FROM (
        SELECT *, arg_min(tree, error * 1000 + tree) OVER (PARTITION BY {_BY} ORDER BY tree) AS best FROM gb_error_v) GROUP BY {_BY}) USING ({_BY}) WHERE tree <= last)
  WHERE error = least GROUP BY ALL""", kept=True)
block("gb_pred_v", " UNION ALL ".join(f"SELECT {_BY}, {t} AS tree, timestamp, y, pred FROM gb_state_{t}_v WHERE kind = 2" for t in _rounds))
_names = ", ".join(f"'{n}'" for n in (*NUMERIC, *TEXTS))
block("gb_splits_v", " UNION ALL ".join(
    f"SELECT {_BY}, {t} AS tree, node, [{_names}][feature + 1] AS feature, mask, gain, all_n AS n, left_n FROM gb_split_{t}_{lv}_v" for t in _rounds for lv in range(HOW.depth)))
block("gb_gain_v", f"SELECT {_BY}, feature, avg(gain) AS gain FROM gb_splits_v JOIN gb_best_v USING ({_BY}) WHERE tree <= trees GROUP BY ALL")

# ---------------------------------------------------------------- Spark frames


@staged
def _fitted(s, d) -> DataFrame:
    """Predictions, rounds used and splits of all models in one table, from one run; ``part`` tells them apart."""
    found = trees.backtest_trees(table(s, d), folds_table(s, d), NUMERIC, TEXTS, how=HOW)
    parts = [f.withColumn("part", F.lit(p)) for p, f in (("row", found.predictions), ("model", found.models), ("split", found.splits))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def _part(s, d, name: str) -> DataFrame:
    return _fitted(s, d).filter(F.col("part") == name)


QUERIES = [
    Query("b13_tree_forecast", "model:s fold:s split:s route_id:s timestamp:t y_real:f y_pred:f", lambda s, d: _part(s, d, "row"),
          sql(f"SELECT {_BY}, timestamp, y AS y_real, pred AS y_pred FROM gb_pred_v JOIN gb_best_v USING ({_BY}) WHERE tree = trees")),
    Query("b13_tree_rows", "model:s fold:s split:s route_id:s timestamp:t y_real:f predicted:b",
          lambda s, d: _part(s, d, "row").withColumn("predicted", F.col("y_pred").isNotNull()),
          sql("""SELECT model, f.fold, f.split, t.route_id, t.timestamp, t.passengers_sum AS y_real, true AS predicted
                 FROM table_v t JOIN folds_v f ON t.timestamp >= f.eval_start AND t.timestamp < f.eval_end, (VALUES ('trees_l2'), ('trees_l1')) AS m(model)""")),
    Query("b13_tree_splits", "model:s fold:s split:s route_id:s tree:i node:i feature:s mask:i gain:f n:i left_n:i",
          lambda s, d: _part(s, d, "split").join(_part(s, d, "model").select(*_BY.split(", "), F.col("trees").alias("_used")), _BY.split(", ")).filter("tree <= _used"),
          sql(f"SELECT * FROM gb_splits_v JOIN gb_best_v USING ({_BY}) WHERE tree <= trees")),
    Query("b14_feature_importance", "model:s route_id:s feature:s gain_mean:f place:i",
          lambda s, d: trees.importance_table(_part(s, d, "model"), _part(s, d, "split").drop("trees")),
          sql("""SELECT *, row_number() OVER (PARTITION BY model, route_id ORDER BY round(gain_mean, 6) DESC, feature) AS place
                 FROM (SELECT model, route_id, feature, avg(gain) AS gain_mean FROM gb_gain_v GROUP BY ALL)""")),
    Query("b14_tree_counts", "model:s route_id:s folds:i mean:f std:f min:i max:i", lambda s, d: trees.tree_counts(_part(s, d, "model")),
          sql("SELECT model, route_id, count(*) AS folds, avg(trees) AS mean, stddev_samp(trees) AS std, min(trees) AS min, max(trees) AS max FROM gb_best_v GROUP BY ALL")),
]

"""Splits, bins and stopping of the boosted trees against plain loops."""

import random
from datetime import datetime, timedelta
from itertools import product

from pyspark.sql import functions as F

from busloom.operators import trees
from busloom.operators.trees import SCALE, Boosting


def plain_best(rows, numeric, how):
    """(gain, left rows) of the best split of (codes, g) rows, by trying every one."""
    def score(group):
        return (sum(g for _, g in group) / SCALE) ** 2 / (len(group) + how.shrink)

    best = (trees.LEAST_GAIN, None)
    for feature in range(len(rows[0][0])):
        known = sorted({c[feature] for c, _ in rows} - {0})
        mean = {v: sum(g for c, g in rows if c[feature] == v) / sum(c[feature] == v for c, _ in rows) for v in known}
        order = known if feature < numeric else sorted(known, key=lambda v: (mean[v], v))
        for upto, missing in product(range(1, len(order) + 1), (0, 1)):
            left = {*order[:upto], *([0] if missing else [])}
            a, b = [r for r in rows if r[0][feature] in left], [r for r in rows if r[0][feature] not in left]
            if min(len(a), len(b)) >= how.leaf_rows:
                gain = (score(a) + score(b) - score(rows)) / 2
                if gain > best[0] + 1e-9:
                    best = (gain, len(a))
    return best


def test_best_splits_equal_trying_every_one(spark):
    rng, how = random.Random(4), Boosting(leaf_rows=3)
    rows = []
    for m in range(6):
        for _ in range(60):
            codes = [rng.choice([0, 1, 2, 3, 5]), rng.choice([0, 0, 1, 2]), rng.choice([0, 1, 2, 3, 4])]
            signal = (codes[0] in (0, 1)) * 3 + (codes[2] in (1, 4)) * 2 if m % 2 else codes[1] * 2
            rows.append((m, m % 3, codes, int((signal + rng.random()) * SCALE)))
    frame = spark.createDataFrame(rows, "m int, node int, codes array<tinyint>, g long")
    found = {(r.m, r.node): r for r in trees.best_splits(frame, ["m"], 2, how).collect()}
    for m in range(6):
        gain, left = plain_best([(c, g) for k, _, c, g in rows if k == m], 2, how)
        assert abs(found[m, m % 3].gain - gain) < 1e-9 and found[m, m % 3].left_n == left
    assert any(r.mask & 1 for r in found.values())  # a missing value went to the left somewhere


def test_folds_fit_together_as_they_do_alone(spark):
    """Every fold's trees and predictions are those of a run with this fold only, if the bins are the same."""
    rng, start = random.Random(8), datetime(2024, 1, 1)
    rows = []
    for i in range(24 * 40):
        hour = i % 24
        seen = None if rng.random() < 0.1 else float(hour)
        rows.append(("r", start + timedelta(hours=i), None if i % 50 == 7 else hour * 2.0 + rng.random(), seen, "ab"[hour > 11] if i % 9 else None))
    rows += [("s", t, y, h, x) for r, t, y, h, x in rows[: 24 * 35]]
    table = spark.createDataFrame(rows, "route_id string, timestamp timestamp_ntz, passengers_sum double, hour_seen double, half string")
    folds = spark.createDataFrame([(str(k), "validation", start + timedelta(days=20 + 5 * k), start + timedelta(days=25 + 5 * k)) for k in range(3)],
                                  "fold string, split string, train_end timestamp_ntz, eval_end timestamp_ntz")
    how = Boosting(trees=4, depth=2, rate=0.5, patience=2, stop_days=3, bins=24)
    both = trees.backtest_trees(table, folds, ["hour_seen"], ["half"], how=how)
    alone = trees.backtest_trees(table, folds.filter("fold = '0'"), ["hour_seen"], ["half"], how=how)
    first = sorted(map(tuple, both.predictions.filter("fold = '0'").collect()), key=str)
    assert first == sorted(map(tuple, alone.predictions.collect()), key=str) and len(first) == 2 * 2 * 24 * 5
    errors = both.predictions.filter("y_real IS NOT NULL").groupBy("model", "route_id").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_real"))).alias("mae")).collect()
    assert len(errors) == 4 and all(r.mae < 6 for r in errors)  # demand runs from 0 to 47
    used = {(r.model, r.fold, r.route_id): (r.trees, r.fit_rows, r.stop_rows) for r in both.models.collect()}
    assert len(used) == 12 and all(1 <= t <= 4 and f > 0 and s > 0 for t, f, s in used.values())
    rounds = {r[0] for r in both.splits.select("tree").distinct().collect()}
    assert rounds <= {1, 2, 3, 4} and trees.importance_table(both.models, both.splits).filter("place = 1").count() == 4

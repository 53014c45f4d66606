"""Gradient-boosted trees over all folds, objectives and routes at once.

Every route, fold and objective is a model of its own, and its name is a key of the aggregates: one aggregate per tree
level counts the binned gradients of all models, so the number of jobs follows from rounds and
depth alone, however many folds and routes there are.  A state table holds a row for each slot and
model that uses it (to fit, to decide when to stop, or to be predicted), with its prediction so far.

* *Bins.*  Numeric features are cut at exact quantiles, texts are numbered, both as seen in the
  rows that every fold fits on.  Bin 0 is a missing value.  A split sends a set of bins to the left, kept as the
  bits of a number: for numeric features the bins up to a border, for texts any set (ordered by mean gradient),
  and bin 0 with the side that gains more.
* *Whole numbers.*  Gradients are fixed-point numbers of 1 / ``SCALE``, so sums do not depend on the order of rows and a
  run repeats exactly.
* *Stopping.*  The last training days of each fold decide, for each model, which round was best; a model without a better
  one for ``patience`` rounds leaves the state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.columns import plus_minutes
from busloom.functions.reuse import written_once
from busloom.functions.stats import running_total

# Objectives; what a row is to a model.
OBJECTIVES = {"trees_l2": "squared", "trees_l1": "absolute"}
FIT, STOP, EVAL = 0, 1, 2
SCALE = 1 << 16
MOST_BINS = 61  # their bits, the missing one's and a border beyond the last fit a signed number
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boosting:
    """Rounds, depth, learning rate, least rows of a leaf, regularisation, patience in rounds, stopping days, bins."""

    trees: int = 50
    depth: int = 5
    rate: float = 0.1
    leaf_rows: int = 5
    shrink: float = 1.0
    patience: int = 10
    stop_days: int = 14
    bins: int = MOST_BINS


@dataclass(frozen=True)
class Fitted:
    """``predictions``: the evaluated rows; ``models``: rounds used; ``splits``: of all rounds, also those after the best one."""

    predictions: DataFrame
    models: DataFrame
    splits: DataFrame


def fixed(c: Column) -> Column:
    return F.floor(c * SCALE + 0.5).cast("long")


def numeric_borders(rows: DataFrame, numeric: Sequence[str], bins: int) -> list[list[float]]:
    """Each feature's bins by their least value: exact quantiles of its values, at most ``bins``; features x bins numbers."""
    long = rows.select(F.posexplode(F.array(*(F.col(n).cast("double") for n in numeric))).alias("feature", "value")).filter("value is not null")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    cut = running_total(counts, ["feature"], ["value"], "n", "upto").join(totals, "feature")
    place = F.floor((F.col("upto") - F.col("n")) * bins / F.col("total"))
    borders = cut.groupBy("feature", place.alias("bin")).agg(F.min("value").alias("border"))
    found: list[list[float]] = [[] for _ in numeric]
    for r in borders.orderBy("feature", "bin").collect():
        found[r["feature"]].append(r["border"])
    return found


def text_values(rows: DataFrame, texts: Sequence[str], bins: int) -> list[list[str]]:
    """Each feature's most frequent values, at most ``bins``, in alphabetic order; the others count as missing."""
    found = []
    for name in texts:
        top = rows.filter(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).limit(bins)
        found.append(sorted(r[0] for r in top.collect()))
    return found


def bin_codes(numeric: Sequence[str], borders: list[list[float]], texts: Sequence[str], values: list[list[str]]) -> Column:
    """The bins of a row's features, 0 where a value is missing."""

    def numbered(v: Column, edges: list[float]) -> Column:
        reached = F.filter(F.array(*map(F.lit, edges[1:])).cast("array<double>"), lambda border: border <= v)
        return F.when(v.isNull() | F.lit(not edges), 0).otherwise(1 + F.size(reached))

    codes = [numbered(F.col(name).cast("double"), edges) for name, edges in zip(numeric, borders, strict=True)]
    for name, known in zip(texts, values, strict=True):
        codes.append(F.coalesce(F.array_position(F.array(*map(F.lit, known)).cast("array<string>"), F.col(name)), F.lit(0)))
    return F.array(*(c.cast("tinyint") for c in codes))


def _start(table: DataFrame, folds: list, codes: Column, keys: Sequence[str], target: str, how: Boosting) -> DataFrame:
    """State before the first round: each row is copied to the folds that use it, and there to each objective.

    ``m`` numbers folds and objectives: even numbers are squared, odd ones absolute errors.
    """
    t, stop = F.col("timestamp"), 1440 * how.stop_days
    uses = []
    for f in folds:
        cut, end = (F.lit(str(f[c])).cast("timestamp_ntz") for c in ("train_end", "eval_end"))
        kind = F.when((t >= cut) & (t < end), EVAL).when((t < cut) & F.col(target).isNotNull(), F.when(t < plus_minutes(cut, -stop), FIT).otherwise(STOP))
        uses += [F.struct(F.lit(len(uses) + k).alias("m"), kind.alias("kind")) for k in range(len(OBJECTIVES))]
    used = F.filter(F.array(*uses), lambda u: u["kind"].isNotNull())
    rows = table.select(*keys, "timestamp", F.col(target).cast("double").alias("y"), codes.alias("codes"), F.explode(used).alias("_u"))
    return rows.select("_u.m", *keys, "_u.kind", "timestamp", "codes", "y")


def _named(rows: DataFrame, folds: list) -> DataFrame:
    """``rows`` with the names of their models instead of the numbers."""
    names = F.array(*(F.struct(F.lit(o).alias("model"), F.lit(f["fold"]).alias("fold"), F.lit(f["split"]).alias("split")) for f in folds for o in OBJECTIVES))
    return rows.withColumn("_named", names[F.col("m")]).select("_named.*", *rows.drop("m").columns)


def _squared() -> Column:
    return F.col("m") % 2 == 0


def _gradient() -> Column:
    error = F.col("pred") - F.col("y")
    return F.when(_squared(), fixed(error)).otherwise(F.signum(error).cast("long") * SCALE)


def _routed(rows: DataFrame, splits: DataFrame | None, by: Sequence[str], levels: int) -> DataFrame:
    """``rows`` with the node each is in after ``levels`` levels: 1, then 2n to the left and 2n + 1 to the right of n."""
    if splits is None or not levels:
        return rows.withColumn("node", F.lit(1))
    # At most a tree's inner nodes per model.
    trees = splits.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "mask")))).alias("_tree"))
    out = rows.join(trees, list(by), "left").withColumn("node", F.lit(1))
    for _ in range(levels):
        out = out.withColumn("_s", F.expr("try_element_at(_tree, node)")).withColumn(
            "node", F.expr("2 * node + IF(_s IS NULL OR shiftright(_s.mask, codes[_s.feature]) & 1 = 1, 0, 1)"))
    return out.drop("_tree", "_s")


def best_splits(rows: DataFrame, by: Sequence[str], numeric: int, how: Boosting) -> DataFrame:
    """The best split of every node (``rows``: by, node, g, codes) that has one; texts are the features from ``numeric`` on.

    One shuffle, by model: a model's rows are bounded by the time span, and all that follows is grouped below it.
    """
    node = [*by, "node"]
    # The rows are short, what they unfold to is not: runtime re-planning would put them into one task.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = rows.select(*node, "g", "codes").repartition(tasks, *by).select(*node, "g", F.posexplode("codes").alias("feature", "code")).groupBy(*node, "feature", "code").agg(
        F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy(*node, "feature")
    missing = F.col("code") == 0
    cells = cells.withColumns({
        "all_g": F.sum("g").over(one), "all_n": F.sum("n").over(one),
        "no_g": F.coalesce(F.sum(F.when(missing, F.col("g"))).over(one), F.lit(0)),
        "no_n": F.coalesce(F.sum(F.when(missing, F.col("n"))).over(one), F.lit(0))}).filter(~missing)
    order = F.when(F.col("feature") < numeric, F.col("code").cast("double")).otherwise(F.col("g") / F.col("n"))
    upto = one.orderBy("order", "code").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("order", order).withColumns({
        "left_g": F.sum("g").over(upto), "left_n": F.sum("n").over(upto), "mask": F.when(
            F.col("feature") < numeric, F.expr("shiftleft(2L, code) - 2")).otherwise(F.bit_or(F.expr("shiftleft(1L, code)")).over(upto))})
    side = F.explode(F.array(F.lit(0), F.lit(1))).alias("missing_left")
    cells = cells.select("*", side).withColumns({
        "left_g": F.col("left_g") + F.col("missing_left") * F.col("no_g"), "left_n": F.col("left_n") + F.col("missing_left") * F.col("no_n"),
        "mask": F.col("mask") + F.col("missing_left")})

    def score(g: Column, n: Column) -> Column:
        g = g.cast("double") / SCALE
        return g * g / (n + F.lit(how.shrink))

    rest_g, rest_n = F.col("all_g") - F.col("left_g"), F.col("all_n") - F.col("left_n")
    gain = (score(F.col("left_g"), F.col("left_n")) + score(rest_g, rest_n) - score(F.col("all_g"), F.col("all_n"))) / 2
    kept = cells.withColumn("gain", gain).filter((F.col("left_n") >= how.leaf_rows) & (rest_n >= how.leaf_rows) & (F.col("gain") > LEAST_GAIN))
    # Of equal gains, the first feature, missing values to the right, the first bin.
    best = F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("missing_left")).alias("m"), (-F.col("code")).alias("c"), "mask", "all_n", "left_n"))
    return kept.groupBy(*node).agg(best.alias("b")).select(
        *node, (-F.col("b.f")).alias("feature"), "b.mask", "b.gain", F.col("b.all_n").alias("n"), "b.left_n")


def _leaves(rows: DataFrame, by: Sequence[str], how: Boosting) -> DataFrame:
    """What each leaf adds; the median is over one model's rows of one route, which the time span bounds."""
    mean = -(F.sum("g").cast("double") / SCALE) / (F.count(F.lit(1)) + F.lit(how.shrink))
    value = F.when(_squared(), mean).otherwise(F.median(F.col("y") - F.col("pred"))) * how.rate
    return rows.groupBy(*by, "node").agg(value.alias("leaf"))


def _scored(state: DataFrame, before: DataFrame | None, by: Sequence[str], number: int, how: Boosting) -> DataFrame:
    """Every model's best round so far, whether it is this one, and whether the model goes on.

    A model without rows to decide on goes on to the last round.
    """
    error = F.sum(F.when(F.col("kind") == STOP, fixed(F.abs(F.col("y") - F.col("pred")))))
    now = state.filter(F.col("kind") != EVAL).groupBy(*by).agg(error.alias("error"), F.count(F.when(F.col("kind") == FIT, 1)).alias("fit_rows"),
                                                              F.count(F.when(F.col("kind") == STOP, 1)).alias("stop_rows"))
    if before is None:
        return now.withColumns({"best_error": F.col("error"), "best_round": F.lit(number), "improved": F.lit(True), "active": F.col("fit_rows") > 0}).drop("error")
    met = before.drop("improved", "fit_rows", "stop_rows").join(now, list(by), "left")
    improved = F.col("active") & (F.col("error").isNull() | (F.col("error") < F.col("best_error")))
    met = met.withColumn("improved", improved)
    best = F.when(F.col("improved"), F.lit(number)).otherwise(F.col("best_round"))
    rows = before.select(*by, "fit_rows", "stop_rows")
    return met.drop("fit_rows", "stop_rows").withColumns({
        "best_error": F.when(F.col("improved"), F.col("error")).otherwise(F.col("best_error")),
        "active": F.col("active") & (number - best < how.patience), "best_round": best}).drop("error").join(rows, list(by))


def backtest_trees(table: DataFrame, folds: DataFrame, numeric: Sequence[str], texts: Sequence[str], *,
                   keys: Sequence[str] = ("route_id",), target: str = "passengers_sum", how: Boosting = Boosting()) -> Fitted:
    """Fit and predict every key (``keys``), fold and objective.

    ``table`` has a row per slot: keys, timestamp, target and features.  Rows without a target
    are predicted only.  A model without rows to fit predicts nothing.  Intermediates are written while the frames are built,
    one per tree level and round.
    """
    how = replace(how, bins=min(how.bins, MOST_BINS))
    by = ["m", *keys]
    plan = folds.select("fold", "split", "train_end", "eval_end").orderBy("train_end", "fold").collect()  # a few dozen
    first = F.lit(str(min(f["train_end"] for f in plan))).cast("timestamp_ntz")
    known = table.filter((F.col("timestamp") < plus_minutes(first, -1440 * how.stop_days)) & F.col(target).isNotNull())
    codes = bin_codes(numeric, numeric_borders(known, numeric, how.bins), texts, text_values(known, texts, how.bins))
    state = written_once(_start(table, plan, codes, keys, target, how), "trees")
    y = F.col("y")
    base = state.filter(F.col("kind") == FIT).groupBy(*by).agg(F.when(
        _squared(), F.sum(fixed(y)).cast("double") / SCALE / F.count(F.lit(1))).otherwise(F.median(y)).alias("pred"))
    state = state.join(base, by, "left").withColumn("best", F.lit(None).cast("double"))
    models, every = None, []
    for number in range(1, how.trees + 1):
        if models is not None:
            flags = models.select(*by, "improved", "active")
            state = state.join(flags, by).filter(F.col("active") | (F.col("kind") == EVAL)).withColumn(
                "best", F.when(F.col("improved"), F.col("pred")).otherwise(F.col("best"))).drop("improved")
        else:
            state = state.withColumn("active", F.lit(True))
        fit = state.filter(F.col("active") & (F.col("kind") == FIT)).withColumn("g", _gradient())
        splits = None
        for level in range(how.depth):
            found = written_once(best_splits(_routed(fit, splits, by, level), by, len(numeric), how).withColumn("tree", F.lit(number)), "splits")
            splits = found if splits is None else splits.unionByName(found)
        every.append(splits)
        leaves = _leaves(_routed(fit, splits, by, how.depth), by, how)
        moved = _routed(state, splits, by, how.depth).join(leaves, [*by, "node"], "left")
        grown = F.when(F.col("active"), F.col("pred") + F.coalesce(F.col("leaf"), F.lit(0.0))).otherwise(F.col("pred"))
        state = written_once(moved.withColumn("pred", grown).drop("node", "leaf", "active"), "trees")
        models = written_once(_scored(state, models, by, number, how), "models")
        if models.filter("active").isEmpty():
            break
    last = state.filter(F.col("kind") == EVAL).join(models.select(*by, "improved"), by, "left")
    # A model that was never scored (no rows to fit) keeps its null prediction.
    predictions = last.select(*by, "timestamp", F.col("y").alias("y_real"), F.when(F.col("improved"), F.col("pred")).otherwise(F.col("best")).alias("y_pred"))
    names = F.array(*map(F.lit, [*numeric, *texts]))
    splits = reduce(DataFrame.unionByName, every).withColumn("feature", names[F.col("feature")])
    used = models.select(*by, F.col("best_round").alias("trees"), "fit_rows", "stop_rows")
    return Fitted(*(_named(x, plan) for x in (predictions, used, splits)))


def importance_table(models: DataFrame, splits: DataFrame, keys: Sequence[str] = ("route_id",)) -> DataFrame:
    """Mean gain of a feature's splits in the rounds used, averaged over folds and ranked within each model and key."""
    by = ["model", "fold", "split", *keys]
    per_fold = splits.join(models.select(*by, "trees"), by).filter("tree <= trees").groupBy(*by, "feature").agg(F.avg("gain").alias("gain"))
    means = per_fold.groupBy("model", *keys, "feature").agg(F.avg("gain").alias("gain_mean"))
    # Sums of gains in another order may differ in their last digits; those count as equal.
    return means.withColumn("place", F.row_number().over(
        Window.partitionBy("model", *keys).orderBy(F.round("gain_mean", 6).desc(), "feature")))


def tree_counts(models: DataFrame, keys: Sequence[str] = ("route_id",)) -> DataFrame:
    """Trees used per model and key over the folds."""
    return models.groupBy("model", *keys).agg(
        F.count(F.lit(1)).alias("folds"), F.avg("trees").alias("mean"), F.stddev_samp("trees").alias("std"),
        F.min("trees").alias("min"), F.max("trees").alias("max"))

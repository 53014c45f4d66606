"""Approximate nearest neighbours by shifted space-filling curves, for the largest inner product.

Vectors are projected to ``PROJECTED`` dimensions in ``CURVES`` random ways, each with a shift of its own,
and ordered along a Hilbert curve.  Each ordering is range-partitioned and every vector knows its
rank.  A query's candidates are the vectors whose rank in any ordering is within a window of its
own; they are ranked by the exact inner product and the orderings' results merge.

*Window.*  How far neighbours lie apart in the orderings depends on the data, so it is measured: a
bounded sample of queries is searched exhaustively, and the window is the rank distance, in the best
ordering, within which ``TARGET`` of their true neighbours lie.  Clustered vectors get a small window;
vectors without any structure a share of all rows, which no ordering can avoid.

*Bounded work.*  Orderings are cut into cells of queries, and the vectors in the windows around a cell into
pieces; a group is one cell against one piece, streamed.  Ranks are row numbers with ties by id,
so a crowded place on a curve is cut like any other.  Equal vectors are searched as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once
from busloom.llm.common import to_batches
from busloom.llm.vectors import by_length, distinct_vectors, matrix, usable

NEAREST = 20
CURVES = 16
PROJECTED = 8
BITS = 7  # PROJECTED * BITS at most 63
TARGET = 0.95
SAMPLED_QUERIES = 200
CELL = 20_480
PIECE = 65_536
AT_ONCE = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of grid cells (rows of unsigned numbers below 2 ** bits)."""
    x = cells.astype(np.uint64).T.copy()
    one, zero = np.uint64(1), np.uint64(0)
    for level in reversed(range(1, bits)):
        bit = np.uint64(1 << level)
        low = bit - one
        for axis in x:
            high = (axis & bit) != zero
            swap = np.where(high, zero, (x[0] ^ axis) & low)
            x[0] ^= np.where(high, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in reversed(range(1, bits)):
        flip ^= np.where((x[-1] & np.uint64(1 << level)) != zero, np.uint64((1 << level) - 1), zero)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in reversed(range(bits)):
        for axis in x:
            key = key << one | axis >> np.uint64(level) & one
    return key


def curve_keys(points: np.ndarray, spread: float, curves: int, seed: int) -> np.ndarray:
    """Keys of points in every ordering, a row per point.  ``spread``: typical size of one coordinate."""
    random = np.random.default_rng(seed)
    keys = np.empty((len(points), curves), np.int64)
    for c in range(curves):
        axes = np.linalg.qr(random.normal(size=(points.shape[1], min(PROJECTED, points.shape[1]))))[0]
        shift = random.random(axes.shape[1])
        grid = (points @ axes / (8 * spread) + 0.5 + shift / 2) / 1.5 * (1 << BITS)  # 4 spreads to each side, shifted by up to half of that range
        keys[:, c] = hilbert_keys(np.clip(grid, 0, (1 << BITS) - 1), BITS).astype(np.int64)
    return keys


def lifted(vectors: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """One more coordinate, so that the nearest point has the largest inner product with the query."""
    length = np.linalg.norm(vectors, axis=1)
    if query:
        return np.hstack([vectors / length[:, None] * longest, np.zeros((len(vectors), 1))])
    return np.hstack([vectors, np.sqrt(np.maximum(0, longest**2 - length**2))[:, None]])


def _ranks(classes: DataFrame, curves: int, seed: int) -> tuple[DataFrame, int]:
    """curve, cls, query (the class as a query, not as a vector), rank of every point in every ordering; points per ordering."""
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = classes.agg(F.max(squares), F.avg(squares), F.max(F.size("vec")), F.count("*"), F.count_if("asked")).first()
    longest, spread = float(size[0] or 1) ** 0.5, (float(size[1] or 1) / max(1, size[2] or 1)) ** 0.5
    schema = pa.schema([("curve", pa.int32()), ("key", pa.int64()), ("query", pa.bool_()), ("cls", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, AT_ONCE):
                    part = batch.slice(at, AT_ONCE)
                    vectors, names = matrix(part), part.column("cls").to_numpy()
                    asked = part.column("asked").to_numpy(zero_copy_only=False)
                    for query, chosen in ((False, np.ones(len(names), bool)), (True, asked)):
                        if chosen.any():
                            keys = curve_keys(lifted(vectors[chosen], longest, query), spread, curves, seed)
                            for cls, row in zip(names[chosen].tolist(), keys.tolist(), strict=True):
                                yield from ((c, key, query, cls) for c, key in enumerate(row))

        yield from to_batches(rows(), schema)

    keys = classes.select("cls", "vec", "asked").mapInArrow(run, "curve int, key long, query boolean, cls long")
    cut = keys.repartitionByRange("curve", "key", "query", "cls").sortWithinPartitions("curve", "key", "query", "cls")
    numbered = written_once(cut.select("curve", "query", "cls", F.monotonically_increasing_id().alias("id")), "orderings")
    part = F.shiftright("id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    points = size[3] + size[4]
    rank = F.col("offset") + F.col("id").bitwiseAND((1 << 33) - 1) - F.col("curve") * F.lit(points)
    ranked = numbered.withColumn("part", part).join(offsets, "part").select("curve", "cls", "query", rank.alias("rank"))
    return written_once(ranked, "ranks"), points


class Best:
    """The best ``k`` scores of each of some queries, ties to the smaller name."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.row, self.name, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.full(queries, -np.inf)

    def add(self, scores: np.ndarray, names: np.ndarray) -> None:
        bar = self.least
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        row, column = np.nonzero(scores >= bar[:, None])
        row, name, score = np.concatenate([self.row, row]), np.concatenate([self.name, names[column]]), np.concatenate([self.score, scores[row, column]])
        order = np.lexsort((name, -score, row))
        row, name, score = row[order], name[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.name, self.score = row[kept], name[kept], score[kept]
        full = place[kept] == self.k - 1
        self.least[self.row[full]] = self.score[full]

    def rows(self, queries: np.ndarray) -> Iterator[tuple]:
        yield from zip(queries[self.row].tolist(), self.name.tolist(), self.score.tolist(), strict=True)


FOUND = pa.schema([("query", pa.int64()), ("cls", pa.int64()), ("score", pa.float64())])


def _window(classes: DataFrame, ranks: DataFrame, target: float, nearest: int, sampled: int) -> int:
    """Rank distance that holds ``target`` of the true neighbours of a bounded sample of queries."""
    sample = classes.where("asked").orderBy(F.xxhash64("cls"), "cls").limit(sampled).select("cls", "vec").collect()
    if not sample:
        return 0
    asked = np.array([r.vec for r in sample], np.float64)
    names = np.array([r.cls for r in sample], np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), nearest + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                best.add(asked @ matrix(part).T, part.column("cls").to_numpy())
        yield from to_batches(best.rows(names), FOUND)

    found = classes.select("cls", "vec").mapInArrow(search, "query long, cls long, score double").where("query <> cls")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "cls")
    true = found.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= nearest).select(F.col("query").alias("asked"), "cls")
    # At most ``sampled`` * ``nearest`` rows of two numbers, and ``sampled`` rows of one.
    mine = ranks.where("query").join(F.broadcast(true.select("asked").distinct()), F.col("cls") == F.col("asked")).select("asked", "curve", F.col("rank").alias("mine"))
    near = ranks.where("NOT query").join(F.broadcast(true), "cls").select("asked", "cls", "curve", "rank")
    apart = near.join(mine, ["asked", "curve"]).groupBy("asked", "cls").agg(F.min(F.abs(F.col("rank") - F.col("mine"))).alias("apart"))
    return int(apart.agg(F.percentile("apart", target)).first()[0] or 0) + 1


def _searched(classes: DataFrame, ranks: DataFrame, points: int, window: int, nearest: int) -> DataFrame:
    """query, cls, score: the best candidates of each query class in every group of a cell and a piece."""
    cells, last = max(1, -(-points // CELL)), max(0, points - 1)
    vectors = classes.select("cls", "vec")
    corpus = ranks.where("NOT query").join(vectors, "cls").select(
        "curve", F.explode(F.sequence(
            F.greatest(F.lit(0), F.floor((F.col("rank") - window) / CELL)).cast("int"),
            F.least(F.lit(cells - 1), F.floor((F.col("rank") + window) / CELL)).cast("int"))).alias("cell"),
        F.floor(F.col("rank") / PIECE).cast("int").alias("piece"), F.lit(1).alias("kind"), "cls", "vec")
    cell = F.floor(F.col("rank") / CELL)
    queries = ranks.where("query").join(vectors, "cls").select(
        "curve", cell.cast("int").alias("cell"), F.explode(F.sequence(
            F.floor(F.greatest(F.lit(0), cell * CELL - window) / PIECE).cast("int"),
            F.floor(F.least(F.lit(last), (cell + 1) * CELL - 1 + window) / PIECE).cast("int"))).alias("piece"),
        F.lit(0).alias("kind"), "cls", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            current, asked, best = None, None, None  # of the group that is being read
            waiting: list[pa.RecordBatch] = []
            for batch in batches:
                place = np.stack([batch.column(c).to_numpy() for c in ("curve", "cell", "piece", "kind")], 1)
                cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
                for start, end in zip(cuts, cuts[1:]):
                    *key, kind = place[start].tolist()
                    if key != current:
                        if best is not None:
                            yield from best.rows(asked[0])
                        current, asked, best, waiting = key, None, None, []
                    part = batch.slice(start, end - start)
                    if kind == 0:
                        waiting.append(part)
                        continue
                    if waiting:
                        table = pa.Table.from_batches(waiting)
                        asked, waiting = (table.column("cls").to_numpy(), matrix(table)), []
                        best = Best(len(asked[0]), nearest + 1)
                    if best is not None:  # else no query has its window here
                        for at in range(0, part.num_rows, AT_ONCE):
                            some = part.slice(at, AT_ONCE)
                            best.add(asked[1] @ matrix(some).T, some.column("cls").to_numpy())
            if best is not None:
                yield from best.rows(asked[0])

        yield from to_batches(rows(), FOUND)

    keys = ("curve", "cell", "piece")
    return corpus.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "query long, cls long, score double")


def search(
    vectors: DataFrame, asked: Column, nearest: int = NEAREST, curves: int = CURVES, target: float = TARGET,
    sampled: int = SAMPLED_QUERIES, seed: int = 20,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` found for every query, by inner product, ties to the smaller id.

    ``vectors``: vec_id, embedding; ``asked`` is a condition on vec_id.  Candidates are all other
    rows of its length; a query with fewer gets all of them.  Vectors that are null, empty, zero
    or with null or non-finite parts take no part, nor do null ids.  A repeated vec_id is
    one row, with its least vector.  Equal vectors are found with the same score, in order of their ids.
    Other columns are ignored; no vectors or no queries give no rows.  The index is fitted on
    ``sampled`` queries (taken by hash) and holds every row.
    """
    found = written_once(usable(vectors).withColumn("asked", F.coalesce(asked, F.lit(False))), "vectors")
    parts = [_nearest(part, nearest, curves, target, sampled, seed) for part in by_length(found) or [found]]
    return reduce(DataFrame.unionByName, parts)


def _nearest(found: DataFrame, nearest: int, curves: int, target: float, sampled: int, seed: int) -> DataFrame:
    """``search`` among equally long usable vectors (vec_id, vec, asked)."""
    # One more id than is wanted, as a query does not find itself.
    with_queries = found.where("asked").select("vec").distinct().withColumn("asked", F.lit(True))
    classes = written_once(
        distinct_vectors(found.select("vec_id", "vec"), nearest + 1).join(with_queries, "vec", "left").withColumn("asked", F.coalesce("asked", F.lit(False))),
        "classes")
    ranks, points = _ranks(classes, curves, seed)
    window = _window(classes, ranks, target, nearest, sampled)
    scored = _searched(classes, ranks, points, window, nearest).groupBy("query", "cls").agg(F.max("score").alias("score"))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))).where(F.col("n") <= nearest + 1)
    named = best.join(classes.select("cls", "ids"), "cls").select("query", "score", F.explode("ids").alias("vec_id"))
    # At most (nearest + 1) squared entries, of which the first nearest + 1 stay.
    entry = F.struct((-F.col("score")).alias("low"), F.col("vec_id"))
    lists = named.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, nearest + 1).alias("list"))
    of_class = classes.where("asked").select("vec", F.col("cls").alias("query"))
    queries = found.where("asked").select("vec_id", "vec").join(of_class, "vec").select(F.col("vec_id").alias("query_id"), "query")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    return queries.join(lists, "query").select("query_id", F.posexplode(others).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.low")).alias("score"))

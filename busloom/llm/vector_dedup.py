"""Near-duplicate vectors by a subspace pigeonhole join, verified exactly by cosine.

Unit vectors with cosine c have squared distance 2 - 2c, which a rotation keeps.  The rotated coordinates are dealt
into ``BLOCKS`` blocks; if two vectors are within the budget 2 - 2 * ``cosine``, then in at least one block they are
within the share of the budget that goes with the block's dimensions.  So each block is range-joined on its own:

* The rotation is to the principal axes of all vectors, dealt to the blocks in turn, so that every block has its
  part of the spread.  Cells for the range join come from a tree of splits, each on the axis and at the place that saves most
  work, estimated on a bounded sample: between clusters where there are any, and none where more copies of vectors within the radius
  of the border would be shipped than comparisons saved.  So cells follow the data, and their number grows with it.
* A vector lies in one cell and visits those later cells that its radius touches, so every pair of a block
  meets once, whatever the splits are.  Cells are cut into chunks and joined chunk by chunk: a crowded cell is many tasks'
  groups.
* The task that finds a pair within a block's budget leaves it to the first block that finds it, and verifies the
  cosine on the original vectors in double precision.  Counts of links and a spanning forest leave the task,
  never all pairs.

Equal vectors are one class with a count.  Components follow from the forests' links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.functions.reuse import written_once
from busloom.llm.common import blocks_for, components, grouped, to_batches
from busloom.llm.vectors import by_length, distinct_vectors, matrix, usable

COSINE = 0.95
BLOCKS = 4
SAMPLED = 32_768  # vectors that the splits are fitted on, and at most so many bytes of them
SAMPLED_BYTES = 64 << 20
LEAF = 48  # sampled vectors below which a cell is not split
COPY_COST = 2000  # comparisons that take as long as shipping one more copy of a vector
QUANTILES = np.linspace(0.05, 0.95, 13)
CHUNK = 8192
PAIRS_AT_ONCE = 50_000
SLACK = 1e-9  # on squared distances, far above rounding; pairs are verified exactly afterwards


@dataclass(frozen=True)
class Subspaces:
    axes: np.ndarray  # columns are the rotated axes, block after block
    bounds: list[tuple[int, int]]
    budgets: list[float]

    def rotated(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors in rotated coordinates; each row's numbers do not depend on what else is in the batch."""
        unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
        return np.einsum("ij,jk->ik", unit, self.axes)


def fit_subspaces(classes: DataFrame, cosine: float, blocks: int) -> Subspaces | None:
    """Principal axes from the second moments of all unit vectors, summed in tasks (one square matrix each)."""
    schema = pa.schema([("moments", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch, scaled=True)
                unit = v / np.linalg.norm(v, axis=1)[:, None]
                augmented = np.hstack([unit, np.ones((len(unit), 1))])
                total = augmented.T @ augmented + (0 if total is None else total)
        yield from to_batches([] if total is None else [(total.tobytes(),)], schema)

    # One matrix per task; merged on the way to the driver one by one.
    total = None
    for row in classes.select("vec").mapInArrow(run, "moments binary").toLocalIterator():
        part = np.frombuffer(row.moments)
        total = part if total is None else total + part
    if total is None:
        return None
    d = int(round(len(total) ** 0.5)) - 1
    total = total.reshape(d + 1, d + 1)
    mean = total[:d, d] / total[d, d]
    spread, axes = np.linalg.eigh(total[:d, :d] / total[d, d] - np.outer(mean, mean))
    axes = axes[:, np.argsort(-spread, kind="stable")]
    blocks = max(1, min(blocks, d))
    dealt = [list(range(b, d, blocks)) for b in range(blocks)]
    starts = np.cumsum([0, *map(len, dealt)]).tolist()
    budget = max(0.0, 2 - 2 * cosine)
    return Subspaces(axes[:, [i for b in dealt for i in b]], list(zip(starts, starts[1:])), [budget * len(b) / d for b in dealt])


@dataclass(frozen=True)
class Splits:
    """A block's tree: inner node i sends rows with ``axis[i]`` up to ``border[i]`` to ``low[i]``, others to ``high[i]``; a child below 0 is cell -1 - child."""

    axis: list[int]
    border: list[float]
    low: list[int]
    high: list[int]

    def cells(self, points: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(cell, rows, whether at home there) of the cells that hold or are touched by any point."""
        waiting = [(0 if self.axis else -1, np.arange(len(points)), np.ones(len(points), bool))]
        while waiting:
            node, rows, home = waiting.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -1 - node, rows, home
                continue
            off = points[rows, self.axis[node]] - self.border[node]
            for child, side, reach in ((self.low[node], off <= 0, off <= radius), (self.high[node], off > 0, off >= -radius)):
                waiting.append((child, rows[reach], (home & side)[reach]))


def fit_splits(points: np.ndarray, radius: float, total: int) -> Splits:
    """Split where it saves most work for ``total`` vectors distributed as a sample's points, as long as it saves any.

    Work is comparisons and copies: the vectors below a border and within the radius of it visit the cells above.
    """
    scale = total / max(1, len(points))
    axis: list[int] = []
    border: list[float] = []
    children: list[list[int]] = [[], []]
    cells = 0
    waiting = [(points, None)]  # the points of a node, and where its number goes
    while waiting:
        inside, place = waiting.pop()
        n, best = len(inside), None
        if n >= 2 * LEAF:
            ordered = np.sort(inside, axis=0)
            for a in range(inside.shape[1]):
                line = ordered[:, a]
                at = np.unique(np.quantile(line, QUANTILES))
                # Borders in the middle of a gap, so that the fewest lie near them.
                after = np.searchsorted(line, at, "right")
                at = (at + line[np.minimum(after, n - 1)]) / 2
                low = np.searchsorted(line, at, "right")
                near = low - np.searchsorted(line, at - radius, "left")
                cost = scale * (low * low / 2 + (n - low) * (n - low) / 2 + near * (n - low)) + COPY_COST * near
                k = int(cost.argmin())
                if LEAF <= low[k] <= n - LEAF and (best is None or cost[k] < best[0]):
                    best = (cost[k], a, float(at[k]))
        if best is None or best[0] >= scale * n * n / 2:
            number = -1 - cells
            cells += 1
        else:
            number = len(axis)
            axis.append(best[1])
            border.append(best[2])
            for side in children:
                side.append(0)
            left = inside[:, best[1]] <= best[2]
            waiting += [(inside[~left], (1, number)), (inside[left], (0, number))]
        if place is not None:
            children[place[0]][place[1]] = number
    return Splits(axis, border, *children)


def fit_cells(classes: DataFrame, spaces: Subspaces) -> list[Splits]:
    """Every block's splits, from a bounded sample of distinct vectors taken by hash."""
    rows = min(SAMPLED, max(2 * LEAF, SAMPLED_BYTES // (8 * max(1, len(spaces.axes)))))
    found = classes.orderBy(F.xxhash64("cls"), "cls").limit(rows).select("vec").toArrow()
    points = spaces.rotated(matrix(found, scaled=True))
    total = classes.count()
    return [fit_splits(points[:, s:e], (g + 2 * SLACK) ** 0.5, total) for (s, e), g in zip(spaces.bounds, spaces.budgets, strict=True)]


def _placed(classes: DataFrame, spaces: Subspaces, splits: list[Splits]) -> DataFrame:
    """block, cell, home, cls for the cell that each vector lies in (home) and the later ones it visits."""
    schema = pa.schema([("block", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("cls", pa.int64())])
    shared = classes.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, names = spaces.rotated(matrix(batch, scaled=True)), batch.column("cls").to_numpy()
            for b, ((start, end), budget, tree) in enumerate(zip(spaces.bounds, spaces.budgets, shared.value, strict=True)):
                found = list(tree.cells(points[:, start:end], (budget + 2 * SLACK) ** 0.5))
                own = np.zeros(len(names), np.int64)
                for cell, rows, home in found:
                    own[rows[home]] = cell
                for cell, rows, home in found:
                    kept = home | (own[rows] < cell)
                    n = int(kept.sum())
                    if n:
                        columns = (np.full(n, b, np.int32), np.full(n, cell, np.int32), home[kept], names[rows[kept]])
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return classes.select("cls", "vec").mapInArrow(run, "block int, cell int, home boolean, cls long")


def compared_pairs(placed: DataFrame) -> int:
    """How many pairs the cells leave to be compared, all blocks together."""
    sizes = placed.groupBy("block", "cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    return int(sizes.agg(F.sum(F.expr("h * (h - 1) / 2 + h * v"))).first()[0] or 0)


def _forest(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those of the links (a, b) that join two parts which were apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = find(x), find(y)
        if u != v:
            root[u] = v
            yield x, y


def _links(pairs: DataFrame, spaces: Subspaces, cosine: float) -> DataFrame:
    """Rows (a, b null, n links of a) and (a, b, null) of a forest, from groups of (block, cell, first, second)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def verified(block: int, x: pa.Table, y: pa.Table | None) -> Iterator[tuple]:
        """Links between the rows of x and of y, or among x."""
        inside = y is None
        y = x if inside else y
        vx, vy = matrix(x, scaled=True), matrix(y, scaled=True)
        px, py = spaces.rotated(vx), spaces.rotated(vy)
        lx, ly = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (vx, vy))
        names_x, names_y = x.column("cls").to_numpy(), y.column("cls").to_numpy()
        copies_x, copies_y = x.column("copies").to_numpy(), y.column("copies").to_numpy()
        start, end = spaces.bounds[block]
        bx, by = px[:, start:end], py[:, start:end]
        count: dict[int, int] = {}
        square_y = (by * by).sum(1)
        step = max(1, PAIRS_AT_ONCE // max(1, len(vy)))
        linked_a, linked_b = [], []
        for at in range(0, len(vx), step):
            some = bx[at : at + step]
            near = (some * some).sum(1)[:, None] + square_y[None, :] - 2 * some @ by.T <= spaces.budgets[block] + 2 * SLACK
            i, j = np.nonzero(near)
            i += at
            keep = i < j if inside else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            # The same sums for a pair wherever it meets, so that exactly one block keeps it.
            within = [((px[i, s:e] - py[j, s:e]) ** 2).sum(1) <= g + SLACK for (s, e), g in zip(spaces.bounds[: block + 1], spaces.budgets, strict=False)]
            first = within[block] & ~np.any(within[:block], axis=0) if block else within[0]
            i, j = i[first], j[first]
            close = np.einsum("ij,ij->i", vx[i], vy[j]) / (lx[i] * ly[j]) >= cosine
            i, j = i[close], j[close]
            for names, copies, rows in ((names_x, copies_y[j], i), (names_y, copies_x[i], j)):
                sums = np.bincount(rows, copies, len(names))
                for r in np.flatnonzero(sums):
                    count[int(names[r])] = count.get(int(names[r]), 0) + int(sums[r])
            linked_a.append(names_x[i])
            linked_b.append(names_y[j])
        for name, n in count.items():
            yield name, None, n
        for a, b in _forest(np.concatenate(linked_a), np.concatenate(linked_b)):
            yield a, b, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (block, _, first, second), table in grouped(batches, "block", "cell", "first", "second"):
                side = np.array(table.column("chunk").to_pylist())
                if first == second:
                    if table.num_rows > 1:
                        yield from verified(block, table, None)
                elif (side == first).any() and (side == second).any():
                    yield from verified(block, table.filter(pa.array(side == first)), table.filter(pa.array(side == second)))

        yield from to_batches(rows(), schema)

    keys = ("block", "cell", "first", "second")
    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long")


def _chunked(placed: DataFrame, chunk: int) -> DataFrame:
    """block, cell, first, second, chunk, cls: every pair of chunks of a cell of which one holds vectors at home.

    Chunks of homes are numbered from 0, chunks of visitors from -1 down; visitors are not joined with each
    other, they meet where one of them is at home.
    """
    sizes = placed.groupBy("block", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors")).where("homes > 0")
    sizes = sizes.select("block", "cell", blocks_for(F.col("homes"), chunk).alias("h"), F.when(F.col("visitors") > 0, blocks_for(F.col("visitors"), chunk)).otherwise(0).alias("v"))
    part = F.pmod(F.xxhash64("cls", "block"), F.when(F.col("home"), F.col("h")).otherwise(F.col("v"))).cast("int")
    known = placed.join(sizes, ["block", "cell"]).withColumn("chunk", F.when(F.col("home"), part).otherwise(-1 - part))
    others = F.sequence(F.when(F.col("home"), -F.col("v")).otherwise(F.lit(0)), F.col("h") - 1)
    met = known.select("block", "cell", "cls", "chunk", F.explode(others).alias("other"))
    return met.select("block", "cell", "cls", "chunk", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"))


def dedup_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding).

    n_links counts the other vectors with a cosine of ``cosine`` or more, component_id is the
    smallest vec_id reachable by links, kept says whether the vector is that one.  Vectors that are
    null, empty, zero or with null or non-finite parts link with nothing and are
    their own component, vectors of different lengths do not link; a null vec_id has a null component and is not kept.  A repeated vec_id is one
    vector (the least, if they differ).  Other columns are ignored; an empty table gives no rows.
    Intermediates are written while the frame is built.
    """
    found = written_once(usable(vectors), "vectors")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    results = [_linked(part, cosine, blocks, chunk) for part in by_length(found)]
    result = reduce(DataFrame.unionByName, results) if results else found.select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return ids.join(result, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


def _linked(found: DataFrame, cosine: float, blocks: int, chunk: int) -> DataFrame:
    """vec_id, n_links, component_id of equally long usable vectors."""
    classes = written_once(distinct_vectors(found, 1).select("cls", "vec", "copies"), "classes")
    spaces = fit_subspaces(classes, cosine, blocks)
    placed = written_once(_placed(classes, spaces, fit_cells(classes, spaces)), "cells")
    pairs = _chunked(placed, chunk).join(classes, "cls")
    links = written_once(_links(pairs, spaces, cosine), "links")
    counts = links.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "cls")
    roots = components(links.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"node": "cls", "component": "root"})
    named = classes.join(counts, "cls", "left").join(roots, "cls", "left").select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("component_id"))
    return found.join(named, "vec").select("vec_id", "n_links", "component_id")

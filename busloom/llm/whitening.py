"""Whitening of vectors by shifted CholeskyQR: repeated Gram passes over centred rows, then an SVD of the small factor.

Entries become whole numbers (``floor(SCALE * c)``), so sums are exact and centring loses nothing: n * x - S is a whole
number, and the centred entry is that divided by n.  Adding the same number to every entry changes no
centred value, so ``OFFSET`` is left out of the work.

With X the centred rows, each round takes the Gram matrix of X after the triangular solves so far, factors it
(Cholesky, with a shift where it is close to singular, as it is in the first round) and adds the factor:

* a *pass* is one look at all rows: every task solves its rows against the factors and adds up its own Gram
  matrix, a row of it per key; rows with the same key meet and are added as they arrive, so nothing but d rows
  of d numbers reaches the driver, whatever the number of vectors or tasks;
* two rounds make rows orthonormal for all but extreme data, and passes go on until every direction has
  length 1 or, after two rounds, none at all;
* the composed factor R holds all of X's second moments: its right singular vectors are the components and its squared
  singular values over n their variances, each accurate to the factor's own precision rather than to that
  of a covariance matrix, which would square the condition number.

A last pass measures how far the whitened rows' covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.llm.common import to_batches
from busloom.llm.vectors import matrix

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000  # of the contract's x; every result here is free of it
ROUNDS = 8
NULL_LENGTH = 1e-9  # squared length of a direction that two shifted rounds did not raise
STRAIGHT = 1e-10  # how near to 1 a direction's squared length must be
LEAST_SPREAD = 1e-11  # of the widest component's; below lies rounding
ROWS_BYTES = 8 << 20  # doubles of the rows worked on at once in a task
WHOLE = 1 << 62

PARTIAL = pa.schema([("i", pa.int32()), ("sums", pa.binary())])


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` vectors: ``sums`` of the scaled entries, ``axes`` (d x k, unit columns), their variances and shares."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (doubles): rows whose vector has only finite entries, and the most common length (of two, the longer).

    Vectors of another length span another space and take no part; nor do those with an entry
    beyond 2**56, which is no 64-bit number once scaled.  Zero vectors, repeated rows and null ids do.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where(
        "vec IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 72057594037927936D)")
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vec") == (common["d"] if common else 0))


def exact_sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """The number of vectors and the exact sum of each scaled entry; one row per dimension reaches the driver."""
    whole = F.transform("vec", lambda x: F.floor(x * SCALE).cast("long"))
    # Upper and lower halves are added apart, so that no sum leaves 64 bits.
    parts = rows.select(F.posexplode(whole).alias("i", "x")).groupBy("i").agg(
        F.count("*").alias("n"), F.sum(F.shiftright("x", 31)).alias("high"), F.sum(F.col("x").bitwiseAND(F.lit((1 << 31) - 1))).alias("low"))
    found = sorted(tuple(r) for r in parts.collect())
    return (found[0][1] if found else 0), tuple((high << 31) + low for _, _, high, low in found)


def deviations(vec: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - S as whole numbers: 64-bit ones where they fit, else Python's."""
    x = np.floor(vec * SCALE).astype(np.int64)
    largest = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * n + max(map(abs, sums), default=0)
    if largest < WHOLE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows * inverse of an upper triangular factor, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    size = max(1, ROWS_BYTES // (8 * dims))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def gram(rows: DataFrame, n: int, sums: tuple[int, ...], mapped: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The Gram matrix (``width`` x ``width``) of the centred rows after ``mapped``; one pass over all rows."""
    dims = len(sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in _slices(batches, dims):
            q = mapped(deviations(matrix(part), n, sums).astype(float) / n)
            total = q.T @ q + (0 if total is None else total)
        if total is not None:
            yield from to_batches(((i, total[i].tobytes()) for i in range(width)), PARTIAL)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sums_of in zip(batch.column("i").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                row = np.frombuffer(sums_of)
                totals[i] = totals[i] + row if i in totals else row
        yield from to_batches(((i, row.tobytes()) for i, row in totals.items()), PARTIAL)

    ddl = "i int, sums binary"
    out = np.zeros((width, width))
    for i, row in rows.select("vec").mapInArrow(partial, ddl).repartition("i").mapInArrow(added, ddl).collect():
        out[i] = np.frombuffer(row)
    return (out + out.T) / 2


def cholesky_factor(g: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper triangular R with R'R = g, or g + shift * I; the shift grows until there is such a factor."""
    d = len(g)
    least = 11 * d * (d + 1) * np.finfo(float).eps * np.linalg.norm(g, 2)
    shift = least if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(least, 10 * shift)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on all ``rows`` (as ``usable_vectors`` gives them).

    Components are numbered by falling variance; there are fewer than ``components`` if the vectors
    span fewer directions (a variance of zero cannot be scaled to one).  The largest entry of each is
    positive.  What the driver holds are matrices of the vectors' length squared.
    """
    n, sums = exact_sums(rows)
    d = len(sums)
    empty = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0)
    if not n:
        return empty
    factors: list[np.ndarray] = []
    composed = np.eye(d)
    for number in range(ROUNDS):
        kept = tuple(factors)

        def orthogonal(q: np.ndarray, kept: tuple[np.ndarray, ...] = kept) -> np.ndarray:
            for factor in kept:
                q = solved(q, factor)
            return q

        g = gram(rows, n, sums, orthogonal, d)
        if not g.any():
            return empty
        lengths, directions = np.linalg.eigh(g)
        if number >= 2 and all(abs(x - 1) <= STRAIGHT or x <= NULL_LENGTH for x in lengths):
            break
        factors.append(cholesky_factor(g, number == 0))
        composed = factors[-1] @ composed
    # What the last pass still found to differ from the identity goes into the factor as well.
    last = np.sqrt(np.maximum(lengths, 0))[:, None] * directions.T @ composed
    _, spread, axes = np.linalg.svd(last)
    k = min(components, int((spread > LEAST_SPREAD * spread[0]).sum()))
    axes = axes[:k].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(k)])
    variances = spread[:k] ** 2 / n
    scaled = axes / np.sqrt(variances)
    found = gram(rows, n, sums, lambda q: q @ scaled, k) / n
    return Whitening(n, sums, axes, variances, spread[:k] ** 2 / (spread**2).sum(), float(np.abs(found - np.eye(k)).max(initial=0)))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened: for each row the exact sum of (n * x - S)**2 (null beyond 64 bits) and its whitened coordinates.

    The model (a matrix of vector length x components) is broadcast; nothing is shuffled.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    dims = max(1, len(model.sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        scaled = fitted.axes / np.sqrt(fitted.variances)
        k = scaled.shape[1]
        for part in _slices(batches, dims):
            whole = deviations(matrix(part), fitted.n, fitted.sums)
            if whole.dtype == object or int(np.abs(whole).max(initial=0)) ** 2 * dims >= 1 << 63:
                deviation = [x if x < 1 << 63 else None for x in (whole.astype(object) ** 2).sum(1).tolist()]
            else:
                deviation = (whole**2).sum(1)
            values = (whole.astype(float) / fitted.n) @ scaled
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * k + 1, k) if k else np.zeros(len(values) + 1), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "vec").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row per vector and component.

    Input: vec_id and embedding; other columns are ignored.  Vectors that are null, empty, hold null or
    non-finite entries, or do not have the most common length take no part; repeated rows count and come back
    each time.  An empty table, or vectors that are all equal, give no rows.  The passes run while the frame is built.
    """
    rows = usable_vectors(vectors)
    model = fit(rows, components)
    shares = F.array(*(F.lit(float(x)) for x in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    return whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))

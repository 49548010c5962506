"""Whitening of vectors by leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed: its product with a few vectors is one Spark job in which every task
centres its rows, multiplies, and sums; the sums of the tasks are added by a shuffle, so the driver
gets one small matrix whatever the number of rows. The eigenvectors come from a search space that
grows by solutions of the projected correction equation

    (I - QQ') (A - e I) (I - QQ') t = -r

for every pair not yet found, solved by a few steps of MINRES; all pairs take their steps together,
so a step costs one job. Rayleigh-Ritz in the space gives the next pairs; those whose residual is at
double precision are locked, and at the end all residuals are checked by a fresh product.

Entries are scaled and floored to whole numbers, so the sums are exact and centring is one exact
subtraction and one of a fraction.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, as are
rows whose vector has another length than most (ties: the longer); equal rows are all kept;
components without variance (fewer different rows than dimensions) are left out, so one row, equal
rows or an empty table give none. Columns other than the key and the vector are not read, so
clashing names do no harm; a null key is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import cut_lineage

SCALE, SHIFT = 1_024, 100_000
EPS = float(np.finfo(float).eps)
INNER_STEPS, MOST_ROUNDS, SEED = 4, 60, 20240311


def whole_entries(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * entry) + shift of every entry."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + shift)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """Lists of one length as a matrix of whole numbers."""
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Centre:
    """Means S / n kept as whole part and rest, so that x - S / n is rounded once."""

    def __init__(self, sums: list[int], n: int):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)², exact."""
        steps = x - self.whole
        most = (int(np.abs(steps).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            off = steps * self.n - self.rest
            return pa.array((off * off).sum(1)).cast(pa.decimal128(38, 0))
        off = steps.astype(object) * self.n - self.rest.astype(object)
        return pa.array([Decimal(v) for v in (off * off).sum(1)], pa.decimal128(38, 0))


def summed(rows: DataFrame, step: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray | list[int]:
    """Sum over all batches of what ``step`` gives for a matrix of rows, flattened.

    Tasks add up their own batches, a shuffle adds up the tasks; the driver gets one value a place.
    """
    kind = "bigint" if whole else "double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = step(matrix(batch)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    value = F.col("value").cast("decimal(19,0)") if whole else F.col("value")
    places = rows.select("x").mapInArrow(partial, f"place bigint, value {kind}").groupBy("place").agg(F.sum(value).alias("value"))
    found = sorted((r.place, r.value) for r in places.collect())
    return [int(v) for _, v in found] if whole else np.array([v for _, v in found])


def covariance_product(rows: DataFrame, centre: Centre) -> Callable[[np.ndarray], np.ndarray]:
    """B -> covariance times B, one job each."""

    def product(b: np.ndarray) -> np.ndarray:
        def step(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ b)

        return summed(rows, step).reshape(b.shape) / centre.n

    return product


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The part of ``block`` that is orthogonal to ``against``, as orthonormal columns."""
    kept = np.zeros((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size:
            continue
        v = column / size
        for _ in range(3):
            for q in (against, kept):
                v = v - q @ (q.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10:
            v /= left
            for q in (against, kept):
                v = v - q @ (q.T @ v)
            kept = np.column_stack([kept, v / np.linalg.norm(v)])
    return kept


def minres(product: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int) -> np.ndarray:
    """``steps`` of MINRES from zero for every column of ``rhs``; all columns share one product a step."""
    beta = np.linalg.norm(rhs, axis=0)
    safe = lambda d: np.where(d == 0, 1, d)
    v, before = rhs / safe(beta), np.zeros_like(rhs)
    x, w, w_before = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    cos, cos_before = np.ones(rhs.shape[1]), np.ones(rhs.shape[1])
    sin, sin_before, eta = np.zeros(rhs.shape[1]), np.zeros(rhs.shape[1]), beta.copy()
    last = np.zeros(rhs.shape[1])
    for _ in range(steps):
        y = product(v)
        alpha = (v * y).sum(0)
        y = y - alpha * v - last * before
        size = np.linalg.norm(y, axis=0)
        # two earlier rotations on the new column, then the one that makes its last entry zero
        delta = cos * alpha - cos_before * sin * last
        above, far = sin * alpha + cos_before * cos * last, sin_before * last
        long = np.hypot(delta, size)
        cos_before, sin_before = cos, sin
        cos, sin = np.where(long > 0, delta / safe(long), 1), np.where(long > 0, size / safe(long), 0)
        w, w_before = np.where(long > 0, (v - above * w - far * w_before) / safe(long), 0), w
        x = x + cos * eta * w
        eta = -sin * eta
        before, v, last = v, y / safe(size), size
    return x


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, inner: int = INNER_STEPS, rounds: int = MOST_ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and their unit eigenvectors as columns."""
    wanted = min(wanted, size)
    none = np.zeros((size, 0))
    space = orthonormal(np.random.default_rng(SEED).standard_normal((size, min(size, 2 * wanted))), none)
    image, locked, best = product(space), none, np.inf
    widest, narrow, stalled = min(size, max(12 * wanted, 64)), 4 * wanted, 0
    for _ in range(rounds):
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max(values[0] if len(values) else 0, EPS)
        if locked.shape[1]:
            top = max(top, largest)
        enough = EPS * 16 * np.sqrt(size) * top
        open_ = wanted - locked.shape[1]
        residual = image[:, :open_] - values[:open_] * space[:, :open_]
        residual -= locked @ (locked.T @ residual)
        far = np.linalg.norm(residual, axis=0)
        done = int(np.argmin(np.append(far <= enough, False)))
        stalled = stalled + 1 if far.max(initial=0) > best / 2 else 0
        best = min(best, far.max(initial=0))
        if stalled >= 6 and far.max(initial=0) <= 64 * enough:
            done = open_  # rounding of the sums leaves no more
        if done:
            largest = top
            locked = np.column_stack([locked, space[:, :done]])
            space, image, residual, values = space[:, done:], image[:, done:], residual[:, done:], values[done:]
            open_, best, stalled = open_ - done, np.inf, 0
        if not open_:
            fresh = product(locked)
            small = locked.T @ fresh
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, vectors = values[::-1], (locked @ turn)[:, ::-1]
            off = np.linalg.norm((fresh @ turn)[:, ::-1] - vectors * values, axis=0).max()
            if off > 256 * enough:
                raise ArithmeticError(f"a residual of {off} is left, {enough} was wanted")
            return values, vectors
        if space.shape[1] + open_ + locked.shape[1] > widest and space.shape[1] > narrow and widest < size:
            space, image = space[:, :narrow], image[:, :narrow]
        ritz, values = space[:, :open_], values[:open_]
        fixed = np.column_stack([locked, ritz])
        apart = lambda b: b - fixed @ (fixed.T @ b)  # noqa: E731, B023
        moved = minres(lambda b: apart(product(apart(b)) - values * apart(b)), -apart(residual), inner)  # noqa: B023
        new = orthonormal(moved, np.column_stack([locked, space]))
        if not new.shape[1]:
            more = np.random.default_rng(SEED + space.shape[1]).standard_normal((size, open_))
            new = orthonormal(more, np.column_stack([locked, space]))
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, product(new)])
    raise ArithmeticError(f"no convergence in {rounds} rounds; a residual of {best} is left")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row per usable vector
    and component; ``deviation`` is decimal(38, 0)."""
    v = F.col(vector)
    rows = df.where(usable(v)).select(F.col(key).alias("key"), whole_entries(v).alias("x"))
    rows = cut_lineage(rows, "whitening-rows")
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size, n = (common["size"], common["count"]) if common else (0, 0)
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not size:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    rows = rows.where(F.size("x") == size)
    centre = Centre(summed(rows, lambda x: x.sum(0), whole=True), n)
    trace = float(summed(rows, lambda x: np.array([(centre(x) ** 2).sum()]))[0]) / n
    if not trace:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    values, vectors = jacobi_davidson(covariance_product(rows, centre), size, components)
    real = values > values[0] * EPS * 64 * size
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    scaled = vectors / np.sqrt(values)

    def second_moments(x: np.ndarray) -> np.ndarray:
        w = centre(x) @ scaled
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    moments, k = summed(rows, second_moments) / n, len(values)
    spread = moments[k:].reshape(k, k) - np.outer(moments[:k], moments[:k])
    error = float(np.abs(spread - np.eye(k)).max())
    shares = values / trace

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch)
                w, rows = centre(x) @ scaled, np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index("key")).take(pa.array(rows)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(rows), n)),
                        centre.deviation(x).take(pa.array(rows)),
                        pa.array(w.ravel()),
                        pa.array(np.tile(shares, len(x))),
                        pa.array(np.full(len(rows), error)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(whitened, schema).withColumnRenamed("key", key)

"""Whitening of embeddings: the leading components of the covariance by block Jacobi-Davidson, without forming the covariance.

The covariance V is only ever applied to a block of vectors, in one pass over the distributed fit list. Each round takes the
Ritz pairs of the search space (Rayleigh-Ritz), locks those whose residual has reached double precision, and widens the space by
corrections t of the next ones: the solutions of (I - QQ')(V - e)(I - QQ') t = -r, where Q holds the locked vectors and the
Ritz vectors of the block, by a few steps of MINRES, each step one pass for all of them. A space that grows too wide starts
anew from its best Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.storage import materialize
from parchment.runtime import ship

#: x = floor(64 * c) + 1000000
SCALE, SHIFT = 64.0, 1_000_000
#: greatest absolute x: beyond, doubles skip whole numbers
LARGEST = 1 << 53
#: bytes of vectors in one row of the fit list
BLOCK_BYTES = 1 << 19
_HALF = (1 << 26) - 1


@dataclass(frozen=True)
class Solver:
    """Components, MINRES steps for a correction, greatest rounds and width of the search space in blocks, and the seed of the first space."""

    components: int = 16
    inner: int = 5
    rounds: int = 60
    widest: int = 5
    seed: int = 11


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what the columns of new add to the given orthonormal bases; columns that add nothing are left out."""
    for q in (*against, *against):
        new = new - q @ (q.T @ new)
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-8]
    for q in (*against, *against):
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def minres(product: Callable[[np.ndarray], np.ndarray], shifts: np.ndarray, rhs: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Columns t with project(product(t) - shift * t) near rhs after some steps of MINRES, all columns at once; rhs lies in the projection."""
    t = np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    safe = lambda x: np.where(x == 0, 1.0, x)
    v_old, v = np.zeros_like(rhs), rhs / safe(beta)
    d_old, d = np.zeros_like(rhs), np.zeros_like(rhs)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, beta_v = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        y = project(product(v) - shifts * v)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - beta_v * v_old
        beta_next = np.linalg.norm(y, axis=0)
        # the last two rotations on the new column of the tridiagonal matrix, then the one that clears its last entry
        high, middle = s_old * beta_v, c_old * beta_v
        upper, low = c * middle + s * alpha, c * alpha - s * middle
        size = np.hypot(low, beta_next)
        c_new, s_new = low / safe(size), beta_next / safe(size)
        d_old, d = d, np.where(size > 0, (v - upper * d - high * d_old) / safe(size), 0.0)
        t = t + eta * c_new * d
        eta = -s_new * eta
        v_old, v = v, y / safe(beta_next)
        beta_v, c_old, c, s_old, s = beta_next, c, c_new, s, s_new
    return t


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, solver: Solver = Solver()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: B008
    """(eigenvalues from the greatest, unit eigenvectors as columns, residual norms) of a symmetric matrix of which only the product is known.

    Residuals are at most d * eps times the greatest eigenvalue, or as small as rounding in the product lets them become.
    """
    k = min(solver.components, d)
    block = min(k, d)
    rng = np.random.default_rng(solver.seed)
    space = _orthonormal(rng.standard_normal((d, block)))
    image = product(space)
    locked, values, residuals = np.zeros((d, 0)), [], []
    best, stuck = np.inf, 0
    for _ in range(solver.rounds):
        small = space.T @ image
        theta, u = np.linalg.eigh((small + small.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        ritz, mapped = space @ u, image @ u
        rest = mapped - ritz * theta
        size = np.linalg.norm(rest, axis=0)
        scale = max([*values[:1], theta[0], np.finfo(float).tiny])
        goal = d * np.finfo(float).eps * scale
        want = k - len(values)
        worst = size[:want].max()
        best, stuck = (worst, 0) if worst < 0.5 * best else (best, stuck + 1)
        full = space.shape[1] + len(values) == d
        # rounding in the products is all that is left where the space is whole or nothing improves
        done = size[:want] <= (goal if not (full or stuck > 4) or worst > 1e-10 * scale else np.inf)
        n = want if done.all() else int(done.argmin())
        if n:
            locked = np.hstack([locked, ritz[:, :n]])
            values += theta[:n].tolist()
            residuals += size[:n].tolist()
            best, stuck = np.inf, 0
            space, image, theta, rest, ritz, mapped = ritz[:, n:], mapped[:, n:], theta[n:], rest[:, n:], ritz[:, n:], mapped[:, n:]
        if len(values) == k:
            break
        if not full:
            if space.shape[1] + block > max(solver.widest * block, 2):
                space, image = ritz[:, : 2 * block], mapped[:, : 2 * block]
            m = min(block, k - len(values), ritz.shape[1])
            q = np.hstack([locked, ritz[:, :m]])
            project = lambda x, q=q: x - q @ (q.T @ x)
            step = minres(product, theta[:m], project(-rest[:, :m]), project, solver.inner)
            new = _orthonormal(step, locked, space)
            if not new.shape[1]:
                new = _orthonormal(rng.standard_normal((d, min(block, d - locked.shape[1] - space.shape[1]))), locked, space)
        else:
            # a whole space: its own products once more, with the base made orthonormal anew
            space, new = space[:, :0], _orthonormal(space, locked)
            image = image[:, :0]
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError(f"{k - len(values)} of {k} components have not converged in {solver.rounds} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    locked = locked[:, order]
    sign = np.sign(locked[np.abs(locked).argmax(axis=0), np.arange(k)])
    return np.array(values)[order], locked * np.where(sign == 0, 1, sign), np.array(residuals)[order]


def _whole(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vector has d finite entries that give whole numbers, their x)."""
    lists = batch.column("vec")
    if lists.offset or isinstance(lists, pa.LargeListArray):
        lists = lists.take(pa.array(np.arange(len(lists))))
    length = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    entries = lists.flatten()
    keep = np.repeat(length == d, np.maximum(length, 0))
    c = entries.cast(pa.float64()).to_numpy(zero_copy_only=False)[keep].reshape(-1, d)  # null entries are NaN
    rows = np.flatnonzero(length == d)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(SCALE * c) + SHIFT
        fine = (np.abs(x) <= LARGEST).all(axis=1)
    return rows[fine], x[fine].astype(np.int64)


def _lattice(d: int):
    """mapInArrow function: vec to x, the bytes of its longs, for usable rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, x = _whole(batch, d)
                offsets = np.arange(len(at) + 1, dtype=np.int32) * (8 * d)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])], ["x"])

    return rows


def _blocker(d: int):
    """mapInArrow function: single x to rows of many, joined."""
    most = max(1, BLOCK_BYTES // (8 * d))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                held += batch.column("x").slice(i, most).to_pylist()
                while len(held) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held[:most])], pa.binary())], ["x"])
                    held = held[most:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["x"])

    return blocks


@dataclass(frozen=True)
class Centre:
    """n vectors with sums S: whole numbers near the means, and n * x - S of those."""

    n: int
    near: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        near = [(2 * s + n) // (2 * n) for s in sums]
        return Centre(n, np.array(near, np.int64), np.array([s - n * m for s, m in zip(sums, near, strict=True)], np.int64))

    def apart(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: of exact whole numbers, one rounding of the small rest."""
        y = (x - self.near).astype(np.float64)
        return y - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - S)^2 of each row; null beyond a long."""
        y = x - self.near
        if np.abs(y).max(initial=0).astype(float) * self.n + self.n < np.sqrt((1 << 62) / max(x.shape[1], 1)):
            return ((self.n * y - self.rest) ** 2).sum(axis=1).tolist()
        rest = self.rest.tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def _totals(fit: DataFrame, f: Callable[[np.ndarray], np.ndarray], d: int, centre: Centre) -> np.ndarray:
    """The sum over all blocks of the fit list of f(centred block), a matrix of at most d rows.

    Tasks add up their blocks; Spark adds the tasks' rows by row number, so the driver gets one matrix, however many tasks there are.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("x"):
                one = f(centre.apart(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, d)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(total[:, j]) for j in range(total.shape[1])]], ["r", *[f"c{j}" for j in range(total.shape[1])]])

    shape = f(np.zeros((1, d))).shape
    names = [f"c{j}" for j in range(shape[1])]
    rows = fit.mapInArrow(part, "r long, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros(shape)
    for r in rows.groupBy("r").agg(*[F.sum(c).alias(c) for c in names]).toArrow().to_pylist():
        out[r["r"]] = [r[c] for c in names]
    return out


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            for raw in batch.column("x"):
                x = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, d)
                n += len(x)
                high += (x >> 26).sum(axis=0)
                low += (x & _HALF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["r", "n", "high", "low"])

    rows = fit.mapInArrow(part, "r long, n long, high long, low long").groupBy("r").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect()
    sums = {r.r: (r.high << 26) + r.low for r in rows}
    return (rows[0].n if rows else 0), [sums.get(i, 0) for i in range(d)]


@dataclass(frozen=True)
class Whitening:
    """Dimensions, centre, eigenvalues (from the greatest, all above rounding), components as columns, trace of the covariance, identity error and residuals."""

    d: int
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residuals: np.ndarray

    @property
    def map(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _width(rows: DataFrame) -> int:
    """The most frequent number of entries; of equally frequent ones the greatest."""
    top = rows.where("vec is not null").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def fit_whitening(vectors: DataFrame, vec_col: str = "embedding", solver: Solver = Solver()) -> Whitening | None:  # noqa: B008
    """Whitening of the distinct lattice vectors of a table; None where no two differ. See whiten for what rows are left out.

    The distinct vectors are written once, in blocks, and every product is a pass over them; the driver holds some matrices of as many
    rows as a vector has entries.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vec_col).alias("vec"))
    d = _width(rows)
    if not d:
        return None
    fit = materialize(rows.mapInArrow(_lattice(d), "x binary").distinct().mapInArrow(_blocker(d), "x binary"), "whitening")
    n, sums = _sums(fit, d)
    if n < 2:
        return None
    centre = Centre.of(n, sums)
    total = lambda f: _totals(fit, f, d, centre)
    trace = float(total(lambda x: np.array([[np.square(x).sum()]]))[0, 0]) / n
    values, vectors_, residuals = jacobi_davidson(lambda w: total(lambda x: x.T @ (x @ w)) / n, d, solver)
    real = values > 8 * d * np.finfo(float).eps * values[0]
    values, vectors_, residuals = values[real], vectors_[:, real], residuals[real]
    to = vectors_ / np.sqrt(values)
    mean = total(lambda x: (x @ to).sum(axis=0, keepdims=True)) / n

    def products(x: np.ndarray) -> np.ndarray:
        z = x @ to - mean
        return z.T @ z

    error = float(np.abs(total(products) / n - np.eye(len(values))).max())
    return Whitening(d, centre, values, vectors_, trace, error, residuals)


def apply_whitening(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each usable row and component: id, component, n, deviation, whitened, explained and identity_error."""
    ship(vectors.sparkSession)
    kind, k, to, share = vectors.schema[id_col].dataType.simpleString(), len(model.values), model.map, model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                at, x = _whole(part, model.d)
                m = len(at)
                z = (model.centre.apart(x) @ to).ravel()
                columns = [
                    part.column("id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.centre.n)),
                    pa.array(model.centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z), pa.array(np.tile(share, m)), pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).mapInArrow(project, schema).withColumnRenamed("id", id_col)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", solver: Solver = Solver()) -> DataFrame:  # noqa: B008
    """A row for each row and component, see apply_whitening; the model is fitted on the distinct vectors when this is called.

    Left out are rows whose vector is null, holds a null or non-finite entry or one whose x is beyond 2^53, or has another length than
    most rows have (of equally frequent lengths the greatest counts). Components whose eigenvalue is not above rounding are left out, as
    nothing can be divided by it; so there are no rows where all vectors are equal or the table is empty. Null ids and repeated rows are
    rows like others, equal vectors count once in the fit, other columns are ignored. A deviation that is no long is null.
    """
    model = fit_whitening(vectors, vec_col, solver)
    if model is None:
        kind = vectors.schema[id_col].dataType.simpleString()
        schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    return apply_whitening(vectors, model, id_col, vec_col)

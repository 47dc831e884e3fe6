"""Whitening against the covariance and its eigenvectors, formed plainly."""

import math

import numpy as np
import pytest

from parchment.llm import queries
from parchment.llm import whitening as W

ROW = "vec_id long, embedding array<float>, component string, n double"


def plain(rows, k=16):
    """(vec_id, component) -> n, deviation, projection on each plain eigenvector over its root, share; from the definition."""
    usable = [(i, v) for i, v in rows if v is not None and not any(c is None or not math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in usable]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    centred = np.array([[(n * v[j] - sums[j]) / n for j in range(d)] for v in fit])
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    out = []
    for i, v in x:
        dev = sum((n * v[j] - sums[j]) ** 2 for j in range(d))
        z = np.array([(n * v[j] - sums[j]) / n for j in range(d)]) @ q / np.sqrt(e)
        out += [(i, c + 1, n, dev, float(z[c]), float(e[c] / np.trace(cov))) for c in range(len(e))]
    return out


def compare(got, want):
    got = sorted([tuple(r) for r in got], key=lambda r: (str(r[0]), r[1], r[3]))
    want = sorted(want, key=lambda r: (str(r[0]), r[1], r[3]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    a, b = np.array([r[4] for r in got]), np.array([r[4] for r in want])
    component = np.array([r[1] for r in got])
    for c in set(component.tolist()):
        x, y = a[component == c], b[component == c]
        assert min(np.abs(x - y).max(), np.abs(x + y).max()) < 1e-8
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] <= 1e-4 for r in got) and len({r[6] for r in got}) == 1


def test_driver_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(queries.QUERIES["op11_embedding_whitening"](spark, sf).collect(), plain(rows))


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).round(3).tolist()) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf")] + [0.0] * 4)]
    again = [rows[0], (None, rows[1][1]), (7, rows[2][1])] + [(200 + i, rows[3][1]) for i in range(60)]
    table = spark.createDataFrame([(i, v, "c", 0.5) for i, v in rows + odd + again], ROW)
    compare(W.whiten(table).collect(), plain(rows + odd + again, 5))
    unusable = [(300, [1.0, 2.0]), (301, []), (302, [1e30, 0.0, 0.0, 0.0, 0.0])]
    more = table.union(spark.createDataFrame([(i, v, "c", 0.5) for i, v in unusable], ROW))
    compare(W.whiten(more).collect(), plain(rows + odd + again, 5))


def test_degenerate_tables(spark):
    table = lambda rows: spark.createDataFrame([(i, v, "c", 0.5) for i, v in rows], ROW)
    assert W.whiten(table([])).count() == 0
    assert W.whiten(table([(1, None)])).count() == 0
    assert W.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]  # one direction varies, so there is one component
    out = W.whiten(table(line)).collect()
    assert {r.component for r in out} == {1} and len(out) == 10 and abs(out[0].explained - 1) < 1e-12


def test_deviations_are_exact():
    x = np.array([[10**12, -(10**12)], [10**12 + 1, 5]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    got = W.Centre.of(2, sums).deviations(x)
    want = [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert got == [v if v < 1 << 63 else None for v in want]
    small = W.Centre.of(3, [7, 8]).deviations(np.array([[1, 2], [3, 4]]))
    assert small == [(3 - 7) ** 2 + (6 - 8) ** 2, (9 - 7) ** 2 + (12 - 8) ** 2]


@pytest.mark.parametrize(("d", "n"), [(64, 900), (3, 10), (150, 600), (40, 12)])
def test_solver_reaches_double_precision(d, n):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((n, d)) * np.linspace(1, 3, d)
    x -= x.mean(axis=0)
    v = x.T @ x / n
    e, q, residual = W.jacobi_davidson(lambda w: x.T @ (x @ w) / n, d, W.Solver(components=10))
    want = np.linalg.eigvalsh(v)[::-1][: len(e)]
    assert len(e) == min(10, d) and np.abs(e - want).max() < 1e-13 * want[0]
    assert np.abs(v @ q - q * e).max() < 1e-12 * want[0] and np.abs(q.T @ q - np.eye(len(e))).max() < 1e-13
    assert residual.max() < 1e-12 * want[0]


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    rhs, shifts = rng.standard_normal((30, 3)), np.array([0.3, -2.0, 5.0])
    t = W.minres(lambda w: a @ w, shifts, rhs, lambda w: w, 30)
    assert np.abs(a @ t - shifts * t - rhs).max() < 1e-4

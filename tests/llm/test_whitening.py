"""Embedding whitening against a plain eigendecomposition, and the eigenvalue search on hard matrices."""

import math

import numpy as np
import pytest

from echolens.llm import whitening
from echolens.llm.queries import QUERIES
from echolens.llm.tables import read
from tests.conftest import FOLDER


def plain(rows, k=4):
    """``{id: [(component, n, deviation, whitened, explained), ...]}`` lists of usable rows, by whole numbers and eigh."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    d = max(set(lengths), key=lambda x: (lengths.count(x), x), default=0)
    xs = [(i, [math.floor(256 * c) for c in v]) for i, v in good if len(v) == d]
    fit = [list(x) for x in {tuple(x) for _, x in xs}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    keep = e > 1e-13 * np.trace(v)
    e, u = e[keep], u[:, keep]
    out = []
    for i, x in xs:
        centred = np.array([float(n * c - s) / n for c, s in zip(x, sums)])
        out += [(i, j + 1, n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), centred @ u[:, j] / np.sqrt(e[j]), e[j] / np.trace(v))
                for j in range(len(e))]
    return out


def agree(got, expected):
    key = lambda r: (str(r[0]), r[1], r[3], abs(r[4]))
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    signs = {}
    for g, e in zip(got, expected):
        assert abs(abs(g[4]) - abs(e[4])) < 1e-7 and abs(g[5] - e[5]) < 1e-9
        if abs(e[4]) > 1e-6:
            signs.setdefault(g[1], set()).add(np.sign(g[4] * e[4]))
        assert g[6] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def vectors(rng, n, d):
    return (rng.standard_normal((n, d)) * np.geomspace(3, 0.2, d)).tolist()


def test_whitening(spark):
    rng = np.random.default_rng(5)
    data = [(i, v) for i, v in enumerate(vectors(rng, 300, 7))]
    data += [(None, data[3][1]), (3, data[3][1]), (3, data[4][1]), (900, None), (901, []), (902, [1.0] * 6), (903, [None] * 7),
             (904, [float("nan")] * 7), (905, [1.0] * 6 + [float("-inf")]), (906, [1.0] * 6 + [None]), (907, [-0.0] * 7)]
    data += [(1000 + i, data[0][1]) for i in range(500)]
    df = spark.createDataFrame([(*r, "x", [1]) for r in data], "vec_id long, embedding array<double>, _id string, x array<int>")
    agree(whitening.whiten(df.repartition(9)).collect(), plain(data))
    flat = [(i, [float(i % 5), 2.0 * (i % 5), 7.0]) for i in range(40)]  # one direction only
    agree(whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect(), plain(flat))
    for few in ([(1, [1.0, 2.0])] * 5, [(1, None)], []):
        assert whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<double>")).count() == 0


def test_whitening_of_large_numbers(spark):
    rows = [(1, [1e6, -3e9]), (2, [1e6, 5e9]), (3, [-1e6, 1e9])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1).collect()
    for r, e in zip(sorted(got), sorted(plain(rows, 1))):
        assert (r.deviation if r.deviation is not None else 1 << 63) == min(e[3], 1 << 63)


def test_given_table(spark):
    got = QUERIES["op11_embedding_whitening"](spark, FOLDER).collect()
    agree(got, plain([(r.vec_id, r.embedding) for r in read(spark, FOLDER, "embeddings").collect()]))


@pytest.mark.parametrize("make", [
    lambda r: np.cov(r.standard_normal((64, 4000))), lambda r: np.eye(30), lambda r: np.zeros((4, 4)), lambda r: np.array([[3.0]]),
    lambda r: np.diag([5.0, 5, 5, 5, 5, 5, 4, 0]), lambda r: np.diag([1e6, 1.0, 1e-3, 1e-4, 1e-9]), lambda r: np.diag([3.0, 2, 0, 0, 0, 0]),
    lambda r: np.cov(r.standard_normal((100, 40)))])
def test_leading_components(make):
    v = make(np.random.default_rng(3))
    values, u = whitening.leading(v, 4)
    known = np.linalg.eigvalsh(v)[::-1][:4]
    assert len(values) == (known > 1e-12 * max(known[0], 1e-300)).sum()
    assert np.allclose(values, known[:len(values)], rtol=1e-9, atol=1e-13 * known[0])
    if len(values):
        assert np.abs(v @ u - u * values).max() < 1e-12 * known[0] and np.allclose(u.T @ u, np.eye(len(values)))


def test_inertia():
    rng = np.random.default_rng(8)
    for d in (1, 2, 3, 9, 40):
        a = rng.standard_normal((d, d))
        a += a.T
        np.fill_diagonal(a, a.diagonal() * rng.integers(0, 2, d))
        for shift in rng.standard_normal(12):
            assert whitening.count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()

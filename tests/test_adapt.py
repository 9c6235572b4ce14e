"""Linear maps against direct optimisation of the same objective on the rows."""

import numpy as np
import pytest

from portlake.operators.adapt import DIAGONAL, FULL, linear_maps

D, C = 4, 3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    y, port = rng.integers(0, C, 500), rng.integers(0, 3, 500)
    x = rng.normal(0, 1, (500, D)) * [1, 2, 0.5, 1] + np.eye(C, D)[y] * 1.2 + 0.3 * port[:, None]
    data = [(int(p), int(c), v.tolist()) for p, c, v in zip(port, y, x)]
    return x, y, port, spark.createDataFrame([*data, (None, 1, [0.0] * D), (1, None, [0.0] * D), (1, 1, None)], "port int, y int, v array<double>").repartition(3)


def objective(x, y, xt, kind, lam, mu, m, w, b):
    z = x @ m @ w + b
    z = z - z.max(1, keepdims=True)
    ce = (np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean()
    cov, mean = np.cov(xt.T), xt.mean(0)
    return ce, ce + lam * ((m.T @ cov @ m - cov) ** 2).sum() + mu * ((m.T @ mean - mean) ** 2).sum()


def by_adam(x, y, xt, kind, lam, mu, steps=300, rate=1e-2):
    """300 steps of Adam on all rows."""
    hot, cov, mean = np.eye(C)[y], np.cov(xt.T), xt.mean(0)
    p = [np.eye(D), np.zeros((D, C)), np.zeros(C)]
    m1, m2 = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for k in range(1, steps + 1):
        m, w, b = p
        z = x @ m @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        r = (e / e.sum(1, keepdims=True) - hot) / len(x)
        gm = x.T @ r @ w.T + lam * 4 * cov @ m @ (m.T @ cov @ m - cov) + mu * 2 * np.outer(mean, m.T @ mean - mean)
        grads = [gm * np.eye(D) if kind == DIAGONAL else gm, m.T @ x.T @ r, r.sum(0)]
        for i, g in enumerate(grads):
            m1[i], m2[i] = 0.9 * m1[i] + 0.1 * g, 0.999 * m2[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m1[i] / (1 - 0.9**k)) / (np.sqrt(m2[i] / (1 - 0.999**k)) + 1e-8)
    return objective(x, y, xt, kind, lam, mu, *p)[1]


def test_maps_reach_the_optimum_over_all_rows(rows):
    x, y, port, df = rows
    got = linear_maps(df, "port", "y", "v", [(0.0, 0.0), (1.0, 1.0), (10.0, 0.0)]).collect()
    assert len(got) == 3 * 2 * 3 and {r.kind for r in got} == {DIAGONAL, FULL}
    for r in got:
        m, w, b = np.array(r.m).reshape(D, D), np.array(r.w).reshape(D, C), np.array(r.b)
        assert r.kind == FULL or (m == np.diag(np.diagonal(m))).all()
        args = (x[port != r.target], y[port != r.target], x[port == r.target], r.kind, r.lam, r.mu)
        ce, whole = objective(*args, m, w, b)
        assert abs(ce - r.loss) < 1e-9 and abs(whole - r.objective) < 1e-9
        assert whole <= by_adam(*args) + 2e-3


def test_full_maps_are_no_worse_than_diagonal_ones(rows):
    best = {(r.target, r.kind): r.objective for r in linear_maps(rows[3], "port", "y", "v", [(1.0, 1.0)]).collect()}
    assert all(best[p, FULL] <= best[p, DIAGONAL] + 1e-3 for p in range(3))


def test_no_rows_and_one_port(rows, spark):
    df = rows[3]
    assert linear_maps(df.limit(0), "port", "y", "v", [(0.0, 0.0)]).count() == 0
    assert linear_maps(df.where("port = 1"), "port", "y", "v", [(0.0, 0.0)]).count() == 0

"""Gates of all folds at once against trees grown one by one from the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from portlake.operators import boosting as B

SCHEMA = "id long, port long, a double, b double, label double, w double, truth int, p1 int, p2 int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(900):
        a, b = rng.normal(), float(rng.integers(0, 5))
        help_ = rng.random() < (0.8 if a > 0.3 and b > 1 else 0.3)
        truth = int(rng.integers(0, 3))
        p1, p2 = (int((truth + 1) % 3), truth) if help_ else (truth, int((truth + 1) % 3))
        out.append((i, i % 4, None if i % 97 == 0 else a, b, None if i % 11 == 0 else float(help_), float(1 + i % 3), truth, p1, p2))
    return out, spark.createDataFrame(out, SCHEMA).repartition(5).cache()


def plain(x, y, w, edges, rounds, depth, rate=B.RATE, ridge=B.RIDGE, least=B.LEAST):
    """One fold: every node looks at its own rows and every limit of every feature."""
    bins = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    share = (w * y).sum() / w.sum()
    z = np.full(len(y), np.log(share / (1 - share)))
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = w * (p - y), w * p * (1 - p)
        tree = {}

        def grow(node, at, level, g=g, h=h, tree=tree):
            worth = lambda k: g[k].sum() ** 2 / (h[k].sum() + ridge)
            best = (1e-9, None)
            for f in range(x.shape[1]) if level < depth else ():
                for limit in range(B.BINS - 1):
                    left = bins[at, f] <= limit
                    if min(left.sum(), (~left).sum()) >= least:
                        gain = worth(at[left]) + worth(at[~left]) - worth(at)
                        if gain > best[0] * (1 + 1e-8):
                            best = (gain, (f, limit))
            tree[node] = (best[1], -rate * g[at].sum() / (h[at].sum() + ridge))
            if best[1]:
                left = bins[at, best[1][0]] <= best[1][1]
                grow(2 * node + 1, at[left], level + 1)
                grow(2 * node + 2, at[~left], level + 1)

        grow(0, np.arange(len(y)), 0)
        trees.append(tree)
        z = z + walk(tree, bins)
    return trees, lambda q: np.log(share / (1 - share)) + sum(walk(t, np.column_stack([np.searchsorted(e, q[:, f], "left") for f, e in enumerate(edges)])) for t in trees)


def walk(tree, bins):
    out = np.zeros(len(bins))
    for i, row in enumerate(bins):
        node = 0
        while tree[node][0]:
            f, limit = tree[node][0]
            node = 2 * node + 1 + (row[f] > limit)
        out[i] = tree[node][1]
    return out


def arrays(rows, leave):
    kept = [r for r in rows if r[1] not in leave and r[4] is not None]
    x = np.array([[np.inf if r[2] is None else r[2], r[3]] for r in kept])
    return x, np.array([r[4] for r in kept]), np.array([r[5] for r in kept]), np.array([r[6] for r in kept])


@pytest.mark.parametrize("balance", [None, "truth"])
def test_all_folds_equal_trees_grown_one_by_one(rows, balance):
    data, df = rows
    gates = B.fit_gates(df, "port", ["a", "b"], "label", "w", balance, rounds=3, depth=3)
    assert gates.folds == [(0,), (1,), (2,), (3,), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    all_x = np.array([[np.inf if r[2] is None else r[2], r[3]] for r in data])
    for k in (0, 2, 4, 9):
        x, y, w, c = arrays(data, gates.folds[k])
        if balance:
            n = np.bincount(c)
            w = w * (len(c) / (len(n) * n))[c]
        _, margin = plain(x, y, w, gates.edges, 3, 3)
        assert np.allclose(gates.margin(gates.binned(all_x), k), margin(all_x), atol=1e-8)


def test_scores_leave_the_own_port_out(rows, spark):
    data, df = rows
    gates = B.fit_gates(df, "port", ["a", "b"], "label", inner=False, rounds=2, depth=2)
    got = {r.id: r.gate for r in B.score_gates(df.unionByName(spark.createDataFrame([(10_000, 77, 0.0, 0.0, None, 1.0, 0, 0, 0)], SCHEMA)), gates, "port", "id").collect()}
    assert got[10_000] is None and len(got) == 901
    for p in (0, 3):
        x, y, _, _ = arrays(data, (p,))
        _, margin = plain(x, y, np.ones(len(y)), gates.edges, 2, 2)
        mine = [r for r in data if r[1] == p]
        want = 1 / (1 + np.exp(-margin(np.array([[np.inf if r[2] is None else r[2], r[3]] for r in mine]))))
        assert np.allclose([got[r[0]] for r in mine], want, atol=1e-9)


def test_taus_come_from_ports_that_the_trees_did_not_see(rows):
    data, df = rows
    gates = B.fit_gates(df, "port", ["a", "b"], "label", rounds=2, depth=2)
    taus = [0.2, 0.4, 0.5, 0.6, 0.9]
    got = {r.port: (r.tau, r.inner_ba) for r in B.inner_taus(df, gates, "port", "truth", "p1", "p2", taus).collect()}
    for p in range(4):
        best = []
        for tau in taus:
            ba = []
            for q in set(range(4)) - {p}:
                mine = [r for r in data if r[1] == q]
                x = np.array([[np.inf if r[2] is None else r[2], r[3]] for r in mine])
                score = gates.probability(gates.binned(x), gates.folds.index((min(p, q), max(p, q))))
                ok = np.array([(r[8] if s > tau else r[7]) == r[6] for r, s in zip(mine, score)])
                y = np.array([r[6] for r in mine])
                ba.append(np.mean([ok[y == c].mean() for c in np.unique(y)]))
            best.append((-round(float(np.mean(ba)), 12), tau))
        assert got[p][0] == min(best)[1] and abs(got[p][1] + min(best)[0]) < 1e-9


def test_no_rows_and_one_port(spark):
    none = spark.createDataFrame([], SCHEMA)
    gates = B.fit_gates(none, "port", ["a", "b"], "label", rounds=2)
    assert gates.ports == [] and B.score_gates(none, gates, "port", "id").count() == 0
    one = spark.createDataFrame([(k, 5, float(k), 1.0, float(k % 2), 1.0, 0, 0, 1) for k in range(50)], SCHEMA)
    gates = B.fit_gates(one, "port", ["a"], "label", rounds=2)
    assert {r.gate for r in B.score_gates(one, gates, "port", "id").collect()} == {0.5}  # nothing is left to learn from
    assert B.inner_taus(one, gates, "port", "truth", "p1", "p2").count() == 0

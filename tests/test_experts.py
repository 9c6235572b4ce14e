"""Experts from moments against direct fits; alignment and prior estimation invariants."""

import re

import numpy as np
import pandas as pd
import pytest

from portlake.operators import moments as M
from portlake.operators import shift as H

D, C = 6, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 600
    y = rng.integers(0, C, n)
    x = rng.normal(0, 1, (n, D)) + np.eye(C, D)[y] * 1.5
    pdf = pd.DataFrame({"id": np.arange(n), "port": rng.integers(0, 4, n), "y": y, "v": list(x)})
    df = spark.createDataFrame(pdf)
    from portlake.session import cut

    return pdf, df, cut(M.sufficient_stats(df, "port", "y", "v"))


def direct_ridge(x, y, alpha):
    w = len(y) / (C * np.bincount(y, minlength=C))[y]
    t = np.where(y[:, None] == np.arange(C), 1.0, -1.0)
    xb, tb = np.average(x, 0, w), np.average(t, 0, w)
    a = ((x - xb) * w[:, None]).T @ (x - xb) + alpha * np.eye(x.shape[1])
    coef = np.linalg.solve(a, ((x - xb) * w[:, None]).T @ (t - tb)).T
    return coef, tb - coef @ xb


def test_ridge_equals_direct_fit(data):
    pdf, _, st = data
    m = M.fit_ridge(st, M.lopo(st), [("r", 3.0, None), ("sub", 3.0, [0, 2])]).toPandas()
    for p in range(4):
        tr = pdf[pdf.port != p]
        x = np.stack(tr.v.to_numpy())
        mu, sd = x.mean(0), x.std(0)
        for arm, dims in (("r", list(range(D))), ("sub", [0, 2])):
            coef, b = direct_ridge(((x - mu) / sd)[:, dims], tr.y.to_numpy(), 3.0)
            got = m[(m.target == p) & (m.arm == arm)].sort_values("cls")
            w = np.stack(got.w.to_numpy())[:, dims]
            assert np.allclose(w, coef / sd[dims], atol=1e-9)
            assert np.allclose(got.b, b - (coef / sd[dims]) @ mu[dims], atol=1e-9)


def test_inner_folds_leave_both_out(data):
    pdf, _, st = data
    m = M.fit_ridge(st, M.inner_folds(st), [("r", 1.0, None)], standardise=False).toPandas()
    tr = pdf[~pdf.port.isin([0, 1])]
    coef, b = direct_ridge(np.stack(tr.v.to_numpy()), tr.y.to_numpy(), 1.0)
    got = m[m.fold == "0|1"].sort_values("cls")
    assert np.allclose(np.stack(got.w.to_numpy()), coef, atol=1e-9) and np.allclose(got.b, b, atol=1e-9)


def test_folds_are_equal_by_memory_and_by_shuffle(data, spark):
    """Moments held once by the tasks against signed rows for every fold, with extra rows and folds without sources too."""
    from pyspark.sql import functions as F

    _, df, st = data
    extra = M.sufficient_stats(df.where("id % 5 = 0"), "port", "y", "v").select(F.col("port").cast("string").alias("fold"), F.col("port").alias("target"), "cls", "n", "s", "g", F.lit(1.0).alias("sign"))
    arms = [("all", 1.0, None), *M.drop_one_arms(D, 1.0)[1:], *M.single_arms(D, 2.0)]
    none = M.lopo(st).where("false")
    for folds, more in ((M.lopo(st), None), (M.inner_folds(st), None), (M.lopo(st), extra), (none, extra)):
        both = [M.fit_ridge(st, folds, arms, extra=more, limit=limit).toPandas().sort_values(["fold", "arm", "cls"]) for limit in (0, 1)]
        assert len(both[0]) == len(both[1]) > 0
        assert np.allclose(np.stack(both[0].w.to_numpy()), np.stack(both[1].w.to_numpy()), atol=1e-9) and np.allclose(both[0].b, both[1].b, atol=1e-9)
    for direction in ("t2s", "s2t"):
        a, b = M.coral(st, direction).toPandas(), M.coral(st, direction).toPandas()
        assert np.allclose(np.stack(a.sort_values("target").m.to_numpy()), np.stack(b.sort_values("target").m.to_numpy()))


def test_a_fold_in_the_shuffle_is_its_names(data):
    """No moments travel with the folds, however many there are."""
    _, _, st = data
    plan = M.fit_ridge(st, M.inner_folds(st), [("r", 1.0, None)])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(fold#" in plan and " g#" not in plan and ", g#" not in plan


def test_left_out_dimensions_equal_own_solutions(data):
    """A dimension taken off the inverse against solving the smaller system."""
    _, _, st = data
    cls, n, s, g = M.Moments(st.toPandas()).without([2])
    system = M.Ridge(n, s, g, True)
    for out in range(D):
        keep = [k for k in range(D) if k != out]
        w, b = system.fit(3.0, keep)
        coef = np.linalg.solve(system.gram[np.ix_(keep, keep)] + 3.0 * np.eye(D - 1), system.xy[:, keep].T).T
        assert np.allclose(w[:, keep] * system.sd[keep], coef) and (w[:, out] == 0).all()


def test_packed_triangles():
    m = np.random.default_rng(0).normal(size=(3, 5, 5))
    m = m + m.transpose(0, 2, 1)
    assert (M.unpack(np.stack([M.pack(x) for x in m]), 5) == m).all()


def test_scores_and_counts_agree(data):
    _, df, st = data
    models = M.fit_ridge(st, M.lopo(st), [("r", 1.0, None)])
    s = M.score(df, models, "port", "id", "v", ["port", "y"], C).toPandas()
    b = M.ba_of_counts(M.recall_counts(df, models, "port", "y", "v")).toPandas().set_index("fold").ba
    for p, g in s.groupby("port"):
        assert abs(b[str(p)] - g.assign(ok=g.pred == g.y).groupby("y").ok.mean().mean()) < 1e-12


def test_coral_moves_covariance(data):
    pdf, df, st = data
    maps = M.coral(st, "t2s", 1e-9)
    assert maps.toPandas().residual.max() < 1e-8
    moved = M.apply_maps(df, maps, "port", "v").toPandas()
    own = np.stack(moved[moved.port == 2].v.to_numpy())
    rest = np.stack(pdf[pdf.port != 2].v.to_numpy())
    assert np.allclose(own.mean(0), rest.mean(0)) and np.allclose(np.cov(own.T), np.cov(rest.T), atol=1e-6)


def test_distances_match_direct(data):
    pdf, df, st = data
    d = M.class_distances(df, M.precision_models(st, M.lopo(st), centred=False), "port", "id", "v").toPandas().set_index("id")
    tr = pdf[pdf.port != 1]
    x = np.stack(tr.v.to_numpy())
    cov = np.cov(x.T, bias=True)
    prec = np.linalg.inv(0.95 * cov + 0.05 * np.trace(cov) / D * np.eye(D))
    row = pdf[pdf.port == 1].iloc[0]
    mu = np.stack([np.stack(tr[tr.y == c].v.to_numpy()).mean(0) for c in range(C)])
    assert np.allclose(d.loc[row.id].d2, [(row.v - m) @ prec @ (row.v - m) for m in mu])


def test_nonnegative_solve():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.normal(size=(6, 4)), rng.normal(size=6)
        x = H.nonnegative_solve(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-8).all() and np.allclose(g[x > 0], 0, atol=1e-8)


def test_prior_recovered_from_confusion(spark):
    c = np.array([[80, 20], [30, 70]])
    conf = spark.createDataFrame([("f", t, p, int(c[t, p])) for t in range(2) for p in range(2)], "fold string, truth int, pred int, n long")
    true = np.array([0.2, 0.8])
    h = true @ (c / 100.0)
    hist = spark.createDataFrame([("f", p, int(round(h[p] * 100000))) for p in range(2)], "fold string, pred int, n long")
    got = H.estimate_prior(conf, hist, "fold", 2).toPandas().sort_values("cls").prior
    assert np.allclose(got, true, atol=1e-4)


def test_neighbour_entropy_blocks_do_not_matter(data):
    _, df, _ = data
    a = H.neighbour_entropy(df, "port", "id", "v", block=37).toPandas().sort_values("port").snd
    b = H.neighbour_entropy(df, "port", "id", "v", block=10_000).toPandas().sort_values("port").snd
    assert np.allclose(a, b)


def test_energy_distance_over_all_rows(spark):
    """More rows in a port than any block holds, against the plain mean over all pairs."""
    from portlake.operators.shift import energy_distance

    rng = np.random.default_rng(0)
    rows = [(k, "a" if k < 2300 else "b", (rng.normal(size=3) + (k >= 2300)).tolist()) for k in range(2600)]
    got = energy_distance(spark.createDataFrame(rows, "id long, p string, v array<double>"), "p", "id", "v", block=700).collect()
    x, y = (np.array([v for _, p, v in rows if p == side]) for side in "ab")
    far = lambda s, t: np.sqrt(((s[:, None, :] - t[None, :, :]) ** 2).sum(2)).mean()
    assert len(got) == 1 and abs(got[0].energy - (2 * far(x, y) - far(x, x) - far(y, y))) < 1e-6


def test_root_pair():
    from portlake.operators.moments import root_pair

    a = np.random.default_rng(1).normal(size=(40, 4))
    root, inverse = root_pair("own", a.T @ a)
    assert np.allclose(root @ root, a.T @ a) and np.allclose(root @ inverse, np.eye(4)) and np.allclose(root, root.T)
    with pytest.raises(ValueError):
        root_pair("own", np.diag([1.0, 0.0]))


def test_interventions_equal_changed_vectors(data):
    """Every dimension, and all at once, against predictions of vectors that were really changed."""
    from pyspark.sql import functions as F

    from portlake.operators.policies import hash_permutation, hash_permutations

    pdf, df, st = data
    models = M.fit_ridge(st, M.lopo(st), [("r", 1.0, None)])
    seeds = ["1", "2", "3"]
    perm = hash_permutations(df, ["port"], "id", seeds).toPandas()
    for s in seeds:
        assert set(zip(perm.id[perm.seed == s], perm.donor[perm.seed == s])) == {tuple(r) for r in hash_permutation(df, ["port"], "id", s).collect()}
    moved = df.join(df.sparkSession.createDataFrame(perm), "id").join(df.select(F.col("id").alias("donor"), F.col("v").alias("dv")), "donor")
    c = M.intervention_counts(moved, models, "port", "y", "v", "dv", "permute", ["seed"], joint=True).toPandas()
    assert len(c) == 3 * (D + 1) * C
    m, x = models.toPandas(), np.stack(pdf.v.to_numpy())
    for s in seeds:
        new = x[perm[perm.seed == s].set_index("id").donor.loc[pdf.id].to_numpy()]
        for what, dims in [(f"permute_{d}", [d]) for d in range(D)] + [("permute_all", list(range(D)))]:
            z = x.copy()
            z[:, dims] = new[:, dims]
            pred = np.zeros(len(z), int)
            for p in range(4):
                w = m[m.target == p].sort_values("cls")
                own = (pdf.port == p).to_numpy()
                pred[own] = (z[own] @ np.stack(w.w.to_numpy()).T + w.b.to_numpy()).argmax(1)
            got = c[(c.seed == s) & (c.what == what)].sort_values("truth")
            assert got.n.tolist() == [int((pdf.y == k).sum()) for k in range(C)]
            assert got.ok.tolist() == [int(((pdf.y == k) & (pred == k)).sum()) for k in range(C)]


def test_interventions_cover_all_dimensions_and_seeds(spark):
    import __spark_entry__ as entry

    rows = {r.what: r.seeds for r in entry.queries()["frozen_interventions"](spark, "/root/testdata/sf0.001").collect()}
    assert rows == {w: 20 for w in ["none", "permute_all", *[f"{k}_{d}" for k in ("mean", "permute") for d in range(64)]]}


def test_gates_are_fitted_in_full(spark, monkeypatch):
    """The registered gates use the operator's own rounds and depth, in every fold and inner fold."""
    import __spark_entry__ as entry
    from portlake.operators import boosting as B

    made, real = [], B.fit_gates
    monkeypatch.setattr(B, "fit_gates", lambda *a, **kw: made.append(real(*a, **kw)) or made[-1])
    rows = entry.queries()["decision_weighted_gate"](spark, "/root/testdata/sf0.001").collect()
    (fitted,) = made
    assert len(fitted.folds) == 8 + 28 and {len(t) for t in fitted.trees} == {20} and {len(t.feature) for trees in fitted.trees for t in trees} == {2**5 - 1}
    assert len(rows) == 8 and all(r.tau is not None and 0 < r.mean_gate < 1 for r in rows)


def metrics(df):
    """Metrics of the executed plan's nodes, the query stages of adaptive execution included."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if node.metrics().contains("shuffleRecordsWritten"):
                out.append(f"shuffle records written {node.metrics().apply('shuffleRecordsWritten').value()}")
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return "; ".join(out)


def test_rows_of_block_pairs_grow_with_the_table(spark):
    """However small the blocks asked for, a row is repeated over a bounded number of them, and the results stay."""
    from portlake.operators import shift as H

    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (400, 5))
    df = spark.createDataFrame([(int(i % 2), i, v[i].tolist()) for i in range(400)], "port int, id int, v array<double>")
    entropy, energy = H.neighbour_entropy(df, "port", "id", "v", block=2), H.energy_distance(df, "port", "id", "v", block=2)
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    for r in entropy.collect():
        s = u[r.port::2] @ u[r.port::2].T / 0.05
        e = np.exp(s)
        np.fill_diagonal(e, 0)
        assert abs(r.snd - (np.log(e.sum(1)) - (e * s).sum(1) / e.sum(1)).mean()) < 1e-9
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    assert abs(energy.first().energy - (2 * d[::2, 1::2].mean() - d[::2, ::2].mean() - d[1::2, 1::2].mean())) < 1e-6
    rows = [int(m) for m in re.findall(r"shuffle records written\D*(\d+)", metrics(entropy))]
    assert rows and max(rows) <= 400 * H.PORT_BLOCKS

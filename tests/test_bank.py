"""Hand-made cases for the moment bank, the metrics and the contracts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from portlake.operators import bank as B
from portlake.operators import clean as C
from portlake.operators import metrics as M
from portlake.operators import policies as P


def moments(spark, rows):
    """rows: (grp, d, head, mech, predicted, observed)"""
    return spark.createDataFrame([(0, *r, r[5] is not None) for r in rows], "k int, grp int, d int, head int, mech int, predicted double, observed double, active boolean")


def kept(df):
    return sorted(r["head"] for r in df.where("retained").collect())


def test_keeps_the_compatible_head(spark):
    m = moments(spark, [(0, 0, 0, 0, .1, .1), (1, 0, 0, 0, .9, .9), (0, 0, 1, 0, .9, .1), (1, 0, 1, 0, .1, .9)])
    f = B.filter_bank(m, ["k"], .1)
    assert kept(f) == [0] and f.head().status == "compatible"


def test_nothing_active_keeps_all(spark):
    f = B.filter_bank(moments(spark, [(0, 0, h, 0, .1, None) for h in (0, 1)]), ["k"], .1)
    assert kept(f) == [0, 1] and f.head().status == "no_active_knowledge"


def test_conflict_keeps_all_and_shows(spark):
    f = B.filter_bank(moments(spark, [(0, 0, 0, 0, .1, .5), (0, 0, 1, 0, .9, .5)]), ["k"], .1)
    assert kept(f) == [0, 1] and f.head().status == "mechanism_conflict"


def test_one_mechanism_must_fit_all_groups(spark):
    m = moments(spark, [(0, 0, 0, 0, .2, .2), (1, 0, 0, 0, .2, .8), (0, 0, 0, 1, .8, .2), (1, 0, 0, 1, .8, .8)])
    assert B.filter_bank(m, ["k"], .05).head().status == "mechanism_conflict"
    assert {r.grp: r.mechanism for r in B.group_mechanisms(m, ["k"]).collect()} == {0: 0, 1: 1}


def test_masked_rows_leave_both_moments(spark):
    phi = spark.createDataFrame([(1, 0, 0, "a", 0, .2), (2, 0, 0, "b", 0, None)], "sample int, k int, grp int, block string, d int, phi double")
    probs = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "sample int, head int, p array<double>")
    rel = spark.createDataFrame([(s, 0, 0, [.2, .9]) for s in (1, 2)], "sample int, mech int, d int, q array<double>")
    r = B.moments(phi, probs, rel, ["k"], min_cell=1, min_blocks=1).head()
    assert (r.observed, r.predicted, r.n) == (.2, .2, 1)


@pytest.mark.parametrize("ports,status,tau", [(4, "ready", .12), (3, "calibration_unavailable", None)])
def test_calibration(spark, ports, status, tau):
    m = spark.createDataFrame([(k, 0, 0, 0, 0, .6, .5, True) for k in range(ports)], "k int, grp int, d int, head int, mech int, predicted double, observed double, active boolean")
    r = B.calibrate_tau(m, "k", 0).head()
    assert r.status == status and (r.tau is None if tau is None else abs(r.tau - tau) < 1e-9)


def test_balanced_accuracy_is_not_accuracy(spark):
    df = spark.createDataFrame([("a", 0, 0)] * 8 + [("a", 1, 0)] * 2 + [("b", 0, 0)], "port string, t int, p int")
    r = {x.port: x for x in M.balanced_accuracy(df, ["port"], "t", "p").collect()}
    assert r["a"].ba == .5 and r["a"].accuracy == .8
    assert M.equal_port_ba(df, "port", "t", "p").head().equal_port_ba == .75


def test_sampling_mass_sums_to_one(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 2)], "port string, c int")
    assert abs(P.balanced_weights(df, "port", "c").agg(F.sum("weight")).head()[0] - 1) < 1e-12


def test_contract_and_ids(spark):
    df = spark.createDataFrame([("x|1.0",), ("x|1.0",)], "id string")
    with pytest.raises(ValueError):
        C.strict_ids(df, "id")
    assert not C.contract_report(df, ["id"], 2).head().ok


def test_forbidden_columns_raise(spark):
    perm = spark.createDataFrame([("a", "feature", True), ("y", "evaluator_only", False)], "column string, role string, usable boolean")
    df = spark.createDataFrame([(1, 2)], "a int, y int")
    assert C.project_permitted(df, perm, ["feature"]).columns == ["a"]
    with pytest.raises(ValueError):
        C.assert_permitted(df, perm, ["feature"])
    with pytest.raises(ValueError):
        C.project_permitted(df.withColumn("z", F.lit(1)), perm, ["feature"])


def test_unknown_parent_is_an_error(spark):
    p = spark.createDataFrame([(0, "c")], "fine int, coarse string")
    with pytest.raises(ValueError):
        M.parent_class(spark.createDataFrame([(1,)], "t int"), p, "t")


def test_direction_operator_conserves_mass(spark):
    df = spark.createDataFrame([([.5, .2, .2, .1], [.0, .4, -.1, .2])], "p array<double>, g array<double>")
    out = df.select(P.direction_operator(F.col("p"), F.col("g")).alias("o")).head().o
    assert abs(sum(out) - 1) < 1e-12 and out[0] < .5 and out[1] > .2 and out[2] == .2


def test_bag_consistency_keeps_rows_without_a_bag(spark):
    from portlake.operators.selective import loo_bag_consistency

    rows = [(1, "a", 1, 0), (2, "a", 2, 0), (3, "a", 2, 1), (4, "a", 3, None), (5, None, 1, 0), (6, None, 2, 0), (7, "b", 1, 0), (8, "b", 1, 0), (9, "a", None, 0)]
    df = spark.createDataFrame(rows, "id long, bag string, product long, pred long")
    got = {r.id: r.c for r in loo_bag_consistency(df, ["bag"], "product", "pred", "c").collect()}
    want = {}
    for i, bag, product, pred in rows:
        rest = [r[3] == pred for r in rows if r[1] == bag and r[2] != product]
        want[i] = sum(rest) / len(rest) if bag and rest else None
    assert got == want


def test_subset_oracle_of_twelve_heads(spark):
    """All 4,095 subsets against one at a time, with rows that lack scores or a label."""
    from portlake.operators import bank

    rng = np.random.default_rng(3)
    heads, classes, n = 12, 3, 60
    ps = np.round(rng.random((n, heads, classes)), 6)
    y = rng.integers(0, classes, n).tolist()
    rows = [(i, None if i == 7 else y[i], None if i == 9 else ps[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, truth int, ps array<array<double>>").repartition(3)
    got = {r.mask: r for r in bank.subset_oracle(df, heads, "id", "truth").collect()}
    assert len(got) == 4095
    for mask in (1, 6, 2048, 3000, 4095):
        keep = [h for h in range(heads) if mask >> h & 1]
        pick = lambda i, keep: -1 if i == 9 else int(np.round(sum(ps[i, h] for h in keep) / len(keep), 9).argmax())
        ok = [rows[i][1] is not None and pick(i, keep) == rows[i][1] for i in range(n)]
        base = [rows[i][1] is not None and pick(i, range(heads)) == rows[i][1] for i in range(n)]
        by = {c: [ok[i] for i in range(n) if rows[i][1] == c] for c in {r[1] for r in rows}}
        r = got[mask]
        assert (r["size"], r.rescue, r.harm) == (len(keep), sum(a and not b for a, b in zip(ok, base)), sum(b and not a for a, b in zip(ok, base)))
        assert abs(r.accuracy - sum(ok) / n) < 1e-12 and abs(r.ba - np.mean([np.mean(v) for v in by.values()])) < 1e-12 and r.is_full == (mask == 4095)
    u = bank.union_ceiling(df, heads, "id", "truth").first()
    assert u.any_head <= u.any_subset <= 1 and u.full <= u.any_subset and u.beyond_reach == round((1 - u.any_subset) * n)
    assert bank.subset_oracle(df.limit(0), heads, "id", "truth").count() == 0

"""Moments, experts and library models. Rows-only where the result is iterative or needs a solver."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import boosting as B
from ..operators import gates as G
from ..operators import metrics as E
from ..operators import models as L
from ..operators import moments as M
from ..operators.metrics import auc
from ..session import cut
from .base import query, rounded
from .q_gates import episodes, port_gain
from .views import CLASSES

ALPHAS = [0.3, 1.0, 3.0, 10.0]
D = 64
#: Replicates of a permutation.
SEEDS = 20


def stats(v):
    return cut(M.sufficient_stats(v.features, "port", "y", "v"))


@query("moments_small_d", "features", "SELECT port, y, count(*) AS n, " + ", ".join(f"round(sum(v[{i + 1}]), 6) + 0.0 AS s{i}" for i in range(3)) + ", " + ", ".join(f"round(sum(v[{i + 1}]*v[{j + 1}]), 6) + 0.0 AS g{i}_{j}" for i in range(3) for j in range(i, 3)) + " FROM features GROUP BY port, y")
def _(v):
    return rounded(M.small_moments(v.features, ["port", "y"], "v", 3))


@query("sufficient_stats", "features", "SELECT port, y AS cls, CAST(count(*) AS DOUBLE) AS n, round(sum(v[1]), 6) + 0.0 AS s_first, round(sum(v[64]), 6) + 0.0 AS s_last, round(sum(v[2]*v[3]), 6) + 0.0 AS g_cross, round(sum(list_sum(list_transform(v, lambda z: z*z))), 6) AS g_trace FROM features GROUP BY port, y")
def _(v):
    s = M.sufficient_stats(v.features, "port", "y", "v")
    trace = S.total(F.array(*[F.element_at("g", i * D - i * (i - 1) // 2 + 1) for i in range(D)]))
    return rounded(s.select("port", "cls", "n", F.element_at("s", 1).alias("s_first"), F.element_at("s", D).alias("s_last"), F.element_at("g", D + 2).alias("g_cross"), trace.alias("g_trace")))


@query("standardise", "features dims", """, t AS (SELECT port, d, count(x) AS n, sum(x) AS s, sum(x*x) AS q FROM dims GROUP BY ALL), a AS (SELECT d, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM t GROUP BY d), m AS (SELECT t.port, t.d, (a.s - t.s)/(a.n - t.n) AS mu, (a.q - t.q)/(a.n - t.n) AS m2 FROM t JOIN a USING (d)) SELECT id, x.d, round((x - mu)/sqrt(m2 - mu*mu), 6) + 0.0 AS z FROM dims x JOIN m USING (port, d)""")
def _(v):
    return rounded(E.impute_standardise(v.dims, "port", v.features.select("port").distinct()).select("id", "d", "z"))


def lopo_scores(v, st=None, alpha=1.0):
    st = st or stats(v)
    return M.score(v.features, M.fit_ridge(st, M.lopo(st), [("ridge", alpha, None)]), "port", "id", "v", ["port", "y"], CLASSES)


@query("ridge_expert")
def _(v):
    s = lopo_scores(v)
    return rounded(E.balanced_accuracy(s, ["port"], "y", "pred"))


@query("tune_alpha")
def _(v):
    return rounded(M.tune_alpha(v.features, stats(v), "port", "y", "v", ALPHAS))


@query("pca")
def _(v):
    st = stats(v)
    return rounded(M.fit_pca(st, M.lopo(st), 4).select("fold", "axis", "variance", "share"))


@query("coral_t2s")
def _(v):
    st = stats(v)
    maps = M.coral(st, "t2s", 1e-3)
    moved = M.apply_maps(v.features, maps, "port", "v").withColumn("port", F.col("target")).drop("target")
    models = M.fit_ridge(st, M.lopo(st), [("ridge", 1.0, None)])
    b = M.ba_of_counts(M.recall_counts(moved, models, "port", "y", "v")).select("fold", "ba")
    return rounded(maps.select(F.col("target").cast("string").alias("fold"), "residual").join(b, "fold"))


@query("coral_s2t")
def _(v):
    """Sources moved into each target's frame, then a fresh expert per target on the moved moments."""
    st = stats(v)
    moved = M.apply_maps(v.features, M.coral(st, "s2t", 1e-3), "port", "v", own=False)
    ms = M.sufficient_stats(moved, "target", "y", "v").select(F.col("port").alias("target"), "cls", "n", "s", "g")
    extra = ms.select(F.col("target").cast("string").alias("fold"), "target", "cls", "n", "s", "g", F.lit(1.0).alias("sign"))
    none = M.lopo(st).withColumn("leave_out", F.array(F.lit(None).cast("bigint"))).where("false")
    models = M.fit_ridge(st, none, [("ridge", 1.0, None)], extra=extra)
    return rounded(M.ba_of_counts(M.recall_counts(v.features, models, "port", "y", "v")))


@query("novelty")
def _(v):
    """AUC of three novelty scores for rows of classes the fold never saw."""
    known = cut(M.sufficient_stats(v.features.where("y < 7"), "port", "y", "v"))
    out = None
    for name, kw in {"pooled": {"centred": False}, "class_centred": {"centred": True}, "diagonal": {"centred": True, "diagonal": True}}.items():
        n = M.novelty(M.class_distances(v.features, M.precision_models(known, M.lopo(known), **kw), "port", "id", "v", ["port", "y"]))
        a = auc(n, ["port"], "novelty", F.col("y") >= 7).select(F.lit(name).alias("score"), "port", "auc")
        out = a if out is None else out.unionByName(a)
    return rounded(out)


@query("class_distinctiveness")
def _(v):
    st = stats(v)
    d = M.class_distances(v.features, M.precision_models(st, M.lopo(st), centred=False), "port", "id", "v", ["port", "y"])
    return rounded(M.class_distinctiveness(d, "y", "port"))


@query("pseudo_label")
def _(v):
    st = stats(v)
    s = lopo_scores(v, st).withColumn("margin", S.margin(F.col("scores")))
    extra = M.pseudo_moments(s, v.features, "id", "port", "v", "margin", 0.3)
    models = M.fit_ridge(st, M.lopo(st), [("refit", 1.0, None)], extra=extra)
    return rounded(M.ba_of_counts(M.recall_counts(v.features, models, "port", "y", "v")))


@query("attribution")
def _(v):
    """Drop-one and single-dimension experts over all dimensions, from one scan."""
    st = stats(v)
    models = M.fit_ridge(st, M.lopo(st), M.drop_one_arms(D, 1.0) + M.single_arms(D, 1.0))
    b = M.ba_of_counts(M.recall_counts(v.features, models, "port", "y", "v"))
    return rounded(b.groupBy("arm").agg(F.avg("ba").alias("ba"), F.count(F.lit(1)).alias("folds")))


@query("expert_grid")
def _(v):
    st = stats(v)
    arms = M.block_arms({"first": range(0, 32), "second": range(32, 64), "all": range(64)}, [1.0, 10.0])
    b = M.ba_of_counts(M.recall_counts(v.features, M.fit_ridge(st, M.lopo(st), arms), "port", "y", "v"))
    return rounded(b.groupBy("arm").agg(F.avg("ba").alias("ba"), F.min("ba").alias("worst")))


@query("source_count_curve")
def _(v):
    st = stats(v)
    models = M.fit_ridge(st, M.source_subsets(st, [2, 4, 7]), [("ridge", 1.0, None)])
    b = M.ba_of_counts(M.recall_counts(v.features, models, "port", "y", "v")).withColumn("sources", F.split_part("fold", F.lit(":"), F.lit(2)).cast("int"))
    return rounded(b.groupBy("sources").agg(F.avg("ba").alias("ba"), F.count(F.lit(1)).alias("folds")))


@query("regional_sources")
def _(v):
    st = stats(v)
    reg = v.features.select("port").distinct().withColumn("region", F.col("port") % 2)
    models = M.fit_ridge(st, M.regional_sources(st, reg), [("ridge", 1.0, None)])
    return rounded(M.ba_of_counts(M.recall_counts(v.features, models, "port", "y", "v")))


@query("frozen_interventions")
def _(v):
    """A fixed expert under mean replacement of each dimension and under permutation of each, or of all, within its scene."""
    from ..operators.policies import hash_permutations

    f, st = v.features, stats(v)
    models = cut(M.fit_ridge(st, M.lopo(st), [("fixed", 1.0, None)]))
    means = f.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).groupBy().agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    # replicates are rows; what no seed changes is counted once
    seeds = [str(k) for k in range(1, SEEDS + 1)]
    donor = f.select(F.col("id").alias("donor"), F.col("v").alias("dv"))
    moved = f.join(hash_permutations(f, ["product"], "id", seeds), "id").join(donor, "donor")
    drawn = M.intervention_counts(moved, models, "port", "y", "v", "dv", "permute", ["seed"], joint=True)
    still = M.intervention_counts(f.join(F.broadcast(means)), models, "port", "y", "v", "mean", "mean")
    none = M.recall_counts(f, models, "port", "y", "v").groupBy("truth").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok")).withColumn("what", F.lit("none"))
    fixed = still.unionByName(none).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    b = M.ba_of_counts(drawn.unionByName(fixed), ["what", "seed"]).groupBy("what").agg(F.avg("ba").alias("ba"), F.count(F.lit(1)).alias("seeds"))
    return rounded(b)


@query("profile_gate")
def _(v):
    prof = v.dims.groupBy("port", "d").agg(F.avg("x").alias("x")).groupBy("port").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return rounded(M.profile_gate(prof, port_gain(v).withColumnRenamed("fold", "port")))


@query("linear_map_adapt")
def _(v):
    """Diagonal and full maps of every port over all source rows, without and with penalties."""
    from ..operators.adapt import linear_maps

    m = linear_maps(v.features, "port", "y", "v", [(0.0, 0.0), (1.0, 1.0)])
    trace = S.total(F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda i: F.get("m", i * (D + 1))))
    return rounded(m.select("target", "kind", "lam", "mu", "loss", "objective", (trace / D).alias("mean_scale")), 3)


# ---------------------------------------------------------------- library models: each port scored by a model of the others

def lopo(v, df, fn):
    """fn(rows of the other ports, rows of the port) for every port; the fits follow each other, so this is for tables with few ports."""
    out = None
    for p in sorted(r["port"] for r in v.features.select("port").distinct().collect()):
        part = fn(df.where(F.col("port") != p), df.where(F.col("port") == p))
        out = part if out is None else out.unionByName(part)
    return out


def gate_rows(v):
    d = G.gate_features(v.preds, "s1", "s2", CLASSES)
    lab = G.net_gain_label("truth", "p1", "p2")
    return d.withColumns({"net": lab, "benefit": (lab > 0).cast("double"), "wrong": (F.col("p1") != F.col("truth")).cast("double")})


GATE = ["margin1", "margin2", "entropy1", "entropy2", "differ"]


@query("logistic_probe")
def _(v):
    r = lopo(v, v.features, lambda tr, te: L.logistic_probe(tr, te, "v", "y", 0.01))
    return rounded(E.balanced_accuracy(r, ["port"], "y", "probe"))


def gates(v, weight=None, balance=None):
    """Every port by the trees of the others, with its threshold from inner episodes: rows, mean score, threshold, gated accuracy."""
    taught = F.when(F.col("net") != 0, F.col("benefit"))
    g = cut(gate_rows(v).select("id", "port", "truth", "p1", "p2", *GATE, taught.alias("label"), F.when(F.col("net") < 0, B.HARM_WEIGHT).otherwise(1.0).alias("harm")))
    fitted = B.fit_gates(g, "port", GATE, "label", weight, balance)
    taus = B.inner_taus(g, fitted, "port", "truth", "p1", "p2")
    s = B.score_gates(g, fitted, "port", "id", ["truth", "p1", "p2"]).join(F.broadcast(taus), "port")  # a row for each port
    s = s.withColumn("pick", G.gated("p1", "p2", F.col("gate") > F.col("tau")))
    told = s.groupBy("port").agg(F.count(F.lit(1)).alias("n"), F.avg("gate").alias("mean_gate"), F.max("tau").alias("tau"), F.max("inner_ba").alias("inner_ba"))
    return rounded(told.join(E.balanced_accuracy(s, ["port"], "truth", "pick").select("port", "ba"), "port"), 4)


@query("fit_gate")
def _(v):
    return gates(v)


@query("decision_weighted_gate")
def _(v):
    return gates(v, "harm", "truth")


@query("density_ratio")
def _(v):
    r = lopo(v, v.features, lambda tr, te: L.density_ratio(tr, te, "v", "id"))
    return rounded(r.groupBy("port").agg(F.avg("ratio").alias("mean"), F.min("ratio").alias("low"), F.max("ratio").alias("high")), 4)


@query("surrogate_risk")
def _(v):
    return rounded(lopo(v, gate_rows(v), lambda tr, te: L.surrogate_risk(tr, te, ["margin1", "entropy1"], "wrong", "margin1", "id", "port", 0.8)), 4)


@query("scaled_surrogate_thresholds", "preds", """, s AS (SELECT id, port, m1, 'confidence' AS surrogate, round(1 - least(1.0, m1), 6) AS v FROM preds UNION ALL SELECT id, port, m1, 'product', round((1 - least(1.0, m1))*(1 - least(1.0, m2)), 6) FROM preds), z AS (SELECT *, v/greatest(avg(v) OVER (PARTITION BY port, surrogate), 1e-6) AS w FROM s),
 r AS (SELECT port, surrogate, m1, row_number() OVER o AS rn, avg(w) OVER o AS risk FROM z WINDOW o AS (PARTITION BY port, surrogate ORDER BY m1 DESC, id ROWS UNBOUNDED PRECEDING)) SELECT port, surrogate, count(*) AS n, arg_max(m1, rn) FILTER (risk <= 0.9) AS threshold, coalesce(max(rn) FILTER (risk <= 0.9), 0) AS accepted FROM r GROUP BY ALL""")
def _(v):
    c = 1 - F.least(F.lit(1.0), F.col("m1"))
    d = v.preds.select("id", "port", "m1", F.round(c, 6).alias("confidence"), F.round(c * (1 - F.least(F.lit(1.0), F.col("m2"))), 6).alias("product"))
    return L.scaled_surrogate_thresholds(d, ["confidence", "product"], ["port"], "m1", "id", 0.9)


@query("calibrated_gate")
def _(v):
    g = gate_rows(v).withColumn("diff", F.col("m2") - F.col("m1"))
    r = lopo(v, g, lambda tr, te: L.calibrated_gate(tr.where("net <> 0"), te, "diff", "benefit"))
    return rounded(r.groupBy("port").agg(F.max("switch_point").alias("switch_point"), F.avg(F.col("use_expert").cast("int")).alias("share")), 4)


@query("group_assign")
def _(v):
    g = L.group_assign(v.features, "port", "id", "v", F.col("port") != 0)
    return g.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("port").alias("ports"))


@query("geo_regions")
def _(v):
    p = v.objects.groupBy("port").agg(F.avg("x").alias("lon"), F.avg("y").alias("lat"))
    return L.geo_regions(p, "lon", "lat", 3).select("port", "region")


@query("stacked_policy")
def _(v):
    r = lopo(v, v.preds, lambda tr, te: L.stacked_policy(tr, te, ["s1", "s2"], "truth"))
    return rounded(E.balanced_accuracy(r, ["port"], "truth", "stacked"))

"""Shift between domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import metrics as M
from ..operators import shift as H
from .base import query, rounded
from .q_gates import episodes
from .q_policies import long
from .views import CLASSES

_COS = "list_sum(list_transform(list_zip(a.v, b.v), lambda t: t[1]*t[2]))/((sqrt(list_sum(list_transform(a.v, lambda z: z*z))) + 1e-9)*(sqrt(list_sum(list_transform(b.v, lambda z: z*z))) + 1e-9))"


@query("shift_decompose", "preds", """, k AS (SELECT CAST(unnest(range(10)) AS INT) AS cls), f AS (SELECT DISTINCT port AS fold FROM preds), s AS (SELECT fold, truth AS cls, count(*) AS n, avg(CAST(p1 = truth AS INT)) AS r FROM preds p JOIN f ON f.fold <> p.port GROUP BY ALL), t AS (SELECT port AS fold, truth AS cls, count(*) AS n, avg(CAST(p1 = truth AS INT)) AS r FROM preds GROUP BY ALL),
 j AS (SELECT f.fold, coalesce(s.n, 0)/sum(coalesce(s.n, 0)) OVER (PARTITION BY f.fold) AS ps, coalesce(t.n, 0)/sum(coalesce(t.n, 0)) OVER (PARTITION BY f.fold) AS pt, coalesce(s.r, 0) AS rs, coalesce(t.r, 0) AS rt FROM f CROSS JOIN k LEFT JOIN s ON s.fold = f.fold AND s.cls = k.cls LEFT JOIN t ON t.fold = f.fold AND t.cls = k.cls)
SELECT fold, round(sum(ps*rs), 6) AS source_acc, round(sum(pt*rs), 6) AS label_shifted_acc, round(sum(pt*rt), 6) AS target_acc, round(0.5*sum(abs(pt - ps)), 6) AS prior_tv FROM j GROUP BY fold""")
def _(v):
    return rounded(H.shift_decompose(episodes(v), v.preds.withColumn("fold", F.col("port")), "fold", "truth", "p1", "p1"))


@query("pair_matrix", "features dims", """, p AS (SELECT y, d, round(avg(x), 9) AS x FROM dims GROUP BY ALL), t AS (SELECT y, d FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY x DESC, d) AS rn FROM p) q WHERE rn <= 10)
SELECT a.y, b.y AS other, round(sum(a.x*b.x)/(sqrt(sum(a.x*a.x))*sqrt(sum(b.x*b.x)) + 1e-12), 6) + 0.0 AS cosine, round(count(*) FILTER (ta.d IS NOT NULL AND tb.d IS NOT NULL)/count(*) FILTER (ta.d IS NOT NULL OR tb.d IS NOT NULL), 6) AS jaccard FROM p a JOIN p b ON a.d = b.d AND a.y < b.y LEFT JOIN t ta ON ta.y = a.y AND ta.d = a.d LEFT JOIN t tb ON tb.y = b.y AND tb.d = b.d GROUP BY a.y, b.y""")
def _(v):
    p = v.dims.groupBy("y", "d").agg(F.round(F.avg("x"), 9).alias("x"))
    return rounded(H.pair_matrix(p, "y", "d", "x"))


@query("mean_shift", "features dims", ", m AS (SELECT port, d, sum(x) AS s, count(*) AS n FROM dims GROUP BY ALL), t AS (SELECT d, sum(s) AS S, sum(n) AS N FROM m GROUP BY d) SELECT id, x.d, round(x + (S - s)/(N - n) - s/n, 6) + 0.0 AS x FROM dims x JOIN m USING (port, d) JOIN t USING (d)".replace("sum(s) AS S, sum(n) AS N", "sum(s) AS ts, sum(n) AS tn").replace("(S - s)/(N - n)", "(ts - s)/(tn - n)"))
def _(v):
    return rounded(long(H.mean_shift(v.features, "port", "v"), "v").withColumnRenamed("cls", "d"))


@query("snd_entropy", "features", f""", c AS (SELECT a.port, a.id, exp({_COS}/0.05) AS e, {_COS}/0.05 AS s FROM features a JOIN features b ON a.port = b.port AND a.id <> b.id), r AS (SELECT port, id, ln(sum(e)) - sum(e*s)/sum(e) AS h FROM c GROUP BY ALL) SELECT port, round(avg(h), 6) AS snd FROM r GROUP BY port""")
def _(v):
    return rounded(H.neighbour_entropy(v.features, "port", "id", "v", block=32))


@query("energy_distance", "features", """, d AS (SELECT a.port AS a, b.port AS b, avg(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1]-t[2])*(t[1]-t[2]))))) AS m FROM features a JOIN features b ON true GROUP BY ALL) SELECT x.a, x.b, round(2*x.m - y.m - z.m, 6) AS energy FROM d x JOIN d y ON y.a = x.a AND y.b = x.a JOIN d z ON z.a = x.b AND z.b = x.b WHERE x.a < x.b""")
def _(v):
    return rounded(H.energy_distance(v.features, "port", "id", "v"))


@query("label_shift_prior")
def _(v):
    conf = episodes(v).groupBy("fold", "truth", F.col("p1").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    hist = v.preds.groupBy(F.col("port").alias("fold"), F.col("p1").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(H.estimate_prior(conf, hist, "fold", CLASSES, 0.2))


@query("label_shift_correct")
def _(v):
    """Posterior reweighted by the estimated prior, balanced accuracy before and after, distance of the prior to the truth."""
    e = episodes(v)
    conf = e.groupBy("fold", "truth", F.col("p1").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    hist = v.preds.groupBy(F.col("port").alias("fold"), F.col("p1").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    prior = H.estimate_prior(conf, hist, "fold", CLASSES, 0.2)
    t = H.prior_array(prior, "fold", "pt", CLASSES).withColumnRenamed("fold", "port")
    s = H.prior_array(M.class_prior(e, ["fold"], "truth", CLASSES), "fold", "ps", CLASSES).withColumnRenamed("fold", "port")
    d = v.preds.join(F.broadcast(t), "port").join(F.broadcast(s), "port")
    d = d.withColumn("pc", S.argmax(H.reweight(S.softmax(F.col("s1")), F.col("pt"), F.col("ps"))))
    a, b = (M.balanced_accuracy(d, ["port"], "truth", p).select("port", F.col("ba").alias(n)) for p, n in (("p1", "ba_before"), ("pc", "ba_after")))
    tv = M.prior_distance(prior.withColumnRenamed("fold", "port"), M.class_prior(v.preds, ["port"], "truth", CLASSES), ["port"]).select("port", "tv")
    return rounded(a.join(b, "port").join(tv, "port"))


@query("posterior_reweight", "preds", """, k AS (SELECT unnest(range(10)) AS cls), f AS (SELECT DISTINCT port FROM preds), ps AS (SELECT port, list(pr ORDER BY cls) AS ps FROM (SELECT f.port, k.cls, count(*) FILTER (p.truth = k.cls)/count(*) AS pr FROM preds p JOIN f ON f.port <> p.port CROSS JOIN k GROUP BY ALL) q GROUP BY port), pt AS (SELECT port, list(pr ORDER BY cls) AS pt FROM (SELECT p.port, k.cls, count(*) FILTER (p.p1 = k.cls)/count(*) AS pr FROM preds p CROSS JOIN k GROUP BY ALL) q GROUP BY port),
 w AS (SELECT id, [exp(s1[c] - list_max(s1))*greatest(pt[c]/greatest(ps[c], 1e-6), 1e-6) FOR c IN [1,2,3,4,5,6,7,8,9,10]] AS w FROM preds JOIN ps USING (port) JOIN pt USING (port)) SELECT id, CAST(c - 1 AS INT) AS cls, round(w[c]/list_sum(w), 6) AS x FROM w, (SELECT unnest([1,2,3,4,5,6,7,8,9,10]) AS c) z""")
def _(v):
    t = H.prior_array(M.class_prior(v.preds, ["port"], "p1", CLASSES), "port", "pt", CLASSES)
    s = H.prior_array(M.class_prior(episodes(v), ["fold"], "truth", CLASSES), "fold", "ps", CLASSES).withColumnRenamed("fold", "port")
    d = v.preds.join(F.broadcast(t), "port").join(F.broadcast(s), "port")
    return rounded(long(d.select("id", H.reweight(S.softmax(F.col("s1")), F.col("pt"), F.col("ps")).alias("o")), "o"))


@query("mixval")
def _(v):
    d = v.features.join(v.preds.select("id", "p1"), "id").withColumn("u", F.transform("v", lambda z: z / (S.norm(F.col("v")) + 1e-9)))
    return rounded(H.mixture_confidence(d, "port", "id", "p1", "u"))


@query("perturb_consistency")
def _(v):
    return rounded(H.perturb_consistency(v.preds, "port", "id", "s1", 0.3, 5))

"""Gates between the base (head 1) and the expert (head 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import gates as G
from ..operators import metrics as M
from .base import query, rounded
from .views import CLASSES

_K = ", k AS (SELECT CAST(unnest(range(10)) AS INT) AS cls)"
_SMX = "list_transform({a}, lambda z: exp(z - list_max({a})) / list_sum(list_transform({a}, lambda w: exp(w - list_max({a})))))"


@query("gate_features", "preds features", f""", q AS (SELECT id, p1, p2, m1, m2, {_SMX.format(a='s1')} AS q1, {_SMX.format(a='s2')} AS q2 FROM preds)
SELECT id, m1 AS margin1, m2 AS margin2, round(-list_sum(list_transform(q1, lambda z: z*ln(z + 1e-12))), 6) AS entropy1, round(-list_sum(list_transform(q2, lambda z: z*ln(z + 1e-12))), 6) AS entropy2, round(list_max(q1), 6) AS top1, round(list_max(q2), 6) AS top2, CAST(p1 <> p2 AS DOUBLE) AS differ,
 {", ".join(f"CAST(p1 = {c} AS DOUBLE) AS is_{c}" for c in range(10))}, round(sqrt(list_sum(list_transform(v, lambda z: z*z))), 6) AS knowledge_norm FROM q JOIN features USING (id)""")
def _(v):
    d = v.preds.join(v.features.select("id", "v"), "id")
    g = G.gate_features(d, "s1", "s2", CLASSES, "v")
    names = ["margin1", "margin2", "entropy1", "entropy2", "top1", "top2", "differ", *[f"is_{c}" for c in range(CLASSES)], "knowledge_norm"]
    return rounded(g.select("id", *names))


_GRID = """, tg AS (SELECT unnest([0.05, 0.1, 0.2, 0.4])::DOUBLE AS tau), gp AS (SELECT port, truth, tau, CASE WHEN m2 > tau THEN p2 ELSE p1 END AS p FROM preds, tg), gc AS (SELECT port, tau, truth, count(*) AS n, sum(CAST(p = truth AS INT)) AS ok FROM gp GROUP BY ALL), gb AS (SELECT port, tau, avg(ok/n) AS ba, sum(ok)/sum(n) AS accuracy, sum(n) AS n, count(*) AS classes FROM gc GROUP BY ALL)"""
TAUS = [0.05, 0.1, 0.2, 0.4]


@query("tau_grid", "preds", _GRID + " SELECT port, tau, round(ba, 6) AS ba, round(accuracy, 6) AS accuracy, CAST(n AS BIGINT) AS n, classes FROM gb")
def _(v):
    return rounded(G.tau_grid(v.preds, ["port"], "m2", "truth", "p1", "p2", TAUS))


@query("best_tau", "preds", _GRID + " SELECT port, tau, round(ba, 6) AS ba FROM (SELECT port, tau, ba, row_number() OVER (PARTITION BY port ORDER BY round(ba, 12) DESC, tau) AS rn FROM gb) q WHERE rn = 1")
def _(v):
    return rounded(G.best_tau(G.tau_grid(v.preds, ["port"], "m2", "truth", "p1", "p2", TAUS), ["port"]))


@query("class_aware_gate", "preds", _K + """, n AS (SELECT p.port, k.cls, greatest(1, count(*) FILTER (p1 = k.cls)) AS n FROM preds p CROSS JOIN k GROUP BY ALL), ra AS (SELECT port, cls, (1.0/n)/avg(1.0/n) OVER (PARTITION BY port) AS r FROM n), g AS (SELECT p.port, truth, delta, CASE WHEN m2 > 0.1 + delta*r OR p2 = p1 THEN p2 ELSE p1 END AS p FROM preds p JOIN ra ON ra.port = p.port AND ra.cls = p.p2, (SELECT unnest([0.0, 0.05, 0.1])::DOUBLE AS delta) dl), c AS (SELECT port, delta, truth, avg(CAST(p = truth AS INT)) AS rec FROM g GROUP BY ALL)
SELECT port, delta, round(avg(rec), 6) AS ba FROM c GROUP BY port, delta""")
def _(v):
    g = G.class_aware_gate(v.preds, "port", "m2", "p1", "p2", CLASSES, 0.1, [0.0, 0.05, 0.1])
    return rounded(M.balanced_accuracy(g, ["port", "delta"], "truth", "gated").select("port", "delta", "ba"))


_SHIFT = _K + """, cn AS (SELECT p.port, k.cls, count(*) FILTER (p1 = k.cls) AS c, count(*) AS n FROM preds p CROSS JOIN k GROUP BY ALL), tt AS (SELECT cls, sum(c) AS tc, sum(n) AS tn FROM cn GROUP BY cls), sh AS (SELECT port AS fold, cls, c/n - (tc - c)/(tn - n) AS shift FROM cn JOIN tt USING (cls)),
 cg AS (SELECT port, truth AS cls, avg(CAST(p2 = truth AS INT)) - avg(CAST(p1 = truth AS INT)) AS gain FROM preds GROUP BY ALL), np AS (SELECT count(DISTINCT port) AS n FROM preds), dk AS (SELECT p.port AS fold, k.cls, (coalesce((SELECT sum(gain) FROM cg WHERE cg.cls = k.cls), 0) - coalesce((SELECT sum(gain) FROM cg WHERE cg.cls = k.cls AND cg.port = p.port), 0)) / ((SELECT n FROM np) - 1) AS dk FROM (SELECT DISTINCT port FROM preds) p CROSS JOIN k),
 gg AS (SELECT fold, sum(shift*dk) AS g, sum(shift*dk)/(sqrt(sum(shift*shift))*sqrt(sum(dk*dk)) + 1e-9) AS cosine FROM sh JOIN dk USING (fold, cls) GROUP BY fold)"""


def shift_dk(v):
    return G.prior_shift(v.preds, "port", "p1", CLASSES), G.source_gain(v.preds, "port", "truth", "p1", "p2", CLASSES)


@query("prior_shift_gate", "preds", _SHIFT + " SELECT fold, round(g, 8) AS g, round(cosine, 6) AS cosine, g > 0 AS use_expert FROM gg")
def _(v):
    g = G.prior_shift_gate(*shift_dk(v))
    return g.select("fold", F.round("g", 8).alias("g"), F.round("cosine", 6).alias("cosine"), "use_expert")


@query("shuffled_gate", "preds", _SHIFT + """, o AS (SELECT fold, cls, dk, row_number() OVER (PARTITION BY fold ORDER BY cls) AS i, row_number() OVER (PARTITION BY fold ORDER BY sha256('z' || CAST(cls AS VARCHAR)), cls) AS j FROM dk), mv AS (SELECT a.fold, a.cls, b.dk FROM o a JOIN o b ON a.fold = b.fold AND a.i = b.j)
SELECT fold, round(sum(shift*mv.dk), 8) AS g FROM sh JOIN mv USING (fold, cls) GROUP BY fold""")
def _(v):
    g = G.shuffled_gate(*shift_dk(v), "z")
    return rounded(g.select("fold", "g"), 8)


_EPIS = _SHIFT + """, bb AS (SELECT port, avg(r2) - avg(r1) AS gain FROM (SELECT port, truth, avg(CAST(p2 = truth AS INT)) AS r2, avg(CAST(p1 = truth AS INT)) AS r1 FROM preds GROUP BY ALL) q GROUP BY port)"""


def port_gain(v):
    a, b = (M.balanced_accuracy(v.preds, ["port"], "truth", p).select("port", F.col("ba").alias(p)) for p in ("p1", "p2"))
    return a.join(b, "port").select(F.col("port").alias("fold"), (F.col("p2") - F.col("p1")).alias("gain"))


@query("risk_thresholds", "preds", _EPIS + """, ep AS (SELECT a.fold, b.fold AS q, round(b.g, 9) AS g, round(bb.gain, 9) AS gain FROM gg a JOIN gg b ON a.fold <> b.fold JOIN bb ON bb.port = b.fold), va AS (SELECT fold, tau, CASE WHEN g > tau THEN gain ELSE 0 END AS val FROM ep, (SELECT unnest([-0.005, 0.0, 0.002, 0.005])::DOUBLE AS tau) t),
 m AS (SELECT fold, tau, avg(val) - stddev_pop(val) AS risk, quantile_cont(val, 0.25) AS p25 FROM va GROUP BY ALL), r AS (SELECT fold, tau, row_number() OVER (PARTITION BY fold ORDER BY round(risk, 12) DESC, tau) AS a, row_number() OVER (PARTITION BY fold ORDER BY round(p25, 12) DESC, tau) AS b FROM m)
SELECT x.fold, x.tau AS tau_risk, y.tau AS tau_p25 FROM r x JOIN r y ON x.fold = y.fold AND x.a = 1 AND y.b = 1""")
def _(v):
    g = G.prior_shift_gate(*shift_dk(v)).select(F.col("fold").alias("q"), F.round("g", 9).alias("g"))
    e = port_gain(v).select(F.col("fold").alias("q"), F.round("gain", 9).alias("gain")).join(g, "q")
    folds = v.preds.select(F.col("port").alias("fold")).distinct()
    return G.risk_taus(folds.join(e, F.col("fold") != F.col("q")), [-0.005, 0.0, 0.002, 0.005])


@query("source_matching", "preds", _EPIS + """, cs AS (SELECT a.fold, b.fold AS q, sum(a.shift*b.shift)/(sqrt(sum(a.shift*a.shift))*sqrt(sum(b.shift*b.shift)) + 1e-9) AS c FROM sh a JOIN sh b ON a.cls = b.cls AND a.fold <> b.fold GROUP BY ALL)
SELECT fold, round(sum(exp(c/0.2)*gain)/sum(exp(c/0.2)), 6) AS matched_gain FROM cs JOIN bb ON bb.port = cs.q GROUP BY fold""")
def _(v):
    s = G.prior_shift(v.preds, "port", "p1", CLASSES)
    return rounded(G.source_matching(s, port_gain(v), 0.2).select("fold", "matched_gain"))


@query("per_class_mask", "preds", f""", cr AS (SELECT port, truth AS cls, avg(CAST(p1 = truth AS INT)) AS r1, avg(CAST(p2 = truth AS INT)) AS r2 FROM preds GROUP BY ALL HAVING count(*) >= 3), up AS (SELECT f.port AS fold, cls, avg(r2) > avg(r1) AS up FROM cr JOIN (SELECT DISTINCT port FROM preds) f ON f.port <> cr.port GROUP BY ALL),
 w AS (SELECT fold, [coalesce(bool_or(up) FILTER (cls = 0), false), {", ".join(f"coalesce(bool_or(up) FILTER (cls = {c}), false)" for c in range(1, 10))}] AS w FROM up GROUP BY fold), q AS (SELECT id, port, {_SMX.format(a='s1')} AS q1, {_SMX.format(a='s2')} AS q2 FROM preds), b AS (SELECT id, [CASE WHEN w[c] THEN q2[c] ELSE q1[c] END FOR c IN [1,2,3,4,5,6,7,8,9,10]] AS m FROM q JOIN w ON w.fold = q.port)
SELECT id, CAST(list_position(m, list_max(m)) - 1 AS INT) AS masked FROM b""")
def _(v):
    return G.per_class_mask(v.preds, "port", "truth", "p1", "p2", "s1", "s2", CLASSES).select("id", "masked")


@query("reference_gates", "preds", """, g AS (SELECT *, quantile_cont(m1, 0.5) OVER (PARTITION BY port) AS med, count(*) FILTER (m2 > 0.15) OVER (PARTITION BY port) AS k, row_number() OVER (PARTITION BY port ORDER BY sha256('0' || CAST(id AS VARCHAR)), id) AS rh FROM preds)
SELECT id, CASE WHEN m2 > 0.15 THEN p2 ELSE p1 END AS gate, CASE WHEN rh <= k THEN p2 ELSE p1 END AS random, CASE WHEN m1 <= med THEN p2 ELSE p1 END AS low_margin FROM g""")
def _(v):
    return G.reference_gates(v.preds.select("id", "port", "m1", "m2", "p1", "p2"), "port", "id", "m2", "m1", "p1", "p2", 0.15).select("id", "gate", "random", "low_margin")


@query("worst_class_tau", "preds", _GRID + ", w AS (SELECT tau, min(r) AS worst FROM (SELECT tau, truth, avg(CAST(p = truth AS INT)) AS r FROM gp GROUP BY ALL HAVING count(*) >= 5) q GROUP BY tau) SELECT tau, round(worst, 6) AS worst FROM w ORDER BY round(worst, 12) DESC, tau LIMIT 1")
def _(v):
    return rounded(G.worst_class_tau(v.preds, [], "m2", "truth", "p1", "p2", TAUS))


_CAND = ", cd AS (SELECT *, (p1 + p2) % 10 AS p3, round(m1 + m2, 6) / 2 AS m3 FROM preds)"


@query("multi_candidate_gate", "preds", _CAND + " SELECT id, CAST(CASE WHEN m1 >= m2 AND m1 >= m3 THEN p1 WHEN m2 >= m3 THEN p2 ELSE p3 END AS INT) AS pick FROM cd")
def _(v):
    d = v.preds.withColumns({"p3": ((F.col("p1") + F.col("p2")) % 10).cast("int"), "m3": F.round(F.col("m1") + F.col("m2"), 6) / 2})
    return d.select("id", G.multi_candidate_gate(d, {"m1": "p1", "m2": "p2", "m3": "p3"}).alias("pick"))


_EPI = ", ep AS (SELECT p.*, f.port AS fold, round(m2 - m1, 6) AS adv FROM preds p JOIN (SELECT DISTINCT port FROM preds) f ON f.port <> p.port)"


def episodes(v):
    f = v.preds.select(F.col("port").alias("fold")).distinct()
    return v.preds.join(F.broadcast(f), F.col("port") != F.col("fold")).withColumn("adv", F.round(F.col("m2") - F.col("m1"), 6))


@query("conservative_theta", "preds", _EPI + """, g AS (SELECT fold, port, theta, truth, avg(CAST(CASE WHEN adv > theta THEN p2 ELSE p1 END = truth AS INT)) AS r, avg(CAST(p1 = truth AS INT)) AS b FROM ep, (SELECT unnest([0.0, 0.1, 0.2, 0.3])::DOUBLE AS theta) t GROUP BY ALL), h AS (SELECT fold, port, theta, avg(r) - avg(b) AS gain FROM g GROUP BY ALL), w AS (SELECT fold, theta, min(gain) AS worst FROM h GROUP BY ALL)
SELECT fold, theta, round(worst, 6) + 0.0 AS worst_gain FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(worst, 12) DESC, theta) AS rn FROM w) q WHERE rn = 1""")
def _(v):
    return rounded(G.conservative_theta(episodes(v), "fold", "port", "adv", "truth", "p1", "p2", [0.0, 0.1, 0.2, 0.3]))


@query("quantile_rule", "preds", ", a AS (SELECT *, round(m2 - m1, 6) AS adv FROM preds), q AS (SELECT port, quantile_cont(adv, 0.5) AS a, quantile_cont(adv, 0.9) AS b FROM a GROUP BY port) SELECT id, CASE WHEN adv > q.a THEN p2 ELSE p1 END AS q50, CASE WHEN adv > q.b THEN p2 ELSE p1 END AS q90 FROM a JOIN q USING (port)")
def _(v):
    d = v.preds.withColumn("adv", F.round(F.col("m2") - F.col("m1"), 6))
    return G.quantile_rule(d, "port", "adv", "p1", "p2", {"q50": 0.5, "q90": 0.9}).select("id", "q50", "q90")


@query("rate_matched_gate", "preds", _EPI + """, rt AS (SELECT fold, avg(CAST(m2 > 0.15 AS INT)) AS rate FROM ep GROUP BY fold), r AS (SELECT id, port, p1, p2, row_number() OVER (PARTITION BY port ORDER BY m2 DESC, id) AS rn, count(*) OVER (PARTITION BY port) AS n FROM preds)
SELECT id, CASE WHEN rn <= round(rate*n) THEN p2 ELSE p1 END AS matched FROM r JOIN rt ON rt.fold = r.port""")
def _(v):
    return G.rate_matched_gate(v.preds, episodes(v).select("fold", "m2"), "port", "m2", "p1", "p2", 0.15, "id").select("id", "matched")


@query("class_and_port_veto", "preds", _EPI + """, cg AS (SELECT fold, port, truth, avg(CAST(p2 = truth AS INT)) - avg(CAST(p1 = truth AS INT)) AS g FROM ep GROUP BY ALL HAVING count(*) >= 3), us AS (SELECT fold, truth AS cls FROM cg GROUP BY ALL HAVING round(avg(g), 12) < 0), le AS (SELECT fold, min(m) AS least FROM (SELECT fold, port, avg(m2) AS m FROM ep WHERE port % 2 = 0 GROUP BY ALL) q GROUP BY fold), pm AS (SELECT port, round(avg(m2), 9) AS m FROM preds GROUP BY port)
SELECT id, CASE WHEN us.cls IS NOT NULL THEN p1 ELSE p2 END AS class_veto, CASE WHEN pm.m >= round(least, 9) THEN p2 ELSE p1 END AS port_veto FROM preds p LEFT JOIN us ON us.fold = p.port AND us.cls = p.p2 JOIN pm ON pm.port = p.port JOIN le ON le.fold = p.port""")
def _(v):
    e = episodes(v)
    bad = G.class_gain(e, ["fold", "port"], "truth", "p1", "p2", 3).groupBy("fold", "cls").agg(F.avg("gain").alias("g")).where(F.round("g", 12) < 0)
    a = G.veto(v.preds, "port", "p2", bad, "p2", "p1", "class_veto")
    least = e.where("port % 2 = 0").groupBy("fold", "port").agg(F.avg("m2").alias("m")).groupBy("fold").agg((F.min("m") - 1e-9).alias("least"))
    return G.port_veto(a, "port", "m2", "p2", "p1", least, "port_veto").select("id", "class_veto", "port_veto")


@query("net_gain_auc", "preds", """, g AS (SELECT CASE WHEN p1 <> truth AND p2 = truth THEN 1 WHEN p1 = truth AND p2 <> truth THEN -1 ELSE 0 END AS l, m1, m2 FROM preds), a AS (SELECT l, 'm1' AS predictor, round(m1, 2) AS s FROM g WHERE l <> 0 UNION ALL SELECT l, 'm2', round(m2, 2) FROM g WHERE l <> 0), r AS (SELECT *, rank() OVER (PARTITION BY predictor ORDER BY s) + (count(*) OVER (PARTITION BY predictor, s) - 1)/2.0 AS ar FROM a)
SELECT predictor, count(*) AS n, count(*) FILTER (l > 0) AS positives, round((sum(ar) FILTER (l > 0) - count(*) FILTER (l > 0)*(count(*) FILTER (l > 0) + 1)/2.0)/(count(*) FILTER (l > 0)*count(*) FILTER (l < 0)), 6) AS auc FROM r GROUP BY predictor""")
def _(v):
    d = v.preds.select(G.net_gain_label("truth", "p1", "p2").alias("l"), F.round("m1", 2).alias("m1"), F.round("m2", 2).alias("m2"))
    return rounded(G.predictor_auc(d, "l", ["m1", "m2"]))


@query("absorption_rate", "preds", """, t AS (SELECT port, quantile_cont(m1, 0.1) AS th FROM preds WHERE truth < 7 AND p1 = truth GROUP BY port) SELECT port, round(any_value(th), 8) AS threshold, round(avg(CASE WHEN truth < 7 THEN CAST(m1 >= th AS INT) END), 6) AS known_accepted, round(avg(CASE WHEN truth >= 7 THEN CAST(m1 >= th AS INT) END), 6) AS absorbed FROM preds JOIN t USING (port) GROUP BY port""")
def _(v):
    g, _per = G.absorption_rate(v.preds, ["port"], F.col("truth") < 7, F.col("p1") == F.col("truth"), "m1")
    return g.select("port", F.round("threshold", 8).alias("threshold"), F.round("known_accepted", 6).alias("known_accepted"), F.round("absorbed", 6).alias("absorbed"))


@query("absorption_by_class", "preds", ", t AS (SELECT quantile_cont(m1, 0.1) AS th FROM preds WHERE truth < 7 AND p1 = truth) SELECT truth AS cls, count(*) AS n, round(avg(CAST(m1 >= th AS INT)), 6) AS absorbed FROM preds, t WHERE truth >= 7 GROUP BY truth")
def _(v):
    _g, per = G.absorption_rate(v.preds, [], F.col("truth") < 7, F.col("p1") == F.col("truth"), "m1")
    return rounded(per.groupBy(F.col("truth").alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.avg("_over").alias("absorbed")))


@query("open_set_counts", "preds", """, c AS (SELECT port, truth, avg(CAST(m1 >= 0.1 AND p1 = truth AS INT)) AS r FROM preds WHERE truth < 7 GROUP BY ALL), b AS (SELECT port, avg(r) AS ba FROM c GROUP BY port)
SELECT port, round(any_value(ba), 6) AS known_ba, round(avg(CASE WHEN truth >= 7 THEN CAST(m1 < 0.1 AS INT) END), 6) AS unknown_recall, round(avg(CASE WHEN truth >= 7 THEN CAST(m1 >= 0.1 AS INT) END), 6) AS unknown_accepted FROM preds JOIN b USING (port) GROUP BY port""")
def _(v):
    return rounded(G.open_set_counts(v.preds, ["port"], "truth", "p1", F.col("m1") >= 0.1, F.col("truth") < 7))


@query("classwise_weight", "preds", """, t AS (SELECT truth, w, list_transform(list_zip(s1, s2), lambda t: round(t[1] + w*t[2], 9)) AS s FROM preds, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w) g), r AS (SELECT truth AS cls, w, avg(CAST(list_position(s, list_max(s)) - 1 = truth AS INT)) AS recall FROM t GROUP BY ALL)
SELECT cls, w, round(recall, 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY round(recall, 12) DESC, w) AS rn FROM r) q WHERE rn = 1""")
def _(v):
    return rounded(G.classwise_weight(v.preds, [], "s1", "s2", "truth", CLASSES, [0.0, 0.25, 0.5, 0.75, 1.0]))


@query("candidate_oracle", "preds", ", c AS (SELECT port, truth, count(*) AS n, sum(CAST(p1 = truth OR p2 = truth AS INT)) AS ok FROM preds GROUP BY ALL) SELECT port, round(avg(ok/n), 6) AS ba, round(sum(ok)/sum(n), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n, count(*) AS classes, false AS deployable FROM c GROUP BY port")
def _(v):
    return rounded(G.candidate_oracle(v.preds, ["port"], "truth", ["p1", "p2"]))
